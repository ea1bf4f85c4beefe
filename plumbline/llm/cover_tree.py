"""Near-duplicate embeddings: exact pairs over a cosine threshold by dual traversal of cover trees.

On unit vectors a cosine of s is a distance of sqrt(2 - 2 s). A node of a cover tree has a centre and a
covering radius, measured over all of its members; its children are a net of centres at least half its
radius apart, and members go to the nearest. Two nodes are compared by their centres' distance d and radii
r: with d - r - r' over the threshold's distance no pair of theirs is linked; with d + r + r' under it all are, and
they are counted and joined without being looked at; else their children are compared.

The upper levels are built by Spark, a level a round, from a bounded sample of each node; nodes that a task can hold
are the leaves of that part. The traversal runs over its nodes first. Pairs of leaves that neither rule settles are
compared in the task that holds the first leaf, by trees of the same kind in memory, while the second one's members
stream past. No pairs are written: a task gives each member's number of links and one edge to its component.

Equal vectors are one member with a weight. A leaf that can't be told apart any more is dealt by hash in parts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._scratch import materialize, ship, tidy
from ._skew import salted_join
from .ann import _matrix, usable
from .minhash import components

LEAST = 0.98
#: Members that one task holds of a leaf, and their bytes: each leaf meets all leaves in reach, so large ones are sent about least.
LEAF_ROWS = 16_384
LEAF_BYTES = 8 << 20
#: Members that a node's children are chosen from, about; twice as many at most.
SAMPLE_ROWS = 256
#: Children of a node, at most.
FAN_OUT = 64
LEVELS = 16
#: Members and children of a node of a tree in memory.
SMALL_LEAF = 64
SMALL_FAN_OUT = 16
#: Members of a node that pass one task of a level.
STREAM_ROWS = 65_536
#: What rounding may move a distance by, and the band around the threshold in which a cosine is summed term by term.
SLACK = 1e-9
BAND = 1e-12


def net(vectors: np.ndarray, most: int) -> np.ndarray:
    """Indexes of a net: each centre is the farthest from those before, until all are within half of the radius around the mean."""
    mean = vectors.mean(axis=0)
    from_mean = ((vectors - mean) ** 2).sum(axis=1)
    enough = from_mean.max() / 4
    chosen = [int(from_mean.argmax())]
    nearest = ((vectors - vectors[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < most and nearest.max() > enough:
        chosen.append(int(nearest.argmax()))
        np.minimum(nearest, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1), out=nearest)
    return np.array(chosen)


def to_nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


class CoverTree:
    """A cover tree over unit vectors; its members stand in the order of its leaves."""

    def __init__(self, vectors: np.ndarray):
        order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        todo = [(0, len(vectors), -1)]
        while todo:
            begin, end, parent = todo.pop()
            mine = vectors[order[begin:end]]
            centre = mine.mean(axis=0)
            radius = math.sqrt(((mine - centre) ** 2).sum(axis=1).max())
            at = len(self.nodes)
            self.nodes.append((begin, end))
            self.children.append([])
            self.centres.append(centre)
            self.radii.append(radius)
            if parent >= 0:
                self.children[parent].append(at)
            if end - begin <= SMALL_LEAF:
                continue
            centres = net(mine, SMALL_FAN_OUT)
            if len(centres) < 2:
                continue
            to = to_nearest(mine, mine[centres])
            sorted_to = np.argsort(to, kind="stable")
            order[begin:end] = order[begin:end][sorted_to]
            cuts = [0, *(np.flatnonzero(np.diff(to[sorted_to])) + 1).tolist(), end - begin]
            if len(cuts) > 2:
                todo.extend((begin + a, begin + b, at) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.order, self.vectors = order, np.ascontiguousarray(vectors[order])


class Joined:
    """Links and components of members held in one task, and of those that pass by."""

    def __init__(self, tree: CoverTree, weights: np.ndarray, least: float):
        self.tree, self.weights, self.least = tree, weights[tree.order], least
        self.reach = math.sqrt(max(0.0, 2 - 2 * least))
        self.links = np.zeros(len(weights), np.int64)
        self.roots = np.arange(len(weights))

    def _unite(self, roots: np.ndarray, some: np.ndarray) -> None:
        """Members with the roots ``some`` are one component, named by the smallest."""
        some = np.unique(some)
        if len(some) > 1:
            roots[np.isin(roots, some)] = some[0]

    def _compare(self, other: Joined, a: tuple[int, int], b: tuple[int, int], roots: np.ndarray, shift: int) -> None:
        same = other is self and a == b
        for x in range(a[0], a[1], 1024):
            for y in range(b[0], b[1], 1024):
                p, q = slice(x, min(x + 1024, a[1])), slice(y, min(y + 1024, b[1]))
                u, v = self.tree.vectors[p], other.tree.vectors[q]
                dots = u @ v.T
                linked = dots >= self.least
                for i, j in np.argwhere(np.abs(dots - self.least) < BAND).tolist():
                    linked[i, j] = (u[i] * v[j]).sum() >= self.least
                if same and x == y:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                self.links[p] += linked @ other.weights[q]
                if not same:
                    other.links[q] += self.weights[p] @ linked
                here, there = roots[p], roots[q.start + shift : q.stop + shift]
                apart = linked & (here[:, None] != there[None, :])
                while apart.any():
                    i, j = np.unravel_index(apart.argmax(), apart.shape)
                    self._unite(roots, np.array([here[i], there[j]]))  # here and there are views of roots
                    apart = linked & (here[:, None] != there[None, :])

    def traverse(self, other: Joined | None = None) -> np.ndarray:
        """Link this tree's members with those of ``other``, or with each other; the roots of the others' members, by place here (others follow)."""
        mine, theirs = self.tree, (other or self).tree
        shift = len(self.roots) if other else 0
        roots = np.concatenate([self.roots, np.arange(len(other.roots)) + shift]) if other else self.roots
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            a, b = mine.nodes[i], theirs.nodes[j]
            r, s = mine.radii[i], theirs.radii[j]
            same = other is None and i == j
            d = 0.0 if same else math.sqrt(((mine.centres[i] - theirs.centres[j]) ** 2).sum())
            if d - r - s > self.reach + SLACK:
                continue
            p, q = slice(*a), slice(*b)
            if d + r + s < self.reach - SLACK:
                held = other or self
                self.links[p] += held.weights[q].sum()
                if same:
                    self.links[p] -= self.weights[p]
                else:
                    held.links[q] += self.weights[p].sum()
                self._unite(roots, np.concatenate([roots[p], roots[b[0] + shift : b[1] + shift]]))
                continue
            here, there = mine.children[i], theirs.children[j]
            if same and here:
                todo.extend((here[x], here[y]) for x in range(len(here)) for y in range(x, len(here)))
            elif here and (r >= s or not there):
                todo.extend((x, j) for x in here)
            elif there:
                todo.extend((i, y) for y in there)
            else:
                self._compare(other or self, a, b, roots, shift)
        if other:
            self.roots = roots[: len(self.roots)].copy()
        return roots[shift:]


def keyed_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, v (unit vector), key (16 bytes that stand for label and vector) and grp (label and dimension) of the rows that take part."""
    ship(vectors.sparkSession)
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"), F.col(f"`{label}`").cast("string").alias("label"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", "v", F.concat_ws("|", "label", F.size("v").cast("string")).alias("grp"))

    def keyed(batches: Iterator) -> Iterator:
        for batch in batches:
            keys, units = [], []
            for x, grp in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = x.values.to_numpy() + 0.0  # -0.0 is 0.0
                keys.append(hashlib.blake2b(x.tobytes() + grp.encode(), digest_size=16).digest())
                x = x / np.abs(x).max()
                units.append(x / math.sqrt((x * x).sum()))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in units])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(units) if units else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(keys, pa.binary()), batch.column(2)], names=["id", "v", "key", "grp"])

    return rows.mapInArrow(tidy(keyed), "id long, v array<double>, key binary, grp string")


def _level(members: DataFrame, sizes: DataFrame, level: int) -> DataFrame:
    """cell, centre and kids (centres of children; none for a leaf) of each cell of ``members`` (cell, key, v)."""

    def chosen(sample: pa.Table) -> pa.Table:
        v = _matrix(sample.column("v").combine_chunks())
        v = v[np.lexsort(v.T[::-1])]
        fan = sample.column("fan")[0].as_py()
        kids = net(v, fan) if fan > 1 else []
        kids = v[kids].tolist() if len(kids) > 1 else []
        return pa.table({"cell": [sample.column("cell")[0].as_py()], "centre": [v.mean(axis=0).tolist()], "kids": pa.array([kids], pa.list_(pa.list_(pa.float64())))})

    every = F.greatest(F.floor(F.col("members") / SAMPLE_ROWS), F.lit(1))
    # As many children as make leaves of half the size that they may have, so that few have to be split once more.
    fan = F.when((F.col("members") > F.col("most")) & F.lit(level < LEVELS), F.least(F.lit(FAN_OUT), F.ceil(2 * F.col("members") / F.col("most")))).otherwise(0).cast("int")
    of = sizes.select("cell", every.alias("every"), fan.alias("fan"))
    sample = members.join(of, "cell").filter(F.pmod(F.xxhash64("key", F.lit(level)), F.col("every")) == 0).select("cell", "fan", "v")
    return sample.groupBy("cell").applyInArrow(chosen, "cell string, centre array<double>, kids array<array<double>>")


def _placed(members: DataFrame, chosen: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members`` with far (the distance from their cell's centre) and kid (the nearest child; -1 in a leaf); cells stream through tasks."""
    columns = ["cell", "key", "v", "weight", "rep"]
    salts = sizes.select("cell", F.ceil(F.col("members") / STREAM_ROWS).cast("int").alias("salts"))
    centres = chosen.join(salts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), F.col("centre").alias("v"), F.lit(0).cast("long").alias("weight"), F.lit(None).cast("long").alias("rep"), "kids")
    heavy = salts.filter("salts > 1")  # at most members / STREAM_ROWS
    rows = members.join(heavy, "cell", "left").select(*columns, F.coalesce(F.pmod(F.xxhash64("key"), F.col("salts")), F.lit(0)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("array<array<double>>").alias("kids"))
    names = ["cell", "salt", "kind", "key", "v", "weight", "rep", "kids"]
    dealt = centres.select(names).unionByName(rows.select(names)).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")

    def placed(batches: Iterator) -> Iterator:
        centre = kids = None
        for batch in batches:
            kind, cell = batch.column(2).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(cell) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)], strict=True):
                if a == b:
                    continue
                if kind[a] == 0:
                    centre, some = np.array(batch.column(4)[a].as_py()), batch.column(7)[a].as_py()
                    kids = np.array(some) if some else None
                    continue
                some = batch.slice(a, b - a)
                v = _matrix(some.column(4))
                far = np.sqrt(((v - centre) ** 2).sum(axis=1))
                kid = np.full(len(v), -1, np.int32) if kids is None else to_nearest(v, kids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(3), some.column(4), some.column(5), some.column(6), pa.array(far), pa.array(kid)], names=[*columns, "far", "kid"])

    return dealt.mapInArrow(tidy(placed), "cell string, key binary, v array<double>, weight long, rep long, far double, kid int")


def upper_levels(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): nodes are cell, parent, centre, radius, members, weight, least (id) and leaf; leaves are the members by leaf cell."""
    nodes, leaves, level = [], [], 0
    while True:
        most = F.greatest(F.lit(2), F.least(F.lit(LEAF_ROWS), F.floor(F.lit(LEAF_BYTES) / (8 * F.max(F.size("v"))))))
        sizes = materialize(members.groupBy("cell").agg(F.count("*").alias("members"), F.sum("weight").alias("weight"), F.min("rep").alias("least"), most.alias("most")), "cells", small=True)
        chosen = materialize(_level(members, sizes, level), "cell-centres", small=True)
        placed = materialize(_placed(members, chosen, sizes), "placed-members")
        radii = placed.groupBy("cell").agg(F.max("far").alias("radius"))
        parent = F.when(F.lit(level > 0), F.regexp_replace("cell", "/[0-9]+$", ""))
        nodes.append(materialize(sizes.join(chosen, "cell").join(radii, "cell").select("cell", parent.alias("parent"), "centre", "radius", "members", "most", "weight", "least", (F.size("kids") == 0).alias("leaf")), "cell-nodes", small=True))
        leaves.append(placed.filter("kid < 0").select("cell", "key", "v", "weight", "rep"))
        members = placed.filter("kid >= 0").select(F.concat_ws("/", "cell", "kid").alias("cell"), "key", "v", "weight", "rep")
        level += 1
        if nodes[-1].filter("not leaf").isEmpty():
            break
    every, held = nodes[0], leaves[0]
    for x, y in zip(nodes[1:], leaves[1:], strict=True):
        every, held = every.unionByName(x), held.unionByName(y)
    return (materialize(every, "nodes", small=True) if level > 1 else every), held


def node_pairs(nodes: DataFrame, reach: float) -> DataFrame:
    """(x, y, all) with x <= y: pairs of nodes that are linked as a whole (all), and pairs of leaves to be compared."""
    of = nodes.select("cell", "centre", "radius", "leaf")
    now = of.join(nodes.filter("parent is null").select("cell"), "cell").select(F.col("cell").alias("x"), F.col("cell").alias("y"))
    settled = []
    while True:
        x, y = (of.select(*[F.col(c).alias(f"{c}_{s}") for c in of.columns]).withColumnRenamed(f"cell_{s}", s) for s in "xy")
        d = F.sqrt(F.aggregate(F.zip_with("centre_x", "centre_y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p))
        d = F.when(F.col("x") == F.col("y"), F.lit(0.0)).otherwise(d)
        both = F.col("radius_x") + F.col("radius_y")
        pairs = now.join(x, "x").join(y, "y").withColumn("d", d).filter(F.col("d") - both <= reach + SLACK)
        pairs = pairs.withColumn("all", F.col("d") + both < reach - SLACK).select("x", "y", "all", "leaf_x", "leaf_y")
        pairs = materialize(pairs, "node-pairs", small=True)
        settled.append(pairs.filter("all or (leaf_x and leaf_y)").select("x", "y", "all"))
        further = pairs.filter("not all and not (leaf_x and leaf_y)")
        if further.isEmpty():
            break
        kids = nodes.filter("parent is not null").select("parent", "cell")
        down = lambda side: kids.select(F.col("parent").alias(side), F.col("cell").alias(f"kid_{side}"))
        now = further.join(down("x"), "x", "left").join(down("y"), "y", "left").select("x", "y", F.coalesce("kid_x", "x").alias("kx"), F.coalesce("kid_y", "y").alias("ky"))
        now = now.filter("x <> y or kx <= ky").select(F.least("kx", "ky").alias("x"), F.greatest("kx", "ky").alias("y"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def _whole_links(nodes: DataFrame, leaves: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, edges) of pairs of nodes that are linked as a whole: key and n; a and b."""
    of = nodes.select("cell", "weight", "least")
    side = lambda s, t: pairs.select(F.col(s).alias("cell"), F.col(t).alias("other"))
    other = of.select(F.col("cell").alias("other"), F.col("weight").alias("w"), F.col("least").alias("l"))
    # A node gets the weights of all nodes that it is linked to, its own among them if it is linked to itself.
    gets = side("x", "y").unionByName(side("y", "x").filter("cell <> other")).join(other, "other").groupBy("cell").agg(F.sum("w").alias("n"), F.min("l").alias("l"), F.max((F.col("cell") == F.col("other")).cast("int")).alias("own"))
    # A leaf gets what the nodes above it get.
    above = nodes.filter("leaf").select(F.col("cell").alias("leaf_cell"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS + 1)), lambda i: F.regexp_replace("cell", F.concat(F.lit("(/[0-9]+){"), i.cast("string"), F.lit("}$")), ""))).alias("cell")).distinct()
    gets = materialize(above.join(gets, "cell").groupBy(F.col("leaf_cell").alias("cell")).agg(F.sum("n").alias("n"), F.min("l").alias("l"), F.max("own").alias("own")), "whole-links", small=True)
    rows = leaves.join(gets, "cell")
    edges = rows.select(F.col("rep").alias("a"), F.col("l").alias("b"))
    joint = side("x", "y").join(of, "cell").join(other, "other").select(F.col("least").alias("a"), F.col("l").alias("b"))
    return rows.select("key", (F.col("n") - F.when(F.col("own") == 1, F.col("weight")).otherwise(0)).alias("n")), edges.unionByName(joint)


def _compared(leaves: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """key, n (links), a and b (an edge, or null) of members of the ``pairs`` (x, y) of leaves, compared in tasks."""
    parts = nodes.filter("leaf").select("cell", F.ceil(F.col("members") / F.col("most")).cast("int").alias("parts"))
    rows = leaves.join(parts.filter("parts > 1"), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    hosts = parts.select(F.col("cell").alias("x"), "parts")
    asked = pairs.filter("x <> y").join(hosts, "x").select(F.col("y").alias("cell"), F.col("x").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
    own = pairs.filter("x = y").select(F.col("x").alias("cell"))
    within = own.join(parts.filter("parts > 1"), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
    names = ["to", "to_part", "kind", "cell", "part", "own", "key", "v", "weight", "rep"]
    held = rows.join(own.withColumn("own", F.lit(True)), "cell", "left").select(F.col("cell").alias("to"), F.col("part").alias("to_part"), F.lit(0).alias("kind"), "cell", "part", F.coalesce("own", F.lit(False)).alias("own"), "key", "v", "weight", "rep")
    passing = rows.join(asked, "cell").withColumns({"kind": F.lit(1), "own": F.lit(False)}).select(names)
    passing = passing.unionByName(rows.join(within, "cell").filter("part > to_part").withColumns({"to": F.col("cell"), "kind": F.lit(1), "own": F.lit(False)}).select(names))
    streamed = held.select(names).unionByName(passing).repartition("to", "to_part").sortWithinPartitions("to", "to_part", "kind", "cell", "part").select("to", "to_part", "kind", "cell", "part", "own", "key", "v", "weight", "rep")

    def run(batches: Iterator) -> Iterator:
        def blocks() -> Iterator:
            """Rows of one (to, to_part, kind, cell, part) at a time."""
            last, gathered = None, []
            for batch in batches:
                codes = [batch.column(i).dictionary_encode().indices.to_numpy() if i in (0, 3) else batch.column(i).to_numpy() for i in range(5)]
                changes = np.zeros(max(0, len(batch) - 1), bool)
                for c in codes:
                    changes |= np.diff(c) != 0
                cuts = (np.flatnonzero(changes) + 1).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                    if a == b:
                        continue
                    key = tuple(batch.column(i)[a].as_py() for i in range(5))
                    if key != last and gathered:
                        yield last, pa.Table.from_batches(gathered)
                        gathered = []
                    last = key
                    gathered.append(batch.slice(a, b - a))
            if gathered:
                yield last, pa.Table.from_batches(gathered)

        def tree(rows: pa.Table) -> Joined:
            v = rows.column("v").combine_chunks()
            return Joined(CoverTree(_matrix(v)), rows.column("weight").to_numpy(), least)

        def made(rows: pa.Table, links: np.ndarray, reps: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
            """Those of ``rows``, in tree order, that have links."""
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks().take(pa.array(some)), pa.array(links[some]), pa.array(reps[some]), pa.array(to[some])], names=["key", "n", "a", "b"])

        at, held, host, reps = None, None, None, None
        ordered = lambda joined, rows: rows.take(pa.array(joined.tree.order))
        for (to, to_part, kind, _, _), rows in blocks():
            if (to, to_part) != at and host is not None:
                yield made(held, host.links, reps, reps[host.roots])
                host = None
            at = (to, to_part)
            if kind == 0:
                host = tree(rows)
                held = ordered(host, rows)
                reps = held.column("rep").to_numpy()
                if rows.column("own")[0].as_py():
                    host.traverse()
            elif host is not None:
                guest = tree(rows)
                roots = host.traverse(guest)
                rows = ordered(guest, rows)
                names = rows.column("rep").to_numpy()
                yield made(rows, guest.links, names, np.concatenate([reps, names])[roots])
        if host is not None:
            yield made(held, host.links, reps, reps[host.roots])

    return streamed.mapInArrow(tidy(run), "key binary, n long, a long, b long")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors``.

    Two vectors of one label and dimension are linked if their cosine is ``least`` or more. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without label or id, are linked with nothing: their
    component is their id, without id null, and they are kept. Rows that repeat label, id and vector are one vector. An id
    with several vectors is one node of the components; each row counts the links of its own vector. Other
    columns are never read; an empty table gives an empty one.
    """
    keyed = materialize(keyed_vectors(vectors, vec_id, vector, label), "unit-vectors")
    classes = materialize(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"), F.count("*").alias("rows"), F.first("grp").alias("cell"), F.first("v").alias("v")), "vector-classes")
    members = classes.select("cell", "key", "v", "weight", "rep")
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    nodes, leaves = upper_levels(members)
    pairs = materialize(node_pairs(nodes, reach), "settled-pairs", small=True)
    whole, edges = _whole_links(nodes, leaves, pairs.filter("all"))
    compared = materialize(_compared(leaves, nodes, pairs.filter("not all"), least), "compared-links")
    links = compared.select("key", "n").unionByName(whole).groupBy("key").agg(F.sum("n").alias("n"))
    several = keyed.groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("id")
    shared = keyed.join(several, "id").select("id", "key").distinct().join(classes.select("key", "rep"), "key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = compared.select("a", "b").unionByName(edges).unionByName(shared).filter("a <> b")
    found = materialize(components(edges), "vector-components", small=True).withColumnRenamed("component", "whole")
    out = classes.select("key", "rep", "weight", "rows").join(links, "key", "left").join(found, F.col("rep") == F.col("node"), "left")
    out = materialize(out.select("key", "rows", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("whole", "rep").alias("component_id")), "class-links")
    linked = salted_join(keyed.select("id", "key"), out, ["key"], "rows", "id").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    v, i = F.col(f"`{vector}`").cast("array<double>"), F.col(f"`{vec_id}`").cast("long")
    apart = vectors.select(i.alias("vec_id"), (i.isNotNull() & F.col(f"`{label}`").isNotNull() & usable(v)).alias("u")).filter("not u").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
