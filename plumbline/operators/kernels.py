"""Graph kernels over edges (src, dst), as plans over DataFrames; every round of a loop is written out, never kept in executors alone.

Long ways are what loops over fronts are slow on, and in dependency graphs most nodes of a long way have one edge out.
Each kernel first deals with those: where a node's only edge leads is found for 2, 4, 8, .. steps by joining
a table of steps with itself, so a way of n steps takes log n rounds. What such a node gets from others, as a mark, a depth, a
sum or a set, is passed on by the same tables. The rest, whose nodes have two edges out or more, is what fronts
or colours run on: components by colouring, levels by counters of open dependencies, depths by relaxed fronts, and who
reaches whom in words of 64 nodes each, never in pairs of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranking import global_rank
from ..plans.scratch import free, materialize

#: Rounds of trimming that are planned as one, for graphs of few edges; as a plan it reads the edges again for each.
TRIMS_A_ROUND, FEW_EDGES = 3, 200_000
#: Trimming goes on before the first colours while it takes one edge in so many, and those are given up after so many rounds.
WORTH_TRIMMING, EARLY_ROUNDS = 10, 24
#: Bits of a node's number in its colour, and the most that its weight counts.
NUMBER_BITS, MOST_WEIGHT = 40, (1 << 22) - 1
#: Where fewer than one in so many nodes have one edge out, their ways aren't dealt with apart.
FEW_SINGLE = 4
#: Words of 64 nodes that a row holds.
WORDS = 16
#: Where a graph has many edges a node, components are first looked for among about so many of them.
KEPT = 4
#: Rounds over those are given up when they change fewer than one node in so many; what is missed then is left to the rest.
WORTH_A_ROUND = 50


def edges_of(df: DataFrame, src: str = "from_file", dst: str = "to_file") -> DataFrame:
    """Distinct edges without nulls, written once."""
    return materialize(df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct())


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _round(df: DataFrame) -> DataFrame:
    return materialize(df, small=True)


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass
class Forest:
    """The nodes with one edge out. ``steps[k]``: (node, next, dist), 2^k steps on or where the way ends; ``tops``: (node, top, dist), the way's end, a node with none or several edges out; ``turning``: nodes whose ways lead into a cycle of such nodes; ``cycles``: the nodes of those."""

    steps: list[DataFrame]
    tops: DataFrame
    turning: DataFrame
    cycles: DataFrame

    def nodes(self) -> DataFrame:
        return self.steps[0].select("node")

    def pushed(self, start: DataFrame, value: list[Column], merge: list[Column]) -> DataFrame:
        """``start`` (node, ..) passed on along all ways: a node gets ``value`` (over a step's row) of each node before it, merged with its own by ``merge``."""
        now = start
        for k, step in enumerate(self.steps):
            now = _round(now) if k % 2 == 0 else now  # two steps a written round
            sent = now.join(step.filter(F.col("dist") == 1 << k), "node").select(F.col("next").alias("node"), *value).join(self.nodes(), "node", "left_semi")
            keys = ["node"] + (["block"] if "block" in now.columns else [])
            now = now.unionByName(sent).groupBy(*keys).agg(*merge)
        return _round(now)


def forest(edges: DataFrame, far: bool = False) -> Forest:
    """By doubling; ``edges`` are distinct and no loops of one node. Where ways turn in cycles, ``far`` asks for steps as long as the cycles."""
    first = _round(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("next")).filter("n = 1").select("node", "next", F.lit(1).cast("long").alias("dist")))
    steps, going = [first], -1

    def doubled(a: DataFrame) -> DataFrame:
        b = a.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("dist").alias("more"))
        return a.join(b, "next", "left").select("node", F.coalesce("further", "next").alias("next"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.when(F.col("further").isNotNull(), F.col("next")).alias("by"))

    while True:  # two doublings a written round
        once = doubled(steps[-1])
        b = once.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("dist").alias("more"))
        both = once.withColumnRenamed("dist", "d").join(b, "next", "left")
        both = both.select("node", "next", F.col("d").alias("dist"), F.coalesce("further", "next").alias("next2"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("dist2"), F.when(F.col("further").isNotNull(), F.col("next")).alias("by"))
        both = _round(both)
        joined = both.select("node", F.col("next2").alias("next"), F.col("dist2").alias("dist"), "by")
        were, going, nodes = going, *joined.agg(F.count_distinct("by"), F.count("*")).first()
        steps.append(both.select("node", "next", "dist"))
        if not going:
            turning = first.limit(0).select("node")
            return Forest(steps, joined.select("node", F.col("next").alias("top"), "dist"), turning, turning)
        steps.append(joined.select("node", "next", "dist"))
        # The nodes that ways of 2^k steps come to become fewer until only those of cycles are left.
        if going == were and (not far or 1 << len(steps) > 2 * nodes):
            return Forest(steps, joined.filter("by is null").select("node", F.col("next").alias("top"), "dist"), joined.filter("by is not null").select("node"), _round(joined.select(F.col("by").alias("node")).dropna().distinct()))


def _relaxed(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): the shortest ways over ``edges`` (src, dst, length) from ``start`` (node, depth), by rounds of what has become shorter."""
    seen = front = _round(start.groupBy("node").agg(F.min("depth").alias("depth")))
    while not front.isEmpty():
        step = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("new"))
        merged = _round(seen.join(step, "node", "full").select("node", F.least("depth", "new").alias("depth"), (F.coalesce(F.col("new") < F.col("depth"), F.col("depth").isNull())).alias("shorter")))
        front, seen = merged.filter("shorter").select("node", "depth"), merged.select("node", "depth")
    return seen


def _reached(edges: DataFrame, seeds: DataFrame, few: int = 0) -> DataFrame:
    """(node): what ``seeds`` (node) reach, themselves too, by fronts; with ``few``, until fronts have become that small again."""
    seen = front = _round(seeds)
    n, grown = front.count(), False
    while n > few or (n and not grown):
        front = _round(front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen, n = seen.unionByName(front), front.count()
        grown = grown or n > few
    return seen


def bfs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): edges from the nearest seed, seeds (node) at 0."""
    seeds = _round(seeds.select("node").dropna().distinct())
    real = edges.filter("src <> dst")
    trees = forest(real, far=True)
    tops = trees.tops.select(F.col("node").alias("dst"), "top", "dist")
    core = real.join(trees.nodes().withColumnRenamed("node", "src"), "src", "left_anti")
    zero = F.lit(0).cast("long")
    ways = _round(core.join(tops, "dst", "left").join(trees.turning.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", F.coalesce("top", "dst").alias("dst"), (F.coalesce("dist", F.lit(0)) + 1).alias("length")))
    start = seeds.join(tops.withColumnRenamed("dst", "node"), "node", "left").join(trees.turning, "node", "left_anti").select(F.coalesce("top", "node").alias("node"), F.coalesce("dist", zero).alias("depth"))
    far = _relaxed(ways, start)
    entered = core.join(far, core["src"] == far["node"]).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    begun = entered.unionByName(seeds.select("node", zero.alias("depth"))).join(trees.nodes(), "node", "left_semi").groupBy("node").agg(F.min("depth").alias("depth"))
    inside = trees.pushed(begun, [(F.col("depth") + F.col("dist")).alias("depth")], [F.min("depth").alias("depth")])
    return _round(far.unionByName(inside))


def _singles(edges: DataFrame, side: str) -> tuple[int, int]:
    """Nodes on one side of the edges with one edge there, and all."""
    return tuple(edges.groupBy(side).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1), F.count("*")).first())


def _joint(edges: DataFrame) -> DataFrame:
    """(node, root): the components of more than one node, ``edges`` distinct and no loops; root is one of its nodes."""
    none = edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("root"))
    single, sources = _singles(edges, "src")
    if not sources:
        return none
    if single * FEW_SINGLE < sources:  # short ways: fronts and colours are quick
        single, sources = _singles(edges, "dst")
        return coloured(edges) if single * FEW_SINGLE < sources else _joint(_round(turned(edges)))
    trees = forest(edges)
    around = edges.join(trees.cycles.withColumnRenamed("node", "src"), "src", "left_semi")
    found = connected(around).withColumnRenamed("component", "root") if not trees.cycles.isEmpty() else none
    # What leads into such a cycle, or nowhere, can't come back.
    core = edges.join(trees.nodes().withColumnRenamed("node", "src"), "src", "left_anti")
    sources = _round(core.select("src").distinct())
    if sources.isEmpty():
        return found
    tops = _round(trees.tops.join(sources.withColumnRenamed("src", "top"), "top", "left_semi").select("node", "top"))
    led = core.join(tops.withColumnRenamed("node", "dst"), "dst", "left").select("src", "dst", F.coalesce("top", "dst").alias("to"))
    led = _round(led.join(sources.withColumnRenamed("src", "to"), "to", "left_semi"))
    inner = _joint(_round(led.filter("src <> to").select(F.col("to").alias("src"), F.col("src").alias("dst")).distinct()))
    of = lambda side: inner.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    # A node on the way to a top is in the top's component if some node of that component leads to it.
    back = led.filter("dst <> to").join(of("src"), "src", "left").join(of("to"), "to", "left").filter(F.coalesce("src_root", "src") == F.coalesce("to_root", "to"))
    marked = trees.pushed(back.select(F.col("dst").alias("node"), F.lit(1).alias("m")).distinct(), ["m"], [F.max("m").alias("m")]).select("node") if not back.isEmpty() else none.select("node")
    ways = _round(marked.join(tops, "node").join(inner.withColumnsRenamed({"node": "top", "root": "known"}), "top", "left").select("node", "top", F.coalesce("known", "top").alias("root")))
    return _round(found.unionByName(inner).unionByName(ways.select("node", "root")).unionByName(ways.select(F.col("top").alias("node"), "root")).distinct())


def _contracted(edges: DataFrame, among: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """For graphs of many edges a node: all nodes, (node, root) of parts of components, and the distinct edges between parts; None for others.

    What is connected both ways by some edges is so by all, so the components of a share of the edges can stand for their
    nodes; no edge is left out, each is looked at once to see whether it joins two parts. Few do, and the rounds run on those.
    """
    m = edges.count()
    share = m // (KEPT * max(1, edges.agg(F.approx_count_distinct("src")).first()[0])) if m > FEW_EDGES else 0
    if share < 2:
        return None
    real = edges.filter("src <> dst")
    some = materialize(_between(real.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(share)) == 0), among))
    parts = _parts(some)
    if among is None:
        a = b = parts.select("node", F.col("root").alias("part"))
    else:
        a = b = materialize(among.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part")))
    how = "left" if among is None else "inner"
    of = lambda x, side: x.select(F.col("node").alias(side), F.col("part").alias(f"{side}_part")).hint("shuffle_hash")
    led = real.join(of(a, "src"), "src", how).join(of(b, "dst"), "dst", how).select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst"))
    rest = materialize(led.filter("src <> dst").distinct())
    # A node in no part has all its edges in the rest.
    nodes = nodes_of(some.unionByName(rest).unionByName(_between(edges.filter("src = dst"), among)))
    return materialize(nodes), parts, rest


def _between(edges: DataFrame, among: DataFrame | None) -> DataFrame:
    """The edges between nodes of ``among`` (node), if that is given."""
    if among is None:
        return edges
    of = lambda side: among.select(F.col("node").alias(side)).hint("shuffle_hash")
    return edges.join(of("src"), "src", "left_semi").join(of("dst"), "dst", "left_semi").select("src", "dst")


def _components(edges: DataFrame, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(node, scc) of all nodes, edges (src, dst) that hold all those between components, and whether a component has several nodes."""
    if contracted := _contracted(edges, among):
        nodes, parts, rest = contracted
        joined = _joint(rest).select(F.col("node").alias("part"), F.col("root").alias("top"))
        placed = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).join(joined, "part", "left")
        found = _round(placed.filter("root is not null or top is not null").select("node", F.coalesce("top", "part").alias("root")))
        return _named(nodes, found), rest, not found.isEmpty()
    if among is not None:
        edges = materialize(_between(edges, among).distinct())
    real = edges.filter("src <> dst")
    found = _joint(real)
    return _named(nodes_of(edges), found), real, not found.isEmpty()


def _named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    named = found.join(found.groupBy("root").agg(F.min("node").alias("scc")), "root").select("node", "scc")
    return _round(nodes.join(named, "node", "left").select("node", F.coalesce("scc", "node").alias("scc")))


def scc(edges: DataFrame) -> DataFrame:
    """(node, scc): the smallest node that is reachable both ways, itself included."""
    if not _numbers(edges):
        ids, numbers = coded(edges)
        return _round(_decoded(scc(numbers), ids, "node", "scc"))
    return _components(edges)[0]


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (name, node) in their order as numbers, and the edges by number: rounds of loops then move 16 bytes an edge."""
    names = nodes_of(edges).withColumnRenamed("node", "name")
    ids = materialize(global_rank(names, [F.asc("name")], "node"))
    a, b = ids.withColumnsRenamed({"name": "src", "node": "a"}), ids.withColumnsRenamed({"name": "dst", "node": "b"})
    return ids, materialize(edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _decoded(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the numbers in ``columns`` as names again."""
    for c in columns:
        rows = rows.join(ids.select(F.col("node").alias(c), "name"), c).drop(c).withColumnRenamed("name", c)
    return rows


def _numbers(edges: DataFrame) -> bool:
    return dict(edges.dtypes)["src"] == "bigint"


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges whose source something leads to and whose target leads on."""
    for _ in range(rounds):
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")
    return materialize(edges)


def _colours(active: DataFrame, most: int | None, worth: int | None = None) -> DataFrame | None:
    """(node, colour): the largest (weight, number) that reaches a node, the weight being the smaller of its degrees; None if ``most`` rounds don't do.

    With ``worth``, rounds end when they move fewer than one node in so many: a colour is then one that reaches the node, if not the largest.
    """
    outs, ins = active.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o")), active.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    weight = F.least(F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0)), F.lit(MOST_WEIGHT))
    colour = materialize(outs.join(ins, "node", "full").select("node", (F.shiftleft(weight.cast("long"), NUMBER_BITS) + F.col("node")).alias("colour"), F.lit(True).alias("moved")))
    rounds, few = 0, colour.count() // worth if worth else 0
    while most is None or rounds < most:
        rounds += 1
        # Only what has changed is passed on; the smaller table is the one that is held.
        pushed = active.join(colour.filter("moved").hint("shuffle_hash"), active["src"] == colour["node"]).groupBy("dst").agg(F.max("colour").alias("pushed"))
        new = materialize(colour.drop("moved").join(pushed, colour["node"] == pushed["dst"], "left").select("node", F.greatest("colour", "pushed").alias("colour"), F.coalesce(F.col("pushed") > F.col("colour"), F.lit(False)).alias("moved")))
        free(colour)
        colour = new
        if colour.filter("moved").count() <= few:
            return colour.select("node", "colour")
    return None


def _split(active: DataFrame, colour: DataFrame, worth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The edges within a colour, and (node, root) of what reaches its colour's own node there."""
    a, b = colour.withColumnsRenamed({"node": "src", "colour": "x"}), colour.withColumnsRenamed({"node": "dst", "colour": "y"})
    inner = materialize(active.join(a, "src").join(b, "dst").filter("x = y").select("src", "dst"))
    root = F.col("colour").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    back = _reached(turned(inner), colour.filter(F.col("node") == root).select("node"), colour.count() // worth if worth else 0)
    return inner, materialize(back.join(colour, "node").select("node", root.alias("root")))


def _parts(edges: DataFrame) -> DataFrame:
    """(node, root): nodes that are connected both ways with their root, not always all of them; by one go of colours."""
    if not _numbers(edges):
        ids, numbers = coded(edges)
        return _round(_decoded(_parts(numbers), ids, "node", "root"))
    return _several(_split(edges, _colours(edges, None, WORTH_A_ROUND), WORTH_A_ROUND)[1])


def _several(found: DataFrame) -> DataFrame:
    """Those of (node, root) whose root has more nodes than one."""
    return _round(found.join(found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "root", "left_semi").select("node", "root"))


def coloured(edges: DataFrame) -> DataFrame:
    """(node, root) of components of more than one node. The largest (weight, number) that reaches a node is its colour, and what
    reaches the colour's own node back within the colour is its component. Weights are high inside dense components, so the large
    ones are found and left out first; nodes without in- or out-edges are trimmed from the rest, which is small by then.
    """
    if not _numbers(edges):
        ids, numbers = coded(edges)
        return _round(_decoded(coloured(numbers), ids, "node", "root"))
    active = materialize(edges.filter("src <> dst"))
    left, early, found = active.count(), True, []
    while left:
        trimmed = _trimmed(active, TRIMS_A_ROUND if left < FEW_EDGES else 1)
        now = trimmed.count()
        free(active)
        lost, active, left = left - now, trimmed, now
        if not left:
            break
        if lost and not (early and lost * WORTH_TRIMMING < left):
            continue
        colour = _colours(active, EARLY_ROUNDS if early else None)
        early = False
        if colour is None:
            continue
        inner, back = _split(active, colour)
        found.append(back)
        gone = back.select("node")
        free(active)
        active = materialize(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        free(inner)
        left = active.count()
    if not found:
        return edges.limit(0).select(F.col("src").alias("node"), F.col("src").alias("root"))
    return _several(_union(found))


def between_components(edges: DataFrame, sccs: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) between the components of ``sccs`` (node, scc); edges may be repeated, those of other nodes don't count."""
    of = lambda side, name: sccs.select(F.col("node").alias(side), F.col("scc").alias(name)).hint("shuffle_hash")
    return _round(edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def condensed(edges: DataFrame, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Forest]:
    """Components (node, scc), the distinct edges (src, dst) between them, and the forest of those. Where ``among`` (node) is given, only edges between its nodes count."""
    sccs, real, several = _components(edges, among)
    if not several:  # each node is a component
        return sccs, real, forest(real)
    a, b = sccs.withColumnsRenamed({"node": "src", "scc": "a"}), sccs.withColumnsRenamed({"node": "dst", "scc": "b"})
    deps = _round(real.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    return sccs, deps, forest(deps)


def _core_levels(ways: DataFrame) -> DataFrame:
    """(node, level) of all nodes of ``ways`` (src, dst, length) without cycles: counters of open dependencies, each edge is heard once."""
    open_ = _round(ways.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("level")))
    front = _round(ways.select(F.col("dst").alias("node")).distinct().join(open_, "node", "left_anti").withColumn("level", F.lit(0).cast("long")))
    done = [front]
    while not front.isEmpty():
        heard = front.join(ways, front["node"] == ways["dst"]).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"), F.max(F.col("level") + F.col("length")).alias("up"))
        now = _round(open_.join(heard, "node", "left").select("node", (F.col("open") - F.coalesce("k", F.lit(0))).alias("open"), F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        front, open_ = now.filter("open = 0").select("node", "level"), now.filter("open > 0")
        done = [*done, front] if len(done) < 32 else [_round(_union(done)), front]
    return _round(_union(done))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def dag_levels(deps: DataFrame, trees: Forest) -> DataFrame:
    """(node, level) of every node of ``deps``, which have no cycle; ``trees`` is their forest."""
    tops = trees.tops.select(F.col("node").alias("dst"), "top", "dist")
    core = deps.join(trees.nodes().withColumnRenamed("node", "src"), "src", "left_anti")
    ways = core.join(tops, "dst", "left").groupBy("src", F.coalesce("top", "dst").alias("to")).agg(F.max(F.coalesce("dist", F.lit(0)) + 1).alias("length")).select("src", F.col("to").alias("dst"), "length")
    ways = _round(ways)
    if ways.isEmpty():
        ends = trees.tops.select(F.col("top").alias("node"), F.lit(0).cast("long").alias("level")).distinct()
        return ends.unionByName(trees.tops.select("node", F.col("dist").alias("level")))
    high = _core_levels(ways)
    ends = _round(trees.tops.select(F.col("top").alias("node")).distinct().join(high, "node", "left").select("node", F.coalesce("level", F.lit(0).cast("long")).alias("level")))
    inside = trees.tops.join(ends.withColumnRenamed("node", "top"), "top").select("node", (F.col("level") + F.col("dist")).alias("level"))
    return _round(high.unionByName(ends.join(high, "node", "left_anti")).unionByName(inside))


def levels(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(node, scc, level, top): 1 more than the highest level that its component depends on, leaves 0; ``top`` where no edge leads to it.

    Where ``among`` (node) is given, only edges between its nodes count, and edges may be repeated.
    """
    if not _numbers(edges):
        ids, numbers = coded(edges)
        return _round(_decoded(levels(numbers), ids, "node", "scc").select("node", "scc", "level", "top"))
    sccs, deps, trees = condensed(edges, among)
    high = dag_levels(deps, trees).withColumnRenamed("node", "scc")
    headed = deps.select(F.col("dst").alias("scc")).union(sccs.filter("node <> scc").select("scc")).union(edges.filter("src = dst").select("src")).distinct().withColumn("headed", F.lit(True))
    placed = sccs.join(high, "scc", "left").join(headed, "scc", "left")
    return _round(placed.select("node", "scc", F.coalesce("level", F.lit(0).cast("long")).alias("level"), F.col("headed").isNull().alias("top")))


def _bits() -> list[str]:
    return [f"w{i}" for i in range(WORDS)]


def _merged() -> list[Column]:
    return [F.bit_or(w).alias(w) for w in _bits()]


def _ancestors(ways: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, block, w0, ..): for each node of ``ways`` (src, dst) without cycles, the nodes of ``ids`` (node, id) that reach it or that it is, as bits; a node is passed on when all before it are."""
    bit = lambda i: F.when(F.floor(F.col("id") / 64) % WORDS == i, F.expr("shiftleft(1L, cast(id % 64 as int))")).otherwise(F.lit(0).cast("long")).alias(f"w{i}")
    own = ids.select("node", F.floor(F.col("id") / (64 * WORDS)).alias("block"), *[bit(i) for i in range(WORDS)])
    open_ = _round(ways.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open")))
    front = _round(ways.select(F.col("src").alias("node")).distinct().join(open_, "node", "left_anti"))
    sets, done = _round(own), []
    while not front.isEmpty():
        ready = _round(sets.join(front, "node", "left_semi"))
        done = [*done, ready] if len(done) < 32 else [_round(_union(done)), ready]
        to = _round(front.join(ways, front["node"] == ways["src"]).select("node", "dst"))
        sent = to.join(ready, "node").drop("node").withColumnRenamed("dst", "node").groupBy("node", "block").agg(*_merged())
        sets = _round(sets.join(front, "node", "left_anti").unionByName(sent).groupBy("node", "block").agg(*_merged()))
        now = _round(open_.join(to.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k")), "node", "left").select("node", (F.col("open") - F.coalesce("k", F.lit(0))).alias("open")))
        front, open_ = now.filter("open = 0").select("node"), now.filter("open > 0")
    return _round(_union(done)) if done else own.limit(0)


def _weighed(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, n): the sum of the weights of each node's bits; ``ids`` are (node, id, weight). A weight's binary digits are masks over a block, so bits are counted, not listed."""
    digits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda j: F.floor(F.col("weight") / F.pow(F.lit(2.0), j)) % 2 == 1))
    bit = lambda i: F.bit_or(F.when(F.floor(F.col("id") / 64) % WORDS == i, F.expr("shiftleft(1L, cast(id % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}")
    masks = _round(ids.select("id", digits.alias("j")).groupBy(F.floor(F.col("id") / (64 * WORDS)).alias("block"), "j").agg(*[bit(i) for i in range(WORDS)]))
    ones = sum((F.bit_count(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}"))) for i in range(WORDS)), F.lit(0))
    return sets.join(masks, "block").groupBy("node").agg(F.sum(ones.cast("long") * F.pow(F.lit(2.0), F.col("j")).cast("long")).alias("n"))


def reach_counts(edges: DataFrame) -> DataFrame:
    """(node, n): how many other nodes reach it."""
    return dependants(*condensed(edges))


def dependants(sccs: DataFrame, deps: DataFrame, trees: Forest) -> DataFrame:
    """(node, n): how many other nodes reach it, given what ``condensed`` gives.

    On the condensation, where a component weighs its nodes. A node with one edge out reaches what its way's end
    reaches; so such nodes are counted with the end, by sums along the ways, and only the others are kept in sets.
    """
    weights = _round(sccs.groupBy(F.col("scc").alias("node")).agg(F.count("*").alias("weight")))
    below = trees.pushed(trees.nodes().join(weights, "node").select("node", F.col("weight").alias("s")), ["s"], [F.sum("s").alias("s")])
    hung = trees.tops.join(weights, "node").groupBy(F.col("top").alias("node")).agg(F.sum("weight").alias("hung"))
    core = _round(deps.join(trees.nodes().withColumnRenamed("node", "src"), "src", "left_anti"))
    own = weights.join(trees.nodes(), "node", "left_anti").join(hung, "node", "left").select("node", F.coalesce("hung", F.lit(0)).alias("hung"), "weight")
    own = _round(own)
    counts = below.select("node", "s").unionByName(own.select("node", (F.col("hung") + F.col("weight")).alias("s")))
    if not core.isEmpty():
        # Components with several edges out, numbered; each stands for itself and all that hangs on it.
        numbered = global_rank(own.join(core.select(F.col("src").alias("node")).distinct(), "node", "left_semi"), [F.asc("node")], "id")
        ids = _round(numbered.select("node", (F.col("id") - 1).alias("id"), (F.col("hung") + F.col("weight")).alias("weight")))
        ways = _round(core.join(trees.tops.select(F.col("node").alias("dst"), "top"), "dst", "left").select("src", F.coalesce("top", "dst").alias("dst")).distinct())
        sets = _ancestors(ways, ids)
        inner = _weighed(sets, ids).join(own.select("node", "hung", "weight"), "node").join(ids.select("node", F.lit(1).alias("numbered")), "node", "left")
        # The set of a node with edges out holds itself, with what hangs on it; that of another doesn't.
        inner = inner.select("node", F.when(F.col("numbered").isNull(), F.col("n") + F.col("hung") + F.col("weight")).otherwise(F.col("n")).alias("s"))
        entered = core.select("src", F.col("dst").alias("node")).join(trees.nodes(), "node", "left_semi").join(sets.withColumnRenamed("node", "src"), "src").drop("src").groupBy("node", "block").agg(*_merged())
        passed = trees.pushed(entered, ["block", *_bits()], _merged())
        more = _weighed(passed, ids).withColumnRenamed("n", "s")
        counts = below.unionByName(more).groupBy("node").agg(F.sum("s").alias("s")).unionByName(inner).unionByName(own.join(inner, "node", "left_anti").select("node", (F.col("hung") + F.col("weight")).alias("s")))
    return _round(sccs.join(counts.withColumnRenamed("node", "scc"), "scc").select("node", (F.col("s") - 1).alias("n")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the undirected component, by alternating stars."""
    now = materialize(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        seen, old = mark, now
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = materialize(large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct())
        free(old)


def stable_modules(pairs: DataFrame, most: float = 0.15, least_in: int = 3) -> DataFrame:
    """(module): the fixpoint of modules whose dependencies outside the stable set are few.

    ``pairs``: distinct (from_module, to_module) across modules. A module joins when it has no
    unstable dependency and at least two dependants, or instability of at most ``most`` and at
    least ``least_in`` dependants.
    """
    nodes = pairs.select(F.col("from_module").alias("module")).union(pairs.select("to_module")).distinct()
    ca = pairs.groupBy(F.col("to_module").alias("module")).agg(F.count("*").alias("ca"))
    stable = materialize(nodes.limit(0))
    while True:
        ce = pairs.join(stable, pairs["to_module"] == stable["module"], "left_anti").groupBy(F.col("from_module").alias("module")).agg(F.count("*").alias("ce"))
        rest = nodes.join(stable, "module", "left_anti").join(ca, "module", "left").join(ce, "module", "left").fillna(0, ["ca", "ce"])
        fresh = materialize(rest.filter(((F.col("ce") == 0) & (F.col("ca") >= 2)) | ((F.col("ce") > 0) & (F.col("ce") / (F.col("ca") + F.col("ce")) <= most) & (F.col("ca") >= least_in))).select("module"))
        if fresh.isEmpty():
            return stable
        stable = materialize(stable.union(fresh))
