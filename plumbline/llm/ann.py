"""Approximate nearest neighbours by largest inner product: a vantage-point tree for each shard.

Inner products become distances by one more component: with M the largest norm of all vectors,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q * M / |q|, 0) give |q' - x'|^2 = 2 M^2 - 2 M q.x / |q|.

A shard's tree halves its vectors by their distance from a vantage point and keeps the distance
range of either half. A query skips a leaf when ``factor`` times the lower bound that the triangle
inequality gives exceeds the distance of its k-th nearest so far: factor 1 is exact search, a larger
one trades recall for time. Scores are inner products of the original vectors in double precision.

Shards are the leaves of one more such tree, whose vantage points and medians come from a bounded sample
and whose distance ranges come from all vectors. A query first searches the shard that the smaller lower
bounds lead to; its k-th nearest there, by the same rule, says which other shards it is sent to. A shard of more
rows than a task shall hold, as one of many equal vectors, is dealt over several parts. A task holds one
part and streams blocks of queries past it, so memory doesn't grow with the number of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._scratch import materialize, ship, tidy

K = 20
#: Production value; recall measured against brute force is in the README.
FACTOR = 4.0
#: Rows of a shard: ROOT_ROWS times the root of all rows, from SHARD_ROWS to what SHARD_BYTES hold.
SHARD_ROWS = 8192
ROOT_ROWS = 64
SHARD_BYTES = 64 << 20
#: Vectors that the shards' tree is fitted on, at most.
SAMPLE_ROWS = 16_384
LEAF_ROWS = 256
QUERY_ROWS = 2048
#: Queries that go down the shards' tree together.
ROUTED_ROWS = 512


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class VantageTree:
    """A tree over the rows of ``vectors`` for queries by inner product; ``top`` is M."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, leaf_rows: int = LEAF_ROWS):
        self.top = top
        rest = np.sqrt(np.maximum(top * top - (vectors * vectors).sum(axis=1), 0))
        space = np.column_stack([vectors, rest])
        self.points: list[np.ndarray] = []
        self.leaves: list[tuple[list[tuple[int, float, float]], tuple[int, int]]] = []
        placed: list[np.ndarray] = []
        at = 0
        todo = [(np.arange(len(ids)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append((path, (at, at + len(rows))))
                placed.append(rows)
                at += len(rows)
                continue
            mine = space[rows]
            point = mine[((mine - mine.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            far = np.sqrt(((mine - point) ** 2).sum(axis=1))
            order = np.argsort(far, kind="stable")
            self.points.append(point)
            for half in (order[: len(rows) // 2], order[len(rows) // 2 :]):
                todo.append((rows[half], [*path, (len(self.points) - 1, float(far[half].min()), float(far[half].max()))]))
        self.ids, self.vectors = ids[np.concatenate(placed)], np.ascontiguousarray(vectors[np.concatenate(placed)])
        self.points = np.array(self.points).reshape(-1, space.shape[1])

    def bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(queries, leaves): no vector of the leaf is nearer than this."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not len(self.points):
            return out
        dots = queries @ self.points[:, :-1].T * (self.top / norms)[:, None]
        d = np.sqrt(np.maximum(self.top**2 + (self.points**2).sum(axis=1) - 2 * dots, 0))
        for j, (path, _) in enumerate(self.leaves):
            for node, lo, hi in path:
                np.maximum(out[:, j], np.maximum(lo - d[:, node], d[:, node] - hi), out=out[:, j])
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of the k nearest of each query but those of its own id."""
        norms = _norms(queries)
        lower = self.bounds(queries, norms)
        n = len(queries)
        best = np.full((n, k), -np.inf)
        place = np.full((n, k), -1)
        slack = 1e-9 * norms * self.top
        first = lower.argmin(axis=1)

        def exact(row: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """``some`` places and their scores by rank; the same sum wherever a vector stands, so ties are ties."""
            scores = (queries[row] * self.vectors[some]).sum(axis=1)
            order = np.lexsort([self.ids[some], -scores])
            return some[order], scores[order]

        def look(leaf: int, rows: np.ndarray) -> None:
            begin, end = self.leaves[leaf][1]
            near = queries[rows] @ self.vectors[begin:end].T
            near[self.ids[begin:end] == query_ids[rows][:, None]] = -np.inf
            rows_of = np.flatnonzero(near.max(axis=1) >= best[rows, -1] - slack[rows])
            rows, near = rows[rows_of], near[rows_of]
            if not len(rows):
                return
            scores = np.concatenate([best[rows], near], axis=1)
            places = np.concatenate([place[rows], np.broadcast_to(np.arange(begin, end), near.shape)], axis=1)
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            kept = np.take_along_axis(scores, top, axis=1)
            order = np.argsort(-kept, axis=1)
            least = kept.min(axis=1)
            best[rows] = np.take_along_axis(kept, order, axis=1)
            place[rows] = np.take_along_axis(np.take_along_axis(places, top, axis=1), order, axis=1)
            tied = ((scores >= (least - slack[rows])[:, None]).sum(axis=1) > k) & (least > -np.inf)
            for i in np.flatnonzero(tied).tolist():
                some, s = exact(int(rows[i]), places[i][scores[i] >= least[i] - slack[rows[i]]])
                best[rows[i]], place[rows[i]] = s[:k], some[:k]

        for leaf in np.unique(first).tolist():
            look(leaf, np.flatnonzero(first == leaf))
        for leaf in np.argsort(lower.mean(axis=0)).tolist():
            reach = np.sqrt(np.maximum(2 * self.top**2 - 2 * self.top * np.where(best[:, -1] > -np.inf, best[:, -1], -2 * self.top * norms) / norms, 0))
            rows = np.flatnonzero((factor * lower[:, leaf] <= reach + 1e-6 * self.top) | (best[:, -1] == -np.inf))
            rows = rows[first[rows] != leaf]
            if len(rows):
                look(leaf, rows)
        got = [exact(i, place[i][best[i] > -np.inf]) for i in range(n)]
        row = np.repeat(np.arange(n), [len(x) for x, _ in got])
        return row, self.ids[np.concatenate([x for x, _ in got])], np.concatenate([x for _, x in got])


class Router:
    """A complete binary tree of vantage points over the space of x'; its leaves are shards."""

    def __init__(self, sample: np.ndarray, top: float, shards: int):
        self.top, self.depth = top, math.ceil(math.log2(shards)) if shards > 1 else 0
        space = self.lifted(sample)
        self.points = np.zeros((2**self.depth - 1, space.shape[1]))
        self.cuts = np.full(len(self.points), np.inf)
        rows = {0: np.arange(len(space))}
        for node in range(len(self.points)):
            mine = space[rows.pop(node)]
            if not len(mine):
                rows[2 * node + 1] = rows[2 * node + 2] = np.zeros(0, np.int64)
                continue
            self.points[node] = mine[((mine - mine.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            far = self.far(space, np.full(len(space), node))
            inside = self.members(space, node)
            self.cuts[node] = np.median(far[inside])
            left = far <= self.cuts[node]
            rows[2 * node + 1], rows[2 * node + 2] = np.flatnonzero(inside & left), np.flatnonzero(inside & ~left)
        self.low = self.high = np.zeros(0)

    def members(self, space: np.ndarray, node: int) -> np.ndarray:
        """Which rows come to ``node``, whose ancestors are cut already."""
        out, path = np.ones(len(space), bool), []
        while node:
            path.append(((node - 1) // 2, node % 2 == 0))
            node = (node - 1) // 2
        for parent, right in path:
            out &= (self.far(space, np.full(len(space), parent)) > self.cuts[parent]) == right
        return out

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.sqrt(np.maximum(self.top * self.top - (vectors * vectors).sum(axis=1), 0))])

    def far(self, space: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(((space - self.points[nodes]) ** 2).sum(axis=1))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and its distances from the vantage points of its path."""
        space, node = self.lifted(vectors), np.zeros(len(vectors), np.int64)
        far = np.zeros((len(vectors), self.depth))
        for level in range(self.depth):
            far[:, level] = self.far(space, node)
            node = 2 * node + 1 + (far[:, level] > self.cuts[node])
        return node - len(self.points), far

    def measured(self, ranges: dict[int, np.ndarray]) -> None:
        """Take each leaf's ranges; a node's range of distances from its parent's point is that of all leaves below it, and empty nodes are never gone to."""
        self.low, self.high = np.full(2 ** (self.depth + 1) - 1, np.inf), np.full(2 ** (self.depth + 1) - 1, -np.inf)
        for leaf, spread in ranges.items():
            node = leaf + len(self.points)
            for lo, hi in spread[::-1]:
                self.low[node], self.high[node] = min(self.low[node], lo), max(self.high[node], hi)
                node = (node - 1) // 2

    def _distances(self, queries: np.ndarray, scale: np.ndarray, points: np.ndarray) -> np.ndarray:
        """From each query to its own row of ``points``, or to one point."""
        return np.sqrt(np.maximum(self.top**2 + (points**2).sum(axis=-1) - 2 * (queries * points[..., :-1]).sum(axis=-1) * scale, 0))

    def home(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query comes to by the smaller lower bound, on ties by its side of the cut."""
        scale, node, low = self.top / _norms(queries), np.zeros(len(queries), np.int64), np.zeros(len(queries))
        for _ in range(self.depth):
            d = self._distances(queries, scale, self.points[node])
            left, right = (np.maximum(low, np.where(np.isfinite(self.low[c]), np.maximum(self.low[c] - d, d - self.high[c]), np.inf)) for c in (2 * node + 1, 2 * node + 2))
            go = (right < left) | ((right == left) & (d > self.cuts[node]))
            low, node = np.where(go, right, left), 2 * node + 1 + go
        return node - len(self.points)

    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of queries) of all leaves whose lower bound times ``factor`` is within a query's reach; subtrees out of reach aren't entered."""
        scale = self.top / _norms(queries)
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, rows, low = todo.pop()
            if node >= len(self.points):
                yield node - len(self.points), rows
                continue
            d = self._distances(queries[rows], scale[rows], self.points[node])
            for child in (2 * node + 1, 2 * node + 2):
                if np.isfinite(self.low[child]):
                    bound = np.maximum(low, np.maximum(self.low[child] - d, d - self.high[child]))
                    near = factor * bound <= reach[rows]
                    if near.any():
                        todo.append((child, rows[near], bound[near]))


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), 1e-150)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def nearest(base: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest of ``base`` found, but rows of its own id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on either
    side, nor do rows without id. Vectors are compared within one dimension. Ties go to the smaller
    id. Fewer candidates than k give fewer rows; empty tables give an empty result. Rows that repeat an id
    are one candidate and one query: a neighbour stands once in a list, with the best score of their
    vectors, and no row of the query's id is its neighbour. Other columns are never read.
    """
    spark = base.sparkSession
    ship(spark)

    def rows(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        df = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("v")))

    held, asked = rows(base), rows(queries).distinct()
    largest = F.array_max(F.transform("v", F.abs))
    total, most, dims = held.agg(F.count("*"), F.max(largest), F.mode(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # Where squares would leave the range of doubles, all is scaled by a power of two, which changes no digit.
    scale = 0 if 1e-100 < most < 1e100 else math.frexp(most)[1]
    if scale:
        held, asked = (df.withColumn("v", F.transform("v", lambda x: x / F.lit(2.0**scale))) for df in (held, asked))
    top = float(held.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0])
    shard_rows = shard_rows or int(min(max(SHARD_ROWS, ROOT_ROWS * math.sqrt(total)), max(SHARD_BYTES // (8 * dims), LEAF_ROWS)))
    shards = max(1, math.ceil(total / shard_rows))
    usual = F.size("v") == dims
    sample = []
    if shards > 1:
        sample = [r["v"] for r in held.filter(usual).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()]
    router = Router(np.array(sample).reshape(-1, dims), top, shards)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            leaf, far = router.place(_matrix(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * router.depth), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf), lists], names=["id", "v", "shard", "far"])

    placed = held.filter(usual).mapInArrow(tidy(place), "id long, v array<double>, shard long, far array<double>")
    # Vectors of other dimensions stand in one more shard for each of these, without bounds.
    others = held.filter(~usual).select("id", "v", F.lit(-1).cast("long").alias("shard"), F.array().cast("array<double>").alias("far"))
    placed = materialize(placed.unionByName(others).withColumn("dim", F.size("v")), "vectors")
    spread = [x for i in range(router.depth) for x in (F.min(F.get("far", i)).alias(f"lo{i}"), F.max(F.get("far", i)).alias(f"hi{i}"))]
    sizes = materialize(placed.groupBy("shard", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), *spread), "shards")
    router.measured({r["shard"]: np.array([(r[f"lo{i}"], r[f"hi{i}"]) for i in range(router.depth)]).reshape(-1, 2) for r in sizes.filter("shard >= 0").collect()})  # one row a shard
    parts = sizes.select(F.col("shard").alias("s"), F.col("dim").alias("d"), "parts")

    def in_parts(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(parts) if shards <= SHARD_ROWS else parts, (F.col("shard") == F.col("s")) & (F.col("dim") == F.col("d")))

    dealt = in_parts(placed).select("shard", "dim", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, ids, vectors, tree, copies = None, [], [], None, 1
        for batch in batches:
            shard, dims, part, kind = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(dims) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if a == b:
                    continue
                if (shard[a], dims[a], part[a]) != key:
                    key, ids, vectors, tree = (shard[a], dims[a], part[a]), [], [], None
                some = batch.slice(a, b - a)
                own, v = some.column(4).to_numpy(), _matrix(some.column(5))
                if kind[a] == 0:
                    ids.append(own)
                    vectors.append(v)
                    continue
                if tree is None and ids:
                    numbers, whole = _distinct(np.concatenate(ids), np.concatenate(vectors))
                    copies = int(np.unique(numbers, return_counts=True)[1].max())  # vectors of one id
                    tree = VantageTree(numbers, whole, top)
                    ids, vectors = [], []
                for at in range(0, (b - a) if tree else 0, QUERY_ROWS):
                    q = own[at : at + QUERY_ROWS]
                    row, found, score = tree.search(q, v[at : at + QUERY_ROWS], min(k * copies, len(tree.ids)), factor)
                    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    def searched(wanted: DataFrame) -> DataFrame:
        """The k best of each (query, shard) of ``wanted`` (shard, id, v)."""
        wanted = in_parts(wanted.withColumn("dim", F.size("v"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        wanted = wanted.select("shard", "dim", "part", F.lit(1).alias("kind"), "id", "v")
        streamed = dealt.join(wanted.select("shard", "dim").distinct(), ["shard", "dim"], "left_semi").unionByName(wanted)
        streamed = streamed.repartition("shard", "dim", "part").sortWithinPartitions("shard", "dim", "part", "kind")
        return streamed.mapInArrow(tidy(search), "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def blocks(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTED_ROWS):
                part = batch.slice(at, ROUTED_ROWS)
                yield part, _matrix(part.column(1))

    def home(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, v in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(router.home(v)), part.column(0), part.column(1)], names=["shard", "id", "v"])

    def beyond(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, v in blocks(batches):
            least, own = part.column(2).fill_null(-np.inf).to_numpy(), router.home(v)
            known = least > -np.inf
            reach = np.where(known, np.sqrt(np.maximum(2 * top * top - 2 * top * np.where(known, least, 0) / _norms(v), 0)), np.inf) + 1e-6 * top
            for leaf, rows in router.within(v, reach, factor):
                rows = pa.array(rows[own[rows] != leaf])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), part.column(0).take(rows), part.column(1).take(rows)], names=["shard", "id", "v"])

    asked = materialize(asked, "queries")
    routed = "shard long, id long, v array<double>"
    found = searched(asked.filter(usual).mapInArrow(tidy(home), routed).unionByName(asked.filter(~usual).select(F.lit(-1).cast("long").alias("shard"), "id", "v")))
    if shards > 1:
        found = materialize(ranked(found), "home-shards")
        least = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        far = asked.filter(usual).join(least, "id", "left").select("id", "v", "least").mapInArrow(tidy(beyond), routed)
        found = found.select("query_id", "vec_id", "score").unionByName(searched(materialize(far, "routed-queries")))
    out = ranked(found)
    return out.withColumn("score", F.col("score") * F.lit(2.0**scale) * F.lit(2.0**scale)) if scale else out


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that repeat both id and vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    raw = np.column_stack([ids.view(np.uint64), np.ascontiguousarray(vectors).view(np.uint64)])
    first = np.sort(np.unique(raw, axis=0, return_index=True)[1])
    return ids[first], vectors[first]


def measured_recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact``'s (query_id, vec_id) pairs that are in ``found``."""
    exact = materialize(exact.select("query_id", "vec_id"), "exact-pairs")
    hit = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())
