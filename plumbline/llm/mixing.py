"""Mixing sources to target weights along a curriculum.

Each source's weight is a base weight times a schedule over training time, from 0 to 1. A source's
cumulative demand is the integral of its schedule, scaled to its target; its documents stand in a
hashed order, and the point where demand reaches a document's cumulative size is that document's
training position. Demand beyond a source's size goes round its documents again.

All of it is built-in SQL. The cumulative size of a source comes in two levels, a sum for each
(source, bucket of the hash) and a running sum inside. A source has as many buckets as the root of its
rows asks for, so neither the buckets of a hot source nor the rows of a bucket become one task's load.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Base weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Weight schedules, repeating in the same order: knots (time, factor), linear between them.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
MOST_REPEATS = 3
#: A source of n rows has sqrt(n) / this many buckets.
ROOTS_A_BUCKET = 4
#: So many rows of sources, or of their buckets, may be broadcast; beyond, they are joined by shuffle. Buckets grow with the root of the rows.
BROADCAST_SOURCES = 20_000
BROADCAST_BUCKETS = 1_000_000


def normalized(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Pieces (time, end, factor at time, slope, integral up to time) of a schedule whose integral is 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if knots[0][0] != 0 or knots[-1][0] != 1 or area <= 0 or any(b[0] <= a[0] or min(a[1], b[1]) < 0 for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("a schedule has rising knots from time 0 to 1 and factors that aren't negative nor all zero")
    pieces, done = [], 0.0
    for (t, f), (u, g) in zip(knots, knots[1:], strict=False):
        pieces.append((t, u, f / area, (g - f) / (u - t) / area, done))
        done += (u - t) * (f + g) / 2 / area
    return pieces


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a schedule has asked for ``share`` (0 to 1) of its total."""
    out = F.lit(1.0)
    for t, u, f, slope, done in reversed(normalized(knots)):
        rest = F.greatest(share - done, F.lit(0.0))
        if abs(slope) < 1e-12:
            time = t + rest / f if f else F.lit(float(t))
        else:
            time = t + (F.sqrt(F.greatest(F.lit(f * f) + 2 * slope * rest, F.lit(0.0))) - f) / slope
        full = done + (u - t) * (f + slope * (u - t) / 2)
        out = F.when(share <= full, F.least(time, F.lit(float(u)))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with class_no, weight and target.

    Targets share the total by weight and stop at ``most`` times a source's size; the excess is
    reshared by weight until none is above. That ends at target = min(level * weight, cap) for one
    level, found from running sums over sources by cap / weight. One row a source is sorted here, not
    one a document. Sources without words get 0.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("class_no", (F.row_number().over(by_name) - 1).cast("int"))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class_no") % len(weights) + 1))
    ratio = F.col("source_size") / F.col("weight")
    before = W.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumns({"_done": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "_freed": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "_total": F.sum("source_size").over(everything), "_weights": F.sum("weight").over(everything)})
    # The level if exactly the sources before this one were capped; the first source whose own cap isn't reached at it sets the level.
    level = (F.col("_total") - most * F.col("_done")) / (F.col("_weights") - F.col("_freed"))
    rows = rows.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") <= most * F.col("source_size"))
    rows = rows.withColumn("_level", F.min(F.when(F.col("_fits"), F.struct(ratio.alias("r"), F.col("_level").alias("level")))).over(everything)["level"])
    return rows.withColumn("target", F.least(F.col("_level") * F.col("weight"), F.lit(float(most)) * F.col("source_size"))).drop("_done", "_freed", "_total", "_weights", "_level", "_fits")


def plan_mixture(docs: DataFrame, text: str = "text", source: str = "source", keep: Sequence[str] = ("doc_id",), order: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, most: int = MOST_REPEATS) -> DataFrame:
    """``keep`` columns with size, source_size, target, copies (int) and positions (array<double>, one for each copy).

    A document is taken for each round in which the middle of its words lies within what is left of
    its source's target: from 0 to ``most`` whole copies, and a source's taken words differ from its
    target by half a document at most. The order within a source is that of hashes of ``order``; rows
    equal in it and in size are interchangeable. A null text has size 0, a null source is a source,
    sorted last. Documents without words are never taken. An empty table gives an empty one. A kept
    column may not have the name of one that is added; columns not kept are never read.

    If the text itself is kept, the plan is made on narrow rows and texts are read a second time, so
    that they pass one shuffle and are never written in between.
    """
    added = ("size", "source_size", "target", "copies", "positions")
    if clash := set(keep).intersection(added):
        raise ValueError(f"kept columns have the names of added ones: {sorted(clash)}")
    kept = [f"_k{i}" for i in range(len(keep))]
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in order]).alias("_hash"))
    sized = materialize(rows.drop(*kept) if text in keep else rows, "mix-sizes")
    per = sized.groupBy(F.col("source").alias("_s")).agg(F.ceil(F.sqrt(F.count("*")) / ROOTS_A_BUCKET).cast("long").alias("_buckets"))
    per = materialize(per, "mix-sources")
    per = F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per

    def bucketed(df: DataFrame) -> DataFrame:
        """The hash's high 32 bits, as a share of all, pick the bucket: buckets stand in the order of hashes."""
        high = F.shiftright("_hash", 32) + F.lit(2**31)
        return df.join(per, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_bucket", F.shiftright(high * F.col("_buckets"), 32)).drop("_s", "_buckets")

    cells = materialize(bucketed(sized).groupBy("source", "_bucket").agg(F.sum("size").alias("_cell")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, most)
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell").over(before), F.lit(0)))
    cells = materialize(cells.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_cell"), "mix-plan")
    inside = W.partitionBy("source", "_bucket").orderBy("_hash", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = bucketed(rows if text in keep else sized).withColumn("_offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    c = cells.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    c = F.broadcast(c) if cells.count() <= BROADCAST_BUCKETS else c
    placed = placed.join(c, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    middle = F.col("_before") + F.col("_offset") + F.col("size") / 2
    turn = (F.col("target") - middle) / F.col("source_size")
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), F.ceil(turn)))).otherwise(0).cast("int")
    placed = placed.withColumn("copies", copies).withColumn("_middle", middle)

    def position(j: Column) -> Column:
        share = F.least(F.lit(1.0), (F.col("_middle") + j * F.col("source_size")) / F.col("target"))
        out = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            out = F.when(F.col("class_no") % len(schedules) == k, inverse_demand(share, knots)).otherwise(out)
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return placed.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "size", "source_size", "target", "copies", positions.alias("positions"))


def lay_out(planned: DataFrame, all_documents: bool = False) -> DataFrame:
    """One row for each taken copy with its number ``copy`` (from 0) and ``position``, range-sorted by position.

    With ``all_documents`` a document that is never taken has one row too, last, with null in both, so that
    the rows whose copy is 0 or null are the documents. ``planned`` may not have columns of these names.
    Copies at equal positions, repeated documents' too, stand in any order. An empty plan gives an empty one.
    """
    explode = F.posexplode_outer if all_documents else F.posexplode
    laid = planned.select("*", explode("positions").alias("copy", "position"))
    return laid.repartitionByRange(F.col("position").asc_nulls_last()).sortWithinPartitions(F.col("position").asc_nulls_last())
