"""Best-fit packing by a length histogram.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers, so it is
made on the driver at any corpus size: lengths in falling order fill the tightest open sequences,
whole runs of equal sequences at a time. Pieces then take the planned slots by their rank within
their length. Ranks come in two levels, a count for each (length, bucket) and a row number inside, so
a length that a third of all pieces share is still dealt over many tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ._scratch import materialize, ship, tidy

#: n pieces are dealt over sqrt(n) / this many buckets, so that neither a length's buckets nor a bucket's pieces become one task's load.
ROOTS_A_BUCKET = 16


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, first offset, pieces a sequence) and the number of sequences.

    Piece ``rank`` of a run stands in sequence ``first + (rank - first rank) // per`` at
    ``offset + (rank - first rank) % per * length``. Lengths must be from 1 to ``capacity``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    made = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, n))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} isn't from 1 to {capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, capacity - room, per))
                leave(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                runs.append((length, rank, left, first + full, capacity - room, left))
                leave(room - left * length, first + full, 1)
                leave(room, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            else:
                leave(room, first + full, n - full)
    return runs, made


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit) of each document with its end id.

    Only documents longer than ``capacity`` are cut, at any length of text. A null text is an empty one: its
    end id alone. Repeated rows give repeated pieces, an empty table gives an empty one, and columns not
    kept are never read.
    """
    ship(docs.sparkSession)
    kept = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join([*(f"{k} {narrow.schema[k].dataType.simpleString()}" for k in kept), "piece int, start long, length long, ids binary"])

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from plumbline.llm._tokens import encoder

        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b, counts, ids in enc.groups(batch.column(batch.num_columns - 1)):
                raw, at = ids.tobytes(), 0
                of, piece, start, length, body = [], [], [], [], []
                for row, n in enumerate(counts.tolist()):
                    whole = raw[at * 4 : (at + n) * 4] + end
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        part = whole[s * 4 : (s + capacity) * 4]
                        of.append(row), piece.append(k), start.append(s), length.append(len(part) // 4), body.append(part)
                rows = batch.slice(a, b - a).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(body, pa.binary())], names=[*kept, "piece", "start", "length", "ids"])

    return narrow.mapInArrow(tidy(cut), schema).withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: Sequence[str] = ("doc_id", "piece"), bucket: Column | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from offset 0.

    ``pieces`` is read several times: hand in a written table. ``order`` makes ranks repeatable;
    rows equal in it are interchangeable (nulls first). Pieces of one length take slots by ``bucket``, then by
    ``order``; the bucket is a hash of the order unless one is given, which for example keeps the order of files.
    Lengths out of range raise; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    if bucket is None:
        buckets = max(1, math.ceil(math.sqrt(pieces.count()) / ROOTS_A_BUCKET))
        bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    dealt = pieces.withColumn("_bucket", F.coalesce(bucket.cast("long"), F.lit(-1).cast("long"))).withColumn("_length", F.col(length).cast("long"))
    cells = materialize(dealt.groupBy("_length", "_bucket").agg(F.count("*").alias("_n")), "pack-cells")
    histogram = {r["_length"]: r["n"] for r in cells.groupBy("_length").agg(F.sum("_n").alias("n")).limit(capacity + 1).collect()}
    runs, _ = plan_best_fit(histogram, capacity)
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 0, 1)], "_length long, lo long, n long, seq long, off long, per long")
    plan = plan.groupBy("_length").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "seq", "off", "per"))).alias("_runs"))
    before = W.partitionBy("_length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(plan, "_length")
    cells = cells.select("_length", "_bucket", "_before", F.expr("filter(_runs, r -> r.lo < _before + _n and r.lo + r.n > _before)").alias("_runs"))
    inside = W.partitionBy("_length", "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("_rank", F.row_number().over(inside)).join(cells, ["_length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).withColumn("_run", F.expr("filter(_runs, r -> r.lo <= _rank and _rank < r.lo + r.n)[0]"))
    at = F.col("_rank") - F.col("_run.lo")
    return ranked.select(
        *pieces.columns,
        (F.col("_run.seq") + F.floor(at / F.col("_run.per"))).cast("long").alias("sequence_id"),
        (F.col("_run.off") + at % F.col("_run.per") * F.col("_length")).cast("long").alias("offset"),
    )
