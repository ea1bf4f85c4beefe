"""Filter interaction audit: what each filter of a cascade removes in every order that the filters can have.

An order is a path through the lattice of filter subsets. Its steps are edges (filters already applied, next
filter), and five filters have 80 edges for their 600 steps. A document adds to an edge by the set of filters
that it fails alone, so documents are counted by that set first, the few counts are spread over the
edges, and the steps of all orders take their figures from the edges by a join.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ._scratch import materialize
from .quality import let

#: Words are runs of other than these; upper case and marks as the filters name them.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "[A-Z]+"
MARK = r"[#$%&*|]"

#: Labelled ids that may be broadcast (9 bytes each); beyond, they are joined by shuffle.
BROADCAST_LABELS = 1_000_000

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails A (under 200 words), B (under half of its words distinct), C (over 3 % upper case) and D (a mark)."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE + "+"), lambda x: x != "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))
    upper = F.length(t) - F.length(F.regexp_replace(t, UPPER, ""))
    measured = let(sizes, lambda s: F.struct((s["n"] < 200).alias("A"), (100 * s["k"] < 50 * s["n"]).alias("B")))
    return {"A": measured["A"], "B": measured["B"], "C": 100 * upper > 3 * F.length(t), "D": t.rlike(MARK)}


def failing_sets(docs: DataFrame, labels: DataFrame, failures: dict[str, Column], text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, failed (bits of the failed filters in their order; the bit after them is a copy's), n, good and toxic.

    A copy is a document whose text equals that of a smaller doc_id anywhere in the table. Equal texts are known
    by their SHA-256. Documents without doc_id are no copies and make none. A doc_id is good or toxic if any of
    its labels is 1.
    """
    bits = sum(F.when(failed, F.lit(1 << i)).otherwise(0) for i, failed in enumerate(failures.values()))
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("failed"), digest.alias("digest"))
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")).filter("id is not null and (good or toxic)")
    marked = materialize(marked.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "audit-labels")
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_LABELS else marked
    narrow = materialize(narrow.join(marked, "id", "left"), "audit-documents")
    # A text's first document alone is looked up by its text and id, so that no text's copies meet in one task.
    first = narrow.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null")
    passed = narrow.filter("id is not null").join(first, ["digest", "id"]).select(narrow.columns).unionByName(narrow.filter("id is null"))
    copy = 1 << len(failures)

    def counted(rows: DataFrame, failed: Column, sign: int) -> DataFrame:
        sums = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
        return sums.select("part", failed.alias("failed"), *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])

    failed = F.col("failed")
    own = materialize(passed.select("part", "failed", "good", "toxic").groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("k")), "audit-first-copies", small=True)
    own = own.withColumns({"n": F.col("k"), "good": F.when(F.col("good"), F.col("k")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("k")).otherwise(0)}).groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    minus = own.select("part", failed.bitwiseOR(copy).alias("failed"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    every = counted(narrow, failed.bitwiseOR(copy), 1).unionByName(minus).unionByName(own)
    return every.groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n > 0")


def lattice_edges(sets: DataFrame, filters: int) -> DataFrame:
    """part, applied (bits), next (bit) and the measures, of every edge of the lattice, from the counts of ``failing_sets``."""
    edges = [(s, 1 << f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    at = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in edges])
    failed, applied, after = F.col("failed"), F.col("applied"), F.col("next")
    before, here = failed.bitwiseAND(applied) != 0, failed.bitwiseAND(after) != 0
    removed = ~before & here
    amount = lambda condition, of: F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0)))
    return sets.select("*", F.inline(at)).groupBy("part", "applied", "next").agg(
        amount(~before & ~here, "n").alias("kept"), amount(removed, "n").alias("removed"), amount(before & here, "n").alias("redundant"),
        amount(failed == after, "n").alias("unique_fails"), amount(removed, "good").alias("good_lost"), amount(removed, "toxic").alias("toxic_lost"),
    )


def steps_of_orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """filter_order, step (from 1), applied and next (bits) of every step of every order of ``names``."""
    rows = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, applied, 1 << f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, copies: str = "E", text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, filter_order, step, the measures and shapley: one row for each part, order of the filters and step.

    ``failures``: conditions on a row of ``docs`` by filter name; ``copies`` names the filter against copies of a
    smaller doc_id's text, which comes last among them. A null text is empty, a null part an empty string. Repeated
    rows count each time and aren't copies of each other; rows without doc_id count and are no copies. Labels
    that are null are 0, those without doc_id or document mean nothing. No documents give no rows. Columns of
    ``docs`` may have any names.
    """
    failures = text_failures(F.col(f"`{text}`").cast("string")) if failures is None else failures
    names = [*failures, copies]
    sets = materialize(failing_sets(docs, labels, failures, text, doc_id, part), "audit-sets", small=True)
    edges = lattice_edges(sets, len(names))
    steps = F.broadcast(steps_of_orders(docs.sparkSession, names))  # a row for each order and step: 600 for five filters
    rows = steps.join(edges, ["applied", "next"])
    shapley = F.sum("removed").over(W.partitionBy("part", "next"))  # a row for each order
    return rows.select("part", "filter_order", "step", *MEASURES, shapley.alias("shapley"))
