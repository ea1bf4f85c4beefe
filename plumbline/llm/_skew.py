"""Joins of many rows to one row a key, where one key may be asked for by a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows that ask for one key under one salt; a key with more has its row copied over as many salts as it takes.
LOAD = 512
#: So many heavy keys are broadcast to salt the rows (they are at most rows / LOAD); beyond, they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], load: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup`` (unique in ``keys``) on ``keys``; ``load`` is the count of rows that ask for a key, ``by`` a column that spreads them.

    ``lookup`` is read twice, so it should be a written table.
    """
    salts = F.ceil(F.col(load) / LOAD).cast("int")
    heavy = lookup.filter(F.col(load) > LOAD).select(*keys, salts.alias("_salts"))
    few = heavy.count() <= BROADCAST_KEYS
    salted = rows.join(F.broadcast(heavy) if few else heavy, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
