"""Scalar conventions of scores and ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio_0_10000(a: Column, b: Column) -> Column:
    """Rounded half away from zero; 10000 on a zero denominator."""
    return F.when(b == 0, F.lit(10000)).otherwise(F.round(F.try_divide(a * F.lit(10000.0), b))).cast("long")


def safe_ratio(a: Column, b: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(a.cast("double"), b), digits)


def severity(score: Column) -> Column:
    return F.when(score >= 6500, "high").when(score >= 3000, "medium").otherwise("low")


def ratio_pressure(value: Column, limit: int, most: int) -> Column:
    """How far a value is over its limit, at most once over, scaled to ``most``; 0 at the limit."""
    if not limit:
        return F.lit(0).cast("long")
    return F.when(value <= limit, 0).otherwise(F.round(F.least(F.lit(1.0), (value - limit) / F.lit(float(limit))) * most)).cast("long")


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def ordered_distinct(values: Column) -> Column:
    return F.filter(F.array_distinct(values), lambda x: x != "")


def finding_key(*columns: str) -> Column:
    """Canonical JSON of the columns, in name order."""
    return F.to_json(F.struct(*sorted(columns)))
