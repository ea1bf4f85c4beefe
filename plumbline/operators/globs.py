"""Globs as an index: a pattern's literal part is a key, paths are looked up by it, and only hits are tried.

Every pattern has an exact key (itself), and the prefix or the suffix that its form demands. A path gives its
prefixes and suffixes of those lengths that some pattern has, so paths and patterns meet in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def glob_sql(path: str, pattern: str) -> str:
    """Whether a path matches a glob: the path itself, dir/**/* and dir/** (a bare prefix), dir/* (what follows the prefix, less one slash, has none), *.ext, or a directory."""
    return f"""case when {pattern} = {path} then true
        when ENDS({pattern}, '/**/*') then STARTS({path}, left({pattern}, length({pattern}) - 5)) and length({path}) > length({pattern}) - 5
        when ENDS({pattern}, '/**') then STARTS({path}, left({pattern}, length({pattern}) - 3)) and length({path}) > length({pattern}) - 3
        when ENDS({pattern}, '/*') then STARTS({path}, left({pattern}, length({pattern}) - 2)) and not HAS(regexp_replace(substr({path}, length({pattern}) - 1), '^/', ''), '/')
        when STARTS({pattern}, '*.') then ENDS({path}, substr({pattern}, 2))
        else STARTS({path}, {pattern} || '/') end"""


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """(pattern, side, key) of distinct patterns: what a path must be, begin with or end with."""
    p = F.col("pattern")
    begins = F.when(p.endswith("/**/*"), F.regexp_replace(p, r"/\*\*/\*$", "")).when(p.endswith("/**"), F.regexp_replace(p, r"/\*\*$", "")).when(p.endswith("/*"), F.regexp_replace(p, r"/\*$", "")).when(~p.startswith("*."), F.concat(p, F.lit("/")))
    keys = F.array(F.struct(F.lit("is").alias("side"), p.alias("key")), F.struct(F.lit("begins").alias("side"), begins.alias("key")), F.struct(F.lit("ends").alias("side"), F.when(begins.isNull(), F.expr("substr(pattern, 2)")).alias("key")))
    return patterns.select("pattern").dropna().distinct().select("pattern", F.inline(keys)).filter("key is not null")


def glob_hits(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, pattern): the distinct paths that each distinct pattern matches."""
    from ..plans.sqlops import translate

    keys = pattern_keys(patterns)
    lengths = lambda side: F.coalesce(keys.filter(F.col("side") == side).agg(F.collect_set(F.length("key"))).scalar(), F.array().cast("array<int>"))  # noqa: E731  one small array
    path = F.col("path")
    known = paths.select("path").dropna().distinct().withColumns({"begins": lengths("begins"), "ends": lengths("ends")})
    fitting = lambda column, cut: F.transform(F.filter(column, lambda n: n <= F.length("path")), cut)
    begins = fitting("begins", lambda n: F.struct(F.lit("begins").alias("side"), F.substr(path, F.lit(1), n).alias("key")))
    ends = fitting("ends", lambda n: F.struct(F.lit("ends").alias("side"), F.substr(path, F.length(path) - n + 1, n).alias("key")))
    looked = known.select("path", F.inline(F.concat(F.array(F.struct(F.lit("is").alias("side"), path.alias("key"))), begins, ends)))
    return looked.join(keys, ["side", "key"]).filter(F.expr(translate(glob_sql("path", "pattern"), True))).select("path", "pattern").distinct()
