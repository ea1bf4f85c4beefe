"""Operators as SQL over named relations.

An operator is one SELECT in the dialect that Spark and DuckDB share, over relations written
``@name``. ``SqlOp.run`` binds them to DataFrames, so Catalyst sees one declarative plan; the same text
with the views as common table expressions is what the tests hold results against.

A few macros bridge the dialects: EPOCH(timestamp), DIR(path), NAME(path), IDIV(a, b), MATCHES(text, pattern), SETJOIN(x),
LISTJOIN(x, key), STARTS(text, prefix), ENDS(text, suffix), HAS(text, part) PCT(x, p), LIST(a, b, ..), UNNEST(list, alias, column) after a FROM
and PREFIXES(text, pattern, separator): the text's first 1, 2, .. parts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .scratch import materialize, spread

MACROS = {
    "EPOCH": ("unix_timestamp(cast({0} as timestamp))", "cast(floor(epoch({0})) as bigint)"),
    "IDIV": ("(({0}) div ({1}))", "(({0}) // ({1}))"),
    "MATCHES": ("regexp_like({0}, {1})", "regexp_matches({0}, {1})"),
    "SETJOIN": ("array_join(sort_array(collect_set({0})), ',')", "coalesce(string_agg(distinct {0}, ',' order by {0}), '')"),
    "LISTJOIN": ("array_join(transform(sort_array(collect_list(struct({1} as k, {0} as v))), x -> x.v), ',')", "coalesce(string_agg({0}, ',' order by {1}, {0}), '')"),
    "STARTS": ("startswith({0}, {1})", "starts_with({0}, {1})"),
    "ENDS": ("endswith({0}, {1})", "ends_with({0}, {1})"),
    "HAS": ("contains({0}, {1})", "contains({0}, {1})"),
    "DIR": ("(case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '' end)", "(case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '' end)"),
    "NAME": ("regexp_replace({0}, '^.*/', '')", "regexp_replace({0}, '^.*/', '')"),
    "LIST": ("array({*})", "[{*}]"),
    "UNNEST": ("lateral view explode({0}) {1} as {2}", "cross join unnest({0}) {1}({2})"),
    "PREFIXES": ("transform(sequence(1, size(split({0}, '{1}'))), i -> array_join(slice(split({0}, '{1}'), 1, i), '{2}'))", "list_transform(range(1, len(string_split_regex({0}, '{1}')) + 1), lambda i: array_to_string(string_split_regex({0}, '{1}')[1:i], '{2}'))"),
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at ``at``, and the end of the call."""
    depth, quoted, parts, begin = 0, False, [], at + 1
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*parts, text[begin:i].strip()], i + 1
        elif c == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError("a bracket isn't closed")


def translate(sql: str, spark: bool) -> str:
    """``sql`` with its macros written out in one dialect."""
    pattern = re.compile(r"\b(" + "|".join(MACROS) + r")\(")
    while m := pattern.search(sql):
        args, end = _arguments(sql, m.end() - 1)
        body = MACROS[m[1]][0 if spark else 1].replace("{*}", ", ".join(args))
        args = [a[1:-1] if m[1] == "PREFIXES" and i else a for i, a in enumerate(args)]
        sql = sql[: m.start()] + (body if m[1] == "LIST" else body.format(*args)) + sql[end:]
    return sql


def with_pairs(df: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``df``, edges by name, with the same edges by number beside it, for those who can do without names."""
    df._plumbline_pairs = pairs
    return df


def pairs_of(df: DataFrame) -> DataFrame | None:
    return getattr(df, "_plumbline_pairs", None)


def relations_of(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"@(\w+)", sql)))


@dataclass(frozen=True)
class SqlOp:
    """One operator: what it computes, and its SELECT over ``@relations``."""

    about: str
    sql: str

    def run(self, spark: SparkSession | None = None, **relations: DataFrame) -> DataFrame:
        """The operator over the caller's relations, lazily."""
        names = relations_of(self.sql)
        spark = spark or relations[names[0]].sparkSession
        mark = uuid.uuid4().hex[:12]
        for name in names:
            relations[name].createOrReplaceTempView(f"pl_{mark}_{name}")
        try:
            return spark.sql(re.sub(r"@(\w+)", rf"pl_{mark}_\1", translate(self.sql, True)))
        finally:
            for name in names:
                spark.catalog.dropTempView(f"pl_{mark}_{name}")


class Relations:
    """Named relations over base tables, for Spark as DataFrames and for DuckDB as common table expressions.

    ``views`` are SELECTs in the shared dialect. ``computed`` are those that Spark gets by a kernel: name to the
    function, the relations that it takes in order, and a SELECT that DuckDB gets the same rows by.
    """

    def __init__(self, views: dict[str, str], computed: dict[str, tuple] | None = None, written: frozenset[str] = frozenset()):
        self.views, self.computed, self.written = views, computed if computed is not None else {}, written
        #: Relations of which Spark makes only what a SELECT reads: name to a function from the SELECT to the name of that part.
        self.parts: dict[str, Callable[[str], str]] = {}
        #: Relations that take edges by number where they can, so that writing what they read by name would be for nothing.
        self.by_number: set[str] = set()
        self.hands_on: set[str] = set()

    def reads(self, text: str, by_name: bool = False) -> Counter[str]:
        """How often a SELECT reads each relation, by way of other relations too; ``by_name``: without those that ``by_number`` read."""
        refs: list[tuple[str, str]] = []
        todo, done = [("", text)], set()
        while todo:
            reader, sql = todo.pop()
            for name in re.findall(r"@(\w+)", sql):
                refs.append((reader, name))
                if name not in done:
                    done.add(name)
                    todo.append((name, " ".join(f"@{n}" for n in self.computed[name][1]) if name in self.computed else self.views.get(name, "")))
        # A relation that hands numbers on reads names if one that reads it does.
        numbers = self.by_number | {n for n in self.hands_on if {r for r, name in refs if name == n} <= self.by_number}
        return Counter(name for reader, name in refs if not (by_name and reader in numbers))

    def often(self, text: str) -> frozenset[str]:
        """The costly relations (``written``) that a SELECT reads more than once."""
        counts = self.reads(text, by_name=True)
        return frozenset(n for n in self.written if counts[n] > 1)

    def frame(self, spark: SparkSession, sf_dir: str, name: str, seen: dict[str, DataFrame] | None = None, often: frozenset[str] = frozenset()) -> DataFrame:
        """A relation, and into ``seen`` all that it needed; those in ``often`` are written once rather than planned in each place."""
        seen = {} if seen is None else seen
        if name not in seen:
            if name in self.computed:
                f, names, _ = self.computed[name]
                made = f(*(self.frame(spark, sf_dir, n, seen, often) for n in names))
                seen[name] = with_pairs(materialize(made), pairs_of(made)) if name in often else made
            elif name in self.views:
                op = SqlOp(name, self.views[name])
                made = op.run(spark, **{n: self.frame(spark, sf_dir, n, seen, often) for n in relations_of(op.sql)})
                seen[name] = materialize(made) if name in often else made
            else:
                seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return seen[name]

    def frames(self, spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
        """The relations that a SELECT names."""
        seen: dict[str, DataFrame] = {}
        parts = {n: self.parts[n](text) if n in self.parts else n for n in relations_of(text)}
        text = re.sub(r"@(\w+)", lambda m: f"@{parts[m[1]]}", text)
        often = self.often(text)
        spread(spark, [f"{sf_dir}/{n}.parquet" for n in self.reads(text) if n not in self.computed and n not in self.views])
        return {n: self.frame(spark, sf_dir, part, seen, often) for n, part in parts.items()}

    def ctes(self, names: list[str]) -> list[str]:
        out: dict[str, str] = {}

        def visit(name: str) -> None:
            sql = self.computed[name][2] if name in self.computed else self.views.get(name)
            if sql and name not in out:
                for n in relations_of(sql):
                    visit(n)
                out[name] = f"{name} AS MATERIALIZED ({re.sub(r'@(\w+)', r'\1', translate(sql, False))})"

        for n in names:
            visit(n)
        return list(out.values())

    def oracle(self, sql: str, recursive: bool = False) -> str:
        """``sql`` for DuckDB with the views that it needs; its own leading WITH is merged."""
        own = re.sub(r"@(\w+)", r"\1", translate(sql, False)).strip()
        ctes = self.ctes(relations_of(sql))
        head = "WITH RECURSIVE " if recursive else "WITH "
        if m := re.match(r"with\s+(recursive\s+)?", own, re.I):
            return head + ", ".join([*ctes, own[m.end() :]])
        return (head + ", ".join(ctes) + " " if ctes else "") + own
