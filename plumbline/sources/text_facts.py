"""Facts that need no grammar: module specifiers, comment lines, code without literals, entry points; and facts ingested as JSON.

Facts of a whole program (symbols, reads, writes, closed domains, their sites, transitions) come from an extractor
outside as one JSON document a repository; ``semantic_facts`` reads them into tables.
"""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.scratch import ship

#: Line comment, block comment and string patterns by family of languages.
_PY = r"""(?P<c>\#[^\n]*)|(?P<s>(?s:'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z))|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)"""
_C = r"""(?P<c>//[^\n]*|(?s:/\*.*?(?:\*/|\Z)))|(?P<s>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?|(?s:`(?:\\.|[^`\\])*`?))"""
HASH_LANGUAGES = ("python", "ruby", "shell", "yaml", "toml")
#: Directories whose files are no entry points.
NO_ENTRY = r"(^|/)(tests?|__tests__|spec|examples?|bench(es|marks)?|vendor|fixtures)/"
ENTRY_NAMES = ["main.py", "__main__.py", "main.rs", "main.go", "main.ts", "main.js", "manage.py"]

SYMBOLS = "array<struct<id: string, path: string, name: string, kind: string, line: int>>"
READS = "array<struct<path: string, symbol_name: string, read_kind: string, line: int>>"
WRITES = "array<struct<path: string, symbol_name: string, write_kind: string, line: int>>"
DOMAINS = "array<struct<path: string, symbol_name: string, variants: array<string>, line: int, defining_file: string>>"
SITES = "array<struct<path: string, domain_symbol_name: string, defining_file: string, site_kind: string, proof_kind: string, covered_variants: array<string>, line: int, fallback_kind: string, site_expression: string, site_semantic_role: string, site_confidence: double>>"
TRANSITIONS = "array<struct<path: string, domain_symbol_name: string, group_id: string, transition_kind: string, source_variant: string, target_variants: array<string>, line: int>>"
SEMANTIC = f"symbols {SYMBOLS}, reads {READS}, writes {WRITES}, closed_domains {DOMAINS}, closed_domain_sites {SITES}, transition_sites {TRANSITIONS}"


def normalize_module(spec: Column, dots_are_separators: bool = False) -> Column:
    """A specifier as a path: quotes gone, :: as /, and dots too if they separate; leading dots stay."""
    bare = F.regexp_replace(F.trim(spec), "^[\"'`<]+|[\"'`>;]+$", "")
    path = F.regexp_replace(bare, "::", "/")
    if not dots_are_separators:
        return path
    lead = F.regexp_extract(path, r"^\.*", 0)
    rest = F.regexp_replace(F.substr(path, F.length(lead) + 1, F.length(path)), r"\.", "/")
    return F.concat(lead, F.when((lead != "") & (rest != ""), F.concat(F.lit("/"), rest)).otherwise(rest))


def braces(text: str) -> list[str]:
    """``a::{b, c::{d, e}}`` as its members, inner braces first expanded; text without braces is itself."""
    at = text.find("{")
    if at < 0:
        return [text.strip()] if text.strip() else []
    depth, parts, begin = 0, [], at + 1
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                parts.append(text[begin:i])
                break
        elif text[i] == "," and depth == 1:
            parts.append(text[begin:i])
            begin = i + 1
    head = text[:at].strip()
    return [head.removesuffix("::") if x == "self" else head + x for p in parts for x in braces(p)]


def expand_braces(specs: DataFrame, column: str = "spec") -> DataFrame:
    """One row for each member of a braced specifier."""
    ship(specs.sparkSession)
    each = F.pandas_udf(lambda s: s.map(lambda x: [] if x is None else braces(x)), "array<string>")
    return specs.withColumn(column, F.explode(each(F.col(column))))


def _pattern(lang: str) -> re.Pattern:
    return re.compile(_PY if lang in HASH_LANGUAGES else _C)


def stripped(source: str, lang: str) -> str:
    """Code without comments and without the insides of strings."""
    return _pattern(lang).sub(lambda m: "" if m["c"] is not None else m[0][0] * 2, source)


def commented(source: str, lang: str) -> int:
    """Distinct lines that a comment covers, in part or whole."""
    lines: set[int] = set()
    for m in _pattern(lang).finditer(source):
        if m["c"] is not None:
            first = source.count("\n", 0, m.start())
            lines.update(range(first, first + m[0].count("\n") + 1))
    return len(lines)


def text_measures(contents: DataFrame) -> DataFrame:
    """``contents`` (path, content, lang) with lines, blanks, comments and logic; undecodable bytes count as characters."""
    ship(contents.sparkSession)

    def measure(content: pd.Series, lang: pd.Series) -> pd.DataFrame:
        out = []
        for raw, of in zip(content, lang, strict=True):
            text = bytes(raw or b"").decode(errors="replace")
            rows = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
            blank = sum(not x.strip(" \t\r") for x in rows)
            comments = commented(text, of or "")
            out.append((len(rows), blank, comments, max(0, len(rows) - blank - comments)))
        return pd.DataFrame(out, columns=["lines", "blanks", "comments", "logic"])

    measured = F.pandas_udf(measure, "lines bigint, blanks bigint, comments bigint, logic bigint")
    return contents.withColumn("m", measured("content", "lang")).select("path", "lang", "m.*")


def strip_literals(contents: DataFrame) -> DataFrame:
    """(path, code) without comments and string bodies, by language."""
    ship(contents.sparkSession)

    def strip(content: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([stripped(bytes(c or b"").decode(errors="replace"), x or "") for c, x in zip(content, lang, strict=True)])

    return contents.select("path", F.pandas_udf(strip, "string")("content", "lang").alias("code"))


def same_file_refs(functions: DataFrame, code: DataFrame) -> DataFrame:
    """(path, name, same_file_ref_count): how often the name stands in its file outside definitions and calls."""
    word = F.regexp_extract_all("code", F.lit(r"(?:\b(?:def|fn|func|function|class)\s+)?\b[A-Za-z_]\w*\b(?:\s*\()?"), F.lit(0))
    names = code.select("path", F.explode(word).alias("w")).filter(~F.col("w").rlike(r"\($") & ~F.col("w").rlike(r"^(def|fn|func|function|class)\s"))
    counts = names.groupBy("path", F.col("w").alias("name")).agg(F.count("*").alias("same_file_ref_count"))
    return functions.select("path", "name").distinct().join(counts, ["path", "name"], "left").fillna(0, ["same_file_ref_count"])


def entry_points(contents: DataFrame) -> DataFrame:
    """(file, func, confidence): files named as programs are, and Python files with a main guard; no tests, examples or vendored files."""
    name = F.regexp_replace("path", "^.*/", "")
    guard = F.decode("content", "UTF-8").rlike(r"""(?m)^if\s+__name__\s*==\s*['"]__main__['"]""")
    rows = contents.filter(~F.lower("path").rlike(NO_ENTRY)).withColumn("guard", F.col("path").endswith(".py") & guard)
    return rows.filter(name.isin(ENTRY_NAMES) | F.col("guard")).select(F.col("path").alias("file"), F.lit("main").alias("func"), F.when(name.isin(ENTRY_NAMES), "high").otherwise("medium").alias("confidence"))


def semantic_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a semantic snapshot: symbols, reads, writes, closed_domains, closed_domain_sites and transition_sites."""
    document = spark.read.schema(SEMANTIC).option("multiLine", True).json(path)
    return {c: document.select(F.inline(c)) for c in document.columns}


def write_semantic_cache(facts: dict[str, DataFrame], path: str, identity: str) -> None:
    """Each table as Parquet below the identity of the snapshot that it came from."""
    for name, df in facts.items():
        df.write.mode("overwrite").parquet(f"{path}/identity={identity}/{name}")


def semantic_cache(spark: SparkSession, path: str, identity: str) -> dict[str, DataFrame] | None:
    """The cached tables if there are some of this identity."""
    names = [f.split()[0] for f in re.split(r", (?=\w+ array)", SEMANTIC)]
    try:
        return {n: spark.read.parquet(f"{path}/identity={identity}/{n}") for n in names}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


MANIFEST = "name string, extensions array<string>, file_names array<string>, ignored_dirs array<string>, test_suffixes array<string>, max_cc int, max_fan_out int, max_fan_in int, error string"


def plugin_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row a plugin.toml below ``folder``: languages, their files and thresholds; a manifest that doesn't parse gives its error."""
    rows = []
    for p in sorted(Path(folder).glob("*/plugin.toml")):
        try:
            m = tomllib.loads(p.read_text())
            plugin, s, t = m.get("plugin", {}), m.get("semantics", {}), m.get("thresholds", {})
            rows.append((plugin["name"], plugin.get("extensions", []), plugin.get("file_names", []), s.get("ignored_dirs", []), s.get("test_suffixes", []), t.get("cc_high", 15), t.get("fan_out", 15), t.get("fan_in", 20), None))
        except (tomllib.TOMLDecodeError, KeyError) as e:
            rows.append((p.parent.name, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, MANIFEST)
