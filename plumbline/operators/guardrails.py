"""Guardrails: what architecture tests demand and forbid, resolved to files, concepts and roles.

Literals are read out of the tests by patterns that know escapes and negated assertions. A forbidden module fragment
meets the files that end in it by an inverted index from a path's ends at each slash; symbols meet texts
by automata of many symbols that texts stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize, ship
from ..plans.sqlops import SqlOp
from ..plans.views import RELATIONS
from .globs import glob_hits, glob_sql

#: Names of architecture tests, extensions of the sources that they name, and the assertion.
TEST_NAME = r"[.]architecture[.](test|spec)[.]tsx?$"
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
QUOTED = r"""(["'`])((?:\\.|(?!\1)[^\\])*+)\1"""
ASSERTED = r"[.]toContain\("
REFUSED = r"[.]not[.]toContain\("
SOURCE_END = r"[.](ts|tsx|js|jsx)$"
FACTORY = "^create[A-Z]"
#: Symbols that one automaton holds; more are dealt over several, which each text passes.
SYMBOLS_AT_ONCE = 200_000
#: Tests that stream past one copy of an automaton.
TEXTS_AT_ONCE = 20_000


def literals(tests: DataFrame) -> DataFrame:
    """(test, kind, literal) of tests (path, contents): quoted, required (asserted, negated or not) and forbidden (negated); without empty ones."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all("contents", F.lit(f"(?s){pattern}"), F.lit(2)), lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(x, r"(?s)\\(.)", "$1").alias("literal")))
    rows = F.concat(found("quoted", QUOTED), found("required", ASSERTED + QUOTED), found("forbidden", REFUSED + QUOTED))
    return tests.filter(F.col("path").rlike(TEST_NAME)).select(F.col("path").alias("test"), F.inline(rows)).filter("literal <> ''").distinct()


def targets(found: DataFrame, tests: DataFrame, files: DataFrame) -> DataFrame:
    """(test, file, boundary): the files that a test is named for or names, and those that a module fragment it forbids leads to."""
    paths = files.select(F.col("path").alias("file")).distinct()
    stem = F.regexp_replace("path", TEST_NAME, "")
    named = tests.filter(F.col("path").rlike(TEST_NAME)).select(F.col("path").alias("test"), F.explode(F.array(*[F.concat(stem, F.lit(x)) for x in EXTENSIONS])).alias("file"))
    literal = F.col("literal")
    written = found.filter("kind = 'quoted'").filter(literal.rlike(SOURCE_END) & literal.contains("/")).select("test", F.regexp_replace(F.regexp_replace("literal", r"^(?:[.]/)++", ""), r"\\", "/").alias("file"))
    direct = named.union(written).join(paths, "file").select("test", "file", F.lit(False).alias("boundary"))
    # A path's ends at each slash, as a fragment has one at least; what stands before it is compared afterwards.
    bare = F.regexp_replace("file", SOURCE_END, "")
    parts = F.split(bare, "/")
    ends = paths.select("file", bare.alias("bare"), F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i > 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))).alias("key"))
    fragments = found.filter("kind = 'forbidden'").filter(literal.contains("/") & ~literal.contains(" ") & ~literal.rlike(SOURCE_END)).select("test", "literal", F.regexp_replace("literal", "^[^/]*", "").alias("key"))
    led = fragments.join(ends, "key").filter(F.col("bare").endswith(F.col("literal"))).select("test", "file", F.lit(True).alias("boundary"))
    return direct.union(led).distinct()


def guardrail_scan(tests: DataFrame, files: DataFrame) -> DataFrame:
    """(file, kind, value): for each guarded file its tests, the literals that they require and forbid, required factories of owners, and those that guard it as a boundary."""
    found = materialize(literals(tests))
    to = materialize(targets(found, tests, files))
    own = to.filter("not boundary").select("test", "file")
    guarded = to.select("file", F.lit("test").alias("kind"), F.col("test").alias("value"))
    demanded = own.join(found.filter("kind <> 'quoted'"), "test").select("file", "kind", F.col("literal").alias("value"))
    factories = demanded.filter("kind = 'required'").filter(F.col("value").rlike(FACTORY)).withColumn("kind", F.lit("factory"))
    boundary = to.filter("boundary").select("test", "file").join(found.filter("kind = 'forbidden'"), "test").select("file", F.lit("boundary").alias("kind"), F.col("literal").alias("value"))
    return guarded.union(demanded).union(factories).union(boundary).distinct()


def symbol_hits(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbol): the distinct symbols that each text (path, contents) holds, anywhere in it.

    Symbols are dealt in blocks, a block's automaton is built in each task that has it, and texts stream past.
    """
    ship(texts.sparkSession)
    symbols = symbols.select("symbol").filter("symbol <> ''").distinct()
    blocks, salts = (F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / most)).cast("int") for df, most in ((symbols, SYMBOLS_AT_ONCE), (texts, TEXTS_AT_ONCE)))
    held = symbols.select(F.pmod(F.xxhash64("symbol"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("symbol").alias("path"), F.lit(None).cast("string").alias("contents"))
    passing = texts.filter("contents is not null").select(F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("path"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "path", "contents")

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        at, automaton = None, None
        for batch in batches:
            hits: set[tuple[str, str]] = set()
            for block, salt, kind, path, contents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, salt) != at:
                    at, automaton = (block, salt), ahocorasick.Automaton()
                if kind == 0:
                    automaton.add_word(path, path)
                    continue
                if not len(automaton):
                    continue
                if automaton.kind != ahocorasick.AHOCORASICK:
                    automaton.make_automaton()
                hits.update((path, symbol) for _, symbol in automaton.iter(contents))
            rows = sorted(hits)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["path", "symbol"])

    dealt = held.unionByName(passing).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
    return dealt.mapInArrow(run, "path string, symbol string").distinct()


def guardrail_concepts(tests: DataFrame, concept_symbols: DataFrame, related_tests: DataFrame) -> DataFrame:
    """(path, concept, evidence): the concepts of each architecture test, by a glob of theirs (related_test:..) or by a symbol in its text."""
    sources = tests.filter(F.col("path").rlike(TEST_NAME)).select("path", "contents")
    related = glob_hits(sources, related_tests).join(related_tests, "pattern").select("path", "concept", F.concat(F.lit("related_test:"), "pattern").alias("evidence"))
    named = symbol_hits(sources, concept_symbols).join(concept_symbols, "symbol").select("path", "concept", F.col("symbol").alias("evidence"))
    return related.union(named).distinct()


_Q = "['\"`]"
#: The tokens of a test in DuckDB, whose patterns know no back references: one branch a kind of quote.
_QUOTED_SQL = "(?s)" + "|".join(rf"{q}(?:\\.|[^{q}\\])*{q}" for q in ("''", '"', "`"))


def _literals_sql(kind: str, lead: str) -> str:
    pattern = f"{lead}(?:{_QUOTED_SQL[4:]})"
    return f"select path as test, '{kind}' as kind, regexp_replace(regexp_replace(x, '^{lead}.', '', 's'), '.$', '', 's') as raw from (select path, unnest(regexp_extract_all(contents, '(?s){pattern}')) as x from @guardrail_tests where MATCHES(path, '{TEST_NAME}')) z"


_LITERALS = f"select distinct test, kind, regexp_replace(raw, '\\\\(.)', '\\1', 'gs') as literal from ({_literals_sql('quoted', '')} union all {_literals_sql('required', ASSERTED)} union all {_literals_sql('forbidden', REFUSED)}) l where raw <> ''"
#: The definition itself, tests by files, for DuckDB.
SCAN_SQL = f"""
    with l as ({_LITERALS}), t as (select path as test, regexp_replace(path, '{TEST_NAME}', '') as stem from @guardrail_tests where MATCHES(path, '{TEST_NAME}')),
    own as (select t.test, f.path as file from t join @files f on f.path in (t.stem || '.ts', t.stem || '.tsx', t.stem || '.js', t.stem || '.jsx')
            union select l.test, f.path from l join @files f on f.path = replace(regexp_replace(l.literal, '^(?:[.]/)+', ''), chr(92), '/') where l.kind = 'quoted' and MATCHES(l.literal, '{SOURCE_END}') and HAS(l.literal, '/')),
    led as (select distinct l.test, f.path as file from l join @files f on ENDS(regexp_replace(f.path, '{SOURCE_END}', ''), l.literal) where l.kind = 'forbidden' and HAS(l.literal, '/') and not HAS(l.literal, ' ') and not MATCHES(l.literal, '{SOURCE_END}'))
    select file, 'test' as kind, test as value from own union select file, 'test', test from led
    union select o.file, l.kind, l.literal from own o join l on l.test = o.test where l.kind <> 'quoted'
    union select o.file, 'factory', l.literal from own o join l on l.test = o.test where l.kind = 'required' and MATCHES(l.literal, '{FACTORY}')
    union select b.file, 'boundary', l.literal from led b join l on l.test = b.test where l.kind = 'forbidden'"""


CONCEPTS_SQL = f"""select t.path, c.concept, c.symbol as evidence from @guardrail_tests t join @concept_symbols c on c.symbol <> '' and HAS(t.contents, c.symbol) where MATCHES(t.path, '{TEST_NAME}')
    union select t.path, r.concept, 'related_test:' || r.pattern from @guardrail_tests t join @related_tests r on {glob_sql('t.path', 'r.pattern')} where MATCHES(t.path, '{TEST_NAME}')"""

#: Roles that a path alone tells, by pattern.
PATH_ROLES = {
    "route_surface": "^src/app/(.*/)?(page|layout|loading|error|not-found)[.]tsx?$",
    "api_route_surface": "^src/app/api/(.*/)?route[.]tsx?$",
    "http_handler_surface": "^src/(routes|controllers|api|server/routes|server/controllers)/",
    "entry_surface": "^src/app/api/(.*/)?route[.]tsx?$|^src/(routes|controllers|api|server/routes|server/controllers)/",
    "provider_surface": "^src/app/providers[.]tsx?$|/(providers|contexts)/",
    "service_layer": "/services/",
    "query_hook_surface": "/hooks/queries/|-queries[.]tsx?$",
    "repository_layer": "/(repositories|db|persistence)/",
    "middleware_surface": "^src/middleware[.]tsx?$|/middleware/",
    "feature_module_barrel": "^src/modules/[^/]+/index[.]tsx?$",
    "state_container": "/store/|[.]store[.]tsx?$",
}
#: Paths that look like entry surfaces to what they import, facades of transport, and the store's own module.
ENTRY_PATH = "/(index|main)[.]tsx?$|^src/app/(.*/)?(page|layout|loading|error|not-found)[.]tsx?$|^src/(routes|controllers|api|server/routes|server/controllers)/|^src/middleware[.]tsx?$"
TRANSPORT = "(/|-)ipc[.]"
STORE_MODULE = "store/store[.]"
_GUARDED = "select file as path, count(case when kind = 'test' then 1 end) as tests, count(case when kind = 'factory' then 1 end) as factories, count(case when kind = 'boundary' then 1 end) as boundaries from @guardrail_evidence group by file"
_PATH_ROLES = " union all ".join(f"select path, '{role}' as role from @files where MATCHES(path, '{pattern}')" for role, pattern in PATH_ROLES.items())
_OWN_ROLES = f"""
    select file as path, 'entry_surface' as role from @entry_points union {_PATH_ROLES}
    union select path, 'guarded_seam' from ({_GUARDED}) g where tests > 0 union select path, 'facade_with_extracted_owners' from ({_GUARDED}) g where factories >= 2
    union select path, 'guarded_boundary' from ({_GUARDED}) g where boundaries > 0 union select path, 'component_barrel' from ({_GUARDED}) g where boundaries > 0 and MATCHES(path, '{STORE_MODULE}')"""
_ROLES = f"""
    select path, role from @own_roles union select path, 'transport_facade' from @files where MATCHES(path, '{TRANSPORT}')
    union select e.to_file, 'composition_root' from @import_edges e where STARTS(e.to_file, 'src/') and not MATCHES(e.to_file, '{PATH_ROLES['route_surface']}|{PATH_ROLES['api_route_surface']}')
          and (MATCHES(e.from_file, '{ENTRY_PATH}') or e.from_file in (select path from @own_roles where role = 'entry_surface'))"""

RELATIONS.views |= {
    # Architecture tests of some files: they name owners, refuse parts of other files' paths, and mention sources and symbols.
    "guardrail_tests": """
        select regexp_replace(f.path, '[.]ts$', case when f.k % 4 = 1 then '.architecture.spec.tsx' else '.architecture.test.ts' end) as path,
               'expect(s).toContain(' || chr(39) || 'createOwner' || cast(f.k % 5 as string) || chr(39) || ');' || chr(10)
               || case when f.k % 3 = 0 then 'expect(s) .toContain("createRuntime");' when f.k % 3 = 1 then 'expect(s).toContain("createRuntime")' else 'expect(s).toContain(name, "create")' end || chr(10)
               || 'expect(s).not.toContain(`' || substr(regexp_replace(g.path, '[.]ts$', ''), case when f.k % 2 = 0 then 5 else 8 end) || '`);' || chr(10)
               || 'read("./' || h.path || '"); const q = "a ' || chr(92) || '"quoted' || chr(92) || '" word";' || chr(10)
               || case when f.k % 5 = 0 then 'expect(s).not.toContain(' || chr(39) || 'two words/here' || chr(39) || '); // it' || chr(39) || 's open' else 'store.' || lower(n.n_name) || ' store.none' end as contents
        from @files f join @files g on g.k = f.k + 3 join @files h on h.k = f.k + 5 join @nation n on n.n_nationkey = f.k % 25
        where f.k % 6 = 1 and not f.is_test and not f.is_barrel""",
    "concept_symbols": "select concept, target as symbol from @concept_targets union select concept, 'createOwner' || cast(rk as string) from @concepts",
    "related_tests": "select concept, 'src/brand' || cast(rk + 1 as string) || '1/*' as pattern from @concepts union select concept, '*.spec.tsx' from @concepts where rk = 2",
    "own_roles": _OWN_ROLES, "role_tags": _ROLES,
}
RELATIONS.computed |= {"guardrail_evidence": (lambda t, f: materialize(guardrail_scan(t, f)), ("guardrail_tests", "files"), SCAN_SQL)}

OPS: dict[str, SqlOp] = {
    "guarded_files": SqlOp("Each guarded file's tests, literals, factories and boundary guards, counted", f"select * from ({_GUARDED}) g"),
    "path_role_tags": SqlOp("The roles of each file: by its path, by guardrails, and by what imports it", "select path, SETJOIN(role) as roles from @role_tags group by path"),
}
#: name: (operator, its relations in order, its DuckDB SQL or None)
COMPUTED = {
    "guardrail_scan": (guardrail_scan, ("guardrail_tests", "files"), SCAN_SQL),
    "guardrail_concepts": (guardrail_concepts, ("guardrail_tests", "concept_symbols", "related_tests"), CONCEPTS_SQL),
}
