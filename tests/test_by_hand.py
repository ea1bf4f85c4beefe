"""Operators on small relations whose results are worked out by hand from the rules, not from the same SELECT."""

import pytest
from pyspark.sql import functions as F

from plumbline import queries as engine
from plumbline.functions import paths as P
from plumbline.operators import contracts, degrees, evolution, globs, resolution, rules, sessions, structural
from plumbline.plans.ranking import global_rank
from plumbline.plans.sqlops import SqlOp, relations_of
from plumbline.plans.views import NOW, RELATIONS


def run(spark, op, **frames):
    """``op`` over the given relations, and over views of them."""
    seen = dict(frames)
    return op.run(spark, **{n: RELATIONS.frame(spark, "", n, seen) for n in relations_of(op.sql)})


GLOBS = [
    ("src/ui/**", "src/uix/a.ts", True), ("src/ui/**", "src/ui/a/b.ts", True), ("src/ui/**", "src/ui", False), ("src/ui/**/*", "src/uix.ts", True), ("src/ui/**/*", "src/ui", False),
    ("src/ui/*", "src/ui/a.ts", True), ("src/ui/*", "src/ui/a/b.ts", False), ("src/ui/*", "src/uix.ts", True), ("src/ui/*", "src/ui", True), ("*.ts", "a/b.ts", True), ("*.ts", "a/bts", False),
    ("src/ui", "src/ui/a.ts", True), ("src/ui", "src/uix.ts", False), ("src/ui/a.ts", "src/ui/a.ts", True), ("src/brand1*", "src/brand11/a.ts", False),
]


def test_globs(spark):
    df = spark.createDataFrame(GLOBS, "pattern string, path string, want boolean")
    assert df.withColumn("got", F.expr(SqlOp("", globs.glob_sql("path", "pattern")).sql.replace("ENDS(", "endswith(").replace("STARTS(", "startswith(").replace("HAS(", "contains("))).filter("got <> want").collect() == []
    for pattern, path, want in GLOBS:
        assert df.limit(1).select(P.glob_match(pattern, F.lit(path))).first()[0] == want, (pattern, path)
    hits = globs.glob_hits(df, df.union(spark.createDataFrame([(None, None, None)], df.schema)))
    assert {(p, q) for q, p in hits.collect()} >= {(p, q) for p, q, want in GLOBS if want} and not {(p, q) for q, p in hits.collect()} & {(p, q) for p, q, want in GLOBS if not want}
    assert globs.glob_hits(df, df.limit(0)).collect() == []


def test_no_rule_tries_every_pattern_on_every_path(spark, sf_dir):
    """The plans of the relations by which rules find what their globs match, and those of rules over them."""
    plans, seen = [], {}
    for relation, (_, names, _) in RELATIONS.computed.items():
        if relation.endswith(("_hits", "_by_file")):
            paths, patterns = (RELATIONS.frame(spark, sf_dir, n, seen) for n in names)
            path, pattern = "file" if names[0] == "findings" else "path", next(c for c in patterns.columns if c in ("pattern", "path_pattern", "file_glob", "root"))
            plans.append(globs.glob_hits(paths.select(F.col(path).alias("path")), patterns.select(F.col(pattern).alias("pattern"))))
    plans += [engine.queries()[name](spark, sf_dir) for name in ("glob_predicate", "boundary_rule", "writer_policy", "suppression_anti_join")]
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(texts) > 8 and not [t for t in texts if "NestedLoop" in t or "Cartesian" in t]


def test_suppressions_need_kind_concept_and_file(spark):
    found = [("a", "large_file", "x", "src/ui/a.ts"), ("b", "large_file", "y", "src/ui/b.ts"), ("c", "clone", None, "src/db/c.ts"), ("d", "clone", "y", "lib/d.ts"), ("e", "cycle", "z", "lib/e.ts")]
    rules_ = [("large_file", "x", "src/ui/**", None), ("*", None, "src/db/*", "2999-01-01"), ("*", "y", None, "1990-01-01"), ("cycle", "q", None, None), ("clone", None, "*.py", None)]
    frames = {"findings": spark.createDataFrame(found, "key string, kind string, concept string, file string"), "suppressions": spark.createDataFrame(rules_, "kind string, concept string, file_glob string, expires string")}
    assert {r["key"] for r in run(spark, rules.OPS["suppression_anti_join"], **frames).collect()} == {"b", "d", "e"}
    hits = {(r["kind"], r["concept"], r["file_glob"]): (r["expired"], r["hits"]) for r in run(spark, rules.OPS["suppression_hits"], **frames).collect()}
    assert hits == {("large_file", "x", "src/ui/**"): (False, 1), ("*", "", "src/db/*"): (False, 1), ("*", "y", ""): (True, 2), ("cycle", "q", ""): (False, 0), ("clone", "", "*.py"): (False, 0)}


def test_a_family_takes_its_gravest_severity(spark):
    clones = spark.createDataFrame([(1, "low", 5), (2, "high", 3), (3, "medium", 9), (4, "medium", 2), (5, "low", 1)], "bh long, severity string, risk long")
    families = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (5, 3)], "bh long, family long")
    got = {(r["kind"], r["id"]): r["severity"] for r in run(spark, contracts.OPS["clone_report"], clones=clones, clone_families=families).collect()}
    assert got == {("clone_family", 1): "high", ("clone_family", 3): "medium", ("exact_clone_group", 4): "medium"}


def test_test_files(spark):
    yes = ["spec/a.rb", "a/fixtures/x.json", "Testdata/y", "a/test.py", "a/foo_test.go", "FooSpec.java", "x.spec.ts", "lib/FooTests.cs"]
    no = ["src/testing.py", "contest.py", "latest.ts", "spectrum/a.py"]
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r[0] for r in df.filter(P.is_test_file(F.col("path"))).collect()} == set(yes)


def health(spark, **values):
    row = {"quality_signal": 0.5, "coupling_score": 0.3, "cycle_count": 2, "god_files": 1, "complex_functions": 5} | values
    return spark.createDataFrame([tuple(row.values())], "quality_signal double, coupling_score double, cycle_count long, god_files long, complex_functions long")


@pytest.mark.parametrize(("change", "degraded"), [({}, False), ({"quality_signal": 0.481}, False), ({"quality_signal": 0.47}, True), ({"coupling_score": 0.349}, False), ({"coupling_score": 0.36}, True), ({"cycle_count": 3}, True), ({"god_files": 2}, True), ({"complex_functions": 6}, True), ({"cycle_count": 0}, False)])
def test_baseline_diff(spark, change, degraded):
    before = spark.createDataFrame([(0.5, 0.3, 2, 1, 5)], "quality_signal double, coupling_score double, cycle_count long, god_file_count long, complex_fn_count long")
    assert run(spark, rules.OPS["baseline_diff"], health=health(spark, **change), structural_baseline=before).first()["degraded"] == degraded


def test_outcome_buckets_take_the_first_case(spark):
    schema = "event_id long, lane string, status string, presented boolean, top boolean, regressed boolean, final_clean boolean, convergence string"
    cases = [
        (1, "live", "failed", True, True, True, True, "x", "provider_failed"), (2, "live", "completed", False, False, True, True, "x", "regressed"), (3, "live", "completed", False, True, False, True, "x", "clean_but_missed_expected_signal"),
        (4, "live", "completed", False, True, False, False, "x", "missed_expected_signal"), (5, "live", "completed", True, False, False, True, "x", "clean_but_misranked"), (6, "live", "completed", True, False, False, False, "x", "expected_signal_present_not_top"),
        (7, "live", "completed", True, True, False, True, "thrashing", "thrashing"), (8, "live", "completed", True, True, False, True, "stalled", "stalled"), (9, "live", "completed", True, True, False, True, "converging", "clean"), (10, "live", "completed", True, True, False, False, "converging", "incomplete"),
    ]
    got = run(spark, sessions.OPS["outcome_bucket"], trials=spark.createDataFrame([c[:-1] for c in cases], schema)).collect()
    assert {r["event_id"]: r["bucket"] for r in got} == {c[0]: c[-1] for c in cases}


def test_promotion_recommendation(spark):
    verdicts = [("noisy", c, i) for i, c in enumerate(["tp", "fp"])] + [("unseen", "tp", 5), ("vague", "acceptable", 6), ("good", "tp", 7)]
    trial = lambda signal, presented, top, cleared, clean: (signal, presented, top, cleared, False, clean, "converging", 1.0)
    trials = [trial("unseen", False, False, False, True), trial("weak", True, False, False, True), trial("good", True, True, True, True), trial("late", True, True, True, False)] + [trial("lost", True, False, True, True)] * 3
    got = run(
        spark, sessions.OPS["promotion_recommendation"], verdicts=spark.createDataFrame(verdicts, "signal string, category string, idx long"),
        trials=spark.createDataFrame(trials, "signal string, presented boolean, top boolean, cleared boolean, regressed boolean, final_clean boolean, convergence string, checks double"),
    ).collect()
    assert {r["signal"]: r["recommendation"] for r in got} == {"noisy": "degrade_or_quarantine", "unseen": "improve_detection", "vague": "keep_unspecified", "good": "keep_unspecified", "weak": "improve_fix_guidance", "late": "improve_fix_guidance", "lost": "improve_fix_guidance"}


def test_age_is_0_in_the_future(spark):
    day = 86400
    files = spark.createDataFrame([(1, "a", 0, 1, 1), (2, "a", 0, 1, 1), (3, "b", 0, 1, 1)], "commit_id long, path string, pos long, added long, removed long")
    commits = spark.createDataFrame([(1, "x", NOW - 9 * day), (2, "x", NOW - 5 * day), (3, "y", NOW + 7 * day)], "commit_id long, author string, epoch long")
    got = run(spark, evolution.OPS["code_age_days"], commit_files=files, commits=commits, known_files=spark.createDataFrame([("a",), ("b",)], "path string")).collect()
    assert {r["path"]: r["age_days"] for r in got} == {"a": 5, "b": 0}


def test_directories_at_any_depth(spark):
    files = spark.createDataFrame([("a/b/c/x", 1, 1, 0, 0), ("a/b/y", 2, 2, 0, 0), ("z", 4, 4, 0, 0)], "path string, lines long, logic long, comments long, blanks long")
    got = run(spark, degrees.OPS["dir_rollup"], files=files).collect()
    assert {r["dir"]: (r["files"], r["lines"]) for r in got} == {"a": (2, 3), "a/b": (2, 3), "a/b/c": (1, 1)}


def test_gini_counts_values(spark):
    rows = lambda values: spark.createDataFrame([(v,) for v in values], "cc long")
    files = spark.createDataFrame([("a", 10, False, "py"), ("b", 30, False, "py")], "path string, lines long, is_dir boolean, lang string")
    gini = lambda values: run(spark, degrees.OPS["complexity_gini"], functions=rows(values), files=files).first()[0]
    assert gini([10, 10, 10, 10]) == 0.0 and gini([0, 0, 0, 100]) == 0.75 and gini([1, None, 4]) == pytest.approx(1 / 3, abs=1e-6)
    assert gini([]) == 0.25  # of the lines of files


def test_module_declarations_are_left_out(spark):
    edges = [("src/app/mod.rs", "src/app/state.rs"), ("src/app/mod.rs", "src/app/tools/mod.rs"), ("src/app/mod.rs", "src/app/tools/deep/x.rs"), ("lib.rs", "foo.rs"), ("src/a.rs", "src/b.rs"), ("src/app/mod.rs", "src/apps/x.rs")]
    got = RELATIONS.frame(spark, "", "dependency_edges", {"import_edges": spark.createDataFrame(edges, "from_file string, to_file string")}).collect()
    assert {tuple(r) for r in got} == set(edges[2:])


FILES = ["src/app/main.ts", "src/app/util.ts", "src/lib/util.ts", "src/lib/index.ts", "src/lib/deep/only.py", "src/app/deep/util.js", "root.ts"]
SPECS = [
    ("src/app/main.ts", "./util", "src/app/util.ts", "resolved"), ("src/app/main.ts", "../lib", "src/lib/index.ts", "resolved"), ("src/app/main.ts", "../../root", "root.ts", "resolved"), ("src/app/main.ts", "../../../root", "root.ts", "resolved"),
    ("src/app/main.ts", "./util.js", "src/app/util.ts", "resolved"), ("src/app/main.ts", "./none", None, "internal"), ("src/app/main.ts", "lib/util", "src/lib/util.ts", "resolved"), ("src/app/main.ts", "x/y/only", "src/lib/deep/only.py", "resolved"),
    ("src/app/main.ts", "x/util", "src/app/util.ts", "resolved"), ("src/app/main.ts", "@/lib/util", "src/lib/util.ts", "resolved"), ("src/app/main.ts", "react", None, "external"), ("src/app/main.ts", "@scope/pkg", None, "unknown"), ("src/app/main.ts", "node:fs/x", None, "external"),
    ("src/app/util.ts", "./util", None, "internal"), ("src/app/main.ts", "src/lib/util.ts", "src/lib/util.ts", "resolved"), ("src/app/main.ts", "<vector>", None, "external"), ("src/app/main.ts", "deep/util", "src/app/deep/util.js", "resolved"),
]


def test_import_resolution(spark):
    specs = spark.createDataFrame([s[:2] for s in SPECS] + [("src/app/main.ts", None), ("src/app/main.ts", "")], "file string, spec string")
    got = resolution.resolve(specs, spark.createDataFrame([(f,) for f in FILES], "path string"), [("@/", "src/")]).collect()
    assert {(r["file"], r["spec"]): (r["target"], r["kind"]) for r in got} == {s[:2]: s[2:] for s in SPECS}


def test_closest_prefers_shared_directories_then_names(spark):
    index = [("one", "a/c/1"), ("one", "a/b/2"), ("one", "z/0"), ("one", "a/b/x"), ("two", "m/1"), ("two", "b/1"), ("alone", "a/b/2")]
    asked = [("a/b/x", "one"), ("z/0", "one"), ("q", "two"), ("a/b/2", "alone")]
    got = resolution.closest(spark.createDataFrame(asked, "file string, name string"), spark.createDataFrame(index, "name string, path string"), "name").collect()
    assert {r["file"]: r["path"] for r in got} == {"a/b/x": "a/b/2", "z/0": "a/b/2", "q": "b/1"}


def test_cut_effects(spark):
    """Two triangles that share b: each edge of one frees the two files that only it holds; an edge with another way round frees none."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "b")]
    frame = lambda rows: spark.createDataFrame(rows, "from_file string, to_file string")
    members = structural.cycles(frame(edges))
    assert {r["path"] for r in members.collect()} == set("abcde")
    got = {(r["from_file"], r["to_file"]): (r["remaining"], r["reduction"]) for r in structural.cut_effects(members, frame(edges), frame([("a", "b")]).limit(0)).collect()}
    assert got == {e: (3, 2) for e in edges}
    got = structural.cut_effects(members, frame([*edges, ("c", "b")]), frame([("a", "b")])).collect()
    assert ("b", "c") in {(r["from_file"], r["to_file"]) for r in got} and ("c", "a") in {(r["from_file"], r["to_file"]) for r in got}
    assert {(r["from_file"], r["to_file"]): r["reduction"] for r in got}[("c", "a")] == 1


def test_scrub_keeps_lines(spark):
    source = "a('x // y') // z\n/* q\nr */ b(`s\n${t}`) 'open\nc"
    got = structural.scrub_code(spark.createDataFrame([("p", source), ("n", None)], "path string, contents string")).collect()
    code = {r["path"]: r["code"] for r in got}
    assert code["n"] is None and len(code["p"]) == len(source) and code["p"].split("\n") == ["a(" + " " * 8 + ")" + " " * 5, " " * 4, "     b(  ", "      " + " " * 1 + " " * 0 + ") " + " " * 5, "c"] or code["p"].replace(" ", "") == "a()\n\nb(\n)\nc"


def test_conditions(spark):
    df = spark.createDataFrame([(1.0, "abc", True, None)], "n double, s string, b boolean, z double")
    passed = lambda c, o, v=None: df.select(contracts.condition(F.col(c), o, v)).first()[0]
    assert passed("n", "gte", 1.0) and not passed("n", "gt", 1.0) and passed("n", "at_most", 1.0) and passed("s", "includes", "b") and passed("s", "one_of", ["abc"]) and passed("b", "is_true")
    assert not passed("z", "exists") and not passed("z", "lte", 5.0) and not passed("z", "not_equals", 1.0) and not passed("b", "is_false") and passed("s", "non_empty")
    with pytest.raises(ValueError):
        contracts.condition(F.col("n"), "like")


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    got = global_rank(df, [F.desc("v")], "place").collect()
    assert {r["place"]: r["v"] for r in got} == {i + 1: 4999 - i for i in range(5000)}


def test_no_plan_gathers_rows_in_one_window_or_broadcasts_a_null_aware_anti_join(spark, sf_dir):
    """Windows over everything are left to queries that sum distinct values, sources or partitions."""
    few = {"complexity_gini", "churn_concentration", "top_actions", "representative_sample", "verdict"}
    for name, op in engine.sql_ops().items():
        if "@health" in op.sql or name in few:
            continue
        text = op.sql.lower()
        assert " not in (select" not in text, name
        assert "over (order by" not in text or name in few, name
