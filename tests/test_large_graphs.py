"""What keeps graphs, resolution and edges of large tables cheap: numbered nodes, few lookups, one sort of the lines, partitions by input."""

import random

from pyspark.sql import functions as F

from plumbline import queries as engine
from plumbline.operators import kernels as K, resolution
from plumbline.plans import scratch
from plumbline.plans.views import RELATIONS


def _components(edges):
    nodes = {n for e in edges for n in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for x in to[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return seen

    of = {n: reach(n) for n in nodes}
    return {frozenset(m for m in of[n] if n in of[m]) for n in nodes if n in of[n] and len([m for m in of[n] if n in of[m]]) > 1}


def test_components_of_numbered_nodes(spark):
    """Two dense components under a layer without cycles, and one small cycle; colours are numbers."""
    rng = random.Random(5)
    dense = [(rng.randrange(20) + base, rng.randrange(20) + base) for base in (0, 100) for _ in range(70)]
    above = [(200 + i, 200 + rng.randrange(i)) for i in range(1, 30) for _ in range(2)] + [(200 + i, rng.choice((0, 100)) + rng.randrange(20)) for i in range(30)]
    edges = sorted({(a, b) for a, b in [*dense, *above, (300, 301), (301, 300), (301, 302)] if a != b})
    got: dict[int, set] = {}
    for r in K.coloured(spark.createDataFrame(edges, "src long, dst long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert {frozenset(x) for x in got.values()} == _components(edges)


def test_colours_that_take_long_are_left_for_trimming(spark, monkeypatch):
    monkeypatch.setattr(K, "EARLY_ROUNDS", 1)
    ring = [(i, (i + 1) % 9) for i in range(9)] + [(i, (i + 2) % 9) for i in range(9)]
    tail = [(20 + i, 19 + i) for i in range(1, 6)] + [(20, 0)]
    got = {(r["node"], r["root"]) for r in K.coloured(spark.createDataFrame(ring + tail, "src long, dst long")).collect()}
    assert {n for n, _ in got} == set(range(9)) and len({r for _, r in got}) == 1


def test_a_trim_of_many_edges_reads_them_once(spark, monkeypatch):
    monkeypatch.setattr(K, "FEW_EDGES", 0)
    read = []
    write = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, **kw: (read.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation")), write(df, **kw))[1])
    K.coloured(spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long").select(F.col("src"), F.col("dst")))
    assert max(read) <= 3


def test_a_name_is_one_lookup(spark):
    """Not one an extension and index file, each with a key of its own."""
    row = spark.createDataFrame([("src/a/b.ts", "./c")], "file string, spec string")
    assert row.select(F.size(resolution.relative_lookups(F.col("spec"), F.lit("src/a"))).alias("n")).first()["n"] == 1


def test_forms_of_a_name_in_order(spark):
    """A name's extensions, then its stem's, then its own index files; a shared suffix goes to the closest file."""
    files = ["a/x.y/index.ts", "a/x.ts", "a/z/index.ts", "b/z.ts", "b/q/z.ts", "c/q/z.ts"]
    asked = [("a/m.ts", "./x.y", "a/x.ts"), ("a/m.ts", "./z", "a/z/index.ts"), ("c/m.ts", "q/z", "c/q/z.ts"), ("d/m.ts", "q/z", "b/q/z.ts")]
    got = resolution.resolve(spark.createDataFrame([a[:2] for a in asked], "file string, spec string"), spark.createDataFrame([(f,) for f in files], "path string"))
    assert sorted((r["file"], r["spec"], r["target"]) for r in got.collect()) == sorted(asked)


def test_next_lines_take_one_sort(spark, sf_dir):
    plan = RELATIONS.frame(spark, sf_dir, "import_pairs")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1


def test_shuffles_begin_with_more_partitions_for_more_input(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "INPUT_A_PARTITION", 1 << 10)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    try:
        RELATIONS.frames(spark, sf_dir, "select * from @commits")
        assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        if before:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", before)


def test_jobs_that_an_earlier_sql_cut(spark, sf_dir):
    """Commits from the old cutoff on, all files of a cycle, the number of violations beside each, and every place of a rule."""
    run = {n: engine.queries()[n](spark, sf_dir) for n in ("git_log_source", "cycle_cluster", "max_cc", "max_fn_lines")}
    assert run["git_log_source"].filter("epoch < 902000000").count() > 0
    assert all(len(r["files"].split(",")) == r["size"] for r in run["cycle_cluster"].collect())
    for name in ("max_cc", "max_fn_lines"):
        rows = run[name].collect()
        assert rows and {r["n_files"] for r in rows} == {len(rows)}


def test_check_rules_names_every_place(spark, sf_dir):
    rows = engine.queries()["check_rules"](spark, sf_dir).collect()
    for rule in {r["rule"] for r in rows}:
        own = [r for r in rows if r["rule"] == rule]
        assert {(r["n"], r["first_file"]) for r in own} == {(len(own), min(r["file"] for r in own))}
