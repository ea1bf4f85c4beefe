"""Reports that once left out a part of their work or formed far too many pairs, on small relations."""

import pytest

from plumbline import queries as engine, tools
from plumbline.operators import evolution, findings, health


@pytest.mark.parametrize("name", ["change_coupling", "change_coupling_min2"])
def test_files_beyond_the_fiftieth_of_a_commit_are_coupled(spark, name):
    paths = [f"m{i:02}.ts" for i in range(55)] + ["a.ts", "b.ts"]
    rows = [(commit, path, pos, 1, 0) for commit in (1, 2, 3) for pos, path in enumerate(paths)]
    frames = {
        "commit_files": spark.createDataFrame(rows, "commit_id long, path string, pos long, added long, removed long"), "commits": spark.createDataFrame([(c, "x", c, 1) for c in (1, 2, 3)], "commit_id long, author string, epoch long, parents long"),
        "known_files": spark.createDataFrame([(p,) for p in paths], "path string"),
    }
    got = [tuple(r) for r in evolution.OPS[name].run(**frames).collect()]
    assert len(got) == 50 and got[0] == ("a.ts", "b.ts", 3, 1.0) and got[1] == ("a.ts", "m00.ts", 3, 1.0)


@pytest.fixture
def large(spark):
    """a.ts has many functions, one of much cognitive complexity, dependencies and a guardrail test; b.ts has next to nothing."""
    functions = [("a.ts", f"f{i}", 10, None, 45 if i == 3 else 1, False, False, 0) for i in range(25)] + [("b.ts", "g", 10, 10, None, True, False, 0)]
    return {
        "files": spark.createDataFrame([("a.ts", "typescript", 600), ("b.ts", "typescript", 600), ("c.ts", "unknown", 900)], "path string, lang string, lines long"),
        "functions": spark.createDataFrame(functions, "path string, name string, ln long, cc long, cog long, is_public boolean, is_method boolean, same_file_ref_count long"),
        "degrees": spark.createDataFrame([("a.ts", 2, 0), ("b.ts", 1, 0)], "path string, fan_out long, fan_in long"),
        "role_tags": spark.createDataFrame([("a.ts", "guarded_seam"), ("a.ts", "service_layer"), ("b.ts", "service_layer")], "path string, role string"),
    }


def test_a_large_file_scores_by_its_first_cut_too(large):
    # 2400, 720 for a fifth over the limit, 2400 for complexity 45, and a twelfth of 1200 + 1800 + 2000 + 1600 + 1700 + 1000.
    assert sorted(map(tuple, findings.OPS["large_file_report"].run(**large).collect())) == [("a.ts", 6295), ("b.ts", 3220)]


def test_structural_debt_has_six_kinds(spark, large):
    files = large["files"].union(spark.createDataFrame([("s.ts", "typescript", 10)], large["files"].schema))
    degrees = large["degrees"].union(spark.createDataFrame([("s.ts", 30, 40)], large["degrees"].schema))
    others = {
        "calls": spark.createDataFrame([("f0",)], "callee string"), "cycle_clusters": spark.createDataFrame([("p.ts", 7000)], "cycle_id string, score long"), "dead_islands": spark.createDataFrame([("q.ts", 2900)], "island string, score long"),
    }
    got = {(r["kind"], r["scope"]): (r["score"], r["severity"]) for r in findings.OPS["structural_debt"].run(**large | others | {"files": files, "degrees": degrees}).collect()}
    assert got.pop(("dependency_sprawl", "s.ts"))[0] > 2800 and got.pop(("unstable_hotspot", "s.ts"))[0] > 3200
    assert got == {
        ("large_file", "a.ts"): (6295, "medium"), ("large_file", "b.ts"): (3220, "medium"), ("dead_private_code_cluster", "a.ts"): (7900, "high"),
        ("cycle_cluster", "cycle:p.ts"): (7000, "high"), ("dead_island", "island:q.ts"): (2900, "low"),
    }


@pytest.mark.parametrize("numbered", [True, False])
def test_arch_report_has_blast_surface_and_distance(spark, numbered):
    names = {1: "a.ts", 2: "b.ts", 3: "c.ts", 4: "d.ts"}
    edges = [(1, 2), (2, 1), (2, 3), (4, 2)]
    if numbered:  # with repeats, and numbers that no file has
        graph = spark.createDataFrame([*edges, (4, 2), (1, 99), (99, 4)], "src long, dst long")
    else:
        graph = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "src string, dst string")
    levels = spark.createDataFrame([(p, k, 1, "a.ts" if k < 3 else p) for k, p in names.items()], "path string, node long, level long, scc string")
    points = spark.createDataFrame([("b.ts",), ("elsewhere.ts",)], "file string")
    blast, surface = health.import_dependants(graph, levels), health.import_surface(graph, levels, points)
    assert sorted(map(tuple, blast.collect())) == [("a.ts", 2), ("b.ts", 2), ("c.ts", 3), ("d.ts", 0)] and sorted(r[0] for r in surface.collect()) == ["a.ts", "b.ts", "c.ts"]
    frames = {
        "levels": levels, "import_dependants": blast, "import_surface": surface, "upward": spark.createDataFrame([(1,)], "from_file long"), "health": spark.createDataFrame([(4, 4, 1)], "total_import_edges long, graph_files long, cycle_count long"),
        "files": spark.createDataFrame([(1, "m"), (2, "m"), (3, "n")], "k long, module string"), "module_edges": spark.createDataFrame([("m", "n", "a.ts", "c.ts")], "from_module string, to_module string, from_file string, to_file string"),
    }
    row = health.OPS["arch_report"].run(**frames).first()
    assert (row["max_blast_radius"], row["max_blast_file"], row["attack_surface_files"], row["attack_surface_ratio"], row["upward_ratio"]) == (3, "c.ts", 3, 0.75, 0.25)
    assert row["avg_distance"] == 0.0  # m has no abstract file and depends on n only: 0 + 1 - 1; n is a foundation


def test_a_concept_is_counted_side_by_side(spark):
    concepts = spark.createDataFrame([("one",), ("two",), ("one",)], "concept string")
    targets = spark.createDataFrame([("one", "store.a"), ("one", "store.b"), ("one", "store.a")], "concept string, target string")
    writes = spark.createDataFrame([("store.a", f"w{i % 3}.ts", i) for i in range(300)], "symbol string, path string, line long")
    reads = spark.createDataFrame([("store.b.field", f"r{i % 7}.ts", i) for i in range(300)], "symbol string, path string, line long")
    frames = {"concepts": concepts, "concept_targets": targets, "writes": writes, "reads": reads}
    got = tools.explain_concept(*frames.values())
    assert sorted(map(tuple, got.collect())) == [("one", 2, 3, 7), ("two", 0, 0, 0)] == sorted(map(tuple, tools.OPS["tool_explain_concept"].run(**frames).collect()))


def test_bases_are_looked_up_in_imported_files(spark, sf_dir):
    plan = engine.queries()["inherit_edge_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    named = [line for line in plan.splitlines() if "Join" in line and "base#" in line]
    assert named and all("to_file#" in line for line in named)
