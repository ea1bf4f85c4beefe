"""Degrees, flows between modules and the health row by counts, against the views that they stand for."""

from plumbline.operators import health
from plumbline.plans.sqlops import SqlOp, relations_of
from plumbline.plans.views import RELATIONS, VIEWS


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_edges(spark):
    """Repeats, edges of one file, missing paths on either side."""
    imports = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), (None, "a"), ("a", None), (None, None), ("x", "a")]
    calls = [("a", "b"), ("b", "a"), (None, "a"), ("d", "a")]
    schema = "from_file string, to_file string"
    return {"dependency_edges": spark.createDataFrame(imports, schema), "call_edges": spark.createDataFrame(calls, schema)}


def test_health_reads_no_edge_table_by_module():
    reads = RELATIONS.reads("select * from @health")
    assert reads["module_flows"] and reads["node_degrees"]
    assert not {"edges", "module_edges", "degrees"} & set(reads)


def test_upward_edges_need_no_distinct(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    lv = spark.createDataFrame([("a", "a", 0), ("b", "a", 0), ("c", "c", 1)], "path string, scc string, level bigint")
    found = RELATIONS.computed["upward"][0](e, lv)
    assert rows(found.select("from_file", "to_file")) == [("a", "b"), ("b", "a")]
    want = SqlOp("upward", health.UPWARD_SQL).run(dependency_edges=e.toDF("from_file", "to_file"), levels=lv)
    assert rows(found) == rows(want.select(*found.columns))


def test_edges_and_degrees_of_odd_edges(spark):
    seen = odd_edges(spark)
    edges = SqlOp("edges", VIEWS["edges"]).run(**seen)
    assert rows(RELATIONS.frame(spark, "", "edges", seen)) == rows(edges)
    degrees = SqlOp("degrees", VIEWS["degrees"]).run(edges=edges)
    assert rows(RELATIONS.frame(spark, "", "degrees", seen)) == rows(degrees)


def test_flows_of_repeated_edges(spark):
    seen = odd_edges(spark)
    modules = [(p, m) for p, m in (("a", "m"), ("b", "m"), ("b", "n"), ("c", None), ("x", "n"))]  # b has two, d has none
    seen["module_paths"] = spark.createDataFrame(modules, "path string, module string")
    flows = RELATIONS.frame(spark, "", "module_flows", seen)
    for column, of in (("edges", "edges"), ("imports", "dependency_edges")):
        per = SqlOp("flows", f"select a.module as f, b.module as t, count(*) as n from @{of} e join @module_paths a on a.path = e.from_file join @module_paths b on b.path = e.to_file group by 1, 2")
        assert rows(flows.filter(f"{column} > 0").select("from_module", "to_module", column)) == rows(per.run(**{n: RELATIONS.frame(spark, "", n, seen) for n in relations_of(per.sql)}))


def test_degrees_pass_over_neighbours_once(spark, sf_dir):
    plan = RELATIONS.frame(spark, sf_dir, "degrees", odd_edges(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 0
