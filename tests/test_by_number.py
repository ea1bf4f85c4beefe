"""Edges by number in place of names, where files and numbers are one to one."""

from plumbline.operators import health
from plumbline.plans.sqlops import SqlOp
from plumbline.plans.views import _MODULE_FLOWS, RELATIONS, by_number

BY_NAME = {"import_edges", "dependency_edges", "call_edges", "adjacency"}


def test_flows_use_no_names(spark, sf_dir):
    seen = {}
    flows, names = RELATIONS.frame(spark, sf_dir, "module_flows", seen), SqlOp("flows", _MODULE_FLOWS)
    assert sorted(map(tuple, flows.collect())) == sorted(map(tuple, names.run(adjacency=seen["adjacency"], module_paths=seen["module_paths"]).collect()))
    plan = flows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "from_file" not in plan


def test_two_files_of_one_number_go_by_name(spark):
    part = spark.createDataFrame([(1, "Brand#1", 3), (1, "Brand#2", 3), (2, "Brand#1", 3)], "p_partkey long, p_brand string, p_size int")
    single = part.filter("p_brand = 'Brand#1'")
    for rows, want in ((part, False), (single, True), (single.union(spark.createDataFrame([(None, "Brand#1", 3)], part.schema)), False), (single.union(spark.createDataFrame([(3, None, 3)], part.schema)), False)):
        assert by_number(RELATIONS.frame(spark, "", "module_paths", {"part": rows})) == want


def test_modularity_writes_no_edges_by_name():
    assert not RELATIONS.often(f"@{health.part_of_health('select h.modularity from @health h')}") & BY_NAME


def test_edges_that_names_are_read_of_are_written():
    assert "dependency_edges" in RELATIONS.often("@module_flows @node_degrees @dependency_edges")
    assert "next_lines" in RELATIONS.often("@module_flows")


def test_files_are_looked_up_once(spark, sf_dir, monkeypatch):
    files, asked = RELATIONS.frame(spark, sf_dir, "module_paths"), []
    kind, agg = type(files), type(files).agg
    monkeypatch.setattr(kind, "agg", lambda *a: (asked.append(1), agg(*a))[1])
    assert by_number(files) and by_number(files) and len(asked) == 1
