"""A score's rule makes only what that score is counted from."""

import pytest

from plumbline.operators import health, rules
from plumbline.plans.sqlops import SqlOp, relations_of
from plumbline.plans.views import RELATIONS

EDGES = {"levels", "import_graph", "dependency_edges", "adjacency", "module_flows", "node_degrees", "stable"}


def needed(sql):
    part = health.part_of_health(sql)
    return set(RELATIONS.reads(f"@{part}"))


@pytest.mark.parametrize(("rule", "may"), [("min_equality", set()), ("min_redundancy", set()), ("min_modularity", {"adjacency", "module_flows", "dependency_edges"}), ("min_depth", {"levels", "import_graph", "dependency_edges"}), ("min_acyclicity", {"levels", "import_graph", "dependency_edges"})])
def test_a_rule_reads_its_own_score_only(rule, may):
    assert needed(rules.CHECKS[rule]) & EDGES == may


def test_the_signal_reads_all_scores_and_no_degrees():
    found = needed(rules.CHECKS["min_quality"])
    assert {"levels", "module_flows", "functions", "calls"} <= found and not {"node_degrees", "stable"} & found


def test_whole_rows_need_all():
    assert health.part_of_health("select * from @health") == health.part_of_health("select h.* from @health h") == "health"


def test_parts_equal_the_whole_row(spark, sf_dir):
    whole = RELATIONS.frames(spark, sf_dir, "select * from @health")["health"].first()
    want = SqlOp("health", health.HEALTH_SQL)
    seen = {}
    assert set(whole.asDict()) == set(want.run(spark, **{n: RELATIONS.frame(spark, sf_dir, n, seen) for n in relations_of(want.sql)}).columns)
    for c in ("modularity", "equality", "depth", "coupling_score", "quality_signal", "total_import_edges"):
        part = RELATIONS.frames(spark, sf_dir, f"select h.{c} from @health h")["health"]
        assert c in part.columns and part.first().asDict().items() <= whole.asDict().items()
