"""Levels by number, and components that a share of the edges finds first."""

import random

import pytest

from plumbline.operators import health, kernels as K
from plumbline.plans.sqlops import SqlOp
from plumbline.plans.views import RELATIONS


def _levels(edges):
    """(scc, level, top) of each node, by brute force."""
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
    scc = {n: min({n} | {m for m in of[n] if n in of[m]}) for n in nodes}
    level = dict.fromkeys(nodes, 0)
    for _ in nodes:
        for a, b in edges:
            up = level[a] if scc[a] == scc[b] else max(level[a], level[b] + 1)
            for n in nodes if up > level[a] else ():
                level[n] = up if scc[n] == scc[a] else level[n]
    return {(n, scc[n], level[n], all(b != n for _, b in edges)) for n in nodes}


def _graph():
    """Two dense components, the second hardly led to, under layers without cycles; a small cycle, a loop and a node with one edge."""
    rng = random.Random(7)
    dense = [(rng.randrange(16) + base, rng.randrange(16) + base) for base in (0, 100) for _ in range(120)]
    above = [(200 + i, 200 + rng.randrange(i)) for i in range(1, 12) for _ in range(3)] + [(200 + i, rng.choice((0, 100)) + rng.randrange(16)) for i in range(12) for _ in range(4)]
    return sorted({(a, b) for a, b in [*dense, *above] if a != b} | {(3, 105), (300, 301), (301, 300), (301, 302), (400, 400), (401, 5)})


def test_parts_of_a_share_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(K, "FEW_EDGES", 0)
    monkeypatch.setattr(K, "KEPT", 1)
    edges = _graph()
    df = K.materialize(spark.createDataFrame(edges, "src long, dst long"))
    assert K._contracted(df, None)
    assert {tuple(r) for r in K.levels(df).select("node", "scc", "level", "top").collect()} == _levels(edges)


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_edges_among_nodes(spark, monkeypatch, few):
    """Repeated edges, and edges of nodes that aren't there, on either way."""
    monkeypatch.setattr(K, "FEW_EDGES", few)
    monkeypatch.setattr(K, "KEPT", 1)
    edges = _graph()
    there = {n for e in edges for n in e if n % 7 and n != 400}
    known = spark.createDataFrame([(n,) for n in [*there, 999]], "node long")
    df = K.materialize(spark.createDataFrame(edges + edges[::3], "src long, dst long"))
    got = K.levels(df, K.materialize(known)).select("node", "scc", "level", "top").collect()
    assert len(got) == len({r["node"] for r in got}) and {tuple(r) for r in got} == _levels([(a, b) for a, b in edges if a in there and b in there])


def test_levels_of_two_files_of_one_number(spark):
    """Two parts of one key, and two lines of an order that lead back: by number they would be one file."""
    part = spark.createDataFrame([(1, "Brand#1", 3), (1, "Brand#2", 3), (2, "Brand#1", 3)], "p_partkey long, p_brand string, p_size int")
    lines = [(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2), (3, 9, 1), (3, 1, 2)]
    lineitem = spark.createDataFrame([(o, k, n, 0, 1.0, 0.0, 1.0) for o, k, n in lines], "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_discount double, l_quantity double")
    seen = {"part": part, "lineitem": lineitem}
    graph = RELATIONS.frame(spark, "", "import_graph", seen)
    assert dict(graph.dtypes)["src"] == "string"
    one, two, both = "src/brand1/f1.ts", "src/brand2/f1.ts", "src/brand1/f2.ts"
    assert {tuple(r) for r in graph.collect()} == {(one, both), (two, both), (both, one), (both, two)}
    single = part.filter("p_brand = 'Brand#1'")
    levels = RELATIONS.frame(spark, "", "levels", {"part": single, "lineitem": lineitem})
    want = SqlOp("levels", "select from_file as path from @dependency_edges union select to_file from @dependency_edges")
    assert {r["path"] for r in levels.collect()} == {r["path"] for r in want.run(dependency_edges=RELATIONS.frame(spark, "", "dependency_edges", {"part": single, "lineitem": lineitem})).collect()}


def test_levels_are_made_without_names(spark, sf_dir):
    assert dict(RELATIONS.frame(spark, sf_dir, "import_graph").dtypes) == {"src": "bigint", "dst": "bigint"}
    for column in ("depth", "quality_signal"):
        assert not RELATIONS.often(f"@{health.part_of_health(f'select h.{column} from @health h')}") & {"import_edges", "dependency_edges", "call_edges", "adjacency"}
