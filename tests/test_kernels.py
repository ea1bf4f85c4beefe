"""Graph kernels on hand-made graphs."""

import functools
import random

import pytest

from plumbline.operators import graph as G
from plumbline.operators import kernels as K

CASES = {
    "empty": [],
    "single": [("a", "b")],
    "self_loop": [("a", "a"), ("a", "b")],
    "two_cycle": [("a", "b"), ("b", "a")],
    "tail": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "apart": [("a", "b"), ("c", "d")],
    "two_in_row": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("f", "a"), ("e", "e")],
    "repeated": [("a", "b"), ("a", "b")],
}


def brute_reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = set()
    for a in after:
        todo, seen = list(after[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after.get(b, ())
        reach |= {(a, b) for b in seen}
    return reach


def drawn(seed, nodes, edges, forward=False):
    """A random graph; ``forward``: without cycles."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    return [(f"n{a:03}", f"n{b:03}") for a, b in pairs if not forward or a < b]


CASES |= {
    "long_way": [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)],
    "long_cycle": [(f"n{i:03}", f"n{(i + 1) % 33:03}") for i in range(33)] + [(f"t{i}", f"t{i + 1}") for i in range(9)] + [("t9", "n004"), ("s", "t3")],
    "cycle_through_ways": [("u", "a"), ("a", "b"), ("b", "u"), ("u", "c"), ("c", "d"), ("d", "v"), ("v", "u"), ("v", "e"), ("x", "b"), ("y", "x")],
    "sparse": drawn(1, 30, 30), "dense": drawn(2, 12, 40), "medium": drawn(3, 40, 60), "dag": drawn(4, 30, 90, True), "many_ways": drawn(5, 60, 66),
}


#: All graphs side by side as one, as each run of a kernel costs seconds of small jobs.
ALL = [(f"{name}/{a}", f"{name}/{b}") for name, edges in CASES.items() for a, b in edges]


@pytest.fixture(params=["empty", "all"])
def case(request, spark, monkeypatch):
    monkeypatch.setattr(K, "WORDS", 2)
    edges = ALL if request.param == "all" else []
    return edges, spark.createDataFrame(edges, "from_file string, to_file string")


def test_reach_and_scc(case):
    edges, df = case
    reach = brute_reach(edges)
    e = K.edges_of(df)
    nodes = {x for pair in edges for x in pair}
    want = {n: min([n, *(m for m in nodes if (n, m) in reach and (m, n) in reach)]) for n in nodes}
    assert {r["node"]: r["scc"] for r in K.scc(e).collect()} == want
    assert {r["node"]: r["n"] for r in K.reach_counts(e).collect()} == {n: len({a for a, b in reach if b == n and a != n}) for n in nodes}
    begin = {"a", "c", *sorted(nodes)[::7]}
    depths, front, at = {}, begin, 0
    while front:
        depths.update(dict.fromkeys(front, at))
        front, at = {b for a, b in edges if a in front} - set(depths), at + 1
    seeds = spark_of(df).createDataFrame([*((n,) for n in sorted(begin)), (None,)], "node string")
    assert {r["node"]: r["depth"] for r in K.bfs(e, seeds).collect()} == depths


def spark_of(df):
    return df.sparkSession


def test_levels_and_components(case):
    edges, df = case
    reach = brute_reach(edges)
    nodes = {x for pair in edges for x in pair}
    both = lambda a, b: a == b or ((a, b) in reach and (b, a) in reach)

    @functools.cache
    def level(n):
        return max([level(b) + 1 for a, b in edges if both(a, n) and not both(b, n)], default=0)

    assert {r["node"]: r["level"] for r in K.levels(K.edges_of(df)).collect()} == {n: level(n) for n in nodes}
    linked = brute_reach([*edges, *((b, a) for a, b in edges)])
    want = {n: min([n, *(m for m in nodes if (n, m) in linked)]) for n in nodes if any(n in p and p[0] != p[1] for p in edges)}
    assert {r["node"]: r["component"] for r in K.connected(K.edges_of(df)).collect()} == want


def test_stable_modules_grow_in_rounds(spark):
    pairs = [("a", "core"), ("b", "core"), ("c", "mid"), ("d", "mid"), ("mid", "core")]
    df = spark.createDataFrame(pairs, "from_module string, to_module string")
    assert {r["module"] for r in K.stable_modules(df).collect()} == {"core", "mid"}


def test_whatif_break_cycle_improves(spark):
    df = spark.createDataFrame(CASES["tail"], "from_file string, to_file string")
    row = G.whatif_simulate(df, [("break_cycle",)]).first()
    assert (row["cycles_before"], row["cycles_after"]) == (1, 0)
