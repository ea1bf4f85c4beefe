"""Foundation files and test files in graph operators."""

from plumbline.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "from_file string, to_file string")


def modules(spark, paths, barrels=()):
    return spark.createDataFrame([(p, p.split("/")[0], p in barrels) for p in paths], "path string, module string, is_barrel boolean")


def score(spark, pairs, barrels=()):
    paths = {p for e in pairs for p in e}
    return graph.blast_concentration(edges(spark, pairs), modules(spark, paths, barrels)).first()[0]


def test_a_file_of_a_stable_module_is_left_out(spark):
    assert score(spark, [("a/1", "base/x"), ("b/1", "base/x"), ("c/1", "base/x"), ("c/2", "c/1")]) == 0.8


def test_a_file_with_five_dependants_is_left_out(spark):
    assert score(spark, [(f"a/{i}", "a/x") for i in range(5)] + [("a/x", "b/1")], barrels=("b/1",)) == 1.0
    assert score(spark, [(f"a/{i}", "a/x") for i in range(4)]) == 0.2


def test_a_barrel_is_left_out(spark):
    pairs = [("a/1", "a/index"), ("a/2", "a/index"), ("a/3", "a/2")]
    assert score(spark, pairs) == 0.25 and score(spark, pairs, barrels=("a/index",)) == 0.75


def test_components_need_a_file_that_is_no_test(spark):
    files = spark.createDataFrame([("a", False), ("b", False), ("t", True), ("u", True), ("v", True), ("alone", False), ("w", True)], "path string, is_test boolean")
    got = graph.weak_components(edges(spark, [("t", "a"), ("t", "b"), ("u", "v")]), files).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("alone", "alone"), ("b", "a"), ("t", "a")]
