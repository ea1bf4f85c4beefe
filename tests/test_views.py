"""The dependency relations over all orders, on lines whose orders no stride divides."""

from plumbline.plans.views import RELATIONS

PARTS = [(2, 10, "Brand#11"), (3, 10, "Brand#11"), (4, 20, "Brand#12")]


def edges(spark, folder, name):
    lines = [(order, part, 1, n, 1.0, 1.0, 0.0) for order, parts in ((1, (2, 3, 4)), (3, (3, 2)), (5, (4, 4)), (7, (4, 2, 3))) for n, part in enumerate(parts)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(PARTS, "p_partkey long, p_size int, p_brand string").write.parquet(f"{folder}/part.parquet")
    paths = {f"src/brand{b.removeprefix('Brand#')}/f{k}.ts": k for k, _, b in PARTS}
    return sorted((paths[a], paths[b]) for a, b in RELATIONS.frame(spark, str(folder), name).select("from_file", "to_file").collect())


def test_import_edges_come_from_every_order(spark, tmp_path):
    assert edges(spark, tmp_path, "import_edges") == [(2, 3), (3, 2), (3, 4), (4, 2)]


def test_call_edges_come_from_every_order(spark, tmp_path):
    assert edges(spark, tmp_path, "call_edges") == [(2, 4), (4, 3)]


def test_chain_edges_form_no_pairs_of_all_files(spark, tmp_path):
    spark.createDataFrame([(0, 3, "Brand#11"), (1, 2, "Brand#11"), (2, 9, "Brand#12"), (3, None, "Brand#12")], "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    chain = RELATIONS.frame(spark, str(tmp_path), "chain_edges")
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan or "ShuffledHashJoin" in plan  # between files; the count alone is sent whole
    number = lambda p: int(p.rpartition("f")[2].split(".")[0]) if p.endswith(".ts") and "/x" not in p else 0
    assert sorted((number(a), number(b)) for a, b in chain.collect()) == [(0, 3), (2, 3)] and plan.count("NestedLoop") == 1
