"""The registered opN_ queries and the pipeline's stages, called as they are, over awkward tables and empty ones."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from plumbline.llm import queries as registry  # noqa: E402

from .test_documents import WORD, base, brute_components, water_fill  # noqa: E402
from .test_tokens import check_packing, library_ids  # noqa: E402
from .test_vectors_and_pages import brute  # noqa: E402

TABLES = "documents embeddings pages labels conversations".split()


@pytest.fixture(scope="module")
def tables(spark, awkward, tmp_path_factory):
    """A folder with awkward tables, and one with the same tables without rows."""
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    frames = {
        "documents": awkward,
        "embeddings": spark.createDataFrame([(i, [float(i % 7), 1.0, -float(i % 3)], i) for i in range(61)] + [(20, [1.0, 1.0, 1.0], 0), (20, [1.0, 1.0, 1.0], 0), (30, None, None), (None, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, id int").selectExpr("*", "id % 3 as label", "'x' as cell"),
        "pages": spark.createDataFrame([(1, "u", "x" * 1200, 1), (2, "u", "x" * 1200, 2), (3, None, "x", 3), (4, "u", "x", None), (None, "u", None, 5)], "page_id long, url string, html string, digest int"),
        "labels": spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int"),
    }
    frames["conversations"] = spark.createDataFrame([(c, t, "user" if t else None, f"turn {t}" if t else None, "x") for c in (0, 1, 7, 100, 101, 250) for t in (None, 1, 2, 3, 3)] + [(None, 1, "user", "x", "y"), (5, 1, None, "", None)], "conv_id long, turn long, role string, text string, depth string")
    for name, df in frames.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


def test_empty_tables_give_empty_results(spark, tables):
    for name, query in registry.queries().items():
        assert query(spark, tables[1]).count() == 0, name


def test_op1(spark, tables):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in registry.op1_nearest_neighbours(spark, tables[0]).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(rows, {0, 20, 40, 60}, 20)
    assert all(len(got[q]) == 20 and len({i for i, _ in got[q]}) == 20 for q in want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 80


def test_op2(spark, tables, texts):
    got = registry.op2_toxicity(spark, tables[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in texts)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op3(spark, tables, texts):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in registry.op3_token_counts(spark, tables[0]).collect())
    assert got == Counter((d, len((t or "").encode()), n := len(library_ids("word_bpe_49k.json", t)), n > 2048) for d, t, _ in texts)


def test_op4(spark, tables, texts):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in registry.op4_quality_rules(spark, tables[0]).collect())
    assert got == Counter((d, *(m := base(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for d, t, _ in texts)


def test_op5(spark, tables, texts):
    got = registry.op5_source_mixing(spark, tables[0]).collect()
    words = [(d, s, len(WORD.findall(t or ""))) for d, t, s in texts]
    sizes = Counter()
    for _, s, n in words:
        sizes[s] += n
    target = water_fill(sizes, (1, 2, 3), 3)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n) for d, _, n in words)
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(target[s], 6)) for s in sizes}
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == len(r["positions"]) * r["size"] for r in got)
    largest = max(n for _, _, n in words)
    assert abs(sum(r["taken"] for r in got) - sum(target.values())) <= len(sizes) * largest / 2


def test_op6(spark, tables, texts):
    got = Counter((r["doc_id"], r["text"]) for r in registry.op6_pseudonyms(spark, tables[0]).collect())
    assert got == Counter((d, t) for d, t, _ in texts)  # none of these holds personal data


def test_op7(spark, tables, texts):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in registry.op7_near_duplicates(spark, tables[0]).filter("doc_id is not null").collect()}
    assert got == {(d, *x) for d, x in brute_components([(d, t) for d, t, _ in texts if d is not None]).items()}


def test_op8(spark, tables, texts):
    rows = registry.op8_best_fit_packing(spark, tables[0]).collect()
    want = Counter()
    for d, t, _ in texts:
        ids = [*library_ids("word_bpe_49k.json", t), 0]
        want.update((d, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_packing(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_op9(spark, tables, texts):
    at = 0
    rows = registry.op9_token_files(spark, tables[0]).orderBy("start").collect()
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [(d, [*library_ids("byte_bpe_50k.json", t), 0]) for d, t, _ in texts]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(str, map(tuple, df.select(names).collect()))) == Counter(map(str, got.fetchall()))


def test_stages_on_awkward_and_empty_tables(spark, tables, tmp_path):
    for folder in tables:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        counts = []
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            alone = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)  # each stage on the awkward rows themselves
            assert alone.columns == docs.columns or k == 4
            assert alone.count() > 0 or folder == tables[1], name
            out = stage(spark, docs, folder)
            path = str(tmp_path / f"{folder.rpartition('/')[2]}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            counts.append(docs.count())
        assert counts[0] >= counts[1] == counts[2] and (counts[4] == 0) == (folder == tables[1])
