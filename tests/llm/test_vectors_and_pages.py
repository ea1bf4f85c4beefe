"""Nearest neighbours and WARC against brute force."""

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import ann, warc
from plumbline.llm._scratch import scratch_path


def brute(rows, queries, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q in queries:
        best = {}
        for u in (u for i, u in ok if i == q):
            for i, v in ok:
                if i != q and len(v) == len(u):
                    best[i] = max(best.get(i, -np.inf), float((u * v).sum()))
        out[q] = [(i, s) for s, i in sorted((-s, i) for i, s in best.items())[:k]]
        out[q] = [(i, -s) for i, s in out[q]]
    return out


def test_exact_at_factor_one(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [rows[10], rows[10], rows[11], (20, rows[33][1]), (20, rows[33][1]), (41, rows[44][1]), (50, rows[50][1])]  # repeated rows, and ids with other vectors
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] * 8), (2005, [float("inf")] * 8), (None, rows[0][1]), (2010, [1.0, 2.0]), (2020, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 10 = 0 or vec_id = 1003"), k=5, factor=1.0, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, {*range(0, 3000, 10), 1003}, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert all(a[1] == pytest.approx(b[1], rel=1e-12) for q in got for a, b in zip(got[q], want[q], strict=True))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_components_near_the_ends_of_doubles(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * size).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), k=3, factor=1.0).orderBy("query_id", "rank").collect()
    want = brute([(i, [x / size for x in v]) for i, v in rows], {0, 20, 40}, 3)
    assert [r["vec_id"] for r in got] == [i for q in (0, 20, 40) for i, _ in want[q]]
    assert all(r["score"] == (np.inf if size > 1 else 0.0) for r in got if abs(r["score"]) in (np.inf, 0.0))


def test_one_vector_may_be_a_third_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist() if i % 3 else [1.0, 2.0, 0.5, 0.0, 1.0, 1.0]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), k=8, factor=1.0, shard_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in v] for q, v in brute(rows, set(range(0, 900, 50)), 8).items()}


def test_routing_over_4096_shards_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    v = rng.normal(size=(16_384, 16))
    router = ann.Router(v, float(np.linalg.norm(v, axis=1).max()), 4096)
    leaf, far = router.place(v)
    router.measured({x: np.column_stack([far[leaf == x].min(axis=0), far[leaf == x].max(axis=0)]) for x in np.unique(leaf).tolist()})
    q = v[:512]
    tracemalloc.start()
    home = router.home(q)
    found = {(leaf, int(r)) for leaf, rows in router.within(q, np.full(512, 0.5), 1.0) for r in rows}
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert set(home.tolist()) <= set(leaf.tolist())
    near = np.sqrt(np.maximum(((router.lifted(v)[:, None] - np.column_stack([q * (router.top / ann._norms(q))[:, None], np.zeros(512)])[None, :40]) ** 2).sum(axis=2), 0)) <= 0.5
    assert {(int(leaf[i]), int(j)) for i, j in np.argwhere(near)} <= found


def test_recall_at_production_factor(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = df.filter("vec_id % 20 = 0")
    assert ann.measured_recall(ann.nearest(df, q), ann.nearest(df, q, factor=1.0)) >= 0.9


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_warc_round_trip(spark, monkeypatch, broadcast):
    rng = random.Random(1)
    big = "".join(rng.choice("abc<>\r\n é") for _ in range(200_000))
    same = "x" * 1500
    rows = [(1, "http://a/1", None), (2, None, ""), (3, "http://a/3", "short"), (4, "u", "short"), (5, "u v\r\nX: y", same), (9, "u", same), (7, "u", same), (9, "u", same), (10, "u", big), (11, "u", big), (12, "u", big + "!"), (None, "u", same), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (20, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast)
    monkeypatch.setattr("plumbline.llm._skew.LOAD", 2)
    path = scratch_path(spark, "test-warc")
    warc.write_archives(warc.mark_revisits(df), path, segment_bytes=5000, archive_bytes=100_000)
    records = warc.read_records(spark, path)
    assert records.filter("record_type = 'revisit' and (refers_to_url is null or refers_to_url <> 'u')").count() == 0
    assert records.filter("record_type = 'continuation'").count() > 80
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in warc.reassemble(records).collect())
    last: dict = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            last[b] = max(p, last.get(b, p))
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = last.get(b) if last.get(b) != p else None
        want.append((str(p), len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", str(to)))
    assert got == sorted(want)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.reassemble(records).filter("page_id in (12, 20)").collect()}
    assert payloads == {12: (big + "!").encode(), 20: rows[-1][2].encode()}


def test_broken_archives_raise(spark):
    assert warc.unchunked(warc.chunked(b"x" * 10_000)) == b"x" * 10_000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    parts = list(warc.records_of(1, "u", b"y" * 9000, hashlib.sha1(b"y" * 9000).hexdigest(), None, None, "n", 3000))
    rows = [x for x in warc.parse(memoryview(b"".join(p + b"\r\n\r\n" for p in parts)))]
    assert len(rows) == 4 and rows[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in rows))
    with pytest.raises(ValueError):
        list(warc.parse(memoryview(b"".join(parts))))


def test_empty_archive(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc-empty")
    warc.write_archives(warc.mark_revisits(df), path)
    assert warc.reassemble(warc.read_records(spark, path)).count() == 0
