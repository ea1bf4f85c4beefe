"""Token counts, token files and packing against the library itself."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from plumbline.llm import packing, token_counts, token_files  # noqa: E402
from plumbline.llm._scratch import scratch_path  # noqa: E402

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@lru_cache
def library(name):
    return Tokenizer.from_file(str(P.path(name)))


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", FILES)
def test_counts_equal_library(awkward, texts, name):
    got = token_counts.count_tokens(awkward, str(P.path(name)))
    want = Counter((d, len((t or "").encode()), len(library_ids(name, t))) for d, t, _ in texts)
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.count_tokens(awkward.limit(0), str(P.path(name))).count() == 0


def test_long_texts_are_split_at_safe_places(awkward, texts, monkeypatch):
    from plumbline.llm._tokens import safe_pieces

    for name in FILES:
        long = max((t for _, t, _ in texts if t), key=len)
        parts = safe_pieces(long.encode(), 1000, name.startswith("word"))
        assert len(parts) > 10 and b"".join(parts) == long.encode()
        assert sum(len(library_ids(name, p.decode())) for p in parts) == len(library_ids(name, long))


@pytest.mark.parametrize("name", FILES)
def test_files_round_trip(spark, awkward, texts, name):
    path = scratch_path(spark, "test-files")
    token_files.write_token_files(awkward, path, str(P.path(name)))
    rows = token_files.document_starts(token_files.read_token_files(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows if r["doc_id"] is not None] == sorted(d for d, _, _ in texts if d is not None)
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    want = Counter((d, crc([*library_ids(name, t), 0])) for d, t, _ in texts)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want


def test_empty_table_writes_nothing(spark, awkward):
    path = scratch_path(spark, "test-empty")
    token_files.write_token_files(awkward.limit(0), path, str(P.path(FILES[0])))
    assert token_files.document_starts(token_files.read_token_files(spark, path)).count() == 0


def test_segments_hold_any_range():
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 50_257, 2**32 - 1):
            ids = np.where(rng.random(n) < 0.05, rng.integers(0, top, n), rng.integers(0, min(top, 300), n)).astype(np.uint32)
            data = token_files.encode_segment([5, None], np.array([0, n]), ids, 3, 4)
            segment = token_files.Segment(memoryview(data))
            assert np.array_equal(segment.read(), ids) and segment.doc_ids == [5, None]
            assert np.array_equal(segment.read(n // 3, n // 2), ids[n // 3 : n // 2])
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.Segment(memoryview(broken))


def test_a_separator_within_a_segment_is_masked():
    inside = np.frombuffer(token_files.SEPARATOR.encode().ljust(24, b"x"), "<i8").tolist()  # document ids that spell the separator
    data = token_files.encode_segment(inside, np.array([1, 1, 1]), np.array([7, 8, 9], np.uint32))
    assert token_files.SEPARATOR.encode() not in data
    segment = token_files.Segment(memoryview(data))
    assert segment.doc_ids == inside and segment.read().tolist() == [7, 8, 9]


@pytest.mark.parametrize("name", FILES)
def test_memo_equals_library_when_it_forgets(monkeypatch, name):
    import random

    import pyarrow as pa

    from plumbline.llm import _tokens

    monkeypatch.setattr(_tokens, "MEMO_BYTES", 2000)
    monkeypatch.setattr(_tokens, "LEARN_AT_ONCE", 7)
    rng = random.Random(11)
    bits = ["the", "Wort", "été", "a.", "b,", "#x", "12", "<|endoftext|>", "\u00a0", "\n", "\t", "  ", "\U0001f600", "don't", "I\u0307", "\u0120", ".", ",", "x" * 50, "漢字"]
    enc = _tokens.MemoEncoder(str(P.path(name)))
    for _ in range(60):
        texts = [rng.choice(["", " "]) + "".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(30))) for _ in range(12)] + [None]
        counts, ids = enc.group(pa.array(texts))
        want = [library_ids(name, t) for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert enc.group(pa.array(texts), counting=True)[0].tolist() == counts.tolist()


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing(spark, awkward, texts):
    name, capacity = FILES[0], 64
    pieces = packing.cut_pieces(awkward, str(P.path(name)), capacity).withColumn("crc", F.crc32("ids")).drop("ids").cache()
    rows = packing.pack(pieces, capacity, order=("doc_id", "piece", "crc")).collect()
    want = Counter()
    for d, t, _ in texts:
        ids = [*library_ids(name, t), 0]
        want.update((d, k, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in rows) == want
    assert check_packing(rows, capacity) <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert packing.pack(pieces.limit(0), capacity, order=("doc_id",)).count() == 0


def test_plan_is_best_fit():
    assert packing.plan_best_fit({}, 10) == ([], 0)
    assert packing.plan_best_fit({6: 2, 4: 2}, 10)[1] == 2
    assert packing.plan_best_fit({7: 1, 5: 2, 3: 1}, 10)[1] == 2
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 65, int(rng.integers(1, 400)))
        rooms: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(64 - s)
        runs, made = packing.plan_best_fit(Counter(sizes.tolist()), 64)
        assert made == len(rooms)
        rows = [{"sequence_id": q + i // per, "offset": o + i % per * n, "length": n} for n, _, c, q, o, per in runs for i in range(c)]
        assert check_packing(rows, 64) == made
    with pytest.raises(ValueError):
        packing.plan_best_fit({11: 1}, 10)
