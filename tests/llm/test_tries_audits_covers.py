"""Conversation trie, filter audit and embedding near-duplicates against brute force, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from plumbline.llm import conversation_trie, cover_tree, filter_audit
from plumbline.llm.queries import op11_conversation_trie, op12_filter_audit, op13_embedding_duplicates


def brute_trie(sequences):
    """Rows of the trie of {conv_id: [(role, text), ..]}."""
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(sequences[c]) == len(k))
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()}


def ordered(rows):
    """{conv_id: turns} of (conv_id, turn, role, text), ties by the digest of role and text."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            out[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(s)] for c, s in out.items()}


def regrown(own):
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + s[h:]
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 260, 3), 300, 301, 302, 400, 5_000_000_007]:
        shared = c % 2
        for t in range(rng.choice([1, 2, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"common {t}" if shared else rng.choice(["", None, "yes", "Été \U0001f600", f"own {rng.random()}"])))
    for c in (900, 901, 902, 903):  # long ones, copies and a prefix
        rows += [(c, t, "user", f"line {t} " * 3) for t in range(700 if c < 903 else 350)]
    rows += [(910, None, "user", "first"), (910, 1, "user", "tie b"), (910, 1, "user", "tie a"), (910, 1, "user", "tie a"), (None, 1, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def as_set(df):
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def test_trie_equals_brute_force(spark, talks, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_BYTES", 16)
    monkeypatch.setattr("plumbline.llm._skew.LOAD", 2)
    df = spark.createDataFrame([(*r, "x") for r in talks], SCHEMA + ", depth string").repartition(5)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert as_set(op11_conversation_trie(spark, str(tmp_path))) == brute_trie(regrown(ordered(talks)))
    assert as_set(conversation_trie.prefix_trie(df)) == brute_trie(ordered(talks))


def test_trie_of_nested_conversations_needs_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "ROUNDS_AT_ONCE", 3)
    rows = [(c, t, "user", f"t{t}") for c in range(1, 10) for t in range(c)]
    assert as_set(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie(ordered(rows))


def test_trie_of_no_conversations_is_empty(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def brute_audit(docs, labels):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in range(2))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failed, out = [], Counter()
    for d, t, lang in docs:
        t = t or ""
        w = words.findall(t)
        bad = {f for f, x in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", d is not None and d > first[t])) if x}
        failed.append((lang or "", bad, d is not None and d in good, d is not None and d in toxic))
    rows = {}
    for part in {p for p, *_ in failed}:
        for order in permutations("ABCDE"):
            left = [x for x in failed if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + here
                out[part, f] += len(here)
                rows[part, "".join(order), step] = (f, len(left), len(here), redundant, sum(x[0] == part and x[1] == {f} for x in failed), sum(x[2] for x in here), sum(x[3] for x in here))
    return {(*k, *v[1:], out[k[0], v[0]]) for k, v in rows.items()}


def test_audit_equals_brute_force(spark, awkward, tmp_path):
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(210))
    texts = [base, base, base + " #", "A " * 300, base.upper(), "a b", None, "", base, f"{base} x", "a a b b " * 60]
    rows = [(100 + i, texts[i % len(texts)], rng.choice(["en", "de", None, ""])) for i in range(60)] + [(100, base, "fr"), (None, base, "en"), (None, None, None)]
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()] + rows
    labels = [(100 + i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(50)] + [(100, 1, 1), (None, 1, 1), (9999, 1, 1), (3, 1, 0)]
    extra = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part string")
    awkward.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string").write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_filter_audit(spark, str(tmp_path))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in got.select(columns).collect()]
    want = brute_audit(docs, labels)
    assert len(got) == len(set(got)) and set(got) == want


def test_audit_of_other_filters(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "abc"[: i % 4], "en") for i in range(12)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"X": F.length("text") < 2}, copies="Y").orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got] == [("XY", 1, 6, 6, 0, 2, 8), ("XY", 2, 2, 4, 4, 4, 12), ("YX", 1, 4, 8, 0, 4, 12), ("YX", 2, 2, 2, 4, 2, 8)]


def brute_links(rows, least=0.98):
    """{(vec_id, vector as text): (n_links, component)} of (vec_id, vector, label)."""
    ok = lambda i, v, lab: i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    usable = sorted({(i, lab, tuple(v)) for i, v, lab in rows if ok(i, v, lab)})
    unit = [np.array(v) / np.linalg.norm(v) for *_, v in usable]
    parent = {i: i for i, *_ in usable}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, (i, p, u) in enumerate(usable):
        for b in range(a):
            j, q, v = usable[b]
            if p == q and len(u) == len(v) and (u == v or unit[a] @ unit[b] >= least):
                if i != j or u != v:
                    links[a] += 1
                    links[b] += 1
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    out = {x: (links[a], root(x[0])) for a, x in enumerate(usable)}
    return [(i, *(out[i, lab, tuple(v)] if ok(i, v, lab) else (0, i))) for i, v, lab in rows]


def vectors(seed, dims=16, copies=60, singles=150):
    rng = np.random.default_rng(seed)
    rows, at = [], 0

    def add(v, label):
        nonlocal at
        rows.append((at, [float(x) for x in np.float32(v)], label))
        at += 1

    for label in ("a", "b", "a|16", None):
        for _ in range(singles):
            add(rng.normal(size=dims), label)
        for spread in (0.0, 0.02, 0.05, 0.12):
            centre = rng.normal(size=dims)
            centre /= np.linalg.norm(centre)
            for _ in range(copies):
                add((centre + rng.normal(size=dims) * spread / math.sqrt(dims)) * rng.choice([1.0, 2.0, 1e-3]), label)
    add([0.0] * dims, "a")
    add([1.0, 2.0, 3.0], "a")
    add([1.0, 2.0, 3.0001], "a")
    rows += [(at, None, "a"), (at + 1, [], "a"), (at + 2, [1.0, float("nan")], "a"), (at + 3, [1.0, float("inf")], "a"), (at + 4, [1.0, None], "a"), rows[3], rows[3], (None, rows[3][1], "a"), (7, rows[200][1], rows[200][2]), (7, None, "a")]
    return rows


@pytest.mark.parametrize("leaf_rows", [16_384, 40])
def test_embedding_duplicates_equal_brute_force(spark, tmp_path, monkeypatch, leaf_rows):
    for name, value in (("LEAF_ROWS", leaf_rows), ("SAMPLE_ROWS", 32), ("FAN_OUT", 6), ("STREAM_ROWS", 100), ("LEVELS", 3)):
        monkeypatch.setattr(cover_tree, name, value)
    rows = vectors(1)
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label string, key int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in op13_embedding_duplicates(spark, str(tmp_path)).collect())
    want = Counter(brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]))
    assert got == want


def test_whole_nodes_are_counted_without_their_members():
    rng = np.random.default_rng(2)
    v = np.concatenate([[1.0], np.zeros(15)]) + rng.normal(size=(500, 16)) * 0.002
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    joined = cover_tree.Joined(cover_tree.CoverTree(v), np.ones(500, np.int64), 0.98)
    joined._compare = None  # not called: the root's own pair is linked as a whole
    joined.traverse()
    assert (joined.links == 499).all() and (joined.roots == 0).all()
