"""The pipeline, stage by stage, against what each stage promises."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_documents import base, brute_components  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    raw, good, single, private, mixed, packed = seen
    passing = {r["doc_id"] for r in raw if (m := base(r["text"]))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert {r["doc_id"] for r in good} == passing and Counter(good) <= Counter(raw)
    kept = {d for d, (_, _, k) in brute_components([(r["doc_id"], r["text"]) for r in good]).items() if k}
    assert Counter(r["doc_id"] for r in single) == Counter(kept)
    assert {r["doc_id"] for r in private} == kept and any(a["text"] != b["text"] for a, b in zip(sorted(single), sorted(private), strict=True))
    assert Counter(mixed) <= Counter({r: 3 for r in private})
    rows = defaultdict(list)
    for r in packed:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rows.values():
        assert sum(n for _, n in parts) <= 2048 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
