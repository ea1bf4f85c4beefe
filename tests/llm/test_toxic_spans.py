"""Offsets of toxic words in texts with letters that libraries class differently."""

import random

from plumbline.llm import toxicity


def test_spans_do_not_depend_on_other_letters(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    texts = [" ".join([*rng.choices(words, k=20), *(["grobnak"] if i % 2 else []), *rng.choices(words, k=20)]) for i in range(200)]
    tagger = toxicity.fit(texts, [i % 2 for i in range(200)])
    odd = ["", "՘ ", "İstanbul ", "ẞ ", "Ƛ ", "\U0001f600 ", "\U0002b73a "]
    rows = [(i, x + "worda wordb GROBNAK wordc " + x) for i, x in enumerate(odd)]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    for i, text in rows:
        spans = [tuple(s) for s in got[i]["spans"]]
        at = text.index("GROBNAK")
        assert got[i]["score"] >= 0.5 and (at, at + 7, "GROBNAK") in spans, ascii(text)
        assert all(text[a:b] == w for a, b, w in spans)
