import random

import pytest

#: Names that operators use for columns of their own, at some time or other.
INNER = "t k0 _k0 id bucket shard size source_size target position positions copy copies _hash _bucket _pii pii pseudonyms found kind _kept kept kept_id n c0 c1 _c0 r component component_id digest _m base_failed _host _h rejected host_rate _salt _length sequence_id offset piece start length ids ids_crc32 file_no file_row _metadata_ score spans h".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in INNER)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that operators use inside."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = [None, "", "   \n\t ", "one two", "One TWO", base, base + " tail", base.upper(), long, long, base, "Été naïve \U0001f600 x y", "a  b \n c", "<|endoftext|> x"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), *(f"x{i % 2}" for _ in INNER)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, *[None] * (3 + len(INNER))), (None, None, *[None] * (3 + len(INNER)))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def texts(awkward):
    return [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
