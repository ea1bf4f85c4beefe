"""Pseudonyms in very long texts: domains of many labels, and tables of numbers."""

import random
import re
import subprocess
import sys
import time

import pytest

from plumbline.llm import pii

FRESH = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from plumbline.llm import pii
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
texts = ["x@a" + ".a" * int(sys.argv[2]), "1 " * 50_000 + "x@a" + ".a" * 2000]
got = pii.pseudonymize(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "key").orderBy("doc_id").collect()
assert [len(r["text"]) for r in got] == [len(t) for t in texts]
print("all is well")
"""


@pytest.mark.parametrize("labels", [2_000, 500_000])
def test_a_long_domain_in_the_first_query_of_a_jvm(labels):
    from .. import conftest

    done = subprocess.run([sys.executable, "-c", FRESH, conftest.ROOT, str(labels)], capture_output=True, text=True, timeout=300)
    assert "all is well" in done.stdout, done.stderr[-3000:]


def changed(spark, texts):
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()
    digits = lambda t: re.sub(r"\D", "", t)
    return [(r["text"], sum(a != b for a, b in zip(digits(t), digits(r["text"]), strict=True)) / max(1, len(digits(t)))) for t, r in zip(texts, rows, strict=True)]


def test_tables_of_numbers_stay(spark):
    rng = random.Random(11)
    tables = [" ".join(str(rng.randrange(most)) for _ in range(100_000)) for most in (97, 3_000, 10_000)]
    tables += ["\n".join(" ".join(str(rng.randrange(most)) for _ in range(12)) for _ in range(5_000)) for most in (5_000,)]
    begun = time.monotonic()
    for _, share in changed(spark, tables):
        assert share < 0.01
    assert time.monotonic() - begun < 40 * len(tables)


def test_cards_in_tables_are_found(spark):
    rng = random.Random(12)
    cards = ["4111111111111111", "5500 0000 0000 0004", "3400-000000-00009", "3782 822463 10005"]
    texts = []
    for card in cards:
        cells = [str(rng.randrange(97)) for _ in range(20_000)]
        cells[10_000] = card
        texts.append(" ".join(cells))
    two = "4111 1111 1111 1111 5500 0000 0000 0004"
    got = changed(spark, [*texts, two])
    for card, (out, share) in zip([*cards, two], got, strict=True):
        assert card not in out and share > 0
    assert "5500 0000" not in got[-1][0]  # both cards of a row
