"""Corpus pipeline: quality rules, near-dedup, pseudonyms, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import _scratch, minhash, mixing, packing, pii, quality
from plumbline.llm._scratch import drop_paths, materialize, scratch_path
from plumbline.llm.queries import PII_KEY, tokenizer

#: Scratch tables of the stage before. Its result is written by the time the next stage begins, so they can go then.
_before: list[str] = []


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Free the scratch tables of the stage before, unless ``docs`` still reads one of them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [p.rpartition("/")[2] for p in _before]
        if _before and not any(n in f for f in docs.inputFiles() for n in names):
            drop_paths(spark, *_before)
            _before.clear()
        made = len(_scratch._made)
        out = stage(spark, docs, sf_dir)
        _before.extend(path for _, path in _scratch._made[made:])
        return out

    return run_stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected.

    A null or empty text has no words and goes; long texts are measured whole; a null source is a host of its
    own; repeated rows are judged one by one; an empty table stays empty.
    """
    return quality.filter_documents(docs)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Repeated rows leave one; rows of one doc_id with other texts are other documents. Null or empty texts
    and rows without doc_id are linked with nothing and stay. An empty table stays empty.
    """
    return minhash.drop_duplicates(docs)


@staged
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts and n_chars of the new text.

    A null text stays null, as its n_chars; all rows stay, repeated ones equal; an empty table stays empty.
    """
    done = pii.pseudonymize(docs, PII_KEY, found=None)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time they are taken, in files and rows by training position.

    Documents without words and those beyond their source's target are left out. Nulls: a null text has no
    words, a null source is a source. Repeated rows are taken one by one; an empty table stays empty.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()])
    planned = mixing.plan_mixture(renamed, inner["text"], inner["source"], keep=list(inner.values()), order=[inner["doc_id"]])
    return mixing.lay_out(planned).select(*[F.col(c).alias(name) for name, c in inner.items()])


@staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with their ids.

    Pieces of one length take their slots in the order of files and rows, which is that of training
    positions. A null or empty text is one piece, its end id; long texts are cut, repeated rows packed one by one,
    and an empty table stays empty.
    """
    try:
        placed = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("int").alias("file_no"), F.col("_metadata.row_index").alias("file_row"))
        placed.schema  # noqa: B018  resolved here
    except AnalysisException:  # rows that don't come from Parquet files have no order to keep
        placed = docs.select("doc_id", "text", F.lit(None).cast("int").alias("file_no"), F.lit(None).cast("long").alias("file_row"))
    pieces = packing.cut_pieces(placed, tokenizer("word_bpe_49k.json"), keep=("doc_id", "file_no", "file_row"))
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")), "pack-pieces")
    order = ("file_row", "doc_id", "piece", "ids_crc32")
    return packing.pack(pieces, order=order, bucket=F.coalesce("file_no", F.pmod(F.xxhash64(*order[1:]), F.lit(1024)))).drop("file_no", "file_row")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII pseudonyms", pseudonyms),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokenization, hashed orders and keyed pseudonyms aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
