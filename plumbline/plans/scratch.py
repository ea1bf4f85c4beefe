"""Cutting lineage in iterative plans: tables written to the folder that ``spark.checkpoint.dir`` names.

A query's tables are freed when the process ends; a loop frees the rounds that nothing reads any more.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where ``spark.checkpoint.dir`` is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of input that a shuffle begins a partition for; rows grow when they're read, joined and given their paths.
INPUT_A_PARTITION = 4 << 20
#: The most bytes of a shuffle that small partitions are joined to, and of a table that is sent to the driver and all executors: loops send one a round.
JOINED, BROADCAST = 16 << 20, 1 << 20
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_MOST = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": JOINED, "spark.sql.autoBroadcastJoinThreshold": BROADCAST}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _bytes(value: str) -> int:
    number = value.rstrip("bBkKmMgG")
    return int(number) * _UNITS[value[len(number) :].lower()]


def spread(spark: SparkSession, paths: list[str]) -> None:
    """Set the partitions that shuffles begin with by the size of the input, and limits to what is joined or broadcast, so that neither a task's share nor the driver's grows with it."""
    sc, size = spark.sparkContext, 0
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(sc._jsc.hadoopConfiguration())
        size += files.getContentSummary(p).getLength() if files.exists(p) else 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_A_PARTITION))
    for key, most in _MOST.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, most)
    spark.conf.set(_PARTITIONS, max(wanted, int(spark.conf.get(_PARTITIONS, None) or 0)))


_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def materialize(df: DataFrame, small: bool = False) -> DataFrame:
    """Write ``df`` once and read it back; survives lost executors, unlike cached blocks.

    A ``small`` table, as one of a loop's rounds, is written in as few files as its size asks for, not in one a core.
    """
    path = f"{scratch_root(df.sparkSession)}/plumbline/step-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(free)
    _made[path] = df.sparkSession
    conf = df.sparkSession.conf
    before = conf.get(_PARALLEL)
    try:
        if small:
            conf.set(_PARALLEL, False)
        df.write.parquet(path)
    finally:
        if small:
            conf.set(_PARALLEL, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._plumbline_written = True
    return table


def once(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a table that was written, else written."""
    return df if getattr(df, "_plumbline_written", False) else materialize(df)


def free(*tables: DataFrame) -> None:
    """Delete the written tables behind these DataFrames; all that are left if none is given."""
    names = {f.split("/plumbline/")[1].split("/")[0] for t in tables for f in t.inputFiles() if "/plumbline/step-" in f}
    for path in [p for p in _made if not tables or p.rpartition("/")[2] in names]:
        spark = _made.pop(path)
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_engine_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="plumbline-code-"), "plumbline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(target)
    sc._plumbline_engine_shipped = True
