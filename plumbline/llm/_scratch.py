"""Shared plumbing of the corpus operators: the shared scratch folder and code shipping.

Intermediate tables are cut from their lineage by writing Parquet into the folder that the
cluster names in ``spark.checkpoint.dir``, which the driver and all executors share. A lost
executor then costs only its running tasks: finished tables are re-read, never recomputed.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where ``spark.checkpoint.dir`` is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_scratch)
    _made.append((spark, path))
    return path


def drop_paths(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch() -> None:
    """Delete every scratch table of this process; called at exit, or by a job when its results are written."""
    while _made:
        spark, path = _made.pop()
        try:
            drop_paths(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


_PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    A ``small`` table, as one of a loop's rounds, is written in as few files as its size asks for, not in one for
    each core: file creation is what such a round costs most.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_PARALLEL)
    try:
        if small:
            spark.conf.set(_PARALLEL, False)
        df.write.parquet(path)
    finally:
        if small:
            spark.conf.set(_PARALLEL, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker. Spark's own default, 64 MB, is held several times over on either side.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when it ends, memory that its arrays have left goes back to the system, as workers outlive their tasks."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidied


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context, and have batches bounded by bytes."""
    sc = spark.sparkContext
    if int(spark.conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    if getattr(sc, "_plumbline_corpus_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="plumbline-code-")
    target = os.path.join(folder, "plumbline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(target)
    sc._plumbline_corpus_shipped = True
