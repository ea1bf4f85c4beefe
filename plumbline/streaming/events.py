"""File-event streams: debounce, heat and incremental upserts, each with a batch twin.

Events are (path, ts, event_id, kind), ts in seconds. Stateful operators keep one small row a path, in
Spark's state store, so a lost executor resumes from the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.ranking import global_rank
from ..plans.scratch import ship
from .maintenance import under

MOST_HEAT = 5.0
LEAST_HEAT = 0.01
HALF_LIFE = 3600.0
DEBOUNCE = 300
EVENT_SCHEMA = "path string, ts long, event_id long, kind string"
#: Directories whose events are noise.
IGNORED = r"(^|/)(\.git|node_modules|target|dist|build|__pycache__)/"


def file_event_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the JSON events that appear in ``folder``, without ignored directories; a batch takes so many files, the rest waits."""
    events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return events.filter(F.col("path").isNotNull() & ~F.col("path").rlike(IGNORED))


def shed(events: DataFrame, most: int) -> DataFrame:
    """For a consumer that can't keep up: each path's last event, and of these the ``most`` newest; the rest is dropped, as the feature asks."""
    last = events.groupBy("path").agg(F.max_by(F.struct("ts", "event_id", "kind"), F.struct("ts", "event_id")).alias("e")).select("path", "e.*")
    return global_rank(last, [F.desc("ts"), F.desc("event_id"), F.asc("path")], "place").filter(F.col("place") <= most).drop("place")


def heat_after(heat: float, seconds: float, half_life: float = HALF_LIFE) -> float:
    """Heat after a change that follows the last one by ``seconds``."""
    return min(heat * math.exp(-math.log(2) * max(seconds, 0.0) / max(half_life, 0.001)) + 1.0, MOST_HEAT)


def heat(events: DataFrame, now: int, half_life: float = HALF_LIFE) -> DataFrame:
    """(path, heat, last_ts) at ``now``: the fold of each path's events in order, decayed; cold paths are evicted.

    Events without a path are left out. Rows are sorted by path and time within tasks and folded as they stream, so a hot path needs no
    list of its events in memory.
    """
    ship(events.sparkSession)
    ordered = events.filter("path is not null").select("path", F.col("ts").cast("long").alias("ts"), F.col("event_id").cast("long").alias("event_id")).repartition("path").sortWithinPartitions("path", "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, value, last = None, 0.0, 0
        for pdf in batches:
            done = []
            for p, ts in zip(pdf["path"], pdf["ts"], strict=True):
                if p != path:
                    if path is not None:
                        done.append((path, value, last))
                    path, value, last = p, 0.0, ts
                value, last = heat_after(value, ts - last, half_life), ts
            yield pd.DataFrame(done, columns=["path", "heat", "last_ts"])
        if path is not None:
            yield pd.DataFrame([(path, value, last)], columns=["path", "heat", "last_ts"])

    live = F.col("heat") * F.exp(-F.lit(math.log(2) / half_life) * F.greatest(F.lit(now) - F.col("last_ts"), F.lit(0)))
    return ordered.mapInPandas(fold, "path string, heat double, last_ts long").withColumn("heat", live).filter(F.col("heat") > LEAST_HEAT)


def hot_files(events: DataFrame, now: int, threshold: float = 0.5, half_life: float = HALF_LIFE) -> DataFrame:
    return heat(events, now, half_life).filter(F.col("heat") > threshold).select("path", F.round("heat", 6).alias("heat"))


TRAIL_SECONDS = 30
_HEAT_ROW = "path string, heat double, last_ts long, trail long, evicted boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _heat_processor(half_life: float, trail_seconds: int) -> StatefulProcessor:
    """Made here, with all that it uses, as the process that Spark asks for a stream's timers has no code of this package."""
    most, least, rate = MOST_HEAT, LEAST_HEAT, math.log(2) / max(half_life, 0.001)
    columns = ["path", "heat", "last_ts", "trail", "evicted"]

    class HeatProcessor(StatefulProcessor):
        """A path's heat and last change as a value, its recent changes as a list that the store lets expire, and a timer for when it is cold."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.value = handle.getValueState("heat", "heat double, last_ts long, event_id long")
            self.trail = handle.getListState("trail", "ts long", trail_seconds * 1000)

        def handleInputRows(self, key, rows, timerValues):
            heat, last, seen = self.value.get() if self.value.exists() else (0.0, None, None)
            for pdf in rows:
                pdf = pdf.sort_values(["ts", "event_id"])
                for ts, event in zip(pdf["ts"].tolist(), pdf["event_id"].tolist(), strict=True):
                    if (ts, event) == (last, seen):
                        continue  # told twice
                    gone = 0 if last is None else max(ts - last, 0)
                    heat, last, seen = min(heat * math.exp(-rate * gone) + 1.0, most), ts, event
                    self.trail.appendValue((ts,))
            self.value.update((heat, last, seen))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(math.log(heat / least) / rate * 1000))
            yield pd.DataFrame([(key[0], heat, last, sum(1 for _ in self.trail.get()), False)], columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            _, last, _ = self.value.get()
            self.value.clear()
            self.trail.clear()
            yield pd.DataFrame([(key[0], 0.0, last, 0, True)], columns=columns)

        def close(self) -> None:
            pass

    return HeatProcessor()


def heat_stream(events: DataFrame, half_life: float = HALF_LIFE, trail_seconds: int = TRAIL_SECONDS) -> DataFrame:
    """The stateful twin of ``heat``: each micro-batch gives the new heat of the paths it touched, how many changes their trail holds, and cold paths once more, as evicted, when their state goes.

    An event that repeats a path's last one, as a source may after a restart, is counted once.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return events.groupBy("path").transformWithStateInPandas(_heat_processor(half_life, trail_seconds), _HEAT_ROW, "update", "processingTime")


def debounce(events: DataFrame, gap: int = DEBOUNCE) -> DataFrame:
    """The last event of each burst: no event of its path follows within ``gap`` seconds."""
    from pyspark.sql import Window as W

    following = F.lead("ts").over(W.partitionBy("path").orderBy("ts", "event_id"))
    return events.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") - F.col("ts") >= gap)).drop("_next")


def debounce_stream(events: DataFrame, gap: int = DEBOUNCE) -> DataFrame:
    """The stateful twin: an event is emitted when one of its path follows after the gap, or the timer ends it."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["path", "ts", "event_id", "kind"]
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=columns)
            return
        held, out = (state.get if state.exists else None), []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"])[columns[1:]].itertuples(index=False):
            if held is not None and row.ts - held[0] >= gap:
                out.append((key[0], *held))
            held = tuple(row)
        state.update(held)
        state.setTimeoutDuration(gap * 1000)
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("path").applyInPandasWithState(update, EVENT_SCHEMA, "ts long, event_id long, kind string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def incremental_rescan(files: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """``files`` without deleted paths and what lies below them, and with ``changed`` rows in place of old ones."""
    gone = under(files, deleted).unionByName(changed.select("path")).distinct()
    return files.join(gone, "path", "left_anti").unionByName(changed)


POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, folder: str) -> int | None:
    """The generation that ``folder`` points to; None before the first."""
    jvm, path, fs = _files(spark, folder)
    pointer = jvm.org.apache.hadoop.fs.Path(path, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_generation(rows: DataFrame, generation: int, folder: str) -> bool:
    """Write ``rows`` as a generation below ``folder`` and then swap the pointer to it in one step; False if as new a one is there, as for a batch that is replayed."""
    spark = rows.sparkSession
    now = published(spark, folder)
    if now is not None and now >= generation:
        return False
    rows.write.mode("overwrite").parquet(f"{folder}/generation={generation}")
    jvm, path, fs = _files(spark, folder)
    fresh = jvm.org.apache.hadoop.fs.Path(path, f"_{POINTER}-{generation}")
    out = fs.create(fresh, True)
    out.write(str(generation).encode())
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(path, POINTER), rename)
    return True


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the generation that ``folder`` points to."""
    return spark.read.parquet(f"{folder}/generation={published(spark, folder)}")


def publish(stream: DataFrame, folder: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """Publish ``build(batch)`` of each micro-batch as a generation below ``folder``; readers see whole ones only, and a batch told twice changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, n: publish_generation(build(batch), n, folder) and None).option("checkpointLocation", checkpoint).start()
