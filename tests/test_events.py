"""Stream operators against their batch twins and plain Python."""

import math
import time

from pyspark.sql import functions as F

from plumbline.streaming import events as E

ROWS = [("a", 0, 1, "m"), ("a", 100, 2, "m"), ("b", 50, 3, "m"), ("a", 1000, 4, "d"), ("b", 300, 5, "m"), ("c", 10, 6, "m")]


def brute_heat(rows, now, half_life):
    state = {}
    for path, ts, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        value, last = state.get(path, (0.0, ts))
        state[path] = (E.heat_after(value, ts - last, half_life), ts)
    live = {p: v * math.exp(-math.log(2) * (now - last) / half_life) for p, (v, last) in state.items()}
    return {p: round(v, 9) for p, v in live.items() if v > E.LEAST_HEAT}


def test_heat_folds_in_order_and_evicts(spark):
    df = spark.createDataFrame(ROWS, E.EVENT_SCHEMA)
    for now in (1000, 100_000):
        assert {r["path"]: round(r["heat"], 9) for r in E.heat(df, now, 3600.0).collect()} == brute_heat(ROWS, now, 3600.0)
    assert E.heat(df.limit(0), 0).count() == 0


def test_heat_stream_agrees_with_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(sorted(ROWS, key=lambda r: r[1])[2 * i : 2 * i + 2], E.EVENT_SCHEMA).coalesce(1).write.mode("append").json(str(source))
        time.sleep(1.1)
    stream = spark.readStream.schema(E.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    q = E.heat_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("update").format("memory").queryName("heat_out").start()
    until = time.monotonic() + 90
    while spark.table("heat_out").filter("not evicted").agg(F.max("last_ts")).first()[0] != 1000 and time.monotonic() < until:  # timers keep such a query busy
        time.sleep(0.5)
    q.stop()
    got = {r["path"]: r["h"] for r in spark.sql("select path, max_by(heat, last_ts) h from heat_out where not evicted group by path").collect()}
    want = {r["path"]: r["heat"] for r in E.heat(spark.createDataFrame(ROWS, E.EVENT_SCHEMA), 0).collect()}  # at 0 nothing has decayed
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_debounce_keeps_the_last_of_a_burst(spark):
    got = E.debounce(spark.createDataFrame(ROWS, E.EVENT_SCHEMA), 300)
    assert sorted(r["event_id"] for r in got.collect()) == [2, 4, 5, 6]


def test_incremental_rescan(spark):
    files = spark.createDataFrame([("a/x", 1), ("a/y", 2), ("b", 3), ("ab", 4)], "path string, lines long")
    changed = spark.createDataFrame([("b", 30), ("new", 5)], "path string, lines long")
    got = E.incremental_rescan(files, changed, spark.createDataFrame([("a",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("ab", 4), ("b", 30), ("new", 5)]


def test_shed_keeps_the_newest_of_the_last_events(spark):
    df = spark.createDataFrame(ROWS, E.EVENT_SCHEMA)
    assert sorted(map(tuple, E.shed(df, 2).collect())) == [("a", 1000, 4, "d"), ("b", 300, 5, "m")]
    assert E.shed(df, 9).count() == 3 and E.shed(df.limit(0), 5).count() == 0


def test_file_events_are_read_in_bounded_batches(spark, tmp_path):
    source, checkpoint = tmp_path / "events", tmp_path / "checkpoint"
    source.mkdir()
    for i, path in enumerate(["src/a.ts", "node_modules/x.js", "src/b.ts"]):
        (source / f"{i}.json").write_text(f'{{"path": "{path}", "ts": {i}, "event_id": {i}, "kind": "modified"}}\n')
    query = E.file_event_stream(spark, str(source), files_a_batch=1).writeStream.format("memory").queryName("seen_events").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["path"] for r in spark.table("seen_events").collect()) == ["src/a.ts", "src/b.ts"]
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3


def test_heat_goes_on_after_a_restart_and_events_told_twice_count_once(spark, tmp_path):
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    schema = E.EVENT_SCHEMA

    def told(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = E.heat_stream(spark.readStream.schema(schema).json(str(source)))
        out = []

        def keep(batch, _):
            out.extend(map(tuple, batch.collect()))

        q = stream.writeStream.option("checkpointLocation", str(checkpoint)).outputMode("update").foreachBatch(keep).start()
        until = time.monotonic() + 90
        while not any(r[0] == "a" and r[2] == rows[-1 if rows[-1][0] == "a" else 1][1] for r in out) and time.monotonic() < until:
            time.sleep(0.5)
        q.stop()
        return {r[0]: (round(r[1], 9), r[2], r[3], r[4]) for r in out}

    assert told("one", ROWS[:3])["a"][:3] == (round(E.heat_after(1.0, 100), 9), 100, 2)
    after = told("two", [ROWS[1], ROWS[3]])  # the store's state goes on, and the event that it ended with comes once more
    assert after["a"] == (round(E.heat_after(E.heat_after(1.0, 100), 900), 9), 1000, 3, False) and set(after) == {"a"}


def test_cold_paths_are_evicted(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 0, 1, "m")], E.EVENT_SCHEMA).coalesce(1).write.json(str(source))
    out = []
    stream = E.heat_stream(spark.readStream.schema(E.EVENT_SCHEMA).json(str(source)), half_life=0.2)
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("update").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).start()
    until = time.monotonic() + 60
    while not any(r[4] for r in out) and time.monotonic() < until:
        time.sleep(0.5)
    q.stop()
    assert [(r[0], r[4]) for r in out][:2] == [("a", False), ("a", True)]


def test_generations_are_swapped_whole_and_replayed_batches_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "published")
    row = lambda n: spark.createDataFrame([(n,)], "n long")
    assert E.published(spark, folder) is None
    assert E.publish_generation(row(1), 0, folder) and E.publish_generation(row(2), 1, folder)
    before = E.current(spark, folder)
    assert not E.publish_generation(row(99), 1, folder) and not E.publish_generation(row(98), 0, folder)
    assert E.publish_generation(row(3), 2, folder)
    assert [r["n"] for r in E.current(spark, folder).collect()] == [3] and [r["n"] for r in before.collect()] == [2]
