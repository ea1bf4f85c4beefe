"""Views after rescans equal views built anew."""

import random

from pyspark.sql import functions as F

from plumbline.streaming import maintenance as M


def frames(spark, state):
    files = spark.createDataFrame([(p,) for p in state], "path string")
    statements = spark.createDataFrame([(p, t) for p, (targets, _) in state.items() for t in targets], "from_file string, to_file string")
    bodies = spark.createDataFrame([(p, f"f{i}", b) for p, (_, found) in state.items() for i, b in enumerate(found)], "path string, name string, bh long")
    return files, statements, bodies


def seen(views):
    return {name: {tuple(r) for r in getattr(views, name).read().select(*sorted(getattr(views, name).read().columns)).collect()} for name in ("edges", "degrees", "module_edges", "clones")}


def test_rescans_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BUCKETS", 3)
    rng = random.Random(9)
    paths = [f"src/m{i % 4}/d{i % 3}/f{i}.ts" for i in range(30)]
    file = lambda: ([rng.choice(paths) for _ in range(rng.randint(0, 4))], [rng.choice([None, 0, 1, 2, 3]) for _ in range(rng.randint(0, 3))])
    state = {p: file() for p in paths[:20]}
    views = M.Maintained(spark, f"{tmp_path}/kept").create(*frames(spark, state))
    for turn, gone in enumerate((["src/m1", paths[2]], [paths[25], "src/m0/d0"])):
        for p in list(state):
            if any(p == g or p.startswith(g + "/") for g in gone):
                del state[p]
        changed = {p: file() for p in rng.sample(paths, 6)}
        state |= changed
        meta = views.rescan(spark.createDataFrame([(p,) for p in changed], "path string"), spark.createDataFrame([(g,) for g in gone], "path string"), *frames(spark, changed)[1:]).first()
        assert meta["partial"] and meta["kept_files"] == 6 and meta["candidate_files"] >= 6
        assert seen(views) == seen(M.Maintained(spark, f"{tmp_path}/anew{turn}").create(*frames(spark, state)))
    assert not views.rescan(spark.createDataFrame([], "path string"), spark.createDataFrame([], "path string"), *[f.limit(0) for f in frames(spark, state)[1:]]).first()["edges_changed"]


def test_only_touched_buckets_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BUCKETS", 12)
    view = M.View(spark, f"{tmp_path}/view", ("k",)).create(spark.range(500).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
    before = {f: (tmp_path / "view").joinpath(f).stat().st_mtime_ns for f in [str(p.relative_to(tmp_path / "view")) for p in (tmp_path / "view").rglob("*.parquet")]}
    told = view.add(spark.createDataFrame([(3, -1), (7, 1), (1000, 2)], "k long, n long")).collect()
    assert sorted(map(tuple, told)) == [(3, -1), (1000, 1)]
    after = {str(p.relative_to(tmp_path / "view")) for p in (tmp_path / "view").rglob("*.parquet")}
    assert len(set(before) & after) >= M.BUCKETS - 4
    assert view.read().filter("k in (3, 7, 1000)").count() == 2 and view.read().agg(F.sum("n")).first()[0] == 502
