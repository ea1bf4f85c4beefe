"""Views kept up to date by signed changes, so that a rescan costs what changed.

A view is a table of keys with counts. A change of some files is first told as rows that come (+1) and go (-1); from
there every view is a sum: an edge exists while some statement supports it, and edges that begin or end to exist are in
turn the changes of degrees and module edges. A view is written in buckets of its keys, and only buckets with changes are
read and written again; the other files stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import module_of
from ..plans.scratch import materialize

BUCKETS = 64


def under(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """(path) of ``files`` that are deleted (path) or below a deleted directory: paths are looked up by their directories, so it is an equi-join."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_gone"))
    return above.join(deleted.select(F.col("path").alias("_gone")).distinct(), "_gone", "left_semi").select("path").distinct()


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts (keys, n) of ``new`` less those of ``old``; what both have alike cancels out."""
    keys = [c for c in old.columns if c != "n"]
    both = old.select(*keys, (-F.col("n")).alias("n")).unionByName(new)
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


@dataclass
class View:
    """Keys with counts at ``path``, in buckets of their ``by`` columns."""

    spark: SparkSession
    path: str
    by: tuple[str, ...]

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.by), F.lit(BUCKETS)).cast("int"))

    def create(self, rows: DataFrame) -> View:
        self._bucketed(rows).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def add(self, delta: DataFrame) -> DataFrame:
        """Add signed counts (keys, n); gives (keys, n): +1 for keys that begin and -1 for keys that end to exist."""
        keys = [c for c in delta.columns if c != "n"]
        delta = materialize(self._bucketed(delta.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")))
        touched = [r["bucket"] for r in delta.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        if not touched:
            return delta.drop("bucket").limit(0)
        old = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched))
        merged = old.withColumn("was", F.col("n")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        merged = materialize(merged.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("was").alias("was")))
        kept = merged.filter("n > 0").drop("was")
        gone = self.spark.createDataFrame([(b,) for b in touched], "bucket int").join(kept.select("bucket").distinct(), "bucket", "left_anti")
        kept.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(self.path)
        for r in gone.collect():  # buckets that are empty now
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={r['bucket']}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return merged.filter("(n > 0) <> (was > 0)").select(*keys, F.when(F.col("n") > 0, 1).otherwise(-1).cast("long").alias("n"))


class Maintained:
    """Imports, degrees, module edges and groups of equal bodies of a set of files, below ``root``; ``module`` tells a path's module."""

    def __init__(self, spark: SparkSession, root: str, module: Callable[[Column], Column] = module_of):
        self.module = module
        view = lambda name, *by: View(spark, f"{root}/{name}", by)
        self.files, self.statements, self.bodies = view("files", "path"), view("statements", "from_file"), view("bodies", "path")
        self.edges, self.degrees, self.module_edges, self.clones = view("edges", "from_file"), view("degrees", "path"), view("module_edges", "from_module"), view("clones", "bh")

    def _degrees(self, edges: DataFrame) -> DataFrame:
        return edges.select(F.col("from_file").alias("path"), F.lit("out").alias("side"), "n").unionByName(edges.select(F.col("to_file").alias("path"), F.lit("in").alias("side"), "n"))

    def _modules(self, edges: DataFrame) -> DataFrame:
        return edges.select(self.module(F.col("from_file")).alias("from_module"), self.module(F.col("to_file")).alias("to_module"), "n")

    def _clones(self, bodies: DataFrame) -> DataFrame:
        return bodies.filter("bh is not null and bh <> 0").select("bh", "n")

    def create(self, files: DataFrame, statements: DataFrame, bodies: DataFrame) -> Maintained:
        """``files`` (path), ``statements`` (from_file, to_file: an import, maybe several, maybe of a file that isn't there), ``bodies`` (path, name, bh)."""
        counted = lambda df: materialize(df.groupBy(*[c for c in df.columns if c != "n"]).agg(F.sum("n").alias("n") if "n" in df.columns else F.count("*").alias("n")))
        paths, stated, held = counted(files.select("path").distinct()), counted(statements.select("from_file", "to_file")), counted(bodies.select("path", "name", "bh"))
        edges = materialize(stated.join(paths.select(F.col("path").alias("to_file")), "to_file", "left_semi").select("from_file", "to_file", F.lit(1).cast("long").alias("n")))
        for view, rows in ((self.files, paths), (self.statements, stated), (self.bodies, held), (self.edges, edges), (self.degrees, self._degrees(edges)), (self.module_edges, self._modules(edges)), (self.clones, self._clones(held))):
            view.create(counted(rows))
        return self

    def rescan(self, changed: DataFrame, deleted: DataFrame, statements: DataFrame, bodies: DataFrame) -> DataFrame:
        """Take in ``changed`` files (path) with all their ``statements`` and ``bodies`` of now, and ``deleted`` paths or directories; a path that is both is there.

        Gives the metadata of a partial scan, one row: candidate_files, kept_files, partial, and whether any edge changed.
        """
        changed = materialize(changed.select("path").distinct())
        known = self.files.read().select("path")
        gone = under(known, deleted).join(changed, "path", "left_anti")
        touched = materialize(gone.unionByName(changed).distinct())
        was = lambda view, c: view.read().join(touched.withColumnRenamed("path", c), c, "left_semi")
        one = F.lit(1).cast("long").alias("n")
        at_files = materialize(difference(was(self.files, "path"), changed.select("path", one)))
        at_statements = materialize(difference(was(self.statements, "from_file"), statements.select("from_file", "to_file", one)))
        at_bodies = materialize(difference(was(self.bodies, "path"), bodies.select("path", "name", "bh", one)))
        self.files.add(at_files)
        self.bodies.add(at_bodies)
        self.clones.add(self._clones(at_bodies))
        told = self.statements.add(at_statements)
        # An edge needs a statement and its target: asked for are statements that began or ended, and those of targets that did.
        of_targets = self.statements.read().join(at_files.select(F.col("path").alias("to_file")), "to_file", "left_semi")
        asked = materialize(told.select("from_file", "to_file").unionByName(of_targets.select("from_file", "to_file")).distinct())
        both = ["from_file", "to_file"]
        now = self.statements.read().join(asked, both, "left_semi").join(self.files.read().select(F.col("path").alias("to_file")), "to_file", "left_semi")
        delta = materialize(difference(self.edges.read().join(asked, both, "left_semi").select(*both, one), now.select(*both, one)))
        self.edges.add(delta)
        self.degrees.add(self._degrees(delta))
        self.module_edges.add(self._modules(delta))
        counts = touched.agg(F.count("*").alias("candidate_files")).crossJoin(changed.agg(F.count("*").alias("kept_files")))  # two single rows
        return counts.crossJoin(delta.agg((F.count("*") > 0).alias("edges_changed"))).select("candidate_files", "kept_files", F.lit(True).alias("partial"), "edges_changed")
