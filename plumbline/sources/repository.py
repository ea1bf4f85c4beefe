"""Sources and sinks: working trees, git history, rules, baselines and session logs.

Listings come from git on the driver, as file contents and parsing are the large part; contents are
read by Spark's binaryFile source and parsed where they are read.
"""

from __future__ import annotations

import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

FILES = "path string, lines long, blanks long"
COMMITS = "commit_id string, author string, epoch long, parents int"
COMMIT_FILES = "commit_id string, pos int, path string, added int, removed int"
SESSION_EVENTS = "session_run_id string, event_index int, event_type string, gate string, decision string, action_count int, action_kinds array<string>, top_action_kind string"
BASELINE = "timestamp double, quality_signal double, coupling_score double, cycle_count long, god_file_count long, hotspot_count long, complex_fn_count long, max_depth int, total_import_edges long, cross_module_edges long"
MOST_FILES_A_COMMIT = 50


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """Tracked files, and untracked ones that aren't ignored."""
    names = sorted(set(filter(None, _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0"))))
    return spark.createDataFrame([(n,) for n in names], "path string")


def walked_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = (".git", "node_modules", "target", "dist", "build", "__pycache__")) -> DataFrame:
    """All files below ``root`` outside the ignored directories."""
    base = Path(root)
    names = sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file() and not set(p.relative_to(base).parts[:-1]) & set(ignored))
    return spark.createDataFrame([(n,) for n in names], "path string")


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below ``root`` whose names match; recursive, read by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = Path(root).resolve().as_posix()
    return rows.select(F.regexp_replace("path", f"^(file:)?/*{base.lstrip('/')}/", "").alias("path"), "content")


def git_status(spark: SparkSession, root: str) -> DataFrame:
    """(path, status) of the working tree; a rename gives its new path."""
    rows = []
    for line in _git(root, "status", "--porcelain").splitlines():
        rows.append((line[3:].rpartition(" -> ")[2].strip('"'), line[:2].strip()))
    return spark.createDataFrame(rows, "path string, status string")


def git_log(spark: SparkSession, root: str, since_epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """Commits and their files since a time, without merges and commits of more than 50 files."""
    commits, files = [], []
    for block in _git(root, "log", "--numstat", "--no-renames", *([f"--since=@{since_epoch}"] if since_epoch else []), "--format=%x00%H%x01%an%x01%at%x01%P").split("\0")[1:]:
        head, *lines = block.strip().splitlines()
        sha, author, at, parents = head.split("\x01")
        changed = [x.split("\t") for x in lines if x.count("\t") == 2]
        n_parents = len(parents.split())
        if n_parents > 1 or not 0 < len(changed) <= MOST_FILES_A_COMMIT:
            continue
        commits.append((sha, author, int(at), n_parents))
        files += [(sha, i, path, int(a) if a.isdigit() else 0, int(r) if r.isdigit() else 0) for i, (a, r, path) in enumerate(changed)]
    return spark.createDataFrame(commits, COMMITS), spark.createDataFrame(files, COMMIT_FILES)


def rules(path: str) -> dict:
    """A rules file: constraints, layers, boundaries and the other sections, missing ones empty."""
    data = tomllib.loads(Path(path).read_text())
    return {k: data.get(k, {} if k == "constraints" else []) for k in ("constraints", "layers", "boundaries", "concept", "contract", "state_model", "module_contract", "suppress")}


def rules_frames(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    r = rules(path)
    return {
        "layers": spark.createDataFrame([(i, x["name"], x["paths"], x.get("order", i)) for i, x in enumerate(r["layers"])], "idx int, name string, paths array<string>, ord int"),
        "boundaries": spark.createDataFrame([(x["from"], x["to"], x.get("reason", "")) for x in r["boundaries"]], "from_glob string, to_glob string, reason string"),
        "suppressions": spark.createDataFrame([(x["kind"], x.get("concept"), x.get("file"), x.get("reason", ""), x.get("expires")) for x in r["suppress"]], "kind string, concept string, file string, reason string, expires string"),
    }


def starter_rules(files: DataFrame) -> str:
    """A first rules file: one layer for each of the largest top directories."""
    tops = files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("d")).count().orderBy(F.desc("count"), "d").limit(5).collect()
    return "[constraints]\nmax_cycles = 0\n" + "".join(f'\n[[layers]]\nname = "{r["d"]}"\npaths = ["{r["d"]}/**"]\n' for r in tops)


def write_session_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_session_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSION_EVENTS).json(path)


def write_baseline(row: DataFrame, path: str) -> None:
    """One row; coalesced, so one file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE).json(path)
