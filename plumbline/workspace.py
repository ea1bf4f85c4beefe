"""A repository as the engine's relations: one scan gives files, facts, dependencies and history, and any operator runs over them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import paths as P
from .operators import resolution
from .plans.scratch import materialize, ship
from .plans.sqlops import SqlOp, relations_of
from .plans.views import RELATIONS
from .sources import python_facts, repository, text_facts

#: Languages by extension; a plugin manifest may add more.
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "sh": "shell", "toml": "toml", "yaml": "yaml", "yml": "yaml"}
LIMITS = {"min_quality": "double", "min_modularity": "double", "min_acyclicity": "double", "min_depth": "double", "min_equality": "double", "min_redundancy": "double", "max_coupling_score": "double", "max_cycles": "bigint", "max_cc": "bigint", "max_file_lines": "bigint", "max_fn_lines": "bigint", "no_god_files": "boolean", "max_upward_violations": "bigint"}


class Workspace:
    """Relations by name, computed ones on demand and once; ``run`` binds an operator to them."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], sf_dir: str = "", root: str = ""):
        self.spark, self.sf_dir, self.root, self.seen = spark, sf_dir, root, dict(frames)

    def relation(self, name: str) -> DataFrame:
        return RELATIONS.frame(self.spark, self.sf_dir, name, self.seen)

    def run(self, op: SqlOp) -> DataFrame:
        return op.run(self.spark, **{n: self.relation(n) for n in relations_of(op.sql)})

    def call(self, f: Callable[..., DataFrame], *names: str) -> DataFrame:
        return f(*(self.relation(n) for n in names))


def language(path: Column) -> Column:
    out = F.lit("unknown")
    for ext, name in LANGUAGES.items():
        out = F.when(path.endswith(f".{ext}"), name).otherwise(out)
    return out


def rule_frames(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """The rule relations of a rules file; without one there are no limits, layers, boundaries or contracts."""
    r = repository.rules(path) if path and Path(path).exists() else {k: {} if k == "constraints" else [] for k in ("constraints", "layers", "boundaries", "module_contract", "suppress")}
    c = r["constraints"]
    limits = tuple(c.get(k, False if k == "no_god_files" else None) for k in LIMITS)
    limits = tuple(float(v) if v is not None and LIMITS[k] == "double" else v for k, v in zip(LIMITS, limits, strict=True))
    contracts = [(x["id"], x["root"], bool(x.get("forbid_cross_module_deep_imports", False))) for x in r["module_contract"]]
    return {
        "constraints": spark.createDataFrame([limits], ", ".join(f"{k} {t}" for k, t in LIMITS.items())),
        "layers": spark.createDataFrame([(x["name"], p, x.get("order", i), n) for i, x in enumerate(r["layers"]) for n, p in enumerate(x["paths"])], "layer string, pattern string, ord int, nth int"),
        "boundaries": spark.createDataFrame([(x["from"], x["to"], x.get("reason", "")) for x in r["boundaries"]], "from_glob string, to_glob string, reason string"),
        "module_contracts": spark.createDataFrame(contracts, "id string, root string, forbid boolean"),
        "contract_api": spark.createDataFrame([(x["id"], f) for x in r["module_contract"] for f in (*x.get("public_api", []), *x.get("nested_public_api", []))], "id string, file_name string"),
    }


def scan(spark: SparkSession, root: str, rules: str | None = None) -> Workspace:
    """The relations of the working tree at ``root``: listing by git, or by a walk where there is no repository.

    Contents are read and parsed by Spark; functions, classes, imports and calls come from Python sources.
    """
    ship(spark)
    in_git = (Path(root) / ".git").exists()
    listed = repository.git_files(spark, root) if in_git else repository.walked_files(spark, root)
    contents = repository.contents(spark, root).join(listed, "path", "left_semi").withColumn("lang", language(F.col("path")))
    contents = materialize(contents)
    path = F.col("path")
    files = text_facts.text_measures(contents).select("path", P.module_of(path).alias("module"), P.is_test_file(path).alias("is_test"), P.is_package_index(path).alias("is_barrel"), "lang", F.lit(False).alias("is_dir"), "lines", "comments", "blanks", "logic", F.xxhash64("path").alias("k"))
    files = materialize(files)
    sources = contents.filter("lang = 'python'")
    facts = materialize(python_facts.extract(sources, "functions"))
    refs = text_facts.same_file_refs(facts, text_facts.strip_literals(sources))
    of = files.select("path", "module", "is_test", "lang")
    functions = facts.join(refs, ["path", "name"], "left").join(of, "path").select(
        "path", "module", "is_test", "lang", "name", F.col("sl").cast("long").alias("sl"), F.col("el").cast("long").alias("el"), F.col("ln").cast("long").alias("ln"), F.col("cc").cast("long").alias("cc"), F.col("cog").cast("long").alias("cog"), F.col("pc").cast("long").alias("pc"),
        F.when(F.col("bh") == "", 0).otherwise(F.xxhash64("bh")).alias("bh"), "is_public", "is_method", F.coalesce("same_file_ref_count", F.lit(0)).cast("long").alias("same_file_ref_count"),
    )
    functions = materialize(functions)
    calls = facts.select("path", F.col("name").alias("func"), F.explode("calls").alias("callee"), F.col("sl").cast("long").alias("line"))
    specifiers = python_facts.extract(sources, "imports").select(F.col("path").alias("file"), text_facts.normalize_module(F.col("module"), True).alias("spec"))
    imports = materialize(resolution.resolve(specifiers, files).filter("target is not null").select(F.col("file").alias("from_file"), F.col("target").alias("to_file")).distinct())
    frames = {
        "files": files, "module_paths": files.select("path", "module", "is_test", "is_barrel", F.col("lines").alias("size")), "functions": functions, "calls": materialize(calls), "import_edges": imports,
        "entry_points": text_facts.entry_points(contents), "known_files": files.filter("not is_test").select("path"), "specifiers": specifiers,
        "contents": contents.select("path", F.decode("content", "UTF-8").alias("contents")),
        **rule_frames(spark, rules or str(Path(root) / "plumbline.toml")),
    }
    if in_git:
        frames["commits"], frames["commit_files"] = repository.git_log(spark, root)
    workspace = Workspace(spark, frames, root=root)
    from .operators.degrees import OPS

    workspace.seen["call_edges"] = materialize(workspace.run(OPS["call_edge_join"]).select("from_file", "to_file").distinct())
    return workspace
