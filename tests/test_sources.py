"""Sources on a small git repository, Python facts, and Column functions."""

import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths as P
from plumbline.functions import scalars as S
from plumbline.sources import python_facts, repository as R

SOURCE = '''
import os
from . import sibling


class Thing(Base):
    def method(self, a, b=1):
        for x in a:
            if x and b or os:
                helper(x)
        return b


def _small():
    pass
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "pkg").mkdir()
    (root / "pkg" / "thing.py").write_text(SOURCE)
    (root / "broken.py").write_text("def (")
    run("add", "."), run("commit", "-qm", "one")
    (root / "pkg" / "thing.py").write_text(SOURCE + "\n# more\n")
    run("commit", "-qam", "two")
    (root / "new.txt").write_text("x")
    return str(root)


def test_git_sources(spark, tree):
    assert sorted(r[0] for r in R.git_files(spark, tree).collect()) == ["broken.py", "new.txt", "pkg/thing.py"]
    assert sorted(r[0] for r in R.walked_files(spark, tree).collect()) == ["broken.py", "new.txt", "pkg/thing.py"]
    assert [tuple(r) for r in R.git_status(spark, tree).collect()] == [("new.txt", "??")]
    commits, files = R.git_log(spark, tree)
    assert commits.count() == 2 and files.filter("path = 'pkg/thing.py'").count() == 2
    assert files.filter("path = 'pkg/thing.py'").agg(F.sum("removed")).first()[0] == 0


def test_python_facts(spark, tree):
    c = R.contents(spark, tree, "*.py")
    assert {r["path"] for r in c.collect()} == {"broken.py", "pkg/thing.py"}
    rows = {r["name"]: r for r in python_facts.extract(c, "functions").collect()}
    m = rows["method"]
    assert (m["cc"], m["cog"], m["pc"], m["is_method"], m["calls"]) == (5, 5, 2, True, ["helper"])
    assert rows["_small"]["bh"] == "" and not rows["_small"]["is_public"]
    assert [tuple(r) for r in python_facts.extract(c, "classes").select("name", "bases").collect()] == [("Thing", ["Base"])]
    assert sorted(r["module"] for r in python_facts.extract(c, "imports").collect()) == [".", "os"]


def test_rules_and_baseline_round_trip(spark, tmp_path):
    path = tmp_path / "rules.toml"
    path.write_text('[constraints]\nmax_cycles = 0\n[[layers]]\nname = "ui"\npaths = ["ui/**"]\n[[boundaries]]\nfrom = "a/**"\nto = "b/**"\n')
    frames = R.rules_frames(spark, str(path))
    assert frames["layers"].first()["name"] == "ui" and frames["boundaries"].first()["reason"] == "" and frames["suppressions"].count() == 0
    row = spark.createDataFrame([(1.0, 0.5, 0.1, 2, 0, 0, 3, 4, 5, 6)], R.BASELINE)
    R.write_baseline(row, str(tmp_path / "base"))
    assert R.read_baseline(spark, str(tmp_path / "base")).collect() == row.collect()


def test_path_functions(spark):
    cases = {"src/layout/types.rs": "src/layout", "src/layout/algo/squarify.rs": "src/layout/algo", "a/b/c/d/e.rs": "a/b/c", "main.rs": "main", "src/app.rs": "src/app", "docs/x.md": "docs"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r[0]: r[1] for r in df.select("path", P.module_of(F.col("path"))).collect()} == cases
    globs = spark.createDataFrame([("src/ui/a.ts",), ("src/uix/a.ts",), ("src/ui/d/a.ts",)], "p string")
    hits = lambda g: [r[0] for r in globs.filter(P.glob_match(g, F.col("p"))).collect()]
    assert len(hits("src/ui/**")) == 2 + 1 and hits("src/ui/*") == ["src/ui/a.ts"] and len(hits("*.ts")) == 3 and hits("src/ui") == ["src/ui/a.ts", "src/ui/d/a.ts"]
    edges = spark.createDataFrame([("a/mod.rs", "a/x.rs"), ("a/mod.rs", "a/b/x.rs"), ("a/mod.rs", "a/b/c/x.rs"), ("a/x.rs", "a/y.rs")], "f string, t string")
    assert [r[0] for r in edges.select(P.is_module_declaration(F.col("f"), F.col("t"))).collect()] == [True, True, False, False]


def test_scalars(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (5, 2)], "a long, b long")
    assert [tuple(r) for r in df.select(S.ratio_0_10000(F.col("a"), F.col("b")), S.safe_ratio(F.col("a"), F.col("b"))).collect()] == [(3333, 0.333), (10000, None), (25000, 2.5)]
    assert [r[0] for r in spark.createDataFrame([(500,), (750,), (2000,)], "v long").select(S.ratio_pressure(F.col("v"), 500, 3600)).collect()] == [0, 1800, 3600]
