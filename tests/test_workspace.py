"""A scan of a small repository, the tools over it and the command line, with values worked out by hand."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline import __main__ as cli
from plumbline import tools
from plumbline.sources import text_facts as T
from plumbline.workspace import scan

FILES = {
    "app/main.py": "from app import core\nfrom app.util import helper\n\n\ndef main():\n    core.run(1)\n    helper()\n\n\nif __name__ == '__main__':\n    main()\n",
    "app/core.py": "# comment\nfrom .util import helper\n\n\ndef run(x):\n    if x and x > 1:\n        for y in range(x):\n            helper()\n    return 'not # a comment'\n",
    "app/util.py": "from . import core\n\n\ndef helper():\n    return core\n\n\ndef _unused(a, b):\n    return a + b\n",
    "tests/test_core.py": "from app import core\n\n\ndef test_run():\n    core.run(2)\n",
    "notes.txt": "one\n\ntwo",
    "plumbline.toml": "[constraints]\nmax_cycles = 0\nmax_cc = 3\nno_god_files = true\n\n[[layers]]\nname = 'app'\npaths = ['app/**']\norder = 1\n\n[[layers]]\nname = 'tests'\npaths = ['tests/**']\norder = 2\n\n[[boundaries]]\nfrom = 'app/**'\nto = 'tests/**'\nreason = 'no tests'\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("scanned")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    return root


@pytest.fixture(scope="module")
def workspace(spark, root):
    return scan(spark, str(root))


def test_scan(workspace):
    files = {r["path"]: r for r in workspace.relation("files").collect()}
    assert set(files) == set(FILES)
    assert (files["notes.txt"]["lines"], files["notes.txt"]["blanks"], files["notes.txt"]["lang"]) == (3, 1, "unknown")
    assert (files["app/core.py"]["lines"], files["app/core.py"]["comments"], files["app/core.py"]["blanks"]) == (9, 1, 2)
    edges = {(r["from_file"], r["to_file"]) for r in workspace.relation("import_edges").collect()}
    assert edges >= {("app/main.py", "app/util.py"), ("app/core.py", "app/util.py")}
    assert [r["file"] for r in workspace.relation("entry_points").collect()] == ["app/main.py"]
    assert files["tests/test_core.py"]["is_test"] and not files["app/core.py"]["is_test"]


def test_every_tool_answers(workspace, root, tmp_path):
    assert tools.dispatch("scan", workspace)["scan"].first()["files"] == len(FILES)
    scores = tools.dispatch("health", workspace)["scores"].first()
    assert all(0 <= scores[c] <= 10000 for c in tools.CAUSES) and scores["bottleneck"] in tools.CAUSES and scores[scores["bottleneck"]] == min(scores[c] for c in tools.CAUSES)
    check = tools.dispatch("check", workspace)
    assert {r["rule"] for r in check["violations"].collect()} == {"max_cc"} and not check["verdict"].first()["passed"]
    assert check["verdict"].first()["rules_checked"] == 5
    saved = tools.dispatch("gate", workspace, path=str(tmp_path / "baseline"), save=True)["gate"].first()
    assert (saved["degraded"], saved["decision"]) == (False, "pass")
    start = tools.dispatch("session_start", workspace, path=str(tmp_path / "session"))["session"].first()
    assert start["files"] == len(FILES)
    end = tools.dispatch("session_end", workspace, path=str(tmp_path / "session"))
    assert end["changes"].count() == 0 and end["decision"].first()["decision"] == "pass"
    assert tools.dispatch("agent_brief", workspace)["health"].count() == 1
    stats = tools.dispatch("git_stats", workspace)
    assert {r["path"]: r["commit_count"] for r in stats["churn"].collect()} == {p: 1 for p in FILES if not p.startswith("tests/")}
    matrix = tools.dispatch("dsm", workspace)
    assert matrix["stats"].first()["edge_count"] == workspace.relation("import_edges").count()
    assert set(tools.render(matrix["matrix"])) <= set("x.\\\n")
    gaps = tools.dispatch("test_gaps", workspace)["report"].first()
    assert gaps["test_files"] == 1 and gaps["source_files"] == len(FILES) - 1


def test_registry(workspace):
    with pytest.raises(KeyError):
        tools.dispatch("nothing", workspace)
    tools.register_metric("longest", lambda w: w.relation("files").agg(F.max("lines").alias("longest")))
    tools.register_graph_builder("calls", lambda w: w.relation("call_edges"))
    try:
        assert tools.dispatch("health", workspace)["longest"].first()["longest"] == 19
        assert tools.dispatch("dsm", workspace, graph_name="calls")["stats"].count() == 1
    finally:
        del tools.METRICS["longest"], tools.GRAPHS["calls"]


def test_command_line(spark, root, tmp_path, capsys):
    assert cli.main(["check", str(root)], spark) == 1
    assert json.loads(capsys.readouterr().out)["verdict"]["violated"] == 1
    base = str(tmp_path / "b")
    assert cli.main(["gate", str(root), "--baseline", base, "--save"], spark) == 0
    assert cli.main(["brief", str(root)], spark) == 0 and cli.main(["report", str(root)], spark) == 0


def test_text_facts(spark, tmp_path):
    assert T.braces("a::{b, c::{d, self}, e}") == ["a::b", "a::c::d", "a::c", "a::e"] and T.braces("plain") == ["plain"]
    df = spark.createDataFrame([("std::{io, fmt::Debug}",), ("x",), (None,)], "spec string")
    assert [r["spec"] for r in T.expand_braces(df).collect()] == ["std::io", "std::fmt::Debug", "x"]
    specs = spark.createDataFrame([("..pkg.mod", True), ("a.b", True), ("crate::a::b", False), ("'./x.js'", False), (".", True)], "s string, d boolean")
    got = [specs.filter(F.col("d") == d).select(T.normalize_module(F.col("s"), d)).collect() for d in (True, False)]
    assert [[r[0] for r in x] for x in got] == [["../pkg/mod", "a/b", "."], ["crate/a/b", "./x.js"]]
    assert T.stripped("x = 'a # b'  # c\n", "python") == "x = ''  \n"
    assert T.commented("a /* b\nc */ d // e\n'// no'\n", "typescript") == 2
    facts = {"symbols": [{"id": "1", "path": "a.ts", "name": "n", "kind": "type", "line": 1}], "closed_domains": [{"path": "a.ts", "symbol_name": "S", "variants": ["x", "y"], "line": 2}]}
    (tmp_path / "facts.json").write_text(json.dumps(facts))
    tables = T.semantic_facts(spark, str(tmp_path / "facts.json"))
    assert tables["symbols"].first()["name"] == "n" and tables["closed_domains"].first()["variants"] == ["x", "y"] and tables["reads"].count() == 0
    T.write_semantic_cache(tables, str(tmp_path / "cache"), "id1")
    assert T.semantic_cache(spark, str(tmp_path / "cache"), "id1")["symbols"].count() == 1 and T.semantic_cache(spark, str(tmp_path / "cache"), "id2") is None
    (tmp_path / "plugins" / "py").mkdir(parents=True), (tmp_path / "plugins" / "bad").mkdir()
    (tmp_path / "plugins" / "py" / "plugin.toml").write_text("[plugin]\nname = 'python'\nextensions = ['py']\n[thresholds]\ncc_high = 9\n")
    (tmp_path / "plugins" / "bad" / "plugin.toml").write_text("[plugin\n")
    rows = {r["name"]: r for r in T.plugin_manifests(spark, str(tmp_path / "plugins")).collect()}
    assert rows["python"]["max_cc"] == 9 and rows["bad"]["error"]
