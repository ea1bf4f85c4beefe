"""Architecture tests: their literals, the files and concepts that they lead to, and the roles that follow."""

import random

from plumbline.operators import guardrails as G
from plumbline.plans.sqlops import SqlOp, relations_of
from plumbline.plans.views import RELATIONS

FILES = ["src/components/TaskPanel.tsx", "src/app/task-ports.ts", "src/store/store.ts", "src/app/store-boundary.ts", "src/other/bigstore/store.ts", "lib/a.js", "src/index.ts", "src/services/mail.ts", "src/app/api/x/route.ts", "src/lib/used.ts"]
PANEL = "src/components/TaskPanel.architecture.test.ts"
BOUNDARY = "src/app/store-boundary.architecture.spec.tsx"
TESTS = [
    (PANEL, "expect(source).toContain('createTaskPanelFocusRuntime');\nexpect(source).toContain(\"createTaskPanelPreview\\\"Controller\");\nexpect(source) .toContain(`created`);\nexpect(x).toContain(name);\nread('./lib/a.js'); read(\"../lib/a.js\"); it's open"),
    (BOUNDARY, "expect(source).not.toContain('store/store');\nexpect(source).not.toContain('two words/x');\nexpect(source).not.toContain('src/store/store.ts');\nexpect(source).toContain('');"),
    ("src/plain.test.ts", "expect(source).not.toContain('store/store'); taskStore.items"),
    ("x.architecture.test.ts", None),
]


def frames(spark):
    return spark.createDataFrame(TESTS, "path string, contents string"), spark.createDataFrame([(f,) for f in FILES], "path string")


def test_scan(spark):
    got = {}
    for r in G.guardrail_scan(*frames(spark)).collect():
        got.setdefault((r["file"], r["kind"]), set()).add(r["value"])
    panel = {"createTaskPanelFocusRuntime", 'createTaskPanelPreview"Controller', "created"}
    forbidden = {"store/store", "two words/x", "src/store/store.ts"}
    want = {}
    for file in ("src/components/TaskPanel.tsx", "lib/a.js"):
        want |= {(file, "test"): {PANEL}, (file, "required"): panel, (file, "factory"): panel - {"created"}}
    # Named by the test's own name; by the forbidden path as a quoted source; and by the fragment's end, at a component or inside one.
    for file in ("src/app/store-boundary.ts", "src/store/store.ts"):
        want |= {(file, "test"): {BOUNDARY}, (file, "required"): forbidden, (file, "forbidden"): forbidden}
    want |= {("src/store/store.ts", "boundary"): forbidden, ("src/other/bigstore/store.ts", "test"): {BOUNDARY}, ("src/other/bigstore/store.ts", "boundary"): forbidden}
    assert got == want


def test_long_literals_take_no_stack(spark):
    long = "x" * 300_000
    tests = spark.createDataFrame([(PANEL, f"expect(s).toContain('{long}'); expect(s).toContain('open {long}")], "path string, contents string")
    rows = G.literals(tests).collect()
    assert {(r["kind"], len(r["literal"])) for r in rows} == {("quoted", 300_000), ("required", 300_000)}


def test_roles(spark):
    tests, files = frames(spark)
    seen = {
        "guardrail_tests": tests, "files": files, "entry_points": spark.createDataFrame([("lib/a.js",)], "file string"),
        "import_edges": spark.createDataFrame([("src/index.ts", "src/lib/used.ts"), ("lib/a.js", "src/services/mail.ts"), ("src/app/task-ports.ts", "src/store/store.ts")], "from_file string, to_file string"),
    }
    op = SqlOp("", "select path, role from @role_tags")
    got = {}
    for r in op.run(spark, **{n: RELATIONS.frame(spark, "", n, seen) for n in relations_of(op.sql)}).collect():
        got.setdefault(r["path"], set()).add(r["role"])
    assert got == {
        "src/components/TaskPanel.tsx": {"guarded_seam", "facade_with_extracted_owners"}, "lib/a.js": {"guarded_seam", "facade_with_extracted_owners", "entry_surface"}, "src/app/store-boundary.ts": {"guarded_seam"},
        "src/store/store.ts": {"guarded_seam", "guarded_boundary", "component_barrel", "state_container"}, "src/other/bigstore/store.ts": {"guarded_seam", "guarded_boundary", "component_barrel"}, "src/services/mail.ts": {"service_layer", "composition_root"},
        "src/app/api/x/route.ts": {"api_route_surface", "entry_surface"}, "src/lib/used.ts": {"composition_root"},
    }


def test_concepts(spark):
    tests, _ = frames(spark)
    symbols = spark.createDataFrame([("panel", "TaskPanel"), ("panel", "createTaskPanelFocusRuntime"), ("store", "store/sto"), ("none", "taskStore"), ("none", "")], "concept string, symbol string")
    related = spark.createDataFrame([("store", "src/app/*"), ("panel", "*.spec.tsx"), ("none", "lib/**")], "concept string, pattern string")
    got = {tuple(r) for r in G.guardrail_concepts(tests, symbols, related).select("path", "concept", "evidence").collect()}
    assert got == {(PANEL, "panel", "TaskPanel"), (PANEL, "panel", "createTaskPanelFocusRuntime"), (BOUNDARY, "store", "store/sto"), (BOUNDARY, "store", "related_test:src/app/*"), (BOUNDARY, "panel", "related_test:*.spec.tsx")}


def test_ten_thousand_symbols(spark, monkeypatch):
    monkeypatch.setattr(G, "SYMBOLS_AT_ONCE", 3_000)
    monkeypatch.setattr(G, "TEXTS_AT_ONCE", 20)
    rng = random.Random(2)
    symbols = sorted({"".join(rng.choice("abcd.") for _ in range(rng.randint(3, 8))) for _ in range(14_000)})[:10_000]
    texts = [(f"t{i}", "".join(rng.choice("abcd. ") for _ in range(400))) for i in range(60)]
    got = {tuple(r) for r in G.symbol_hits(spark.createDataFrame(texts, "path string, contents string"), spark.createDataFrame([(s,) for s in symbols], "symbol string")).collect()}
    assert len(symbols) == 10_000 and got == {(p, s) for p, t in texts for s in symbols if s in t}
