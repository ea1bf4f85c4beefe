"""Tools over a workspace: each gives named DataFrames, by operators that are also queries of their own.

``dispatch`` runs a tool by name. ``register_metric`` and ``register_graph_builder`` add a caller's own metric, which
``health`` then reports, and a caller's own way to make a graph, which ``dsm`` may be asked to use.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .operators import evolution, findings, graph, health, rules
from .plans.ranking import global_rank
from .plans.scratch import materialize
from .plans.sqlops import SqlOp
from .plans.views import RELATIONS
from .sources import repository
from .workspace import Workspace, scan

Result = dict[str, DataFrame]
METRICS: dict[str, Callable[[Workspace], DataFrame]] = {}
GRAPHS: dict[str, Callable[[Workspace], DataFrame]] = {"imports": lambda w: w.relation("dependency_edges")}
CAUSES = ("modularity", "acyclicity", "depth", "equality", "redundancy")
#: Share of edges above the diagonal from which the matrix tells of inverted layers.
INVERTED = 0.2
SHOWN_ROWS = 40

SCAN = "select (select count(*) from @files) as files, (select count(*) from @files where lang <> 'unknown') as code_files, (select coalesce(sum(lines), 0) from @files) as lines, (select count(*) from @functions) as functions, (select count(*) from @import_edges) as import_edges, (select count(*) from @call_edges) as call_edges"
HEALTH = "select " + ", ".join(f"cast(round(h.{c} * 10000) as bigint) as {c}" for c in CAUSES) + ", cast(round(round(h.quality_signal, 6) * 10000) as bigint) as quality_signal, case least(" + ", ".join(f"h.{c}" for c in CAUSES) + ") " + " ".join(f"when h.{c} then '{c}'" for c in CAUSES) + " end as bottleneck from @health h"
GATE = f"with d as ({rules.OPS['baseline_diff'].sql}) select degraded, case when degraded then 'fail' else 'pass' end as decision from d"
DEBT = f"select kind, scope, score, {findings._SEVERITY.format('score')} as severity from ({findings._DEBT}) d"
BRIEF = f"select kind, scope, score, severity, row_number() over (partition by severity order by score desc, kind, scope) as place from ({DEBT}) x"
CONCEPT = f"select c.concept, count(distinct t.target) as targets, count(distinct w.path) as writers, count(distinct r.path) as readers from @concepts c left join @concept_targets t on t.concept = c.concept left join ({findings._WRITES}) w on w.concept = c.concept left join ({findings._READS}) r on r.concept = c.concept group by c.concept"
DSM = "select (select count(*) from @levels) as size, (select count(*) from @dependency_edges) as edges, (select count(*) from @upward) as above, case when (select count(*) from @dependency_edges) = 0 then false else (select count(*) from @upward) / cast((select count(*) from @dependency_edges) as double) > 0.2 end as inverted"
#: Tools whose answer is one SELECT: registered as queries too.
SELECTS = {"tool_scan": SCAN, "tool_health": HEALTH, "tool_check": rules.OPS["check_verdict"].sql, "tool_gate": GATE, "tool_agent_brief": BRIEF, "tool_explain_concept": CONCEPT, "tool_trace_symbol": findings.OPS["trace_symbol"].sql, "tool_git_stats": evolution.OPS["churn"].sql, "tool_dsm": DSM}
OPS = {name: SqlOp(f"The answer of {name}", sql) for name, sql in SELECTS.items()}
RELATIONS.views["debt_reports"] = DEBT


def brief(reports: DataFrame) -> DataFrame:
    """The rows of ``tool_agent_brief``: places within a severity from ranks by ranges, as one severity may hold most of the reports."""
    order = [F.asc("severity"), F.desc("score"), F.asc("kind"), F.asc("scope")]
    ranked = materialize(global_rank(reports, order, "nth"))
    first = ranked.groupBy("severity").agg(F.min("nth").alias("first"))
    return ranked.join(F.broadcast(first), "severity").select("kind", "scope", "score", "severity", (F.col("nth") - F.col("first") + 1).cast("int").alias("place"))


def explain_concept(concepts: DataFrame, targets: DataFrame, writes: DataFrame, reads: DataFrame) -> DataFrame:
    """The rows of ``tool_explain_concept``: each side is counted by itself, as joined they would be all triples of a concept's targets, writes and reads."""
    rows = concepts.select("concept").distinct()
    used = {"targets": (targets, "target"), "writers": (SqlOp("writes", findings._WRITES).run(writes=writes, concept_targets=targets), "path"), "readers": (SqlOp("reads", findings._READS).run(reads=reads, concept_targets=targets), "path")}
    for name, (side, column) in used.items():
        rows = rows.join(side.groupBy("concept").agg(F.count_distinct(column).alias(name)), "concept", "left")
    return rows.fillna(0, list(used))


#: Answers that Spark gets by a function: (operator, its relations in order, None, as DuckDB gets the SELECT).
COMPUTED = {"tool_agent_brief": (brief, ("debt_reports",), None), "tool_explain_concept": (explain_concept, ("concepts", "concept_targets", "writes", "reads"), None)}


def tool_scan(w: Workspace) -> Result:
    return {"scan": w.run(OPS["tool_scan"])}


def tool_health(w: Workspace) -> Result:
    """Scores from 0 to 10000, raw values, the lowest score, and what registered metrics add."""
    return {"scores": w.run(OPS["tool_health"]), "raw": w.run(health.OPS["health_report"])} | {name: f(w) for name, f in METRICS.items()}


def tool_check(w: Workspace) -> Result:
    return {"verdict": w.run(OPS["tool_check"]), "violations": w.run(rules.OPS["check_rules"])}


def baseline(w: Workspace) -> DataFrame:
    """The row that a later gate compares with."""
    return w.run(SqlOp("baseline", "select cast(0 as double) as timestamp, quality_signal, coupling_score, cycle_count, god_files as god_file_count, hotspot_files as hotspot_count, complex_functions as complex_fn_count, cast(max_depth as int) as max_depth, total_import_edges, cross_module_edges from @health"))


def tool_gate(w: Workspace, path: str | None = None, save: bool = False) -> Result:
    """Compare with the baseline at ``path``, or save it there."""
    if path and save:
        repository.write_baseline(baseline(w), path)
    if path:
        w.seen["structural_baseline"] = repository.read_baseline(w.spark, path)
    return {"gate": w.run(OPS["tool_gate"]), "diff": w.run(rules.OPS["baseline_diff"])}


def _debt(w: Workspace) -> DataFrame:
    return w.run(SqlOp("debt", DEBT))


def session_payload(w: Workspace) -> tuple[DataFrame, DataFrame]:
    """File hashes, and findings by their key."""
    hashes = w.relation("contents").select("path", F.xxhash64("contents").alias("hash"))
    found = _debt(w).select(F.to_json(F.struct("kind", "scope")).alias("key"), "kind", "severity", F.col("scope").alias("file"), "score")
    return hashes, found


def tool_session_start(w: Workspace, path: str) -> Result:
    """Save what a session begins with below ``path``: hashes and findings."""
    hashes, found = session_payload(w)
    hashes.write.mode("overwrite").parquet(f"{path}/hashes")
    found.write.mode("overwrite").parquet(f"{path}/findings")
    w.spark.createDataFrame([(json.dumps({"schema_version": 3, "root": w.root}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/identity")
    return {"session": hashes.agg(F.count("*").alias("files")).crossJoin(found.agg(F.count("*").alias("findings")))}  # two single rows


def tool_session_end(w: Workspace, path: str) -> Result:
    """Changed files, findings that came and went, and the decision: fail on a new high one, warn on any new one."""
    hashes, found = session_payload(w)
    old_hashes, old = w.spark.read.parquet(f"{path}/hashes"), w.spark.read.parquet(f"{path}/findings")
    found = materialize(found)
    changes = rules.OPS["hash_diff_full_outer"].run(file_hashes=hashes, baseline_hashes=old_hashes)
    introduced = materialize(found.join(old.select("key"), "key", "left_anti"))
    resolved = old.join(found.select("key"), "key", "left_anti")
    high = F.coalesce(F.max((F.col("severity") == "high").cast("int")), F.lit(0))
    decision = introduced.agg(F.when(high == 1, "fail").when(F.count("*") > 0, "warn").otherwise("pass").alias("decision"), F.count("*").alias("introduced"))
    return {"changes": changes, "introduced": introduced, "resolved": resolved, "decision": decision}


def tool_agent_brief(w: Workspace, limit: int = 3) -> Result:
    """The worst findings, and what to check first. The limit is the reader's."""
    order = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return {"brief": w.call(brief, "debt_reports").orderBy(order.desc(), F.desc("score"), "kind", "scope").limit(limit), "health": w.run(OPS["tool_health"])}


def tool_explain_concept(w: Workspace, concept: str | None = None) -> Result:
    rows = w.call(explain_concept, "concepts", "concept_targets", "writes", "reads")
    return {"concept": rows if concept is None else rows.filter(F.col("concept") == concept)}


def trace(symbol: str) -> SqlOp:
    """Where a symbol, or one below it, is written, read or the target of a concept."""
    return SqlOp("trace", findings.OPS["trace_symbol"].sql.replace("store.nation_15", symbol.replace("'", "''")))


def tool_trace_symbol(w: Workspace, symbol: str) -> Result:
    return {"trace": w.run(trace(symbol))}


def tool_git_stats(w: Workspace) -> Result:
    return {name: w.run(evolution.OPS[name]) for name in ("churn", "change_coupling", "temporal_hotspots", "bus_factor", "bus_factor_score", "churn_concentration")}


def render(cells: DataFrame, rows: int = SHOWN_ROWS) -> str:
    """The first rows and columns of a matrix (row, col) as text; the bound is that of the text."""
    found = {(r["row"], r["col"]) for r in cells.filter((F.col("row") < rows) & (F.col("col") < rows)).select("row", "col").collect()}
    n = 1 + max((max(c) for c in found), default=-1)
    return "\n".join("".join("x" if (i, j) in found else "\\" if i == j else "." for j in range(n)) for i in range(n))


def tool_dsm(w: Workspace, graph_name: str = "imports") -> Result:
    edges = GRAPHS[graph_name](w)
    return {"summary": w.run(OPS["tool_dsm"]), "stats": graph.dsm_stats(edges), "matrix": graph.dsm(edges), "clusters": graph.dsm_clusters(edges)}


def tool_test_gaps(w: Workspace) -> Result:
    edges, files = w.relation("import_edges"), w.relation("files")
    return {"report": graph.test_gap_report(edges, files), "gaps": graph.risk_gaps(edges, files, w.relation("functions"))}


TOOLS: dict[str, Callable[..., Result]] = {f.__name__.removeprefix("tool_"): f for f in (tool_scan, tool_health, tool_check, tool_gate, tool_session_start, tool_session_end, tool_agent_brief, tool_explain_concept, tool_trace_symbol, tool_git_stats, tool_dsm, tool_test_gaps)}
#: Tools that need a registered add-on; others are open to all.
TIERS: dict[str, str] = {}


def dispatch(name: str, w: Workspace, tier: str = "open", **arguments) -> Result:
    """Run a tool by name; an unknown one, or one of a higher tier, raises."""
    if name not in TOOLS:
        raise KeyError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    if TIERS.get(name, "open") not in ("open", tier):
        raise PermissionError(f"{name} needs the tier {TIERS[name]}")
    return TOOLS[name](w, **arguments)


def register_metric(name: str, f: Callable[[Workspace], DataFrame]) -> None:
    METRICS[name] = f


def register_graph_builder(name: str, f: Callable[[Workspace], DataFrame]) -> None:
    """``f`` gives (from_file, to_file) rows."""
    GRAPHS[name] = f


def rescan(w: Workspace) -> Workspace:
    """The workspace of the same tree as it is now."""
    return scan(w.spark, w.root)

