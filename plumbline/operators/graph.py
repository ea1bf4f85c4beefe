"""Graph operators over dependency edges: cycles, levels, reach, matrices and what-if."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.ranking import global_rank
from ..plans.scratch import materialize
from . import kernels as K

CHAIN = "chain_edges"
DAG = "dag_edges"
_REACH = "reach(s, d) as (select from_file, to_file from @{e} union select r.s, e.to_file from reach r join @{e} e on e.from_file = r.d)"
_SCC = "nodes as (select from_file as node from @{e} union select to_file from @{e}), sccs as (select n.node, least(n.node, coalesce(min(r.d), n.node)) as scc from nodes n left join (select a.s, a.d from reach a join reach b on a.s = b.d and a.d = b.s) r on r.s = n.node group by n.node)"
_SIZES = "sizes as (select scc, count(*) as n from sccs group by scc)"
#: Longest path over the condensation; the views used for levels have few and short paths.
_LEVELS = "deps as (select distinct a.scc as a, b.scc as b from @{e} e join sccs a on a.node = e.from_file join sccs b on b.node = e.to_file where a.scc <> b.scc), walk(c, n) as (select scc, cast(0 as bigint) from (select distinct scc from sccs) z union select d.a, w.n + 1 from walk w join deps d on d.b = w.c), lev as (select c as scc, max(n) as level from walk group by c)"


def _with(edges: str, *parts: str) -> str:
    return "with recursive " + ", ".join(p.format(e=edges) for p in parts)


def cycle_detection(edges: DataFrame) -> DataFrame:
    """Components of more than one file: id, size and sorted members."""
    s = K.scc(K.edges_of(edges))
    return s.groupBy("scc").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("node")), ",").alias("members")).filter("size > 1").select(F.col("scc").alias("cycle_id"), "size", "members")


def scc_ids(edges: DataFrame) -> DataFrame:
    """Component and its size of every file, single files too."""
    s = K.scc(K.edges_of(edges))
    return s.join(s.groupBy("scc").agg(F.count("*").alias("scc_size")), "scc").select(F.col("node").alias("path"), "scc", "scc_size")


def levelization(edges: DataFrame) -> DataFrame:
    return K.levels(K.edges_of(edges)).select(F.col("node").alias("path"), "level")


def upward_violations(edges: DataFrame) -> DataFrame:
    """Edges up in level, or within a component of more than one file."""
    e = K.edges_of(edges)
    lv = K.levels(e)
    sizes = lv.groupBy("scc").agg(F.count("*").alias("n"))
    placed = lv.join(sizes, "scc")
    a = placed.select(F.col("node").alias("src"), F.col("level").alias("from_level"), F.col("scc").alias("a"), "n")
    b = placed.select(F.col("node").alias("dst"), F.col("level").alias("to_level"), F.col("scc").alias("b"))
    bad = (F.col("from_level") < F.col("to_level")) | ((F.col("a") == F.col("b")) & (F.col("n") > 1) & (F.col("src") != F.col("dst")))
    return e.join(a, "src").join(b, "dst").filter(bad).select(F.col("src").alias("from_file"), "from_level", F.col("dst").alias("to_file"), "to_level")


def blast_radius(edges: DataFrame) -> DataFrame:
    """Files that reach each file, itself left out."""
    return K.reach_counts(K.edges_of(edges)).select(F.col("node").alias("path"), F.col("n").alias("blast_radius"))


def exec_depth(edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Edges from the nearest entry point of each file that one reaches."""
    return K.bfs(K.edges_of(edges), entry_points.select(F.col("file").alias("node"))).select(F.col("node").alias("path"), "depth")


def attack_surface(edges: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Files of the graph that entry points reach, and all files of it."""
    e = K.edges_of(edges)
    nodes = K.nodes_of(e)
    reached = K.bfs(e, entry_points.select(F.col("file").alias("node")).join(nodes, "node", "left_semi"))
    return reached.agg(F.count("*").alias("reachable")).crossJoin(nodes.agg(F.count("*").alias("total")))  # two single rows


def transitive_tested(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that some test reaches."""
    tests = files.filter("is_test").select(F.col("path").alias("node"))
    return K.bfs(K.edges_of(edges), tests).join(files.filter("not is_test").select(F.col("path").alias("node")), "node").select(F.col("node").alias("path"))


def test_gap_report(edges: DataFrame, files: DataFrame) -> DataFrame:
    tested = transitive_tested(edges, files).agg(F.count("*").alias("tested"))
    counts = files.agg(F.sum(F.when(~F.col("is_test"), 1).otherwise(0)).cast("long").alias("source_files"), F.sum(F.when(F.col("is_test"), 1).otherwise(0)).cast("long").alias("test_files"))
    return counts.crossJoin(tested).withColumn("coverage_ratio", F.when(F.col("source_files") == 0, 1.0).otherwise(F.round(F.col("tested") / F.col("source_files"), 6)))


def risk_gaps(edges: DataFrame, files: DataFrame, functions: DataFrame, limit: int = 50) -> DataFrame:
    """The untested sources with the largest complexity times (fan-in + 1)."""
    tested = transitive_tested(edges, files)
    cc = functions.groupBy("path").agg(F.max(F.coalesce("cc", F.lit(1))).alias("max_complexity"))
    fan = edges.groupBy(F.col("to_file").alias("path")).agg(F.count("*").alias("fan_in"))
    rows = files.filter("not is_test").select("path").join(tested, "path", "left_anti").join(cc, "path", "left").join(fan, "path", "left").fillna(1, ["max_complexity"]).fillna(0, ["fan_in"])
    return rows.withColumn("risk_score", F.col("max_complexity") * (F.col("fan_in") + 1)).orderBy(F.desc("risk_score"), "path").limit(limit)


def max_depth(edges: DataFrame) -> DataFrame:
    """The longest chain of components, defined on the condensation."""
    return K.levels(K.edges_of(edges)).agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_depth"))


def dsm(edges: DataFrame) -> DataFrame:
    """The matrix in coordinates: rows and columns by level then path, and where each edge lies."""
    e = K.edges_of(edges)
    lv = K.levels(e)
    at = global_rank(lv, [F.desc("level"), F.asc("node")], "idx").withColumn("idx", F.col("idx") - 1)
    a = at.select(F.col("node").alias("src"), F.col("idx").alias("row"), F.col("level").alias("x"))
    b = at.select(F.col("node").alias("dst"), F.col("idx").alias("col"), F.col("level").alias("y"))
    side = F.when(F.col("x") == F.col("y"), "same").when(F.col("x") < F.col("y"), "above").otherwise("below")
    return e.join(a, "src").join(b, "dst").select("row", "col", side.alias("side"))


def dsm_stats(edges: DataFrame) -> DataFrame:
    """Size, edges, density and the mean share of other files that a file reaches."""
    e = K.edges_of(edges)
    n = K.nodes_of(e).agg(F.count("*").alias("size"))
    m = e.agg(F.count("*").alias("edge_count"))
    r = K.reach_counts(e).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reach"))
    possible = F.col("size") * (F.col("size") - 1)
    return n.crossJoin(m).crossJoin(r).select("size", "edge_count", F.round(F.when(F.col("size") > 1, F.col("edge_count") / possible).otherwise(F.col("edge_count")), 6).alias("density"), F.round(F.when(F.col("size") > 1, F.col("reach") / possible).otherwise(0.0), 6).alias("propagation_cost"))


def dsm_clusters(edges: DataFrame) -> DataFrame:
    """Components over edges that go both ways."""
    e = K.edges_of(edges)
    both = e.alias("a").join(e.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).select(F.col("a.src").alias("src"), F.col("a.dst").alias("dst")).filter("src < dst")
    return K.connected(both).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("node")), ",").alias("members"))


def weak_components(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Undirected components that a file which is no test belongs to, such files without edges too; edges of tests join."""
    sources = files.filter("not is_test").select(F.col("path").alias("node"))
    linked = K.connected(K.edges_of(edges))
    found = linked.union(sources.join(linked, "node", "left_anti").select("node", F.col("node").alias("component")))
    return found.join(found.join(sources, "node", "left_semi").select("component").distinct(), "component", "left_semi").select(F.col("node").alias("path"), "component")


def best_cycle_break(edges: DataFrame) -> DataFrame:
    """For each cycle the inner edge whose target has the smallest fan-in."""
    from pyspark.sql import Window as W

    e = K.edges_of(edges)
    s = K.scc(e)
    fan = e.groupBy("dst").agg(F.count("*").alias("fan_in"))
    inner = e.filter("src <> dst").join(s.withColumnsRenamed({"node": "src", "scc": "a"}), "src").join(s.withColumnsRenamed({"node": "dst", "scc": "b"}), "dst").filter("a = b").join(fan, "dst")
    rank = F.row_number().over(W.partitionBy("a").orderBy("fan_in", "src", "dst"))
    return inner.withColumn("rk", rank).filter("rk = 1").select(F.col("a").alias("cycle_id"), F.col("src").alias("from_file"), F.col("dst").alias("to_file"), "fan_in")


def whatif(edges: DataFrame, kind: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Edges after an action: move (a to b), add_edge, remove_edge, remove_file (a) or break_cycle (every best break)."""
    e = edges.select("from_file", "to_file").distinct()
    if kind == "move":
        new = lambda c: F.when(F.col(c) == a, F.lit(b)).otherwise(F.col(c)).alias(c)
        return e.select(new("from_file"), new("to_file")).distinct()
    if kind == "add_edge":
        return e.union(e.sparkSession.createDataFrame([(a, b)], "from_file string, to_file string")).distinct()
    if kind == "remove_edge":
        return e.filter(~((F.col("from_file") == a) & (F.col("to_file") == b)))
    if kind == "remove_file":
        return e.filter((F.col("from_file") != a) & (F.col("to_file") != a))
    if kind == "break_cycle":
        return e.join(best_cycle_break(e), ["from_file", "to_file"], "left_anti")
    raise ValueError(f"no action {kind!r}")


def whatif_simulate(edges: DataFrame, actions: list[tuple]) -> DataFrame:
    """Cycles, upward edges and depth before and after a sequence of actions; improved: none worse, one better."""
    after = edges
    for action in actions:
        after = materialize(whatif(after, *action))

    def measured(e: DataFrame, name: str) -> DataFrame:
        e = K.edges_of(e)
        lv = K.levels(e)
        cycles = lv.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias(f"cycles_{name}"))
        return cycles.crossJoin(lv.agg(F.coalesce(F.max("level"), F.lit(0)).alias(f"depth_{name}"))).crossJoin(e.agg(F.count("*").alias(f"edges_{name}")))

    row = measured(edges, "before").crossJoin(measured(after, "after"))
    worse = (F.col("cycles_after") > F.col("cycles_before")) | (F.col("depth_after") > F.col("depth_before"))
    better = (F.col("cycles_after") < F.col("cycles_before")) | (F.col("depth_after") < F.col("depth_before"))
    return row.withColumn("improved", ~worse & better)


def foundation_files(edges: DataFrame, module_paths: DataFrame, most: float = 0.25, least_modules: int = 2, least_files: int = 5) -> DataFrame:
    """(path): barrels, files with ``least_files`` dependants, and files of modules of instability of at most ``most`` with ``least_modules`` dependants."""
    e = edges.select("from_file", "to_file").distinct()
    m = module_paths.select("path", "module")
    cross = e.join(m.withColumnsRenamed({"path": "from_file", "module": "a"}), "from_file").join(m.withColumnsRenamed({"path": "to_file", "module": "b"}), "to_file").filter("a <> b").select("a", "b").distinct()
    ce, ca = cross.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("ce")), cross.groupBy(F.col("b").alias("module")).agg(F.count("*").alias("ca"))
    stable = ca.join(ce, "module", "left").fillna(0, ["ce"]).filter((F.col("ca") >= least_modules) & (F.col("ce") / (F.col("ca") + F.col("ce")) <= most))
    wide = e.groupBy(F.col("to_file").alias("path")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_files)
    return module_paths.filter("is_barrel").select("path").union(m.join(stable, "module", "left_semi").select("path")).union(wide.select("path")).distinct()


def blast_concentration(edges: DataFrame, module_paths: DataFrame) -> DataFrame:
    """1 less the largest blast radius of files that are no foundation, over all files; 1 without such files."""
    b = materialize(blast_radius(edges))
    most = b.join(foundation_files(edges, module_paths), "path", "left_anti").agg(F.coalesce(F.max("blast_radius"), F.lit(0)).alias("most"))
    return b.agg(F.count("*").alias("n")).crossJoin(most).select(F.when(F.col("n") == 0, 1.0).otherwise(F.round(1 - F.col("most") / F.col("n"), 6)).alias("blast_score"))  # two single rows


_CA = "select to_module as module, count(*) as ca from @module_tree where from_module <> to_module group by to_module"
#: Three rounds, written out: in a tree a module is stable when all that it depends on is and two modules depend on it.
STABLE_SQL = f"with p as (select from_module, to_module from @module_tree), c as ({_CA}), s1 as (select module from c where ca >= 2 and module not in (select from_module from p)), s2 as (select module from s1 union select c.module from c join p on p.from_module = c.module where c.ca >= 2 and p.to_module in (select module from s1)), s3 as (select module from s2 union select c.module from c join p on p.from_module = c.module where c.ca >= 2 and p.to_module in (select module from s2)) select module from s3"

#: Both graphs under names of their own: reach2, sccs2 and lev2 belong to what is left without the best break of each cycle.
_BREAK = "f as (select to_file, count(*) as n from @chain_edges group by to_file), x as (select e.from_file, e.to_file, row_number() over (partition by a.scc order by f.n, e.from_file, e.to_file) as rk from @chain_edges e join sccs a on a.node = e.from_file join sccs b on b.node = e.to_file join f on f.to_file = e.to_file where a.scc = b.scc and e.from_file <> e.to_file), after as (select distinct from_file, to_file from @chain_edges e where not exists (select 1 from x where x.rk = 1 and x.from_file = e.from_file and x.to_file = e.to_file))"
_AFTER = ", ".join(p.format(e=CHAIN) for p in (_REACH, _SCC, _LEVELS)).replace(f"@{CHAIN}", "after")
for _n in ("reach", "nodes", "sccs", "deps", "walk", "lev"):
    _AFTER = re.sub(rf"\b{_n}\b", f"{_n}2", _AFTER)
WHATIF_SQL = _with(CHAIN, _REACH, _SCC, _LEVELS) + f", {_BREAK}, {_AFTER}, v as (select (select count(*) from (select scc from sccs group by scc having count(*) > 1) z) as cycles_before, (select max(level) from lev) as depth_before, (select count(*) from (select distinct from_file, to_file from @chain_edges) d) as edges_before, (select count(*) from (select scc from sccs2 group by scc having count(*) > 1) z) as cycles_after, (select max(level) from lev2) as depth_after, (select count(*) from after) as edges_after) select *, not (cycles_after > cycles_before or depth_after > depth_before) and (cycles_after < cycles_before or depth_after < depth_before) as improved from v"

#: name: (operator, its relations in order, its DuckDB SQL or None)
GRAPH: dict[str, tuple[Callable, tuple[str, ...], str | None]] = {
    "reachable": (lambda e, p: K.bfs(K.edges_of(e), p.select(F.col("file").alias("node"))).select(F.col("node").alias("path")), (DAG, "entry_points"), "with recursive r(path) as (select file from @entry_points union select e.to_file from r join @dag_edges e on e.from_file = r.path) select path from r"),
    "cycle_detection": (cycle_detection, (CHAIN,), _with(CHAIN, _REACH, _SCC) + " select scc as cycle_id, count(*) as size, SETJOIN(node) as members from sccs group by scc having count(*) > 1"),
    "scc_ids": (scc_ids, (CHAIN,), _with(CHAIN, _REACH, _SCC, _SIZES) + " select s.node as path, s.scc, z.n as scc_size from sccs s join sizes z on z.scc = s.scc"),
    "levelization": (levelization, (DAG,), _with(DAG, _REACH, _SCC, _LEVELS) + " select s.node as path, l.level from sccs s join lev l on l.scc = s.scc"),
    "upward_violations": (upward_violations, (CHAIN,), _with(CHAIN, _REACH, _SCC, _SIZES, _LEVELS) + " select e.from_file, x.level as from_level, e.to_file, y.level as to_level from @chain_edges e join sccs a on a.node = e.from_file join sccs b on b.node = e.to_file join lev x on x.scc = a.scc join lev y on y.scc = b.scc join sizes z on z.scc = a.scc where x.level < y.level or (a.scc = b.scc and z.n > 1 and e.from_file <> e.to_file)"),
    "blast_radius": (blast_radius, (CHAIN,), _with(CHAIN, _REACH, _SCC) + " select n.node as path, count(r.s) as blast_radius from nodes n left join reach r on r.d = n.node and r.s <> n.node group by n.node"),
    "blast_concentration": (blast_concentration, (CHAIN, "module_paths"), _with(CHAIN, _REACH, _SCC) + ", b as (select n.node, count(r.s) as n from nodes n left join reach r on r.d = n.node and r.s <> n.node group by n.node), x as (select distinct p.module as a, q.module as b from @chain_edges e join @module_paths p on p.path = e.from_file join @module_paths q on q.path = e.to_file where p.module <> q.module), ce as (select a, count(*) as n from x group by a), ca as (select b, count(*) as n from x group by b), st as (select ca.b as module from ca left join ce on ce.a = ca.b where ca.n >= 2 and coalesce(ce.n, 0) / cast(ca.n + coalesce(ce.n, 0) as double) <= 0.25), f as (select path from @module_paths where is_barrel or module in (select module from st) union select to_file from (select distinct from_file, to_file from @chain_edges) d group by to_file having count(*) >= 5) select round(1 - (select coalesce(max(n), 0) from b where node not in (select path from f)) / cast(count(*) as double), 6) as blast_score from b"),
    "exec_depth": (exec_depth, (DAG, "entry_points"), "with recursive r(path, depth) as (select file, cast(0 as bigint) from @entry_points union select e.to_file, r.depth + 1 from r join @dag_edges e on e.from_file = r.path) select path, min(depth) as depth from r group by path"),
    "attack_surface": (attack_surface, (CHAIN, "entry_points"), "with recursive n as (select from_file as path from @chain_edges union select to_file from @chain_edges), r(path) as (select file from @entry_points where file in (select path from n) union select e.to_file from r join @chain_edges e on e.from_file = r.path) select (select count(*) from r) as reachable, (select count(*) from n) as total"),
    "transitive_tested": (transitive_tested, (CHAIN, "files"), "with recursive r(path) as (select path from @files where is_test union select e.to_file from r join @chain_edges e on e.from_file = r.path) select r.path from r join @files f on f.path = r.path where not f.is_test"),
    "test_gap_report": (test_gap_report, (CHAIN, "files"), "with recursive r(path) as (select path from @files where is_test union select e.to_file from r join @chain_edges e on e.from_file = r.path), t as (select count(*) as tested from r join @files f on f.path = r.path where not f.is_test), c as (select cast(sum(case when not is_test then 1 else 0 end) as bigint) as source_files, cast(sum(case when is_test then 1 else 0 end) as bigint) as test_files from @files) select source_files, test_files, tested, round(tested / cast(source_files as double), 6) as coverage_ratio from c cross join t"),
    "risk_gaps": (risk_gaps, (CHAIN, "files", "functions"), "with recursive r(path) as (select path from @files where is_test union select e.to_file from r join @chain_edges e on e.from_file = r.path), m as (select path, max(coalesce(cc, 1)) as cc from @functions group by path), i as (select to_file as path, count(*) as n from @chain_edges group by to_file) select f.path, coalesce(m.cc, 1) as max_complexity, coalesce(i.n, 0) as fan_in, coalesce(m.cc, 1) * (coalesce(i.n, 0) + 1) as risk_score from @files f left join m on m.path = f.path left join i on i.path = f.path where not f.is_test and f.path not in (select path from r) order by risk_score desc, f.path limit 50"),
    "max_depth": (max_depth, (DAG,), _with(DAG, _REACH, _SCC, _LEVELS) + " select max(level) as max_depth from lev"),
    "dsm": (dsm, (DAG,), _with(DAG, _REACH, _SCC, _LEVELS) + ", p as (select s.node, l.level, row_number() over (order by l.level desc, s.node) - 1 as idx from sccs s join lev l on l.scc = s.scc) select a.idx as row, b.idx as col, case when a.level = b.level then 'same' when a.level < b.level then 'above' else 'below' end as side from @dag_edges e join p a on a.node = e.from_file join p b on b.node = e.to_file"),
    "dsm_stats": (dsm_stats, (CHAIN,), _with(CHAIN, _REACH, _SCC) + ", n as (select count(*) as size from nodes), m as (select count(*) as edge_count from @chain_edges), r as (select count(*) as reach from reach where s <> d) select size, edge_count, round(edge_count / cast(size * (size - 1) as double), 6) as density, round(reach / cast(size * (size - 1) as double), 6) as propagation_cost from n cross join m cross join r"),
    "dsm_clusters": (dsm_clusters, ("import_edges",), "with recursive b as (select x.from_file as s, x.to_file as d from @import_edges x join @import_edges y on x.from_file = y.to_file and x.to_file = y.from_file), r(s, d) as (select s, s from b union select r.s, b.d from r join b on b.s = r.d), c as (select s as node, min(d) as component from r group by s) select component, count(*) as size, SETJOIN(node) as members from c group by component"),
    "weak_components": (weak_components, (CHAIN, "files"), "with recursive b as (select from_file as s, to_file as d from @chain_edges union select to_file, from_file from @chain_edges), r(s, d) as (select s, s from b union select path, path from @files where not is_test union select r.s, b.d from r join b on b.s = r.d), c as (select s as path, min(d) as component from r group by s) select path, component from c where component in (select c.component from c join @files f on f.path = c.path where not f.is_test)"),
    "stable_modules": (lambda pairs: K.stable_modules(materialize(pairs)), ("module_tree",), STABLE_SQL),
    "best_cycle_break": (best_cycle_break, (CHAIN,), _with(CHAIN, _REACH, _SCC) + ", f as (select to_file, count(*) as n from @chain_edges group by to_file), x as (select a.scc as cycle_id, e.from_file, e.to_file, f.n as fan_in, row_number() over (partition by a.scc order by f.n, e.from_file, e.to_file) as rk from @chain_edges e join sccs a on a.node = e.from_file join sccs b on b.node = e.to_file join f on f.to_file = e.to_file where a.scc = b.scc and e.from_file <> e.to_file) select cycle_id, from_file, to_file, fan_in from x where rk = 1"),
    "whatif_sequence": (lambda e: whatif_simulate(e, [("break_cycle",)]), (CHAIN,), WHATIF_SQL),
}
