"""The health report: levels, cycles, stable modules and the five root causes, over dependency edges.

These are computed relations: other operators and rules read them by name, as ``@levels``, ``@upward``, ``@stable``
and ``@health``. In Spark they come from the kernels; beside each stands the SELECT that gives DuckDB the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize, once
from ..plans.sqlops import SqlOp, pairs_of, relations_of
from ..plans.views import RELATIONS, by_number
from . import kernels as K
from .degrees import CC_HIGH, COG_HIGH, DEAD, DEGREES, DUPLICATES, FAN_IN, FAN_OUT, FUNC_LENGTH, GINI, LARGE_FILE, LEAST_HOTSPOT_INSTABILITY, MODULARITY, MODULE_EDGES, PARAM_HIGH
from .degrees import OPS as DEGREE_OPS

#: rounds' limits of stable modules, the floor under each score, the depth that halves the score, and the coupling from which entropy counts whole.
MOST_INSTABILITY, LEAST_DEPENDANTS, FLOOR, HALF_DEPTH, FULL_COUPLING = 0.15, 3, 0.01, 8, 0.35

_REACH = "reach(s, d) as (select from_file, to_file from @dependency_edges union select r.s, e.to_file from reach r join @dependency_edges e on e.from_file = r.d)"
LEVELS_SQL = f"""
    with recursive {_REACH}, nodes as (select from_file as node from @dependency_edges union select to_file from @dependency_edges),
    sccs as (select n.node, least(n.node, coalesce(min(r.d), n.node)) as scc from nodes n left join (select a.s, a.d from reach a join reach b on a.s = b.d and a.d = b.s) r on r.s = n.node group by n.node),
    deps as (select distinct a.scc as a, b.scc as b from @dependency_edges e join sccs a on a.node = e.from_file join sccs b on b.node = e.to_file where a.scc <> b.scc),
    walk(c, n) as (select scc, cast(0 as bigint) from (select distinct scc from sccs) z union select d.a, w.n + 1 from walk w join deps d on d.b = w.c), lev as (select c as scc, max(n) as level from walk group by c)
    select s.node as path, s.scc, l.level from sccs s join lev l on l.scc = s.scc"""


def import_graph(dependency_edges: DataFrame, module_paths: DataFrame) -> DataFrame:
    """(src, dst): distinct edges by name; by number, with repeats and numbers that no file has, where files and numbers are one to one."""
    pairs = pairs_of(dependency_edges)
    if pairs is not None and by_number(module_paths):
        return materialize(pairs.select(F.col("a_k").alias("src"), F.col("b_k").alias("dst")))
    return K.edges_of(dependency_edges)


def levels(import_graph: DataFrame, module_paths: DataFrame) -> DataFrame:
    """(path, scc, level, top, node) of each file of the graph; ``node`` is what the graph calls it, ``top`` if no edge leads to it."""
    if dict(import_graph.dtypes)["src"] != "bigint":
        return materialize(K.levels(import_graph).select(F.col("node").alias("path"), "scc", "level", "top", "node"))
    files = module_paths.select(F.col("k").alias("node"), "path")
    placed = K.levels(import_graph, files.select("node")).withColumnRenamed("scc", "number").join(files, "node")
    names = placed.groupBy("number").agg(F.min("path").alias("scc"))
    return materialize(placed.join(names, "number").select("path", "scc", "level", "top", "node"))


UPWARD_SQL = """
    select distinct e.from_file, a.level as from_level, e.to_file, b.level as to_level
    from @dependency_edges e join @levels a on a.path = e.from_file join @levels b on b.path = e.to_file join (select scc, count(*) as n from @levels group by scc) z on z.scc = a.scc
    where a.level < b.level or (a.scc = b.scc and z.n > 1 and e.from_file <> e.to_file)"""

#: Over distinct edges, so that what is found needn't be made distinct; a component's size comes with its files, not with their edges.
_UPWARD = """
    with p as (select l.path, l.node, l.scc, l.level, z.n from @levels l join (select scc, count(*) as n from @levels group by scc) z on z.scc = l.scc)
    select a.path as from_file, a.level as from_level, b.path as to_file, b.level as to_level
    from @import_graph e join p a on a.node = e.src join @levels b on b.node = e.dst
    where a.level < b.level or (a.scc = b.scc and a.n > 1 and e.src <> e.dst)"""


def upward(import_graph: DataFrame, levels: DataFrame) -> DataFrame:
    """Edges up in level or within a component of several files."""
    e = import_graph.distinct() if dict(import_graph.dtypes)["src"] == "bigint" else import_graph
    return SqlOp("upward", _UPWARD).run(import_graph=e, levels=levels if "node" in levels.columns else levels.withColumn("node", F.col("path")))


_DEPENDANTS_SQL = f"with recursive {_REACH}, nodes as (select from_file as node from @dependency_edges union select to_file from @dependency_edges) select n.node as path, count(r.s) as n from nodes n left join reach r on r.d = n.node and r.s <> n.node group by n.node"
_SURFACE_SQL = "with recursive r(path) as (select path from @levels where path in (select file from @entry_points) union select e.to_file from r join @dependency_edges e on e.from_file = r.path) select path from r"


def _condensed(import_graph: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, node, scc) of the graph's files, a component by one of its nodes, and the edges between components; ``levels`` has found them already."""
    placed = levels.select("path", (F.col("node") if dict(import_graph.dtypes)["src"] == "bigint" else F.col("path")).alias("node"), F.col("scc").alias("name"))
    files = materialize(placed.join(placed.groupBy("name").agg(F.min("node").alias("scc")), "name").select("path", "node", "scc"))
    return files, K.between_components(import_graph, files)


def import_dependants(import_graph: DataFrame, levels: DataFrame) -> DataFrame:
    """(path, n): how many other files of the import graph reach each."""
    files, deps = _condensed(import_graph, levels)
    return materialize(K.dependants(files.select("node", "scc"), deps, K.forest(deps)).join(files, "node").select("path", "n"))


def import_surface(import_graph: DataFrame, levels: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(path) of the import graph's files that its entry points reach, themselves too: a component is reached as a whole."""
    files, deps = _condensed(import_graph, levels)
    seeds = files.join(entry_points.select(F.col("file").alias("path")), "path", "left_semi").select(F.col("scc").alias("node")).distinct()
    found = K._reached(deps, seeds)
    return materialize(files.join(found.withColumnRenamed("node", "scc"), "scc", "left_semi").select("path"))


_PAIRS = f"select distinct from_module, to_module from ({MODULE_EDGES}) e where from_module <> to_module"


def _stable_sql(rounds: int) -> str:
    """The fixpoint of stable modules, if it takes at most ``rounds`` rounds."""
    ctes = [f"p as ({_PAIRS})", "m as (select from_module as module from p union select to_module from p)", "ca as (select to_module as module, count(*) as ca from p group by to_module)", "s0 as (select module from m where false)"]
    for i in range(rounds):
        ce = f"select from_module as module, count(*) as ce from p where to_module not in (select module from s{i}) group by from_module"
        ctes.append(f"s{i + 1} as (select module from s{i} union select m.module from m left join ca on ca.module = m.module left join ({ce}) ce on ce.module = m.module where (coalesce(ce, 0) = 0 and coalesce(ca, 0) >= 2) or (coalesce(ce, 0) > 0 and ce / cast(coalesce(ca, 0) + ce as double) <= {MOST_INSTABILITY} and coalesce(ca, 0) >= {LEAST_DEPENDANTS}))")
    return f"with {', '.join(ctes)} select module from s{rounds}"


def stable(module_flows: DataFrame) -> DataFrame:
    """(module) of stable modules."""
    return K.stable_modules(materialize(module_flows.filter("imports > 0 and from_module <> to_module").select("from_module", "to_module")))


#: One row of raw values, over relations that Spark holds as tables by now.
_RAW = f"""
    with deg as ({DEGREES}), me as ({MODULE_EDGES}),
    god as (select d.path from deg d join @files f on f.path = d.path where d.fan_out > {FAN_OUT} and not f.is_barrel and not exists (select 1 from @entry_points p where p.file = d.path)),
    hot as (select d.path from deg d join @files f on f.path = d.path where d.fan_in > {FAN_IN} and not f.is_barrel and d.fan_out / cast(d.fan_in + d.fan_out as double) >= {LEAST_HOTSPOT_INSTABILITY}),
    fn as (select count(*) as total, sum(case when cc > {CC_HIGH} then 1 else 0 end) as complex_ones, sum(case when ln > {FUNC_LENGTH} then 1 else 0 end) as long_ones, sum(case when cog > {COG_HIGH} then 1 else 0 end) as cog_ones, sum(case when pc > {PARAM_HIGH} then 1 else 0 end) as param_ones from @functions),
    fl as (select count(*) as code_files, sum(case when lines > {LARGE_FILE} then 1 else 0 end) as large_files, sum(lines) as lines, sum(comments) as comments from @files where not is_dir and lang <> '' and lang <> 'unknown'),
    dead as (select count(*) as n from ({DEAD}) x), dup as (select coalesce(sum(n), 0) as n from ({DUPLICATES}) y),
    ed as (select count(*) as edges, coalesce(sum(case when from_module <> to_module then 1 else 0 end), 0) as cross_edges, coalesce(sum(case when from_module <> to_module and not exists (select 1 from @stable s where s.module = me.to_module) then 1 else 0 end), 0) as loose from me),
    pr as (select count(*) as n from (select from_module, to_module, count(*) as n from me where from_module <> to_module and not exists (select 1 from @stable s where s.module = me.to_module) group by from_module, to_module) q),
    cy as (select count(*) as cycles, coalesce(sum(n), 0) as cycle_files from (select scc, count(*) as n from @levels group by scc having count(*) > 1) z),
    seeds as (select l.path, l.level, exists (select 1 from @entry_points p where p.file = l.path) as entry, not exists (select 1 from @dependency_edges e where e.to_file = l.path) as top from @levels l),
    de as (select coalesce(max(case when entry then level end), max(case when top then level end), 0) as max_depth, count(*) as graph_files from seeds)
    select q.q as modularity_q, g.gini, cast(cy.cycles as bigint) as cycle_count, cast(cy.cycle_files as bigint) as cycle_files, cast(de.max_depth as bigint) as max_depth, cast(de.graph_files as bigint) as graph_files,
           fn.total as total_functions, cast(coalesce(fn.complex_ones, 0) as bigint) as complex_functions, cast(coalesce(fn.long_ones, 0) as bigint) as long_functions, cast(coalesce(fn.cog_ones, 0) as bigint) as cog_complex_functions, cast(coalesce(fn.param_ones, 0) as bigint) as high_param_functions,
           fl.code_files, cast(coalesce(fl.large_files, 0) as bigint) as large_files, case when coalesce(fl.lines, 0) = 0 then null else fl.comments / cast(fl.lines as double) end as comment_ratio,
           cast(dead.n as bigint) as dead_functions, cast(dup.n as bigint) as duplicate_functions, case when fn.total = 0 then 0.0 else least(dead.n + dup.n, fn.total) / cast(fn.total as double) end as redundancy_ratio,
           ed.edges as total_import_edges, cast(ed.cross_edges as bigint) as cross_module_edges, cast(pr.n as bigint) as loose_pairs, case when ed.loose = 0 then 0.0 else ed.loose / cast(ed.edges as double) end as coupling_score,
           (select count(*) from god) as god_files, (select count(*) from hot) as hotspot_files
    from ({MODULARITY}) q cross join ({GINI}) g cross join fn cross join fl cross join dead cross join dup cross join ed cross join pr cross join cy cross join de"""
_SCORES = {
    "modularity": "greatest(0.0, least(1.0, (modularity_q + 0.5) / 1.5))", "acyclicity": "1 / cast(1 + cycle_count as double)", "depth": f"1 / (1 + max_depth / cast({HALF_DEPTH} as double))",
    "equality": "greatest(0.0, least(1.0, 1 - gini))", "redundancy": "greatest(0.0, least(1.0, 1 - redundancy_ratio))",
}
_SIGNAL = f"power({' * '.join(f'greatest({c}, {FLOOR})' for c in _SCORES)}, 0.2)"
HEALTH_SQL = f"""
    with raw as ({_RAW}),
    s as (select *, {', '.join(f'{e} as {c}' for c, e in _SCORES.items())} from raw)
    select *, {_SIGNAL} as quality_signal from s"""


_LOOSE = "from_module <> to_module and not exists (select 1 from @stable s where s.module = mf.to_module)"
_FLOWS = "(select * from @module_flows where imports > 0) mf"
_GOD = f"(select count(*) as n from @node_degrees d join @files f on f.path = d.path where d.fan_out > {FAN_OUT} and not f.is_barrel and not exists (select 1 from @entry_points p where p.file = d.path))"
_HOT = f"(select count(*) as n from @node_degrees d join @files f on f.path = d.path where d.fan_in > {FAN_IN} and not f.is_barrel and d.fan_out / cast(d.fan_in + d.fan_out as double) >= {LEAST_HOTSPOT_INSTABILITY})"
#: The row of ``_RAW`` for Spark in pieces, each a row of its own with the columns that it gives; what stands on edges there is counted from ``module_flows`` and ``node_degrees``.
_PIECES: dict[str, tuple[str, dict[str, str]]] = {
    "q": ("""(
        with m as (select coalesce(sum(edges), 0) as m, coalesce(sum(case when from_module = to_module then edges else 0 end), 0) as inside from @module_flows),
        o as (select from_module as module, sum(edges) as k from @module_flows group by from_module), i as (select to_module as module, sum(edges) as k from @module_flows group by to_module),
        x as (select cast(coalesce(sum(o.k * i.k), 0) as double) as s from o join i on o.module = i.module)
        select case when m.m = 0 then 1.0 else greatest(-0.5, least(1.0, (m.inside - x.s / m.m) / m.m)) end as q from m cross join x)""", {"modularity_q": "q.q"}),
    "g": (f"({GINI})", {"gini": "g.gini"}),
    "cy": ("(select count(*) as cycles, coalesce(sum(n), 0) as cycle_files from (select scc, count(*) as n from @levels group by scc having count(*) > 1) z)", {"cycle_count": "cast(cy.cycles as bigint)", "cycle_files": "cast(cy.cycle_files as bigint)"}),
    "de": ("(select coalesce(max(case when entry then level end), max(case when top then level end), 0) as max_depth, count(*) as graph_files from (select l.path, l.level, exists (select 1 from @entry_points p where p.file = l.path) as entry, l.top from @levels l) seeds)", {"max_depth": "cast(de.max_depth as bigint)", "graph_files": "cast(de.graph_files as bigint)"}),
    "fn": (f"(select count(*) as total, sum(case when cc > {CC_HIGH} then 1 else 0 end) as complex_ones, sum(case when ln > {FUNC_LENGTH} then 1 else 0 end) as long_ones, sum(case when cog > {COG_HIGH} then 1 else 0 end) as cog_ones, sum(case when pc > {PARAM_HIGH} then 1 else 0 end) as param_ones from @functions)", {"total_functions": "fn.total"} | {f"{x}_functions": f"cast(coalesce(fn.{y}_ones, 0) as bigint)" for x, y in (("complex", "complex"), ("long", "long"), ("cog_complex", "cog"), ("high_param", "param"))}),
    "fl": (f"(select count(*) as code_files, sum(case when lines > {LARGE_FILE} then 1 else 0 end) as large_files, sum(lines) as lines, sum(comments) as comments from @files where not is_dir and lang <> '' and lang <> 'unknown')", {"code_files": "fl.code_files", "large_files": "cast(coalesce(fl.large_files, 0) as bigint)", "comment_ratio": "case when coalesce(fl.lines, 0) = 0 then null else fl.comments / cast(fl.lines as double) end"}),
    "re": (f"(select t.total, dead.n as dead, dup.n as dup from (select count(*) as total from @functions) t cross join (select count(*) as n from ({DEAD}) x) dead cross join (select coalesce(sum(n), 0) as n from ({DUPLICATES}) y) dup)", {"dead_functions": "cast(re.dead as bigint)", "duplicate_functions": "cast(re.dup as bigint)", "redundancy_ratio": "case when re.total = 0 then 0.0 else least(re.dead + re.dup, re.total) / cast(re.total as double) end"}),
    "ed": (f"(select coalesce(sum(imports), 0) as edges, coalesce(sum(case when from_module <> to_module then imports else 0 end), 0) as cross_edges from {_FLOWS})", {"total_import_edges": "ed.edges", "cross_module_edges": "cast(ed.cross_edges as bigint)"}),
    "lo": (f"(select coalesce(sum(imports), 0) as edges, coalesce(sum(case when {_LOOSE} then imports else 0 end), 0) as loose, coalesce(sum(case when {_LOOSE} then 1 else 0 end), 0) as pairs from {_FLOWS})", {"loose_pairs": "cast(lo.pairs as bigint)", "coupling_score": "case when lo.loose = 0 then 0.0 else lo.loose / cast(lo.edges as double) end"}),
    "god": (_GOD, {"god_files": "god.n"}),
    "hot": (_HOT, {"hotspot_files": "hot.n"}),
}
_OF = {column: piece for piece, (_, columns) in _PIECES.items() for column in columns} | {"modularity": "q", "equality": "g", "acyclicity": "cy", "depth": "de", "redundancy": "re"}


def _pieces_sql(pieces: tuple[str, ...]) -> str:
    """The health row as far as these pieces give it."""
    raw = [f"{e} as {c}" for p in pieces for c, e in _PIECES[p][1].items()]
    sql = f"select {', '.join(raw)} from {' cross join '.join(f'{_PIECES[p][0]} {p}' for p in pieces)}"
    scores = [f"{e} as {c}" for c, e in _SCORES.items() if _OF[c] in pieces]
    sql = f"select {', '.join(['*', *scores])} from ({sql}) raw"
    return f"select *, {_SIGNAL} as quality_signal from ({sql}) s" if len(scores) == len(_SCORES) else sql


def _pieces(text: str) -> tuple[str, ...]:
    """The pieces that give every column of the health row which a SELECT may mean; all if it takes whole rows."""
    words = set(re.findall(r"\w+", text))
    used = {_OF[w] for w in words & set(_OF)} | ({_OF[c] for c in _CAUSES} if "quality_signal" in words else set())
    return tuple(p for p in _PIECES if p in used) if used and not re.search(r"select \*|\.\*", text) else tuple(_PIECES)


_READ_OFTEN = ("files", "functions", "module_flows", "node_degrees")


def _health(pieces: tuple[str, ...]) -> tuple:
    op = SqlOp("health", _pieces_sql(pieces))
    names = tuple(relations_of(op.sql))

    def health(*frames: DataFrame) -> DataFrame:
        """One row: raw values, scores and the quality signal. Relations that are read several times are written once."""
        relations = {n: once(f) if n in _READ_OFTEN and op.sql.count(f"@{n}") > 1 else f for n, f in zip(names, frames, strict=True)}
        if "calls" in relations:
            relations["calls"] = relations["calls"].select("callee").distinct()
        return materialize(op.run(**relations))

    return health, names, HEALTH_SQL


def part_of_health(text: str) -> str:
    """The name of the health row as far as a SELECT reads it; a score by itself needs no other's relations."""
    pieces = _pieces(text)
    name = "health" if len(pieces) == len(_PIECES) else f"health_{'_'.join(pieces)}"
    RELATIONS.computed.setdefault(name, _health(pieces))
    return name


_CAUSES = tuple(_SCORES)
RELATIONS.computed |= {
    "import_graph": (import_graph, ("dependency_edges", "module_paths"), None),
    "levels": (levels, ("import_graph", "module_paths"), LEVELS_SQL),
    "upward": (upward, ("import_graph", "levels"), UPWARD_SQL),
    "import_dependants": (import_dependants, ("import_graph", "levels"), _DEPENDANTS_SQL),
    "import_surface": (import_surface, ("import_graph", "levels", "entry_points"), _SURFACE_SQL),
    "stable": (stable, ("module_flows",), _stable_sql(4)),
    "health": _health(tuple(_PIECES)),
}
RELATIONS.parts["health"] = part_of_health
RELATIONS.by_number |= {"import_graph"}

OPS: dict[str, SqlOp] = {
    "quality_signal": SqlOp("The five root-cause scores and their geometric mean with a floor of 0.01", f"select {', '.join(f'round({c}, 6) as {c}' for c in _CAUSES)}, round(quality_signal, 5) as quality_signal from @health"),
    "health_report": SqlOp("One row of counts, ratios and scores", "select code_files, total_functions, total_import_edges, cross_module_edges, cycle_count, max_depth, god_files, hotspot_files, complex_functions, long_functions, cog_complex_functions, high_param_functions, large_files, dead_functions, duplicate_functions, round(comment_ratio, 6) as comment_ratio, round(coupling_score, 6) as coupling_score, round(modularity_q, 6) as modularity_q, round(gini, 6) as gini, round(redundancy_ratio, 6) as redundancy_ratio, round(quality_signal, 5) as quality_signal from @health"),
    "module_metrics": SqlOp("Coupling to modules that aren't stable, its entropy by module pair scaled by coupling, depth and cycles", f"with c as (select from_module, to_module, count(*) as n from ({MODULE_EDGES}) e where from_module <> to_module and not exists (select 1 from @stable s where s.module = e.to_module) group by from_module, to_module), t as (select sum(n) as s, count(*) as pairs from c), b as (select coalesce(-sum(c.n / cast(t.s as double) * log2(c.n / cast(t.s as double))), 0) as bits, coalesce(max(t.pairs), 0) as pairs from c cross join t) select round(h.coupling_score, 6) as coupling_score, h.cross_module_edges, round(b.bits, 6) as entropy_bits, cast(b.pairs as bigint) as entropy_num_pairs, round(case when b.pairs > 1 then b.bits / log2(b.pairs) * least(1.0, h.coupling_score / {FULL_COUPLING}) else 0.0 end, 6) as entropy, h.max_depth, h.cycle_count from @health h cross join b"),
    "coupling_score": SqlOp("Cross-module edges to modules that are not stable, over all edges", "select h.cross_module_edges, (select count(*) from @stable) as stable_modules, round(h.coupling_score, 6) as coupling_score from @health h"),
    "import_levels": SqlOp("Component and level of each file of the import graph", "select path, scc, level from @levels"),
    "import_cycles": SqlOp("Components of more than one file of the import graph", "select scc as cycle_id, count(*) as size, SETJOIN(path) as members from @levels group by scc having count(*) > 1"),
    "arch_report": SqlOp("Levels, upward edges, the widest blast radius, the surface that entry points open, and the mean distance of modules that are no foundations", f"""
        select (select max(level) from @levels) as max_level, (select count(*) from @upward) as upward_violations, round((select count(*) from @upward) / cast(nullif(h.total_import_edges, 0) as double), 6) as upward_ratio, h.graph_files as total_graph_files, h.cycle_count,
               b.max_blast_radius, b.max_blast_file, s.n as attack_surface_files, case when h.graph_files = 0 then 0.0 else round(s.n / cast(h.graph_files as double), 6) end as attack_surface_ratio, d.avg_distance
        from @health h cross join (select coalesce(max(n), 0) as max_blast_radius, coalesce(min(case when first_n = n then path end), '') as max_blast_file from (select path, n, (select max(n) from @import_dependants) as first_n from @import_dependants) x) b
        cross join (select count(*) as n from @import_surface) s
        cross join (select coalesce(round(avg(distance), 6), 0.0) as avg_distance from ({DEGREE_OPS['main_sequence_distance'].sql}) m where not is_foundation) d"""),
    "mod_decl_filter": SqlOp("Import edges and those that aren't module declarations", "select (select count(*) from @import_edges) as import_edges, (select count(*) from @dependency_edges) as dependency_edges"),
}
