"""Degree, module and size metrics over files, functions and dependency edges."""

from __future__ import annotations

from ..plans.sqlops import SqlOp

#: Default thresholds.
CC_HIGH, FUNC_LENGTH, COG_HIGH, PARAM_HIGH, FAN_OUT, FAN_IN, LARGE_FILE = 15, 50, 15, 4, 15, 20, 500
STABLE_INSTABILITY, STABLE_FAN_IN, LEAST_HOTSPOT_INSTABILITY, FOUNDATION = 0.15, 3, 0.15, 0.30
#: Functions that frameworks call.
IMPLICIT_ENTRIES = ["main", "new", "default", "init", "setup", "teardown", "run", "start", "stop", "build", "configure", "register", "update", "draw", "render", "getDerivedStateFromError", "componentDidCatch", "serialize", "deserialize"]

#: Distinct edges of imports and calls; structural metrics leave out edges that only declare modules.
EDGES = "select from_file, to_file from @edges"
DEGREES = "select path, fan_out, fan_in from @degrees"
CODE = "select * from @files where not is_dir and lang <> '' and lang <> 'unknown'"
MODULE_EDGES = "select from_module, to_module, from_file, to_file from @module_edges"
DEAD = "select f.path, f.name, f.ln from @functions f where not f.is_public and not f.is_method and coalesce(f.same_file_ref_count, 0) <= 0 and f.name not in (" + ", ".join(f"'{x}'" for x in IMPLICIT_ENTRIES) + ") and not STARTS(f.name, 'test_') and not HAS(f.name, '::') and not HAS(f.path, 'test') and not exists (select 1 from @calls c where c.callee = f.name)"
DUPLICATES = "select bh, count(*) as n from @functions where bh is not null and bh <> 0 group by bh having count(*) > 1"
#: By distinct value, so the window runs over values, not over functions; without functions, lines of code files stand in.
GINI = f"""
    with f as (select coalesce(cc, 1) as v from @functions), l as (select lines as v from ({CODE}) z),
    x as (select v, count(*) as c from (select v from f where (select count(*) from f) > 1 union all select v from l where (select count(*) from f) <= 1) a group by v),
    w as (select v, c, sum(c) over (order by v rows between unbounded preceding and current row) as upto, sum(c) over () as n from x)
    select case when coalesce(max(n), 0) <= 1 or sum(v * c) <= 0 then 0.0 else greatest(0.0, least(1.0, cast(sum(v * c * (2 * upto - c - n)) as double) / (max(n) * cast(sum(v * c) as double)))) end as gini from w"""
MODULARITY = f"""
    with e as (select x.from_file, x.to_file, a.module as fm, b.module as tm from ({EDGES}) x join @module_paths a on a.path = x.from_file join @module_paths b on b.path = x.to_file),
    m as (select count(*) as m, sum(case when fm = tm then 1 else 0 end) as inside from e),
    o as (select fm as module, count(*) as k from e group by fm), i as (select tm as module, count(*) as k from e group by tm),
    x as (select cast(coalesce(sum(o.k * i.k), 0) as double) as s from o join i on o.module = i.module)
    select case when m.m = 0 then 1.0 else greatest(-0.5, least(1.0, (m.inside - x.s / m.m) / m.m)) end as q from m cross join x"""


def _over(column: str, limit: int) -> str:
    return f"select path as file, name as func, {column} as value from @functions where {column} > {limit}"


def _entropy(values: str) -> str:
    """Normalized Shannon entropy of the column v of ``values``."""
    return f"(select case when count(*) <= 1 or sum(v) <= 0 then 0.0 else (select -sum(case when x.v > 0 then x.v / t.s * log2(x.v / t.s) else 0 end) / log2(max(t.n)) from ({values}) x cross join (select sum(v) as s, count(*) as n from ({values}) y) t) end from ({values}) z)"


OPS: dict[str, SqlOp] = {
    "edge_distinct": SqlOp("Import edges without repeats", "select distinct from_file, to_file from @import_edges"),
    "edge_weight": SqlOp("Line pairs by (from, to), self loops removed", "select a.k as from_k, b.k as to_k, count(*) as weight from @line_positions a join @line_positions b on a.commit_id = b.commit_id and b.pos = a.pos + 1 where a.k <> b.k group by a.k, b.k"),
    "structural_graph": SqlOp("Distinct adjacency with its basis: import, call or both", "select from_file, to_file, case when count(distinct b) = 2 then 'mixed' else max(b) end as basis from (select from_file, to_file, 'import' as b from @import_edges union all select from_file, to_file, 'call' from @call_edges) e group by from_file, to_file"),
    "fan_in_out": SqlOp("Distinct neighbours over imports and calls", DEGREES),
    "god_files": SqlOp("Fan-out over the limit, neither entry points nor barrels", f"select d.path, d.fan_out as value from ({DEGREES}) d join @files f on f.path = d.path where d.fan_out > {FAN_OUT} and not f.is_barrel and not exists (select 1 from @entry_points p where p.file = d.path)"),
    "fan_hotspots": SqlOp("Fan-in over the limit and not stable, no barrels", f"select d.path, d.fan_in as value from ({DEGREES}) d join @files f on f.path = d.path where d.fan_in > {FAN_IN} and not f.is_barrel and d.fan_out / cast(d.fan_in + d.fan_out as double) >= {LEAST_HOTSPOT_INSTABILITY}"),
    "instability_top10": SqlOp("The ten least stable files of the import graph, tests left out", f"select n.path, round(case when d.fan_in + d.fan_out > 0 then d.fan_out / cast(d.fan_in + d.fan_out as double) else 0.5 end, 6) as instability, d.fan_in, d.fan_out from (select from_file as path from @dependency_edges union select to_file from @dependency_edges) n join ({DEGREES}) d on d.path = n.path join @files f on f.path = n.path where not f.is_test order by instability desc, n.path limit 10"),
    "fn_threshold_scan": SqlOp("Functions over any threshold, with the measure", f"select path as file, name as func, 'cc' as measure, cc as value from @functions where cc > {CC_HIGH} union all select path, name, 'ln', ln from @functions where ln > {FUNC_LENGTH} union all select path, name, 'cog', cog from @functions where cog > {COG_HIGH} union all select path, name, 'pc', pc from @functions where pc > {PARAM_HIGH}"),
    "complex_functions": SqlOp("Cyclomatic complexity over the limit", _over("cc", CC_HIGH)),
    "long_functions": SqlOp("Length over the limit", _over("ln", FUNC_LENGTH)),
    "cog_complex_functions": SqlOp("Cognitive complexity over the limit", _over("cog", COG_HIGH)),
    "high_param_functions": SqlOp("More parameters than the limit", _over("pc", PARAM_HIGH)),
    "all_function_ccs": SqlOp("Complexity of every function that has one", "select path as file, name as func, cc as value from @functions where cc is not null"),
    "all_file_lines": SqlOp("Lines of files in known languages", f"select path, lines as value from ({CODE}) f"),
    "comment_ratio": SqlOp("Comment lines over lines; null without lines", f"select round(sum(comments) / cast(nullif(sum(lines), 0) as double), 6) as comment_ratio from ({CODE}) f"),
    "large_files": SqlOp("Files over the line limit", f"select path, lines as value from ({CODE}) f where lines > {LARGE_FILE}"),
    "large_file_ratio": SqlOp("Count of large files and their share of code files", f"select cast(coalesce(sum(case when lines > {LARGE_FILE} then 1 else 0 end), 0) as bigint) as large_files, case when count(*) = 0 then 0.0 else round(sum(case when lines > {LARGE_FILE} then 1 else 0 end) / cast(count(*) as double), 6) end as ratio from ({CODE}) f"),
    "duplicate_groups": SqlOp("Groups of functions with one body, by size", f"select n as instances, SETJOIN(f.path || ':' || f.name) as members from ({DUPLICATES}) d join @functions f on f.bh = d.bh group by d.bh, n"),
    "duplicate_texts": SqlOp("Texts that are equal but for white space", "select count(*) as instances, count(distinct path) as places, min(func) as first_id, max(ln) as longest from @body_groups group by body having count(*) > 1"),
    "dead_functions": SqlOp("Private functions that nothing calls or refers to", f"select path as file, name as func, ln as value from ({DEAD}) d"),
    "total_functions": SqlOp("Number of functions", "select count(*) as total_functions from @functions"),
    "cross_module_entropy_raw": SqlOp("Entropy of (from, to) module pairs over cross edges, no stable set", f"with c as (select from_module, to_module, count(*) as n from ({MODULE_EDGES}) e where from_module <> to_module group by from_module, to_module), t as (select sum(n) as s, count(*) as pairs from c) select max(t.pairs) as pairs, round(coalesce(-sum(c.n / cast(t.s as double) * log2(c.n / cast(t.s as double))), 0), 6) as bits, case when max(t.pairs) > 1 then round(-sum(c.n / cast(t.s as double) * log2(c.n / cast(t.s as double))) / log2(max(t.pairs)), 6) else 0.0 end as normalized from c cross join t"),
    "avg_cohesion": SqlOp("Mean over modules of distinct inner edges over files less one, at most 1", f"with n as (select module, count(*) as n from @files where not is_test and lang <> '' group by module having count(*) >= 2), i as (select a.module, count(*) as e from ({EDGES}) x join @module_paths a on a.path = x.from_file join @module_paths b on b.path = x.to_file where a.module = b.module group by a.module) select round(avg(least(1.0, coalesce(i.e, 0) / cast(n.n - 1 as double))), 6) as avg_cohesion from n left join i on i.module = n.module"),
    "modularity_q": SqlOp("Directed Newman modularity over distinct edges; 1 without edges", f"select round(q, 6) as q from ({MODULARITY}) m"),
    "complexity_gini": SqlOp("Gini coefficient of function complexity", f"select round(gini, 6) as gini from ({GINI}) g"),
    "redundancy_ratio": SqlOp("Dead and duplicate functions over all, at most 1", f"with d as (select count(*) as n from ({DEAD}) x), u as (select coalesce(sum(n), 0) as n from ({DUPLICATES}) y), t as (select count(*) as n from @functions) select case when t.n = 0 then 0.0 else round(least(d.n + u.n, t.n) / cast(t.n as double), 6) end as redundancy_ratio from d cross join u cross join t"),
    "structural_entropy": SqlOp("Mean normalized entropy of file lines and function complexity", f"with s as (select cast(lines as double) as v from ({CODE}) f), c as (select cast(cc as double) as v from @functions where cc is not null and lang <> 'unknown'), st as (select sum(v) as s, count(*) as n from s), ct as (select sum(v) as s, count(*) as n from c), se as (select -sum(case when v > 0 then v / st.s * log2(v / st.s) else 0 end) / log2(max(st.n)) as h from s cross join st), ce as (select -sum(case when v > 0 then v / ct.s * log2(v / ct.s) else 0 end) / log2(max(ct.n)) as h from c cross join ct) select round((se.h + ce.h) / 2, 6) as structural_entropy from se cross join ce"),
    "main_sequence_distance": SqlOp("Abstractness, instability and distance from the main sequence of each module", f"with m as (select module, count(*) as n, sum(case when k % 3 = 0 then 1 else 0 end) as abstracts from @files group by module), e as (select distinct from_module, to_module from ({MODULE_EDGES}) x where from_module <> to_module), o as (select from_module as module, count(*) as n from e group by from_module), i as (select to_module as module, count(*) as n from e group by to_module), v as (select m.module, m.abstracts / cast(m.n as double) as a, case when coalesce(o.n, 0) + coalesce(i.n, 0) = 0 then 0.5 else coalesce(o.n, 0) / cast(coalesce(o.n, 0) + coalesce(i.n, 0) as double) end as i from m left join o on o.module = m.module left join i on i.module = m.module) select module, round(a, 6) as abstractness, round(i, 6) as instability, round(abs(a + i - 1), 6) as distance, i <= {FOUNDATION} as is_foundation from v"),
    "call_containment": SqlOp("Each call's innermost function by line range", "select path, callee, line, func from (select c.path, c.callee, c.line, f.name as func, row_number() over (partition by c.path, c.callee, c.line order by f.el - f.sl, f.sl, f.name) as rk from @calls c join @functions f on f.path = c.path and c.line between f.sl and f.el) x where rk = 1"),
    "dir_rollup": SqlOp("Sums of all files below each directory, at any depth", "select dir, count(*) as files, cast(sum(lines) as bigint) as lines, cast(sum(logic) as bigint) as logic, cast(sum(comments) as bigint) as comments, cast(sum(blanks) as bigint) as blanks from (select dir, lines, logic, comments, blanks from @files UNNEST(PREFIXES(DIR(path), '/', '/'), u, dir) where HAS(path, '/')) d group by dir"),
    "flatten_tree": SqlOp("The files of the tree, without directories", "select path, lang, lines from @files where not is_dir"),
    "call_edge_join": SqlOp("Calls to functions of imported files of the same language, unless a call has over 3 targets", "with t as (select distinct c.path as from_file, c.func as from_func, c.callee, f.path as to_file, f.name as to_func from @calls c join @import_edges e on e.from_file = c.path join @functions f on f.path = e.to_file and f.name = c.callee join @files a on a.path = c.path and a.lang = f.lang where f.path <> c.path), n as (select *, count(*) over (partition by from_file, from_func, callee) as targets from t) select distinct from_file, from_func, to_file, to_func from n where targets <= 3"),
    "inherit_edge_join": SqlOp("Classes and their bases in imported files", "select distinct c.path as child_file, c.name as child_class, b.path as parent_file, b.name as parent_class from @classes c join @classes b on b.name = c.base and b.path <> c.path join @import_edges e on e.from_file = c.path and e.to_file = b.path"),
    "test_cover_direct": SqlOp("Sources that each test imports", "select t.path as test_file, count(distinct s.path) as n, SETJOIN(s.path) as sources from @import_edges e join @files t on t.path = e.from_file and t.is_test join @files s on s.path = e.to_file and not s.is_test group by t.path"),
    "fan_thresholds_by_lang": SqlOp("Degrees against the limits of the language", f"select f.lang, count(*) as files, cast(sum(case when d.fan_out > {FAN_OUT} then 1 else 0 end) as bigint) as over_out, cast(sum(case when d.fan_in > {FAN_IN} then 1 else 0 end) as bigint) as over_in from ({DEGREES}) d join @files f on f.path = d.path group by f.lang"),
}

#: For Spark the classes of imported files only: a class name with the bases of that name would be all pairs of the files that share it.
INHERITED = SqlOp("Classes and their bases in imported files", "select distinct c.path as child_file, c.name as child_class, b.path as parent_file, b.name as parent_class from @import_edges e join @classes c on c.path = e.from_file join @classes b on b.path = e.to_file and b.name = c.base where b.path <> c.path")

#: name: (operator, its relations in order, None, as DuckDB gets the SELECT)
COMPUTED = {"inherit_edge_join": (lambda e, c: INHERITED.run(import_edges=e, classes=c), ("import_edges", "classes"), None)}
