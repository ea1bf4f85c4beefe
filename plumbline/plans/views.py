"""The engine's relations over the driver's star schema, so every operator has data to run on.

An order is a commit and its lines are the changed files; a part is a file with functions; lines that
follow each other in an order are dependencies. See the comments of each view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .sqlops import Relations, SqlOp, pairs_of, relations_of, with_pairs

#: Files that declare modules.
MODULE_FILES = ["mod.rs", "lib.rs", "main.rs"]

#: The one clock of all ages and expiries: a fixed now within the dates of the test data.
NOW = 902_000_000
TODAY = "1998-08-01"

VIEWS: dict[str, str] = {
    # One path a part: some are barrels, some are tests.
    "paths": """
        select p_partkey as k, p_size as size, p_brand as brand,
               case when p_partkey % 23 = 0 then 'src/' || lower(replace(p_brand, '#', '')) || '/x' || cast(p_partkey as string) || '/index.ts'
                    when p_partkey % 11 = 0 then 'src/' || lower(replace(p_brand, '#', '')) || '/f' || cast(p_partkey as string) || '.test.ts'
                    when p_partkey % 17 = 0 then 'src/' || lower(replace(p_brand, '#', '')) || '/api/deep/f' || cast(p_partkey as string) || '.ts'
                    else 'src/' || lower(replace(p_brand, '#', '')) || '/f' || cast(p_partkey as string) || '.ts' end as path
        from @part""",
    "module_paths": """
        select k, size, path,
               case when not HAS(path, '/') then path
                    when split_part(path, '/', 3) = '' then split_part(path, '/', 1)
                    when split_part(path, '/', 4) = '' then split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
                    else split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) end as module,
               HAS(path, '.test.') as is_test, ENDS(path, '/index.ts') as is_barrel
        from @paths""",
    "files": """
        select k, path, module, is_test, is_barrel, case when size % 13 = 0 then 'unknown' else 'typescript' end as lang, false as is_dir,
               cast(size * 20 as bigint) as lines, cast(size * (k % 5) as bigint) as comments, cast(size * 2 as bigint) as blanks,
               cast(size * 20 - size * (k % 5) - size * 2 as bigint) as logic
        from @module_paths""",
    "functions": """
        select f.path, f.module, f.is_test, f.lang, 'fn' || cast((f.k * 7 + f.i) % 400 as string) as name, cast(f.i * 30 as bigint) as sl, cast(f.i * 30 + (f.k * f.i) % 90 as bigint) as el,
               cast((f.k * f.i) % 90 + 1 as bigint) as ln, case when (f.k + f.i) % 9 = 0 then null else cast((f.k * f.i + f.lines) % 40 as bigint) end as cc,
               cast((f.k * 3 + f.i) % 33 as bigint) as cog, cast((f.k + f.i) % 8 as bigint) as pc, case when f.k % 4 = 0 then cast(0 as bigint) else cast((f.k % (case when f.i = 3 then 74 else 37 end)) * 10 + f.i as bigint) end as bh,
               (f.k + f.i) % 7 = 0 as is_public, (f.k + f.i) % 5 = 0 as is_method, cast((f.k * f.i) % 6 - 3 as bigint) as same_file_ref_count
        from (select * from @files UNNEST(LIST(1, 2, 3), u, i)) f""",
    "calls": "select path, name as func, 'fn' || cast((cast(substr(name, 3) as bigint) * 2) % 400 as string) as callee, sl + 1 as line from @functions",
    "classes": "select path, 'Class' || cast(k % 60 as string) as name, 'Class' || cast((k * 5) % 60 as string) as base from @files",
    # Positions of an order's lines; l_linenumber repeats within an order.
    "line_positions": """
        select l_orderkey as commit_id, l_partkey as k, cast(l_quantity as bigint) as added, cast(floor(l_discount * 100) as bigint) as removed,
               cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as pos
        from @lineitem""",
    "commits": "select o_orderkey as commit_id, 'a' || cast(o_custkey % 97 as string) as author, EPOCH(o_orderdate) as epoch, cast(1 as bigint) as parents from @orders",
    "commit_files": """
        select l.commit_id, p.path, min(l.pos) as pos, cast(sum(l.added) as bigint) as added, cast(sum(l.removed) as bigint) as removed
        from @line_positions l join @paths p on p.k = l.k group by l.commit_id, p.path""",
    "known_files": "select path from @files where not is_test",
    # Lines that follow each other. Files of some numbers are above the others: their edges lead to smaller ones of them or down, so they are on no cycle.
    "import_pairs": """
        select distinct case when down then a_k else b_k end as a_k, case when down then b_k else a_k end as b_k
        from (select a_k, b_k, case when ra <> rb then ra > rb when ra > 0 then a_k > b_k else true end as down
              from (select a_k, b_k, case when a_k % 18 = 0 then 1 else 0 end as ra, case when b_k % 18 = 0 then 1 else 0 end as rb
                    from (select distinct a.k as a_k, b.k as b_k from @line_positions a join @line_positions b on a.commit_id = b.commit_id and b.pos = a.pos + 1 where a.k <> b.k) x) y) z""",
    "import_edges": "select p.path as from_file, q.path as to_file from @import_pairs e join @paths p on p.k = e.a_k join @paths q on q.k = e.b_k",
    "call_edges": """
        select distinct p.path as from_file, q.path as to_file
        from @line_positions a join @line_positions b on a.commit_id = b.commit_id and b.pos = a.pos + 2 join @paths p on p.k = a.k join @paths q on q.k = b.k
        where a.k <> b.k""",
    # Specifiers that lead to the imported file: relative within a directory, else by alias, by path or by suffix; and some that lead nowhere.
    "specifiers": """
        select from_file as file, to_file as made_from, case when DIR(from_file) = DIR(to_file) then './' || regexp_replace(NAME(to_file), '[.]ts$', '') when n % 3 = 0 then '@/' || substr(m, 5) when n % 3 = 1 then m else substr(m, 5) end as spec
        from (select from_file, to_file, length(to_file) + length(from_file) as n, case when ENDS(to_file, '/index.ts') then DIR(to_file) else regexp_replace(to_file, '[.]ts$', '') end as m from @import_edges) e
        union all select path, path, case when k % 2 = 0 then 'library' || cast(k % 50 as string) else 'lib/x' || cast(k % 50 as string) end from @files where k % 5 = 0""",
    # Import edges without those by which a module file declares its own directory or one a level below.
    "dependency_edges": f"""
        select from_file, to_file from (select from_file, to_file, DIR(from_file) as a, DIR(to_file) as b, NAME(from_file) as n from @import_edges) e
        where not (n in ({', '.join(f"'{x}'" for x in MODULE_FILES)}) and a <> '' and (a = b or (STARTS(b, a || '/') and not HAS(substr(b, length(a) + 2), '/'))))""",
    "edges": "select from_file, to_file from @dependency_edges union select from_file, to_file from @call_edges",
    "degrees": """
        select coalesce(o.path, i.path) as path, coalesce(o.n, 0) as fan_out, coalesce(i.n, 0) as fan_in
        from (select from_file as path, count(*) as n from @edges group by from_file) o full outer join (select to_file as path, count(*) as n from @edges group by to_file) i on o.path = i.path""",
    "module_edges": "select a.module as from_module, b.module as to_module, e.from_file, e.to_file from @dependency_edges e join @module_paths a on a.path = e.from_file join @module_paths b on b.path = e.to_file",
    "entry_points": "select path as file from @files where k % 50 = 1",
    # Out-degree of at most one: long chains and cycles.
    "chain_edges": """
        select a.path as from_file, b.path as to_file from @paths a cross join (select count(*) as n from @part) c join @paths b on b.k = (a.k * 7 + a.size) % c.n where a.k <> b.k""",
    "dag_edges": "select a.path as from_file, b.path as to_file from @paths a join @paths b on b.k = IDIV(a.k, 2) where a.k <> b.k",
    # A tree, and pairs of files that stand by themselves.
    "island_edges": """
        select a.path as from_file, b.path as to_file from @paths a join @paths b on b.k = IDIV(a.k, 2) where a.k % 30 not in (10, 11) and b.k % 30 not in (10, 11)
        union all select a.path, b.path from @paths a join @paths b on b.k = a.k + 1 where a.k % 30 = 10
        union all select b.path, a.path from @paths a join @paths b on b.k = a.k + 1 where a.k % 60 = 10""",
    "contents": """
        select path, repeat('await x; ', cast(k % 8 as int)) || repeat('store.dispatch(a); ', cast(k % 4 as int)) || case when k % 3 = 0 then '// setTimeout( in a comment' || chr(10) else 'setTimeout(f); ' end
               || case when k % 5 = 0 then 'const s = ' || chr(39) || 'it' || chr(92) || chr(39) || ' spawn(' || chr(39) || ';' when k % 5 = 1 then '/* retry( ' || chr(10) || ' */ retry(g);' when k % 5 = 2 then 'let q = "exec(" + `a' || chr(10) || 'emit(`;' else 'try { spawn(x) } catch (e) {}' end as contents
        from @files""",
    # Modules 1 to 4 depend on 0, 5 to 9 on 1, and so on.
    "module_tree": "select distinct 'm' || cast(k % 50 as string) as from_module, 'm' || cast(IDIV(k % 50, 5) as string) as to_module from @paths where k % 50 > 0",
    "rounds": """
        select user_id as session, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as idx, event_type as action, value,
               case when value > 50 then 'fail' when value > 20 then 'warn' else 'pass' end as gate
        from @events""",
    "body_groups": "select lower(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), '')) as body, source as path, doc_id as func, n_chars as ln from @documents where length(text) >= 20",
    "verdicts": """
        select d.source as signal, d.doc_id, d.doc_id as idx,
               case when l.quality = 1 and l.toxic = 0 then 'tp' when l.toxic = 1 then 'fp' when d.n_chars % 2 = 0 then 'acceptable' else 'inconclusive' end as category
        from @labels l join @documents d on d.doc_id = l.doc_id""",
    "trials": """
        select event_id, user_id, event_type as signal, case when user_id % 3 = 0 then 'live' else 'replay' end as lane,
               case user_id % 4 when 0 then 'no_intervention' when 1 then 'fix_first' when 2 then 'report_only' else 'full' end as arm,
               value > 30 as presented, value > 60 as top, value > 80 as cleared, value > 90 as regressed, cast(event_id % 7 as double) as checks,
               case when event_id % 19 = 0 then 'failed' else 'completed' end as status, event_id % 3 > 0 as final_clean, case event_id % 5 when 0 then 'thrashing' when 1 then 'stalled' else 'converging' end as convergence
        from @events""",
    # One row a rule set; limits are data.
    "constraints": "select cast(0.6 as double) as min_quality, cast(0.9 as double) as min_modularity, cast(0.9 as double) as min_acyclicity, cast(1.0 as double) as min_depth, cast(0.95 as double) as min_equality, cast(0.9 as double) as min_redundancy, cast(0.35 as double) as max_coupling_score, cast(0 as bigint) as max_cycles, cast(35 as bigint) as max_cc, cast(900 as bigint) as max_file_lines, cast(80 as bigint) as max_fn_lines, true as no_god_files, cast(0 as bigint) as max_upward_violations from @region where r_regionkey = 0",
    "layers": "select * from (values ('ui', 'src/brand1/**', 0, 0), ('core', 'src/brand3/**', 1, 0), ('core', 'src/brand41/*', 1, 1), ('base', 'src/brand5/**', 2, 0)) l(layer, pattern, ord, nth)",
    "boundaries": "select * from (values ('src/brand1/**', 'src/brand2/**', 'one must not use two'), ('src/brand21/**', 'src/brand22/*', 'flat'), ('src/brand41/**/*', '*.test.ts', 'no tests')) b(from_glob, to_glob, reason)",
    "module_contracts": "select * from (values ('brands', 'src', true), ('loose', 'src/brand11', false)) c(id, root, forbid)",
    "contract_api": "select * from (values ('brands', 'f100.ts'), ('brands', 'api/deep/f17.ts'), ('loose', 'index.ts')) a(id, file_name)",
    "structural_baseline": "select cast(0.30 as double) as quality_signal, cast(0.5 as double) as coupling_score, cast(0 as bigint) as cycle_count, cast(1000 as bigint) as god_file_count, cast(10 as bigint) as complex_fn_count from @region where r_regionkey = 0",
    "domains": "select 'orderpriority' as domain, o_orderpriority as variant from @orders group by o_orderpriority union all select 'mktsegment', c_mktsegment from @customer group by c_mktsegment",
    "sites": """
        select distinct 'orderpriority' as domain, 'customer' || cast(o_custkey as string) as site, o_orderpriority as variant from @orders
        union all select distinct 'mktsegment', 'nation' || cast(c_nationkey as string) || '/' || cast(c_custkey % 41 as string), c_mktsegment from @customer""",
    "writes": "select 'store.' || lower(n.n_name) as symbol, f.path, cast(s.s_suppkey as bigint) as line from @supplier s join @nation n on n.n_nationkey = s.s_nationkey join @files f on f.k = s.s_suppkey",
    "reads": "select 'store.' || lower(n.n_name) || '.field' as symbol, f.path, cast(c.c_custkey as bigint) as line from @customer c join @nation n on n.n_nationkey = c.c_nationkey join @files f on f.k = c.c_custkey",
    "concepts": "select lower(r_name) as concept, case when r_regionkey % 2 = 0 then 'critical' else 'normal' end as priority, r_regionkey as rk from @region",
    "concept_targets": "select c.concept, 'store.' || lower(n.n_name) as target, n.n_nationkey as nk from @concepts c join @nation n on n.n_regionkey = c.rk",
    "allowed_writers": "select c.concept, 'src/brand' || cast(c.rk + 1 as string) || '/**' as pattern, false as forbidden from @concepts c where c.rk <> 4 union all select c.concept, 'src/brand' || cast(c.rk + 2 as string) || '1/*', true from @concepts c",
    "findings": """
        select 'f' || cast(p_partkey as string) as key, case p_partkey % 4 when 0 then 'large_file' when 1 then 'dependency_sprawl' when 2 then 'clone_family' else 'cycle_cluster' end as kind,
               case when p_size >= 35 then 'high' when p_size >= 15 then 'medium' else 'low' end as severity, p_brand as concept, 'src/' || lower(replace(p_brand, '#', '')) || '/f' || cast(p_partkey as string) || '.ts' as file,
               cast((p_size * 200 + p_partkey) % 10001 as bigint) as score, case p_partkey % 5 when 0 then 'experimental' when 1 then 'watchpoint' else 'trusted' end as trust, p_brand as scope
        from @part""",
    "baseline_findings": "select * from @findings where score % 3 <> 0 union all select 'gone' || key, kind, severity, concept, file, score, trust, scope from @findings where score % 11 = 0",
    "file_hashes": "select path, lines * 31 + comments as hash from @files where k % 7 <> 0",
    "baseline_hashes": "select path, lines * 31 + case when k % 5 = 0 then comments + 1 else comments end as hash from @files where k % 6 <> 0",
    "suppressions": "select * from (values ('large_file', null, 'src/brand1/**', '1998-01-01'), ('*', null, 'src/brand21/*', '2999-01-01'), ('cycle_cluster', 'Brand#13', null, null), ('*', 'Brand#22', 'src/brand22/**/*', '1998-08-01'), ('clone_family', null, 'src/brand31', null), ('clone_family', 'Brand#41', '*.py', null)) s(kind, concept, file_glob, expires)",
    "samples": "select cast(l_orderkey % 5 as bigint) as sample, 'metric' || cast(l_linenumber as string) as metric, cast(sum(l_quantity) as double) as elapsed from @lineitem group by 1, 2",
    "file_events": "select EPOCH(ts) as ts, event_id, user_id, 'src/u' || cast(user_id % 40 as string) || '.ts' as path, event_type as kind from @events",
}


def next_lines(lineitem: DataFrame) -> DataFrame:
    """(k, first, second): each line's part and those of the next two lines of its order, by one sort of the lines."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    after = [F.lead("l_partkey", n).over(w).alias(name) for n, name in ((1, "first"), (2, "second"))]
    return lineitem.filter("l_orderkey is not null").select(F.col("l_partkey").alias("k"), *after)


_PAIRED = "select a.k as a_k, b.k as b_k from @line_positions a join @line_positions b on a.commit_id = b.commit_id and b.pos = a.pos + {0} where a.k <> b.k"
_NEXT = "select k as a_k, {0} as b_k from @next_lines where k <> {0}"


def _by_next(view: str, change, pairs: str) -> tuple:
    """A view of lines that follow each other, for Spark over ``next_lines`` in place of a join of positions with themselves; ``pairs``: its rows by number (a_k, b_k), with repeats and with numbers that no file has."""
    op = SqlOp(view, change(VIEWS[view]))
    names = relations_of(op.sql)

    def made(*frames: DataFrame) -> DataFrame:
        frames = dict(zip(names, frames, strict=True))
        return with_pairs(op.run(**frames), SqlOp("pairs", pairs).run(next_lines=frames["next_lines"]))

    return made, tuple(names), VIEWS[view]


def _on_pairs(view: str) -> tuple:
    """A view whose first relation brings its pairs by number."""
    op = SqlOp(view, VIEWS[view])
    names = relations_of(op.sql)
    return lambda *frames: with_pairs(op.run(**dict(zip(names, frames, strict=True))), pairs_of(frames[0])), tuple(names), VIEWS[view]


def by_number(module_paths: DataFrame) -> bool:
    """Whether files and their numbers are one to one and no file declares modules, so that edges are the same by number as by name. Looked up once a relation."""
    if "k" not in module_paths.columns:
        return False
    if not hasattr(module_paths, "_plumbline_one_to_one"):
        # Paths whose hashes differ differ; where two share one, names are used.
        files = module_paths.select("k", F.xxhash64("path").alias("h"), F.col("path").isNull().alias("none"), F.substring_index("path", "/", -1).isin(MODULE_FILES).alias("declares"))
        found = files.agg(F.count("*").alias("n"), F.count_distinct("k").alias("k"), F.count_distinct("h").alias("p"), F.count_if(F.col("none") | F.col("declares")).alias("bad")).first()
        module_paths._plumbline_one_to_one = found["n"] == found["k"] == found["p"] and not found["bad"]
    return module_paths._plumbline_one_to_one


def _pairs(sql: str) -> str:
    inner = _PAIRED.format(1).replace("select ", "select distinct ", 1)
    assert inner in sql
    return sql.replace(inner, _NEXT.format("first"))


def _calls(sql: str) -> str:
    joined = "from @line_positions a join @line_positions b on a.commit_id = b.commit_id and b.pos = a.pos + 2 join @paths p on p.k = a.k join @paths q on q.k = b.k\n        where a.k <> b.k"
    assert joined in sql
    return sql.replace(joined, f"from ({_NEXT.format('second')}) a join @paths p on p.k = a.a_k join @paths q on q.k = a.b_k")


#: Each file's next number is worked out before the join: with the count beside two tables of files, Spark would form all pairs of them.
_CHAIN = """
    select a.path as from_file, b.path as to_file
    from (select p.path, p.k, (p.k * 7 + p.size) % c.n as next from @paths p cross join (select count(*) as n from @part) c) a join @paths b on b.k = a.next where a.k <> b.k"""

_RAW_PAIRS = _pairs(VIEWS["import_pairs"]).replace("select distinct", "select")
_RAW_CALLS = _NEXT.format("second")

#: Distinct neighbours with the number of import edges between them, so that imports and all edges are joined and counted at once.
_ADJACENCY = """
    select from_file, to_file, cast(sum(n) as bigint) as imports
    from (select from_file, to_file, 1 as n from @dependency_edges union all select from_file, to_file, 0 from @call_edges) e group by from_file, to_file"""
#: Degrees in one grouping, and how many imports lead to a file; a missing path stands for itself on either side, as in a full join.
_NODE_DEGREES = """
    select path, sum(1 - end_) as fan_out, sum(end_) as fan_in, sum(end_ * imports) as imported
    from (select case when end_ = 0 then from_file else to_file end as path, end_, imports from @adjacency UNNEST(LIST(0, 1), u, end_)) e group by path, case when path is null then end_ end"""
#: Edges and imports from module to module.
_MODULE_FLOWS = """
    select a.module as from_module, b.module as to_module, count(*) as edges, cast(sum(e.imports) as bigint) as imports
    from @adjacency e join @module_paths a on a.path = e.from_file join @module_paths b on b.path = e.to_file group by a.module, b.module"""

#: The same over the pairs of ``adjacency`` by number; a module goes by the smallest number of its files until flows are counted.
_NUMBERED_FLOWS = """
    with f as (select m.k, n.id from @module_paths m join (select module, min(k) as id from @module_paths group by module) n on n.module <=> m.module),
    e as (select a_k, b_k, max(imports) as imports from @pairs group by a_k, b_k),
    c as (select /*+ shuffle_hash(a), shuffle_hash(b) */ a.id as x, b.id as y, count(*) as edges, cast(sum(e.imports) as bigint) as imports from e join f a on a.k = e.a_k join f b on b.k = e.b_k group by a.id, b.id)
    select a.module as from_module, b.module as to_module, c.edges, c.imports from c join @module_paths a on a.k = c.x join @module_paths b on b.k = c.y"""


def adjacency(dependency_edges: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Distinct neighbours with the number of imports between them, and the pairs (a_k, b_k, imports) of both by number, with repeats."""
    made = SqlOp("adjacency", _ADJACENCY).run(dependency_edges=dependency_edges, call_edges=call_edges)
    imports, calls = pairs_of(dependency_edges), pairs_of(call_edges)
    both = imports.withColumn("imports", F.lit(1)).unionByName(calls.withColumn("imports", F.lit(0))) if imports is not None and calls is not None else None
    return with_pairs(made, both)


def module_flows(adjacency: DataFrame, module_paths: DataFrame) -> DataFrame:
    """Edges and imports from module to module."""
    pairs = pairs_of(adjacency)
    if pairs is not None and by_number(module_paths):
        return SqlOp("module_flows", _NUMBERED_FLOWS).run(pairs=pairs, module_paths=module_paths)
    return SqlOp("module_flows", _MODULE_FLOWS).run(adjacency=adjacency, module_paths=module_paths)


def _spark(sql: str, view: str | None = None) -> tuple:
    """A relation by a SELECT of Spark's own; DuckDB gets the view of that name, if there is one."""
    op = SqlOp(view or "relation", sql)
    return lambda *frames: op.run(**dict(zip(relations_of(op.sql), frames, strict=True))), tuple(relations_of(op.sql)), VIEWS[view] if view else None


#: Relations that need a kernel are added by ``operators.health``.
#: Dependencies and the positions that they come from are written once where a query reads them several times.
RELATIONS = Relations(
    VIEWS,
    {
        "next_lines": (next_lines, ("lineitem",), None), "import_pairs": _by_next("import_pairs", _pairs, _RAW_PAIRS), "call_edges": _by_next("call_edges", _calls, _RAW_CALLS),
        "import_edges": _on_pairs("import_edges"), "dependency_edges": _on_pairs("dependency_edges"),
        "adjacency": (adjacency, ("dependency_edges", "call_edges"), None), "node_degrees": _spark(_NODE_DEGREES), "module_flows": (module_flows, ("adjacency", "module_paths"), None),
        "chain_edges": _spark(_CHAIN, "chain_edges"), "edges": _spark("select from_file, to_file from @adjacency", "edges"), "degrees": _spark("select path, fan_out, fan_in from @node_degrees", "degrees"),
    },
    written=frozenset({"line_positions", "next_lines", "import_pairs", "layer_of", "own_roles", "role_tags", "import_edges", "call_edges", "dependency_edges", "adjacency", "node_degrees", "module_flows", "module_edges"}),
)
RELATIONS.by_number |= {"module_flows"}
RELATIONS.hands_on |= {"adjacency"}
