"""Concept boundaries, contracts, session clones, inferred rules, shape and coverage, and conditions as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import materialize
from ..plans.sqlops import SqlOp
from ..plans.views import NOW, RELATIONS
from . import kernels as K
from .findings import _OBLIGATION, _READS, _WRITES
from .globs import glob_hits, glob_sql

CONFIDENT = 7000
_CHANGED = "select a.path from @file_hashes a left join @baseline_hashes b on a.path = b.path where b.path is null or a.hash <> b.hash"
_USES = f"select concept, path from ({_READS}) r union select concept, path from ({_WRITES}) w"
_BYPASS = f"""select distinct c.concept, case when c.priority = 'critical' then 'high' else 'medium' end as severity, e.from_file, e.to_file
    from @import_edges e join @concept_paths i on i.role = 'internal' and i.path = e.to_file join @concepts c on c.concept = i.concept join ({_USES}) u on u.concept = c.concept and u.path = e.from_file join @files f on f.path = e.from_file and not f.is_test
    where e.from_file <> e.to_file and exists (select 1 from @concept_paths p where p.concept = c.concept and p.role = 'preferred') and not exists (select 1 from (select h.path, a.concept from @writer_hits h join @allowed_writers a on a.pattern = h.pattern where not a.forbidden) w where w.concept = c.concept and w.path = e.from_file)"""
#: Required sites of each contract; a site without a file is missing, and so, where a trigger has changed, is one that has not.
_SITES = f"""with ch as ({_CHANGED}), t as (select distinct s.contract from @contract_sites s join ch on ch.path = s.path where s.is_trigger),
    x as (select s.contract, s.site, s.path is null as absent, t.contract is not null as triggered, ch.path is not null as touched from @contract_sites s left join t on t.contract = s.contract left join ch on ch.path = s.path)
    select contract, site, absent, triggered, absent or (triggered and not touched) as missing from x"""
_PUBLIC = "regexp_replace(NAME(path), '[.].*$', '') in ('index', 'mod', 'lib')"

CONDITIONS = [("reviewed", "gte", 3.0), ("reviewed", "lt", 40.0), ("precision_", "at_least", 0.3), ("noise", "at_most", 0.5), ("precision_", "exists", None), ("signal", "one_of", ["src1", "src2"]), ("signal", "includes", "rc1"), ("signal", "not_equals", "src3"), ("signal", "non_empty", None), ("noise", "gt", 0.1), ("noise", "lte", 0.9), ("fp", "equals", 0.0)]


def condition(column: Column, operator: str, value=None) -> Column:
    """Whether a value meets a condition; a null meets none."""
    made = {
        "exists": lambda: column.isNotNull(), "non_empty": lambda: column.isNotNull() & (F.length(column.cast("string")) > 0), "is_true": lambda: column == F.lit(True), "is_false": lambda: column == F.lit(False),
        "equals": lambda: column == F.lit(value), "not_equals": lambda: column != F.lit(value), "one_of": lambda: column.isin(list(value)), "includes": lambda: F.contains(column, F.lit(value)),
        "gte": lambda: column >= F.lit(value), "at_least": lambda: column >= F.lit(value), "gt": lambda: column > F.lit(value), "lte": lambda: column <= F.lit(value), "at_most": lambda: column <= F.lit(value), "lt": lambda: column < F.lit(value),
    }
    if operator not in made:
        raise ValueError(f"no operator {operator!r}")
    return F.coalesce(made[operator](), F.lit(False))


def condition_ops(scores: DataFrame) -> DataFrame:
    """One row a signal and condition of ``CONDITIONS``."""
    rows = [F.struct(F.lit(i).cast("long").alias("nth"), F.lit(o).alias("operator"), condition(F.col(c), o, v).alias("passed")) for i, (c, o, v) in enumerate(CONDITIONS)]
    return scores.select("signal", F.inline(F.array(*rows)))


def _condition_sql(c: str, o: str, v) -> str:
    word = f"'{v}'" if isinstance(v, str) else v
    return {"exists": f"{c} is not null", "non_empty": f"{c} is not null and length({c}) > 0", "equals": f"{c} = {word}", "not_equals": f"{c} <> {word}", "one_of": f"{c} in ({', '.join(repr(x) for x in v or [])})" if isinstance(v, list) else "", "includes": f"{c} like '%{v}%'", "gte": f"{c} >= {v}", "at_least": f"{c} >= {v}", "gt": f"{c} > {v}", "lte": f"{c} <= {v}", "at_most": f"{c} <= {v}", "lt": f"{c} < {v}"}[o]


def folder_order(pairs: DataFrame) -> DataFrame:
    """(folder, layer): folders that depend on others come before them; folders that depend on each other stand together.

    The layers are those of the condensation, so they don't depend on the order in which folders are visited.
    """
    lv = K.levels(K.edges_of(pairs, "from_module", "to_module"))
    most = lv.agg(F.max("level").alias("most"))  # one row
    return lv.crossJoin(F.broadcast(most)).select(F.col("node").alias("folder"), (F.col("most") - F.col("level")).alias("layer"))


#: The module tree is a tree: a folder's level is the longest way down.
_ORDER_SQL = "with recursive p as (select from_module as a, to_module as b from @module_tree where from_module <> to_module), n as (select a as node from p union select b from p), w(node, l) as (select node, cast(0 as bigint) from n union select p.a, w.l + 1 from w join p on p.b = w.node), v as (select node, max(l) as l from w group by node) select node as folder, (select max(l) from v) - l as layer from v"

RELATIONS.views |= {
    "scoped_patterns": "select * from (values ('reads11', 'src/brand1/**', 'store.%'), ('reads22', 'src/brand22/*', 'store.nation_1%'), ('all', '*.ts', null)) p(id, path_pattern, symbol_like)",
    "concept_paths": "select c.concept, case when f.is_barrel then 'preferred' else 'internal' end as role, f.path from @files f join @concepts c on c.rk = f.k % 5",
    "contract_sites": "select module as contract, 'site' || cast(k as string) as site, case when lang = 'unknown' then null else path end as path, is_barrel as is_trigger from @files",
    "baseline_clones": "select bh, files, risk from @clones where risk % 3 <> 0 union all select bh + 1000000, files, risk from @clones where risk % 5 = 0",
    "baseline_clone_files": "select distinct b.bh, f.path from @baseline_clones b join @functions f on f.bh = case when b.bh >= 1000000 then b.bh - 1000000 else b.bh end",
    "score_rows": "select signal, count(*) as reviewed, cast(sum(case when category = 'fp' then 1 else 0 end) as double) as fp, avg(cast(case when category = 'tp' then 1 else 0 end as double)) as precision_, avg(cast(case when category = 'fp' then 1 else 0 end as double)) as noise from @verdicts group by signal",
}

RELATIONS.computed["scoped_hits"] = (lambda r, p: glob_hits(r, p.withColumnRenamed("path_pattern", "pattern")), ("reads", "scoped_patterns"), f"select distinct r.path, p.path_pattern as pattern from @reads r join @scoped_patterns p on {glob_sql('r.path', 'p.path_pattern')}")

OPS: dict[str, SqlOp] = {
    "scoped_glob_join": SqlOp("Symbols that a pattern of path and symbol matches; a pattern without a symbol matches all", "select p.id, count(*) as n, min(r.path) as first_path from @reads r join @scoped_hits h on h.path = r.path join @scoped_patterns p on p.path_pattern = h.pattern and (p.symbol_like is null or r.symbol like p.symbol_like) group by p.id"),
    "import_bypass": SqlOp("Imports of a concept's internal files past its preferred entries, and concepts that several files bypass", f"with b as ({_BYPASS}) select 'authoritative_import_bypass' as kind, concept, severity, from_file as scope, count(*) as n from b group by concept, severity, from_file union all select 'concept_boundary_pressure', concept, severity, concept, count(distinct from_file) from b group by concept, severity having count(distinct from_file) > 1"),
    "contract_obligation": SqlOp("Contracts with missing sites, or triggered by a change", f"with s as ({_SITES}) select contract, count(*) as required, cast(sum(case when missing then 1 else 0 end) as bigint) as missing, max(case when triggered then 1 else 0 end) = 1 as triggered, case when sum(case when missing then 1 else 0 end) > 0 then 'high' else 'low' end as severity from s group by contract having max(case when triggered then 1 else 0 end) = 1 or sum(case when absent then 1 else 0 end) > 0"),
    "inferred_boundary": SqlOp("Changed files that import a file of another module without public functions where others of it have some, where no contract is declared for its root", f"with ch as ({_CHANGED}) select distinct e.from_file, e.to_file, b.module, 'low' as severity from @import_edges e join ch on ch.path = e.from_file join @module_paths a on a.path = e.from_file join @module_paths b on b.path = e.to_file where a.module <> b.module and not exists (select 1 from @functions u where u.path = e.to_file and u.is_public) and exists (select 1 from @functions u where u.module = b.module and u.is_public) and not exists (select 1 from @module_contracts m where m.forbid and m.root = b.module)"),
    "state_findings": SqlOp("Sites with gaps: none covered, some missing, and the domains most burdened", f"with o as ({_OBLIGATION}) select 'missing_variants' as kind, domain, site as scope, case when missing * 2 >= required then 'high' else 'medium' end as severity, missing as n from o where missing > 0 union all select 'state_burden', domain, domain, case when sum(missing) * 10 >= sum(required) then 'high' else 'medium' end, cast(sum(missing) as bigint) from o group by domain having sum(missing) > 0"),
    "clone_report": SqlOp("Families, and clone groups in none, by one score", "select 'clone_family' as kind, c.family as id, case max(case k.severity when 'high' then 3 when 'medium' then 2 else 1 end) when 3 then 'high' when 2 then 'medium' else 'low' end as severity, count(*) as members, max(k.risk) as top_risk from @clone_families c join @clones k on k.bh = c.bh group by c.family union all select 'exact_clone_group', k.bh, k.severity, cast(1 as bigint), k.risk from @clones k where not exists (select 1 from @clone_families c where c.bh = k.bh)"),
    "session_clones": SqlOp("Clone groups that the baseline lacks and that touch a changed file", f"with ch as ({_CHANGED}) select k.bh, k.risk, k.severity from @clones k where not exists (select 1 from @baseline_clones b where b.bh = k.bh) and exists (select 1 from @functions f join ch on ch.path = f.path where f.bh = k.bh) and exists (select 1 from @baseline_clones)"),
    "clone_followthrough": SqlOp("Groups of the baseline with a changed file and untouched siblings: still equal, or drifted", f"with ch as ({_CHANGED}), m as (select b.bh, b.path, ch.path is not null as touched from @baseline_clone_files b left join ch on ch.path = b.path), g as (select bh, cast(sum(case when touched then 1 else 0 end) as bigint) as changed, cast(sum(case when touched then 0 else 1 end) as bigint) as untouched from m group by bh) select g.bh, case when k.bh is null then 'clone_propagation_drift' else 'touched_clone_family' end as kind, g.changed, g.untouched from g left join @clones k on k.bh = g.bh where g.changed > 0 and g.untouched > 0"),
    "merge_inferred_rules": SqlOp("Declared concepts, and inferred ones of enough confidence that no declared target covers", f"select concept as id, 'declared' as origin from @concepts union all select i.symbol, 'inferred' from (select symbol, least(8000, 5500 + 500 * least(count(distinct path), 4)) as confidence from @reads group by symbol having count(distinct path) >= 2) i where i.confidence >= {CONFIDENT} and not exists (select 1 from @concept_targets t where t.target = i.symbol)"),
    "project_shape": SqlOp("Capabilities that paths show, and the shape by the first that fits", f"with b as (select max(case when HAS(path, '/api/') then 1 else 0 end) as api, max(case when is_test then 1 else 0 end) as tests, max(case when {_PUBLIC} then 1 else 0 end) as packaged, count(distinct module) as modules, count(distinct lang) as langs from @files) select api = 1 as has_api, tests = 1 as has_tests, packaged = 1 as has_packages, modules, langs, case when api = 1 and packaged = 1 then 'modular_service' when packaged = 1 then 'package_library' when api = 1 then 'service' else 'flat' end as archetype from b"),
    "coverage_breakdown": SqlOp("Share of each exclusion bucket, and which is the largest", "with x as (select case when HAS(path, '/deep/') then 'vendor' when HAS(path, '.test.') then 'fixture' when lang = 'unknown' then 'generated' else 'kept' end as bucket from @files), n as (select bucket, count(*) as n from x group by bucket), t as (select sum(n) as total, sum(case when bucket <> 'kept' then n else 0 end) as excluded from n) select n.bucket, n.n, round(n.n / cast(t.total as double), 3) as share, n.bucket <> 'kept' and n.n = (select max(n) from n where bucket <> 'kept') as dominant from n cross join t"),
    "fixed_now": SqlOp("Ages at a given now, whatever the clock says", f"select path, greatest(0, IDIV({NOW} - max(epoch), 86400)) as age_days from (select f.path, c.epoch from @commit_files f join @commits c on c.commit_id = f.commit_id) h group by path"),
    "session_baseline": SqlOp("What a session begins with: a hash a file and the findings' keys", "select 'file' as what, path as id, cast(hash as string) as payload from @file_hashes union all select 'finding', key, kind || '/' || severity from @findings"),
}

#: name: (operator, its relations in order, its DuckDB SQL or None)
COMPUTED = {
    "condition_ops": (condition_ops, ("score_rows",), "with c as (" + " union all ".join(f"select signal, cast({i} as bigint) as nth, '{o}' as operator, coalesce({_condition_sql(c, o, v)}, false) as passed from @score_rows" for i, (c, o, v) in enumerate(CONDITIONS)) + ") select signal, nth, operator, passed from c"),
    "folder_dag_order": (lambda p: folder_order(materialize(p)), ("module_tree",), _ORDER_SQL),
}
