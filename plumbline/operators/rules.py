"""Rules, baselines and gates: constraints, layers, boundaries, contracts, differences, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize
from ..plans.sqlops import SqlOp
from ..plans.views import RELATIONS, TODAY
from .degrees import DEGREES, FAN_OUT
from .globs import glob_hits, glob_sql
from .health import _CAUSES


_GLOBS = "select * from (values ('src/brand11/**'), ('src/brand1*'), ('src/brand12/*'), ('src/brand1/*'), ('*.test.ts'), ('src/brand13'), ('src/brand14/**/*'), ('src/brand3/**/*'), ('src/brand21/f1.ts')) g(pattern)"
#: The first layer, by place in the list and then by pattern, that a path matches.
_LAYER_OF = "select path, layer, ord from (select h.path, l.layer, l.ord, row_number() over (partition by h.path order by l.ord, l.nth) as rk from @layer_hits h join @layers l on l.pattern = h.pattern) x where rk = 1"
_OPEN = "select f.* from @findings f left join (select b.key from @baseline_findings b) b on b.key = f.key where b.key is null"


def _listing(rule: str, rows: str) -> str:
    """A row a violation."""
    return f"select '{rule}' as rule, 'error' as severity, file from ({rows}) v"


def _scalar(rule: str, violated: str) -> str:
    return f"select '{rule}' as rule, 'error' as severity, '' as file from @health h cross join @constraints c where {violated}"


def _over(column: str, limit: str, table: str, what: str) -> str:
    return f"select {what} as file from @{table} t cross join @constraints c where t.{column} > c.{limit}"


_GOD = f"select d.path as file from ({DEGREES}) d join @files f on f.path = d.path cross join @constraints c where c.no_god_files and d.fan_out > {FAN_OUT} and not f.is_barrel and not exists (select 1 from @entry_points p where p.file = d.path)"
_CYCLES = "select l.path as file from @levels l join (select scc from @levels group by scc having count(*) > 1) z on z.scc = l.scc cross join @constraints c cross join @health h where h.cycle_count > c.max_cycles"
_UPWARD = "select u.from_file || ' (L' || cast(u.from_level as string) || ') > ' || u.to_file || ' (L' || cast(u.to_level as string) || ')' as file from @upward u cross join @constraints c where (select count(*) from @upward) > c.max_upward_violations"
#: The 13 constraints; a limit that is null isn't checked.
CHECKS = {
    "min_quality": _scalar("min_quality", "h.quality_signal < c.min_quality"),
    **{f"min_{x}": _scalar(f"min_{x}", f"h.{x} < c.min_{x}") for x in _CAUSES},
    "max_coupling": _scalar("max_coupling_score", "h.coupling_score > c.max_coupling_score"),
    "max_cycles": _listing("max_cycles", _CYCLES),
    "max_cc": _listing("max_cc", _over("cc", "max_cc", "functions", "t.path || ':' || t.name")),
    "max_file_lines": _listing("max_file_lines", _over("lines", "max_file_lines", "files", "t.path")),
    "max_fn_lines": _listing("max_fn_lines", _over("ln", "max_fn_lines", "functions", "t.path || ':' || t.name")),
    "no_god_files": _listing("no_god_files", _GOD),
    "max_upward": _listing("max_upward_violations", _UPWARD),
}
_LAYER = "select distinct e.from_file, a.layer as from_layer, e.to_file, b.layer as to_layer from @import_edges e join @layer_of a on a.path = e.from_file join @layer_of b on b.path = e.to_file where a.ord > b.ord and (select count(distinct layer) from @layers) >= 2"
_BOUNDARY = "select e.from_file, e.to_file, b.reason from @import_edges e join @boundary_hits h on h.path = e.from_file join @boundaries b on b.from_glob = h.pattern join @boundary_hits t on t.path = e.to_file and t.pattern = b.to_glob"
#: A module is the first component below a contract's root; a file is public if its path below the module is listed.
_UNDER = "split_part(substr({0}, length(m.root) + 2), '/', 1)"
_INSIDE = "STARTS({0}, m.root || '/') and " + _UNDER + " <> ''"
_CONTRACT = f"select distinct m.id, e.from_file, e.to_file from @import_edges e join @contract_hits h on h.path = e.to_file join @module_contracts m on m.forbid and m.root <> '' and m.root = h.pattern and {_INSIDE.format('e.to_file')} where exists (select 1 from @contract_api x where x.id = m.id) and not (({_INSIDE.format('e.from_file')}) and {_UNDER.format('e.from_file')} = {_UNDER.format('e.to_file')}) and not exists (select 1 from @contract_api p where p.id = m.id and e.to_file = m.root || '/' || {_UNDER.format('e.to_file')} || '/' || p.file_name)"
_EACH = " union all ".join([
    *CHECKS.values(),
    *[f"select '{name}', 'error', from_file || ' > ' || to_file from ({sql}) x" for name, sql in (("layer_direction", _LAYER), ("boundary", _BOUNDARY), ("module_contract", _CONTRACT))],
])
#: Each place of each rule, beside how many the rule has; a list in one row would be one task's.
_PLACES = f"select e.rule, e.severity, n.n, n.first_file, e.file from ({_EACH}) e join (select rule, count(*) as n, min(file) as first_file from ({_EACH}) x group by rule) n on n.rule = e.rule"
_VIOLATIONS = f"select rule, severity, count(*) as n, min(file) as first_file from ({_EACH}) e group by rule, severity"

#: Findings under each suppression that matches their kind, concept and file, as equi-joins: what a suppression leaves open is a value of its own.
_SUPPRESSED = f"""
    with a as (select key, kind, concept, file from @findings union all select key, '*', concept, file from @findings),
    b as (select key, kind, concept, file from a where concept is not null union all select key, kind, '', file from a),
    c as (select b.key, b.kind, b.concept, h.pattern from b join @suppression_hits_by_file h on h.path = b.file union all select key, kind, concept, '' from b)
    select distinct c.key, s.kind, s.concept, s.file_glob, s.expires, coalesce(s.expires < '{TODAY}', false) as expired from c join @suppressions s on s.kind = c.kind and coalesce(s.concept, '') = c.concept and coalesce(s.file_glob, '') = c.pattern"""
#: The definition for DuckDB, findings by suppressions.
_SUPPRESSED_SQL = f"""select distinct f.key, s.kind, s.concept, s.file_glob, s.expires, s.expires is not null and s.expires < '{TODAY}' as expired from @findings f join @suppressions s on (s.kind = '*' or s.kind = f.kind) and (s.concept is null or s.concept = f.concept) and (s.file_glob is null or {glob_sql('f.file', 's.file_glob')})"""


def globbed(paths: str, path: str, patterns: str, pattern: str) -> tuple:
    """A relation (path, pattern) of the globs of a relation's column that match the paths of another's."""
    both = lambda p, g: materialize(glob_hits(p.select(F.col(path).alias("path")), g.select(F.col(pattern).alias("pattern"))))
    return both, (paths, patterns), f"select distinct p.{path} as path, g.{pattern} as pattern from @{paths} p join @{patterns} g on {glob_sql(f'p.{path}', f'g.{pattern}')}"


def suppressed(findings: DataFrame, suppressions: DataFrame, hits: DataFrame) -> DataFrame:
    return materialize(SqlOp("", _SUPPRESSED).run(findings=findings, suppressions=suppressions, suppression_hits_by_file=hits))


RELATIONS.views |= {"glob_cases": _GLOBS, "boundary_globs": "select from_glob as pattern from @boundaries union select to_glob from @boundaries", "layer_of": _LAYER_OF}
RELATIONS.computed |= {
    "layer_hits": globbed("files", "path", "layers", "pattern"), "boundary_hits": globbed("files", "path", "boundary_globs", "pattern"), "contract_hits": globbed("files", "path", "module_contracts", "root"),
    "writer_hits": globbed("files", "path", "allowed_writers", "pattern"), "glob_case_hits": globbed("files", "path", "glob_cases", "pattern"), "suppression_hits_by_file": globbed("findings", "file", "suppressions", "file_glob"),
    "suppressed": (suppressed, ("findings", "suppressions", "suppression_hits_by_file"), _SUPPRESSED_SQL),
}

OPS: dict[str, SqlOp] = {
    "glob_predicate": SqlOp("Paths that each glob matches", "select pattern, count(*) as n, min(path) as first_path from @glob_case_hits group by pattern"),
    **{name: SqlOp("Violations of one constraint, a row each", sql) for name, sql in CHECKS.items()},
    **{name: SqlOp("Violations of one constraint, a row each, beside their number", f"select v.rule, v.severity, n.n_files, v.file from ({CHECKS[name]}) v cross join (select count(*) as n_files from ({CHECKS[name]}) x) n") for name in ("max_cc", "max_fn_lines")},
    "check_rules": SqlOp("Violations of 13 constraints, layers, boundaries and module contracts: every place, beside how often and where first its rule is violated", _PLACES),
    "check_verdict": SqlOp("Rules checked, rules violated, and whether none was", f"with v as ({_VIOLATIONS}) select (select count(min_quality) + count(min_modularity) + count(min_acyclicity) + count(min_depth) + count(min_equality) + count(min_redundancy) + count(max_coupling_score) + count(max_cycles) + count(max_cc) + count(max_file_lines) + count(max_fn_lines) + count(max_upward_violations) + sum(case when no_god_files then 1 else 0 end) from @constraints) + case when (select count(distinct layer) from @layers) >= 2 then 1 else 0 end + (select count(*) from @boundaries) + (select count(*) from @module_contracts) as rules_checked, count(*) as violated, count(*) = 0 as passed from v"),
    "min_root_cause": SqlOp("Each root-cause score against its minimum", " union all ".join(f"select '{c}' as cause, round(h.{c}, 6) as value, h.{c} >= k.min_{c} as passed from @health h cross join @constraints k" for c in _CAUSES)),
    "layer_direction": SqlOp("Edges from a higher layer order to a lower one, by the first layer that matches", _LAYER),
    "boundary_rule": SqlOp("Edges that both globs of a boundary match", _BOUNDARY),
    "module_contract": SqlOp("Imports into another module below a contract's root that bypass its public files", _CONTRACT),
    "baseline_diff": SqlOp("Health before and after, degraded where the signal fell by over 0.02, coupling rose by over 0.05, or a count rose", "select round(b.quality_signal, 5) as signal_before, round(h.quality_signal, 5) as signal_after, round(b.coupling_score, 6) as coupling_before, round(h.coupling_score, 6) as coupling_after, b.cycle_count as cycles_before, h.cycle_count as cycles_after, b.god_file_count as god_files_before, h.god_files as god_files_after, h.quality_signal - b.quality_signal < -0.02 as signal_dropped, h.coupling_score > b.coupling_score + 0.05 as coupling_degraded, h.cycle_count > b.cycle_count as cycles_increased, h.god_files > b.god_file_count as god_files_increased, h.complex_functions > b.complex_fn_count as complex_increased, h.quality_signal - b.quality_signal < -0.02 or h.coupling_score > b.coupling_score + 0.05 or h.cycle_count > b.cycle_count or h.god_files > b.god_file_count or h.complex_functions > b.complex_fn_count as degraded from @health h cross join @structural_baseline b"),
    "introduced_findings": SqlOp("Findings whose key the baseline lacks", f"select key, kind, severity, file, score from ({_OPEN}) o"),
    "resolved_findings": SqlOp("Baseline findings that are gone, experimental ones left out", "select b.key, b.kind, b.severity from @baseline_findings b where b.trust <> 'experimental' and not exists (select 1 from @findings f where f.key = b.key)"),
    "hash_diff_full_outer": SqlOp("Paths whose hash differs or that one side lacks", "select coalesce(a.path, b.path) as path, case when a.path is null then 'removed' when b.path is null then 'added' else 'changed' end as change from @file_hashes a full outer join @baseline_hashes b on a.path = b.path where a.hash is null or b.hash is null or a.hash <> b.hash"),
    "missing_test_anti_join": SqlOp("Changed production files without a test of their stem, directories with more than 3 as one", "with c as (select a.path from @file_hashes a left join @baseline_hashes b on a.path = b.path where b.path is null and not HAS(a.path, '.test.')), m as (select c.path, split_part(c.path, '/', 2) as dir from c left join @files t on t.path = replace(c.path, '.ts', '.test.ts') where t.path is null), n as (select dir, count(*) as n from m group by dir) select m.path as scope, cast(1 as bigint) as n from m join n on n.dir = m.dir where n.n <= 3 union all select dir, n from n where n > 3"),
    "suppression_anti_join": SqlOp("Findings that no unexpired suppression of their kind, concept and file hides", "select f.key, f.kind, f.file from @findings f where not exists (select 1 from @suppressed s where s.key = f.key and not s.expired)"),
    "suppression_hits": SqlOp("Findings that each suppression matches, and whether it has expired", f"select s.kind, coalesce(s.concept, '') as concept, coalesce(s.file_glob, '') as file_glob, coalesce(s.expires < '{TODAY}', false) as expired, coalesce(m.n, 0) as hits from @suppressions s left join (select kind, concept, file_glob, expires, count(*) as n from @suppressed group by kind, concept, file_glob, expires) m on m.kind = s.kind and coalesce(m.concept, '') = coalesce(s.concept, '') and coalesce(m.file_glob, '') = coalesce(s.file_glob, '') and coalesce(m.expires, '') = coalesce(s.expires, '')"),
    "expired": SqlOp("Suppressions past their date, at the given today; one without a date never is", f"select kind, coalesce(concept, '') as concept, coalesce(file_glob, '') as file_glob, coalesce(expires < '{TODAY}', false) as expired from @suppressions"),
    "gate_decision": SqlOp("fail if an introduced finding is high, or medium when strict; else pass", f"select strict, case when sum(case when o.severity = 'high' or (strict and o.severity = 'medium') then 1 else 0 end) > 0 then 'fail' else 'pass' end as decision from ({_OPEN}) o cross join (values (true), (false)) v(strict) group by strict"),
    "session_end_decision": SqlOp("fail, warn or pass of each scope", f"select f.scope, case when sum(case when o.severity = 'high' then 1 else 0 end) > 0 then 'fail' when count(o.key) > 0 then 'warn' else 'pass' end as decision from (select distinct scope from @findings) f left join ({_OPEN}) o on o.scope = f.scope group by f.scope"),
    "agent_gate": SqlOp("fail if an issue blocks, warn if one is medium or higher", "select scope, case when max(case when severity = 'high' and trust = 'trusted' then 1 else 0 end) = 1 then 'fail' when max(case when severity in ('high', 'medium') then 1 else 0 end) = 1 then 'warn' else 'pass' end as gate from @findings group by scope"),
    "rule_coverage": SqlOp("Checkable rules over declared ones in each section", "with d as (select 'concept' as section, concept as id from @concepts union all select 'suppress', kind from @suppressions), c as (select distinct 'concept' as section, concept as id from @concept_targets where nk > 4 union all select distinct 'suppress', kind from @suppressions where expires is not null) select d.section, count(*) as declared, count(c.id) as checkable, cast(round(10000.0 * count(c.id) / count(*)) as bigint) as score_0_10000 from d left join c on c.section = d.section and c.id = d.id group by d.section"),
}
