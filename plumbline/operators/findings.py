"""Semantic rules, structural debt, ranking and helpers over findings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.ranking import global_rank
from ..plans.sqlops import SqlOp
from .degrees import DEAD, DEGREES, FAN_IN, FAN_OUT, LARGE_FILE

#: A symbol belongs to a target that is the symbol itself or one of its prefixes up to a dot; an index in brackets before the dot may be missing.
_PREFIXED = "(select symbol, path, line, p as prefix from (select * from @{0} UNNEST(PREFIXES(symbol, '[.]', '.'), u, p)) x union select symbol, path, line, substr(p, 1, length(p) - 3) from (select * from @{0} UNNEST(PREFIXES(symbol, '[.]', '.'), u, p)) y where ENDS(p, '[*]') and p <> symbol)"
_WRITES = f"select distinct t.concept, w.symbol, w.path, w.line from {_PREFIXED.format('writes')} w join @concept_targets t on t.target = w.prefix"
_READS = f"select distinct t.concept, w.symbol, w.path, w.line from {_PREFIXED.format('reads')} w join @concept_targets t on t.target = w.prefix"
_SEVERITY = "case when {0} >= 6500 then 'high' when {0} >= 3000 then 'medium' else 'low' end"
_COVER = "select d.domain, s.site, count(*) as covered from (select distinct domain, site, variant from @sites) s join @domains d on d.domain = s.domain and d.variant = s.variant group by d.domain, s.site"
_NEED = "select domain, count(*) as variants from @domains group by domain"
_OBLIGATION = f"select c.domain, c.site, n.variants as required, c.covered as satisfied, n.variants - c.covered as missing from ({_COVER}) c join ({_NEED}) n on n.domain = c.domain"
_RANK = "case severity when 'high' then 3 when 'medium' then 2 else 1 end"
_TRUST = "case trust when 'trusted' then 2 when 'watchpoint' then 1 else 0 end"
_ORDER = f"{_RANK} desc, {_TRUST} desc, score desc, scope, kind, key"
_PRESENTATION = "case when trust = 'experimental' then 'experimental' when trust = 'watchpoint' then 'watchpoint' when score < 2000 then 'hardening_note' else 'structural_debt' end"
_LEVERAGE = "case when trust = 'experimental' then 'experimental' when kind = 'cycle_cluster' and score >= 5000 then 'architecture_signal' when kind = 'clone_family' then 'local_refactor_target' when severity = 'high' then 'architecture_signal' when score < 2000 then 'hardening_note' else 'secondary_cleanup' end"
#: Orders of leverage and presentation as its documents list them; the policy file isn't public.
LEVERAGES = ["architecture_signal", "local_refactor_target", "boundary_discipline", "regrowth_watchpoint", "secondary_cleanup", "hardening_note", "tooling_debt", "experimental"]
PRESENTATIONS = ["structural_debt", "guarded_facade", "watchpoint", "hardening_note", "tooling_debt", "experimental"]


def _place(value: str, names: list[str]) -> str:
    return f"case {value} " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(names)) + f" else {len(names)} end"


_BRIEF = f"{_RANK} desc, {_place(f'({_LEVERAGE})', LEVERAGES)}, {_place(f'({_PRESENTATION})', PRESENTATIONS)}, {_TRUST} desc, score desc, scope, kind, key"


def ranked(order: str, place: str, keep: str, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """``keep`` columns of ``rows`` with their ``place`` in an SQL ``order``, or the caller's ``limit`` first; no task holds all rows."""
    terms = [x.strip() for x in re.split(r",(?![^(]*\))", order)]
    columns = [F.expr(x.removesuffix(" desc")).desc() if x.endswith(" desc") else F.expr(x).asc() for x in terms]
    out = global_rank(rows, columns, place).select(*keep.split(), place)
    return out if limit is None else out.filter(F.col(place) <= int(limit))


def issue_ranking(found: DataFrame, limit: int | None = None) -> DataFrame:
    return ranked(_ORDER, "rank_no", "key", found, limit)


def merge_findings(found: DataFrame, others: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings of two sources, equal ones once, by severity, leverage, presentation, trust and score; or the caller's ``limit`` first."""
    return ranked(_BRIEF, "rank_no", "key kind severity score", found.unionByName(others).distinct(), limit)


def brief_ranking(found: DataFrame, limit: int | None = None) -> DataFrame:
    """All findings in brief order, or the caller's ``limit`` first."""
    return ranked(_BRIEF, "rank_no", "key kind", found, limit)


def clone_hints(found: DataFrame, limit: int | None = None) -> DataFrame:
    """All hints in turn across kinds, or the caller's ``limit`` first."""
    turn = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "key"))
    return ranked("turn, kind", "hint_no", "key", found.select("key", "kind", "score").withColumn("turn", turn), limit)


def _pressure(value: str, limit: int, most: int) -> str:
    return f"(case when {value} <= {limit} then 0 else round(least(1.0, ({value} - {limit}) / cast({limit} as double)) * {most}) end)"


_INSTABILITY = "round(10000.0 * d.fan_out / (d.fan_in + d.fan_out))"
_DEBT = f"""
    select 'large_file' as kind, f.path as scope, cast(least(10000, 2400 + {_pressure('f.lines', LARGE_FILE, 3600)} + 120 * least(greatest(coalesce(m.cc, 1) - 20, 0), 20)) as bigint) as score
    from @files f left join (select path, max(cc) as cc from @functions group by path) m on m.path = f.path where f.lines > {LARGE_FILE} and f.lang <> 'unknown'
    union all select 'dependency_sprawl', d.path, cast(least(10000, 2800 + {_pressure('d.fan_out', FAN_OUT, 3200)} + floor({_INSTABILITY} / 4)) as bigint) from ({DEGREES}) d where d.fan_out > {FAN_OUT}
    union all select 'unstable_hotspot', d.path, cast(least(10000, 3200 + {_pressure('d.fan_in', FAN_IN, 3000)} + floor({_INSTABILITY} / 3)) as bigint) from ({DEGREES}) d where d.fan_in > {FAN_IN}"""
#: How sure the first cut of a file is: by its functions, its peak complexity, its dependencies, its guardrail tests and its roles.
_CUT = "1200 + case when coalesce(m.n, 0) >= 20 then 1800 else 0 end + case when coalesce(m.peak, 0) >= 40 then 2000 when coalesce(m.peak, 0) >= 25 then 1000 else 0 end + case when coalesce(d.fan_out, 0) >= 2 then 1600 else 0 end + case when t.seam = 1 then 1700 else 0 end + case when t.path is not null then 1000 else 0 end"
_LARGE = f"""
    select 'large_file' as kind, f.path as scope, cast(least(10000, 2400 + {_pressure('f.lines', LARGE_FILE, 3600)} + 120 * least(greatest(coalesce(m.peak, 0) - 20, 0), 20) + least(800, IDIV({_CUT}, 12))) as bigint) as score
    from @files f left join (select path, count(*) as n, max(greatest(coalesce(cc, 0), coalesce(cog, 0))) as peak from @functions group by path) m on m.path = f.path left join ({DEGREES}) d on d.path = f.path
    left join (select path, max(case when role = 'guarded_seam' then 1 else 0 end) as seam from @role_tags where role in ('composition_root', 'entry_surface', 'facade_with_extracted_owners', 'guarded_seam') group by path) t on t.path = f.path
    where f.lines > {LARGE_FILE} and f.lang <> 'unknown'"""
#: A function of one name counts once a file, at its longest.
_DEAD_PRIVATE = f"""
    select 'dead_private_code_cluster' as kind, x.path as scope, cast(1500 + least(3600, 900 * count(*)) + least(2800, 18 * sum(x.ln)) as bigint) as score
    from (select path, name, max(ln) as ln from ({DEAD}) u group by path, name) x join @files f on f.path = x.path where f.lang <> 'unknown' group by x.path having count(*) >= 2 or sum(x.ln) >= 40"""
#: All six kinds; a cycle or an island goes by its smallest file, and its members stand in ``cycle_cluster`` and ``islands``.
_ALL_DEBT = f"""{_LARGE} union all select kind, scope, score from ({_DEBT}) w where kind <> 'large_file' union all {_DEAD_PRIVATE}
    union all select 'cycle_cluster', 'cycle:' || cycle_id, score from @cycle_clusters union all select 'dead_island', 'island:' || island, score from @dead_islands"""

OPS: dict[str, SqlOp] = {
    "symbol_prefix_join": SqlOp("Symbols of each concept: equal to a target or below it", f"select concept, symbol, count(*) as reads from ({_READS}) w group by concept, symbol"),
    "multi_writer": SqlOp("Concepts that more than one production file writes", f"select concept, count(distinct w.path) as writers, 'high' as severity from ({_WRITES}) w join @files f on f.path = w.path where not f.is_test group by concept having count(distinct w.path) > 1"),
    "writer_policy": SqlOp("Forbidden writers, then writers outside the allowed ones", f"with p as (select a.concept, h.path, max(case when a.forbidden then 1 else 0 end) as bad, max(case when a.forbidden then 0 else 1 end) as good from @writer_hits h join @allowed_writers a on a.pattern = h.pattern group by a.concept, h.path), l as (select distinct concept from @allowed_writers where not forbidden) select w.concept, w.path, w.symbol, case when p.bad = 1 then 'forbidden_writer' else 'writer_outside_allowlist' end as kind from ({_WRITES}) w left join p on p.concept = w.concept and p.path = w.path left join l on l.concept = w.concept where p.bad = 1 or (coalesce(p.good, 0) = 0 and l.concept is not null)"),
    "forbidden_raw_read": SqlOp("Raw reads of a concept's fields by file", f"select concept, path, count(*) as n, SETJOIN(symbol) as symbols, 'medium' as severity from ({_READS}) r where ENDS(symbol, '.field') group by concept, path"),
    "domain_concept_join": SqlOp("Sites and variants of each domain", "select domain, count(distinct site) as sites, count(distinct variant) as variants from @sites group by domain"),
    "domain_obligation": SqlOp("Required, satisfied and missing variants of each site", _OBLIGATION),
    "obligation_score": SqlOp("Satisfied over required, 0 to 10000; 10000 if none", f"select cast(case when coalesce(sum(required), 0) = 0 then 10000 else round(10000.0 * sum(satisfied) / sum(required)) end as bigint) as score_0_10000 from ({_OBLIGATION}) o"),
    "transition_gaps": SqlOp("Variants that a site doesn't cover", "select n.domain, s.site, n.variant from @domains n join (select distinct domain, site from @sites) s on s.domain = n.domain left join @sites x on x.domain = n.domain and x.site = s.site and x.variant = n.variant where x.site is null"),
    "contract_parity": SqlOp("Present cells of each domain's contract, and the score", f"select domain, cast(sum(required) as bigint) as total_cells, cast(sum(satisfied) as bigint) as satisfied_cells, cast(round(10000.0 * sum(satisfied) / sum(required)) as bigint) as score_0_10000 from ({_OBLIGATION}) o group by domain"),
    "parity_score": SqlOp("All satisfied cells over all cells", f"select cast(case when count(*) = 0 then 10000 else round(10000.0 * sum(satisfied) / sum(required)) end as bigint) as score_0_10000 from ({_OBLIGATION}) o"),
    "parity_findings": SqlOp("Missing cells as findings", f"select domain, site, case when missing * 2 >= required then 'high' else 'medium' end as severity, missing from ({_OBLIGATION}) o where missing > 0"),
    "obligations": SqlOp("Sites with missing variants", f"select domain, site, missing from ({_OBLIGATION}) o where missing > 0"),
    "state_explicitness": SqlOp("Mean of 1, coverage and full-coverage share of each domain", f"select domain, cast(round(10000.0 * (1.0 + sum(satisfied) / cast(sum(required) as double) + avg(cast(case when missing = 0 then 1 else 0 end as double))) / 3) as bigint) as score_0_10000 from ({_OBLIGATION}) o group by domain"),
    "state_integrity": SqlOp("Domains by score, most burdened first", f"select domain, count(*) as sites, cast(sum(missing) as bigint) as burden, cast(round(10000.0 * sum(satisfied) / sum(required)) as bigint) as score_0_10000 from ({_OBLIGATION}) o group by domain"),
    "trace_symbol": SqlOp("Where a symbol is written, read or declared", "select 'write' as role, path, line from @writes where STARTS(symbol, 'store.nation_15') union all select 'read', path, line from @reads where STARTS(symbol, 'store.nation_15') union all select 'concept', concept, cast(0 as bigint) from @concept_targets where STARTS(target, 'store.nation_15')"),
    "infer_concepts": SqlOp("Symbols that at least two files touch, with a confidence", "select symbol, count(distinct path) as files, least(8000, 5500 + 500 * least(count(distinct path), 4)) as confidence from @reads group by symbol having count(distinct path) >= 2"),
    "severity_bands": SqlOp("Severity by score", f"select key, {_SEVERITY.format('score')} as band from @findings"),
    "ratio_pressure": SqlOp("Scaled pressure over a limit", f"select path, cast({_pressure('lines', LARGE_FILE, 3600)} as bigint) as pressure from @files"),
    "structural_debt": SqlOp("Debt reports of six kinds with score and severity", f"select kind, scope, score, {_SEVERITY.format('score')} as severity from ({_ALL_DEBT}) d"),
    "large_file_report": SqlOp("Large files with their score, that of their first cut included", f"select scope, score from ({_LARGE}) d"),
    "dependency_sprawl": SqlOp("Wide files with their score", f"select scope, score from ({_DEBT}) d where kind = 'dependency_sprawl'"),
    "dead_private_cluster": SqlOp("Files with two dead functions or forty dead lines", "select path, count(*) as symbols, cast(sum(ln) as bigint) as dead_lines from @functions f where not is_public and not is_method and same_file_ref_count <= 0 and not exists (select 1 from @calls c where c.callee = f.name) group by path having count(*) >= 2 or sum(ln) >= 40"),
    "concept_debt": SqlOp("Findings by concept with a capped score", f"select concept, count(*) as findings, cast(sum(case when severity = 'high' then 1 else 0 end) as bigint) as high, cast(least(10000, 800 * count(*) + 1500 * sum(case when severity = 'high' then 1 else 0 end)) as bigint) as score from @findings group by concept"),
    "debt_signals": SqlOp("Concepts over 2500 and findings over 4000 elsewhere", "with c as (select concept, least(10000, 800 * count(*)) as score from @findings group by concept) select 'concept' as source, concept as scope, cast(score as bigint) as score from c where score >= 2500 union all select 'hotspot', file, score from @findings f where score >= 4000 and not exists (select 1 from c where c.concept = f.concept and c.score >= 2500)"),
    "check_signal_summary": SqlOp("Counts by family of kinds", "select cast(sum(case when kind like 'clone%' then 1 else 0 end) as bigint) as clones, cast(sum(case when kind in ('large_file', 'dependency_sprawl') then 1 else 0 end) as bigint) as size_kinds, cast(sum(case when kind = 'cycle_cluster' then 1 else 0 end) as bigint) as cycles from @findings"),
    "top_actions": SqlOp("The three first trusted findings", f"select key, row_number() over (order by {_ORDER}) as priority from (select * from @findings where trust = 'trusted' order by {_ORDER} limit 3) x"),
    "unique_by_scope": SqlOp("First finding of each scope", f"select scope, key from (select *, row_number() over (partition by scope order by {_ORDER}) as rk from @findings) x where rk = 1"),
    "candidate_order": SqlOp("Place of each finding within its kind", "select kind, key, row_number() over (partition by kind order by score desc, key) as place from @findings"),
    "presentation_class": SqlOp("Presentation by the first case that fits", f"select key, {_PRESENTATION} as presentation from @findings"),
    "leverage_class": SqlOp("Leverage by the first case that fits", f"select key, {_LEVERAGE} as leverage from @findings"),
    "clone_family_signal": SqlOp("Clone families by trust", "select key, case when score >= 6500 then 'trusted' else 'watchpoint' end as tier from @findings where kind = 'clone_family'"),
    "coordination_hotspot": SqlOp("Scores of at least 3000 with severity", "select file, score, case when score >= 6500 then 'high' else 'medium' end as severity from @findings where score >= 3000"),
    "watchpoints": SqlOp("Pressure by scope: concept and hotspot findings together", "select scope, count(*) as signals, max(score) as top_score from @findings where trust <> 'experimental' group by scope having count(*) >= 2"),
    "report_ranking": SqlOp("Additive ranking", f"select key, {_RANK} * 1000 + {_TRUST} * 200 + IDIV(score, 100) as ranking from @findings"),
    "finding_key": SqlOp("Findings with one identity", "select kind || '|' || severity || '|' || concept || '|' || file as identity, count(*) as n from @findings group by 1"),
    "module_of": SqlOp("Module of each path", "select path, module from @module_paths"),
    "is_test_file": SqlOp("Test files by name", "select path from @files where MATCHES(path, '(^|/)(test|tests|__tests__)/|\\.(test|spec)\\.|_test\\.|(Test|Tests|Spec)\\.')"),
    "is_package_index": SqlOp("Barrel files", "select path from @files where ENDS(path, '/index.ts') or ENDS(path, '/__init__.py') or ENDS(path, '/mod.rs')"),
    "path_category": SqlOp("First component below src/", "select path, case when STARTS(path, 'src/') then split_part(path, '/', 2) else split_part(path, '/', 1) end as category from @files"),
    "ext_filter": SqlOp("Files that aren't assets", "select path from @files where not MATCHES(path, '\\.(png|jpg|jpeg|gif|ico|pdf|zip|gz|woff|woff2|ttf|mp4|lock)$')"),
    "dir_filter": SqlOp("Files below no ignored directory", "select path from @files where not MATCHES(path, '(^|/)(node_modules|target|dist|build|vendor|deep)/')"),
    "exclusion_bucket": SqlOp("Excluded files by reason", "select case when HAS(path, '/deep/') then 'vendor' when HAS(path, '.test.') then 'fixture' else 'kept' end as bucket, count(*) as n from @files group by 1"),
    "detect_lang": SqlOp("Language by extension", "select path, case when ENDS(path, '.ts') or ENDS(path, '.tsx') then 'typescript' when ENDS(path, '.py') then 'python' when ENDS(path, '.rs') then 'rust' else 'unknown' end as lang from @files"),
    "line_count": SqlOp("Lines of each text; an unterminated last line counts, an empty text has none", "select doc_id, cast(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when ENDS(text, chr(10)) then 0 else 1 end end as bigint) as total_lines from @documents"),
    "ratio_0_10000": SqlOp("Rounded ratio, 10000 on a zero denominator", "select path, cast(case when lines = 0 then 10000 else round(10000.0 * comments / lines) end as bigint) as score from @files"),
    "safe_ratio": SqlOp("Three decimals, null on a zero denominator", "select path, round(comments / cast(nullif(greatest(blanks - 20, 0), 0) as double), 3) as ratio from @files"),
    "scan_confidence": SqlOp("Kept over candidates and resolved over all, less penalties", "with c as (select count(*) as kept from @files where lang <> 'unknown'), a as (select count(*) as n from @files) select IDIV(cast(round(10000.0 * kept / n) as bigint) * 8, 10) as confidence from c cross join a"),
    "debounce": SqlOp("Last event of each burst: no other event of the path within the gap", "select path, ts, event_id, kind from (select *, lead(ts) over (partition by path order by ts, event_id) as next_ts from @file_events) e where next_ts is null or next_ts - ts >= 300"),
}

#: Ranks over all findings: (operator, its relations in order, its DuckDB SQL).
RANKED = {
    "merge_findings": (merge_findings, ("findings", "baseline_findings"), f"select key, kind, severity, score, row_number() over (order by {_BRIEF}) as rank_no from (select distinct * from (select * from @findings union all select * from @baseline_findings) a) u"),
    "issue_ranking": (issue_ranking, ("findings",), f"select key, row_number() over (order by {_ORDER}) as rank_no from @findings"),
    "brief_ranking": (brief_ranking, ("findings",), f"select key, kind, row_number() over (order by {_BRIEF}) as rank_no from @findings"),
    "clone_hints": (clone_hints, ("findings",), "select key, row_number() over (order by rk, kind) as hint_no from (select kind, key, row_number() over (partition by kind order by score desc, key) as rk from @findings) x"),
}
