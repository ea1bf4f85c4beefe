"""History operators: churn, change coupling, authors, age, hotspots."""

from __future__ import annotations

from ..plans.sqlops import SqlOp
from ..plans.views import NOW

MOST_FILES_A_COMMIT = 50
#: Fixed value: the oldest commits in scope.
CUTOFF = 800_000_000
LEAST_CO_CHANGES = 3

_KNOWN = "select f.commit_id, f.path, f.added, f.removed, f.pos, c.author, c.epoch from @commit_files f join @commits c on c.commit_id = f.commit_id where f.path in (select path from @known_files)"
_CHURN = f"select path, count(*) as commit_count, cast(sum(added) as bigint) as lines_added, cast(sum(removed) as bigint) as lines_removed, cast(sum(added) + sum(removed) as bigint) as total_churn from ({_KNOWN}) h group by path"
_MAX_CC = "select path, max(coalesce(cc, 1)) as max_cc from @functions group by path"
_PLACED = f"select *, row_number() over (partition by commit_id order by pos, path) as nth from ({_KNOWN}) h"


def _pairs(least: int) -> str:
    """Pairs among all known files of a commit, however many it has."""
    return f"""
        with placed as ({_KNOWN}), counts as (select path, count(*) as n from placed group by path),
        pairs as (select a.path as file_a, b.path as file_b, count(*) as n from placed a join placed b on a.commit_id = b.commit_id and a.path < b.path group by a.path, b.path having count(*) >= {least})
        select p.file_a, p.file_b, p.n as co_change_count, round(p.n / cast(x.n + y.n - p.n as double), 6) as coupling_strength
        from pairs p join counts x on x.path = p.file_a join counts y on y.path = p.file_b"""


OPS: dict[str, SqlOp] = {
    "git_log_source": SqlOp("Commits in scope: no merges, from 1 to 50 files, not older than the cutoff", f"select c.commit_id, c.author, c.epoch, count(*) as n_files from @commits c join @commit_files f on f.commit_id = c.commit_id where c.parents <= 1 and c.epoch >= {CUTOFF} group by c.commit_id, c.author, c.epoch having count(*) <= {MOST_FILES_A_COMMIT}"),
    "churn": SqlOp("Commits, lines added and removed of each known file", _CHURN),
    "co_change_counts": SqlOp("Commits that two known files share, among the first 50 of each commit", f"with placed as ({_PLACED}) select a.path as file_a, b.path as file_b, count(*) as co_change_count from placed a join placed b on a.commit_id = b.commit_id and a.path < b.path where a.nth <= {MOST_FILES_A_COMMIT} and b.nth <= {MOST_FILES_A_COMMIT} group by a.path, b.path"),
    "change_coupling": SqlOp("The 50 strongest pairs of at least 3 shared commits, by Jaccard", f"{_pairs(LEAST_CO_CHANGES)} order by coupling_strength desc, file_a, file_b limit 50"),
    "change_coupling_min2": SqlOp("The 50 strongest pairs of at least 2 shared commits", f"{_pairs(2)} order by coupling_strength desc, file_a, file_b limit 50"),
    "last_modified": SqlOp("Newest commit of each known file", f"select path, max(epoch) as last_epoch from ({_KNOWN}) h group by path"),
    "code_age_days": SqlOp("Whole days since each file's newest commit at a fixed now, 0 if in the future", f"select path, cast(greatest(0, IDIV(greatest(0, {NOW} - max(epoch)), 86400)) as bigint) as age_days from ({_KNOWN}) h group by path"),
    "bus_factor": SqlOp("Authors of each file, the main one (ties by name) and its share", f"""
        with a as (select path, author, count(*) as n from ({_KNOWN}) h group by path, author),
        r as (select *, row_number() over (partition by path order by n desc, author) as rk, sum(n) over (partition by path) as total, count(*) over (partition by path) as authors from a)
        select path, authors as author_count, author as primary_author, round(n / cast(total as double), 6) as primary_ratio from r where rk = 1"""),
    "bus_factor_score": SqlOp("1 less the share of files with one author", f"with a as (select path, count(distinct author) as n from ({_KNOWN}) h group by path) select round(cast(1 as double) - coalesce(avg(cast(case when n = 1 then 1 else 0 end as double)), 0), 6) as bus_factor_score from a"),
    "max_cc_per_file": SqlOp("Largest cyclomatic complexity of each file, 1 where none", _MAX_CC),
    "temporal_hotspots": SqlOp("The 30 files with the largest commits times complexity", f"with c as ({_CHURN}), m as ({_MAX_CC}) select c.path as file, c.commit_count as churn_count, coalesce(m.max_cc, 1) as max_complexity, c.commit_count * coalesce(m.max_cc, 1) as risk_score from c left join m on m.path = c.path where c.commit_count * coalesce(m.max_cc, 1) > 0 order by risk_score desc, file limit 30"),
    "churn_concentration": SqlOp("1 less the churn share of the top tenth of files, at least one; by distinct churn, so the window runs over values", f"with c as ({_CHURN}), v as (select total_churn as v, count(*) as c from c group by total_churn), w as (select v, c, sum(c) over (order by v desc rows between unbounded preceding and current row) as upto, greatest(1, IDIV(sum(c) over (), 10)) as k from v) select case when coalesce(sum(v * c), 0) = 0 then 1.0 else round(1 - cast(sum(v * least(c, greatest(0, k - (upto - c)))) as double) / cast(sum(v * c) as double), 6) end as churn_score from w"),
}
