"""Session, experiment and benchmark analytics."""

from __future__ import annotations

from ..plans.sqlops import SqlOp

_FIRST = "select session, action as first_action from @rounds where idx = 1"
_NEXT = "select *, lead(action) over (partition by session order by idx) as next_action, lag(action) over (partition by session order by idx) as last_action from @rounds"
_FLAGS = f"select r.session, r.idx, r.action = f.first_action as present from @rounds r join ({_FIRST}) f on f.session = r.session"
_CLEARED = f"select session, min(case when not present then idx end) as cleared_at from ({_FLAGS}) x group by session"
_REOPENED = f"select f.session, max(case when f.present and f.idx > c.cleared_at then 1 else 0 end) = 1 as reopened from ({_FLAGS}) f join ({_CLEARED}) c on c.session = f.session group by f.session"
_CARRIES = f"select session, cast(sum(case when action = next_action then 1 else 0 end) as bigint) as repeated_carries from ({_NEXT}) n group by session"
_LAST = "select session, gate as final_gate, value from (select *, row_number() over (partition by session order by idx desc) as rk from @rounds) x where rk = 1"
_STATUS = f"select l.session, case when l.final_gate = 'pass' then 'converged' when o.reopened then 'thrashing' when c.cleared_at is not null then 'converging' else 'stalled' end as status, k.repeated_carries from ({_LAST}) l join ({_REOPENED}) o on o.session = l.session join ({_CLEARED}) c on c.session = l.session join ({_CARRIES}) k on k.session = l.session"


def _rate(condition: str) -> str:
    return f"round(avg(cast(case when {condition} then 1 else 0 end as double)), 3)"


_ARMS = f"select arm, count(*) as n, {_rate('presented')} as presented_rate, {_rate('top')} as top_rate, {_rate('cleared')} as cleared_rate, round(sum(case when cleared and regressed then 1 else 0 end) / cast(nullif(sum(case when cleared then 1 else 0 end), 0) as double), 3) as regression_after_fix, round(avg(checks), 3) as mean_checks from @trials group by arm"
_SIGNAL_ARMS = _ARMS.replace("select arm,", "select signal, arm,").replace("group by arm", "group by signal, arm")
_STATS = "select metric, count(*) as n, min(elapsed) as least, max(elapsed) as most, round(PCT(elapsed, 0.5), 6) as middle, round(avg(elapsed), 6) as mean, round(stddev_pop(elapsed), 6) as deviation, round(max(elapsed) - min(elapsed), 6) as spread from @samples group by metric"
_BUCKET = "case when status <> 'completed' then 'provider_failed' when regressed then 'regressed' when not presented then case when final_clean then 'clean_but_missed_expected_signal' else 'missed_expected_signal' end when not top then case when final_clean then 'clean_but_misranked' else 'expected_signal_present_not_top' end when convergence = 'thrashing' then 'thrashing' when convergence = 'stalled' then 'stalled' when final_clean then 'clean' else 'incomplete' end"
_SCORE = f"""
    with v as (select signal, count(*) as reviewed, sum(case when category = 'tp' then 1 else 0 end) as tp, sum(case when category = 'fp' then 1 else 0 end) as fp, sum(case when category = 'acceptable' then 1 else 0 end) as ok, sum(case when category = 'inconclusive' then 1 else 0 end) as open_ones, min(idx) as first_idx from @verdicts group by signal)
    select signal, reviewed, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(open_ones as bigint) as inconclusive, round((tp + ok) / cast(nullif(reviewed - open_ones, 0) as double), 3) as precision_, round(fp / cast(nullif(reviewed - open_ones, 0) as double), 3) as noise, first_idx from v"""

OPS: dict[str, SqlOp] = {
    "session_state": SqlOp("Event index of each session's check", "select session, idx as event_index, action from @rounds"),
    "repeated_carries": SqlOp("Neighbouring checks with the same top action", _CARRIES),
    "followup_metrics": SqlOp("By action: how often the next check has cleared it", f"select action, count(*) as runs, cast(sum(case when next_action is not null then 1 else 0 end) as bigint) as followed, cast(sum(case when next_action <> action then 1 else 0 end) as bigint) as cleared from ({_NEXT}) n group by action"),
    "checks_to_clear": SqlOp("Checks until the first top action is gone; null if never", f"select session, cleared_at - 1 as checks_to_clear from ({_CLEARED}) c"),
    "reopened": SqlOp("Whether the first top action went and came back", _REOPENED),
    "convergence_status": SqlOp("converged, thrashing, converging or stalled", _STATUS),
    "session_summary": SqlOp("Sessions by status", f"select status, count(*) as sessions, round(avg(cast(repeated_carries as double)), 6) as mean_carries from ({_STATUS}) s group by status"),
    "outcome_bucket": SqlOp("Outcome of each trial by the first case that fits", f"select event_id, lane, {_BUCKET} as bucket from @trials"),
    "focus_area_summary": SqlOp("Outcomes by signal", f"select signal, {_BUCKET} as bucket, count(*) as n from @trials group by 1, 2"),
    "session_trials": SqlOp("Presented, missed and top counts by signal and lane", "select signal, lane, count(*) as expected, cast(sum(case when presented then 1 else 0 end) as bigint) as presented, cast(sum(case when not presented then 1 else 0 end) as bigint) as missed, cast(sum(case when top then 1 else 0 end) as bigint) as top_count from @trials group by signal, lane"),
    "seeded_recall": SqlOp("Recall to 3 decimals by lane; null without trials", f"select signal, round(sum(case when lane = 'live' and presented then 1 else 0 end) / cast(nullif(sum(case when lane = 'live' then 1 else 0 end), 0) as double), 3) as live_recall, round(sum(case when lane = 'replay' and presented then 1 else 0 end) / cast(nullif(sum(case when lane = 'replay' then 1 else 0 end), 0) as double), 3) as replay_recall, {_rate('presented')} as recall, {_rate('top')} as top_recall from @trials group by signal"),
    "remediation_rate": SqlOp("Fixed and regressed by signal", f"select signal, count(*) as total, cast(sum(case when cleared then 1 else 0 end) as bigint) as fixed, cast(sum(case when regressed then 1 else 0 end) as bigint) as regressions, {_rate('cleared')} as remediation_rate from @trials group by signal"),
    "verdict_rates": SqlOp("Rates over known answers, mean cost and net value", f"with r as (select lane, {_rate('top')} as follow, {_rate('cleared')} as help, {_rate('not regressed')} as success, {_rate('regressed')} as expansion, round(avg(checks), 3) as cost from @trials group by lane) select lane, follow, help, success, expansion, cost, round(greatest(-1.0, least(1.0, (follow + help + success) / 3 - (expansion + least(1.0, greatest(cost - 1, 0) / 3)) / 2)), 3) as net_value from r"),
    "net_value_score": SqlOp("Mean of the gains less mean of the penalties, within 1 either way", f"with r as (select arm, {_rate('top')} as follow, {_rate('cleared')} as help, {_rate('regressed')} as expansion from @trials group by arm) select arm, round(greatest(-1.0, least(1.0, (follow + help) / 2 - expansion)), 3) as net_value from r"),
    "arm_summary": SqlOp("Counts and rates of each experiment arm", _ARMS),
    "arm_effects": SqlOp("Differences to the arm without intervention", f"with a as ({_ARMS}) select t.arm, round(t.top_rate - c.top_rate, 3) as top_delta, round(t.cleared_rate - c.cleared_rate, 3) as cleared_delta, round(t.mean_checks - c.mean_checks, 3) as checks_delta from a t cross join a c where c.arm = 'no_intervention' and t.arm <> 'no_intervention'"),
    "signal_arm_effects": SqlOp("The same by signal, with whether it qualifies", f"with a as ({_SIGNAL_ARMS}) select t.signal, t.arm, round(t.cleared_rate - c.cleared_rate, 3) as cleared_delta, t.n >= 3 and t.cleared_rate >= c.cleared_rate as qualifies from a t join a c on c.signal = t.signal where c.arm = 'no_intervention' and t.arm <> 'no_intervention'"),
    "review_precision": SqlOp("Review counts, precision and noise by signal", _SCORE),
    "signal_scorecard": SqlOp("Review and trial evidence by signal, whichever exists", f"with r as ({_SCORE}), t as (select signal, count(*) as trials, {_rate('presented')} as recall from @trials group by signal) select coalesce(r.signal, t.signal) as signal, r.reviewed, r.precision_, t.trials, t.recall from r full outer join t on t.signal = r.signal"),
    "promotion_candidates": SqlOp("Signals whose precision and noise pass", f"select signal from ({_SCORE}) s where precision_ >= 0.8 and noise <= 0.2"),
    "demotion_candidates": SqlOp("Signals that violate a limit, with the limits", f"select signal, precision_ < 0.8 as low_precision, noise > 0.2 as high_noise from ({_SCORE}) s where precision_ < 0.8 or noise > 0.2"),
    "promotion_recommendation": SqlOp("First case that fits: noise, outcome, fix guidance, then keep; a rate without samples decides nothing", f"with s as ({_SCORE}), t as (select signal, count(*) as trials, {_rate('presented')} as recall, {_rate('top')} as follow, {_rate('cleared')} as remediation, {_rate('final_clean')} as session_clean, {_rate('regressed')} as regression, {_rate("convergence = 'thrashing'")} as thrash from @trials group by signal), m as (select coalesce(s.signal, t.signal) as signal, coalesce(s.reviewed, 0) as reviewed, coalesce(s.fp, 0) as fp, s.noise, s.precision_, t.recall, coalesce(t.trials, 0) as trials, t.follow, t.remediation, t.session_clean, t.regression, t.thrash from s full outer join t on t.signal = s.signal) select signal, case when reviewed > 0 and fp > 0 then 'degrade_or_quarantine' when reviewed > 0 and noise > 0.2 then 'needs_review' when recall < 0.95 then 'improve_detection' when precision_ < 0.8 then 'reduce_noise' when trials >= 3 and follow < 0.6 then 'improve_fix_guidance' when remediation < 0.6 or session_clean < 0.6 or regression > 0.4 or thrash > 0.3 then 'improve_fix_guidance' else 'keep_unspecified' end as recommendation from m"),
    "completion_gates": SqlOp("A phase passes when no required condition fails", f"with c as (select 'precision' as condition, true as required, avg(precision_) >= 0.5 as passed from ({_SCORE}) a union all select 'volume', true, sum(reviewed) >= 10 from ({_SCORE}) b union all select 'noise', false, max(noise) <= 0.2 from ({_SCORE}) d) select min(case when required and not passed then 0 else 1 end) = 1 as passed, cast(sum(case when required and not passed then 1 else 0 end) as bigint) as failed_required, cast(sum(case when not required and not passed then 1 else 0 end) as bigint) as failed_optional from c"),
    "signal_backlog": SqlOp("Missed signals by weighted misses", "select signal, cast(3 * sum(case when lane = 'live' and not presented then 1 else 0 end) + 2 * sum(case when lane = 'replay' and not presented then 1 else 0 end) + 2 * sum(case when regressed then 1 else 0 end) as bigint) as priority from @trials group by signal"),
    "benchmark_stats": SqlOp("Count, range, median, mean and deviation of each metric", _STATS),
    "regression_class": SqlOp("fail over 250 and 20 %, warn over 150 and 10 %, else pass", f"with s as ({_STATS}), b as (select avg(mean) as base from s) select metric, round(mean - base, 6) as delta, case when mean - base > 250 and (mean - base) / base > 0.2 then 'fail' when mean - base > 150 and (mean - base) / base > 0.1 then 'warn' else 'pass' end as class from s cross join b"),
    "representative_sample": SqlOp("The sample nearest to all medians", f"with s as ({_STATS}), d as (select x.sample, sum(abs(x.elapsed - s.middle)) as distance from @samples x join s on s.metric = x.metric group by x.sample) select sample, round(distance, 6) as distance from (select *, row_number() over (order by distance, sample) as rk from d) y where rk = 1"),
}
