"""The registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tools
from .operators import contracts, degrees, evolution, findings, graph, guardrails, health, resolution, rules, sessions, structural
from .plans.sqlops import SqlOp
from .plans.views import RELATIONS
from .streaming import events

#: A fixed now for heat: later than every event of the test data.
HEAT_NOW = 1_706_745_600

FAMILIES = (evolution, degrees, health, rules, sessions, findings, guardrails, structural, contracts, tools)
#: Families of functions: name to (operator, its relations in order, its DuckDB SQL or None).
COMPUTED = graph.GRAPH | resolution.OPS | contracts.COMPUTED | degrees.COMPUTED | findings.RANKED | guardrails.COMPUTED | tools.COMPUTED


def _bound(op: SqlOp) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op.run(spark, **RELATIONS.frames(spark, sf_dir, op.sql))


def _kernel(f: Callable[..., DataFrame], names: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = RELATIONS.frames(spark, sf_dir, " ".join(f"@{n}" for n in names))
        return f(*(frames[n] for n in names))

    return run


def sql_ops() -> dict[str, SqlOp]:
    return {name: op for family in FAMILIES for name, op in family.OPS.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    streams = {
        "heat_update": _kernel(lambda e: events.heat(e, HEAT_NOW, half_life=864_000.0).select("path", F.round("heat", 6).alias("heat"), "last_ts"), ("file_events",)),
        "hot_files": _kernel(lambda e: events.hot_files(e, HEAT_NOW, half_life=864_000.0), ("file_events",)),
        "incremental_rescan": _kernel(lambda f: events.incremental_rescan(f.select("path", "lines"), f.filter("k % 10 = 1").select("path", (F.col("lines") + 1).alias("lines")), f.filter("k % 10 = 2").select("path")), ("files",)),
    }
    return streams | {name: _bound(op) for name, op in sql_ops().items()} | {name: _kernel(f, names) for name, (f, names, _) in COMPUTED.items()}


#: The fold of each path's changes in order, and its decay until now.
_HEAT = f"e as (select path, ts, row_number() over (partition by path order by ts, event_id) as n from @file_events where path is not null), r as (select path, n, ts, cast(1 as double) as heat from e where n = 1 union all select e.path, e.n, e.ts, least(r.heat * exp(-ln(2.0) * (e.ts - r.ts) / 864000.0) + 1, 5.0) from r join e on e.path = r.path and e.n = r.n + 1), h as (select r.path, r.heat * exp(-ln(2.0) / 864000.0 * greatest({HEAT_NOW} - r.ts, 0)) as heat, r.ts as last_ts from r join (select path, max(n) as n from e group by path) m on m.path = r.path and m.n = r.n)"


def oracle_sql() -> dict[str, str]:
    streams = {
        "incremental_rescan": RELATIONS.oracle("select path, case when k % 10 = 1 then lines + 1 else lines end as lines from @files where k % 10 <> 2"),
        "heat_update": RELATIONS.oracle(f"with recursive {_HEAT} select path, round(heat, 6) as heat, last_ts from h where heat > 0.01", recursive=True),
        "hot_files": RELATIONS.oracle(f"with recursive {_HEAT} select path, round(heat, 6) as heat from h where heat > 0.5", recursive=True),
    }
    plain = streams | {name: RELATIONS.oracle(op.sql) for name, op in sql_ops().items()}
    return plain | {name: RELATIONS.oracle(sql, recursive=True) for name, (_, _, sql) in COMPUTED.items() if sql}
