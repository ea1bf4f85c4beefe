"""Places within a severity by ranges, against the window of the SELECT."""

import random

from pyspark.sql import functions as F

from plumbline import queries, tools
from plumbline.plans.sqlops import SqlOp


def reports(spark, n=400):
    rng = random.Random(3)
    rows = [(k, f"f{i}", rng.randint(0, 30) * 300) for i in range(n) for k in ("large_file", "unstable_hotspot")]
    severity = F.when(F.col("score") >= 6500, "high").when(F.col("score") >= 3000, "medium").otherwise("low")
    return spark.createDataFrame(rows, "kind string, scope string, score bigint").withColumn("severity", severity)


def test_places_equal_the_window(spark):
    found = reports(spark)
    want = SqlOp("", "select kind, scope, score, severity, row_number() over (partition by severity order by score desc, kind, scope) as place from @x").run(x=found)
    got = tools.brief(found)
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect())
    assert not tools.brief(found.limit(0)).collect()


def test_no_task_holds_a_severity(spark, sf_dir):
    plan = queries.queries()["tool_agent_brief"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
