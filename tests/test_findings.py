"""Orders over findings keep every finding unless the caller gives a limit."""

from plumbline.operators import findings

SCHEMA = "key string, kind string, severity string, concept string, file string, score long, trust string, scope string"


def frame(spark, rows):
    return spark.createDataFrame([(key, kind, severity, "c", "f", score, trust, scope) for key, kind, severity, score, trust, scope in rows], SCHEMA)


def order(df, place):
    rows = sorted(df.collect(), key=lambda r: r[place])
    assert [r[place] for r in rows] == list(range(1, len(rows) + 1))
    return [r["key"] for r in rows]


def test_brief_ranking_keeps_all_findings(spark):
    df = frame(spark, [(f"f{i:02}", "large_file", "low", 9000 - i, "trusted", "s") for i in range(25)])
    assert order(findings.brief_ranking(df), "rank_no") == [f"f{i:02}" for i in range(25)]
    assert order(findings.brief_ranking(df, 4), "rank_no") == ["f00", "f01", "f02", "f03"]


def test_brief_ranking_orders_by_leverage_and_presentation_before_trust_and_score(spark):
    rows = [
        ("low", "large_file", "low", 9999, "trusted", "a"),
        ("secondary", "large_file", "medium", 9000, "trusted", "a"),
        ("hardening", "large_file", "medium", 100, "trusted", "a"),
        ("experimental", "cycle_cluster", "medium", 9999, "experimental", "a"),
        ("watched_clone", "clone_family", "medium", 3000, "watchpoint", "a"),
        ("small_clone", "clone_family", "medium", 1000, "trusted", "a"),
        ("clone", "clone_family", "medium", 2500, "trusted", "a"),
        ("cycle", "cycle_cluster", "medium", 5000, "watchpoint", "a"),
        ("high", "large_file", "high", 10, "trusted", "a"),
    ]
    want = ["high", "cycle", "clone", "watched_clone", "small_clone", "secondary", "hardening", "experimental", "low"]
    assert order(findings.brief_ranking(frame(spark, rows)), "rank_no") == want


def test_clone_hints_go_round_all_hints(spark):
    rows = [(f"a{i}", "clone_family", "low", 100 - i, "trusted", "s") for i in range(6)] + [("b0", "large_file", "low", 1, "trusted", "s"), ("b1", "large_file", "low", 0, "trusted", "s")]
    df = frame(spark, rows)
    assert order(findings.clone_hints(df), "hint_no") == ["a0", "b0", "a1", "b1", "a2", "a3", "a4", "a5"]
    assert order(findings.clone_hints(df, 3), "hint_no") == ["a0", "b0", "a1"]
