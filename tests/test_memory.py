import random
from datetime import datetime, timedelta

import models

from difftide.operators import memory

SCHEMA = "id long, pr_id string, file_path string, line_start int, rule_category string, agent_type string, code_snippet string, feedback string, created_at timestamp_ntz"
T0 = datetime(2024, 1, 1)
FULL = {"a": "ACCEPTED", "d": "DISMISSED"}


def log(spark, verbs, rule="XSS", agent="security", start=0):
    rows = [(start + i, "p", "F.java", 1, rule, agent, None, FULL[v], T0 + timedelta(seconds=start + i)) for i, v in enumerate(verbs)]
    return spark.createDataFrame(rows, SCHEMA)


def stats_of(df):
    return {(r.agent_type, r.rule_category): r for r in memory.compute_rule_stats(df).collect()}


def test_flag_is_sticky_and_strict(spark):
    for verbs, flag in [("d", True), ("daaaaaaa", True), ("aaadddddddd", True), ("aaaddddddd", False), ("aaad", False), ("a", False)]:
        r = stats_of(log(spark, verbs))[("security", "XSS")]
        assert (r.is_downgraded, r.total, r.dismissed) == (flag, len(verbs), verbs.count("d"))
    r = stats_of(log(spark, "aaaddddddd"))[("security", "XSS")]
    assert r.dismiss_ratio == 0.7


def test_one_hot_rule_equals_a_sequential_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for rule, n, p in [("hot", 4000, 0.72), ("warm", 900, 0.69), ("r1", 5, 0.5), ("r2", 60, 0.75)]:
        verbs = ["ACCEPTED"] * 3 + ["DISMISSED" if rng.random() < p else "ACCEPTED" for _ in range(n)]
        # Many rows share a time stamp, so the id decides.
        rows += [(i, "p", "F", 1, rule, "x", None, v, T0 + timedelta(seconds=i // 50)) for i, v in enumerate(verbs)]
        want[("x", rule)] = models.sticky(verbs)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # Small partitions would be merged, which leaves one segment per rule.
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        got = {k: (r.total, r.accepted, r.dismissed, r.is_downgraded) for k, r in stats_of(df).items()}
        assert memory.rule_segments(df).where("rule_category = 'hot'").count() > 1
    finally:
        spark.conf.set(merge, "true")
    assert got == want
    assert {k: (r.total, r.accepted, r.dismissed, r.is_downgraded) for k, r in stats_of(df).items()} == want
    flags = {(r.agent_type, r.rule_category): r.is_downgraded for r in memory.rule_downgrade(df).collect()}
    assert flags == {k: v[3] for k, v in want.items()}


def test_counters_merge(spark):
    df = log(spark, "adadd")
    halves = memory.merge_counters(memory.rule_counters(df.where("id < 2")), memory.rule_counters(df.where("id >= 2")))
    assert halves.collect() == memory.rule_counters(df).collect()


def test_reset_restarts_counting(spark):
    df = log(spark, "dddaada")
    resets = spark.createDataFrame([("security", "XSS", T0 + timedelta(seconds=2)), ("security", "XSS", T0)], "agent_type string, rule_category string, reset_at timestamp_ntz")
    r = stats_of(memory.apply_resets(df, resets))[("security", "XSS")]
    assert (r.total, r.dismissed, r.is_downgraded) == (4, 1, False)


def test_lookup_of_unknown_rule(spark):
    keys = spark.createDataFrame([("security", "XSS"), ("logic", "X")], "agent_type string, rule_category string")
    got = {r.rule_category: (r.total, r.is_downgraded) for r in memory.rule_lookup(memory.compute_rule_stats(log(spark, "d")), keys).collect()}
    assert got == {"XSS": (1, True), "X": (None, False)}


def test_recent_feedback_limits_before_the_shuffle(spark, tmp_path):
    log(spark, "ad" * 100).write.parquet(str(tmp_path / "f"))
    df = memory.recent_feedback(spark.read.parquet(str(tmp_path / "f")))
    assert sorted(r.id for r in df.collect()) == list(range(150, 200))
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_hints(spark):
    feedback = log(spark, "ddddddddaa").unionByName(log(spark, "a", rule="OK", start=50))
    stats = memory.compute_rule_stats(feedback)
    assert [r.hint for r in memory.memory_hints(stats).collect()] == [
        "CAUTION: Rule 'XSS' from agent 'security' has been downgraded (dismissed 80% of 10 times). "
        "Consider whether this rule applies before flagging it."
    ]
    files = spark.createDataFrame([(1, "p", 1, "F.java"), (1, "p", 2, "G.java"), (2, "q", 1, "G.java")], "task_id long, pr_id string, file_seq int, file_path string")
    assert [(r.task_id, r.hint) for r in memory.file_history_hints(feedback, files).collect()] == [(1, "File 'F.java' has 11 past feedback record(s).")]
    assert [len(memory.hints_for_task(stats, feedback, files, t).collect()) for t in (1, 2, 3)] == [2, 1, 0]


FINDING = "task_id long, pr_id string, seq long, agent_id string, severity string, category string, file_path string, line_start int, line_end int, title string, description string, suggestion string"


def test_filter_verdicts(spark):
    stats = spark.createDataFrame(
        [("a", "drop", 10, 2, 8, 0.8, True), ("a", "soft", 10, 5, 5, 0.5, True), ("a", "off", 10, 1, 9, 0.9, False), ("codestyle", "drop", 3, 0, 3, 1.0, True)],
        "agent_type string, rule_category string, total long, accepted long, dismissed long, dismiss_ratio double, is_downgraded boolean",
    )
    rows = [
        ("a", "CRITICAL", "soft", "d"), ("a", "MAJOR", "soft", None), ("a", "MINOR", "soft", "d"), ("a", "INFO", "soft", "d"), ("a", "MAJOR", "drop", "d"),
        ("a", "MAJOR", "off", "d"), (None, "MAJOR", "drop", "d"), ("a", "MAJOR", None, "d"), ("a", "MAJOR", "  ", "d"), ("a", "MAJOR", "DROP", "d"),
        ("code-style", "MAJOR", "drop", "d"),
    ]
    df = spark.createDataFrame([(1, "p", i, a, s, c, "f", 1, 1, "t", d, None) for i, (a, s, c, d) in enumerate(rows)], FINDING)
    got = {r.seq: (r.severity, r.description) for r in memory.fp_filter(df, stats).collect()}
    suffix = memory.SOFTEN_SUFFIX
    assert got == {
        0: ("MAJOR", "d" + suffix), 1: ("MINOR", "null" + suffix), 2: ("INFO", "d" + suffix), 3: ("INFO", "d" + suffix),
        **{i: ("MAJOR", "d") for i in range(5, 11)},
    }
    assert sorted(r.seq for r in memory.fp_filter(df, stats, normalize_agent_ids=True).collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    s = memory.fp_filter_stats(df, stats).first()
    assert (s.rows_in, s.suppressed, s.downgraded, s.rows_out) == (11, 1, 4, 10)


def test_two_spellings_of_an_agent_are_one_rule(spark):
    stats = spark.createDataFrame(
        [("code-style", "r", 5, 4, 1, 0.2, False), ("codestyle", "r", 9, 2, 7, 0.7, True), ("code-style", "s", 9, 8, 1, 0.1, True), ("codestyle", "s", 3, 1, 2, 0.6, True)],
        "agent_type string, rule_category string, total long, accepted long, dismissed long, dismiss_ratio double, is_downgraded boolean",
    )
    df = spark.createDataFrame([(1, "p", i, "code-style", "MAJOR", c, "f", 1, 1, "t", "d", None) for i, c in enumerate("rs")], FINDING)
    rows = {r.seq: r.severity for r in memory.fp_filter(df, stats, normalize_agent_ids=True).collect()}
    assert rows == {1: "MINOR"}  # r: 8 of 14 dismissed, dropped; s: 3 of 12, softened once
