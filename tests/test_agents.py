import json

from pyspark.sql import functions as F

from difftide.operators import diffs, findings as fi
from difftide.plans.catalog import big_change_agent

SCHEMA = "task_id long, pr_id string, agent_id string, response string, error string"
BODY = "diff --git a/src/m/F.java b/src/m/F.java\n--- a/src/m/F.java\n+++ b/src/m/F.java\n@@ -1 +1,2 @@\n+System.out.println(x);\n"


def result(path, severity="MAJOR", **more):
    return {"severity": severity, "category": "c", "filePath": path, "lineStart": 1, "lineEnd": 2, "title": "t", "description": "d", "suggestion": "s", **more}


def responses(spark, rows):
    return spark.createDataFrame([(t, f"p{t}", a, r if r is None or isinstance(r, str) else json.dumps({"results": r}), e) for t, a, r, e in rows], SCHEMA)


def files(spark):
    df = spark.createDataFrame([(1, "p1", BODY), (2, "p2", "")], "task_id long, pr_id string, body string")
    return df, diffs.changed_files(df)


def test_fan_in(spark):
    df, changed = files(spark)
    rows = responses(spark, [
        (1, "logic", [result("F.java"), result(" "), result("other.java")], None), (1, "security", "{oops", None), (1, "code-style", [result(None)], None),
        (1, "architecture", [], "timeout"), (2, "logic", [result("F.java")], None), (2, "security", "null", None), (2, "code-style", [result("F", "HUGE")], None),
        (2, "architecture", '{"results":null}', None),
    ])
    found = fi.all_findings(rows, changed).orderBy("task_id", "seq").collect()
    got = [(r.task_id, r.agent_id, r.title, r.file_path) for r in found]
    assert got == [
        (1, "architecture", "Architecture review failed", ""), (1, "code-style", "No code style issues found", ""),
        (1, "logic", "t", "F.java"), (1, "logic", "t", "other.java"), (1, "security", "Security review failed", ""),
        (2, "architecture", "No architecture issues found", ""), (2, "code-style", "Code style review failed", ""),
        (2, "logic", "No logic issues found", ""), (2, "security", "Security review failed", ""),
    ]
    assert [r.description for r in found if r.title == "Architecture review failed"][0].endswith("internal error: timeout")
    strict = fi.all_findings(rows, changed, paths=diffs.changed_paths(df)).where("agent_id = 'logic'").orderBy("task_id", "seq").collect()
    assert [(r.task_id, r.title, r.file_path) for r in strict] == [(1, "t", "F.java"), (2, "No logic issues found", "")]


def test_one_pass_equals_the_single_operators(spark):
    _, changed = files(spark)
    rows = responses(spark, [(1, "logic", [result("F.java"), result("")], None), (1, "security", None, "e"), (2, "logic", [result("F")], None)])
    valid = fi.valid_findings(fi.parse_agent_responses(rows), changed)
    parts = valid.unionByName(fi.no_issue_rows(rows, valid)).unionByName(fi.agent_failures(rows))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(parts) == key(fi.model_findings(rows, changed).select(*parts.columns))


def test_tool_rows_survive_other_agents_failures(spark):
    _, changed = files(spark)
    ok = responses(spark, [(1, "security", [], None), (1, "code-style", None, "e")])
    got = [r.title for r in fi.all_findings(ok, changed).where("category = 'static-analysis'").collect()]
    assert got == ["SYSTEM_OUT_USAGE"]


def test_strict_paths(spark):
    df, _ = files(spark)
    rows = responses(spark, [(1, "logic", [result("m\\F.java"), result("src/m/F.java"), result("G.java"), result("src/m/F.java\nx")], None)])
    kept = fi.valid_findings_strict(fi.parse_agent_responses(rows), diffs.changed_paths(df))
    assert sorted(r.file_path for r in kept.collect()) == ["m\\F.java", "src/m/F.java"]


def test_custom_agents(spark):
    df, changed = files(spark)
    fi.register_agent("all", lambda c, f: f.select(
        "task_id", "pr_id", F.lit(0).cast("long").alias("seq"), F.lit("INFO").alias("severity"), F.lit("x").alias("category"), "file_path", F.lit(1).alias("line_start"),
        F.lit(1).alias("line_end"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("s").alias("suggestion")))
    fi.register_agent("size", big_change_agent)
    assert {"all", "size"} <= set(fi.registered_agents())
    extra = fi.run_agents(diffs.contexts(df), changed, ["all", "size"])
    rows = responses(spark, [(1, "logic", [], None)])
    found = fi.all_findings(rows, changed, *extra).collect()
    assert len({(r.task_id, r.seq) for r in found}) == len(found)
    assert [r.agent_id for r in sorted(found, key=lambda r: r.seq)][-1] == "all"
    got = sorted((r.agent_id, r.title) for r in found)
    assert got == [("all", "t"), ("logic", "No logic issues found"), ("security", "SYSTEM_OUT_USAGE")]


def test_custom_agents_may_repeat_rows(spark):
    """Every row counts, also rows alike in everything; each has a place of its own."""
    df, changed = files(spark)
    row = ["task_id", "pr_id", F.lit(0).cast("long").alias("seq"), F.lit("INFO").alias("severity"), F.lit("x").alias("category"), "file_path", F.lit(1).alias("line_start"),
           F.lit(1).alias("line_end"), F.lit("t").alias("title"), F.col("d").alias("description"), F.lit("s").alias("suggestion")]
    fi.register_agent("twice", lambda c, f: f.select("*", F.explode(F.array(*map(F.lit, "aabca"))).alias("d")).select(*row))
    got = fi.run_agent("twice", diffs.contexts(df), changed).collect()
    assert sorted(r.description for r in got) == list("aaabc") and len({(r.task_id, r.seq) for r in got}) == 5
    again = fi.run_agent("twice", diffs.contexts(df), changed.repartition(3)).collect()
    assert sorted((r.seq, r.description) for r in got) == sorted((r.seq, r.description) for r in again)


def test_fan_in_sorts_nothing(spark):
    """Hits and responses meet keys that are hashed; before, large tables were sorted and spilled for it."""
    _, changed = files(spark)
    found = fi.all_findings(responses(spark, [(1, "security", "{oops", None), (1, "logic", [result("F.java")], None)]), changed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    # Hits are as wide as the rules make them when they meet the keys; suggestions are added later.
    assert plan.index("Review and fix the identified code issue.") < plan.rindex("ShuffledHashJoin") and {r.agent_id for r in found.collect()} == {"security", "logic"}
