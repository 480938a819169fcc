import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from difftide.operators import ledger
from difftide.operators.bug_rules import BUG_RULES
from difftide.operators.diffs import changed_files, hunks
from difftide.operators.rules import scan
from difftide.plans import catalog

RULES = [BUG_RULES["rule_system_out"], BUG_RULES["rule_todo"]]
NOW = datetime(2024, 5, 1, 12)


# -- reviewed hunks ----------------------------------------------------------------------------
def push(spark, task, *pieces, pr="p", path="src/A.java"):
    """Hunks of a push: each piece is (first line, lines)."""
    body = f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n" + "".join(f"@@ -{at},9 +{at},9 @@\n{text}\n" for at, text in pieces)
    return hunks(changed_files(spark.createDataFrame([(task, pr, body)], "task_id long, pr_id string, body string")))


def headers(rows):
    return sorted((r.task_id, r.header.split(",")[0][4:]) for r in rows.collect())


A, B, C = " x\n-old\n+new\n y", "+added\n z", " q\n-gone"


def test_two_pushes_of_one_pull_request(spark, tmp_path):
    """Hunks that only moved or got other surroundings are known; changed and further ones are not."""
    book = str(tmp_path / "ledger")
    assert headers(ledger.review_push(push(spark, 1, (1, A), (50, B)), book, 0)) == [(1, "1"), (1, "50")]
    moved, surroundings, changed = (21, A), (70, "+added\n other context"), (90, " x\n-old\n+newer\n y")
    second = push(spark, 2, moved, surroundings, changed, (99, C))
    assert headers(ledger.review_push(second, book, 1)) == [(2, "90"), (2, "99")]
    assert headers(ledger.review_push(second, book, 1)) == [(2, "90"), (2, "99")]  # repeated after a failure
    assert headers(ledger.review_push(second, book, 2)) == []
    assert headers(ledger.review_push(push(spark, 3, (1, A), path="src/B.java"), book, 3)) == [(3, "1")]
    assert headers(ledger.review_push(push(spark, 4, (1, A), pr="other"), book, 4)) == [(4, "1")]


def test_repeated_hunks_and_pushes_that_come_together(spark, tmp_path):
    book = str(tmp_path / "ledger")
    both = push(spark, 2, (1, A), (30, A), (60, B)).unionByName(push(spark, 1, (5, A)))
    assert headers(ledger.review_push(both, book, 0)) == [(1, "5"), (2, "30"), (2, "60")]
    assert headers(ledger.review_push(push(spark, 3, (1, A), (2, A), (3, A)), book, 1)) == [(3, "3")]
    assert ledger.review_push(both.limit(0), book, 2).count() == 0


def test_lines_are_told_apart(spark):
    rows = push(spark, 1, (1, "+a\n+b"), (9, "+a+b"), (20, "+a\n b")).unionByName(push(spark, 2, (1, " only context")))
    assert ledger.hunk_identities(rows).select("hunk_hash").distinct().count() == 4


def test_hunks_are_cut_and_hashed_once(spark, tmp_path):
    spark.createDataFrame([(1, "p", "diff --git a/A b/A\n@@ -1 +1 @@\n+x\n"), (2, None, "diff --git a/A b/A\n@@ -1 +1 @@\n+x\n")], "task_id long, pr_id string, body string").write.parquet(str(tmp_path / "diffs"))
    rows = ledger.unreviewed_hunks(hunks(changed_files(spark.read.parquet(str(tmp_path / "diffs")))), spark.createDataFrame([], ledger._LEDGER))
    assert [(r.task_id, r.pr_id) for r in rows.collect()] == [(1, "p")]  # a hunk without a key is not brought
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?:FileScan|Scan) parquet", plan)) == 1 and plan.count("sha2(") == 1


@pytest.mark.parametrize("tasks", [[5], [], [3, 40_000], [-9, -70_000]])
def test_highest_task_is_found_from_the_top(spark, tasks):
    known = spark.createDataFrame([(t,) for t in [*tasks, 90_000, -80_000]], "task_id long")
    costly = spark.createDataFrame([(t,) for t in tasks], "task_id long")
    assert catalog._highest(costly, known) == max(tasks, default=None)
    assert catalog._highest(costly, known.limit(0)) is None


# -- rule hits -----------------------------------------------------------------------------------
FILE = "task_id long, pr_id string, file_seq int, file_path string, diff_content string"
TEXTS = ["System.out.println(1);\nint a; // TODO later", "int b;", "System.out.println(2);", None, " ", "// FIXME x\nSystem.err.println(3);\n" * 50]


def files(spark, numbers, start=0):
    return spark.createDataFrame([(start + k, f"p{k}", k % 3, f"F{k}", TEXTS[k % len(TEXTS)]) for k in numbers], FILE).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()))


def scanned(spark, cache, run):
    return spark.read.parquet(f"{cache}/run={run}").count()


def test_contents_are_scanned_once_in_a_period(spark, tmp_path):
    cache, hour = str(tmp_path / "cache"), timedelta(hours=1)
    call = lambda df, run, at, version="1": ledger.cached_scan(df, RULES, version, cache, run, at, hour)
    one = files(spark, [k for k in range(60) if k % 6 != 5])
    assert rows(call(one, 0, NOW)) == rows(scan(one, RULES)) and scanned(spark, cache, 0) == 4
    every = files(spark, range(90), 1000)
    again = call(every, 1, NOW + timedelta(minutes=30))
    assert rows(again) == rows(scan(every, RULES)) and scanned(spark, cache, 1) == 1
    assert rows(call(every, 1, NOW + timedelta(minutes=30))) == rows(again) and scanned(spark, cache, 1) == 1
    assert rows(call(every, 2, NOW + timedelta(minutes=80))) == rows(again) and scanned(spark, cache, 2) == 4  # the fifth is younger
    assert rows(call(every, 3, NOW + timedelta(minutes=81), "2")) == rows(again) and scanned(spark, cache, 3) == 5
    assert call(every.limit(0), 4, NOW).count() == 0


def exchanged(df, capsys):
    """The columns of every exchange of the plan."""
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)


def test_no_text_is_exchanged(spark, tmp_path, capsys):
    files(spark, range(40)).write.parquet(str(tmp_path / "files"))
    df = spark.read.parquet(str(tmp_path / "files"))
    keys = ledger.content_keys(df)
    wanted = ledger.new_contents(keys, spark.createDataFrame([], "content_hash string"))
    for plan in (wanted, ledger.hits_of(df, RULES, wanted, 5)):
        moved = exchanged(plan, capsys)
        assert moved and not [m for m in moved if "diff_content" in m or "_text" in m]


@pytest.mark.parametrize("count", [1, 300, 5000])
def test_prefilter_lets_all_wanted_files_through(spark, count):
    """Every wanted file is found, and few others are scanned."""
    wanted = spark.range(count).select(F.col("id").alias("task_id"), (F.col("id") % 7).cast("int").alias("file_seq"), F.col("id").cast("string").alias("content_hash"))
    texts = spark.range(count * 4).select(F.col("id").alias("task_id"), F.lit("p").alias("pr_id"), (F.col("id") % 7).cast("int").alias("file_seq"), F.lit("F").alias("file_path"), F.lit("// TODO x").alias("diff_content"))
    got = ledger.hits_of(texts, RULES, wanted, count)
    assert got.count() == count and got.where(F.size("hits") != 1).count() == 0
    bitmap, bits = ledger.prefilter(wanted, count)
    assert sum(r[0] for r in bitmap.select(F.bitmap_count("bitmap")).collect()) <= count <= bits // 16
