"""What the reports move: findings once, and texts once."""

import re
from pathlib import Path

import pytest

from difftide.operators import importance, reports
from difftide.plans import catalog, derived
from difftide.session import job_settings
from difftide.sinks import outputs
from difftide.streaming import reviews
from test_reports import LEVELS, finding, table, tasks

SF = Path("/root/testdata/sf0.001")


def final_plan(df):
    """Lines of the plan that has run, without its first version."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def some(spark):
    return table(spark, [finding(1 + i % 3, i, LEVELS[i % 4], "c", f"F{i % 7}.java", i % 9, i % 9) for i in range(300)]).repartition(3)


def test_findings_move_once_and_unsorted(spark):
    plan = final_plan(reports.dedup_findings(some(spark)))
    moves = [i for i, line in enumerate(plan) if re.search(r"\bExchange hashpartitioning", line)]
    assert len(moves) == 1
    assert not any("Aggregate" in line or "Sort " in line for line in plan[moves[0]:])


def test_all_parts_of_a_report_share_the_findings_that_have_moved(spark):
    f = some(spark)
    text = reports.report_markdown(reports.reports(tasks(spark, 1, 2, 3, 4), f), reports.dedup_findings(f))
    plan = final_plan(text)
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan) == 1
    assert sum(bool(re.search(r"ReusedExchange .*REPARTITION_BY_COL", line)) for line in plan) >= 2


def test_rows_of_a_report_are_rendered_where_findings_were_deduplicated(spark):
    rows = [finding(1 + i % 3, i, LEVELS[i % 4], "c", [None, "", "(unknown)", "F.java"][i % 5 % 4], i % 9, i % 7) for i in range(300)]
    known = tasks(spark, 1, 2, 3).select("task_id", "pr_id")
    placed = reports.report_rows(reports.placed_findings(table(spark, rows).repartition(3)), known)
    assert not any(re.search(r"Exchange hashpartitioning\(task_id#\w+, file#", line) for line in final_plan(placed))
    assert sorted(placed.collect()) == sorted(reports.report_rows(reports.dedup_findings(table(spark, rows)), known).collect())


@pytest.fixture
def no_small_joins(spark):
    """The planner takes no table for small by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("few", [reviews.FEW, 0])
def test_newest_reports_are_read_where_they_lie_if_few_are_renewed(spark, tmp_path, monkeypatch, no_small_joins, few):
    monkeypatch.setattr(reviews, "FEW", few)
    for batch, ids in enumerate([[1, 2, 3], [2], [3]]):
        pieces = spark.createDataFrame([(i, "o/r", k, "row", f"{batch}-{k}", "none") for i in ids for k in range(2)], reviews.PIECES)
        reviews._store(pieces, f"{tmp_path}/reports", batch, 4)
        if batch < 2:  # the last list of versions isn't written yet
            pieces.where("position = 0").select("task_id").write.parquet(f"{tmp_path}/versions/batch={batch}")
    got = reviews.current_reports(spark, str(tmp_path))
    joins = " ".join(line for line in final_plan(got) if "Join" in line)
    assert ("BroadcastHashJoin" in joins) == (few > 0) and "SortMergeJoin" not in joins
    assert sorted((r.task_id, r.version, r.position, r.text) for r in got.collect()) == [(i, v, k, f"{v}-{k}") for i, v in ((1, 0), (2, 1), (3, 0)) for k in range(2)]


def test_micro_batches_of_many_reviews_give_the_reports_of_few(spark, tmp_path, monkeypatch):
    t = tasks(spark, 1, 2, 3, 4).selectExpr("task_id", "pr_id", "trigger_event", "timestamp '2024-01-01 00:00:00' AS received_at")
    f = some(spark)
    changes = [(t.where("task_id < 3"), f.where("seq % 2 = 0")), (t.where("task_id > 2"), f.where("seq % 2 = 1 AND task_id <> 1"))]
    got = []
    for few in (reviews.FEW, 0):
        monkeypatch.setattr(reviews, "FEW", few)
        root = str(tmp_path / str(few))
        write = reviews.write_reports_batch(t.schema, f.schema, f"{root}/stats", f"{root}/flow", "t", 4)
        for batch, change in enumerate(changes):
            write(reviews.review_changes(*change), batch)
        got.append(sorted(map(str, reviews.current_reports(spark, f"{root}/flow").collect())))
    assert got[0] == got[1]
    seen = f.where("task_id <> 1 OR seq % 2 = 0")
    whole = reports.report_markdown(reports.reports(t, seen), reports.dedup_findings(seen))
    names = ["task_id", "position", "kind", "text"]
    assert sorted(reviews.current_reports(spark, f"{root}/flow").select(names).collect()) == sorted(whole.select(names).collect())


def test_pieces_move_once_to_their_comment(spark):
    f, t = some(spark), tasks(spark, 1, 2, 3)
    pieces = reports.report_markdown(reports.reports(t, f), reports.dedup_findings(f)).localCheckpoint()
    plan = final_plan(outputs.summary_comments(pieces, t))
    # The pieces, and the tasks on either side of them.
    assert sum("Exchange" in line and "ReusedExchange" not in line for line in plan) == 3


def test_findings_without_a_place_have_one_order(spark):
    rows = [finding(1, None, "INFO", f"c{i % 50:02}", start=1, end=i // 50) for i in range(200)]
    for parts in (1, 5):
        ranked = reports.rank_findings(reports.dedup_findings(table(spark, rows[::-1]).repartition(parts))).orderBy("rank").collect()
        assert [(r.line_end, r.category) for r in ranked] == [(i // 50, f"c{i % 50:02}") for i in range(200)]


@pytest.mark.skipif(not SF.exists(), reason="needs the given tables")
def test_parts_of_derived_rows_grow_with_splits_and_landed_files_do_not(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.createDataFrame([(k, 1, k, 1, 5.0) for k in range(500)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double") \
        .repartition(cores + 2).write.parquet(str(tmp_path / "lineitem.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = derived.derived(spark, str(tmp_path), "fx_findings")
        assert rows.rdd.getNumPartitions() > cores and rows.count() == 500
        catalog._landed(rows, str(tmp_path / "landed"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert 0 < len(list((tmp_path / "landed").glob("part-*"))) <= cores
    assert derived.derived(spark, str(SF), "fx_findings").rdd.getNumPartitions() == cores


def test_files_move_once_to_the_last_part_of_their_names(spark, tmp_path):
    rows = [(t, "p", k, f"src/a/b/c/C{k}.java", f"import b.c.C{k + 1};\nimport static a.b.c.C{k - 1}.of;") for t in (1, 2) for k in range(6)]
    spark.createDataFrame(rows, "task_id long, pr_id string, file_seq int, file_path string, diff_content string").repartition(3).write.parquet(str(tmp_path / "files"))
    before = {name: spark.conf.get(name, None) for name in importance.JOB}
    with job_settings(spark, importance.JOB):
        links = importance.import_links(spark.read.parquet(str(tmp_path / "files")))
        plan = final_plan(links)
    assert {name: spark.conf.get(name, None) for name in importance.JOB} == before
    moves = [line for line in plan if re.search(r"\bExchange hashpartitioning", line)]
    assert len(moves) == 3 and not any(re.search(r"\bname#", line) for line in moves)
    # Names are given behind the move, so a file is one row of it.
    explodes = [i for i, line in enumerate(plan) if "Generate explode" in line and "substring_index" in line]
    assert explodes and any("Exchange hashpartitioning(task_id" in line for line in plan[explodes[0]:])
    assert sorted(map(tuple, links.collect())) == sorted((t, k, j) for t in (1, 2) for k in range(6) for j in (k - 1, k + 1) if 0 <= j < 6)
    kept = importance.stored_links(spark.read.parquet(str(tmp_path / "files")))
    assert {(r.importing, r.out) for r in kept.collect()} == {(k, 1 if k in (0, 5) else 2) for k in range(6)}


def test_heads_alone_move_no_texts_and_count_the_same(spark):
    rows = [finding(1 + i % 3, i * 7 % 400, [*LEVELS, "ODD", None][i % 6], [None, "", "c"][i % 7 % 3], [None, "", "(unknown)", "F.java"][i % 5 % 4], i % 3, i % 2) for i in range(400)]
    f, t = table(spark, rows + rows[:50]).repartition(3), tasks(spark, 1, 2, 3, 4)
    heads = reports.reports(t, f, alone=True)
    assert sorted(heads.collect()) == sorted(reports.reports(t, f).collect())
    moves = [line for line in final_plan(reports.counted_findings(f)) if "Exchange hashpartitioning" in line]
    assert len(moves) == 1
    assert not any(name in reports.counted_findings(f)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0] for name in ("title", "description", "suggestion"))


def test_stored_tables_of_the_flow_are_packed(spark, tmp_path):
    pieces = spark.createDataFrame([(1, "o/r", 0, "row", "t", "none")], reviews.PIECES)
    reviews._store(pieces, f"{tmp_path}/reports", 0, 4)
    assert [f.name.endswith(".zstd.parquet") for f in tmp_path.rglob("*.parquet")] == [True]
