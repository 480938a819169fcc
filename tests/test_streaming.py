import hashlib
import hmac
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from difftide.operators import memory
from difftide.operators.events import to_feedback
from difftide.operators.reports import dedup_findings, report_counts, report_markdown, report_summary
from difftide.sources.webhooks import read_comment_webhooks
from difftide.streaming import feeds, reviews, rule_state

T0 = datetime(2024, 1, 1)
RAW = "delivery_id long, received_at timestamp_ntz, body string, signature string"
FINDING = "task_id long, pr_id string, seq long, agent_id string, severity string, category string, file_path string, line_start int, line_end int, title string, description string, suggestion string"
TASK = "task_id long, pr_id string, trigger_event string, received_at timestamp"


def comments(spark, verbs, start, rule="XSS"):
    rows = [
        (start + i, T0 + timedelta(seconds=start + i), json.dumps({"comment": {"body": f"/feedback {'dismiss' if v == 'd' else 'accept'} {rule}"}}), None)
        for i, v in enumerate(verbs)
    ]
    return spark.createDataFrame(rows, RAW)


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def stats_of(spark, folder):
    feedback = to_feedback(read_comment_webhooks(spark.read.schema(RAW).parquet(folder)))
    return sorted(map(str, memory.compute_rule_stats(feedback).collect()))


# -- tasks -----------------------------------------------------------------------------------
def delivery(k, at, key=b"key", number=1):
    body = json.dumps({"action": "opened", "number": number, "pull_request": {"title": "t", "head": {}, "base": {}}, "repository": {"full_name": "o/r"}})
    return k, T0 + timedelta(seconds=at), body, "sha256=" + hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def test_unsigned_deliveries_give_no_task(spark, tmp_path):
    rows = [delivery(1, 0), delivery(2, 0)[:3] + ("sha256=00",), delivery(3, 0)[:3] + (None,)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "in"))
    feeds.run_to_table(feeds.stream_tasks(spark, "key", str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "p"))
    assert [r.task_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_redelivered_events(spark, tmp_path):
    """Within the bound one task; a forged copy takes no place; ids are forgotten after the bound; by default every delivery is a task."""
    feed, out, progress = (str(tmp_path / n) for n in ("in", "out", "p"))
    batches = [[delivery(1, 0, b"forged"), delivery(1, 1)], [delivery(1, 60), delivery(2, 61)], [delivery(3, 7200)], [delivery(1, 7201)]]
    seen = []
    for rows in batches:
        land(spark.createDataFrame(rows, RAW), feed)
        feeds.run_to_table(feeds.stream_tasks(spark, "key", feed, redelivery="10 minutes"), out, progress)
        seen.append(sorted(r.task_id for r in spark.read.parquet(out).collect()))
    assert seen == [[1], [1, 2], [1, 2, 3], [1, 1, 2, 3]]
    assert spark.read.format("statestore").load(progress).count() == 2  # 1 anew and 3; the first two are gone
    feeds.run_to_table(feeds.stream_tasks(spark, "key", feed), f"{out}-all", f"{progress}-all")
    assert sorted(r.task_id for r in spark.read.parquet(f"{out}-all").collect()) == [1, 1, 1, 2, 3]


# -- rule statistics -------------------------------------------------------------------------
def test_rule_state_survives_batches_and_restarts(spark, tmp_path):
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    assert rule_state.latest_batch(spark, state) == -1 and rule_state.rule_stats_at(spark, state).count() == 0
    land(comments(spark, "daaa", 0).unionByName(comments(spark, "aad", 10, "NULL")), feed)
    one = {r.rule_category: r for r in rule_state.stream_rule_stats(spark, feed, state).collect()}
    assert one["XSS"].is_downgraded and one["XSS"].total == 4 and not one["NULL"].is_downgraded
    land(comments(spark, "aaaa", 20), feed)
    land(comments(spark, "ddddddddd", 30, "NULL"), feed)
    # A new query on the same folders continues where the first one ended, one file per batch.
    two = rule_state.stream_rule_stats(spark, feed, state, files_per_batch=1)
    assert sorted(map(str, two.collect())) == stats_of(spark, feed)
    assert rule_state.latest_batch(spark, state) == 2
    rows = {r.rule_category: r for r in two.collect()}
    assert rows["XSS"].is_downgraded and rows["XSS"].total == 8 and rows["NULL"].is_downgraded


def test_a_repeated_batch_does_not_count_twice(spark, tmp_path):
    """A micro-batch that ended before its commit was written is run again, on the state of the batch before."""
    feed, state = str(tmp_path / "feed"), tmp_path / "state"
    for start in (0, 10):
        land(comments(spark, "ddd", start), feed)
        assert rule_state.stream_rule_stats(spark, feed, str(state)).first().total == 3 * (1 + start // 10)
    (state / "commits" / "1").unlink()
    (state / "commits" / ".1.crc").unlink(missing_ok=True)
    assert rule_state.latest_batch(spark, str(state)) == 0 and rule_state.rule_stats_at(spark, str(state)).first().total == 3
    assert rule_state.stream_rule_stats(spark, feed, str(state)).first().total == 6


def test_a_busy_rule_is_many_keys(spark, tmp_path):
    """Stretches of one rule lie in several tasks and combine in order, whatever the span and the batches."""
    feed = str(tmp_path / "feed")
    for start, verbs in ((0, "aadd" * 30), (130, "d" * 40 + "a" * 80), (400, "ad" * 100)):
        land(comments(spark, verbs, start).unionByName(comments(spark, verbs[::-1], start, "OTHER")), feed)
    for span, batch in (("minute", 1), ("second", None), ("day", 2)):
        state = str(tmp_path / f"state-{span}")
        got = rule_state.stream_rule_stats(spark, feed, state, files_per_batch=batch, span=span)
        assert sorted(map(str, got.collect())) == stats_of(spark, feed)
        raw = spark.read.format("statestore").option("stateVarName", "sums").load(state).where("key.rule_category = 'XSS'")
        tasks, keys = raw.agg(F.count_distinct("partition_id"), F.count("*")).first()
        assert (tasks > 1 and keys >= 7) if span != "day" else (tasks, keys) == (1, 1)


def test_a_reader_sees_one_whole_version(spark, tmp_path):
    """Statistics chosen before two further micro-batches stay as they were; by number, each committed batch can be read."""
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    land(comments(spark, "ddd", 0), feed)
    rule_state.stream_rule_stats(spark, feed, state)
    early = rule_state.rule_stats_at(spark, state)
    for start in (10, 20):
        land(comments(spark, "aad", start).unionByName(comments(spark, "a", start, "NEW")), feed)
        rule_state.stream_rule_stats(spark, feed, state)
    assert [(r.rule_category, r.total) for r in early.collect()] == [("XSS", 3)]
    totals = [{r.rule_category: r.total for r in rule_state.rule_stats_at(spark, state, n).collect()} for n in range(3)]
    assert totals == [{"XSS": 3}, {"XSS": 6, "NEW": 1}, {"XSS": 9, "NEW": 2}]


# -- reviews ---------------------------------------------------------------------------------
def found(spark, *places, severity="CRITICAL"):
    rows = [(t, f"p{t}", 100 * t + n, "security", severity, "XSS", "F", n, n, "t", "d", "s") for t, n in places]
    return spark.createDataFrame(rows, FINDING)


def tasks_of(spark, *ids):
    return spark.createDataFrame([(k, f"p{k}", "PUSH" if k == 3 else "PR_OPENED", T0) for k in ids], TASK)


def texts(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.task_id, r.position)):
        out[r.task_id] = out.get(r.task_id, "") + r.text
    return out


@pytest.fixture
def flow(spark, tmp_path):
    """Folders of both feeds, and a call that takes in what has arrived."""
    names = {n: str(tmp_path / n) for n in ("tasks", "findings", "stats", "root", "progress")}

    def run():
        streams = [spark.readStream.schema(s).parquet(names[n]) for n, s in (("tasks", TASK), ("findings", FINDING))]
        return reviews.stream_reports(*streams, names["stats"], names["root"], names["progress"], token="t", buckets=8)

    return names, run


def batch_reports(spark, names):
    tasks, rows = (spark.read.schema(s).parquet(names[n]) for n, s in (("tasks", TASK), ("findings", FINDING)))
    deduped = dedup_findings(rows)
    return texts(report_markdown(report_summary(tasks, report_counts(deduped)), deduped))


def test_reviews_use_the_newest_statistics(spark, tmp_path):
    feed, state, out, progress, log = (str(tmp_path / n) for n in ("findings", "state", "out", "p", "comments"))
    stream = lambda: spark.readStream.schema(FINDING).parquet(feed)
    land(found(spark, (1, 1)), feed)
    assert reviews.stream_reviewed(stream(), state, out, progress).count() == 1
    land(found(spark, (1, 5)), feed)
    assert reviews.stream_reviewed(stream(), state, out, progress).count() == 2
    land(comments(spark, "dd", 0), log)
    rule_state.stream_rule_stats(spark, log, state)
    land(found(spark, (2, 1)), feed)
    assert sorted(r.task_id for r in reviews.stream_reviewed(stream(), state, out, progress).collect()) == [1, 1]


def test_reports_follow_both_feeds(spark, flow):
    """A review split over batches is one, a task without findings has a report, findings may come before their task."""
    names, run = flow
    land(tasks_of(spark, 1, 2, 3), names["tasks"])
    land(found(spark, (1, 1), (4, 7)), names["findings"])
    first = texts(run())
    assert set(first) == {1, 2, 3} and "No issues found." in first[2] and first == {k: v for k, v in batch_reports(spark, names).items() if k != 4}
    land(found(spark, (1, 5)), names["findings"])
    land(tasks_of(spark, 4), names["tasks"])
    reports = run()
    second = texts(reports)
    assert second == batch_reports(spark, names) and "Found 2 critical" in second[1] and "| 7 |" in second[4]
    assert {r.task_id: r.delivery for r in reports.collect()} == {1: "comments", 2: "comments", 3: "file", 4: "comments"}
    assert {r.task_id: r.version for r in reports.collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_a_batch_reads_and_writes_only_its_reviews(spark, flow):
    names, run = flow
    every = range(1, 41)
    land(tasks_of(spark, *every), names["tasks"])
    land(found(spark, *[(t, n) for t in every for n in (1, 2, 3)]), names["findings"])
    run()
    land(found(spark, (5, 9), (6, 9)), names["findings"])
    got = run()
    written = spark.read.parquet(f"{names['root']}/reports/batch=1")
    assert {r.task_id for r in written.collect()} == {5, 6} and written.count() == 2 * (1 + 4 + 1)
    assert texts(got) == batch_reports(spark, names)
    schema = spark.read.schema(FINDING).parquet(names["findings"]).schema
    touched = reviews.touched_reviews(spark, names["root"], spark.createDataFrame([], TASK).schema, schema, 1)
    assert sorted(r.task_id for r in touched.collect()) == [5, 6]
    some = [r[0] for r in touched.select(reviews._bucket(8)).distinct().collect()]
    read = reviews._so_far(spark, f"{names['root']}/kept", schema, 1, some)
    folders = {f.split("bucket=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect() for f in r}
    assert folders == {str(b) for b in some} and read.count() < 122 / 2
    assert read.join(touched, "task_id", "left_semi").count() == 8


def test_a_repeated_report_batch_replaces_its_own(spark, flow):
    names, run = flow
    land(tasks_of(spark, 1, 2), names["tasks"])
    land(found(spark, (1, 1), (2, 2)), names["findings"])
    before = texts(run())
    tasks, rows = (spark.read.schema(s).parquet(names[n]) for n, s in (("tasks", TASK), ("findings", FINDING)))
    again = reviews.write_reports_batch(tasks.schema, rows.schema, names["stats"], names["root"], "t", 8)
    again(reviews.review_changes(tasks, rows), 0)
    assert texts(reviews.current_reports(spark, names["root"])) == before
    again(reviews.review_changes(tasks.where("task_id = 2"), rows.limit(0)), 1)
    again(reviews.review_changes(tasks.where("task_id = 2"), rows.limit(0)), 1)
    assert texts(reviews.current_reports(spark, names["root"])) == before
    assert {r.task_id: r.version for r in reviews.current_reports(spark, names["root"]).collect()} == {1: 0, 2: 1}


def test_nothing_has_arrived(spark, flow):
    names, run = flow
    tasks_of(spark).write.parquet(names["tasks"])
    found(spark).write.parquet(names["findings"])
    assert run().count() == 0
