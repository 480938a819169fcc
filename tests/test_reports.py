import hashlib
import random

import pytest
from pyspark.sql import functions as F

from difftide.functions import markdown as md
from difftide.operators import extras, gate, reports
from difftide.sinks import outputs
from difftide.sources.webhooks import read_report_lines, read_reports

FINDING = "task_id long, pr_id string, seq long, agent_id string, severity string, category string, file_path string, line_start int, line_end int, title string, description string, suggestion string"
LEVELS = ["CRITICAL", "MAJOR", "MINOR", "INFO"]


def finding(task, seq, severity="MAJOR", category="c", path="F.java", start=1, end=1, agent="logic", title="t", description="d", suggestion="s"):
    return (task, f"o/r#{task}", seq, agent, severity, category, path, start, end, title, description, suggestion)


def table(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def tasks(spark, *ids):
    rows = [(i, f"o/r#{i}", "o/r", i, "s", "PR_OPENED") for i in ids]
    return spark.createDataFrame(rows, "task_id long, pr_id string, repo_name string, pr_number int, commit_sha string, trigger_event string")


def model(rows):
    """Sequential deduplication and ranking of one task."""
    kept = {}
    for r in sorted(rows, key=lambda r: r[2]):
        key = (r[6] or "", r[7], r[8], r[5] or "")
        if key not in kept or LEVELS.index(r[4]) < LEVELS.index(kept[key][4]):
            kept[key] = r
    first = list(kept.values())
    return [r[2] for r in sorted(first, key=lambda r: (LEVELS.index(r[4]), r[6] is None, r[6] or "", r[7]))]


def test_a_replacement_keeps_the_place_of_the_first(spark):
    rows = [finding(1, 0, "MINOR", "x"), finding(1, 1, "MAJOR", "y"), finding(1, 2, "MAJOR", "x", agent="security"), finding(1, 3, "MAJOR", "x")]
    got = reports.rank_findings(reports.dedup_findings(table(spark, rows))).orderBy("rank").collect()
    assert [(r.seq, r.first_seq, r.rank) for r in got] == [(2, 0, 1), (1, 1, 2)]


def test_ranks_equal_a_sequential_walk_with_a_hot_task(spark):
    rng = random.Random(1)
    rows = []
    for seq in range(4000):
        task = 1 if rng.random() < 0.5 else rng.randint(2, 9)
        path = rng.choice([None, "", "(unknown)", "a/F.java", "b/F.java", "c/G.java"])
        rows.append(finding(task, seq, rng.choice(LEVELS), rng.choice([None, "x", "y"]), path, rng.randint(0, 20), rng.randint(20, 22)))
    rng.shuffle(rows)
    got = {}
    for r in reports.rank_findings(reports.dedup_findings(table(spark, rows).repartition(6))).collect():
        got.setdefault(r.task_id, []).append((r.rank, r.seq))
    for task, pairs in got.items():
        assert [rank for rank, _ in sorted(pairs)] == list(range(1, len(pairs) + 1))
        assert [seq for _, seq in sorted(pairs)] == model([r for r in rows if r[0] == task])
    again = reports.dedup_findings(reports.dedup_findings(table(spark, rows)).select(*FINDING.replace(",", "").split()[::2]))
    assert again.count() == sum(len(p) for p in got.values())


def test_summary_and_gate(spark):
    rows = [
        finding(1, 0, "CRITICAL", "a"), finding(1, 1, "MAJOR", "b"), finding(1, 2, "MAJOR", "c", path="G"), finding(1, 3, "INFO", "d", path=None),
        finding(2, 0, "MINOR", "a"), finding(4, 0, "INFO", "a", path=None, start=0, end=0),
    ]
    heads = reports.reports(tasks(spark, 1, 2, 3, 4), table(spark, rows))
    got = {r.task_id: r.summary for r in heads.collect()}
    assert got == {
        1: "Found 1 critical, 2 major, 0 minor issues across 2 files.", 2: "Found 0 critical, 0 major, 1 minor issues across 1 file.",
        3: "No issues found.", 4: "Found 0 critical, 0 major, 0 minor issues across 0 files.",
    }
    verdicts = {r.task_id: (r.gate, r.warn) for r in gate.quality_gate(heads, 1).collect()}
    assert verdicts == {1: ("FAIL", True), 2: ("PASS", False), 3: ("PASS", False), 4: ("PASS", False)}
    assert gate.gate_summary(gate.quality_gate(heads)).count() == 2
    with pytest.raises(ValueError):
        gate.quality_gate(heads, -1)


def test_markdown_text(spark):
    rows = [
        finding(1, 0, "MINOR", "a_b", "x/F_1.java", 3, 5, "logic", description=" two\nlines `q` "), finding(1, 1, "CRITICAL", None, None, 0, 0, "security", description=None),
        finding(1, 2, "MINOR", "c", "x/F_1.java", 9, 9, None, description="*"),
    ]
    f = table(spark, rows)
    deduped = reports.dedup_findings(f)
    heads = reports.reports(tasks(spark, 1, 2), f)
    got = {r.task_id: r.markdown for r in outputs.whole_reports(reports.report_markdown(heads, deduped)).collect()}
    assert got[1] == (
        "## AI Code Review Report for PR o/r#1\n\n### Summary\n\n| Severity | Count |\n|----------|-------|\n| :red_circle: Critical | 1 |\n"
        "| :orange_circle: Major | 0 |\n| :yellow_circle: Minor | 2 |\n| :information_source: Info | 0 |\n\n"
        "Found 1 critical, 0 major, 2 minor issues across 1 file.\n\n### Findings by File\n\n"
        "#### (unknown)\n\n| Line | Severity | Category | Description |\n|------|----------|----------|-------------|\n| - | :red_circle: CRITICAL | - | - |\n\n"
        "#### x/F\\_1.java\n\n| Line | Severity | Category | Description |\n|------|----------|----------|-------------|\n"
        "| 3-5 | :yellow_circle: MINOR | a\\_b | two lines \\`q\\` |\n| 9 | :yellow_circle: MINOR | c | \\* |\n\n"
        "### Agent Summary\n\n- **security**: 1 finding\n- **logic**: 1 finding\n- **unknown**: 1 finding\n"
    )
    assert got[2].endswith("No issues found.\n\n### Findings\n\nNo issues found. :white_check_mark:\n\n")
    assert spark.range(1).select(reports.missing_report()).first()[0] == md.NO_REPORT


def test_parts_put_together_are_the_whole_text(spark):
    rows = [finding(1, i, LEVELS[i % 4], "c", f"F{i % 7}.java", i, i) for i in range(100)] + [finding(2, 0)]
    f = table(spark, rows)
    heads, deduped = reports.reports(tasks(spark, 1, 2, 3), f), reports.dedup_findings(f)
    pieces = reports.report_markdown(heads, deduped)
    whole = {r.task_id: r.markdown for r in outputs.whole_reports(pieces).collect()}
    for size in (1, 7, 100):
        parts = outputs.report_parts(pieces, part_rows=size).orderBy("task_id", "part").collect()
        text = {}
        for p in parts:
            text[p.task_id] = text.get(p.task_id, "") + p.markdown
        assert text == whole
        assert len([p for p in parts if p.task_id == 1]) == -(-100 // size)


def test_gate_from_text(spark, tmp_path):
    texts = {
        "a.md": "| :red_circle: Critical | 3 |\n| :orange_circle: MAJOR | 12 |\n| Minor | x |\n",
        "b.md": "no table\n", "c.md": "| 1 | CRITICAL | Critical |\n| Critical | 7 |\n|major|11|\n", "d.md": "| Critical | 0 |\n| Critical | 9 |\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = gate.gate_from_markdown(read_reports(spark, str(tmp_path))).collect()
    got = {r.file_name: (r.critical_count, r.major_count, r.minor_count, r.gate, r.warn) for r in rows}
    assert got == {
        "a.md": (3, 12, 0, "FAIL", True), "b.md": (0, 0, 0, "PASS", False),
        # The first row with the label in a cell counts, and its last number.
        "c.md": (1, 11, 0, "FAIL", True), "d.md": (0, 0, 0, "PASS", False),
    }


def test_comments_and_routing(spark):
    rows = [
        finding(1, 0, "MAJOR", "c", start=4, description="why", suggestion="do"), finding(1, 1, "INFO", None, start=5, description=" ", suggestion=None),
        finding(1, 2, path=" ", start=4), finding(1, 3, start=0), finding(2, 0, start=4),
    ]
    t = tasks(spark, 1, 2).withColumn("commit_sha", F.when(F.col("task_id") == 1, "s"))
    deduped = reports.dedup_findings(table(spark, rows))
    got = {r.line: r.body for r in reports.line_comments(deduped, t).collect()}
    assert got == {4: "**MAJOR** [c]: t\n\nwhy\n\n**Suggestion:** do", 5: "**INFO**: t\n\n"}
    bad = spark.createDataFrame([(1, "F.java", 4)], "task_id long, file_path string, line_start int")
    assert [r.body for r in reports.fallback_comments(deduped, t, bad).collect()] == ["**MAJOR** [c]: t\n\nFile: `F.java:4`\n\nwhy"]
    both = t.withColumn("trigger_event", F.when(F.col("task_id") == 1, "PUSH").otherwise("PR_OPENED"))
    for token, other in [("x", "comments"), (" ", "none"), (None, "none")]:
        assert {r.task_id: r.delivery for r in reports.report_routing(both, token).collect()} == {1: "file", 2: other}


def test_sinks(spark, tmp_path):
    t = tasks(spark, 1, 2).withColumn("trigger_event", F.when(F.col("task_id") == 1, "PUSH").otherwise("PR_OPENED")).withColumn(
        "received_at", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    )
    assert outputs.push_report_names(t).first().file_name == "review-o_r-20240506-070809.md"
    f = table(spark, [finding(1, 0), finding(2, 0)])
    text = reports.report_markdown(reports.reports(t, f), reports.dedup_findings(f))
    outputs.write_push_reports(text, t, str(tmp_path / "r"))
    whole = {r.task_id: r.markdown for r in outputs.whole_reports(text).collect()}
    assert [tuple(r) for r in read_reports(spark, str(tmp_path / "r")).collect()] == [("review-o_r-20240506-070809.md", whole[1])]
    assert [r.task_id for r in outputs.summary_comments(text, t).collect()] == [2]
    assert outputs.review_results(f).first().details == '{"category":"c","file_path":"F.java","line_start":1,"line_end":1,"description":"d","suggestion":"s"}'


def test_merge_and_allowlist(spark):
    rows = [finding(1, 0, "MINOR", agent="b"), finding(1, 1, "MAJOR", agent="a"), finding(1, 2, "INFO", agent="a"), finding(1, 3, category="z", path="src/m/F.java")]
    merged = extras.merge_findings(table(spark, rows)).where("category = 'c'").first()
    assert (merged.severity, merged.agents, merged.reports) == ("MAJOR", "a,b", 3)
    allowed = spark.createDataFrame([("z", "src/m"), ("c", "F.jav")], "rule_category string, path string")
    assert sorted(r.seq for r in extras.allowlist_filter(table(spark, rows), allowed).collect()) == [0, 1, 2]


def test_a_report_in_many_blocks_and_splits(spark, tmp_path):
    rows = [finding(1, i, LEVELS[i % 4], "c", f"F{i % 7}.java", i, i, description=f"d{i}\r | é") for i in range(400)] + [finding(2, 0)]
    t = tasks(spark, 1, 2)
    f = table(spark, rows)
    heads = reports.reports(t, f)
    pieces = reports.report_markdown(heads, reports.dedup_findings(f))
    whole = {f"task-{r.task_id}.md": r.markdown for r in outputs.whole_reports(pieces).collect()}
    named = pieces.withColumn("file_name", F.concat(F.lit("task-"), F.col("task_id").cast("string"), F.lit(".md")))
    outputs.write_report_files(named, str(tmp_path / "r"), block=30)
    assert len(list((tmp_path / "r").glob("file_name=task-1.md/block=*/part-*"))) == 14
    (tmp_path / "plain").mkdir()
    for name, text in whole.items():
        (tmp_path / "plain" / name).write_bytes(text.encode())
    assert {r.file_name: r.markdown for r in read_reports(spark, str(tmp_path / "r")).collect()} == whole
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for folder in ("r", "plain"):
            lines = read_report_lines(spark, str(tmp_path / folder))
            assert lines.rdd.getNumPartitions() > 5
            got = {}
            for r in sorted(lines.collect(), key=lambda r: (r.file_name, r.place)):
                got[r.file_name] = got.get(r.file_name, "") + r.line + "\n"
            assert got == whole
            digests = {r.file_name: (r.chars, r.markdown_md5) for r in outputs.report_digests(lines).collect()}
            assert digests == {n: (len(x), hashlib.md5(x.encode()).hexdigest()) for n, x in whole.items()}
            columns = ["critical_count", "major_count", "minor_count", "gate", "warn"]
            verdicts = {r.file_name: tuple(r)[1:] for r in gate.gate_from_lines(lines).select("file_name", *columns).collect()}
            assert verdicts == {f"task-{r.task_id}.md": tuple(r)[1:] for r in gate.quality_gate(heads).select("task_id", *columns).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gate_from_lines_equals_gate_from_text(spark, tmp_path):
    texts = [
        "| :red_circle: Critical | 3 |\n| :orange_circle: MAJOR | 12 |\n| Minor | x |\n", "no table\n", "| 1 | CRITICAL | Critical |\n| Critical | 7 |\n|major|11|\n",
        "| Critical | 0 |\n| Critical | 9 |\n", "Critical | 4 |\n| Critical\t| 5 |\r| x\n| Info | 99999999999999999999 |\n", "\n", "| a\nMinor | 3 |\n| Minor | 4 |",
    ]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.md").write_bytes(text.encode())
    want = gate.gate_from_markdown(read_reports(spark, str(tmp_path)))
    got = gate.gate_from_lines(read_report_lines(spark, str(tmp_path)))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == len(texts)


def test_summary_pieces_are_the_bodies(spark):
    f = table(spark, [finding(1, i, start=i, end=i) for i in range(50)] + [finding(2, 0), finding(3, 0)])
    t = tasks(spark, 1, 2, 3).withColumn("trigger_event", F.when(F.col("task_id") == 2, "PUSH").otherwise("PR_OPENED"))
    pieces = reports.report_markdown(reports.reports(t, f), reports.dedup_findings(f))
    text = {}
    for r in outputs.summary_comment_pieces(pieces, t).orderBy("task_id", "position").collect():
        text[r.task_id, r.pr_id, r.repo_name, r.pr_number] = text.get((r.task_id, r.pr_id, r.repo_name, r.pr_number), "") + r.text
    assert text == {tuple(r)[:4]: r.body for r in outputs.summary_comments(pieces, t).collect()} and len(text) == 2


def test_the_last_task_of_a_shared_name_is_written(spark, tmp_path):
    t = tasks(spark, 1, 2, 3).withColumn("trigger_event", F.lit("PUSH")).withColumn("received_at", F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"))
    f = table(spark, [finding(k, i, start=i, end=i) for k in (1, 2, 3) for i in range(k)])
    text = reports.report_markdown(reports.reports(t, f), reports.dedup_findings(f))
    outputs.write_push_reports(text, t, str(tmp_path / "r"))
    whole = {r.task_id: r.markdown for r in outputs.whole_reports(text).collect()}
    assert [r.markdown for r in read_reports(spark, str(tmp_path / "r")).collect()] == [whole[3]]
