from pyspark.sql import functions as F

from difftide.operators import diffs as ops
from difftide.operators import extras, importance, prompts
from difftide.sources.diffs import clean_diffs

NEW = "diff --git a/x/App.java b/x/App.java\nnew file mode 100644\n--- /dev/null\n+++ b/x/App.java\n@@ -0,0 +1,4 @@\n+import java.sql.Connection;\n+import java.sql.*;\n+import java.sql.Connection;\n++++ odd\n"
DELETED = "diff --git a/old.txt b/old.txt\ndeleted file mode 100644\n--- a/old.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n\\ No newline at end of file\n"
RENAMED = "diff --git a/a b c b/d e\nsimilarity index 100%\nrename from a b c\nrename to d e\n"


def table(spark, *bodies):
    return spark.createDataFrame([(i, f"o/r#{i}", b) for i, b in enumerate(bodies)], "task_id long, pr_id string, body string")


def test_files(spark):
    body = "preamble\n" + NEW + DELETED + RENAMED
    rows = ops.changed_files(table(spark, body, "", None, "--- a/bare\n+++ b/bare\n@@ -1 +1,2 @@\n x\n")).orderBy("task_id", "file_seq").collect()
    got = [(r.task_id, r.file_seq, r.file_path, r.change_type, r.additions, r.deletions) for r in rows]
    assert got == [
        (0, 2, "x/App.java", "ADDED", 3, 0), (0, 3, "old.txt", "DELETED", 0, 1), (0, 4, "a b c", "RENAMED", 0, 0),
        (3, 1, "bare", "MODIFIED", 0, 0),
    ]


def test_phrase_anywhere_decides_change_type(spark):
    body = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n+say new file mode\n"
    assert ops.changed_files(table(spark, body)).first().change_type == "ADDED"


def test_hunks(spark):
    head = "diff --git a/f b/f\n--- a/f\n+++ b/f\n"
    body = (
        head + "@@ -1,4 +1,5 @@ class X\n a\n+b\n\n@@ -20 +21,6 @@\n@@ -15,99999999999 +15,8 @@\n-c\n\\ No newline\n@@ -7,7 +7,7 @@\r\n+kept in the hunk before\n"
    )
    rows = ops.hunks(ops.changed_files(table(spark, body))).orderBy("hunk_seq").collect()
    got = [(r.hunk_seq, r.old_start, r.old_lines, r.new_start, r.new_lines, r.header, r.lines) for r in rows]
    assert got == [
        (1, 1, 4, 1, 5, "@@ -1,4 +1,5 @@", [" a", "+b"]),
        (2, 15, 1, 15, 8, "@@ -15,1 +15,8 @@", ["-c", "\\ No newline", "+kept in the hunk before"]),
    ]
    assert ops.hunk_lines(ops.hunks(ops.changed_files(table(spark, body)))).count() == 5


def test_imports_and_dependency_text(spark):
    twice = "diff --git a/p.java b/p.java\n--- a/p.java\n+++ b/p.java\n@@ -1 +1 @@\n+import a.A;\n"
    again = twice.replace("a.A", "b.B")
    context = "diff --git a/q b/q\n--- a/q\n+++ b/q\n@@ -1 +1 @@\n import c.C;\n-import static d.D.x ; \n"
    diffs = table(spark, twice + context + again, "", NEW)
    text = {r.task_id: r.dependency_graph for r in ops.dependency_graph(diffs).collect()}
    assert text[0] == "File extensions: .java\nDependencies:\n  p.java imports: b.B\n  q imports: d.D.x\n"
    assert text[1] == ""
    assert text[2] == "File extensions: .java\nDependencies:\n  x/App.java imports: java.sql.Connection\n"
    assert ops.dependency_edges(ops.changed_files(diffs)).count() == 4


def test_extension_of_whole_path(spark):
    df = spark.createDataFrame([("a.b/c",), ("Makefile",), ("x.tar.gz",)], "file_path string")
    got = [r[0] for r in df.select(ops.file_extension(df.file_path)).collect()]
    assert got == [".b/c", None, ".gz"]


def test_prompts(spark):
    rows = {(r.task_id, r.agent_id): r.prompt for r in prompts.review_prompts(ops.contexts(table(spark, NEW, ""))).collect()}
    assert len(rows) == 8
    want = (
        "Review the following pull request for security vulnerabilities.\nPR ID: o/r#0\n\n## Changed Files\n- x/App.java (ADDED) [+3, -0]\n\n"
        "## Code Changes (Diff)\n### File: x/App.java\n```\n@@ -0,0 +1,4 @@\n+import java.sql.Connection;\n+import java.sql.*;\n+import java.sql.Connection;\n++++ odd\n```\n\n"
        "## Dependency Context\nFile extensions: .java\nDependencies:\n  x/App.java imports: java.sql.Connection\n\n"
    )
    assert rows[(0, "security")] == want
    assert "## Dependency Graph\n" in rows[(0, "architecture")]
    assert rows[(1, "logic")] == "Review the following pull request for logic errors and bugs.\nPR ID: o/r#1\n\n" + prompts.NO_FILES
    dim = {r.agent_id: r.system_prompt for r in prompts.agent_dim(spark).collect()}
    assert len(dim) == 4 and all(dim.values())


def test_fetch_log(spark):
    tasks = spark.createDataFrame([(i, f"p{i}", u) for i, u in enumerate(["u", "u", "u", "u", " ", None, "u", "u"])], "task_id long, pr_id string, diff_url string")
    bodies = [(0, 200, "d"), (1, 404, "d"), (2, 200, " \n<!DOCTYPE html>"), (3, 200, "<html>"), (4, 200, "d"), (5, 200, "d"), (6, 200, "<HTML>")]
    log = spark.createDataFrame(bodies, "task_id long, http_status int, body string")
    got = {r.task_id: r.body for r in clean_diffs(tasks, log).collect()}
    assert got == {0: "d", 1: "", 2: "", 3: "", 4: "", 5: "", 6: "<HTML>", 7: ""}


def test_diff_plans_do_not_shuffle(spark, tmp_path):
    path = str(tmp_path / "d")
    table(spark, NEW, DELETED).write.parquet(path)
    diffs = spark.read.parquet(path)
    files = ops.changed_files(diffs)
    for df in [files, ops.hunks(files), ops.file_imports(files), ops.contexts(diffs), prompts.review_prompts(ops.contexts(diffs))]:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_chunks_and_increments(spark):
    files = spark.createDataFrame(
        [(1, "p", i, f"f{i}", a, 0, "x" * n) for i, (a, n) in enumerate([(1, 50), (9, 60), (5, 60), (9, 10)])],
        "task_id long, pr_id string, file_seq int, file_path string, additions int, deletions int, diff_content string",
    )
    got = [(r.file_path, r.position, r.chunk) for r in extras.context_chunks(files, 100).orderBy("position").collect()]
    assert got == [("f1", 1, 0), ("f3", 2, 0), ("f2", 3, 0), ("f0", 4, 1)]
    hunks = ops.hunks(ops.changed_files(table(spark, DELETED)))
    assert extras.incremental_hunks(hunks, extras.reviewed_hunks(hunks)).count() == 0
    assert extras.incremental_hunks(hunks, extras.reviewed_hunks(hunks.where("false"))).count() == 1


def test_one_fetch_of_several_counts(spark):
    tasks = spark.createDataFrame([(k, f"p{k}", "u") for k in (1, 2, 3, 4)], "task_id long, pr_id string, diff_url string")
    rows = [(1, 200, "old", 1), (1, 200, "new", 2), (1, 500, "oops", 3), (2, 404, "x", 1), (2, 200, "<html>", 2), (3, 200, "one", None), (3, 200, "one", None)]
    log = spark.createDataFrame(rows, "task_id long, http_status int, body string, fetched_at int")
    assert sorted((r.task_id, r.body) for r in clean_diffs(tasks, log).collect()) == [(1, "new"), (2, ""), (3, "one"), (4, "")]


def _importance(files: list, rounds: int) -> dict:
    """{(task, file number): (importers, importance)} by plain loops over (task, number, path, imports)."""
    links = set()
    for t, a, _, imports in files:
        for u, b, path, _ in files:
            stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
            dotted = "." + stem.replace("/", ".")
            for name in imports:
                outer = name.rsplit(".", 1)[0]
                if t == u and a != b and (dotted.endswith("." + name) or "." in outer and dotted.endswith("." + outer)):
                    links.add((t, a, b))
    out = {(t, a): sum((t, a) == k[:2] for k in links) for t, a, _, _ in files}
    into = {(t, b): [(u, a) for u, a, c in links if (u, c) == (t, b)] for t, b, _, _ in files}
    score = dict.fromkeys(out, 1_000_000)
    for _ in range(rounds):
        score = {k: 150_000 + sum(score[a] * 85 // (100 * out[a]) for a in into[k]) for k in into}
    return {k: (len(into[k]), score[k]) for k in into}


def test_importance_is_a_plain_link_analysis(spark):
    rows = [
        (1, 1, "src/a/b/Base.java", []), (1, 2, "src/a/b/User.java", ["a.b.Base", "a.b.Base"]), (1, 3, "src/a/c/Test.java", ["a.b.User.run", "a.b.Base", "java.util.List"]),
        (1, 4, "Plain.java", ["Plain", "Base"]), (1, 5, "old/a/b/Base.java", ["a.b.User"]), (1, 6, "noext", ["src.a.b.Base.x.y", "b.Base"]), (1, 7, "x/Base.b/k", ["k"]),
        (2, 1, "src/a/b/Base.java", ["a.b.User"]), (2, 2, "README", []), (3, 1, "p/A.java", ["p.B"]), (3, 2, "p/B.java", ["p.A"]),
    ]
    rows += [(4, k, f"m/F{k}.java", [f"m.F{j}" for j in range(k)]) for k in range(12)]
    text = lambda names: "".join(f"+import {n};\n" for n in names) + "+class X {}\n"
    schema = "task_id long, pr_id string, file_seq int, file_path string, additions int, deletions int, diff_content string"
    files = spark.createDataFrame([(t, f"p{t}", s, path, s % 3, 1, text(i)) for t, s, path, i in rows], schema)
    for rounds in (1, 2, 5):
        got = {(r.task_id, r.file_seq): (r.importers, r.importance) for r in importance.file_importance(files, rounds).collect()}
        assert got == _importance(rows, rounds)
    want = _importance(rows, importance.ROUNDS)
    chunks = extras.context_chunks(files, 60, importance.file_importance(files)).collect()
    for t in (1, 2, 3, 4):
        order = [(r.file_seq, r.importance) for r in sorted(chunks, key=lambda r: r.position) if r.task_id == t]
        by_weight = sorted((-(s % 3 + 1) * want[t, s][1], s) for u, s, _, _ in rows if u == t)
        assert order == [(s, want[t, s][1]) for _, s in by_weight]
    none = importance.file_importance(files.limit(0)).collect()
    assert none == []


def _kept(df, path):
    """The rows as a table of files, whose size the planner knows."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_not_broadcast_and_move_once(spark, tmp_path):
    """The planner takes a text for a few bytes; the side with the bodies grows with the log all the same."""
    tasks = spark.createDataFrame([(1, "p", "u"), (2, "p", " "), (3, "p", "u")], "task_id long, pr_id string, diff_url string")
    log = spark.createDataFrame([(1, 200, "old", 1), (1, 200, "new", 2), (1, 500, "x", 3), (2, 200, "y", 1), (3, 200, "<html>", 1)], "task_id long, http_status int, body string, fetched_at int")
    clean = clean_diffs(tasks, _kept(log.withColumn("fetched_at", F.timestamp_seconds("fetched_at")), tmp_path / "log"))
    assert {r.task_id: r.body for r in clean.collect()} == {1: "new", 2: "", 3: ""}
    assert "BroadcastHashJoin" not in _plan(clean) and "max_by" not in _plan(clean)


def test_importance_broadcasts_no_side_that_grows(spark, tmp_path):
    files = spark.createDataFrame([(1, "p", 1, "a/A.java", 3, 0, "import a.B;"), (1, "p", 2, "a/B.java", 2, 1, "x")], "task_id long, pr_id string, file_seq int, file_path string, additions int, deletions int, diff_content string")
    files = _kept(files, tmp_path / "files")
    found = importance.file_importance(files)
    assert "BroadcastHashJoin" not in _plan(importance.import_links(files)) + _plan(found)


def test_chunks_broadcast_no_side_that_grows(spark, tmp_path):
    files = spark.createDataFrame([(1, "p", 1, "a/A.java", 3, 0, "import a.B;"), (1, "p", 2, "a/B.java", 2, 1, "x")], "task_id long, pr_id string, file_seq int, file_path string, additions int, deletions int, diff_content string")
    files = _kept(files, tmp_path / "files")
    weights = files.select("task_id", "file_seq", F.lit(2).alias("importance"))
    assert "BroadcastHashJoin" not in _plan(extras.context_chunks(files, 60)) + _plan(extras.context_chunks(files, 60, weights))


def test_paths_and_hunk_headers_are_matched_once(spark, tmp_path):
    path = str(tmp_path / "d")
    odd = "diff --git a/x b/x\n--- a/x\n+++ /dev/null\n@@ -7 +99999999999,2 @@ @@ -1 +1 @@\n+a\n@@ -3,4 +5,6 @@\n b\n"
    table(spark, NEW, odd).write.parquet(path)
    rows = ops.hunks(ops.changed_files(spark.read.parquet(path)))
    got = [(r.file_path, r.old_start, r.old_lines, r.new_start, r.new_lines) for r in rows.orderBy("task_id", "hunk_seq").collect()]
    assert got == [("x/App.java", 0, 0, 1, 4), ("x", 7, 1, 1, 2), ("x", 3, 4, 5, 6)]
    plan = _plan(ops.changed_files(spark.read.parquet(path)))
    assert plan.count(r"^\+\+\+") == 1 and plan.count(r"^---") == 1
