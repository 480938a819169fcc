"""Findings to ranked lists, counts, Markdown, comments and routing (RP1-RP8).

A task may hold a large share of all findings, so nothing here sorts or collects a whole task in
one place, only one file of it. Deduplication is an aggregate by file; positions are block
offsets (from counts) plus a position inside a block; report text comes as one row per piece with its position.

Findings of one file share a `_place`, by which they are dealt to tasks. Missing, empty and unnamed files are one place, as
deduplication takes the first two as one path and reports the first and the last as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from difftide import schemas
from difftide.functions.markdown import (
    AGENTS_HEADER, FILE_TABLE_HEADER, FILES_HEADER, NO_FINDINGS, NO_REPORT, REPORT_TITLE, count_table,
    escape_md, fallback_comment, finding_row, line_comment,
)
from difftide.functions.text import not_blank

# Fixed values.
UNKNOWN_FILE = "(unknown)"
UNKNOWN_AGENT = "unknown"

_TIES = ["line_end", "category"]  # order of findings without a `seq`, whose place is unknown

def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 3 for INFO."""
    out = None
    for i, name in enumerate(schemas.SEVERITIES):
        out = F.when(severity == name, i) if out is None else out.when(severity == name, i)
    return out


def _place(path: Column) -> Column:
    """What the findings of one file are dealt by."""
    path = F.coalesce(path, F.lit(""))
    return F.when(path == UNKNOWN_FILE, "").otherwise(path)


def _with_place(deduped: DataFrame) -> DataFrame:
    return deduped if "_place" in deduped.columns else deduped.withColumn("_place", _place(F.col("file_path")))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per task, path, lines and category (RP1).

    The most severe row wins, the earliest on ties. `first_seq` is the place of the key's earliest
    row, which the winner takes over. Agent and title are not part of the key.

    Rows move once, as they are, to the file of their review, and are not sorted before. What is counted by file or by agent
    afterwards is summed up there before it moves, and branches that read other columns of the result share that one shuffle.
    """
    return placed_findings(findings).drop("_place")


def placed_findings(findings: DataFrame) -> DataFrame:
    """`dedup_findings` with the `_place` by which its rows lie in their tasks, for reports: their rows then needn't move again."""
    moved = findings.select(
        "task_id", "pr_id", "seq", "agent_id", "severity", "file_path", "category", "line_start", "line_end", "title", "description", "suggestion",
    ).repartition(F.col("task_id"), _place(F.col("file_path")))
    # A missing path or category and an empty one are one key; what the winner had is told by a flag.
    slim = moved.select(
        "*", F.coalesce("file_path", F.lit("")).alias("_path"), F.col("file_path").isNotNull().alias("_has_path"), F.coalesce("category", F.lit("")).alias("_category"),
        F.col("category").isNotNull().alias("_has_category"), _place(F.col("file_path")).alias("_place"),
    )
    best = F.min(F.struct(
        severity_rank(F.col("severity")).alias("severity_rank"), "seq", "agent_id", "severity", "_has_category", "_has_path",
        "title", "description", "suggestion",
    ))
    grouped = slim.groupBy("task_id", "pr_id", "_place", "_path", "line_start", "line_end", "_category").agg(
        best.alias("best"), F.min("seq").alias("first_seq")
    )
    return grouped.select(
        "task_id", "pr_id", "best.seq", "first_seq", "best.severity_rank", "best.agent_id", "best.severity",
        F.when(F.col("best._has_category"), F.col("_category")).alias("category"),
        F.when(F.col("best._has_path"), F.col("_path")).alias("file_path"),
        "line_start", "line_end", "best.title", "best.description", "best.suggestion", "_place",
    )


def rank_findings(deduped: DataFrame) -> DataFrame:
    """Add `rank`: severity, path (missing last), first line, first-seen place (RP2).

    A block is one severity of one file of a task. Ranks are the sizes of the blocks before plus the
    position in the block; only the block sizes of a task are ordered in one place.
    """
    block = ["task_id", "severity_rank", "_no_path", "_path"]
    keyed = deduped.withColumn("_no_path", F.col("file_path").isNull()).withColumn(
        "_path", F.coalesce("file_path", F.lit(""))
    )
    inside = Window.partitionBy(*block).orderBy("line_start", "first_seq", *_TIES)
    blocks = keyed.groupBy(*block).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("task_id").orderBy(*block[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*block, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    rows = keyed.withColumn("_pos", F.row_number().over(inside))
    rank = (F.col("_before") + F.col("_pos")).cast("long")
    return rows.join(offsets, block).select(*deduped.columns, rank.alias("rank"))


def report_counts(deduped: DataFrame) -> DataFrame:
    """Counts per task; the empty path counts as a file, a missing one does not (RP3)."""
    s = F.col("severity")
    per_file = _with_place(deduped).groupBy("task_id", "pr_id", "_place", "file_path").agg(
        F.count("*").alias("rows"), *[F.count_if(s == n).alias(n) for n in schemas.SEVERITIES]
    )
    return per_file.groupBy("task_id", "pr_id").agg(
        F.sum("CRITICAL").cast("int").alias("critical_count"),
        F.sum("MAJOR").cast("int").alias("major_count"),
        F.sum("MINOR").cast("int").alias("minor_count"),
        F.sum("INFO").cast("int").alias("info_count"),
        F.sum("rows").alias("total_count"),
        F.count("file_path").alias("file_count"),
    )


def report_summary(tasks: DataFrame, counts: DataFrame, *carried: str) -> DataFrame:
    """Report head of every task; tasks without findings get zeros (RP4). Columns `carried` of the tasks are kept."""
    names = ["critical_count", "major_count", "minor_count", "info_count", "total_count", "file_count"]
    joined = tasks.select("task_id", "pr_id", *carried).join(counts.drop("pr_id"), "task_id", "left")
    filled = joined.select("task_id", "pr_id", *carried, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    text = F.concat(
        F.lit("Found "), F.col("critical_count").cast("string"), F.lit(" critical, "),
        F.col("major_count").cast("string"), F.lit(" major, "),
        F.col("minor_count").cast("string"), F.lit(" minor issues across "),
        F.col("file_count").cast("string"),
        F.when(F.col("file_count") == 1, " file.").otherwise(" files."),
    )
    return filled.withColumn(
        "summary", F.when(F.col("total_count") == 0, "No issues found.").otherwise(text)
    )


def counted_findings(findings: DataFrame) -> DataFrame:
    """What `report_counts` needs of the deduplicated findings, where nothing else is made of them.

    Texts don't move. A winner's severity is told by its rank; only a missing path and an empty one, which are one key, need the
    winner itself, so only findings without a path carry what orders them. Severities without a rank aren't counted one by one.
    """
    tie = F.when(F.coalesce("file_path", F.lit("")) == "", F.struct("seq", "agent_id", "severity", F.col("category").isNotNull().alias("has_category")))
    moved = findings.select("task_id", "pr_id", "severity", "file_path", "category", "line_start", "line_end", tie.alias("_tie")).repartition(F.col("task_id"), _place(F.col("file_path")))
    slim = moved.select(
        "task_id", "pr_id", "line_start", "line_end", "_tie", F.coalesce("file_path", F.lit("")).alias("_path"), F.col("file_path").isNotNull().alias("_has_path"),
        F.coalesce("category", F.lit("")).alias("_category"), _place(F.col("file_path")).alias("_place"), severity_rank(F.col("severity")).alias("_rank"),
    )
    best = F.min(F.struct("_rank", "_tie", "_has_path"))
    grouped = slim.groupBy("task_id", "pr_id", "_place", "_path", "line_start", "line_end", "_category").agg(best.alias("best"))
    return grouped.select(
        "task_id", "pr_id", "_place", F.when(F.col("best._has_path"), F.col("_path")).alias("file_path"),
        F.get(F.array(*[F.lit(n) for n in schemas.SEVERITIES]), F.col("best._rank")).alias("severity"),
    )


def reports(tasks: DataFrame, findings: DataFrame, alone: bool = False) -> DataFrame:
    """Report heads straight from raw findings: deduplicate, count, summarise.

    Heads that go into a report share the findings that have moved for it; of heads for themselves (`alone`) less moves.
    """
    return report_summary(tasks, report_counts(counted_findings(findings) if alone else placed_findings(findings)))


# -- grouped views ---------------------------------------------------------------------------
def _order_key() -> Column:
    return F.struct(
        F.col("severity_rank").alias("s"), F.col("file_path").isNull().alias("n"),
        F.col("file_path").alias("p"), F.col("line_start").alias("l"), F.col("first_seq").alias("q"),
    )


def _file_group() -> Column:
    return F.coalesce("file_path", F.lit(UNKNOWN_FILE))


def findings_by_file(deduped: DataFrame) -> DataFrame:
    """Files of a report in the order in which they are first met (RP5a)."""
    groups = _with_place(deduped).groupBy("task_id", "pr_id", "_place", _file_group().alias("file")).agg(
        F.count("*").alias("findings"), F.min(_order_key()).alias("_first")
    )
    met = Window.partitionBy("task_id").orderBy("_first")
    return groups.select(
        "task_id", "pr_id", F.row_number().over(met).alias("file_order"), "file", "findings",
        F.coalesce(
            F.sum("findings").over(met.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("rows_before"),
    )


def findings_by_agent(deduped: DataFrame) -> DataFrame:
    """Findings per agent in the order in which agents are first met (RP5b)."""
    groups = deduped.groupBy(
        "task_id", "pr_id", F.coalesce("agent_id", F.lit(UNKNOWN_AGENT)).alias("agent")
    ).agg(F.count("*").alias("findings"), F.min(_order_key()).alias("_first"))
    met = Window.partitionBy("task_id").orderBy("_first")
    return groups.select(
        "task_id", "pr_id", F.row_number().over(met).alias("agent_order"), "agent", "findings"
    )


# -- Markdown --------------------------------------------------------------------------------
def report_rows(deduped: DataFrame, heads: DataFrame) -> DataFrame:
    """Every table row of the reports of `heads` with its position and text, and the other columns of `heads`.

    A task's head meets the files of its report, which are few, so the rows move to their files and no further; those of
    `placed_findings` lie there. Files meet them by their place, which has two of them at most.
    """
    files = findings_by_file(deduped).select("task_id", "file", "findings", "rows_before")
    of_place = F.collect_list(F.struct("file", "findings", "rows_before")).alias("_files")
    files = files.groupBy("task_id", _place(F.col("file")).alias("_place")).agg(of_place).join(heads, "task_id")
    rows = _with_place(deduped).drop("pr_id").withColumn("file", _file_group()).withColumn(
        "_null", F.col("file_path").isNull()
    )
    # Only the group of unnamed files can mix two paths; a missing path then sorts last.
    inside = Window.partitionBy("task_id", "_place", "file").orderBy("severity_rank", "_null", "line_start", "first_seq", *_TIES)
    placed = rows.withColumn("_pos", F.row_number().over(inside)).join(files, ["task_id", "_place"])
    placed = placed.withColumn("_file", F.filter("_files", lambda f: f["file"] == F.col("file"))[0]).select("*", "_file.findings", "_file.rows_before")
    text = F.concat(
        F.when(F.col("_pos") == 1, F.concat(F.lit("#### "), escape_md(F.col("file")), F.lit("\n\n" + FILE_TABLE_HEADER)))
        .otherwise(F.lit("")),
        finding_row(
            F.col("line_start"), F.col("line_end"), F.col("severity"), F.col("category"), F.col("description")
        ),
        F.when(F.col("_pos") == F.col("findings"), "\n").otherwise(F.lit("")),
    )
    position = (F.col("rows_before") + F.col("_pos")).cast("long")
    return placed.select(*heads.columns, position.alias("position"), text.alias("text"))


def report_markdown(heads: DataFrame, deduped: DataFrame, *carried: str) -> DataFrame:
    """Markdown report per task, as pieces: (task_id, pr_id, position, kind, text) (RP5).

    Columns `carried` of the heads come behind `pr_id`, so pieces needn't move to meet them.

    The head is at position 0, table rows follow from 1 on, and the agent summary comes last. The pieces of a
    task put together in order are its whole report, whatever its size; how they are laid out is up to the sink.
    """
    head = F.concat(
        F.lit(REPORT_TITLE), escape_md(F.col("pr_id")), F.lit("\n\n"),
        count_table(*[F.col(f"{n.lower()}_count") for n in schemas.SEVERITIES]),
        F.lit("\n"), escape_md(F.col("summary")), F.lit("\n\n"),
        F.when(F.col("total_count") == 0, NO_FINDINGS).otherwise(FILES_HEADER),
    )
    # No text is empty. The filter keeps the counts in every branch, so that all share them; without counts a branch would need
    # other columns of the findings and move those once more.
    texts = heads.select("task_id", "pr_id", *carried, head.alias("text")).where(F.length("text") > 0)
    first = texts.select("task_id", "pr_id", *carried, F.lit(0).cast("long").alias("position"), F.lit("head").alias("kind"), "text")
    known = texts.select("task_id", "pr_id", *carried)
    rows = report_rows(deduped, known).select("task_id", "pr_id", *carried, "position", F.lit("row").alias("kind"), "text")
    line = F.concat(
        F.lit("- **"), escape_md(F.col("agent")), F.lit("**: "), F.col("findings").cast("string"),
        F.when(F.col("findings") == 1, " finding\n").otherwise(" findings\n"),
    )
    agents = (
        findings_by_agent(deduped)
        .groupBy("task_id")
        .agg(F.array_sort(F.collect_list(F.struct("agent_order", line.alias("text")))).alias("_rows"), F.sum("findings").alias("_total"))
        .select(
            "task_id", (F.col("_total") + 1).cast("long").alias("position"), F.lit("agents").alias("kind"),
            F.concat(F.lit(AGENTS_HEADER), F.array_join(F.transform("_rows", lambda r: r["text"]), "")).alias("text"),
        )
    )
    return first.unionByName(rows).unionByName(agents.join(known, "task_id"))


def missing_report() -> Column:
    """Text shown where there is no report at all."""
    return F.lit(NO_REPORT)


# -- comments and routing --------------------------------------------------------------------
def _located(findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Findings with a path and a line, of tasks with a commit."""
    commits = tasks.where(F.col("commit_sha").isNotNull()).select("task_id", "commit_sha")
    return findings.where(not_blank(F.col("file_path")) & (F.col("line_start") > 0)).join(commits, "task_id")


def line_comments(deduped: DataFrame, tasks: DataFrame) -> DataFrame:
    """One comment row per located finding (RP6, SK4)."""
    body = line_comment(*[F.col(c) for c in ["severity", "category", "title", "description", "suggestion"]])
    return _located(deduped, tasks).select(
        "task_id", "pr_id", "commit_sha", "file_path", F.col("line_start").alias("line"), "first_seq",
        body.alias("body"),
    )


def fallback_comments(deduped: DataFrame, tasks: DataFrame, unresolved: DataFrame) -> DataFrame:
    """General comments for positions that cannot be resolved (RP7).

    `unresolved` lists (task_id, file_path, line_start).
    """
    keys = ["task_id", "file_path", "line_start"]
    rows = _located(deduped, tasks).join(unresolved.select(*keys), keys, "left_semi")
    body = fallback_comment(
        *[F.col(c) for c in ["severity", "category", "title", "file_path", "line_start", "description"]]
    )
    return rows.select("task_id", "pr_id", "file_path", F.col("line_start").alias("line"), "first_seq", body.alias("body"))


def report_routing(tasks: DataFrame, token: str | None) -> DataFrame:
    """Where a task's report goes: a file for pushes, comments with a token, else nowhere (RP8)."""
    has_token = token is not None and bool(token.strip())
    return tasks.select(
        "task_id", "pr_id", "trigger_event",
        F.when(F.col("trigger_event") == "PUSH", "file")
        .otherwise("comments" if has_token else "none").alias("delivery"),
    )
