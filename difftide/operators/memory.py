"""Feedback memory: counters, sticky downgrade, hints and the false-positive filter (ME1-ME11)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from difftide.functions.text import not_blank, text_or_null_word

# Fixed values.
DOWNGRADE_THRESHOLD = 0.7
RECENT_LIMIT = 50
SOFTENED = {"CRITICAL": "MAJOR", "MAJOR": "MINOR", "MINOR": "INFO"}
SOFTEN_SUFFIX = " [auto-downgraded due to historical false-positive rate]"

RULE = ["agent_type", "rule_category"]


def _dismissed() -> Column:
    return F.col("feedback") == "DISMISSED"


def _accepted() -> Column:
    return F.col("feedback") == "ACCEPTED"


def rule_counters(feedback: DataFrame) -> DataFrame:
    """Total, accepted and dismissed rows per rule (ME1); counted on the map side first."""
    return feedback.groupBy(*RULE).agg(
        F.count("*").alias("total"),
        F.count_if(_accepted()).alias("accepted"),
        F.count_if(_dismissed()).alias("dismissed"),
    )


def merge_counters(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Counters after a further batch of feedback (ME1, incremental form)."""
    names = ["total", "accepted", "dismissed"]
    both = old.select(*RULE, *names).unionByName(delta.select(*RULE, *names))
    return both.groupBy(*RULE).agg(*[F.sum(n).alias(n) for n in names])


def _step_weight(threshold: float) -> Column:
    """Weight of one row, so that a running sum above zero means dismissed / total > threshold.

    With threshold p/q the ratio test is q * dismissed - p * total > 0, in whole numbers.
    """
    exact = Fraction(str(threshold))
    p, q = exact.numerator, exact.denominator
    return F.when(_dismissed(), F.lit(q - p)).otherwise(F.lit(-p)).cast("long")


def feedback_steps(feedback: DataFrame, threshold: float = DOWNGRADE_THRESHOLD) -> DataFrame:
    """What each row adds to its rule: its weight `w`, and whether it is accepted (`a`) or dismissed (`d`)."""
    return feedback.select(
        *RULE, "created_at", "id", _step_weight(threshold).alias("w"),
        _accepted().cast("long").alias("a"), _dismissed().cast("long").alias("d"),
    )


def rule_segments(feedback: DataFrame, threshold: float = DOWNGRADE_THRESHOLD) -> DataFrame:
    """Per rule and range partition: counters, weight sum and highest running weight sum.

    The log is cut by (rule, time, id) ranges, so one rule's rows are spread over as many tasks as
    they need. Segments of a rule are ordered by `segment` and there are at most (rules +
    partitions) of them.
    """
    ranged = feedback_steps(feedback, threshold).repartitionByRange(*RULE, "created_at", "id").withColumn(
        "segment", F.spark_partition_id()
    )
    running = Window.partitionBy("segment", *RULE).orderBy("created_at", "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        ranged.withColumn("run", F.sum("w").over(running))
        .groupBy("segment", *RULE)
        .agg(
            F.count("*").alias("total"), F.sum("a").alias("accepted"), F.sum("d").alias("dismissed"),
            F.sum("w").alias("weight"), F.max("run").alias("peak"),
        )
    )


def fold_segments(segments: DataFrame) -> DataFrame:
    """Counters, weight sum and overall peak per rule from ordered segments."""
    before = Window.partitionBy(*RULE).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shifted = segments.withColumn(
        "peak", F.coalesce(F.sum("weight").over(before), F.lit(0)) + F.col("peak")
    )
    return shifted.groupBy(*RULE).agg(
        *[F.sum(n).alias(n) for n in ["total", "accepted", "dismissed", "weight"]],
        F.max("peak").alias("peak"),
    )


def rule_downgrade(feedback: DataFrame, threshold: float = DOWNGRADE_THRESHOLD) -> DataFrame:
    """Sticky downgrade flag per rule (ME2).

    The flag is set when the dismissed share is above the threshold right after some dismissal. An
    accepted row only lowers the share, so this is the same as any prefix being above it, that is a
    highest running weight sum above zero. Sums and peaks of consecutive segments can be combined,
    so no task needs all rows of a rule.
    """
    folded = fold_segments(rule_segments(feedback, threshold))
    return folded.select(*RULE, (F.col("peak") > 0).alias("is_downgraded"))


def dismiss_ratio(stats: DataFrame) -> DataFrame:
    """Add the dismissed share, 0.0 without any row (ME3)."""
    share = F.when(F.col("total") > 0, F.col("dismissed") / F.col("total")).otherwise(F.lit(0.0))
    return stats.withColumn("dismiss_ratio", share)


def _as_stats(folded: DataFrame) -> DataFrame:
    return dismiss_ratio(folded).select(
        *RULE, "total", "accepted", "dismissed", "dismiss_ratio", (F.col("peak") > 0).alias("is_downgraded")
    )


def compute_rule_stats(feedback: DataFrame, threshold: float = DOWNGRADE_THRESHOLD) -> DataFrame:
    """Counters, share and sticky flag of every rule, from one pass over the log (ME1-ME3)."""
    return _as_stats(fold_segments(rule_segments(feedback, threshold)))


def rule_stats(feedback: DataFrame, threshold: float = DOWNGRADE_THRESHOLD) -> DataFrame:
    """All rule statistics ordered by agent and rule (ME4)."""
    return compute_rule_stats(feedback, threshold).orderBy(*RULE)


def rule_lookup(stats: DataFrame, keys: DataFrame) -> DataFrame:
    """Statistics of the asked rules (ME5); unknown rules have nulls and a false flag."""
    return keys.join(stats, RULE, "left").withColumn(
        "is_downgraded", F.coalesce("is_downgraded", F.lit(False))
    )


def recent_feedback(feedback: DataFrame, k: int = RECENT_LIMIT) -> DataFrame:
    """Newest k records per file and line (ME6).

    The limit is applied before the shuffle as well, so a busy place sends at most k rows per task.
    """
    newest = Window.partitionBy("file_path", "line_start").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        feedback.where(F.col("file_path").isNotNull())
        .withColumn("recency", F.row_number().over(newest))
        .where(F.col("recency") <= k)
    )


def apply_resets(feedback: DataFrame, resets: DataFrame) -> DataFrame:
    """Feedback that still counts after the resets (ME7): rows later than their rule's last reset."""
    last = resets.groupBy(*RULE).agg(F.max("reset_at").alias("reset_at"))
    return (
        feedback.join(last, RULE, "left")
        .where(F.col("reset_at").isNull() | (F.col("created_at") > F.col("reset_at")))
        .drop("reset_at")
        .select(*feedback.columns)
    )


def memory_hints(stats: DataFrame) -> DataFrame:
    """One caution per downgraded rule (ME8).

    Every task with a changed file gets all of them, so they are kept once and not once per task;
    `hints_for_task` puts the list of one task together.
    """
    percent = F.col("dismiss_ratio") * 100
    text = F.format_string(
        "CAUTION: Rule '%s' from agent '%s' has been downgraded (dismissed %.0f%% of %d times). "
        "Consider whether this rule applies before flagging it.",
        "rule_category", "agent_type", percent, "total",
    )
    return stats.where("is_downgraded").select(*RULE, text.alias("hint"))


def file_history_hints(feedback: DataFrame, files: DataFrame) -> DataFrame:
    """One hint per changed file with past feedback (ME9), in file order by `file_seq`."""
    past = feedback.where(F.col("file_path").isNotNull()).groupBy("file_path").agg(
        F.count("*").alias("records")
    )
    return files.join(past, "file_path").select(
        "task_id", "pr_id", "file_seq", "file_path",
        F.format_string("File '%s' has %d past feedback record(s).", "file_path", "records").alias("hint"),
    )


def hints_for_task(stats: DataFrame, feedback: DataFrame, files: DataFrame, task_id: int) -> DataFrame:
    """Ordered hints of one task (ME8 and ME9 together); none for a task without changed files."""
    own = files.where(F.col("task_id") == task_id)
    cautions = memory_hints(stats).select(
        F.lit(0).alias("part"), "agent_type", "rule_category", F.lit(0).alias("file_seq"), "hint"
    )
    past = file_history_hints(feedback, own).select(
        F.lit(1).alias("part"), F.lit("").alias("agent_type"), F.lit("").alias("rule_category"), "file_seq", "hint"
    )
    key = F.lit(task_id).alias("task_id")
    some = own.select("task_id").limit(1)
    rows = cautions.unionByName(past).select(key, "*")
    return rows.join(some, "task_id", "left_semi").orderBy("part", "agent_type", "rule_category", "file_seq")


def _judged(findings: DataFrame, stats: DataFrame, normalize_agent_ids: bool) -> DataFrame:
    """Findings with `_verdict`: keep, soften or drop.

    The statistics are joined without a hint: their size depends on how many categories people
    type, so the planner broadcasts them only when they are measured to be small.
    """
    agent, name = F.col("agent_id"), F.col("agent_type")
    if normalize_agent_ids:
        agent, name = (F.replace(c, F.lit("-"), F.lit("")) for c in (agent, name))
    # Spellings that normalise to one agent are one rule: counters add up and a flag that one has, all have.
    flagged = (
        stats.groupBy(name.alias("_agent"), F.col("rule_category").alias("_rule"))
        .agg(F.bool_or("is_downgraded").alias("_flag"), (F.sum("dismissed") > F.sum("accepted")).alias("_drop"))
        .where("_flag")
    )
    usable = not_blank(F.col("agent_id")) & not_blank(F.col("category"))
    joined = findings.join(
        flagged, usable & (agent == F.col("_agent")) & (F.col("category") == F.col("_rule")), "left"
    )
    verdict = F.when(F.col("_drop").isNull(), "keep").when(F.col("_drop"), "drop").otherwise("soften")
    return joined.withColumn("_verdict", verdict)


def soften_severity(severity: Column) -> Column:
    """One step down; INFO stays."""
    out = None
    for old, new in SOFTENED.items():
        out = F.when(severity == old, new) if out is None else out.when(severity == old, new)
    return out.otherwise(severity)


def fp_filter(findings: DataFrame, stats: DataFrame, normalize_agent_ids: bool = False) -> DataFrame:
    """Drop or soften findings of downgraded rules (ME10).

    The join is exact on agent and category, so ids that are spelled differently in the feedback
    (`codestyle` against `code-style`) never match unless `normalize_agent_ids` is set.
    """
    judged = _judged(findings, stats, normalize_agent_ids).where(F.col("_verdict") != "drop")
    soft = F.col("_verdict") == "soften"
    softened = F.concat(text_or_null_word(F.col("description")), F.lit(SOFTEN_SUFFIX))
    return (
        judged.withColumn("severity", F.when(soft, soften_severity(F.col("severity"))).otherwise(F.col("severity")))
        .withColumn("description", F.when(soft, softened).otherwise(F.col("description")))
        .select(*findings.columns)
    )


def fp_filter_stats(findings: DataFrame, stats: DataFrame, normalize_agent_ids: bool = False) -> DataFrame:
    """Rows in, suppressed, downgraded and out per task (ME11)."""
    v = F.col("_verdict")
    return _judged(findings, stats, normalize_agent_ids).groupBy("task_id", "pr_id").agg(
        F.count("*").alias("rows_in"),
        F.count_if(v == "drop").alias("suppressed"),
        F.count_if(v == "soften").alias("downgraded"),
        F.count_if(v != "drop").alias("rows_out"),
    )
