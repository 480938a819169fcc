"""Deliveries to review tasks and feedback records (EV1-EV12). Everything here is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difftide.functions.events import (
    branch_name, compare_url, directive_of, is_all_zeros, map_trigger,
)
from difftide.functions.rows import keep
from difftide.functions.signing import signature_valid
from difftide.functions.text import text_or_null_word

# Answers given to a delivery.
BAD_SIGNATURE = "Signature mismatch"
BAD_PAYLOAD = "Invalid payload"
PR_DONE = "Webhook processed successfully"
PUSH_DONE = "Push webhook processed successfully"
INCOMPLETE = "Incomplete payload"
SKIP_DELETE = "Delete event, skipping"
SKIP_NEW_BRANCH = "New branch event, skipping"
SKIP_TAG = "Tag push event, skipping"

TASK_COLUMNS = [
    "task_id", "pr_id", "repo_name", "pr_number", "pr_title", "pr_description", "source_branch",
    "target_branch", "commit_sha", "diff_url", "trigger_event", "received_at",
]


def with_signature_valid(df: DataFrame, secret: str | None) -> DataFrame:
    """Add `signature_valid` for the `body` and `signature` columns (EV1)."""
    return df.withColumn(
        "signature_valid", signature_valid(F.col("body"), F.col("signature"), secret)
    )


def _signed(df: DataFrame, verified: bool) -> Column:
    """Accepted signature. A table without the flag is refused unless its deliveries are known to be verified."""
    if "signature_valid" in df.columns:
        return F.col("signature_valid")
    if not verified:
        raise ValueError("no signature_valid column: use with_signature_valid, or verified=True for checked deliveries")
    return F.lit(True)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _within(parent: str, field: str) -> Column:
    """Field of an object: empty when the object is missing, null when only the field is."""
    return F.when(F.col(parent).isNull(), F.lit("")).otherwise(F.col(f"{parent}.{field}"))


def _answer(status: int, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(status).alias("status"), text.alias("message"))


def pr_dispositions(pr: DataFrame, verified: bool = False) -> DataFrame:
    """Add status and message of each PR delivery (EV8, PR half)."""
    unsupported = map_trigger(F.col("action")).isNull()
    broken = F.col("pull_request").isNull() | F.col("repository").isNull()
    return pr.withColumn(
        "disposition",
        F.when(~_signed(pr, verified), _answer(401, BAD_SIGNATURE))
        .when(F.col("parse_error").isNotNull(), _answer(400, BAD_PAYLOAD))
        .when(
            unsupported,
            _answer(400, F.concat(F.lit("Unsupported action: "), text_or_null_word(F.col("action")))),
        )
        .when(broken, _answer(500, INCOMPLETE))
        .otherwise(_answer(200, PR_DONE)),
    )


def route_push(push: DataFrame) -> DataFrame:
    """Add `skip_reason` in the fixed order: delete, new branch, tag; null when reviewed (EV4)."""
    return push.withColumn(
        "skip_reason",
        F.when(F.col("after").isNull() | is_all_zeros(F.col("after")), SKIP_DELETE)
        .when(is_all_zeros(F.col("before")), SKIP_NEW_BRANCH)
        .when(F.col("ref").startswith("refs/tags/"), SKIP_TAG),
    )


def push_dispositions(push: DataFrame, verified: bool = False) -> DataFrame:
    """Add status and message of each push delivery (EV8, push half)."""
    routed = route_push(push)
    return routed.withColumn(
        "disposition",
        F.when(~_signed(push, verified), _answer(401, BAD_SIGNATURE))
        .when(F.col("parse_error").isNotNull(), _answer(400, BAD_PAYLOAD))
        .when(F.col("skip_reason").isNotNull(), _answer(200, F.col("skip_reason")))
        .when(F.col("repository").isNull(), _answer(500, INCOMPLETE))
        .otherwise(_answer(200, PUSH_DONE)),
    )


def dispositions(pr: DataFrame, push: DataFrame, verified: bool = False) -> DataFrame:
    """Deliveries per feed, status and message (EV8)."""
    both = (
        pr_dispositions(pr, verified).select(F.lit("pr").alias("feed"), "disposition.*")
        .unionByName(push_dispositions(push, verified).select(F.lit("push").alias("feed"), "disposition.*"))
    )
    return both.groupBy("feed", "status", "message").agg(F.count("*").alias("deliveries"))


def build_pr_tasks(pr: DataFrame, verified: bool = False) -> DataFrame:
    """Review tasks of the accepted PR deliveries (EV3); closed PRs are reviewed too."""
    rows = pr_dispositions(pr, verified).select(
        "*", F.col("pull_request.head").alias("head"), F.col("pull_request.base").alias("base")
    )
    repo = F.col("repository.full_name")
    return keep(
        rows, F.col("disposition.message") == PR_DONE,
        F.col("delivery_id").alias("task_id"),
        F.concat(text_or_null_word(repo), F.lit("#"), F.col("number").cast("string")).alias("pr_id"),
        repo.alias("repo_name"),
        F.col("number").alias("pr_number"),
        _or_empty(F.col("pull_request.title")).alias("pr_title"),
        _or_empty(F.col("pull_request.body")).alias("pr_description"),
        _within("head", "ref").alias("source_branch"),
        _within("base", "ref").alias("target_branch"),
        _within("head", "sha").alias("commit_sha"),
        _or_empty(F.col("pull_request.diff_url")).alias("diff_url"),
        map_trigger(F.col("action")).alias("trigger_event"),
        "received_at",
    )


def build_push_tasks(push: DataFrame, verified: bool = False) -> DataFrame:
    """Review tasks of the accepted push deliveries (EV7)."""
    repo = F.col("repository.full_name")
    branch = branch_name(F.col("ref"))
    return keep(
        push_dispositions(push, verified), F.col("disposition.message") == PUSH_DONE,
        F.col("delivery_id").alias("task_id"),
        F.concat(text_or_null_word(repo), F.lit("#push:"), F.col("after")).alias("pr_id"),
        repo.alias("repo_name"),
        F.lit(0).alias("pr_number"),
        F.concat(F.lit("Push: "), branch).alias("pr_title"),
        _within("head_commit", "message").alias("pr_description"),
        branch.alias("source_branch"),
        F.lit("").alias("target_branch"),
        F.col("after").alias("commit_sha"),
        compare_url(repo, F.col("before"), F.col("after")).alias("diff_url"),
        F.lit("PUSH").alias("trigger_event"),
        "received_at",
    )


def review_tasks(pr_tasks: DataFrame, push_tasks: DataFrame) -> DataFrame:
    """All review tasks, one per accepted delivery (EV9)."""
    return pr_tasks.unionByName(push_tasks)


def feedback_directives(comments: DataFrame) -> DataFrame:
    """Comments that are feedback directives, with the parsed fields (EV10, EV11)."""
    found = comments.withColumn("directive", directive_of(F.col("body")))
    d = F.col("directive")
    fields = [d[n].alias(n) for n in ["feedback", "rule_category", "agent_type", "file_path", "line_start"]]
    return keep(found, d.isNotNull(), *comments.columns, *fields)


def to_feedback(comments: DataFrame) -> DataFrame:
    """Feedback records of a comment feed (EV12); `created_at` is the arrival time."""
    d = feedback_directives(comments)
    return d.select(
        F.col("delivery_id").alias("id"),
        F.concat("repo_name", F.lit("#"), F.col("pr_number").cast("string")).alias("pr_id"),
        "file_path", "line_start", "rule_category", "agent_type",
        F.lit(None).cast("string").alias("code_snippet"),
        "feedback",
        F.col("received_at").alias("created_at"),
    )
