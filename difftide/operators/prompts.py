"""Prompt dataset: one user prompt per (task, agent), for an external batch job (AG1, AG2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from difftide.functions.text import not_blank

# Texts that frame a prompt.
SUBJECT = {
    "architecture": "architecture issues",
    "code-style": "code style issues",
    "logic": "logic errors and bugs",
    "security": "security vulnerabilities",
}
NO_FILES = "**No changed files available.** Diff may be empty or GitHub API unreachable.\n\n"

# Our own wording of what each agent looks for.
CHECKLIST = {
    "architecture": "Look for layer skips, package cycles, coupling inside a layer and misplaced duties.",
    "code-style": "Look for unclear names, missing comments, long methods, duplication and odd formatting.",
    "logic": "Look for wrong conditions, missing null checks, off-by-one bounds, leaks and races.",
    "security": "Look for injection, unsafe rendering, path tricks, secrets, weak crypto and missing checks.",
}
COMMON_RULE = (
    " Report each problem with severity, category, file path, first and last line, title, description"
    " and suggestion, as JSON, and only for files listed in the prompt."
)


def agent_dim(spark: SparkSession) -> DataFrame:
    """The four agents with subject and system prompt (AG2)."""
    rows = [(a, SUBJECT[a], CHECKLIST[a] + COMMON_RULE) for a in SUBJECT]
    return spark.createDataFrame(rows, "agent_id string, subject string, system_prompt string")


def _file_lines(files: Column) -> Column:
    bullets = F.transform(
        files,
        lambda f: F.concat(
            F.lit("- "), f["file_path"], F.lit(" ("), f["change_type"], F.lit(") [+"),
            f["additions"].cast("string"), F.lit(", -"), f["deletions"].cast("string"), F.lit("]\n"),
        ),
    )
    listed = F.concat(F.lit("## Changed Files\n"), F.array_join(bullets, ""), F.lit("\n"))
    return F.when(F.size(files) > 0, listed).otherwise(F.lit(NO_FILES))


def _diff_blocks(blocks: Column) -> Column:
    fenced = F.transform(
        blocks,
        lambda b: F.concat(
            F.lit("### File: "), b["file_path"], F.lit("\n```\n"), b["header"], F.lit("\n"),
            F.array_join(b["lines"], "\n"), F.lit("\n```\n\n"),
        ),
    )
    text = F.concat(F.lit("## Code Changes (Diff)\n"), F.array_join(fenced, ""))
    return F.when(F.size(blocks) > 0, text).otherwise(F.lit(""))


def review_prompts(contexts: DataFrame) -> DataFrame:
    """System and user prompt per (task, agent) (AG1, AG2). The agents are a literal array, so nothing is joined."""
    body = contexts.withColumn(
        "body",
        F.concat(
            F.lit("PR ID: "), "pr_id", F.lit("\n\n"), _file_lines(F.col("changed_files")),
            _diff_blocks(F.col("diff_blocks")),
        ),
    )
    agents = F.array(
        *[
            F.struct(F.lit(a).alias("agent_id"), F.lit(s).alias("subject"), F.lit(CHECKLIST[a] + COMMON_RULE).alias("system"))
            for a, s in SUBJECT.items()
        ]
    )
    rows = body.withColumn("agent", F.explode(agents))
    graph, history = F.col("dependency_graph"), F.col("related_history")
    plain = F.when(
        not_blank(graph), F.concat(F.lit("## Dependency Context\n"), graph, F.lit("\n"))
    ).otherwise(F.lit(""))
    layered = F.concat(
        F.when(not_blank(graph), F.concat(F.lit("## Dependency Graph\n"), graph, F.lit("\n\n")))
        .otherwise(F.lit("")),
        F.when(not_blank(history), F.concat(F.lit("## Related History\n"), history, F.lit("\n")))
        .otherwise(F.lit("")),
    )
    return rows.select(
        "task_id", "pr_id", "agent.agent_id", F.col("agent.system").alias("system_prompt"),
        F.concat(
            F.lit("Review the following pull request for "), "agent.subject", F.lit(".\n"), "body",
            F.when(F.col("agent.agent_id") == "architecture", layered).otherwise(plain),
        ).alias("prompt"),
    )
