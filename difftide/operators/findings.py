"""Findings: rule hits (SV1-SV4), model responses (SR5), validation and fan-in (AG3-AG7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from difftide import schemas
from difftide.functions.rows import keep
from difftide.functions.text import not_blank
from difftide.operators.bug_rules import BUG_RULES
from difftide.operators.layer_rules import LAYER_RULES
from difftide.operators.rules import scan
from difftide.operators.style_rules import STYLE_RULES

# Severities per rule, agents, suggestions and sentinel texts.
SEVERITY_OF_RULE = {
    "EMPTY_CATCH_BLOCK": "MAJOR", "RESOURCE_LEAK": "MAJOR", "RETURN_IN_VOID_METHOD": "MAJOR",
    "STRING_COMPARISON_USING_EQ": "MINOR", "PRINT_STACK_TRACE": "MINOR",
    "EmptyBlock": "MAJOR", "MagicNumber": "MINOR", "MethodLength": "MINOR", "ParameterNumber": "MINOR",
    "LAYER_VIOLATION": "CRITICAL", "CYCLIC_DEPENDENCY": "MAJOR",
}
TOOL_CATEGORY = "static-analysis"
SUGGESTION_OF_AGENT = {
    "security": "Review and fix the identified code issue.",
    "code-style": "Review and fix the identified code style issue.",
    "architecture": "Review the architecture and refactor to address the identified issue.",
}
AGENT_WORDS = {
    "architecture": "architecture", "code-style": "code style", "logic": "logic", "security": "security",
}
NO_ISSUE_TEXT = {
    "architecture": "The code changes appear to follow architectural best practices based on automated analysis.",
    "code-style": "The code changes appear to follow coding standards based on automated analysis.",
    "logic": "The code changes appear to be logically correct based on automated analysis.",
    "security": "The code changes appear to be free of security vulnerabilities based on automated analysis.",
}
FAILED_TITLE = {
    "architecture": "Architecture review failed", "code-style": "Code style review failed",
    "logic": "Logic review failed", "security": "Security review failed",
}
TOOL_RULES = {"security": BUG_RULES, "code-style": STYLE_RULES, "architecture": LAYER_RULES}

FINDING_COLUMNS = schemas.FINDING.fieldNames()

# A finding's `seq` orders it inside its task: agent, then model rows before tool rows before the rows of
# custom agents, then file, rule and place. It is a struct, so no part can run into another.
MODEL, TOOL, CUSTOM = 0, 1, 2


def _pick(values: dict[str, str], key: Column, default: Column | None = None) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out if default is None else out.otherwise(default)


def agent_order(agent: Column) -> Column:
    """Position of an agent in the fixed order; custom agents come last."""
    out = None
    for i, name in enumerate(schemas.AGENTS):
        out = F.when(agent == name, i) if out is None else out.when(agent == name, i)
    return out.otherwise(len(schemas.AGENTS))


def make_seq(agent: Column, kind: int, file_seq: Column, rule: Column, place: Column) -> Column:
    return F.struct(
        agent_order(agent).alias("agent_order"), agent.alias("agent"), F.lit(kind).alias("kind"),
        file_seq.cast("long").alias("file"), rule.cast("int").alias("rule"), place.cast("long").alias("place"),
    )


def map_severity(rule: Column) -> Column:
    """Severity of a rule; anything not listed is INFO (SV1-SV3)."""
    return _pick(SEVERITY_OF_RULE, rule, F.lit("INFO"))


def agent_of_rule(rule: Column) -> Column:
    """Agent that owns a rule."""
    layer = rule.isin("LAYER_VIOLATION", "CYCLIC_DEPENDENCY", "SAME_LAYER_COUPLING")
    # Bug rules are spelled in capitals, style rules in camel case.
    return F.when(layer, "architecture").when(rule == F.upper(rule), "security").otherwise("code-style")


def hits_to_findings(hits: DataFrame) -> DataFrame:
    """Rule hits as findings of the agent that owns the rule (SV4); layering hits have line 0."""
    rows = hits.withColumn("agent_id", agent_of_rule(F.col("rule")))
    agent = F.col("agent_id")
    line = F.when(agent == "architecture", 0).otherwise(F.col("line_number"))
    return rows.select(
        "task_id", "pr_id",
        make_seq(agent, TOOL, F.col("file_seq"), F.col("hit_rule"), F.col("hit_place")).alias("seq"),
        "agent_id",
        map_severity(F.col("rule")).alias("severity"),
        F.lit(TOOL_CATEGORY).alias("category"),
        "file_path",
        line.alias("line_start"),
        line.alias("line_end"),
        F.col("rule").alias("title"),
        "description",
        _pick(SUGGESTION_OF_AGENT, agent).alias("suggestion"),
    )


def tool_hits(files: DataFrame) -> DataFrame:
    """Hits of every rule on every file, in one pass and without a shuffle."""
    rules = [rule for group in TOOL_RULES.values() for rule in group.values()]
    return scan(files, rules, keep_position=True)


def tool_findings(files: DataFrame) -> DataFrame:
    """Findings of every rule on every file, in one pass and without a shuffle."""
    return hits_to_findings(tool_hits(files))


# -- model responses -------------------------------------------------------------------------
_BAD = "_bad_record"


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add `rows` (finding structs) and `failed` to (task_id, pr_id, agent_id, response, error) rows.

    A response fails when the call reported an error, the text is not the agreed JSON or a severity
    is unknown.
    """
    schema = T.StructType([*schemas.AGENT_RESPONSE.fields, T.StructField(_BAD, T.StringType())])
    parsed = responses.withColumn(
        "parsed",
        F.from_json("response", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}),
    )
    rows = F.coalesce(F.col("parsed.results"), F.array().cast(schemas.AGENT_RESPONSE["results"].dataType))
    bad_severity = F.exists(rows, lambda r: r["severity"].isNotNull() & ~r["severity"].isin(schemas.SEVERITIES))
    ok = (
        F.col("error").isNull() & F.coalesce(F.col("response").rlike(r"\A\s*\{"), F.lit(False))
        & F.col(f"parsed.{_BAD}").isNull() & ~bad_severity
    )
    return parsed.select(
        "task_id", "pr_id", "agent_id", "error",
        (~F.coalesce(ok, F.lit(False))).alias("failed"),
        F.when(ok, rows).alias("rows"),
    )


def _finding_rows(parsed: DataFrame) -> DataFrame:
    """One finding per entry of `rows`, relabelled with the agent's id."""
    placed = F.transform(
        "rows",
        lambda r, i: F.struct(
            i.alias("pos"), r["severity"].alias("severity"), r["category"].alias("category"),
            r["filePath"].alias("file_path"), F.coalesce(r["lineStart"], F.lit(0)).alias("line_start"),
            F.coalesce(r["lineEnd"], F.lit(0)).alias("line_end"), r["title"].alias("title"),
            r["description"].alias("description"), r["suggestion"].alias("suggestion"),
        ),
    )
    rows = parsed.select("task_id", "pr_id", "agent_id", F.inline(placed))
    seq = make_seq(F.col("agent_id"), MODEL, F.lit(0), F.lit(0), F.col("pos"))
    return rows.withColumn("seq", seq).select(*FINDING_COLUMNS)


def parse_agent_responses(responses: DataFrame) -> DataFrame:
    """Findings of the readable responses (SR5); a failed one has no rows."""
    return _finding_rows(parse_responses(responses))


def valid_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with a non-blank path, of tasks with at least one changed file (AG3)."""
    named = findings.where(not_blank(F.col("file_path")))
    return named.join(files.select("task_id"), "task_id", "left_semi").select(*findings.columns)


def valid_findings_strict(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings whose path, slashes unified, is part of a changed path of their task (AG3, strict).

    `paths` holds one text of all changed paths per task (`diffs.changed_paths`). Equality and
    suffix are special cases of "part of", so one search per finding decides and no pairs of
    findings and files are formed.
    """
    wanted = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    named = findings.where(not_blank(F.col("file_path")) & ~F.col("file_path").contains("\n"))
    return (
        named.join(paths.select("task_id", "paths"), "task_id")
        .where(F.col("paths").contains(wanted))
        .select(*findings.columns)
    )


def _sentinel(agent: Column, title: Column, description: Column) -> Column:
    """The INFO row that stands for a whole response, as a response row."""
    return F.struct(
        F.lit("INFO").alias("severity"), F.concat(agent, F.lit("-review")).alias("category"),
        F.lit("").alias("filePath"), F.lit(0).alias("lineStart"), F.lit(0).alias("lineEnd"),
        title.alias("title"), description.alias("description"), F.lit("").alias("suggestion"),
    )


def no_issues(agent: Column) -> Column:
    """Row of a readable response without a valid finding."""
    title = F.concat(F.lit("No "), _pick(AGENT_WORDS, agent, agent), F.lit(" issues found"))
    return _sentinel(agent, title, _pick(NO_ISSUE_TEXT, agent, F.lit("")))


def failure(agent: Column, error: Column) -> Column:
    """Row of a failed response."""
    title = _pick(FAILED_TITLE, agent, F.concat(agent, F.lit(" review failed")))
    text = F.concat(
        F.lit("Unable to complete "), _pick(AGENT_WORDS, agent, agent),
        F.lit(" review due to an internal error: "), F.coalesce(error, F.lit("unreadable response")),
    )
    return _sentinel(agent, title, text)


def _sentinel_rows(rows: DataFrame, row: Column) -> DataFrame:
    return _finding_rows(rows.withColumn("rows", F.array(row)))


def no_issue_rows(responses: DataFrame, valid: DataFrame) -> DataFrame:
    """One INFO row per readable response without a valid finding (AG4)."""
    readable = keep(parse_responses(responses), ~F.col("failed"), "task_id", "pr_id", "agent_id")
    empty = readable.join(valid.select("task_id", "agent_id"), ["task_id", "agent_id"], "left_anti")
    return _sentinel_rows(empty, no_issues(F.col("agent_id")))


def agent_failures(responses: DataFrame) -> DataFrame:
    """One INFO row per failed response (AG5); the agent's tool findings are lost as well."""
    failed = keep(parse_responses(responses), F.col("failed"), "task_id", "pr_id", "agent_id", "error")
    return _sentinel_rows(failed, failure(F.col("agent_id"), F.col("error")))


def model_findings(responses: DataFrame, files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All rows of the model responses in one pass: valid findings, else a sentinel, or a failure.

    Whether a task has files (or its path text, for the strict check) is joined once per response;
    the rest is decided inside the response's row array.
    """
    parsed = parse_responses(responses)
    agent = F.col("agent_id")
    if paths is None:
        # Only these keys are hashed, so the responses and their rows need no sort.
        known = files.select("task_id").distinct().withColumn("_known", F.lit(True)).hint("shuffle_hash")
        fits = lambda r: not_blank(r["filePath"]) & F.coalesce(F.col("_known"), F.lit(False))
    else:
        known = paths.select("task_id", F.col("paths").alias("_known"))
        fits = lambda r: (
            not_blank(r["filePath"]) & ~r["filePath"].contains("\n")
            & F.coalesce(F.col("_known").contains(F.replace(r["filePath"], F.lit("\\"), F.lit("/"))), F.lit(False))
        )
    joined = parsed.join(known, "task_id", "left").withColumn("valid", F.filter("rows", fits))
    rows = (
        F.when(F.col("failed"), F.array(failure(agent, F.col("error"))))
        .when(F.size("valid") == 0, F.array(no_issues(agent)))
        .otherwise(F.col("valid"))
    )
    return _finding_rows(joined.withColumn("rows", rows))


def all_findings(
    responses: DataFrame, files: DataFrame, *custom: DataFrame, paths: DataFrame | None = None
) -> DataFrame:
    """Fan-in of all agents (AG6): model rows, sentinels, failures, tool rows, custom agents.

    Tool rows of an agent whose response failed are dropped. `seq` fixes the order inside a task.
    With `paths`, model rows are validated strictly. Hits meet the failed responses before they become findings, which
    are much wider, and only the keys of those are hashed: nothing is sorted.
    """
    failed = keep(parse_responses(responses), F.col("failed"), "task_id", "agent_id").hint("shuffle_hash")
    hits = tool_hits(files).withColumn("_agent", agent_of_rule(F.col("rule")))
    kept = hits.join(failed.withColumnRenamed("agent_id", "_agent"), ["task_id", "_agent"], "left_anti")
    tools = hits_to_findings(kept)
    parts = [model_findings(responses, files, paths), tools, *custom]
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


# -- user extension --------------------------------------------------------------------------
_AGENTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_agent(name: str, review: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Add an agent: a function from (contexts, files) to a findings table (AG7)."""
    _AGENTS[name] = review


def registered_agents() -> list[str]:
    return sorted(_AGENTS)


def run_agent(name: str, contexts: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of a registered agent, relabelled with its name.

    Every row the agent returns is kept. Its own `seq` orders its rows in a task; findings that share one are told apart by a hash
    of what they say, and rows that share that too (repeated ones) by a number, so (task, seq) is unique in the fan-in.
    """
    rows = _AGENTS[name](contexts, files).withColumn("agent_id", F.lit(name)).select(*FINDING_COLUMNS)
    said = [c for c in FINDING_COLUMNS if c not in ("task_id", "pr_id", "seq")]
    alike = Window.partitionBy("task_id", "seq", F.xxhash64(*said)).orderBy("pr_id", *said)
    numbered = rows.withColumn("_copy", F.row_number().over(alike) - 1)
    return numbered.withColumn("seq", make_seq(F.lit(name), CUSTOM, F.col("seq"), F.col("_copy"), F.xxhash64(*said))).drop("_copy")


def run_agents(contexts: DataFrame, files: DataFrame, names: Sequence[str] | None = None) -> list[DataFrame]:
    """Findings of the registered agents; agents that return no table are left out."""
    return [run_agent(n, contexts, files) for n in (names or registered_agents())]
