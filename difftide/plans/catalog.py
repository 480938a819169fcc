"""Registered queries: each runs one operator over whole (given or derived) tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difftide.functions.signing import hmac_sha256_hex
from difftide.operators import diffs as df_ops
from difftide.operators import events as ev
from difftide.operators import extras, findings as fi, gate, importance, layer_rules, ledger, memory, prompts, reports
from difftide.operators.bug_rules import BUG_RULES, empty_catch
from difftide.operators.layer_rules import LAYER_RULES
from difftide.operators.rules import scan
from difftide.operators.style_rules import STYLE_RULES
from difftide.plans.derived import WEBHOOK_SECRET, derived, table
from difftide.session import shared_folder
from difftide.sinks import outputs
from difftide.sources import diffs as diff_sources
from difftide.sources import webhooks
from difftide.streaming import feeds, reviews, rule_state

# The threshold that splits the derived reports into both warning outcomes.
GATE_THRESHOLD = 140

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


# -- shared inputs ---------------------------------------------------------------------------
def _pr(spark: SparkSession, sf: str) -> DataFrame:
    return webhooks.read_pr_webhooks(derived(spark, sf, "fx_pr_webhooks"))


def _push(spark: SparkSession, sf: str) -> DataFrame:
    return webhooks.read_push_webhooks(derived(spark, sf, "fx_push_webhooks"))


def _signed(raw: DataFrame, all_good: bool = False) -> DataFrame:
    """Raw deliveries with a signature; of every seven one has none and one a wrong one, unless all are good."""
    good = F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("body"), WEBHOOK_SECRET))
    k = F.col("delivery_id")
    mixed = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 3, F.concat(F.lit("sha256="), F.sha2("body", 256))).otherwise(good)
    return raw.withColumn("signature", good if all_good else mixed)


def _numbered(findings: DataFrame) -> DataFrame:
    """Findings with the agent and the place of their `seq` as plain columns."""
    return findings.withColumns({"seq_agent": F.col("seq.agent_order"), "seq_place": F.col("seq.place")}).drop("seq")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.changed_files(derived(spark, sf, "fx_diffs"))


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    return ev.to_feedback(derived(spark, sf, "fx_comments"))


def _resets(feedback: DataFrame) -> DataFrame:
    """Resets placed right before a rule's first dismissal, so that its first counted row is one."""
    names = ["XSS", "LAYER_VIOLATION", "CIRCULAR_DEPENDENCY"]
    early = feedback.where(F.col("rule_category").isin(names) & (F.col("feedback") == "DISMISSED"))
    return early.groupBy("agent_type", "rule_category").agg(
        (F.min("created_at") - F.expr("INTERVAL 1 MICROSECOND")).alias("reset_at")
    )


def _stats_after_reset(spark: SparkSession, sf: str) -> DataFrame:
    feedback = _feedback(spark, sf)
    return memory.compute_rule_stats(memory.apply_resets(feedback, _resets(feedback)))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "fx_findings")


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    return reports.dedup_findings(_findings(spark, sf))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_markdown(_heads(spark, sf), reports.placed_findings(_findings(spark, sf)))


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "fx_tasks")


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    return reports.reports(_tasks(spark, sf), _findings(spark, sf))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "fx_responses")


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return fi.valid_findings(fi.parse_agent_responses(_responses(spark, sf)), _files(spark, sf))


# -- sources ---------------------------------------------------------------------------------
@query
def pr_webhook_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _pr(spark, sf).select(
        "delivery_id", "action", "number", F.col("repository.full_name").alias("full_name"),
        F.col("pull_request.title").alias("title"), F.col("pull_request.head.ref").alias("head_ref"),
        F.col("pull_request.head.sha").alias("head_sha"), F.col("pull_request.base.ref").alias("base_ref"),
        F.col("pull_request.diff_url").alias("diff_url"), "parse_error",
    )


@query
def push_webhook_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _push(spark, sf).select(
        "delivery_id", "ref", "before", "after", F.col("repository.full_name").alias("full_name"),
        F.col("head_commit.message").alias("head_message"), F.size("commits").alias("commit_count"),
        "parse_error",
    ).withColumn("commit_count", F.greatest("commit_count", F.lit(0)))


@query
def comment_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = webhooks.read_comment_webhooks(derived(spark, sf, "fx_comment_payloads"))
    return rows.select("delivery_id", "action", "repo_name", F.coalesce("pr_number", F.lit(-1)).alias("pr_number"), "body", "parse_error")


@query
def comment_parse_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = webhooks.read_comment_webhooks(derived(spark, sf, "fx_comment_payloads"), strict=True)
    return rows.select("delivery_id", "action", "repo_name", F.coalesce("pr_number", F.lit(-1)).alias("pr_number"), "body", "parse_error")


@query
def diff_fetch_clean(spark: SparkSession, sf: str) -> DataFrame:
    clean = diff_sources.clean_diffs(ev.build_pr_tasks(_pr(spark, sf), verified=True), derived(spark, sf, "fx_fetches"))
    return clean.select("task_id", "pr_id", F.length("body").alias("chars"), F.md5("body").alias("body_md5"))


@query
def page_fetch_clean(spark: SparkSession, sf: str) -> DataFrame:
    log = derived(spark, sf, "fx_page_fetches")
    body = diff_sources.usable_diff(F.col("diff_url"), F.col("http_status"), F.col("body"))
    return log.select("task_id", F.length(body).alias("chars"), F.md5(body).alias("body_md5"))


@query
def agent_response_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(fi.parse_agent_responses(_responses(spark, sf)))


# -- events ----------------------------------------------------------------------------------
@query
def signature_valid(spark: SparkSession, sf: str) -> DataFrame:
    raw = derived(spark, sf, "fx_pr_webhooks")
    k = F.col("delivery_id")
    digest = hmac_sha256_hex(F.col("body"), WEBHOOK_SECRET)
    header = (
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, digest)
        .when(k % 7 == 2, F.concat(F.lit("sha256="), F.upper(digest)))
        .when(k % 7 == 3, F.concat(F.lit("sha256="), F.sha2("body", 256)))
        .otherwise(F.concat(F.lit("sha256="), digest))
    )
    checked = ev.with_signature_valid(raw.withColumn("signature", header), WEBHOOK_SECRET)
    return checked.select("delivery_id", "signature", "signature_valid")


@query
def trigger_map(spark: SparkSession, sf: str) -> DataFrame:
    trigger = ev.map_trigger(F.col("action"))
    return _pr(spark, sf).groupBy("action", trigger.alias("trigger_event")).agg(F.count("*").alias("deliveries"))


@query
def pr_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return ev.build_pr_tasks(_pr(spark, sf), verified=True)


@query
def push_routing(spark: SparkSession, sf: str) -> DataFrame:
    routed = ev.route_push(_push(spark, sf).where(F.col("parse_error").isNull()))
    return routed.select("delivery_id", F.coalesce("skip_reason", F.lit("review")).alias("route"))


@query
def push_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return ev.build_push_tasks(_push(spark, sf), verified=True)


@query
def webhook_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    pr, push = (
        ev.with_signature_valid(_signed(derived(spark, sf, name)), WEBHOOK_SECRET) for name in ("fx_pr_webhooks", "fx_push_webhooks")
    )
    return ev.dispositions(webhooks.read_pr_webhooks(pr), webhooks.read_push_webhooks(push))


@query
def review_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return ev.review_tasks(ev.build_pr_tasks(_pr(spark, sf), verified=True), ev.build_push_tasks(_push(spark, sf), verified=True))


@query
def feedback_directives(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.feedback_directives(derived(spark, sf, "fx_comments"))
    return rows.select("delivery_id", "feedback", "rule_category", "agent_type", "file_path", "line_start")


@query
def derive_agent(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.feedback_directives(derived(spark, sf, "fx_comments"))
    return rows.groupBy("rule_category", "agent_type").agg(F.count("*").alias("comments"))


@query
def feedback_records(spark: SparkSession, sf: str) -> DataFrame:
    comments = webhooks.read_comment_webhooks(derived(spark, sf, "fx_comment_payloads"))
    return ev.to_feedback(comments).drop("code_snippet")


# -- diffs -----------------------------------------------------------------------------------
@query
def diff_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = df_ops.diff_sections(derived(spark, sf, "fx_diffs"))
    return rows.select("task_id", "file_seq", F.length("section").alias("chars"), F.md5("section").alias("section_md5"))


@query
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).withColumn("diff_content", F.md5("diff_content"))


@query
def hunks(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.hunks(_files(spark, sf)).withColumn("lines", F.array_join("lines", "\n"))


@query
def hunk_lines(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.hunk_lines(df_ops.hunks(_files(spark, sf)))


@query
def file_imports(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.file_imports(_files(spark, sf)).withColumn("imports", F.array_join("imports", ","))


@query
def extension_counts(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.extension_counts(_files(spark, sf))


@query
def dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.dependency_edges(_files(spark, sf))


@query
def dependency_graph(spark: SparkSession, sf: str) -> DataFrame:
    return df_ops.dependency_graph(derived(spark, sf, "fx_diffs"))


@query
def contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = df_ops.contexts(derived(spark, sf, "fx_diffs"))
    paths = F.transform("changed_files", lambda f: F.concat(f["file_path"], F.lit(" "), f["change_type"]))
    headers = F.transform("diff_blocks", lambda b: b["header"])
    return rows.select(
        "task_id", "pr_id", F.size("changed_files").alias("file_count"), F.size("diff_blocks").alias("hunk_count"),
        F.array_join(paths, ",").alias("files"), F.array_join(headers, ",").alias("headers"),
        "dependency_graph", "related_history",
    )


# -- rules -----------------------------------------------------------------------------------
def _rule_query(rule: Callable, on: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        files = _files(spark, sf) if on == "diffs" else derived(spark, sf, "fx_sources")
        return scan(files, [rule])

    return run


for _name, _rule in {**BUG_RULES, **STYLE_RULES}.items():
    QUERIES[_name] = _rule_query(_rule, "diffs")
for _name, _rule in LAYER_RULES.items():
    QUERIES[_name] = _rule_query(_rule, "sources")


@query
def rule_empty_catch_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return scan(_files(spark, sf), [lambda text: empty_catch(text, multiplicity="reference")])


@query
def package_edges(spark: SparkSession, sf: str) -> DataFrame:
    return layer_rules.package_edges(derived(spark, sf, "fx_sources"))


@query
def package_layers(spark: SparkSession, sf: str) -> DataFrame:
    return layer_rules.package_layers(derived(spark, sf, "fx_sources"))


@query
def tool_findings(spark: SparkSession, sf: str) -> DataFrame:
    return fi.tool_findings(_files(spark, sf)).drop("seq")


@query
def source_tool_findings(spark: SparkSession, sf: str) -> DataFrame:
    return fi.tool_findings(derived(spark, sf, "fx_sources")).drop("seq")


# -- agents ----------------------------------------------------------------------------------
@query
def review_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = prompts.review_prompts(df_ops.contexts(derived(spark, sf, "fx_diffs")))
    return rows.select("task_id", "agent_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5"), F.md5("system_prompt").alias("system_md5"))


@query
def valid_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(_valid(spark, sf))


@query
def valid_findings_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = fi.parse_agent_responses(_responses(spark, sf))
    return _numbered(fi.valid_findings_strict(rows, df_ops.changed_paths(derived(spark, sf, "fx_diffs"))))


@query
def no_issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(fi.no_issue_rows(_responses(spark, sf), _valid(spark, sf)))


@query
def agent_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(fi.agent_failures(_responses(spark, sf)))


@query
def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    return fi.all_findings(_responses(spark, sf), _files(spark, sf)).drop("seq")


def big_change_agent(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """Example of a custom agent: one finding per file with many changed lines."""
    churn = F.col("additions") + F.col("deletions")
    return files.where(churn > 10).select(
        "task_id", "pr_id", F.col("file_seq").cast("long").alias("seq"), F.lit("MINOR").alias("severity"),
        F.lit("big-change").alias("category"), "file_path", F.lit(1).alias("line_start"),
        churn.alias("line_end"), F.lit("Big change").alias("title"),
        F.concat(churn.cast("string"), F.lit(" changed lines")).alias("description"),
        F.lit("Split the change.").alias("suggestion"),
    )


@query
def custom_agent(spark: SparkSession, sf: str) -> DataFrame:
    fi.register_agent("size", big_change_agent)
    diffs = derived(spark, sf, "fx_diffs")
    rows = fi.run_agent("size", df_ops.contexts(diffs), df_ops.changed_files(diffs))
    return rows.withColumn("seq", F.col("seq.file"))


@query
def all_findings_custom(spark: SparkSession, sf: str) -> DataFrame:
    """The fan-in with a registered agent, less what an allowlist permits."""
    fi.register_agent("size", big_change_agent)
    diffs = derived(spark, sf, "fx_diffs")
    files = df_ops.changed_files(diffs)
    found = fi.all_findings(_responses(spark, sf), files, *fi.run_agents(df_ops.contexts(diffs), files, ["size"]))
    allowed = spark.createDataFrame([("big-change", "src/m1"), ("static-analysis", "src/m2")], "rule_category string, path string")
    return extras.allowlist_filter(found, allowed).drop("seq")


# -- memory ----------------------------------------------------------------------------------
@query
def rule_counters(spark: SparkSession, sf: str) -> DataFrame:
    return memory.rule_counters(_feedback(spark, sf))


@query
def rule_counters_incremental(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feedback(spark, sf)
    old, new = rows.where(F.col("line_start") < 4), rows.where(F.col("line_start") >= 4)
    return memory.merge_counters(memory.rule_counters(old), memory.rule_counters(new))


@query
def rule_downgrade(spark: SparkSession, sf: str) -> DataFrame:
    return memory.rule_downgrade(_feedback(spark, sf))


@query
def rule_stats(spark: SparkSession, sf: str) -> DataFrame:
    return memory.rule_stats(_feedback(spark, sf))


@query
def rule_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = _findings(spark, sf).select(F.col("agent_id").alias("agent_type"), F.col("category").alias("rule_category"))
    stats = memory.compute_rule_stats(_feedback(spark, sf))
    found = memory.rule_lookup(stats, keys.where(F.col("rule_category").isNotNull()).distinct())
    return found.select("agent_type", "rule_category", F.coalesce("total", F.lit(0)).alias("total"), "is_downgraded")


@query
def recent_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recent_feedback(_feedback(spark, sf)).drop("code_snippet")


@query
def rule_stats_after_reset(spark: SparkSession, sf: str) -> DataFrame:
    return _stats_after_reset(spark, sf)


@query
def memory_hints(spark: SparkSession, sf: str) -> DataFrame:
    return memory.memory_hints(memory.compute_rule_stats(_feedback(spark, sf)))


@query
def file_history_hints(spark: SparkSession, sf: str) -> DataFrame:
    feedback = _feedback(spark, sf)
    # The diffs name their files F<n><m>.java, the comments F<n>.java.
    renamed = feedback.withColumn("file_path", F.replace("file_path", F.lit(".java"), F.lit("0.java")))
    return memory.file_history_hints(renamed, _files(spark, sf))


@query
def fp_filter(spark: SparkSession, sf: str) -> DataFrame:
    return memory.fp_filter(_findings(spark, sf), _stats_after_reset(spark, sf))


@query
def fp_filter_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return memory.fp_filter(_findings(spark, sf), _stats_after_reset(spark, sf), normalize_agent_ids=True)


@query
def fp_filter_stats(spark: SparkSession, sf: str) -> DataFrame:
    return memory.fp_filter_stats(_findings(spark, sf), _stats_after_reset(spark, sf))


# -- reports ---------------------------------------------------------------------------------
@query
def dedup_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _deduped(spark, sf)


@query
def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rank_findings(_deduped(spark, sf))


@query
def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_counts(_deduped(spark, sf))


@query
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf)


@query
def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


@query
def report_markdown_parts(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.report_parts(_pieces(spark, sf), part_rows=100)


@query
def findings_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return reports.findings_by_file(_deduped(spark, sf))


@query
def findings_by_agent(spark: SparkSession, sf: str) -> DataFrame:
    return reports.findings_by_agent(_deduped(spark, sf))


@query
def line_comments(spark: SparkSession, sf: str) -> DataFrame:
    return reports.line_comments(_deduped(spark, sf), _tasks(spark, sf))


@query
def fallback_comments(spark: SparkSession, sf: str) -> DataFrame:
    rows = _findings(spark, sf)
    unresolved = rows.where(F.col("line_start") % 3 == 1).select("task_id", "file_path", "line_start")
    return reports.fallback_comments(_deduped(spark, sf), _tasks(spark, sf), unresolved)


@query
def report_routing(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_routing(_tasks(spark, sf), token="t")


@query
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gate.quality_gate(_heads(spark, sf), GATE_THRESHOLD)


@query
def gate_from_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Reports written as files, read again as a build server finds them, and judged."""
    folder = shared_folder(spark, "reports")
    pieces = _pieces(spark, sf)
    name = F.concat(F.lit("task-"), F.col("task_id").cast("string"), F.lit(".md"))
    outputs.write_report_files(pieces.withColumn("file_name", name), folder)
    verdicts = gate.gate_from_lines(webhooks.read_report_lines(spark, folder), GATE_THRESHOLD)
    named = _tasks(spark, sf).select("task_id", "pr_id", name.alias("file_name"))
    return named.join(verdicts, "file_name").drop("file_name")


@query
def push_report_files(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of the push tasks, written as files and read again. Of tasks that share a name the latest id stays."""
    folder = shared_folder(spark, "push-reports")
    tasks = _tasks(spark, sf)
    pieces = _pieces(spark, sf)
    outputs.write_push_reports(pieces, tasks, folder)
    read = outputs.report_digests(webhooks.read_report_lines(spark, folder))
    return read.withColumn("chars", F.col("chars").cast("int"))


# -- sinks -----------------------------------------------------------------------------------
@query
def feedback_log(spark: SparkSession, sf: str) -> DataFrame:
    """The feedback log, appended to and read again."""
    folder = shared_folder(spark, "feedback-log")
    outputs.append_feedback(_feedback(spark, sf), folder)
    return spark.read.parquet(folder).drop("code_snippet").withColumn("day", F.col("day").cast("string"))


@query
def push_report_names(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.push_report_names(_tasks(spark, sf))


@query
def summary_comments(spark: SparkSession, sf: str) -> DataFrame:
    markdown = _pieces(spark, sf)
    return outputs.summary_comments(markdown, _tasks(spark, sf))


@query
def review_records(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.review_records(review_tasks(spark, sf))


@query
def review_results(spark: SparkSession, sf: str) -> DataFrame:
    return outputs.review_results(_deduped(spark, sf))


# -- streaming -------------------------------------------------------------------------------
def _landed(df: DataFrame, folder: str) -> str:
    """Write deliveries as files for a stream to pick up, one for each core, so that micro-batches stay as many."""
    df.coalesce(df.sparkSession.sparkContext.defaultParallelism).write.mode("overwrite").parquet(folder)
    return folder


def _state(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """Rule statistics after the whole comment feed has run through the stream."""
    signed = F.lit(None).cast("string").alias("signature")
    landed = _landed(derived(spark, sf, "fx_comment_payloads").select("*", signed), f"{root}/comments")
    return rule_state.stream_rule_stats(spark, landed, f"{root}/stats")


def _webhook_dirs(spark: SparkSession, sf: str, root: str) -> tuple[str, str]:
    """Both feeds with good signatures, landed as files."""
    pr = _landed(_signed(derived(spark, sf, "fx_pr_webhooks"), all_good=True), f"{root}/pr")
    return pr, _landed(_signed(derived(spark, sf, "fx_push_webhooks"), all_good=True), f"{root}/push")


def _findings_stream(spark: SparkSession, sf: str, root: str) -> DataFrame:
    landed = _landed(_findings(spark, sf), f"{root}/findings")
    return spark.readStream.schema(_findings(spark, sf).schema).option("maxFilesPerTrigger", 4).parquet(landed)


@query
def stream_tasks(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "stream-tasks")
    feeds.run_to_table(feeds.stream_tasks(spark, WEBHOOK_SECRET, *_webhook_dirs(spark, sf, root)), f"{root}/tasks", f"{root}/progress")
    return spark.read.parquet(f"{root}/tasks")


@query
def stream_tasks_once(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of feeds that deliver every third event again a little later; an event gives one task."""
    root = shared_folder(spark, "stream-tasks-once")
    folders = []
    for feed in ("pr", "push"):
        raw = _signed(derived(spark, sf, f"fx_{feed}_webhooks"), all_good=True)
        again = raw.where(F.col("delivery_id") % 3 == 0).withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 90 SECONDS"))
        folders.append(_landed(raw.unionByName(again), f"{root}/{feed}"))
    tasks = feeds.stream_tasks(spark, WEBHOOK_SECRET, *folders, redelivery="10 minutes")
    feeds.run_to_table(tasks, f"{root}/tasks", f"{root}/progress")
    return spark.read.parquet(f"{root}/tasks").select("task_id", "pr_id", "repo_name", "commit_sha", "trigger_event")


@query
def stream_rule_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf, shared_folder(spark, "stream-stats"))


@query
def stream_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """The findings feed, filtered in micro-batches with the rule statistics of the comment stream."""
    root = shared_folder(spark, "stream-reviewed")
    _state(spark, sf, root)
    return reviews.stream_reviewed(_findings_stream(spark, sf, root), f"{root}/stats", f"{root}/kept", f"{root}/progress")


def _report_rows(reports_: DataFrame) -> DataFrame:
    return reports_.select("task_id", "position", "kind", "delivery", F.md5("text").alias("text_md5"))


@query
def stream_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of all tasks from streams of tasks and findings; reviews that are split over micro-batches are one."""
    root = shared_folder(spark, "stream-reports")
    _state(spark, sf, root)
    tasks = spark.readStream.schema(_tasks(spark, sf).schema).parquet(_landed(_tasks(spark, sf), f"{root}/landed"))
    return _report_rows(reviews.stream_reports(tasks, _findings_stream(spark, sf, root), f"{root}/stats", f"{root}/flow", f"{root}/progress", token="t"))


@query
def review_flow(spark: SparkSession, sf: str) -> DataFrame:
    """From event to report in one flow: signed webhooks to tasks, findings through the filter, reports renewed by change."""
    root = shared_folder(spark, "review-flow")
    _state(spark, sf, root)
    tasks = feeds.stream_tasks(spark, WEBHOOK_SECRET, *_webhook_dirs(spark, sf, root))
    return _report_rows(reviews.stream_reports(tasks, _findings_stream(spark, sf, root), f"{root}/stats", f"{root}/flow", f"{root}/progress", token="t"))


# -- described operators ---------------------------------------------------------------------
@query
def incremental_hunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = df_ops.hunks(_files(spark, sf))
    reviewed = extras.reviewed_hunks(rows.where(F.col("hunk_seq") == 1))
    fresh = extras.incremental_hunks(rows, reviewed)
    return fresh.select("task_id", "pr_id", "file_seq", "hunk_seq", "file_path", "header", "hunk_hash")


@query
def context_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return extras.context_chunks(_files(spark, sf), budget=600)


@query
def file_importance(spark: SparkSession, sf: str) -> DataFrame:
    return importance.file_importance(derived(spark, sf, "fx_modules"))


@query
def context_chunks_important(spark: SparkSession, sf: str) -> DataFrame:
    files = derived(spark, sf, "fx_modules")
    return extras.context_chunks(files, 600, importance.file_importance(files))


@query
def review_kpis(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    changed = F.col("additions") + F.col("deletions")
    lines = files.groupBy("task_id").agg(
        F.sum(changed).alias("changed_lines"),
        F.sum(F.when(F.col("change_type") != "DELETED", changed).otherwise(0)).alias("reviewed_lines"),
    )
    verdicts = gate.quality_gate(_heads(spark, sf), GATE_THRESHOLD).select("task_id", (F.col("gate") == "FAIL").alias("failed"))
    blocked = F.coalesce("failed", F.lit(False))
    # Made inputs: the given tables hold neither response times nor judgements of blocks.
    reviews = lines.join(verdicts, "task_id", "left").select(
        "task_id", "changed_lines", "reviewed_lines", (F.col("task_id") % 900).alias("response_seconds"), blocked.alias("blocked"),
        (blocked & (F.col("task_id") % 3 == 0)).alias("false_block"),
    )
    return extras.review_kpis(reviews, _findings(spark, sf), _feedback(spark, sf))


@query
def scan_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return extras.scan_distinct(_files(spark, sf), [BUG_RULES["rule_system_out"], BUG_RULES["rule_todo"]])


def _highest(df: DataFrame, tasks: DataFrame) -> int | None:
    """The highest task of a table that is costly to make; `tasks` is cheap and holds at least its tasks, whose last ones are tried first."""
    low, top = tasks.agg(F.min("task_id"), F.max("task_id")).first()
    found, width = None, 1024
    while top is not None and found is None and width < 16 * (top - low + 1):
        found = df.where(F.col("task_id") > top - width).agg(F.max("task_id")).first()[0]
        width *= 16
    return found


def _halves(df: DataFrame, tasks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tasks that came first, and the later ones."""
    half = (df.agg(F.max("task_id")).first()[0] if tasks is None else _highest(df, tasks)) // 2
    return df.where(F.col("task_id") <= half), df.where(F.col("task_id") > half)


@query
def hunk_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks to review of two runs with many pushes each; the second knows what the first has reviewed."""
    book, diffs = shared_folder(spark, "hunk-ledger"), derived(spark, sf, "fx_diffs")
    halves = _halves(df_ops.hunks(df_ops.changed_files(diffs)), diffs)
    return reduce(DataFrame.unionByName, [ledger.review_push(rows, book, run) for run, rows in enumerate(halves)])


@query
def scan_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Rule hits of all files half an hour after half of them were scanned; contents known since then aren't scanned again."""
    cache = shared_folder(spark, "scan-cache")
    files, rules, at = _files(spark, sf), [BUG_RULES["rule_system_out"], BUG_RULES["rule_todo"]], datetime(2024, 1, 1)
    ledger.cached_scan(_halves(files)[0], rules, "1", cache, 0, at, timedelta(hours=1))
    return ledger.cached_scan(files, rules, "1", cache, 1, at + timedelta(minutes=30), timedelta(hours=1))


@query
def merged_findings(spark: SparkSession, sf: str) -> DataFrame:
    return extras.merge_findings(_findings(spark, sf))


@query
def allowlist_filter(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") % 2 == 0, "XSS").otherwise("FORMAT").alias("rule_category"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("src/m"), (F.col("n_nationkey") % 5).cast("string")))
        .otherwise(F.concat(F.lit("src/m1/F"), (F.col("n_nationkey") % 6).cast("string"), F.lit(".java")))
        .alias("path"),
    )
    return extras.allowlist_filter(_findings(spark, sf), allowed)


@query
def similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "embeddings")
    found = extras.similar_vectors(corpus.where(F.col("vec_id") % 20 == 0), corpus, k=5)
    return found.select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


# -- whole review ----------------------------------------------------------------------------
@query
def review_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Webhooks and fetch log to gate verdicts: all stages of a review for every task."""
    tasks = ev.build_pr_tasks(_pr(spark, sf), verified=True)
    clean = diff_sources.clean_diffs(tasks, derived(spark, sf, "fx_fetches"))
    files = df_ops.changed_files(clean)
    answers = _responses(spark, sf).join(tasks.select("task_id"), "task_id", "left_semi")
    found = fi.all_findings(answers, files)
    kept = memory.fp_filter(found, _stats_after_reset(spark, sf))
    return gate.quality_gate(reports.reports(tasks, kept, alone=True))
