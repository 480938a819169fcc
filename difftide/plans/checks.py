"""Check SQL: the same results from plain SQL on the given tables, for an independent engine.

Nothing here is used by the operators. Queries without an entry are covered by tests against plain
Python models instead.
"""

from __future__ import annotations

import re

from difftide.functions import markdown as md
from difftide.operators import bug_rules as bug
from difftide.operators import findings as fi
from difftide.operators import layer_rules as lay
from difftide.operators import prompts as pr_text
from difftide.operators import memory as mem
from difftide.plans.derived import WEBHOOK_SECRET, derived_sql

GATE_THRESHOLD = 140

# Fixed values, spelled out here and not taken from the operators: patterns, look-up tables, message texts.
EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
STRING_EQ = r'"[^"]*"\s*==\s*\w+|\w+\s*==\s*"[^"]*"'
SYSTEM_OUT = r"System\.(out|err)\s*\.\s*(print|println|printf)"
TODO = r"//\s*(TODO|FIXME|HACK|XXX)\b"
RESOURCE_OPEN = r"new\s+(FileInputStream|FileOutputStream|FileReader|FileWriter|BufferedReader|BufferedWriter)\s*\("
RETURN_VALUE = r"(?m)^[+\- ]?\s*return\s+([^;]+)\s*;\s*$"
VOID_METHOD = r"[+\- ]?(?:public|private|protected|static|\s)\s+void\s+\w+\s*\("
LAYERS = ["controller", "service", "repository", "model", "config", "tool", "agent", "orchestration"]
SEVERITY_OF_RULE = {
    "EMPTY_CATCH_BLOCK": "MAJOR", "RESOURCE_LEAK": "MAJOR", "RETURN_IN_VOID_METHOD": "MAJOR", "EmptyBlock": "MAJOR", "CYCLIC_DEPENDENCY": "MAJOR",
    "STRING_COMPARISON_USING_EQ": "MINOR", "PRINT_STACK_TRACE": "MINOR", "MagicNumber": "MINOR", "MethodLength": "MINOR", "ParameterNumber": "MINOR",
    "LAYER_VIOLATION": "CRITICAL",
}
AGENT_WORDS = {"architecture": "architecture", "code-style": "code style", "logic": "logic", "security": "security"}
FAILED_TITLE = {
    "architecture": "Architecture review failed", "code-style": "Code style review failed", "logic": "Logic review failed", "security": "Security review failed",
}

_CTE: dict[str, tuple[str, list[str]]] = {}


def _cte(name: str, sql: str, *uses: str) -> None:
    _CTE[name] = (sql.strip(), list(uses))


for _fx in [
    "fx_diffs", "fx_fetches", "fx_page_fetches", "fx_pr_webhooks", "fx_push_webhooks", "fx_comments",
    "fx_comment_payloads", "fx_findings", "fx_tasks", "fx_sources", "fx_responses", "fx_modules",
]:
    _cte(_fx, derived_sql(_fx, spark=False))


def _with(sql: str, *uses: str) -> str:
    """Put the needed common table expressions in front of a query."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _CTE[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    for name in uses:
        need(name)
    parts = ", ".join(f"{n} AS MATERIALIZED ({_CTE[n][0]})" for n in order)
    return f"WITH {parts} {sql.strip()}" if parts else sql.strip()


CHECKS: dict[str, str] = {}


def _check(name: str, sql: str, *uses: str) -> None:
    CHECKS[name] = _with(sql, *uses)


def _q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _str(path: str) -> str:
    return f"json_extract_string(j, '{path}')"


# -- webhooks --------------------------------------------------------------------------------
_cte("prj", "SELECT *, CASE WHEN json_valid(body) THEN body END::json AS j FROM fx_pr_webhooks", "fx_pr_webhooks")
_cte("pr", f"""
SELECT delivery_id, received_at, j IS NOT NULL AS ok, {_str('$.action')} AS action, coalesce(cast({_str('$.number')} AS int), 0) AS number,
 {_str('$.repository.full_name')} AS full_name, json_type(j, '$.pull_request') = 'OBJECT' AS has_pr,
 {_str('$.pull_request.title')} AS title, {_str('$.pull_request.body')} AS pr_body,
 coalesce(json_type(j, '$.pull_request.head') = 'OBJECT', false) AS has_head, {_str('$.pull_request.head.ref')} AS head_ref, {_str('$.pull_request.head.sha')} AS head_sha,
 {_str('$.pull_request.base.ref')} AS base_ref, {_str('$.pull_request.diff_url')} AS diff_url
FROM prj""", "prj")
_cte("pr_trigger", """
SELECT *, CASE action WHEN 'opened' THEN 'PR_OPENED' WHEN 'synchronize' THEN 'PR_SYNCHRONIZED' WHEN 'closed' THEN 'PR_CLOSED' END AS trigger_event FROM pr""", "pr")
_cte("pr_tasks", """
SELECT delivery_id AS task_id, full_name || '#' || number AS pr_id, full_name AS repo_name, number AS pr_number, coalesce(title, '') AS pr_title,
 coalesce(pr_body, '') AS pr_description, CASE WHEN has_head THEN head_ref ELSE '' END AS source_branch, base_ref AS target_branch,
 CASE WHEN has_head THEN head_sha ELSE '' END AS commit_sha, coalesce(diff_url, '') AS diff_url, trigger_event, received_at
FROM pr_trigger WHERE ok AND trigger_event IS NOT NULL AND coalesce(has_pr, false)""", "pr_trigger")
_cte("pushj", "SELECT *, CASE WHEN json_valid(body) THEN body END::json AS j FROM fx_push_webhooks", "fx_push_webhooks")
_cte("push", f"""
SELECT delivery_id, received_at, j IS NOT NULL AS ok, {_str('$.ref')} AS ref, {_str('$.before')} AS before, {_str('$.after')} AS after,
 {_str('$.repository.full_name')} AS full_name, coalesce(json_type(j, '$.head_commit') = 'OBJECT', false) AS has_head,
 {_str('$.head_commit.message')} AS head_message, cast(coalesce(json_array_length(j, '$.commits'), 0) AS int) AS commit_count
FROM pushj""", "pushj")
_cte("push_route", """
SELECT *, CASE WHEN after IS NULL OR regexp_full_match(after, '0+') THEN 'Delete event, skipping'
 WHEN regexp_full_match(before, '0+') THEN 'New branch event, skipping' WHEN starts_with(ref, 'refs/tags/') THEN 'Tag push event, skipping' END AS skip_reason FROM push WHERE ok""", "push")
_cte("push_branch", "SELECT *, regexp_replace(ref, '^refs/(heads|tags)/', '') AS branch FROM push_route WHERE skip_reason IS NULL", "push_route")
_cte("push_tasks", """
SELECT delivery_id AS task_id, full_name || '#push:' || after AS pr_id, full_name AS repo_name, cast(0 AS int) AS pr_number, 'Push: ' || branch AS pr_title,
 CASE WHEN has_head THEN head_message ELSE '' END AS pr_description, branch AS source_branch, '' AS target_branch, after AS commit_sha,
 'https://api.github.com/repos/' || full_name || '/compare/' || before || '...' || after AS diff_url, 'PUSH' AS trigger_event, received_at
FROM push_branch""", "push_branch")
_cte("all_tasks", "SELECT * FROM pr_tasks UNION ALL BY NAME SELECT * FROM push_tasks", "pr_tasks", "push_tasks")

_check("pr_webhook_parse", """
SELECT delivery_id, action, number, full_name, title, head_ref, head_sha, base_ref, diff_url, CASE WHEN NOT ok THEN 'Invalid payload' END AS parse_error FROM pr""", "pr")
_check("push_webhook_parse", """
SELECT delivery_id, ref, before, after, full_name, head_message, commit_count, CASE WHEN NOT ok THEN 'Invalid payload' END AS parse_error FROM push""", "push")
_check("trigger_map", "SELECT action, trigger_event, count(*) AS deliveries FROM pr_trigger GROUP BY ALL", "pr_trigger")
_check("pr_tasks", "SELECT * FROM pr_tasks", "pr_tasks")
_check("push_routing", "SELECT delivery_id, coalesce(skip_reason, 'review') AS route FROM push_route", "push_route")
_check("push_tasks", "SELECT * FROM push_tasks", "push_tasks")
_check("review_tasks", "SELECT * FROM all_tasks", "all_tasks")
_check("stream_tasks", "SELECT * FROM all_tasks", "all_tasks")
_check("webhook_dispositions", """
SELECT feed, cast(status AS int) AS status, message, count(*) AS deliveries FROM (
 SELECT 'pr' AS feed, CASE WHEN delivery_id % 7 IN (0, 3) THEN 401 WHEN NOT ok THEN 400 WHEN trigger_event IS NULL THEN 400 WHEN NOT coalesce(has_pr, false) THEN 500 ELSE 200 END AS status,
  CASE WHEN delivery_id % 7 IN (0, 3) THEN 'Signature mismatch' WHEN NOT ok THEN 'Invalid payload' WHEN trigger_event IS NULL THEN 'Unsupported action: ' || coalesce(action, 'null')
       WHEN NOT coalesce(has_pr, false) THEN 'Incomplete payload' ELSE 'Webhook processed successfully' END AS message FROM pr_trigger
 UNION ALL SELECT 'push', CASE WHEN delivery_id % 7 IN (0, 3) THEN 401 WHEN NOT ok THEN 400 ELSE 200 END,
  CASE WHEN delivery_id % 7 IN (0, 3) THEN 'Signature mismatch' WHEN NOT ok THEN 'Invalid payload' ELSE coalesce(r.skip_reason, 'Push webhook processed successfully') END
 FROM push LEFT JOIN (SELECT delivery_id, skip_reason FROM push_route) r USING (delivery_id)) GROUP BY ALL""", "pr_trigger", "push_route", "push")
_check("review_records", """
SELECT arg_max(task_id, (received_at, task_id)) AS id, pr_id, arg_max(repo_name, (received_at, task_id)) AS repo_name, arg_max(pr_number, (received_at, task_id)) AS pr_number,
 'PENDING' AS status, arg_max(trigger_event, (received_at, task_id)) AS trigger_event, min(received_at) AS created_at, max(received_at) AS updated_at
FROM all_tasks GROUP BY pr_id""", "all_tasks")
_key = WEBHOOK_SECRET.encode().ljust(64, b"\0")
_pads = ["".join(f"{b ^ x:02x}" for b in _key) for x in (0x36, 0x5C)]
_check("signature_valid", f"""
SELECT delivery_id, signature, coalesce(signature = 'sha256=' || digest, false) AS signature_valid FROM (
 SELECT *, CASE delivery_id % 7 WHEN 0 THEN NULL WHEN 1 THEN digest WHEN 2 THEN 'sha256=' || upper(digest) WHEN 3 THEN 'sha256=' || sha256(body) ELSE 'sha256=' || digest END AS signature
 FROM (SELECT delivery_id, body, sha256(unhex('{_pads[1]}') || unhex(sha256(unhex('{_pads[0]}') || encode(body)))) AS digest FROM fx_pr_webhooks))""", "fx_pr_webhooks")

# -- comments and feedback -------------------------------------------------------------------
_DIRECTIVE = r"^/feedback\s+(accept|dismiss)\s+(\S+)(?:\s+(\S+))?(?:\s+(\d+))?\s*$"


def _agent_case(rule: str) -> str:
    from difftide.functions.events import AGENT_WORDS

    whens = " ".join(f"WHEN regexp_matches(upper({rule}), '{'|'.join(w)}') THEN '{a}'" for a, w in AGENT_WORDS.items())
    return f"CASE {whens} ELSE 'unknown' END"


def _directives(source: str) -> str:
    return f"""
SELECT * EXCLUDE (m, body), CASE WHEN lower(m.verb) = 'accept' THEN 'ACCEPTED' ELSE 'DISMISSED' END AS feedback, m.rule AS rule_category,
 {_agent_case('m.rule')} AS agent_type, nullif(m.path, '') AS file_path, CASE WHEN m.line = '' THEN 0 ELSE try_cast(m.line AS int) END AS line_start
FROM (SELECT *, regexp_extract(trim(body), '{_DIRECTIVE}', ['verb', 'rule', 'path', 'line'], 'i') AS m FROM {source}
      WHERE regexp_matches(trim(body), '{_DIRECTIVE}', 'i')) WHERE m.line = '' OR try_cast(m.line AS int) IS NOT NULL"""


_cte("directives", _directives("fx_comments"), "fx_comments")
_cte("feedback", """
SELECT delivery_id AS id, repo_name || '#' || pr_number AS pr_id, file_path, line_start, rule_category, agent_type, feedback, received_at AS created_at FROM directives""", "directives")
_cte("commentj", "SELECT *, CASE WHEN json_valid(body) THEN body END::json AS j FROM fx_comment_payloads", "fx_comment_payloads")
_cte("comment", f"""
SELECT delivery_id, received_at, j IS NOT NULL AS ok, {_str('$.action')} AS action,
 CASE WHEN j IS NULL THEN NULL WHEN json_type(j, '$.repository') IS NULL THEN 'unknown' ELSE {_str('$.repository.full_name')} END AS repo_name,
 CASE WHEN j IS NULL THEN -1 ELSE coalesce(cast({_str('$.issue.number')} AS int), 0) END AS pr_number, {_str('$.comment.body')} AS body,
 delivery_id % 5 <> 0 AND NOT (delivery_id % 19 <> 0 AND delivery_id % 4 = 0) AS plain FROM commentj""", "commentj")
_check("comment_parse", "SELECT delivery_id, action, repo_name, pr_number, body, CASE WHEN NOT ok THEN 'Invalid payload' END AS parse_error FROM comment", "comment")
_check("comment_parse_strict", """
SELECT delivery_id, CASE WHEN plain THEN action END AS action, CASE WHEN plain THEN repo_name END AS repo_name, CASE WHEN plain THEN pr_number ELSE -1 END AS pr_number,
 CASE WHEN plain THEN body END AS body, CASE WHEN NOT ok OR NOT plain THEN 'Invalid payload' END AS parse_error FROM comment""", "comment")
_cte("payload_feedback", f"SELECT delivery_id AS id, repo_name || '#' || pr_number AS pr_id, file_path, line_start, rule_category, agent_type, feedback, received_at AS created_at FROM ({_directives('comment')})", "comment")
_check("feedback_records", "SELECT * FROM payload_feedback", "payload_feedback")
_check("feedback_directives", "SELECT delivery_id, feedback, rule_category, agent_type, file_path, line_start FROM directives", "directives")
_check("derive_agent", "SELECT rule_category, agent_type, count(*) AS comments FROM directives GROUP BY ALL", "directives")
_check("feedback_log", "SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM feedback", "feedback")

_COUNTERS = "count(*) AS total, count(*) FILTER (feedback = 'ACCEPTED') AS accepted, count(*) FILTER (feedback = 'DISMISSED') AS dismissed"


def _stats(source: str) -> str:
    return f"""
SELECT agent_type, rule_category, {_COUNTERS}, count(*) FILTER (feedback = 'DISMISSED')::double / count(*) AS dismiss_ratio,
 bool_or(feedback = 'DISMISSED' AND run_dismissed::double / run_total > 0.7) AS is_downgraded
FROM (SELECT *, count(*) OVER w AS run_total, count(*) FILTER (feedback = 'DISMISSED') OVER w AS run_dismissed FROM {source}
      WINDOW w AS (PARTITION BY agent_type, rule_category ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)) GROUP BY agent_type, rule_category"""


_cte("stats", _stats("feedback"), "feedback")
_cte("payload_stats", _stats("payload_feedback"), "payload_feedback")
_cte("resets", """
SELECT agent_type, rule_category, min(created_at) - INTERVAL 1 MICROSECOND AS reset_at FROM feedback
WHERE feedback = 'DISMISSED' AND rule_category IN ('XSS', 'LAYER_VIOLATION', 'CIRCULAR_DEPENDENCY') GROUP BY ALL""", "feedback")
_cte("kept_feedback", """
SELECT f.* FROM feedback f LEFT JOIN resets r USING (agent_type, rule_category) WHERE r.reset_at IS NULL OR f.created_at > r.reset_at""", "feedback", "resets")
_cte("reset_stats", _stats("kept_feedback"), "kept_feedback")
_check("rule_counters", f"SELECT agent_type, rule_category, {_COUNTERS} FROM feedback GROUP BY ALL", "feedback")
_check("rule_counters_incremental", f"SELECT agent_type, rule_category, {_COUNTERS} FROM feedback GROUP BY ALL", "feedback")
_check("rule_downgrade", "SELECT agent_type, rule_category, is_downgraded FROM stats", "stats")
_check("rule_stats", "SELECT * FROM stats ORDER BY agent_type, rule_category", "stats")
_check("stream_rule_stats", "SELECT * FROM payload_stats", "payload_stats")
_check("rule_stats_after_reset", "SELECT * FROM reset_stats", "reset_stats")
_check("rule_lookup", """
SELECT k.agent_type, k.rule_category, coalesce(total, 0) AS total, coalesce(is_downgraded, false) AS is_downgraded
FROM (SELECT DISTINCT agent_id AS agent_type, category AS rule_category FROM fx_findings WHERE category IS NOT NULL) k LEFT JOIN stats USING (agent_type, rule_category)""", "fx_findings", "stats")
_check("recent_feedback", """
SELECT *, cast(row_number() OVER (PARTITION BY file_path, line_start ORDER BY created_at DESC, id DESC) AS int) AS recency FROM feedback WHERE file_path IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file_path, line_start ORDER BY created_at DESC, id DESC) <= 50""", "feedback")
_check("memory_hints", """
SELECT agent_type, rule_category, 'CAUTION: Rule ''' || rule_category || ''' from agent ''' || agent_type || ''' has been downgraded (dismissed '
 || cast(floor(dismiss_ratio * 100 + 0.5) AS bigint) || '% of ' || total || ' times). Consider whether this rule applies before flagging it.' AS hint FROM stats WHERE is_downgraded""", "stats")
_cte("judged", """
SELECT f.*, CASE WHEN s.agent_type IS NULL THEN 'keep' WHEN s.dismissed > s.accepted THEN 'drop' ELSE 'soften' END AS verdict
FROM fx_findings f LEFT JOIN reset_stats s ON s.is_downgraded AND f.agent_id = s.agent_type AND f.category = s.rule_category""", "fx_findings", "reset_stats")
_cte("judged_normal", """
SELECT f.*, CASE WHEN s.agent_type IS NULL THEN 'keep' WHEN s.dismissed > s.accepted THEN 'drop' ELSE 'soften' END AS verdict
FROM fx_findings f LEFT JOIN reset_stats s ON s.is_downgraded AND replace(f.agent_id, '-', '') = s.agent_type AND f.category = s.rule_category""", "fx_findings", "reset_stats")
_SOFT = f"""
SELECT * EXCLUDE (verdict) REPLACE (
 CASE WHEN verdict = 'soften' THEN CASE severity WHEN 'CRITICAL' THEN 'MAJOR' WHEN 'MAJOR' THEN 'MINOR' ELSE 'INFO' END ELSE severity END AS severity,
 CASE WHEN verdict = 'soften' THEN coalesce(description, 'null') || {_q(mem.SOFTEN_SUFFIX)} ELSE description END AS description) FROM """
_check("fp_filter", _SOFT + "judged WHERE verdict <> 'drop'", "judged")
_check("fp_filter_normalized", _SOFT + "judged_normal WHERE verdict <> 'drop'", "judged_normal")
_check("fp_filter_stats", """
SELECT task_id, pr_id, count(*) AS rows_in, count(*) FILTER (verdict = 'drop') AS suppressed, count(*) FILTER (verdict = 'soften') AS downgraded,
 count(*) FILTER (verdict <> 'drop') AS rows_out FROM judged GROUP BY ALL""", "judged")

# -- reports ---------------------------------------------------------------------------------
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'MAJOR' THEN 1 WHEN 'MINOR' THEN 2 ELSE 3 END"
_cte("deduped", f"""
SELECT * EXCLUDE (rn) FROM (
 SELECT task_id, pr_id, seq, min(seq) OVER k AS first_seq, cast({_RANK} AS int) AS severity_rank, agent_id, severity, category, file_path, line_start, line_end, title, description, suggestion,
  row_number() OVER (PARTITION BY task_id, coalesce(file_path, ''), line_start, line_end, coalesce(category, '') ORDER BY {_RANK}, seq) AS rn
 FROM fx_findings WINDOW k AS (PARTITION BY task_id, coalesce(file_path, ''), line_start, line_end, coalesce(category, ''))) WHERE rn = 1""", "fx_findings")
_cte("ranked", """
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY severity_rank, file_path NULLS LAST, line_start, first_seq) AS rank FROM deduped""", "deduped")
_cte("counts", """
SELECT task_id, pr_id, cast(count(*) FILTER (severity = 'CRITICAL') AS int) AS critical_count, cast(count(*) FILTER (severity = 'MAJOR') AS int) AS major_count,
 cast(count(*) FILTER (severity = 'MINOR') AS int) AS minor_count, cast(count(*) FILTER (severity = 'INFO') AS int) AS info_count, count(*) AS total_count, count(DISTINCT file_path) AS file_count
FROM deduped GROUP BY ALL""", "deduped")
_cte("heads", """
SELECT *, CASE WHEN total_count = 0 THEN 'No issues found.' ELSE 'Found ' || critical_count || ' critical, ' || major_count || ' major, ' || minor_count || ' minor issues across '
 || file_count || CASE WHEN file_count = 1 THEN ' file.' ELSE ' files.' END END AS summary
FROM (SELECT t.task_id, t.pr_id, coalesce(critical_count, 0) AS critical_count, coalesce(major_count, 0) AS major_count, coalesce(minor_count, 0) AS minor_count,
 coalesce(info_count, 0) AS info_count, coalesce(total_count, 0) AS total_count, coalesce(file_count, 0) AS file_count FROM fx_tasks t LEFT JOIN counts c USING (task_id))""", "fx_tasks", "counts")
_cte("by_file", """
SELECT task_id, pr_id, cast(row_number() OVER (PARTITION BY task_id ORDER BY first_rank) AS int) AS file_order, file, findings,
 cast(coalesce(sum(findings) OVER (PARTITION BY task_id ORDER BY first_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS rows_before
FROM (SELECT task_id, pr_id, coalesce(file_path, '(unknown)') AS file, count(*) AS findings, min(rank) AS first_rank FROM ranked GROUP BY ALL)""", "ranked")
_cte("by_agent", """
SELECT task_id, pr_id, cast(row_number() OVER (PARTITION BY task_id ORDER BY first_rank) AS int) AS agent_order, agent, findings
FROM (SELECT task_id, pr_id, coalesce(agent_id, 'unknown') AS agent, count(*) AS findings, min(rank) AS first_rank FROM ranked GROUP BY ALL)""", "ranked")


def _esc(text: str) -> str:
    return rf"regexp_replace({text}, '([_*`])', '\\\1', 'g')"


def _nl(text: str) -> str:
    """SQL literal with newlines."""
    return " || chr(10) || ".join(_q(part) for part in text.split("\n"))


_BADGE = "CASE severity " + " ".join(f"WHEN '{n}' THEN '{m} {n}'" for n, m in md.SEVERITY_MARKS.items()) + " END"
_cte("md_rows", f"""
SELECT r.task_id, f.rows_before + row_number() OVER (PARTITION BY r.task_id, f.file ORDER BY r.rank) AS position,
 CASE WHEN row_number() OVER (PARTITION BY r.task_id, f.file ORDER BY r.rank) = 1 THEN '#### ' || {_esc('f.file')} || chr(10) || chr(10) || {_nl(md.FILE_TABLE_HEADER)} ELSE '' END
 || '| ' || CASE WHEN line_start <= 0 THEN '-' WHEN line_end > line_start THEN line_start || '-' || line_end ELSE line_start::varchar END || ' | ' || {_BADGE} || ' | '
 || {_esc("coalesce(category, '-')")} || ' | ' || {_esc("coalesce(trim(replace(description, chr(10), ' ')), '-')")} || ' |' || chr(10)
 || CASE WHEN row_number() OVER (PARTITION BY r.task_id, f.file ORDER BY r.rank) = f.findings THEN chr(10) ELSE '' END AS text
FROM ranked r JOIN by_file f ON r.task_id = f.task_id AND coalesce(r.file_path, '(unknown)') = f.file""", "ranked", "by_file")
_cte("md_head", f"""
SELECT task_id, pr_id, total_count, {_q(md.REPORT_TITLE)} || {_esc('pr_id')} || chr(10) || chr(10) || {_nl(md.COUNT_HEADER)}
 || {" || ".join(f"'| {m} {n.capitalize()} | ' || {n.lower()}_count || ' |' || chr(10)" for n, m in md.SEVERITY_MARKS.items())}
 || chr(10) || {_esc('summary')} || chr(10) || chr(10) || CASE WHEN total_count = 0 THEN {_nl(md.NO_FINDINGS)} ELSE {_nl(md.FILES_HEADER)} END AS head FROM heads""", "heads")
_cte("md_agents", f"""
SELECT task_id, {_nl(md.AGENTS_HEADER)} || string_agg('- **' || {_esc('agent')} || '**: ' || findings || CASE WHEN findings = 1 THEN ' finding' ELSE ' findings' END || chr(10), '' ORDER BY agent_order) AS agents
FROM by_agent GROUP BY task_id""", "by_agent")


def _markdown(part_rows: int) -> str:
    return f"""
SELECT h.task_id, h.pr_id, cast(coalesce(b.part, 0) AS int) AS part,
 CASE WHEN coalesce(b.part, 0) = 0 THEN h.head ELSE '' END || coalesce(b.body, '')
 || CASE WHEN coalesce(b.part, 0) = (greatest(h.total_count, 1) - 1) // {part_rows} THEN coalesce(a.agents, '') ELSE '' END AS markdown
FROM md_head h LEFT JOIN md_agents a USING (task_id)
LEFT JOIN (SELECT task_id, (position - 1) // {part_rows} AS part, string_agg(text, '' ORDER BY position) AS body FROM md_rows GROUP BY ALL) b USING (task_id)"""


_cte("report_pieces", """
SELECT task_id, pr_id, cast(0 AS bigint) AS position, 'head' AS kind, head AS text FROM md_head
UNION ALL SELECT r.task_id, h.pr_id, cast(r.position AS bigint), 'row', r.text FROM md_rows r JOIN md_head h USING (task_id)
UNION ALL SELECT a.task_id, h.pr_id, cast(h.total_count + 1 AS bigint), 'agents', a.agents FROM md_agents a JOIN md_head h USING (task_id)""", "md_head", "md_rows", "md_agents")
_cte("markdown", "SELECT task_id, pr_id, string_agg(text, '' ORDER BY position) AS markdown FROM report_pieces GROUP BY ALL", "report_pieces")
_check("dedup_findings", "SELECT * FROM deduped", "deduped")
_check("ranked_findings", "SELECT * FROM ranked", "ranked")
_check("report_counts", "SELECT * FROM counts", "counts")
_check("report_summary", "SELECT * FROM heads", "heads")
_check("findings_by_file", "SELECT * FROM by_file", "by_file")
_check("findings_by_agent", "SELECT * FROM by_agent", "by_agent")
_check("report_markdown", "SELECT * FROM report_pieces", "report_pieces")
_check("report_markdown_parts", _markdown(100), "md_head", "md_agents", "md_rows")
_check("summary_comments", """
SELECT t.task_id, m.pr_id, t.repo_name, t.pr_number, m.markdown AS body FROM fx_tasks t JOIN markdown m USING (task_id) WHERE t.trigger_event <> 'PUSH'""", "fx_tasks", "markdown")
_cte("located", """
SELECT d.*, t.commit_sha FROM deduped d JOIN fx_tasks t USING (task_id) WHERE t.commit_sha IS NOT NULL AND trim(d.file_path) <> '' AND d.line_start > 0""", "deduped", "fx_tasks")
_HEAD = "'**' || severity || '**' || coalesce(' [' || category || ']', '') || ': ' || title || chr(10) || chr(10)"
_check("line_comments", f"""
SELECT task_id, pr_id, commit_sha, file_path, line_start AS line, first_seq, {_HEAD} || CASE WHEN trim(coalesce(description, '')) <> '' THEN description || chr(10) || chr(10) ELSE '' END
 || CASE WHEN trim(coalesce(suggestion, '')) <> '' THEN '**Suggestion:** ' || suggestion ELSE '' END AS body FROM located""", "located")
_check("fallback_comments", f"""
SELECT task_id, pr_id, file_path, line_start AS line, first_seq, {_HEAD} || 'File: `' || file_path || ':' || line_start || '`' || chr(10) || chr(10) || coalesce(description, '') AS body
FROM located l WHERE EXISTS (SELECT 1 FROM fx_findings f WHERE f.line_start % 3 = 1 AND f.task_id = l.task_id AND f.file_path = l.file_path AND f.line_start = l.line_start)""", "located", "fx_findings")
_check("report_routing", "SELECT task_id, pr_id, trigger_event, CASE WHEN trigger_event = 'PUSH' THEN 'file' ELSE 'comments' END AS delivery FROM fx_tasks", "fx_tasks")
_GATE = f"CASE WHEN critical_count > 0 THEN 'FAIL' ELSE 'PASS' END AS gate, major_count > {GATE_THRESHOLD} AS warn"
_check("quality_gate", f"SELECT task_id, pr_id, critical_count, major_count, minor_count, {_GATE} FROM heads", "heads")
_check("gate_from_markdown", f"""
SELECT task_id, pr_id, critical_count::bigint AS critical_count, major_count::bigint AS major_count, minor_count::bigint AS minor_count, info_count::bigint AS info_count, {_GATE} FROM heads""", "heads")
_check("push_report_files", """
SELECT file_name, cast(length(markdown) AS int) AS chars, md5(markdown) AS markdown_md5 FROM (
 SELECT max(task_id) AS task_id, 'review-' || replace(repo_name, '/', '_') || '-' || strftime(received_at, '%Y%m%d-%H%M%S') || '.md' AS file_name FROM fx_tasks WHERE trigger_event = 'PUSH' GROUP BY 2) n
JOIN markdown USING (task_id)""", "fx_tasks", "markdown")
_check("push_report_names", """
SELECT task_id, pr_id, 'review-' || replace(repo_name, '/', '_') || '-' || strftime(received_at, '%Y%m%d-%H%M%S') || '.md' AS file_name FROM fx_tasks WHERE trigger_event = 'PUSH'""", "fx_tasks")
_check("review_results", """
SELECT task_id AS review_id, seq, agent_id AS agent_type, 'PENDING' AS status, title AS summary,
 cast(json_object('category', category, 'file_path', file_path, 'line_start', line_start, 'line_end', line_end, 'description', description, 'suggestion', suggestion) AS varchar) AS details, severity FROM deduped""", "deduped")
_check("merged_findings", f"""
SELECT task_id, pr_id, coalesce(file_path, '') AS file_path, line_start, line_end, coalesce(category, '') AS category, arg_min(severity, ({_RANK}, seq)) AS severity,
 arg_min(title, ({_RANK}, seq)) AS title, arg_min(agent_id, ({_RANK}, seq)) AS agent_id, count(*) AS reports, array_to_string(list_sort(list_distinct(list(agent_id))), ',') AS agents
FROM fx_findings GROUP BY task_id, pr_id, coalesce(file_path, ''), line_start, line_end, coalesce(category, '')""", "fx_findings")
_check("allowlist_filter", """
SELECT f.* FROM fx_findings f WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'XSS' ELSE 'FORMAT' END AS rule,
 CASE WHEN n_nationkey % 3 = 0 THEN 'src/m' || n_nationkey % 5 ELSE 'src/m1/F' || n_nationkey % 6 || '.java' END AS path FROM nation) a
 WHERE a.rule = f.category AND (f.file_path = a.path OR starts_with(f.file_path, a.path || '/')))""", "fx_findings")

# -- diffs -----------------------------------------------------------------------------------
_cte("cut", r"""
SELECT task_id, pr_id, unnest(string_split(replace(chr(10) || body, chr(10) || 'diff --git ', chr(1) || 'diff --git '), chr(1))) AS piece,
 generate_subscripts(string_split(replace(chr(10) || body, chr(10) || 'diff --git ', chr(1) || 'diff --git '), chr(1)), 1) AS n FROM fx_diffs""", "fx_diffs")
# Every piece but the last lost the newline in front of the next marker; the first gained one.
_cte("pieces", """
SELECT task_id, pr_id, n, CASE WHEN n = 1 THEN substr(piece, 2) ELSE piece END || CASE WHEN n < max(n) OVER (PARTITION BY task_id) AND NOT (n = 1 AND piece = '') THEN chr(10) ELSE '' END AS section FROM cut""", "cut")
_cte("sections", r"""
SELECT task_id, pr_id, cast(row_number() OVER (PARTITION BY task_id ORDER BY n) AS int) AS file_seq, section FROM pieces WHERE regexp_matches(section, '\S')""", "pieces")
_cte("files", r"""
SELECT task_id, pr_id, file_seq, file_path, CASE WHEN contains(section, 'new file mode') THEN 'ADDED' WHEN contains(section, 'deleted file mode') THEN 'DELETED' WHEN contains(section, 'rename from') THEN 'RENAMED' ELSE 'MODIFIED' END AS change_type,
 cast(len(list_filter(string_split(section, chr(10)), lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++'))) AS int) AS additions,
 cast(len(list_filter(string_split(section, chr(10)), lambda l: starts_with(l, '-') AND NOT starts_with(l, '---'))) AS int) AS deletions, section AS diff_content
FROM (SELECT *, trim(coalesce(nullif(regexp_extract(section, '(?m)^\+\+\+\s+b/(.*)$', 1), ''), nullif(regexp_extract(section, '(?m)^---\s+a/(.*)$', 1), ''), nullif(regexp_extract(section, '(?m)^diff --git a/(.*)\s+b/.*$', 1), ''))) AS file_path FROM sections)
WHERE file_path IS NOT NULL""", "sections")
_cte("lines", """
SELECT task_id, pr_id, file_seq, file_path, unnest(string_split(diff_content, chr(10))) AS line, generate_subscripts(string_split(diff_content, chr(10)), 1) AS n FROM files""", "files")
_HUNK = r"@@\s+-?(\d+)(?:,(\d+))?\s+\+?(\d+)(?:,(\d+))?\s+@@.*"
_cte("hunk_text", rf"""
SELECT *, regexp_full_match(line, '{_HUNK}') AS is_head, sum(CASE WHEN regexp_full_match(line, '{_HUNK}') THEN 1 ELSE 0 END) OVER (PARTITION BY task_id, file_seq ORDER BY n) AS h FROM lines""", "lines")
_NUM = lambda g: rf"coalesce(try_cast(nullif(regexp_extract(max(line) FILTER (is_head), '{_HUNK}', {g}), '') AS int), 1)"
_KEPT = r"NOT is_head AND regexp_matches(line, '^([+\- ]|\\ )')"
_cte("hunk_rows", rf"""
SELECT task_id, pr_id, file_seq, cast(row_number() OVER (PARTITION BY task_id, file_seq ORDER BY h) AS int) AS hunk_seq, file_path, old_start, new_start, old_lines, new_lines,
 '@@ -' || old_start || ',' || old_lines || ' +' || new_start || ',' || new_lines || ' @@' AS header, lines
FROM (SELECT task_id, pr_id, file_seq, file_path, h, {_NUM(1)} AS old_start, {_NUM(2)} AS old_lines, {_NUM(3)} AS new_start, {_NUM(4)} AS new_lines,
 string_agg(line, chr(10) ORDER BY n) FILTER ({_KEPT}) AS lines FROM hunk_text WHERE h > 0 GROUP BY task_id, pr_id, file_seq, file_path, h) WHERE lines IS NOT NULL""", "hunk_text")
_IMPORT = r"(?m)^[+-]?import\s+(?:static\s+)?([a-zA-Z0-9_.]+)\s*;\s*$"
_cte("imports", rf"""
SELECT task_id, pr_id, file_seq, file_path, imported FROM (SELECT *, row_number() OVER (PARTITION BY task_id, file_seq, imported ORDER BY n) AS r FROM (
 SELECT task_id, pr_id, file_seq, file_path, unnest(regexp_extract_all(diff_content, '{_IMPORT}', 1)) AS imported, generate_subscripts(regexp_extract_all(diff_content, '{_IMPORT}', 1), 1) AS n FROM files)) WHERE r = 1""", "files")
_cte("import_lists", rf"""
SELECT task_id, pr_id, file_seq, file_path, array_to_string(l, ',') AS imports FROM (
 SELECT *, list_filter(all_imports, lambda x, i: list_position(all_imports, x) = i) AS l FROM (
  SELECT task_id, pr_id, file_seq, file_path, regexp_extract_all(diff_content, '{_IMPORT}', 1) AS all_imports FROM files)) WHERE len(l) > 0""", "files")
_EXT = r"nullif(regexp_extract(file_path, '(\.[^.]*)$', 1), '')"
_cte("ext_text", f"""
SELECT task_id, string_agg(ext, ', ' ORDER BY file_seq) FILTER (first AND ext IS NOT NULL) AS exts FROM (
 SELECT task_id, file_seq, ext, row_number() OVER (PARTITION BY task_id, ext ORDER BY file_seq) = 1 AS first FROM (SELECT *, {_EXT} AS ext FROM files)) GROUP BY task_id""", "files")
_cte("graphs", """
SELECT d.task_id, d.pr_id, CASE WHEN e.task_id IS NULL THEN '' ELSE 'File extensions: ' || coalesce(e.exts, '') || chr(10) || coalesce(i.text, '') END AS dependency_graph
FROM fx_diffs d LEFT JOIN ext_text e USING (task_id) LEFT JOIN (
 SELECT task_id, 'Dependencies:' || chr(10) || string_agg('  ' || file_path || ' imports: ' || replace(imports, ',', ', ') || chr(10), '' ORDER BY file_seq) AS text FROM import_lists GROUP BY task_id) i USING (task_id)""", "fx_diffs", "ext_text", "import_lists")
_cte("file_text", """
SELECT task_id, cast(count(*) AS int) AS file_count, string_agg(file_path || ' ' || change_type, ',' ORDER BY file_seq) AS files,
 string_agg('- ' || file_path || ' (' || change_type || ') [+' || additions || ', -' || deletions || ']' || chr(10), '' ORDER BY file_seq) AS bullets FROM files GROUP BY task_id""", "files")
_cte("block_text", """
SELECT task_id, cast(count(*) AS int) AS hunk_count, string_agg(header, ',' ORDER BY file_seq, hunk_seq) AS headers,
 string_agg('### File: ' || file_path || chr(10) || '```' || chr(10) || header || chr(10) || lines || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY file_seq, hunk_seq) AS blocks FROM hunk_rows GROUP BY task_id""", "hunk_rows")
_check("diff_sections", "SELECT task_id, file_seq, cast(length(section) AS int) AS chars, md5(section) AS section_md5 FROM sections", "sections")
_check("changed_files", "SELECT * REPLACE (md5(diff_content) AS diff_content) FROM files", "files")
_check("hunks", "SELECT * FROM hunk_rows", "hunk_rows")
_check("hunk_lines", """
SELECT task_id, pr_id, file_seq, hunk_seq, file_path, cast(generate_subscripts(string_split(lines, chr(10)), 1) AS int) AS pos, unnest(string_split(lines, chr(10))) AS line FROM hunk_rows""", "hunk_rows")
_check("file_imports", "SELECT * FROM import_lists", "import_lists")
_check("dependency_edges", "SELECT * FROM imports", "imports")
_check("extension_counts", f"SELECT {_EXT} AS extension, count(*) AS files, cast(sum(additions) AS bigint) AS additions, cast(sum(deletions) AS bigint) AS deletions FROM files GROUP BY ALL", "files")
_check("dependency_graph", "SELECT * FROM graphs", "graphs")
_check("contexts", """
SELECT g.task_id, g.pr_id, coalesce(f.file_count, 0) AS file_count, coalesce(b.hunk_count, 0) AS hunk_count, coalesce(f.files, '') AS files, coalesce(b.headers, '') AS headers, g.dependency_graph, '' AS related_history
FROM graphs g LEFT JOIN file_text f USING (task_id) LEFT JOIN block_text b USING (task_id)""", "graphs", "file_text", "block_text")
_subjects = " UNION ALL ".join(
    f"SELECT '{a}' AS agent_id, '{s}' AS subject, md5({_q(pr_text.CHECKLIST[a] + pr_text.COMMON_RULE)}) AS system_md5" for a, s in pr_text.SUBJECT.items()
)
_check("review_prompts", f"""
SELECT task_id, agent_id, cast(length(prompt) AS int) AS chars, md5(prompt) AS prompt_md5, system_md5 FROM (
SELECT g.task_id, a.agent_id, a.system_md5, 'Review the following pull request for ' || a.subject || '.' || chr(10) || 'PR ID: ' || g.pr_id || chr(10) || chr(10)
 || CASE WHEN f.bullets IS NULL THEN {_nl(pr_text.NO_FILES)} ELSE '## Changed Files' || chr(10) || f.bullets || chr(10) END
 || CASE WHEN b.blocks IS NULL THEN '' ELSE '## Code Changes (Diff)' || chr(10) || b.blocks END
 || CASE WHEN trim(g.dependency_graph) = '' THEN '' WHEN a.agent_id = 'architecture' THEN '## Dependency Graph' || chr(10) || g.dependency_graph || chr(10) || chr(10)
    ELSE '## Dependency Context' || chr(10) || g.dependency_graph || chr(10) END AS prompt
FROM graphs g LEFT JOIN file_text f USING (task_id) LEFT JOIN block_text b USING (task_id), ({_subjects}) a)""", "graphs", "file_text", "block_text")
_cte("k", "SELECT *, sha256(lines) AS hunk_hash FROM hunk_rows", "hunk_rows")
_check("incremental_hunks", """
SELECT task_id, pr_id, file_seq, hunk_seq, file_path, header, hunk_hash FROM k
WHERE NOT EXISTS (SELECT 1 FROM k r WHERE r.hunk_seq = 1 AND r.pr_id = k.pr_id AND r.file_path = k.file_path AND r.hunk_hash = k.hunk_hash)""", "k")
_check("context_chunks", """
SELECT task_id, pr_id, file_seq, file_path, additions + deletions AS churn, cast(length(diff_content) AS int) AS chars, cast(row_number() OVER w AS int) AS position,
 cast(coalesce(sum(length(diff_content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 600 AS int) AS chunk
FROM files WINDOW w AS (PARTITION BY task_id ORDER BY additions + deletions DESC, file_seq)""", "files")
_cte("module_links", rf"""
SELECT DISTINCT a.task_id, a.file_seq AS importing, b.file_seq AS imported
FROM (SELECT task_id, file_seq, unnest([name, regexp_extract(name, '^(.+\..+)\.[^.]*$', 1)]) AS name
      FROM (SELECT task_id, file_seq, unnest(regexp_extract_all(diff_content, '{_IMPORT}', 1)) AS name FROM fx_modules)) a
JOIN (SELECT task_id, file_seq, array_to_string(parts[n:], '.') AS name
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT *, string_split(regexp_replace(file_path, '\.[^./]*$', ''), '/') AS parts FROM fx_modules))) b
  ON a.task_id = b.task_id AND a.name = b.name AND a.file_seq <> b.file_seq""", "fx_modules")
_cte("module_out", "SELECT *, count(*) OVER (PARTITION BY task_id, importing) AS outs FROM module_links", "module_links")
_cte("rank0", "SELECT task_id, file_seq, 0 AS importers, 1000000 AS importance FROM fx_modules", "fx_modules")
for _k in range(5):
    _cte(f"rank{_k + 1}", f"""
SELECT f.task_id, f.file_seq, count(l.imported) AS importers, cast(150000 + coalesce(sum(r.importance * 85 // (l.outs * 100)), 0) AS bigint) AS importance
FROM fx_modules f LEFT JOIN module_out l ON l.task_id = f.task_id AND l.imported = f.file_seq
LEFT JOIN rank{_k} r ON r.task_id = l.task_id AND r.file_seq = l.importing GROUP BY 1, 2""", "fx_modules", "module_out", f"rank{_k}")
_check("file_importance", """
SELECT f.task_id, f.pr_id, f.file_seq, f.file_path, r.importers, r.importance FROM fx_modules f JOIN rank5 r USING (task_id, file_seq)""", "fx_modules", "rank5")
_check("context_chunks_important", """
SELECT f.task_id, pr_id, f.file_seq, file_path, additions + deletions AS churn, r.importance, cast(length(diff_content) AS int) AS chars, cast(row_number() OVER w AS int) AS position,
 cast(coalesce(sum(length(diff_content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 600 AS int) AS chunk
FROM fx_modules f JOIN rank5 r USING (task_id, file_seq) WINDOW w AS (PARTITION BY f.task_id ORDER BY (additions + deletions) * r.importance DESC, f.file_seq)""", "fx_modules", "rank5")
_check("file_history_hints", """
SELECT f.task_id, f.pr_id, f.file_seq, f.file_path, 'File ''' || f.file_path || ''' has ' || p.records || ' past feedback record(s).' AS hint
FROM files f JOIN (SELECT replace(file_path, '.java', '0.java') AS file_path, count(*) AS records FROM feedback WHERE file_path IS NOT NULL GROUP BY 1) p USING (file_path)""", "files", "feedback")
_check("custom_agent", """
SELECT task_id, pr_id, cast(file_seq AS bigint) AS seq, 'size' AS agent_id, 'MINOR' AS severity, 'big-change' AS category, file_path, cast(1 AS int) AS line_start, additions + deletions AS line_end,
 'Big change' AS title, (additions + deletions) || ' changed lines' AS description, 'Split the change.' AS suggestion FROM files WHERE additions + deletions > 10""", "files")
_cte("reviews", """
SELECT f.*, task_id % 900 AS seconds, coalesce(h.critical_count > 0, false) AS blocked, coalesce(h.critical_count > 0, false) AND task_id % 3 = 0 AS false_block FROM (
 SELECT task_id, sum(additions + deletions) AS changed, sum(CASE WHEN change_type <> 'DELETED' THEN additions + deletions ELSE 0 END) AS reviewed FROM files GROUP BY task_id) f
LEFT JOIN (SELECT task_id, critical_count FROM heads) h USING (task_id)""", "files", "heads")
_check("review_kpis", """
SELECT r.* EXCLUDE (changed), f.*, cast(f.severe_findings * 1000 // r.changed AS bigint) AS severe_per_1000_lines, b.* FROM
 (SELECT count(*) AS reviews, cast(sum(reviewed) * 10000 // sum(changed) AS bigint) AS coverage_bp, cast(sum(seconds) // count(*) AS bigint) AS mean_response,
  cast(floor(quantile_cont(seconds, 0.99)) AS bigint) AS p99_response, cast(CASE WHEN bool_or(blocked) THEN count(*) FILTER (false_block) * 10000 // count(*) FILTER (blocked) ELSE 0 END AS bigint) AS false_block_bp, sum(changed) AS changed FROM reviews) r,
 (SELECT count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS severe_findings FROM fx_findings) f,
 (SELECT count(*) AS feedback_rows, cast(count(*) FILTER (feedback = 'DISMISSED') * 10000 // count(*) AS bigint) AS dismiss_bp, cast(count(*) FILTER (feedback = 'ACCEPTED') * 10000 // count(*) AS bigint) AS accept_bp FROM feedback) b""", "reviews", "fx_findings", "feedback")

# -- fetches ---------------------------------------------------------------------------------
_CLEAN = """CASE WHEN http_status = 200 AND NOT starts_with(trim(body, chr(10) || ' '), '<!DOCTYPE') AND NOT starts_with(trim(body, chr(10) || ' '), '<html') THEN body ELSE '' END"""
_cte("clean", f"""
SELECT t.task_id, t.pr_id, coalesce(CASE WHEN trim(t.diff_url) <> '' THEN {_CLEAN} END, '') AS body FROM pr_tasks t LEFT JOIN fx_fetches f USING (task_id)""", "pr_tasks", "fx_fetches")
_check("diff_fetch_clean", "SELECT task_id, pr_id, cast(length(body) AS int) AS chars, md5(body) AS body_md5 FROM clean", "clean")
_check("page_fetch_clean", f"SELECT task_id, cast(length(b) AS int) AS chars, md5(b) AS body_md5 FROM (SELECT task_id, {_CLEAN} AS b FROM fx_page_fetches)", "fx_page_fetches")

# -- rules -----------------------------------------------------------------------------------
_KEYS = "task_id, pr_id, file_seq, file_path"


def _line_rule(rule: str, where: str, text: str) -> str:
    return f"SELECT {_KEYS}, cast(n AS int) AS line_number, '{rule}' AS rule, {text} AS description FROM lines WHERE {where}"


def _pair(texts: tuple[str, ...], number: str = "n") -> str:
    return f"{_q(texts[0])} || {number} || {_q(texts[1])}"


_TRIM = "trim(line, ' ' || chr(9) || chr(13))"
_rule_sql: dict[str, tuple[str, list[str]]] = {}
_rule_sql["rule_string_eq"] = (_line_rule(
    "STRING_COMPARISON_USING_EQ", rf"""regexp_matches(line, {_q(STRING_EQ)}) AND NOT regexp_matches({_TRIM}, '^(//|\*|/\*)')""", _pair(bug.STRING_EQ_TEXT)), ["lines"])
_rule_sql["rule_print_stack"] = (_line_rule("PRINT_STACK_TRACE", "contains(line, '.printStackTrace()')", _q(bug.PRINT_STACK_TEXT)), ["lines"])
_rule_sql["rule_system_out"] = (_line_rule("SYSTEM_OUT_USAGE", f"regexp_matches(line, {_q(SYSTEM_OUT)})", _q(bug.SYSTEM_OUT_TEXT)), ["lines"])
_rule_sql["rule_todo"] = (_line_rule("TODO_COMMENT", f"regexp_matches(line, {_q(TODO)})", f"regexp_extract(line, {_q(TODO)}, 1) || {_pair(bug.TODO_TEXT)}"), ["lines"])
_PARAMS = r"(?:\w+)\s+(?:\w+)"
_rule_sql["rule_param_count"] = (rf"""
SELECT {_KEYS}, cast(n AS int) AS line_number, 'ParameterNumber' AS rule, 'Method at line ' || n || ' has ' || c || ' parameters (max allowed: 5). Consider refactoring.' AS description
FROM (SELECT *, len(string_split(regexp_extract(line, '\((.*)\)', 1), ',')) AS c FROM lines WHERE regexp_matches(line, '\bpublic\s+\w+\s+\w+\s*\([^)]*\)')) WHERE c > 5""", ["lines"])
_MAGIC = r"[\s(=,](\d{2,}|\d+\.\d+)\s*(?:[^\s.\w]|$)"
_rule_sql["rule_magic_number"] = (rf"""
SELECT {_KEYS}, cast(n AS int) AS line_number, 'MagicNumber' AS rule, 'Magic number ''' || number || ''' at line ' || n || '. Define as a named constant instead.' AS description
FROM (SELECT *, regexp_extract(line, '{_MAGIC}', 1) AS number FROM lines WHERE NOT regexp_matches({_TRIM}, '^(//|\*|/\*|package|import|@)'))
WHERE number NOT IN ('', '0', '1', '-1', '0.0', '1.0', '-1.0') AND NOT list_contains(regexp_extract_all(line, 'new\s+\w+\s*\[(\d+(?:\.\d+)?)\]', 1), number)""", ["lines"])
_rule_sql["rule_indentation"] = (rf"""
SELECT {_KEYS}, cast(n AS int) AS line_number, 'Indentation' AS rule, 'Inconsistent indentation at line ' || n || ': mixed tabs and spaces. Use consistent indentation style.' AS description
FROM (SELECT {_KEYS}, min(n) AS n FROM lines WHERE regexp_matches(line, '^(\t+\s| +\t)') AND regexp_matches(line, '\S') GROUP BY ALL)""", ["lines"])


def _matches(pattern: str) -> str:
    """Rows (keys, m = match, prefix = text in front, diff_content) of every match."""
    p = _q(pattern)
    return f"""
SELECT {_KEYS}, diff_content, i, hits[i] AS m, array_to_string(list_transform(range(1, i + 1), lambda k: gaps[k] || CASE WHEN k < i THEN hits[k] ELSE '' END), '') AS prefix
FROM (SELECT {_KEYS}, diff_content, hits, string_split_regex(diff_content, {p}) AS gaps, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT *, regexp_extract_all(diff_content, {p}) AS hits FROM files) WHERE len(hits) > 0)"""


def _newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


_rule_sql["rule_empty_catch"] = (f"SELECT {_KEYS}, cast({_newlines('prefix')} AS int) AS line_number, 'EMPTY_CATCH_BLOCK' AS rule, {_q(bug.EMPTY_CATCH_TEXT)} AS description FROM ({_matches(EMPTY_CATCH)})", ["files"])
_rule_sql["rule_empty_catch_repeated"] = (f"""
SELECT {_KEYS}, cast({_newlines('prefix')} AS int) AS line_number, 'EMPTY_CATCH_BLOCK' AS rule, {_q(bug.EMPTY_CATCH_TEXT)} AS description
FROM (SELECT *, unnest(range(0, {_newlines('diff_content')} + 1 - {_newlines('prefix || m')})) AS copy FROM ({_matches(EMPTY_CATCH)}))""", ["files"])
_rule_sql["rule_resource_leak"] = (rf"""
SELECT {_KEYS}, cast(line AS int) AS line_number, 'RESOURCE_LEAK' AS rule, {_pair(bug.RESOURCE_TEXT, 'line')} AS description
FROM (SELECT *, {_newlines('prefix')} + 1 AS line, right(prefix, 200) AS w FROM ({_matches(RESOURCE_OPEN)}))
WHERE NOT (contains(w, 'try') AND regexp_full_match(string_split(w, 'try')[-1], '\s*\([^)]*'))""", ["files"])
_RETURN = RETURN_VALUE
_rule_sql["rule_void_return"] = (rf"""
SELECT {_KEYS}, cast(line AS int) AS line_number, 'RETURN_IN_VOID_METHOD' AS rule, {_q(bug.VOID_TEXT[0])} || line || {_q(bug.VOID_TEXT[1])}
 || CASE WHEN length(value) > 60 THEN substr(value, 1, 57) || '...' ELSE value END || {_q(bug.VOID_TEXT[2])} AS description
FROM (SELECT *, {_newlines('prefix')} + 1 AS line, trim(regexp_extract(m, '{_RETURN}', 1)) AS value, string_split_regex(prefix, {_q(VOID_METHOD)}) AS parts FROM ({_matches(_RETURN)}))
WHERE len(parts) > 1 AND length(replace(parts[-1], '}}', '')) > length(replace(parts[-1], '{{', ''))""", ["files"])
_rule_sql["rule_empty_block"] = (" UNION ALL ".join(f"""
SELECT {_KEYS}, cast(line AS int) AS line_number, 'EmptyBlock' AS rule, 'Empty {word} block at line ' || line || '. Either implement the body or remove the block.' AS description
FROM (SELECT *, {_newlines('prefix')} + 1 AS line FROM ({_matches(p)}))""" for word, p in [("if", r"if\s*\([^)]*\)\s*\{\s*\}"), ("else", r"else\s*\{\s*\}")]), ["files"])

# Method names as shown by two style rules, for a trimmed line `t`.
_NAME = r"""coalesce(list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN contains(ws[i], '(') THEN CASE WHEN NOT starts_with(ws[i], '(') THEN split_part(ws[i], '(', 1) WHEN i > 1 THEN ws[i - 1] END END), lambda x: x IS NOT NULL)[1], '')"""
_rule_sql["rule_method_length"] = (rf"""
SELECT {_KEYS}, cast(start + 1 AS int) AS line_number, 'MethodLength' AS rule, 'Method ''' || {_NAME} || ''' at line ' || (start + 1) || ' is ' || length || ' lines long (max allowed: 50).' AS description
FROM (SELECT {_KEYS}, f.start, f.length, string_split_regex(trim(replace(ls[f.start + 1], '{{', ''), ' ' || chr(9)), '\s+') AS ws FROM (
 SELECT {_KEYS}, ls, unnest(list_reduce(ls, lambda acc, l: {{
  'at': acc.at + 1,
  'start': CASE WHEN acc.start < 0 AND NOT regexp_matches(trim(l, ' ' || chr(9)), '^(if|while|for|switch|catch|synchronized)\b') AND regexp_full_match(trim(l, ' ' || chr(9)), '\w+.*\(.*\).*\{{')
     THEN CASE WHEN length(replace(l, '}}', '')) <= length(replace(l, '{{', '')) THEN -1 ELSE acc.at END
     WHEN acc.start >= 0 AND acc.depth + length(replace(l, '}}', '')) - length(replace(l, '{{', '')) <= 0 THEN -1 ELSE acc.start END,
  'depth': CASE WHEN acc.start < 0 AND NOT regexp_matches(trim(l, ' ' || chr(9)), '^(if|while|for|switch|catch|synchronized)\b') AND regexp_full_match(trim(l, ' ' || chr(9)), '\w+.*\(.*\).*\{{')
     THEN 0 ELSE acc.depth END + length(replace(l, '}}', '')) - length(replace(l, '{{', '')),
  'found': CASE WHEN acc.start >= 0 AND acc.depth + length(replace(l, '}}', '')) - length(replace(l, '{{', '')) <= 0 AND acc.at - acc.start > 50
     THEN list_append(acc.found, {{'start': acc.start, 'length': acc.at - acc.start}}) ELSE acc.found END
 }}, {{'at': 0::bigint, 'start': -1::bigint, 'depth': 0::bigint, 'found': []::struct("start" bigint, "length" bigint)[]}}).found) AS f
 FROM (SELECT {_KEYS}, string_split(diff_content, chr(10)) AS ls FROM files)))""".replace("{{", "{").replace("}}", "}"), ["files"])
_PUBLIC = r"public\s+\w+\s+\w+\s*\("
_rule_sql["rule_javadoc"] = (rf"""
SELECT {_KEYS}, cast(ln AS int) AS line_number, 'JavadocStyle' AS rule, 'Public method ''' || {_NAME} || ''' at line ' || ln || ' is missing Javadoc comment.' AS description
FROM (SELECT {_KEYS}, ln, string_split_regex(trim(replace(ts[ln], '{{', '')), '\s+') AS ws,
  list_filter(list_reverse(ts[greatest(ln - 5, 1):ln - 1]), lambda p: regexp_matches(p, '^(/\*\*|public|private|protected|class|interface|@interface|enum)'))[1] AS stop
 FROM (SELECT {_KEYS}, ts, unnest(list_reduce(ts, lambda acc, t: {{
   'at': acc.at + 1,
   'inside': starts_with(t, '/**') OR (acc.inside AND NOT contains(t, '*/')),
   'found': CASE WHEN NOT starts_with(t, '/**') AND NOT acc.inside AND regexp_matches(t, '{_PUBLIC}') AND NOT regexp_matches(t, '^(//|\*|@Override|package|import|\{{)')
      THEN list_append(acc.found, acc.at) ELSE acc.found END
  }}, {{'at': 1::bigint, 'inside': false, 'found': []::bigint[]}}).found) AS ln
  FROM (SELECT {_KEYS}, list_transform(string_split(diff_content, chr(10)), lambda l: trim(l, ' ' || chr(9))) AS ts FROM files)))
WHERE NOT coalesce(starts_with(stop, '/**'), false)""".replace("{{", "{").replace("}}", "}"), ["files"])
for _name, (_sql, _uses) in _rule_sql.items():
    _check(_name, _sql, *_uses)

_SRC_PKG = "regexp_extract(content, '(?m)^package\\s+([a-zA-Z0-9_.]+);\\s*$', 1)"
_LAYER = lambda p: f"list_filter(string_split({p}, '.'), lambda s: s IN ({', '.join(_q(x) for x in LAYERS)}))[1]"
_BASE = lambda p: f"array_to_string(string_split({p}, '.')[1:3], '.')"
_cte("src", f"SELECT task_id, pr_id, cast(file_seq AS int) AS file_seq, file_path, content, {_SRC_PKG} AS package FROM fx_sources", "fx_sources")
_cte("edges", r"""
SELECT DISTINCT task_id, pr_id, file_seq, file_path, package, regexp_extract(name, '^(.+)\.[^.]*$', 1) AS imported FROM (
 SELECT *, unnest(regexp_extract_all(content, '(?m)^import\s+([a-zA-Z0-9_.]+);\s*$', 1)) AS name FROM src) WHERE package <> '' AND contains(name, '.')""", "src")
_cte("controllers", r"""
SELECT *, regexp_matches(content, '@(Controller|RestController)\b') AS is_controller,
 regexp_matches(content, '@Autowired\s+(private\s+)?\w*Repository\s+\w+') OR regexp_matches(content, '@Autowired\s+\w+\s*\([^)]*\w*Repository\s+\w+') AS injects,
 len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, 'Repository\.\w+\s*\('))) > 0 AS calls FROM src""", "src")


def _layer_hits(rule: str, text: str, source: str) -> str:
    return f"SELECT {_KEYS}, cast(0 AS int) AS line_number, '{rule}' AS rule, {text} AS description FROM {source}"


_check("package_edges", "SELECT task_id, file_path, package, imported FROM edges", "edges")
_check("package_layers", f"SELECT package, count(*) AS sources, {_LAYER('package')} AS layer FROM src WHERE package <> '' GROUP BY package", "src")
_layer_sql = {
    "rule_layer_injection": (_layer_hits("LAYER_VIOLATION", _q(lay.INJECTION_TEXT), "controllers WHERE is_controller AND injects"), ["controllers"]),
    "rule_layer_call": (_layer_hits("LAYER_VIOLATION", _q(lay.CALL_TEXT), "controllers WHERE is_controller AND calls AND NOT injects"), ["controllers"]),
    "rule_layer_import": (f"""
SELECT e.task_id, e.pr_id, e.file_seq, e.file_path, cast(0 AS int) AS line_number, 'LAYER_VIOLATION' AS rule, 'Controller package ''' || e.package || ''' imports from repository package ''' || min(imported)
 || '''. Controllers should only depend on Service layer.' AS description FROM edges e JOIN controllers c USING (task_id)
WHERE contains(e.package, '.controller') AND contains(imported, '.repository.') AND NOT (is_controller AND (injects OR calls)) GROUP BY e.task_id, e.pr_id, e.file_seq, e.file_path, e.package""", ["edges", "controllers"]),
    "rule_repo_controller": (_layer_hits("CYCLIC_DEPENDENCY", "'Repository package ''' || package || ''' imports from controller package ''' || imported || '''. Repositories should not depend on controller layer.'",
        f"edges WHERE contains(package, '.repository') AND NOT contains(package, '.controller') AND {_LAYER('imported')} = 'controller'"), ["edges"]),
    "rule_same_layer": (_layer_hits("SAME_LAYER_COUPLING", "'Same-layer coupling detected between packages ''' || package || ''' and ''' || imported || '''. Cross-dependency within same layer may indicate tight coupling.'",
        f"edges WHERE imported <> package AND {_BASE('imported')} = {_BASE('package')} AND {_LAYER('imported')} = {_LAYER('package')}"), ["edges"]),
}
for _name, (_sql, _uses) in _layer_sql.items():
    _check(_name, _sql, *_uses)
_cte("identified", """
SELECT *, cast(row_number() OVER (PARTITION BY task_id, file_path, hunk_hash ORDER BY file_seq, hunk_seq) AS int) AS occurrence FROM (
 SELECT task_id, pr_id, file_seq, hunk_seq, file_path, header, sha256(array_to_string(list_transform(
  list_filter(string_split(lines, chr(10)), lambda l: starts_with(l, '+') OR starts_with(l, '-')), lambda l: length(l) || ':' || l), '')) AS hunk_hash FROM hunk_rows)""", "hunk_rows")
_check("hunk_ledger", """
SELECT i.* FROM identified i JOIN (SELECT pr_id, file_path, hunk_hash, occurrence, min(task_id) AS task_id FROM identified GROUP BY ALL) f
USING (task_id, pr_id, file_path, hunk_hash, occurrence)""", "identified")
_check("scan_cached", f"{_rule_sql['rule_system_out'][0]} UNION ALL {_rule_sql['rule_todo'][0]}", "lines")
_check("scan_distinct", f"{_rule_sql['rule_system_out'][0]} UNION ALL {_rule_sql['rule_todo'][0]}", "lines")

# -- agents ----------------------------------------------------------------------------------
_AGENT_NO = "CASE agent_id WHEN 'architecture' THEN 0 WHEN 'code-style' THEN 1 WHEN 'logic' THEN 2 WHEN 'security' THEN 3 ELSE 4 END"
_cte("answers", """
SELECT task_id, pr_id, agent_id, error, error IS NOT NULL OR NOT json_valid(response) OR contains(response, '"HUGE"') AS failed,
 CASE WHEN json_valid(response) THEN coalesce(from_json(json_extract(response, '$.results'), '[{"severity":"VARCHAR","category":"VARCHAR","filePath":"VARCHAR","lineStart":"INTEGER","lineEnd":"INTEGER","title":"VARCHAR","description":"VARCHAR","suggestion":"VARCHAR"}]'), []) ELSE [] END AS results
FROM fx_responses""", "fx_responses")
_cte("model_rows", f"""
SELECT task_id, pr_id, cast({_AGENT_NO} AS int) AS seq_agent, cast(i - 1 AS bigint) AS seq_place, agent_id, r.severity AS severity, r.category AS category, r.filePath AS file_path, r.lineStart AS line_start, r.lineEnd AS line_end,
 r.title AS title, r.description AS description, r.suggestion AS suggestion
FROM (SELECT *, unnest(results) AS r, generate_subscripts(results, 1) AS i FROM answers WHERE NOT failed)""", "answers")
_cte("valid", "SELECT m.* FROM model_rows m WHERE trim(file_path) <> '' AND task_id IN (SELECT task_id FROM files)", "model_rows", "files")
_cte("valid_strict", """
SELECT m.* FROM model_rows m WHERE trim(file_path) <> '' AND EXISTS (SELECT 1 FROM files f WHERE f.task_id = m.task_id AND contains(f.file_path, replace(m.file_path, chr(92), '/')))""", "model_rows", "files")
_SENT = f"""SELECT task_id, pr_id, cast({_AGENT_NO} AS int) AS seq_agent, cast(0 AS bigint) AS seq_place, agent_id, 'INFO' AS severity, agent_id || '-review' AS category, '' AS file_path, cast(0 AS int) AS line_start, cast(0 AS int) AS line_end, """
_case = lambda values: "CASE agent_id " + " ".join(f"WHEN {_q(a)} THEN {_q(v)}" for a, v in values.items()) + " END"
_cte("no_issue", f"""{_SENT} 'No ' || {_case(AGENT_WORDS)} || ' issues found' AS title, {_case(fi.NO_ISSUE_TEXT)} AS description, '' AS suggestion
FROM answers a WHERE NOT failed AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.task_id = a.task_id AND v.agent_id = a.agent_id)""", "answers", "valid")
_cte("failures", f"""{_SENT} {_case(FAILED_TITLE)} AS title, 'Unable to complete ' || {_case(AGENT_WORDS)} || ' review due to an internal error: ' || coalesce(error, 'unreadable response') AS description, '' AS suggestion
FROM answers WHERE failed""", "answers")
_check("agent_response_parse", "SELECT * FROM model_rows", "model_rows")
_check("valid_findings", "SELECT * FROM valid", "valid")
_check("valid_findings_strict", "SELECT * FROM valid_strict", "valid_strict")
_check("no_issue_rows", "SELECT * FROM no_issue", "no_issue")
_check("agent_failures", "SELECT * FROM failures", "failures")

# Tool findings: all rule hits in reporting order, as the findings of the agents that own the rules.
_SEVERITY = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in SEVERITY_OF_RULE.items()) + " ELSE 'INFO' END"
_TOOL_ORDER = [
    ("security", ["rule_empty_catch", "rule_string_eq", "rule_print_stack", "rule_system_out", "rule_todo", "rule_resource_leak", "rule_void_return"]),
    ("code-style", ["rule_javadoc", "rule_method_length", "rule_param_count", "rule_magic_number", "rule_empty_block", "rule_indentation"]),
]
_hit_parts = []
for _agent, _names in _TOOL_ORDER:
    for _name in _names:
        _hit_parts.append(f"SELECT *, '{_agent}' AS agent_id FROM ({_rule_sql[_name][0]})")
_cte("tool_hits", " UNION ALL ".join(_hit_parts), "files", "lines")
_cte("tool_rows", f"""
SELECT task_id, pr_id, agent_id, {_SEVERITY} AS severity, 'static-analysis' AS category, file_path, line_number AS line_start, line_number AS line_end, rule AS title, description,
 {_case(fi.SUGGESTION_OF_AGENT)} AS suggestion FROM tool_hits""", "tool_hits")
_check("tool_findings", "SELECT * FROM tool_rows", "tool_rows")
_check("all_findings", """
SELECT * FROM (SELECT * EXCLUDE (seq_agent, seq_place) FROM valid UNION ALL SELECT * EXCLUDE (seq_agent, seq_place) FROM no_issue UNION ALL SELECT * EXCLUDE (seq_agent, seq_place) FROM failures
 UNION ALL BY NAME SELECT t.* FROM tool_rows t WHERE NOT EXISTS (SELECT 1 FROM failures f WHERE f.task_id = t.task_id AND f.agent_id = t.agent_id))""", "valid", "no_issue", "failures", "tool_rows")


_cte("custom_rows", f"""
SELECT task_id, pr_id, 'size' AS agent_id, 'MINOR' AS severity, 'big-change' AS category, file_path, cast(1 AS int) AS line_start, additions + deletions AS line_end,
 'Big change' AS title, (additions + deletions) || ' changed lines' AS description, 'Split the change.' AS suggestion FROM files WHERE additions + deletions > 10""", "files")
_check("all_findings_custom", """
SELECT * FROM (SELECT * EXCLUDE (seq_agent, seq_place) FROM valid UNION ALL SELECT * EXCLUDE (seq_agent, seq_place) FROM no_issue UNION ALL SELECT * EXCLUDE (seq_agent, seq_place) FROM failures
 UNION ALL BY NAME SELECT t.* FROM tool_rows t WHERE NOT EXISTS (SELECT 1 FROM failures f WHERE f.task_id = t.task_id AND f.agent_id = t.agent_id)
 UNION ALL BY NAME SELECT * FROM custom_rows)
WHERE NOT coalesce((category = 'big-change' AND starts_with(file_path || '/', 'src/m1/')) OR (category = 'static-analysis' AND starts_with(file_path || '/', 'src/m2/')), false)""",
 "valid", "no_issue", "failures", "tool_rows", "custom_rows")


def _variant(name: str, suffix: str, renamed: dict[str, str]) -> None:
    """Copy of a common table expression that reads other tables."""
    sql, uses = _CTE[name]
    for old, new in renamed.items():
        sql = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", sql)
    _cte(name + suffix, sql, *[renamed.get(u, u) for u in uses])


# The same rules on plain sources.
_cte("files_s", "SELECT task_id, pr_id, cast(file_seq AS int) AS file_seq, file_path, content AS diff_content FROM fx_sources", "fx_sources")
for _name in ["lines", "tool_hits", "tool_rows"]:
    _variant(_name, "_s", {"files": "files_s", "lines": "lines_s", "tool_hits": "tool_hits_s"})
_layer_union = " UNION ALL ".join(f"SELECT *, 'architecture' AS agent_id FROM ({q})" for q, _ in _layer_sql.values())
_cte("layer_hits", _layer_union, "controllers", "edges")
_variant("tool_rows", "_layers", {"tool_hits": "layer_hits"})
_check("source_tool_findings", "SELECT * FROM tool_rows_s UNION ALL BY NAME SELECT * FROM tool_rows_layers", "tool_rows_s", "tool_rows_layers")

# The whole review: tasks and fetch log to gate verdicts.
_cte("task_responses", "SELECT r.* FROM fx_responses r WHERE task_id IN (SELECT task_id FROM pr_tasks)", "fx_responses", "pr_tasks")
_chain = ["cut", "pieces", "sections", "files", "lines", "answers", "model_rows", "valid", "no_issue", "failures", "tool_hits", "tool_rows"]
_renamed = {**{n: n + "_e" for n in _chain}, "fx_diffs": "clean", "fx_responses": "task_responses"}
for _name in _chain:
    _variant(_name, "_e", _renamed)
_cte("found_e", """
SELECT * FROM (SELECT * EXCLUDE (seq_agent, seq_place) FROM valid_e UNION ALL SELECT * EXCLUDE (seq_agent, seq_place) FROM no_issue_e UNION ALL SELECT * EXCLUDE (seq_agent, seq_place) FROM failures_e
 UNION ALL BY NAME SELECT t.* FROM tool_rows_e t WHERE NOT EXISTS (SELECT 1 FROM failures_e f WHERE f.task_id = t.task_id AND f.agent_id = t.agent_id))""", "valid_e", "no_issue_e", "failures_e", "tool_rows_e")
_variant("judged", "_e", {"fx_findings": "found_e"})
_cte("filtered_e", _SOFT + "judged_e WHERE verdict <> 'drop'", "judged_e")
_cte("counts_e", f"""
SELECT task_id, cast(count(*) FILTER (r = 0) AS int) AS critical_count, cast(count(*) FILTER (r = 1) AS int) AS major_count, cast(count(*) FILTER (r = 2) AS int) AS minor_count
FROM (SELECT task_id, min({_RANK}) AS r FROM filtered_e GROUP BY task_id, coalesce(file_path, ''), line_start, line_end, coalesce(category, '')) GROUP BY task_id""", "filtered_e")
_check("review_end_to_end", f"""
SELECT *, {_GATE} FROM (SELECT t.task_id, t.pr_id, coalesce(critical_count, 0) AS critical_count, coalesce(major_count, 0) AS major_count, coalesce(minor_count, 0) AS minor_count
 FROM pr_tasks t LEFT JOIN counts_e USING (task_id))""".replace("> 140", "> 10"), "pr_tasks", "counts_e")
_check("similar_vectors", """
SELECT query_id, cast(rank AS int) AS rank, vec_id, round(cosine, 6) AS cosine FROM (
 SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY cosine DESC, c.vec_id) AS rank
 FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id) WHERE rank <= 5""")

# Streams: the filter with the statistics of the comment stream, and the reports of what it keeps.
_variant("judged", "_p", {"reset_stats": "payload_stats"})
_cte("kept_p", _SOFT + "judged_p WHERE verdict <> 'drop'", "judged_p")
_check("stream_reviewed", "SELECT * FROM kept_p", "kept_p")
_streamed = {"fx_findings": "kept_p"}
for _name in ["deduped", "ranked", "counts", "heads", "by_file", "by_agent", "md_rows", "md_head", "md_agents", "report_pieces"]:
    _variant(_name, "_p", _streamed)
    _streamed[_name] = f"{_name}_p"
_check("stream_reports", """
SELECT p.task_id, p.position, p.kind, CASE WHEN t.trigger_event = 'PUSH' THEN 'file' ELSE 'comments' END AS delivery, md5(p.text) AS text_md5
FROM report_pieces_p p JOIN fx_tasks t USING (task_id)""", "report_pieces_p", "fx_tasks")

# One flow from event to report: the tasks are those of the webhooks. A third of the events comes twice in the other query.
_flow = {"fx_tasks": "all_tasks"} | {old: new for old, new in _streamed.items() if old not in ("heads", "md_head", "report_pieces")}
for _name in ["heads", "md_head", "report_pieces"]:
    _variant(_name, "_w", _flow)
    _flow[_name] = f"{_name}_w"
_check("review_flow", """
SELECT p.task_id, p.position, p.kind, CASE WHEN t.trigger_event = 'PUSH' THEN 'file' ELSE 'comments' END AS delivery, md5(p.text) AS text_md5
FROM report_pieces_w p JOIN all_tasks t USING (task_id)""", "report_pieces_w", "all_tasks")
_check("stream_tasks_once", "SELECT task_id, pr_id, repo_name, commit_sha, trigger_event FROM all_tasks", "all_tasks")
