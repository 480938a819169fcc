"""Explicit schemas of the tables and payloads (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


S, I, L, B, D, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType(),
)

# -- payloads -------------------------------------------------------------------------------
GIT_REF = _struct(ref=S, sha=S)
PR_PAYLOAD = _struct(
    action=S,
    number=S,
    pull_request=_struct(title=S, body=S, head=GIT_REF, base=GIT_REF, diff_url=S),
    repository=_struct(full_name=S),
)
COMMIT = _struct(id=S, message=S, url=S)
PUSH_PAYLOAD = _struct(
    ref=S,
    before=S,
    after=S,
    repository=_struct(full_name=S),
    pusher=_struct(name=S, email=S),
    head_commit=COMMIT,
    commits=T.ArrayType(COMMIT),
)
COMMENT_PAYLOAD = _struct(
    action=S, issue=_struct(number=S), comment=_struct(body=S), repository=_struct(full_name=S),
)
RESPONSE_ROW = _struct(
    severity=S, category=S, filePath=S, lineStart=I, lineEnd=I, title=S, description=S, suggestion=S,
)
AGENT_RESPONSE = _struct(results=T.ArrayType(RESPONSE_ROW))

# -- tables ---------------------------------------------------------------------------------
RAW_EVENT = _struct(delivery_id=L, received_at=TS, body=S, signature=S)
REVIEW_TASK = _struct(
    task_id=L, pr_id=S, repo_name=S, pr_number=I, pr_title=S, pr_description=S, source_branch=S,
    target_branch=S, commit_sha=S, diff_url=S, trigger_event=S, received_at=TS,
)
CHANGED_FILE = _struct(
    task_id=L, pr_id=S, file_seq=I, file_path=S, change_type=S, additions=I, deletions=I, diff_content=S,
)
HUNK = _struct(
    task_id=L, pr_id=S, file_seq=I, hunk_seq=I, file_path=S, old_start=I, new_start=I, old_lines=I,
    new_lines=I, header=S, lines=T.ArrayType(S),
)
FINDING = _struct(
    task_id=L, pr_id=S, seq=L, agent_id=S, severity=S, category=S, file_path=S, line_start=I, line_end=I,
    title=S, description=S, suggestion=S,
)
FEEDBACK = _struct(
    id=L, pr_id=S, file_path=S, line_start=I, rule_category=S, agent_type=S, code_snippet=S, feedback=S,
    created_at=TS,
)
RULE_STATS = _struct(
    agent_type=S, rule_category=S, total=L, accepted=L, dismissed=L, dismiss_ratio=D, is_downgraded=B,
)

# -- fixed values ---------------------------------------------------------------------------
SEVERITIES = ["CRITICAL", "MAJOR", "MINOR", "INFO"]
TRIGGER_EVENTS = ["PR_OPENED", "PR_SYNCHRONIZED", "PR_CLOSED", "PUSH"]
CHANGE_TYPES = ["ADDED", "MODIFIED", "DELETED", "RENAMED"]
FEEDBACK_TYPES = ["ACCEPTED", "DISMISSED"]
AGENTS = ["architecture", "code-style", "logic", "security"]
