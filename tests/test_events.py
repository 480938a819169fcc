import hashlib
import hmac
import json
from datetime import datetime

import pytest

from difftide.operators import events as ev
from difftide.sources import webhooks

NOW = datetime(2024, 1, 1)


def raw(spark, bodies):
    rows = [(i, NOW, b, None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "delivery_id long, received_at timestamp_ntz, body string, signature string")


def pr_body(**change):
    body = {
        "action": "opened", "number": 42, "extra": 1, "repository": {"full_name": "owner/repo", "id": 1},
        "pull_request": {"title": "T", "body": None, "head": {"ref": "f", "sha": "s"}, "base": None, "diff_url": "u"},
    }
    body.update(change)
    return json.dumps({k: v for k, v in body.items() if v != "gone"})


def test_signature_matches_hmac(spark):
    for secret in ["k", "x" * 64, "long" * 40, "schlüssel"]:
        good = "sha256=" + hmac.new(secret.encode(), "päyload".encode(), hashlib.sha256).hexdigest()
        cases = [
            ("päyload", good, True), ("päyload!", good, False), ("päyload", good[7:], False),
            ("päyload", good.upper().replace("SHA256=", "sha256="), False), ("päyload", None, False),
            (None, good, False), ("päyload", "sha256=", False),
        ]
        df = spark.createDataFrame([(b, s) for b, s, _ in cases], "body string, signature string")
        got = [r.signature_valid for r in ev.with_signature_valid(df, secret).collect()]
        assert got == [ok for _, _, ok in cases]
    df = spark.createDataFrame([("a", "sha256=b")], "body string, signature string")
    assert ev.with_signature_valid(df, None).first().signature_valid is False


def test_pr_tasks_and_dispositions(spark):
    bodies = [
        pr_body(), pr_body(action="synchronize"), pr_body(action="closed"), pr_body(action="labeled"),
        pr_body(action="gone"), "{broken", "", "[]", pr_body(pull_request=None), pr_body(repository="gone"),
        pr_body(number="x"), pr_body(number="gone", pull_request={"head": {"ref": None, "sha": None}}),
    ]
    pr = webhooks.read_pr_webhooks(raw(spark, bodies))
    got = [(r.disposition.status, r.disposition.message) for r in ev.pr_dispositions(pr, verified=True).orderBy("delivery_id").collect()]
    assert got[:3] == [(200, ev.PR_DONE)] * 3
    assert got[3] == (400, "Unsupported action: labeled") and got[4] == (400, "Unsupported action: null")
    assert got[5:8] == [(400, ev.BAD_PAYLOAD)] * 3
    assert [g[0] for g in got[8:10]] == [500, 500] and got[10] == (400, ev.BAD_PAYLOAD)
    tasks = {r.task_id: r for r in ev.build_pr_tasks(pr, verified=True).collect()}
    assert sorted(tasks) == [0, 1, 2, 11]
    t = tasks[0]
    assert (t.pr_id, t.pr_title, t.pr_description, t.source_branch, t.target_branch, t.commit_sha) == (
        "owner/repo#42", "T", "", "f", "", "s",
    )
    assert tasks[2].trigger_event == "PR_CLOSED"
    assert (tasks[11].pr_id, tasks[11].source_branch, tasks[11].target_branch) == ("owner/repo#0", None, "")


def test_unsigned_delivery_is_rejected_first(spark):
    df = ev.with_signature_valid(raw(spark, ["{broken"]), "k")
    pr = webhooks.read_pr_webhooks(df)
    assert ev.pr_dispositions(pr).first().disposition.status == 401


def test_push_order_and_tasks(spark):
    def push(**c):
        return json.dumps({"ref": "refs/heads/main", "before": "b1", "after": "a1", "repository": {"full_name": "o/r"}, **c})

    bodies = [
        push(), push(after="000", before="000", ref="refs/tags/v"), push(after=None), push(before="0", ref="refs/tags/v"),
        push(ref="refs/tags/v"), push(ref="plain", before=None, head_commit={"message": "m"}), "[1",
    ]
    p = webhooks.read_push_webhooks(raw(spark, bodies))
    got = [r.disposition.message for r in ev.push_dispositions(p, verified=True).orderBy("delivery_id").collect()]
    assert got == [
        ev.PUSH_DONE, ev.SKIP_DELETE, ev.SKIP_DELETE, ev.SKIP_NEW_BRANCH, ev.SKIP_TAG, ev.PUSH_DONE, ev.BAD_PAYLOAD,
    ]
    tasks = {r.task_id: r for r in ev.build_push_tasks(p, verified=True).collect()}
    assert tasks[0].pr_id == "o/r#push:a1" and tasks[0].pr_title == "Push: main"
    assert tasks[0].diff_url == "https://api.github.com/repos/o/r/compare/b1...a1"
    assert tasks[0].pr_description == "" and tasks[5].pr_description == "m"
    assert tasks[5].diff_url.endswith("/compare/null...a1") and tasks[5].source_branch == "plain"


def test_comment_strict_and_defaults(spark):
    bodies = [
        json.dumps({"action": "created", "issue": {"number": 3}, "comment": {"body": "hi"}, "repository": {"full_name": "o/r"}}),
        json.dumps({"comment": {"body": "hi"}}),
        json.dumps({"comment": {"body": "hi", "id": 1}}), json.dumps({"comment": {"body": "hi"}, "sender": {}}), "nope",
    ]
    lenient = webhooks.read_comment_webhooks(raw(spark, bodies)).orderBy("delivery_id").collect()
    assert [(r.repo_name, r.pr_number, r.body) for r in lenient[:2]] == [("o/r", 3, "hi"), ("unknown", 0, "hi")]
    assert [r.parse_error for r in lenient] == [None, None, None, None, "Invalid payload"]
    strict = webhooks.read_comment_webhooks(raw(spark, bodies), strict=True).orderBy("delivery_id").collect()
    assert [r.parse_error is None for r in strict] == [True, True, False, False, False]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("/feedback accept SQL_INJECTION", ("ACCEPTED", "SQL_INJECTION", "security", None, 0)),
        ("  /FEEDBACK Dismiss NULL_CHECK src/A.java 12 \n", ("DISMISSED", "NULL_CHECK", "logic", "src/A.java", 12)),
        ("/feedback accept style 7", ("ACCEPTED", "style", "codestyle", "7", 0)),
        ("/feedback accept security SQL_INJECTION", ("ACCEPTED", "security", "security", "SQL_INJECTION", 0)),
        ("/feedback dismiss AUTHOR_STYLE", ("DISMISSED", "AUTHOR_STYLE", "security", None, 0)),
        ("/feedback dismiss layer/x", ("DISMISSED", "layer/x", "architecture", None, 0)),
        ("/feedback dismiss other", ("DISMISSED", "other", "unknown", None, 0)),
        ("/feedback accept a b 99999999999", None), ("/feedback maybe X", None), ("/feedback accept", None),
        ("x /feedback accept X", None), ("/feedback accept a b 1 extra", None), ("", None), (None, None), (" \t ", None),
    ],
)
def test_directives(spark, body, want):
    df = spark.createDataFrame([(1, NOW, "o/r", 5, body)], "delivery_id long, received_at timestamp_ntz, repo_name string, pr_number int, body string")
    rows = ev.to_feedback(df).collect()
    got = [(r.feedback, r.rule_category, r.agent_type, r.file_path, r.line_start) for r in rows]
    assert got == ([want] if want else [])
    assert all(r.pr_id == "o/r#5" and r.code_snippet is None and r.created_at == NOW for r in rows)
