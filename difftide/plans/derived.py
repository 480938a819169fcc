"""Input tables derived from the given parquet tables.

The given tables hold no diffs, payloads or findings, so these are built from them, row by row, with
expressions written once and rendered for Spark and for the check database. Every derived row comes
from one row of its source table: nothing is grouped, so the inputs grow and split like the source.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

WEBHOOK_SECRET = "test-secret"

RULE_NAMES = [
    "SQL_INJECTION", "XSS", "NULL_POINTER", "BOUND_CHECK", "NAMING_CONVENTION", "FORMAT", "LAYER_VIOLATION",
    "CIRCULAR_DEPENDENCY", "AUTHOR_STYLE", "CUSTOM_RULE",
]
LINE_SIGNS = ["-", " ", "+", "+", "+"]
SNIPPETS = [
    "import java.util.List;",
    "import static org.junit.Assert.assertTrue;",
    "public class T {",
    "    public void run(String a, int b, int c, int d, int e, int f) {",
    '        if (name == "x") { }',
    "        System.out.println(1024);",
    "        // TODO later",
    "        } catch (Exception e) { }",
    "        FileReader r = new FileReader(p);",
    "        return 42;",
    "    }",
    "}",
    "        try (BufferedReader in = wrap(",
    "            new FileReader(q))) {",
    "        e.printStackTrace();",
    "    /** Doc. */",
    "\t  int x = 3;",
    "        int[] a = new int[64];",
    "        } else { }",
    "    public String name() {",
    "    /**",
    "     * Text.",
    "     */",
    "import java.sql.Connection;",
    "        // FIXME soon, XXX",
    "        double ratio = 0.25;",
    "        return compute(a, b);",
    "",
    "        while (i < 10) { i = i + 2; }",
    "        if (ready) {",
    "    void reset(int n) {",
]
LONG_METHOD = ["    public String build(int n) {", "    }", "        call(n);"]
PARTS_OF_SPLIT = 6  # parts of derived rows for a split of the source table, where there are more splits than cores
SOURCE_LAYERS = ["controller", "repository", "service", "model", "config", "util"]


@dataclass(frozen=True)
class Dialect:
    """Renders the few expressions that the two engines spell differently."""

    spark: bool

    def text(self, value: object) -> str:
        return f"cast({value} as varchar(40))"

    def lit(self, value: str) -> str:
        """String literal; control characters and backslashes go through chr()."""
        out, plain = [], ""
        for ch in value:
            if ch in "\n\t\\":
                out += [f"'{plain}'"] if plain else []
                out.append(f"chr({ord(ch)})")
                plain = ""
            else:
                plain += "''" if ch == "'" and not self.spark else ch
        out += [f"'{plain}'"] if plain or not out else []
        return out[0] if len(out) == 1 else f"concat({', '.join(out)})"

    def pick(self, values: list[str], index: str) -> str:
        """Entry of a literal list, index from zero."""
        items = ", ".join(self.lit(v) for v in values)
        if self.spark:
            return f"element_at(array({items}), cast({index} + 1 as int))"
        return f"list_extract([{items}], cast({index} + 1 as int))"

    def join_each(self, start: str, end: str, var: str, expr: str, sep: str) -> str:
        """Texts for var = start .. end - 1, joined."""
        if self.spark:
            return f"array_join(transform(sequence({start}, {end} - 1), {var} -> {expr}), {sep})"
        return f"array_to_string(list_transform(range({start}, {end}), lambda {var}: {expr}), {sep})"

    def each_row(self, end: int, var: str) -> str:
        """Select item that repeats a row for var = 0 .. end - 1."""
        if self.spark:
            return f"explode(sequence(0, {end - 1})) AS {var}"
        return f"cast(unnest(range(0, {end})) as int) AS {var}"


def _nl(*parts: str) -> str:
    """Concatenate with newlines in between."""
    joined = ", chr(10), ".join(parts)
    return f"concat({joined})"


def _section(d: Dialect, o: str, f: str) -> str:
    path = (
        f"concat('src/m', {d.text(f'{o} % 5')}, '/F', {d.text(f'{o} % 7')}, {d.text(f)}, "
        f"{d.pick(['.md', '', '.java', '.java', '.java', '.java'], f'({o} + {f}) % 6')})"
    )
    kind = f"({o} + {f}) % 5"
    head = (
        f"CASE {kind} WHEN 0 THEN {_nl(repr('new file mode 100644'), repr('--- /dev/null'), f'concat({chr(39)}+++ b/{chr(39)}, {path})')} "
        f"WHEN 1 THEN {_nl(repr('deleted file mode 100644'), f'concat({chr(39)}--- a/{chr(39)}, {path})', repr('+++ /dev/null'))} "
        f"WHEN 2 THEN {_nl(repr('similarity index 90%'), f'concat({chr(39)}rename from old/{chr(39)}, {path})', f'concat({chr(39)}rename to {chr(39)}, {path})')} "
        f"ELSE {_nl(repr('index 1234567..abcdef0 100644'), f'concat({chr(39)}--- a/{chr(39)}, {path})', f'concat({chr(39)}+++ b/{chr(39)}, {path})')} END"
    )
    long_line = lambda j: f"(CASE WHEN {j} = 2 THEN 0 WHEN {j} = 50 + {o} % 19 THEN 1 ELSE 2 END)"
    line = lambda j: (
        f"CASE WHEN {o} % 50 = 0 AND {j} < 70 THEN concat(' ', {d.pick(LONG_METHOD, long_line(j))}) ELSE "
        f"concat({d.pick(LINE_SIGNS, f'({o} * 3 + {f} * 5 + {j} * 7) % 5')}, "
        f"{d.pick(SNIPPETS, f'({o} * 7 + {f} * 3 + {j} * {j} + {j} * ({o} % 11)) % {len(SNIPPETS)}')}) END"
    )
    n1 = f"(CASE WHEN {o} % 50 = 0 THEN 70 ELSE 3 + ({o} * 3 + {f}) % 12 END)"
    first = (
        f"concat('@@ -', {d.text(f'{o} % 30')}, CASE WHEN {o} % 3 = 0 THEN '' ELSE ',7' END, ' +', "
        f"{d.text(f'{o} % 31')}, ',9 @@ ctx')"
    )
    body1 = d.join_each("0", n1, "j", line("j"), "chr(10)")
    body2 = d.join_each("100", f"(101 + ({o} + {f}) % 4)", "i", line("i"), "chr(10)")
    second = f"CASE WHEN ({o} + {f}) % 2 = 0 THEN concat(chr(10), '@@ -50,3 +60 @@', chr(10), {body2}) ELSE '' END"
    tail = f"CASE WHEN {o} % 4 = 0 THEN concat(chr(10), chr(92), ' No newline at end of file') ELSE '' END"
    git = f"concat('diff --git a/', {path}, ' b/', {path})"
    return f"concat({git}, chr(10), {head}, chr(10), {first}, chr(10), {body1}, {second}, {tail}, chr(10))"


def _diff_body(d: Dialect) -> str:
    o = "o_orderkey"
    files = d.join_each("0", f"(1 + {o} % 3)", "f", _section(d, o, "f"), "''")
    return (
        f"CASE WHEN {o} % 29 = 0 THEN '' ELSE concat(CASE WHEN {o} % 17 = 0 THEN "
        f"concat('From: someone', chr(10)) ELSE '' END, {files}) END"
    )


def _rule(d: Dialect, index: str) -> str:
    return d.pick(RULE_NAMES, index)


def _diffs(d: Dialect) -> str:
    return (
        f"SELECT o_orderkey AS task_id, concat('org/repo', {d.text('o_custkey % 5')}, '#', {d.text('o_orderkey % 2000')}) AS pr_id, "
        f"{_diff_body(d)} AS body FROM orders"
    )


def _fetches(d: Dialect) -> str:
    return f"""
SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 13 = 0 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN o_orderkey % 19 = 0 THEN concat('  ', chr(10), '<!DOCTYPE html><p>login</p>')
       WHEN o_orderkey % 23 = 0 THEN '<html>login</html>' ELSE {_diff_body(d)} END AS body
FROM orders WHERE o_orderkey % 37 <> 0"""


def _page_fetches(d: Dialect) -> str:
    return f"""
SELECT page_id AS task_id, url AS diff_url, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN page_id % 3 = 0 THEN concat('  ', html)
       ELSE concat('diff --git a/p', {d.text('page_id')}, '.java b/p', {d.text('page_id')}, '.java') END AS body
FROM pages"""


def _pr_webhooks(d: Dialect) -> str:
    o = d.text("o_orderkey")
    return f"""
SELECT o_orderkey AS delivery_id, o_orderdate AS received_at,
 CASE WHEN o_orderkey % 50 = 0 THEN '{{broken' ELSE concat('{{"action":"',
   {d.pick(['opened', 'synchronize', 'closed', 'labeled', 'opened'], 'o_orderkey % 5')},
   '","number":', {d.text('o_orderkey % 2000')}, ',"repository":{{"full_name":"org/repo', {d.text('o_custkey % 5')}, '"}}',
   CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE concat(',"pull_request":{{"title":',
   CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE concat('"T ', {o}, '"') END, ',"body":"b","head":',
   CASE WHEN o_orderkey % 11 = 0 THEN 'null' ELSE concat('{{"ref":"f', {d.text('o_custkey % 9')}, '","sha":"s', {o}, '"}}') END,
   ',"base":{{"ref":"main","sha":"0"}}', CASE WHEN o_orderkey % 47 = 0 THEN '' ELSE concat(',"diff_url":"https://diffs/', {o}, '"') END,
   '}}') END, ',"extra":1}}') END AS body
FROM orders"""


def _push_webhooks(d: Dialect) -> str:
    o = d.text("o_orderkey")
    return f"""
SELECT o_orderkey + 1000000000000 AS delivery_id, o_orderdate AS received_at,
 CASE WHEN o_orderkey % 53 = 0 THEN '[1,' ELSE concat('{{"ref":"',
 {d.pick(['refs/tags/v1', 'refs/heads/main', 'refs/heads/dev', 'other'], 'o_orderkey % 4')},
 '","before":"', CASE WHEN o_orderkey % 6 = 0 THEN '0000' ELSE concat('b', {o}) END, '"',
 CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat(',"after":"', CASE WHEN o_orderkey % 9 = 0 THEN '0000' ELSE concat('a', {o}) END, '"') END,
 ',"repository":{{"full_name":"org/repo', {d.text('o_custkey % 5')}, '"}}',
 CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE ',"head_commit":{{"id":"c","message":"m","url":"u"}}' END,
 CASE WHEN o_orderkey % 5 = 0 THEN ',"commits":[{{"id":"c"}},{{"id":"e"}}]' ELSE ',"commits":[]' END, '}}') END AS body
FROM orders"""


def _comment_text(d: Dialect) -> str:
    rule = _rule(d, "user_id % 10")
    kind = "(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END)"
    r = "(user_id % 10)"
    return f"""CASE WHEN {kind} = 1 THEN 'looks good to me' ELSE concat(
   CASE WHEN event_id % 3 = 0 THEN '  /feedback ' ELSE '/feedback ' END,
   CASE WHEN ({kind} + {r}) % 5 < {r} % 5 THEN CASE WHEN event_id % 4 = 0 THEN 'DISMISS' ELSE 'dismiss' END ELSE 'accept' END,
   ' ', {rule},
   CASE WHEN event_id % 2 = 0 THEN concat(' src/m', {d.text('user_id % 5')}, '/F', {d.text('event_id % 6')}, '.java ', {d.text('event_id % 8')})
        WHEN event_id % 101 = 1 THEN ' 99999999999' WHEN event_id % 103 = 1 THEN ' a/b 99999999999' ELSE '' END) END"""


def _comments(d: Dialect) -> str:
    return f"""
SELECT event_id AS delivery_id, ts AS received_at, concat('org/repo', {d.text('user_id % 5')}) AS repo_name,
  cast(event_id % 40 AS int) AS pr_number, {_comment_text(d)} AS body
FROM events"""


def _comment_payloads(d: Dialect) -> str:
    return f"""
SELECT event_id AS delivery_id, ts AS received_at,
  CASE WHEN event_id % 61 = 0 THEN '{{"action":' ELSE concat('{{"action":"',
   {d.pick(['created', 'edited', 'deleted'], 'event_id % 3')}, '"',
   CASE WHEN event_id % 19 = 0 THEN '' ELSE concat(',"issue":{{"number":', {d.text('event_id % 40')}, CASE WHEN event_id % 4 = 0 THEN ',"id":7}}' ELSE '}}' END) END,
   ',"comment":{{"body":"', {_comment_text(d)}, '"}}',
   CASE WHEN event_id % 23 = 0 THEN '' ELSE concat(',"repository":{{"full_name":"org/repo', {d.text('user_id % 5')}, '"}}') END,
   CASE WHEN event_id % 5 = 0 THEN ',"sender":{{}}' ELSE '' END, '}}') END AS body
FROM events"""


def _findings(d: Dialect) -> str:
    quantity = "cast(l_quantity AS int)"
    return f"""
SELECT l_suppkey AS task_id, concat('org/repo', {d.text('l_suppkey % 5')}, '#', {d.text('l_suppkey')}) AS pr_id,
 (l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey AS seq,
 {d.pick(['architecture', 'code-style', 'logic', 'security'], 'l_linenumber % 4')} AS agent_id,
 CASE WHEN {quantity} % 16 = 0 AND l_partkey % 41 = 0 THEN 'CRITICAL' WHEN {quantity} % 4 = 1 THEN 'MAJOR' WHEN {quantity} % 4 = 2 THEN 'MINOR' ELSE 'INFO' END AS severity,
 CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE {_rule(d, 'l_partkey % 10')} END AS category,
 CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_orderkey % 83 = 0 THEN '' WHEN l_orderkey % 79 = 0 THEN '(unknown)'
      ELSE concat('src/m', {d.text('l_partkey % 5')}, '/F', {d.text('l_orderkey % 6')}, '.java') END AS file_path,
 cast(l_orderkey % 8 AS int) AS line_start, cast(l_orderkey % 8 + l_linenumber % 3 AS int) AS line_end,
 concat('finding ', {d.text('l_orderkey')}) AS title,
 CASE WHEN l_orderkey % 71 = 0 THEN NULL ELSE concat('desc_', {d.text('l_partkey')}, CASE WHEN l_orderkey % 5 = 0 THEN concat(chr(10), '*more* `x`') ELSE '' END) END AS description,
 CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'fix it' END AS suggestion
FROM lineitem"""


def _tasks(d: Dialect) -> str:
    return f"""
SELECT s_suppkey AS task_id, concat('org/repo', {d.text('s_suppkey % 5')}, '#', {d.text('s_suppkey')}) AS pr_id,
 concat('org/repo', {d.text('s_suppkey % 5')}) AS repo_name, cast(s_suppkey AS int) AS pr_number, s_name AS pr_title,
 CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE concat('s', {d.text('s_suppkey')}) END AS commit_sha,
 {d.pick(['PUSH', 'PR_OPENED', 'PR_SYNCHRONIZED', 'PR_CLOSED'], 's_suppkey % 4')} AS trigger_event,
 timestamp '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (s_nationkey * 5003) AS received_at
FROM supplier"""


def _sources(d: Dialect) -> str:
    p = "p_partkey"
    base = d.pick(["com.acme.shop", "com.acme.user"], f"{p} % 2")
    other = d.pick(["com.acme.shop", "com.acme.user"], f"({p} + j) % 2")
    imports = d.join_each(
        "0", f"(1 + {p} % 4)", "j",
        f"concat('import ', {other}, '.', {d.pick(SOURCE_LAYERS, f'({p} * 3 + j * j) % 6')}, "
        f"CASE WHEN (j + {p}) % 3 = 1 THEN '.core' ELSE '' END, '.C', {d.text('j')}, ';')", "chr(10)",
    )
    return f"""
SELECT {p} AS task_id, concat('org/repo#', {d.text(p)}) AS pr_id, 1 AS file_seq, concat('src/C', {d.text(p)}, '.java') AS file_path,
 concat(CASE WHEN {p} % 13 = 0 THEN '+' ELSE '' END, 'package ', {base}, '.', {d.pick(SOURCE_LAYERS, f'{p} % 6')},
  CASE WHEN {p} % 4 = 0 THEN '.impl' ELSE '' END, ';', chr(10), chr(10), {imports}, chr(10), 'import Plain;', chr(10), chr(10),
  CASE WHEN {p} % 6 = 0 OR {p} % 11 = 0 THEN concat('@RestController', chr(10)) WHEN {p} % 7 = 0 THEN concat('@Controllers', chr(10)) ELSE '' END,
  'public class C', {d.text(p)}, ' {{', chr(10),
  CASE WHEN {p} % 5 = 0 THEN concat('    @Autowired', chr(10), '    private OrderRepository repo;', chr(10))
       WHEN {p} % 5 = 1 THEN concat('    @Autowired', chr(10), '    C', {d.text(p)}, '(Clock c, OrderRepository repo) {{ }}', chr(10)) ELSE '' END,
  '    public void save(Order o) {{', chr(10),
  CASE WHEN {p} % 9 = 0 THEN concat('        orderRepository.save(o);', chr(10), '        OrderRepository.flush (o);', chr(10)) ELSE '' END,
  '    }}', chr(10), '}}', chr(10)) AS content
FROM part"""


def _modules(d: Dialect) -> str:
    """Changed files of reviews that import each other: a review for each order, with 3 to 7 files."""
    n, named = "(k + 1)", "(1 + (o_custkey + 3 * k + j * j) % 7)"
    imports = d.join_each(
        "0", "(1 + (o_custkey + k) % 4)", "j",
        f"concat('+import ', CASE WHEN j = 2 THEN 'static ' ELSE '' END, 'com.acme.m', {d.text(f'{named} % 3')}, "
        f"'.C', {d.text(named)}, CASE WHEN j = 2 THEN '.of' ELSE '' END, ';')", "chr(10)",
    )
    return f"""
SELECT o_orderkey AS task_id, concat('org/repo#', {d.text('o_orderkey')}) AS pr_id, cast({n} AS int) AS file_seq,
 concat('src/main/java/com/acme/m', {d.text(f'{n} % 3')}, '/C', {d.text(n)}, '.java') AS file_path,
 cast(1 + (o_custkey + 5 * k) % 9 AS int) AS additions, cast(k % 4 AS int) AS deletions,
 concat({imports}, chr(10), '+class C', {d.text(n)}, ' {{', chr(10), '+}}', chr(10)) AS diff_content
FROM (SELECT o_orderkey, o_custkey, {d.each_row(7, 'k')} FROM orders) x WHERE k <= 2 + o_custkey % 5"""


def _responses(d: Dialect) -> str:
    o, a = "o_orderkey", "agent_no"
    agent = d.pick(["architecture", "code-style", "logic", "security"], a)
    path = (
        f"CASE ({o} + {a}) % 7 WHEN 0 THEN '  ' WHEN 1 THEN concat('F', {d.text(f'{o} % 7')}, '0') WHEN 2 THEN 'nowhere/X.java' "
        f"WHEN 3 THEN concat('m', {d.text(f'{o} % 5')}, chr(92), chr(92), 'F', {d.text(f'{o} % 7')}, '0') "
        f"ELSE concat('src/m', {d.text(f'{o} % 5')}, '/F', {d.text(f'{o} % 7')}, '0.java') END"
    )
    severity = d.pick(["CRITICAL", "MAJOR", "MINOR", "INFO"], f"({o} * 3 + {a}) % 4")
    row = lambda k: (
        f"concat('{{\"severity\":\"', {severity}, '\",\"category\":\"', {_rule(d, f'({o} + {a} + {k}) % 10')}, "
        f"'\",\"filePath\":\"', {path}, '\",\"lineStart\":', {d.text(f'({o} + {k}) % 40')}, ',\"lineEnd\":', {d.text(f'({o} + {k}) % 40 + {a}')}, "
        f"',\"title\":\"t', {d.text(f'{o} + {k}')}, '\",\"description\":\"d\",\"suggestion\":null}}')"
    )
    return f"""
SELECT task_id, pr_id, agent_id, CASE WHEN ({o} + {a}) % 53 = 0 THEN 'timeout' ELSE NULL END AS error,
 CASE WHEN ({o} * 3 + {a}) % 11 = 0 THEN '{{"results":[' WHEN ({o} * 3 + {a}) % 11 = 1 THEN '{{"results":[]}}'
      WHEN ({o} * 3 + {a}) % 11 = 2 THEN '{{"results":null}}' WHEN ({o} * 3 + {a}) % 11 = 3 THEN concat('{{"results":[', {row(0)}, ',', {row(1)}, ']}}')
      WHEN ({o} * 3 + {a}) % 97 = 4 THEN '{{"results":[{{"severity":"HUGE"}}]}}'
      ELSE concat('{{"results":[', {row(0)}, ']}}') END AS response
FROM (SELECT o_orderkey, {a}, o_orderkey AS task_id,
        concat('org/repo', {d.text('o_custkey % 5')}, '#', {d.text('o_orderkey % 2000')}) AS pr_id, {agent} AS agent_id
      FROM (SELECT o_orderkey, o_custkey, {d.each_row(4, a)} FROM orders) x) y"""


_TABLES = {
    "fx_diffs": _diffs,
    "fx_fetches": _fetches,
    "fx_page_fetches": _page_fetches,
    "fx_pr_webhooks": _pr_webhooks,
    "fx_push_webhooks": _push_webhooks,
    "fx_comments": _comments,
    "fx_comment_payloads": _comment_payloads,
    "fx_findings": _findings,
    "fx_tasks": _tasks,
    "fx_sources": _sources,
    "fx_modules": _modules,
    "fx_responses": _responses,
}


DERIVED_TABLES = list(_TABLES)


def derived_sql(name: str, spark: bool) -> str:
    """Defining query of a derived table for one of the two engines."""
    # Doubled braces belong to f-string templates; the texts themselves use single ones.
    return _TABLES[name](Dialect(spark)).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables.

    The given tables are read through views of their own, which are gone when the plan is made. A derived row is
    much larger than its source row, so the rows are dealt out to all cores first (a step of the fixture: the given
    tables are single small files). Each split beyond one for each core adds more parts, so a part doesn't grow with the table.
    """
    cores = spark.sparkContext.defaultParallelism
    sql, views = derived_sql(name, spark=True), []
    try:
        for source in SOURCE_TABLES:
            if re.search(rf"FROM {source}\b", sql):
                views.append(f"difftide_{source}_{uuid.uuid4().hex}")
                given = table(spark, sf_dir, source)
                parts = cores + PARTS_OF_SPLIT * max(0, given.rdd.getNumPartitions() - cores)
                given.repartition(parts).createOrReplaceTempView(views[-1])
                sql = re.sub(rf"FROM {source}\b", f"FROM {views[-1]}", sql)
        return spark.sql(sql)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)
