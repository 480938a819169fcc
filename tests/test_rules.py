import random
import re

import models
import pytest
from pyspark.sql import functions as F

from difftide.functions.text import ctrim
from difftide.operators import bug_rules, findings, layer_rules, rules, style_rules
from difftide.operators.rules import scan

LINES = [
    "public class T {", "    public void run(String a) {", "    public String name() {", "void f(int x) {", "    }", "}", "{",
    "        return 42;", "    return call(a,", "        b);", "+    return x; ", "", "   ", "/** Doc. */", "/**", " * text", " */", "// public int f(",
    "    } catch (Exception e) { }", "} catch (E e) {", "try (Reader r = ", "new FileReader(p)) {", "  x = new BufferedReader(y);", "try {",
    "if (a) {", "} else {", "if (b) { }", "else { }", "\tx = 10;", "\t\tint a;", "  \tint b = 2.5;", "int[] c = new int[64]; d = 64;", "f(100, 3)", "x = 1024L",
    "private static void g(", "    static  void h() { return 1;", "@Override", "@interface X", "  public int k (int a) {", "x = 12 .5", "y = 0.0; z = 33", "try", "x" * 70,
    chr(0xE000) + " odd", "return " + "y" * 70 + ";", "a\rb = 77", "int[] e = new int[77]; f = 77;\r",
]


def texts():
    rng = random.Random(7)
    out = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for _ in range(20):
        body = [rng.choice(LINES) for _ in range(10)] + ["void f(int x) {"] + ["  call();"] * rng.randint(40, 70) + ["}", "}"]
        out.append("\n".join(body))
    return out + ["no newline", "\n", "catch(a){}catch(b){}\n\ncatch(c){\n}\n"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "file_seq int, content string").repartition(4).cache()


def run(corpus, rule):
    got = {}
    for r in scan(corpus, [rule]).collect():
        got.setdefault(r.file_seq, []).append((r.line_number, r.description))
    return got


def lines_only(got):
    return {k: sorted(n for n, _ in v) for k, v in got.items()}


def want(model, key=lambda x: x):
    out = {i: sorted(key(h) for h in model(t)) for i, t in enumerate(texts()) if t.strip()}
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize(
    ("rule", "model"),
    [
        (bug_rules.empty_catch, models.empty_catch),
        (lambda t: bug_rules.empty_catch(t, "reference"), lambda t: models.empty_catch(t, repeated=True)),
        (bug_rules.resource_leak, models.resource_leak), (style_rules.empty_block, models.empty_block),
        (style_rules.indentation, models.indentation),
    ],
)
def test_line_numbers(corpus, rule, model):
    assert lines_only(run(corpus, rule)) == want(model)


@pytest.mark.parametrize(
    ("rule", "model", "pattern"),
    [
        (style_rules.javadoc, models.javadoc, r"method '(.*)' at line"),
        (style_rules.magic_number, models.magic_number, r"number '(.*)' at line"),
        (bug_rules.void_return, lambda t: [(n, v if len(v) <= 60 else v[:57] + "...") for n, v in models.void_return(t)], r"(?s)'return (.*);'"),
        (style_rules.method_length, lambda t: [(n, str(m)) for n, m in models.method_length(t)], r"is (\d+) lines"),
    ],
)
def test_line_numbers_and_details(corpus, rule, model, pattern):
    got = {k: sorted((n, re.search(pattern, d).group(1)) for n, d in v) for k, v in run(corpus, rule).items()}
    assert got == want(model)
    assert got


def one(spark, rule, content):
    df = spark.createDataFrame([(1, content)], "file_seq int, content string")
    return [(r.line_number, r.rule) for r in scan(df, [rule]).orderBy("line_number").collect()]


def test_many_matches(spark):
    content = "catch (E e) { }\n" * 1200
    got = one(spark, bug_rules.empty_catch, content)
    assert [n for n, _ in got] == list(range(1200))


def test_mark_characters_are_reported_unchanged(spark):
    """A text with the mark and its stand-in: lines, and what is quoted from it, are those of the text."""
    a, b = chr(0xE000), chr(0xE001)
    text = f"{a}{b} x\npublic void f(int x) {{\n  return {a}{b}call();\n  {b} new FileReader(p{a})\n  }} catch (E e{a}) {{ }}\n else {{ }}{b}\n  \t{a}\n public int g{a}(int c) {{\n"
    df = spark.createDataFrame([(1, text)], "file_seq int, content string")
    rules = {
        bug_rules.void_return: models.void_return, bug_rules.resource_leak: models.resource_leak, bug_rules.empty_catch: models.empty_catch,
        style_rules.empty_block: models.empty_block, style_rules.javadoc: models.javadoc, style_rules.method_length: models.method_length,
    }
    for rule, model in rules.items():
        expected = sorted(h[0] if isinstance(h, tuple) else h for h in model(text))
        assert sorted(r.line_number for r in scan(df, [rule]).collect()) == expected, rule
    assert f"'return {a}{b}call();'" in scan(df, [bug_rules.void_return]).first().description


def test_simple_line_rules(spark):
    assert one(spark, bug_rules.string_eq, 'if (a == "x") { }\n// b == "y"\n  * "z" == c\nok.equals("q")') == [(1, "STRING_COMPARISON_USING_EQ")]
    assert one(spark, bug_rules.print_stack, "e.printStackTrace();\nx") == [(1, "PRINT_STACK_TRACE")]
    assert [n for n, _ in one(spark, bug_rules.system_out, "System.out.println(1)\nSystem . out\nSystem.err . printf()")] == [1, 3]
    assert [n for n, _ in one(spark, bug_rules.todo, "// TODO a\n//HACK\n// TODOS\n# TODO\n// XXX!")] == [1, 2, 5]
    six = "public void f(int a, int b, int c, int d, int e, Map<K, V> m) {"
    assert [n for n, _ in one(spark, style_rules.param_count, f"{six}\npublic void f(int a, Map<K,V> b) {{\npublic int f() {{")] == [1]
    assert one(spark, bug_rules.todo, "") == [] and one(spark, bug_rules.todo, " \n ") == []


def test_metadata_of_a_raw_diff_counts(spark):
    raw = "diff --git a/f b/f\nnew file mode 100644\n@@ -0,0 +1,20 @@\n+ x"
    assert [n for n, _ in one(spark, style_rules.magic_number, raw)] == [2]
    plus = "+catch (E e) {\n+}"
    assert one(spark, bug_rules.empty_catch, plus) == []


def layer(spark, content):
    df = spark.createDataFrame([(1, content)], "file_seq int, content string")
    return sorted((r.rule, r.description) for r in scan(df, list(layer_rules.LAYER_RULES.values())).collect())


def test_layer_rules(spark):
    head = "package a.b.c.controller;\nimport a.b.c.repository.impl.R;\n"
    injected = head + "@RestController\nclass X {\n@Autowired\nprivate UserRepository repo;\n UserRepository.find(1);"
    assert [d for _, d in layer(spark, injected)] == [layer_rules.INJECTION_TEXT]
    assert [d for _, d in layer(spark, head + "@Controller\nUserRepository.find (1);")] == [layer_rules.CALL_TEXT]
    assert layer(spark, head)[0][1].startswith("Controller package 'a.b.c.controller' imports from repository package 'a.b.c.repository.impl'")
    assert layer(spark, head.replace("repository.impl.R", "repository.R")) == []
    upward = "package a.b.c.repository;\nimport a.b.c.controller.X;\nimport a.b.c.controller.Y;\nimport z.controller.Q;"
    assert [r for r, _ in layer(spark, upward)] == ["CYCLIC_DEPENDENCY"] * 2
    same = "package a.b.c.service.x;\nimport a.b.c.service.y.Z;\nimport a.b.d.service.Z;\nimport Plain;"
    assert [r for r, _ in layer(spark, same)] == ["SAME_LAYER_COUPLING"]
    assert layer(spark, "+" + upward.replace("\n", "\n+")) == []


def test_tool_findings_order_and_severity(spark):
    content = "try { } catch (E e) { }\n// TODO x = 55 \nx = 55\n@Controller @Autowired XRepository y"
    files = spark.createDataFrame([(1, "p", 1, "F.java", content)], "task_id long, pr_id string, file_seq int, file_path string, diff_content string")
    rows = findings.tool_findings(files).orderBy("seq").collect()
    got = [(r.agent_id, r.title, r.severity, r.line_start) for r in rows]
    assert got == [
        ("architecture", "LAYER_VIOLATION", "CRITICAL", 0), ("code-style", "MagicNumber", "MINOR", 3),
        ("security", "EMPTY_CATCH_BLOCK", "MAJOR", 0), ("security", "TODO_COMMENT", "INFO", 2),
    ]
    assert len({r.seq for r in rows}) == 4 and {r.category for r in rows} == {"static-analysis"}
    assert "Exchange" not in findings.tool_findings(files)._jdf.queryExecution().executedPlan().toString()


def test_marks_behind_any_indent_are_found_in_one_match(spark):
    marks = ["//", "*", "/*", "@", "a.b"]
    lines = ["// x", " \t\x00// x", "x // y", "", "  ", "\n* x", "\u00a0* x", "/ *", "\x1f@A", " a.b", " axb", "/", None]
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    both = df.select(rules.trimmed_starts_with_any(F.col("line"), marks).alias("a"), rules.starts_with_any(ctrim(F.col("line")), marks).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]


def test_line_rules_trim_no_line(spark):
    """Trimming looks at one character at a time; what starts a line is matched instead."""
    files = spark.createDataFrame([(1, "p", 1, "A.java", "x")], "task_id long, pr_id string, file_seq int, file_path string, diff_content string")
    for rule in (bug_rules.string_eq, style_rules.magic_number):
        assert "trim(" not in rules.scan(files, [rule])._jdf.queryExecution().optimizedPlan().toString()
