"""Style rules ST1-ST7."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from difftide.functions.text import (
    LINE_ENDS, MARK, count_char, ctrim, first_match_line, let, lines_of, marked_text, match_lines,
)
from difftide.operators.rules import (
    LineRule, any_of, at_line, guarded, hit, no_hits, starts_with_any, trimmed_starts_with_any,
)

# Patterns, limits and message texts of the rules.
PUBLIC_METHOD = r"public[^\S\n]+\w+[^\S\n]+\w+[^\S\n]*\("
METHOD_WITH_PARAMETERS = r"\bpublic\s+\w+\s+\w+\s*\([^)]*\)"
PARAMETER_COMMA = r",(?![^<]*>)"
MAGIC_NUMBER = r"[\s(=,](\d{2,}|\d+\.\d+)(?!\s*[.\w])"
ARRAY_SIZE = r"new\s+\w+\s*\[(\d+(?:\.\d+)?)\]"
EMPTY_IF = r"if\s*\([^)]*\)\s*\{\s*\}"
EMPTY_ELSE = r"else\s*\{\s*\}"
MIXED_INDENT = r"(?m)^(?=\t+[^\S\n]| +\t).*\S"
ALLOWED_NUMBERS = ["0", "1", "-1", "0.0", "1.0", "-1.0"]
NO_METHOD_START = r"\A(?!(?:if|while|for|switch|catch|synchronized)\b)\w"
JAVADOC_SKIP = ["//", "*", "@Override", "package", "import", "{"]
DECLARATION_STARTS = ["public", "private", "protected", "class", "interface", "@interface", "enum"]
NUMBER_SKIP = ["//", "*", "/*", "package", "import", "@"]
LOOK_BACK = 5
MAX_METHOD_LINES = 50
MAX_PARAMETERS = 5
MANY_COMMAS = rf"\A(?:[^,]*+,){{{MAX_PARAMETERS}}}"
NAME_LIMIT = 30


def method_name(line: Column) -> Column:
    """Name shown for a method line (ST7): the text before the parenthesis, else the word before."""
    clean = ctrim(F.replace(line, F.lit("{"), F.lit("")))

    def name_in(words: Column) -> Column:
        named = F.transform(
            words,
            lambda w, i: F.when(
                w.contains("("),
                F.when(~w.startswith("("), F.substring_index(w, "(", 1)).when(i > 0, F.get(words, i - 1)),
            ),
        )
        return F.get(F.array_compact(named), F.lit(0))

    return F.coalesce(let(F.split(clean, r"\s+"), name_in), F.substring(clean, 1, NAME_LIMIT))


def javadoc(text: Column) -> Column:
    """ST1: a public method without a doc comment in the five lines before it.

    A line that opens a doc comment never closes it, so a one-line doc comment hides what follows
    up to the next closing mark on another line. Method lines are marked beforehand; the fold only
    carries the comment state and the numbers of the candidate lines, and only meets lines that hold one of these marks.
    """
    def event(line: Column, at: Column) -> Column:
        return F.when(any_of(line, [MARK, "*/", "/**"]), F.struct(at.alias("at"), ctrim(line).alias("line")))

    def step(acc: Column, met: Column) -> Column:
        line = met["line"]
        opens = line.startswith("/**")
        closes = acc["inside"] & line.contains("*/")
        candidate = (
            line.contains(MARK) & ~opens & ~acc["inside"] & ~starts_with_any(line, JAVADOC_SKIP)
        )
        return F.struct(
            (opens | (acc["inside"] & ~closes)).alias("inside"),
            F.when(candidate, F.concat(acc["found"], F.array(met["at"])))
            .otherwise(acc["found"]).alias("found"),
        )

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<int>").alias("found"))

    def documented(lines: Column, at: Column) -> Column:
        first = F.greatest(at - LOOK_BACK, F.lit(0))
        before = F.reverse(F.transform(F.slice(lines, first + 1, at - first), ctrim))
        stops = [MARK, *DECLARATION_STARTS]
        marks = F.filter(before, lambda l: l.startswith("/**") | starts_with_any(l, stops))
        return F.coalesce(F.get(marks, F.lit(0)).startswith("/**"), F.lit(False))

    def make(lines: Column) -> Column:
        found = F.aggregate(F.array_compact(F.transform(lines, event)), start, step, lambda acc: acc["found"])
        missing = F.filter(found, lambda at: ~documented(lines, at))
        return F.transform(
            missing,
            lambda at: hit(
                at + 1, "JavadocStyle",
                F.concat(
                    F.lit("Public method '"), method_name(F.replace(F.get(lines, at), F.lit(MARK), F.lit(""))),
                    at_line("' at line ", at + 1, " is missing Javadoc comment."),
                ),
            ),
        )

    return F.when(text.rlike(PUBLIC_METHOD), let(lines_of(marked_text(text, PUBLIC_METHOD)), make)).otherwise(no_hits())


def starts_method(trimmed: Column) -> Column:
    """A line that begins with a word (no control keyword), holds `(...)` and ends with a brace."""
    open_at = F.instr(trimmed, "(")
    close_at = F.length(trimmed) - F.length(F.substring_index(trimmed, ")", -1))
    return (
        trimmed.endswith("{") & trimmed.rlike(NO_METHOD_START) & (open_at > 1) & (close_at > open_at)
        & ~trimmed.rlike(f"[{LINE_ENDS}]")
    )


def method_length(text: Column) -> Column:
    """ST2: methods whose closing brace is more than fifty lines below their first line.

    The fold carries the open method's first line and the brace depth since then.
    """

    def step(acc: Column, line: Column) -> Column:
        at = acc["at"]
        begins = acc["start"].isNull() & line.contains("(") & let(ctrim(line), starts_method)
        net = count_char(line, "{") - count_char(line, "}")

        def after(s: Column) -> Column:
            begun, depth = s["start"], s["depth"]
            ends = begun.isNotNull() & (depth <= 0)
            found = F.struct(begun.alias("start"), (at - begun).alias("length"))
            long = ends & (at - begun > MAX_METHOD_LINES)
            return F.struct(
                (at + 1).alias("at"),
                F.when(~ends, begun).alias("start"),
                depth.alias("depth"),
                F.when(long, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"),
            )

        def begun(b: Column) -> Column:
            depth = F.when(b, F.lit(0)).otherwise(acc["depth"]) + net
            return F.struct(F.when(b, at).otherwise(acc["start"]).alias("start"), depth.alias("depth"))

        return let(let(begins, begun), after)

    first = F.struct(
        F.lit(0).alias("at"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("depth"),
        F.array().cast("array<struct<start:int,length:int>>").alias("found"),
    )

    def make(lines: Column) -> Column:
        found = F.aggregate(lines, first, step, lambda acc: acc["found"])
        return F.transform(
            found,
            lambda m: hit(
                m["start"] + 1, "MethodLength",
                F.concat(
                    F.lit("Method '"), method_name(ctrim(F.get(lines, m["start"]))),
                    at_line("' at line ", m["start"] + 1, " is "),
                    at_line("", m["length"], " lines long (max allowed: 50)."),
                ),
            ),
        )

    could = count_char(text, "\n") > MAX_METHOD_LINES
    return F.when(could, let(lines_of(text), make)).otherwise(no_hits())


def parameter_count(line: Column) -> Column:
    """Parameters between the first `(` and the last `)`; commas inside generics do not count."""
    opened = F.instr(line, "(")
    tail = F.length(F.substring_index(line, ")", -1))
    inner = ctrim(F.substring(line, opened + 1, F.length(line) - tail - 1 - opened))
    parts = F.split(inner, PARAMETER_COMMA, -1)
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(F.lit(0))))
    return F.when((opened > 0) & (F.length(line) - tail > opened), last).otherwise(F.lit(0))


# ST3: more than five parameters.
param_count = LineRule(
    "ParameterNumber", ["public"],
    lambda line: line.rlike(MANY_COMMAS) & line.rlike(METHOD_WITH_PARAMETERS) & (parameter_count(line) > MAX_PARAMETERS),
    lambda line, n: F.concat(
        at_line("Method at line ", n, " has "),
        at_line("", parameter_count(line), " parameters (max allowed: 5). Consider refactoring."),
    ),
)


def _bare_number(line: Column) -> Column:
    """The first bare number of a line counts, unless it is allowed or an array size."""
    number = F.regexp_extract(line, MAGIC_NUMBER, 1)
    sizes = F.regexp_extract_all(line, F.lit(ARRAY_SIZE), F.lit(1))
    is_size = line.contains("[") & F.array_contains(sizes, number) & ~line.rlike(f"[{LINE_ENDS}]")
    return (
        line.rlike(MAGIC_NUMBER) & ~trimmed_starts_with_any(line, NUMBER_SKIP)
        & ~number.isin(ALLOWED_NUMBERS) & ~is_size
    )


# ST4. The pattern needs one character in front of the number; a run of them finds the same number.
magic_number = LineRule(
    "MagicNumber", [], _bare_number,
    lambda line, n: F.concat(
        F.lit("Magic number '"), F.regexp_extract(line, MAGIC_NUMBER, 1),
        at_line("' at line ", n, ". Define as a named constant instead."),
    ),
)


def empty_block(text: Column) -> Column:
    """ST5: empty if blocks, then empty else blocks."""

    def found(word: str, pattern: str) -> Column:
        return F.transform(
            match_lines(text, pattern),
            lambda line: hit(
                line + 1, "EmptyBlock",
                at_line(
                    f"Empty {word} block at line ", line + 1,
                    ". Either implement the body or remove the block.",
                ),
            ),
        )

    return F.concat(
        guarded(text, ["if"], found("if", EMPTY_IF)), guarded(text, ["else"], found("else", EMPTY_ELSE))
    )


def indentation(text: Column) -> Column:
    """ST6: the first line of a text whose indent mixes tabs and spaces."""
    made = let(
        first_match_line(text, MIXED_INDENT),
        lambda n: hit(
            n, "Indentation",
            at_line(
                "Inconsistent indentation at line ", n,
                ": mixed tabs and spaces. Use consistent indentation style.",
            ),
        ),
    )
    hits = F.filter(F.array(made), lambda h: h["line_number"].isNotNull())
    return guarded(text, ["\t"], hits)


STYLE_RULES = {
    "rule_javadoc": javadoc,
    "rule_method_length": method_length,
    "rule_param_count": param_count,
    "rule_magic_number": magic_number,
    "rule_empty_block": empty_block,
    "rule_indentation": indentation,
}
