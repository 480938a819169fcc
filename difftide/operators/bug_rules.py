"""Bug rules BG1-BG7. Texts may be raw diff sections or plain sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from difftide.functions.text import count_char, ctrim, let, lines_of, located_pieces, match_lines
from difftide.operators.rules import LineRule, at_line, guarded, hit, no_hits, trimmed_starts_with_any

# Patterns, limits and message texts of the rules.
EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
STRING_EQ = r'"[^"]*"\s*==\s*\w+|\w+\s*==\s*"[^"]*"'
SYSTEM_OUT = r"System\.(?:out|err)\s*\.\s*(?:print|println|printf)"
TODO = r"//\s*(TODO|FIXME|HACK|XXX)\b"
RESOURCE_CLASSES = [
    "FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "BufferedReader", "BufferedWriter",
]
RESOURCE_OPEN = rf"new\s+({'|'.join(RESOURCE_CLASSES)})\s*\("
RETURN_VALUE = r"(?m)^[+\- ]?\s*return\s+([^;]+)\s*;\s*$"
VOID_METHOD = r"[+\- ]?(?:public|private|protected|static|\s)\s+void\s+\w+\s*\("
COMMENT_STARTS = ["//", "*", "/*"]
TRY_WINDOW = 200
EXPRESSION_LIMIT, EXPRESSION_CUT = 60, 57

EMPTY_CATCH_TEXT = (
    "Empty catch block detected. Empty catch blocks silently swallow exceptions, "
    "making debugging difficult and potentially hiding critical failures."
)
PRINT_STACK_TEXT = (
    "printStackTrace() should not be used in production code. Use a logging framework instead."
)
SYSTEM_OUT_TEXT = (
    "System.out/err usage detected. Use a logging framework (SLF4J, Logback) for production code."
)
STRING_EQ_TEXT = (
    "String comparison using == instead of .equals() at line ",
    ". In Java, == compares object references, not string content.",
)
TODO_TEXT = (
    " comment found at line ",
    ". Incomplete code or known issue should be addressed before merge.",
)
RESOURCE_TEXT = (
    "Resource opened without try-with-resources at line ",
    ". Resources should be managed with try-with-resources to ensure proper closure.",
)
VOID_TEXT = (
    "Return with value in void method at line ", ": 'return ",
    ";'. Void methods cannot return a value.",
)


def empty_catch(text: Column, multiplicity: str = "once") -> Column:
    """BG1. The reported line is the newline count before the match, one less than elsewhere.

    `multiplicity="reference"` repeats each hit once per line from the end of the match to the end
    of the text.
    """
    starts = match_lines(text, EMPTY_CATCH)
    if multiplicity == "once":
        hits = F.transform(starts, lambda line: hit(line, "EMPTY_CATCH_BLOCK", EMPTY_CATCH_TEXT))
    else:
        ends = match_lines(text, EMPTY_CATCH, at_end=True)
        hits = let(
            F.size(lines_of(text)),
            lambda total: F.flatten(
                F.zip_with(
                    starts, ends,
                    lambda s, e: F.array_repeat(hit(s, "EMPTY_CATCH_BLOCK", EMPTY_CATCH_TEXT), total - e),
                )
            ),
        )
    return guarded(text, ["catch"], hits)


# BG2: comment lines are skipped.
string_eq = LineRule(
    "STRING_COMPARISON_USING_EQ", ["=="],
    lambda line: line.rlike(STRING_EQ) & ~trimmed_starts_with_any(line, COMMENT_STARTS),
    lambda line, n: at_line(STRING_EQ_TEXT[0], n, STRING_EQ_TEXT[1]),
)

# BG3.
print_stack = LineRule(
    "PRINT_STACK_TRACE", [".printStackTrace()"], lambda line: F.lit(True),
    lambda line, n: F.lit(PRINT_STACK_TEXT),
)

# BG4.
system_out = LineRule(
    "SYSTEM_OUT_USAGE", ["System."], lambda line: line.rlike(SYSTEM_OUT), lambda line, n: F.lit(SYSTEM_OUT_TEXT)
)

# BG5: the tag that was found opens the description.
todo = LineRule(
    "TODO_COMMENT", ["//"], lambda line: line.rlike(TODO),
    lambda line, n: F.concat(F.regexp_extract(line, TODO, 1), at_line(TODO_TEXT[0], n, TODO_TEXT[1])),
)


def resource_leak(text: Column) -> Column:
    """BG6: a reader or writer opened outside a try header.

    "Inside" means that the last `try` in the 200 characters before is followed by an unclosed
    parenthesis. A match is at least 15 characters long, so that window never needs more than the
    last 15 pieces of text.
    """

    def leaks(pieces: Column, i: Column) -> Column:
        first = F.greatest(i - 14, F.lit(0))
        near = F.transform(F.slice(pieces, first + 1, i - first + 1), lambda p: p["before"])
        window = F.right(F.array_join(near, ""), F.lit(TRY_WINDOW))
        return let(
            window,
            lambda w: ~(w.contains("try") & F.substring_index(w, "try", -1).rlike(r"\A\s*\([^)]*\z")),
        )

    def make(pieces: Column) -> Column:
        judged = F.transform(
            pieces,
            lambda p, i: F.when(
                leaks(pieces, i),
                hit(p["line"] + 1, "RESOURCE_LEAK", at_line(RESOURCE_TEXT[0], p["line"] + 1, RESOURCE_TEXT[1])),
            ),
        )
        return F.array_compact(judged)

    return guarded(text, RESOURCE_CLASSES, let(located_pieces(text, RESOURCE_OPEN, None), make))


def void_return(text: Column) -> Column:
    """BG7: a value returned while the braces since the last void method are still open.

    The depth is summed and never stops at zero, so a return of a later non-void method is reported
    too. The fold walks the pieces from one return to the next and keeps only whether a void method
    was seen and the depth since then.
    """

    def summary(p: Column) -> Column:
        parts = F.split(p["before"], VOID_METHOD, -1)
        value = ctrim(p["value"])
        return let(
            parts,
            lambda x: F.struct(
                (F.size(x) > 1).alias("opens"),
                (count_char(F.element_at(x, -1), "{") - count_char(F.element_at(x, -1), "}")).alias("depth"),
                (p["line"] + 1).alias("number"),
                value.alias("value"),
            ),
        )

    def step(acc: Column, p: Column) -> Column:
        depth = F.when(p["opens"], p["depth"]).otherwise(acc["depth"] + p["depth"])
        seen = acc["seen"] | p["opens"]
        found = F.struct(p["number"].alias("number"), p["value"].alias("value"))
        return F.struct(
            seen.alias("seen"),
            depth.alias("depth"),
            F.when(seen & (depth > 0), F.concat(acc["found"], F.array(found)))
            .otherwise(acc["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(False).alias("seen"), F.lit(0).alias("depth"),
        F.array().cast("array<struct<number:int,value:string>>").alias("found"),
    )
    pieces = F.transform(located_pieces(text, RETURN_VALUE, 1), summary)

    def make(r: Column) -> Column:
        value = F.when(
            F.length(r["value"]) > EXPRESSION_LIMIT,
            F.concat(F.substring(r["value"], 1, EXPRESSION_CUT), F.lit("...")),
        ).otherwise(r["value"])
        return hit(
            r["number"], "RETURN_IN_VOID_METHOD",
            F.concat(at_line(VOID_TEXT[0], r["number"], VOID_TEXT[1]), value, F.lit(VOID_TEXT[2])),
        )

    hits = F.transform(F.aggregate(pieces, start, step, lambda acc: acc["found"]), make)
    return F.when(text.contains("return") & text.contains("void"), hits).otherwise(no_hits())


BUG_RULES = {
    "rule_empty_catch": empty_catch,
    "rule_string_eq": string_eq,
    "rule_print_stack": print_stack,
    "rule_system_out": system_out,
    "rule_todo": todo,
    "rule_resource_leak": resource_leak,
    "rule_void_return": void_return,
}
