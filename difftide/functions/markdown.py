"""Text of reports and comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from difftide.functions.text import ctrim, not_blank, text_or_null_word

# Wording and marks of the report format.
REPORT_TITLE = "## AI Code Review Report for PR "
NO_REPORT = "## AI Code Review Report\n\nNo data available."
SEVERITY_MARKS = {
    "CRITICAL": ":red_circle:", "MAJOR": ":orange_circle:", "MINOR": ":yellow_circle:",
    "INFO": ":information_source:",
}
COUNT_HEADER = "### Summary\n\n| Severity | Count |\n|----------|-------|\n"
FILES_HEADER = "### Findings by File\n\n"
FILE_TABLE_HEADER = "| Line | Severity | Category | Description |\n|------|----------|----------|-------------|\n"
NO_FINDINGS = "### Findings\n\nNo issues found. :white_check_mark:\n\n"
AGENTS_HEADER = "### Agent Summary\n\n"


def escape_md(text: Column) -> Column:
    """Backslash before underscore, star and backtick; empty for null (RP5c)."""
    return F.coalesce(F.regexp_replace(text, r"([_*`])", r"\\$1"), F.lit(""))


def badge(severity: Column) -> Column:
    out = None
    for name, mark in SEVERITY_MARKS.items():
        text = f"{mark} {name}"
        out = F.when(severity == name, text) if out is None else out.when(severity == name, text)
    return out.otherwise("UNKNOWN")


def line_cell(start: Column, end: Column) -> Column:
    return (
        F.when(start <= 0, "-")
        .when(end > start, F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
        .otherwise(start.cast("string"))
    )


def finding_row(start: Column, end: Column, severity: Column, category: Column, description: Column) -> Column:
    """One table row of the report."""
    flat = ctrim(F.replace(description, F.lit("\n"), F.lit(" ")))
    return F.concat(
        F.lit("| "), line_cell(start, end), F.lit(" | "), badge(severity), F.lit(" | "),
        escape_md(F.coalesce(category, F.lit("-"))), F.lit(" | "),
        escape_md(F.coalesce(flat, F.lit("-"))), F.lit(" |\n"),
    )


def count_table(critical: Column, major: Column, minor: Column, info: Column) -> Column:
    parts = [F.lit(COUNT_HEADER)]
    for (name, mark), n in zip(SEVERITY_MARKS.items(), [critical, major, minor, info]):
        parts += [F.lit(f"| {mark} {name.capitalize()} | "), n.cast("string"), F.lit(" |\n")]
    return F.concat(*parts)


def _category_tag(category: Column) -> Column:
    return F.when(category.isNotNull(), F.concat(F.lit(" ["), category, F.lit("]"))).otherwise(F.lit(""))


def _comment_head(severity: Column, category: Column, title: Column) -> Column:
    return F.concat(
        F.lit("**"), text_or_null_word(severity), F.lit("**"), _category_tag(category), F.lit(": "),
        text_or_null_word(title), F.lit("\n\n"),
    )


def line_comment(severity: Column, category: Column, title: Column, description: Column, suggestion: Column) -> Column:
    """Body of a comment on a line; missing parts are left out (RP6)."""
    return F.concat(
        _comment_head(severity, category, title),
        F.when(not_blank(description), F.concat(description, F.lit("\n\n"))).otherwise(F.lit("")),
        F.when(not_blank(suggestion), F.concat(F.lit("**Suggestion:** "), suggestion)).otherwise(F.lit("")),
    )


def fallback_comment(
    severity: Column, category: Column, title: Column, path: Column, line: Column, description: Column
) -> Column:
    """Body of a general comment that names file and line (RP7)."""
    return F.concat(
        _comment_head(severity, category, title),
        F.lit("File: `"), path, F.lit(":"), line.cast("string"), F.lit("`\n\n"),
        F.coalesce(description, F.lit("")),
    )
