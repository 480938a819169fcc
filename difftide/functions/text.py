"""Text helpers with the trimming, splitting and matching rules the results depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a "control trim" removes, and what counts as blank text.
CONTROL_CHARS = "".join(map(chr, range(33)))
NOT_BLANK = r"[^\s\x1c-\x1f\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
# Length argument for "the rest of the array".
REST = 1 << 30

# Characters a regular-expression dot does not match.
LINE_ENDS = r"\n\r\x{85}\x{2028}\x{2029}"

# Mark put into a copy of a text while line numbers are counted; a text that already holds it gets the
# stand-in in that copy. Nothing that is reported is taken from the copy.
MARK, _STAND_IN = chr(0xE000), chr(0xE001)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it any number of times in `body`.

    Inside the lambda of an array function nothing is shared: an outer expression is evaluated again
    for each element. Binding it first keeps such expressions linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ctrim(text: Column) -> Column:
    """Strip every leading and trailing character up to U+0020 (not only spaces)."""
    return F.btrim(text, F.lit(CONTROL_CHARS))


def not_blank(text: Column) -> Column:
    """True when the text holds a non-whitespace character; false for null."""
    return F.coalesce(text.rlike(NOT_BLANK), F.lit(False))


def full_match(text: Column, pattern: str) -> Column:
    """Whole-string match (`rlike` alone only searches)."""
    return text.rlike(rf"\A(?:{pattern})\z")


def text_or_null_word(text: Column) -> Column:
    """Text for display where a missing value is printed as the word null."""
    return F.coalesce(text, F.lit("null"))


def lines_of(text: Column) -> Column:
    """All lines, trailing empty ones included."""
    return F.split(text, "\n")


def count_char(text: Column, char: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def marked_text(text: Column, pattern: str, replacement: str = MARK + "$0") -> Column:
    """A copy of the text with a mark in front of every match, for counting only."""
    clean = F.when(text.contains(MARK), F.replace(text, F.lit(MARK), F.lit(_STAND_IN))).otherwise(text)
    return F.regexp_replace(clean, pattern, replacement)


def _line_sums(marked: Column) -> Column:
    """Newlines in front of each mark, counted line by line."""
    per_line = F.transform(
        lines_of(marked), lambda line, i: F.when(line.contains(MARK), F.array_repeat(i, count_char(line, MARK)))
    )
    return F.flatten(F.array_compact(per_line))


def match_lines(text: Column, pattern: str, at_end: bool = False) -> Column:
    """Zero-based line on which each match starts (or ends), in order of occurrence.

    Linear in the text whatever the match count.
    """
    marked = marked_text(text, pattern, "$0" + MARK if at_end else MARK + "$0")
    return let(marked, lambda m: F.when(m.contains(MARK), _line_sums(m)).otherwise(F.array().cast("array<int>")))


def first_match_line(text: Column, pattern: str) -> Column:
    """One-based line of the first match; null without a match."""
    return let(
        F.regexp_instr(text, F.lit(pattern)),
        lambda at: F.when(at > 0, count_char(F.left(text, at - 1), "\n") + 1),
    )


def located_pieces(text: Column, pattern: str, group: int | None = 0) -> Column:
    """Every match as (line, before, value): start line from 0, text since the last match, the group's text.

    The `before` texts up to a match put together are all the text in front of it, for searching and
    counting; `value` is taken from the text itself, and left out without a group.
    """

    def from_marked(marked: Column) -> Column:
        def zipped(pieces: Column) -> Column:
            return F.arrays_zip(
                _line_sums(marked).alias("line"),
                F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("before"),
                *([] if group is None else [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")]),
            )

        return F.when(marked.contains(MARK), let(F.split(marked, MARK), zipped)).otherwise(F.array())

    return let(marked_text(text, pattern), from_marked)
