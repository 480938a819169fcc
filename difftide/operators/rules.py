"""Common contract of the rule scans.

There are two kinds of rules. A line rule looks at one line (`LineRule`); a text rule is a function
from a whole text to an array of hits. `scan` runs any number of both over a table of texts in one
row-local pass: every file yields its whole text and its lines as rows of one generator, and each
row is given to the rules of its kind. Nothing is shuffled. Line rules are plain column expressions
on exploded rows, because those are compiled, while array lambdas are interpreted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difftide.functions.text import lines_of, not_blank

HIT_TYPE = "array<struct<line_number:int,rule:string,description:string>>"

TextRule = Callable[[Column], Column]


@dataclass(frozen=True)
class LineRule:
    """At most one hit per line.

    A line is tested for one of the plain `words` first, then `matches` decides. `describe` gets the
    line and its number.
    """

    rule: str
    words: Sequence[str]
    matches: Callable[[Column], Column]
    describe: Callable[[Column, Column], Column]

    def fires(self, line: Column) -> Column:
        return any_of(line, self.words) & self.matches(line) if self.words else self.matches(line)

    def hit(self, line: Column, number: Column) -> Column:
        return hit(number, self.rule, self.describe(line, number))


Rule = LineRule | TextRule


def any_of(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def starts_with_any(text: Column, marks: Sequence[str]) -> Column:
    out = text.startswith(marks[0])
    for mark in marks[1:]:
        out = out | text.startswith(mark)
    return out


def trimmed_starts_with_any(line: Column, marks: Sequence[str]) -> Column:
    """`starts_with_any` of the text without its leading control characters and spaces, in one match."""
    return line.rlike(r"\A[\x00-\x20]*+(?:" + "|".join(rf"\Q{m}\E" for m in marks) + ")")


def no_hits() -> Column:
    return F.array().cast(HIT_TYPE)


def hit(line_number: Column, rule: str, description: Column | str) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(
        line_number.cast("int").alias("line_number"), F.lit(rule).alias("rule"), text.alias("description")
    )


def at_line(before: str, number: Column, after: str) -> Column:
    """Description text with a number in the middle."""
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def guarded(text: Column, words: Sequence[str], hits: Column) -> Column:
    """Evaluate a text rule only for texts with one of the words it cannot match without."""
    return F.when(any_of(text, words), hits).otherwise(no_hits())


_HIT = ["line_number", "rule", "description"]


def scan(files: DataFrame, rules: Sequence[Rule], keep_position: bool = False) -> DataFrame:
    """All hits of the rules on the column `diff_content` (or `content`) of a file table.

    Blank texts have no hits. With `keep_position`, `hit_rule` and `hit_place` order the hits of one
    file by rule and then by place.
    """
    name = "diff_content" if "diff_content" in files.columns else "content"
    keys = [c for c in ("task_id", "pr_id", "file_seq", "file_path") if c in files.columns]
    whole = [(i, r) for i, r in enumerate(rules) if not isinstance(r, LineRule)]
    lined = [(i, r) for i, r in enumerate(rules) if isinstance(r, LineRule)]
    text = F.col(name)

    # Row 0 of a file is its whole text, row n its nth line.
    units = F.concat(F.array(text), lines_of(text)) if lined else F.array(text)
    unit, part, fired = F.col("_unit"), F.col("_text"), F.col("_fired")
    rows = files.where(not_blank(text)).select(*keys, F.posexplode(units).alias("_unit", "_text"))

    # The patterns run once per line, into one number with a bit per rule. It is a column of its own
    # (and not a filter, which would be evaluated again below it); a line without any hit then has
    # no array to generate rows from.
    bits = F.lit(0)
    for bit, (_, rule) in enumerate(lined):
        bits = bits + F.when(rule.fires(part), 1 << bit).otherwise(0)
    rows = rows.withColumn("_fired", F.when(unit > 0, bits).otherwise(0))

    def line_hit(bit: int, order: int, rule: LineRule) -> Column:
        found = rule.hit(part, unit)
        if keep_position:
            found = F.struct(F.lit(order).alias("hit_rule"), unit.alias("hit_place"), *[found[c].alias(c) for c in _HIT])
        return F.when(fired.bitwiseAND(1 << bit) != 0, found)

    def text_hits(order: int, rule: TextRule) -> Column:
        if not keep_position:
            return rule(part)
        return F.transform(
            rule(part),
            lambda h, i: F.struct(F.lit(order).alias("hit_rule"), i.alias("hit_place"), *[h[c].alias(c) for c in _HIT]),
        )

    in_text = F.concat(*[text_hits(i, r) for i, r in whole]) if whole else None
    in_line = F.array(*[line_hit(b, i, r) for b, (i, r) in enumerate(lined)]) if lined else None
    some = fired != 0
    if in_line is None or in_text is None:
        found = in_text if in_line is None else F.when(some, in_line)
    else:
        found = F.when(unit == 0, in_text).when(some, in_line)
    return rows.select(*keys, F.inline(found)).where(F.col("rule").isNotNull())
