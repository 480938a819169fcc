"""Column rules for webhook fields and feedback directives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from difftide.functions.text import ctrim, full_match, text_or_null_word

# Fixed values.
ACTION_EVENTS = {"opened": "PR_OPENED", "synchronize": "PR_SYNCHRONIZED", "closed": "PR_CLOSED"}
ALL_ZEROS = "0+"
COMPARE_HOST = "https://api.github.com/repos/"
DIRECTIVE = r"(?i)\A/feedback\s+(accept|dismiss)\s+(\S+)(?:\s+(\S+))?(?:\s+(\d+))?\s*\z"
AGENT_WORDS = {
    "security": ["SQL", "XSS", "SECURITY", "INJECTION", "AUTH"],
    "logic": ["NULL", "NPE", "LOGIC", "CONDITION", "BOUND"],
    "codestyle": ["STYLE", "FORMAT", "NAMING", "CONVENTION"],
    "architecture": ["ARCH", "LAYER", "CIRCULAR", "DEPENDENCY", "COUPLING"],
}


def map_trigger(action: Column) -> Column:
    """Review trigger of a PR action; null when the action is not supported (EV2)."""
    out = None
    for name, event in ACTION_EVENTS.items():
        out = F.when(action == name, event) if out is None else out.when(action == name, event)
    return out


def is_all_zeros(sha: Column) -> Column:
    return F.coalesce(full_match(sha, ALL_ZEROS), F.lit(False))


def branch_name(ref: Column) -> Column:
    """Ref without its heads/tags prefix; empty for a missing ref (EV5)."""
    return F.coalesce(F.regexp_replace(ref, r"\Arefs/(?:heads|tags)/", ""), F.lit(""))


def compare_url(repo: Column, before: Column, after: Column) -> Column:
    """Compare address of a push; empty without a repository or for a new branch (EV6)."""
    url = F.concat(
        F.lit(COMPARE_HOST), repo, F.lit("/compare/"), text_or_null_word(before), F.lit("..."),
        text_or_null_word(after),
    )
    return F.when(repo.isNull() | is_all_zeros(before), F.lit("")).otherwise(url)


def derive_agent_type(category: Column) -> Column:
    """Agent a rule category belongs to: the first group with a contained word wins (EV11)."""
    upper = F.upper(category)
    out = None
    for agent, words in AGENT_WORDS.items():
        hit = upper.rlike("|".join(words))
        out = F.when(hit, agent) if out is None else out.when(hit, agent)
    return out.otherwise("unknown")


def directive_of(body: Column) -> Column:
    """Feedback directive of a comment as a struct; null when the comment is none (EV10).

    A single trailing token is the path even when it is all digits. A line number beyond the int
    range makes the directive unusable, so it is dropped as well.
    """
    text = ctrim(body)
    verb = F.lower(F.regexp_extract(text, DIRECTIVE, 1))
    line_text = F.regexp_extract(text, DIRECTIVE, 4)
    line = F.when(line_text == "", F.lit(0)).otherwise(line_text.try_cast("int"))
    category = F.regexp_extract(text, DIRECTIVE, 2)
    directive = F.struct(
        F.when(verb == "accept", "ACCEPTED").otherwise("DISMISSED").alias("feedback"),
        category.alias("rule_category"),
        derive_agent_type(category).alias("agent_type"),
        F.nullif(F.regexp_extract(text, DIRECTIVE, 3), F.lit("")).alias("file_path"),
        line.alias("line_start"),
    )
    # The plain prefix test spares ordinary comments the pattern.
    could = F.lower(F.left(text, F.lit(len("/feedback")))) == "/feedback"
    return F.when(could & text.rlike(DIRECTIVE) & line.isNotNull(), directive)
