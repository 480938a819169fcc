"""Diff texts to files, hunks, lines, imports and contexts (DF1-DF11).

Every operator works inside one diff row: a text is cut with array functions and, at most, exploded.
Nothing is regrouped, so none of these operators shuffles, however many files one diff holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difftide.functions.rows import keep
from difftide.functions.text import LINE_ENDS, REST, ctrim, let, lines_of, not_blank

# Marks of the unified diff format.
SECTION_START = r"(?m)(?=^diff --git )"
NEW_SIDE = r"(?m)^\+\+\+\s+b/.*$"
OLD_SIDE = r"(?m)^---\s+a/.*$"
PATH_FALLBACK = r"(?m)^diff --git a/(.*)\s+b/.*$"
NO_FILE = "/dev/null"
CHANGE_PHRASES = {"new file mode": "ADDED", "deleted file mode": "DELETED", "rename from": "RENAMED"}
HUNK_HEADER = (
    r"@@[^\S\n]+-?(\d+)(?:,(\d+))?[^\S\n]+\+?(\d+)(?:,(\d+))?[^\S\n]+@@[^" + LINE_ENDS + r"]*"
)
KEPT_LINE = r"\n(?:[+\- ]|\\ )"
IMPORT_LINE = r"(?m)^[+-]?import\s+(?:static\s+)?([a-zA-Z0-9_.]+)\s*;\s*$"
EXTENSION = r"(?s)(\.[^.]*)\z"


# -- column expressions on one section -------------------------------------------------------
def sections(body: Column) -> Column:
    """File sections of a diff; text before the first marker is a section of its own (DF1)."""
    return F.filter(F.split(body, SECTION_START), not_blank)


def file_path(section: Column) -> Column:
    """Path of a section: new side, old side, then the git line; null when there is none (DF2)."""

    def side(pattern: str, mark: str) -> Column:
        # `regexp_substr` and `nullif` evaluate what they are given twice, so both are spelled out over a bound value.
        row = F.regexp_extract(section, pattern, 0)
        path = let(row, lambda r: F.when(r != "", ctrim(F.substring(r, F.instr(r, mark) + 2, F.length(r)))))
        return let(path, lambda p: F.when(p != NO_FILE, p))

    git = F.when(
        section.rlike(PATH_FALLBACK), ctrim(F.regexp_extract(section, PATH_FALLBACK, 1))
    )
    return F.coalesce(side(NEW_SIDE, "b/"), side(OLD_SIDE, "a/"), git)


def change_type(section: Column) -> Column:
    """Change type by phrase, wherever in the section it stands (DF3)."""
    out = None
    for phrase, name in CHANGE_PHRASES.items():
        hit = section.contains(phrase)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("MODIFIED")


def line_count(section: Column, sign: str) -> Column:
    """Lines that start with the sign but not with three of them (DF4)."""
    counted = F.filter(
        lines_of(section), lambda l: l.startswith(sign) & ~l.startswith(sign * 3)
    )
    return F.size(counted)


def imports_of(section: Column) -> Column:
    """Distinct imported names in first-seen order (DF8)."""
    return F.array_distinct(F.regexp_extract_all(section, F.lit(IMPORT_LINE), F.lit(1)))


def file_extension(path: Column) -> Column:
    """From the last dot of the whole path on; null without a dot (DF9)."""
    return F.nullif(F.regexp_extract(path, EXTENSION, 1), F.lit(""))


def hunk_pieces(section: Column) -> Column:
    """Texts of the hunks of a section, header line first; hunks without a kept line are left out.

    The section is cut in front of each header line, so whatever precedes the first one goes.
    """
    cut = F.split(F.concat(F.lit("\n"), section), rf"\n(?={HUNK_HEADER}(?:\n|\z))")
    return F.filter(F.slice(cut, 2, REST), lambda piece: piece.rlike(KEPT_LINE))


def parse_hunk(piece: Column) -> Column:
    """Numbers, rebuilt header and kept lines of one hunk text (DF6).

    Counts that are missing or beyond the int range become 1. The header is the whole first line, so one match gives all four.
    """
    head = F.substring_index(piece, "\n", 1)
    groups = F.split(F.regexp_replace(head, HUNK_HEADER, "$1,$2,$3,$4"), ",")

    def kept(line: Column) -> Column:
        return line.startswith("+") | line.startswith("-") | line.startswith(" ") | line.startswith("\\ ")

    names = ["old_start", "old_lines", "new_start", "new_lines"]
    numbers = let(groups, lambda g: F.struct(*[F.coalesce(F.get(g, F.lit(i)).try_cast("int"), F.lit(1)).alias(n) for i, n in enumerate(names)]))
    lines = F.filter(F.slice(lines_of(piece), 2, REST), kept)
    return let(
        numbers,
        lambda n: F.struct(
            *[n[c].alias(c) for c in names],
            F.concat(
                F.lit("@@ -"), n["old_start"].cast("string"), F.lit(","), n["old_lines"].cast("string"),
                F.lit(" +"), n["new_start"].cast("string"), F.lit(","), n["new_lines"].cast("string"),
                F.lit(" @@"),
            ).alias("header"),
            lines.alias("lines"),
        ),
    )


# -- tables ----------------------------------------------------------------------------------
def diff_sections(diffs: DataFrame) -> DataFrame:
    """One row per file section of a diff, numbered from 1 (DF1)."""
    return diffs.select("task_id", "pr_id", F.posexplode(sections(F.col("body"))).alias("pos", "section")).select(
        "task_id", "pr_id", (F.col("pos") + 1).alias("file_seq"), "section"
    )


def changed_files(diffs: DataFrame) -> DataFrame:
    """One row per changed file; sections without a path are dropped (DF5)."""
    located = F.filter(
        F.transform(
            sections(F.col("body")),
            lambda s, i: F.struct(
                (i + 1).alias("file_seq"), file_path(s).alias("file_path"), s.alias("diff_content")
            ),
        ),
        lambda f: f["file_path"].isNotNull(),
    )
    text = F.col("diff_content")
    return diffs.select("task_id", "pr_id", F.inline(located)).select(
        "task_id", "pr_id", "file_seq", "file_path",
        change_type(text).alias("change_type"),
        line_count(text, "+").alias("additions"),
        line_count(text, "-").alias("deletions"),
        "diff_content",
    )


def changed_paths(diffs: DataFrame) -> DataFrame:
    """All changed paths of a task as one text, a path per line."""
    named = F.transform(sections(F.col("body")), file_path)
    return diffs.select("task_id", F.array_join(F.array_compact(named), "\n").alias("paths"))


def hunks(files: DataFrame) -> DataFrame:
    """One row per hunk of a changed file, numbered from 1 (DF6)."""
    keys = ["task_id", "pr_id", "file_seq", "file_path"]
    pieces = files.select(*keys, F.posexplode(hunk_pieces(F.col("diff_content"))).alias("pos", "piece"))
    rows = pieces.select(*keys, (F.col("pos") + 1).alias("hunk_seq"), parse_hunk(F.col("piece")).alias("h"))
    return rows.select(
        "task_id", "pr_id", "file_seq", "hunk_seq", "file_path", "h.old_start", "h.new_start",
        "h.old_lines", "h.new_lines", "h.header", "h.lines",
    )


def hunk_lines(hunk_rows: DataFrame) -> DataFrame:
    """One row per kept line of a hunk, with its position from 1 (DF7)."""
    return hunk_rows.select(
        "task_id", "pr_id", "file_seq", "hunk_seq", "file_path",
        # An expression and not the bare column: for that a size filter would be added below the
        # parsing, which would then run twice.
        F.posexplode(F.slice("lines", 1, REST)).alias("pos", "line"),
    ).withColumn("pos", F.col("pos") + 1)


def file_imports(files: DataFrame) -> DataFrame:
    """Changed files with their distinct imports; files without any are left out (DF8)."""
    keys = ["task_id", "pr_id", "file_seq", "file_path"]
    rows = files.select(*keys, imports_of(F.col("diff_content")).alias("imports"))
    return keep(rows, F.size("imports") > 0, *keys, "imports")


def extension_counts(files: DataFrame) -> DataFrame:
    """Changed files and lines per extension (DF9)."""
    return files.groupBy(file_extension(F.col("file_path")).alias("extension")).agg(
        F.count("*").alias("files"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
    )


def dependency_edges(files: DataFrame) -> DataFrame:
    """One row per (changed file, imported name) (DF10)."""
    return files.select(
        "task_id", "pr_id", "file_seq", "file_path",
        F.explode(imports_of(F.col("diff_content"))).alias("imported"),
    )


def _file_array(body: Column) -> Column:
    """Changed files of a whole diff, without their texts."""

    def describe(section: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("file_seq"),
            file_path(section).alias("file_path"),
            change_type(section).alias("change_type"),
            line_count(section, "+").alias("additions"),
            line_count(section, "-").alias("deletions"),
            imports_of(section).alias("imports"),
            F.transform(hunk_pieces(section), parse_hunk).alias("hunks"),
        )

    every = F.transform(sections(F.coalesce(body, F.lit(""))), describe)
    return F.filter(every, lambda f: f["file_path"].isNotNull())


def dependency_text(files: Column) -> Column:
    """Dependency text of one diff's file array (DF10).

    A path that occurs twice keeps its first place and its last imports; only then is the array
    searched per path.
    """
    extensions = F.array_compact(
        F.array_distinct(F.transform(files, lambda f: file_extension(f["file_path"])))
    )

    def row(path: Column, imports: Column) -> Column:
        return F.concat(F.lit("  "), path, F.lit(" imports: "), F.array_join(imports, ", "), F.lit("\n"))

    def with_paths(importing: Column, paths: Column) -> Column:
        unique = F.transform(importing, lambda f: row(f["file_path"], f["imports"]))
        repeated = F.transform(
            paths,
            lambda p: row(p, F.element_at(F.filter(importing, lambda f: f["file_path"] == p), -1)["imports"]),
        )
        rows = F.when(F.size(paths) == F.size(importing), unique).otherwise(repeated)
        listed = F.concat(F.lit("Dependencies:\n"), F.array_join(rows, ""))
        return F.when(F.size(importing) > 0, listed).otherwise(F.lit(""))

    dependencies = let(
        F.filter(files, lambda f: F.size(f["imports"]) > 0),
        lambda importing: let(
            F.array_distinct(F.transform(importing, lambda f: f["file_path"])),
            lambda paths: with_paths(importing, paths),
        ),
    )
    text = F.concat(F.lit("File extensions: "), F.array_join(extensions, ", "), F.lit("\n"), dependencies)
    return F.when(F.size(files) == 0, F.lit("")).otherwise(text)


def contexts(diffs: DataFrame) -> DataFrame:
    """Review context of every task: file array, hunks, dependency text, history (DF11).

    A task with an empty diff keeps its row, with empty arrays and texts. The history is always
    empty.
    """
    with_files = diffs.select("task_id", "pr_id", _file_array(F.col("body")).alias("files"))
    return with_files.select(
        "task_id", "pr_id",
        F.transform(
            "files",
            lambda f: F.struct(
                f["file_seq"].alias("file_seq"), f["file_path"].alias("file_path"),
                f["change_type"].alias("change_type"), f["additions"].alias("additions"),
                f["deletions"].alias("deletions"),
            ),
        ).alias("changed_files"),
        F.flatten(
            F.transform(
                "files",
                lambda f: F.transform(
                    f["hunks"],
                    lambda h: F.struct(
                        f["file_path"].alias("file_path"), h["header"].alias("header"),
                        h["lines"].alias("lines"),
                    ),
                ),
            )
        ).alias("diff_blocks"),
        dependency_text(F.col("files")).alias("dependency_graph"),
        F.lit("").alias("related_history"),
    )


def dependency_graph(diffs: DataFrame) -> DataFrame:
    """Dependency text per task (DF10)."""
    return contexts(diffs).select("task_id", "pr_id", "dependency_graph")
