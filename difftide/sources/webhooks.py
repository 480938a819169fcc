"""Webhook archives (SR1-SR3) and report files (SR7).

Raw tables hold one delivery per row: `delivery_id`, `received_at`, `body` and, for the signed
feeds, `signature`. All three readers are row-local, so they work on batch tables and on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from difftide import schemas

_BAD = "_bad_record"

# The keys a strict comment payload may hold, per object.
COMMENT_KEYS = {
    "$": ["action", "issue", "comment", "repository"],
    "$.issue": ["number"],
    "$.comment": ["body"],
    "$.repository": ["full_name"],
}


def _parse(body: Column, schema: T.StructType) -> Column:
    with_bad = T.StructType(schema.fields + [T.StructField(_BAD, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    return F.from_json(body, with_bad, options)


def _is_object(body: Column) -> Column:
    return F.coalesce(body.rlike(r"\A\s*\{"), F.lit(False))


def _with_payload(df_raw: DataFrame, schema: T.StructType, usable) -> DataFrame:
    """Add `payload` (null when unusable) and `parse_error`."""
    parsed = df_raw.withColumn("payload", _parse(F.col("body"), schema))
    ok = _is_object(F.col("body")) & F.col(f"payload.{_BAD}").isNull() & usable(F.col("payload"))
    return (
        parsed.withColumn("parse_error", F.when(~F.coalesce(ok, F.lit(False)), "Invalid payload"))
        .withColumn("payload", F.when(F.col("parse_error").isNull(), F.col("payload").dropFields(_BAD)))
    )


def _int_or_missing(number: Column) -> Column:
    return number.isNull() | number.try_cast("int").isNotNull()


def read_pr_webhooks(df_raw: DataFrame) -> DataFrame:
    """PR deliveries with typed payload columns (SR1)."""
    df = _with_payload(df_raw, schemas.PR_PAYLOAD, lambda p: _int_or_missing(p["number"]))
    p = F.col("payload")
    return df.select(
        *[c for c in df_raw.columns],
        p["action"].alias("action"),
        F.coalesce(p["number"].cast("int"), F.lit(0)).alias("number"),
        p["pull_request"].alias("pull_request"),
        p["repository"].alias("repository"),
        "parse_error",
    )


def read_push_webhooks(df_raw: DataFrame) -> DataFrame:
    """Push deliveries with typed payload columns (SR2)."""
    df = _with_payload(df_raw, schemas.PUSH_PAYLOAD, lambda p: F.lit(True))
    names = ["ref", "before", "after", "repository", "pusher", "head_commit", "commits"]
    return df.select(
        *[c for c in df_raw.columns], *[F.col("payload")[n].alias(n) for n in names], "parse_error",
    )


def _only_known_keys(body: Column) -> Column:
    """Strict rule: no object holds a key outside the known set."""
    ok = F.lit(True)
    for path, known in COMMENT_KEYS.items():
        part = body if path == "$" else F.get_json_object(body, path)
        extra = F.array_except(F.json_object_keys(part), F.array(*[F.lit(k) for k in known]))
        ok = ok & (F.coalesce(F.size(extra), F.lit(0)) <= 0)
    return ok


def read_comment_webhooks(df_raw: DataFrame, strict: bool = False) -> DataFrame:
    """Comment deliveries: repository, PR number and comment text (SR3).

    `action` is parsed and kept but never filtered on. With `strict`, a payload with any unknown
    field counts as unparsable, as for a reader that rejects unknown properties.
    """
    df = _with_payload(
        df_raw, schemas.COMMENT_PAYLOAD, lambda p: _int_or_missing(p["issue"]["number"])
    )
    if strict:
        bad = F.col("parse_error").isNull() & ~_only_known_keys(F.col("body"))
        df = df.withColumn("parse_error", F.when(bad, "Invalid payload").otherwise(F.col("parse_error")))
        df = df.withColumn("payload", F.when(F.col("parse_error").isNull(), F.col("payload")))
    p = F.col("payload")
    repo = F.when(p["repository"].isNull(), "unknown").otherwise(
        F.coalesce(p["repository"]["full_name"], F.lit("null"))
    )
    return df.select(
        *[c for c in df_raw.columns if c != "body"],
        p["action"].alias("action"),
        F.when(p.isNotNull(), repo).alias("repo_name"),
        F.when(p.isNotNull(), F.coalesce(p["issue"]["number"].cast("int"), F.lit(0))).alias("pr_number"),
        p["comment"]["body"].alias("body"),
        "parse_error",
    )


def _report_name(files: DataFrame) -> Column:
    return F.col("file_name") if "file_name" in files.columns else F.element_at(F.split(F.input_file_name(), "/"), -1)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files as (file_name, markdown), one row per file (SR7).

    Reads plain files as well as the folders that `outputs.write_report_files` leaves. A report above 2 GB does not
    fit a row; `read_report_lines` reads those too.
    """
    texts = spark.read.text(path, wholetext=True)
    named = texts.select(_report_name(texts).alias("file_name"), F.col("value").alias("markdown"), *[c for c in texts.columns if c == "block"])
    if "block" not in texts.columns:
        return named
    blocks = named.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("block", "markdown"))).alias("_blocks"))
    return blocks.select("file_name", F.array_join(F.transform("_blocks", lambda b: b["markdown"]), "").alias("markdown"))


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of report files as (file_name, place, line), whatever the size of a file; `place` orders them (SR7).

    Large files are read in splits. A line's place is its block, the offset of its split, and its row there.
    """
    lines = spark.read.text(path, lineSep="\n")
    block = F.col("block") if "block" in lines.columns else F.lit(0)
    place = F.struct(
        block.cast("long").alias("block"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
    )
    return lines.select(_report_name(lines).alias("file_name"), place.alias("place"), F.col("value").alias("line"))
