"""Work that is done once across runs: a ledger of reviewed hunks (DX1) and a cache of rule hits (DX4).

Both are append-only folders with one subfolder for each run. A run reads what earlier runs have written and replaces its own subfolder, so
a run that is repeated after a failure gives the same. Neither moves texts: keys are hashes made where the text lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from difftide.operators.rules import HIT_TYPE, Rule, scan

HUNK = ["pr_id", "file_path", "hunk_hash", "occurrence"]
_LEDGER = "task_id long, pr_id string, file_seq int, hunk_seq int, file_path string, header string, hunk_hash string, occurrence int"
_CACHE = f"content_hash string, version string, scanned_at timestamp, hits {HIT_TYPE}"

BITS_PER_KEY = 16  # of the pre-filter: one in sixteen of the other files passes it
MOST_BITS = 1 << 26  # 8 MB; beyond some 4 million new contents more files pass the pre-filter, with the same result
_BITMAP = 32768  # bits that one row of bitmap_construct_agg holds


def _runs(spark: SparkSession, folder: str, schema: str, before: int) -> DataFrame:
    """What the runs before a run have written."""
    try:
        rows = spark.read.schema(f"{schema}, run long").parquet(folder)
    except AnalysisException:  # no run yet
        return spark.createDataFrame([], schema)
    return rows.where(F.col("run") < before).drop("run")


# -- reviewed hunks ----------------------------------------------------------------------------
def hunk_identities(hunks: DataFrame) -> DataFrame:
    """Keys of hunks with an identity that survives shifted lines and changed surroundings.

    `hunk_hash` covers the added and removed lines with their signs; line numbers and context lines don't count. Hunks of a file that
    change the same lines the same way are numbered in order of place (`occurrence`, from 1). The lines themselves are left out.
    """
    changed = F.filter("lines", lambda line: line.startswith("+") | line.startswith("-"))
    keys = hunks.select(
        "task_id", "pr_id", "file_seq", "hunk_seq", "file_path", "header",
        F.sha2(F.array_join(F.transform(changed, lambda line: F.concat(F.length(line).cast("string"), F.lit(":"), line)), ""), 256).alias("hunk_hash"),
    )
    alike = Window.partitionBy("task_id", "file_path", "hunk_hash").orderBy("file_seq", "hunk_seq")
    return keys.withColumn("occurrence", F.row_number().over(alike))


def unreviewed_hunks(hunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Identified hunks that no earlier push of their PR has brought (DX1).

    `ledger` holds the reviewed identities. A hunk that several pushes in `hunks` bring belongs to the first of them (smallest
    `task_id`), so pushes may come together. Hunks are cut and hashed once: the first push is found among the keys that have moved.
    """
    keys = hunk_identities(hunks)
    # A key that lacks a part is like no other. This isn't a filter, which would be evaluated below the hashing as well.
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in HUNK])
    first = F.min(F.when(whole, F.col("task_id"))).over(Window.partitionBy(*HUNK))
    brought = keys.withColumn("_first", first).where(F.col("task_id") == F.col("_first"))
    return brought.join(ledger.select(*HUNK), HUNK, "left_anti").select(*keys.columns)


def review_push(hunks: DataFrame, ledger_dir: str, run: int) -> DataFrame:
    """The hunks of a run's pushes that need a review; they are in the ledger afterwards (DX1)."""
    spark, mine = hunks.sparkSession, f"{ledger_dir}/run={run}"
    unreviewed_hunks(hunks, _runs(spark, ledger_dir, _LEDGER, run)).write.mode("overwrite").parquet(mine)
    return spark.read.schema(_LEDGER).parquet(mine)


# -- rule hits -----------------------------------------------------------------------------------
def content_keys(files: DataFrame) -> DataFrame:
    """Files by the hash of their text, without it."""
    return files.select("task_id", "pr_id", "file_seq", "file_path", F.sha2("diff_content", 256).alias("content_hash"))


def new_contents(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """(content_hash, task_id, file_seq): of each content that is not cached, the file to scan, the smallest one."""
    smallest = F.min(F.struct("task_id", "file_seq"))
    return keys.groupBy("content_hash").agg(smallest.alias("at")).join(cached, "content_hash", "left_anti").select("content_hash", "at.*")


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("task_id", "file_seq"), F.lit(bits))


def prefilter(wanted: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A bitmap over the (task_id, file_seq) of `wanted` in rows (part, bitmap), and its size in bits: at most MOST_BITS."""
    bits = min(MOST_BITS, max(_BITMAP, 1 << math.ceil(math.log2(max(1, count * BITS_PER_KEY)))))
    place = wanted.select(_place(bits).alias("place"))
    parts = place.groupBy(F.floor(F.col("place") / _BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("place") % _BITMAP).alias("bitmap"))
    return parts, bits


def hits_of(files: DataFrame, rules: Sequence[Rule], wanted: DataFrame, count: int) -> DataFrame:
    """(content_hash, hits) of the wanted files: each is scanned where it lies.

    The files that pass the bitmap, which is broadcast (8 MB at most), are scanned; of their hits those of wanted files are kept. So
    only keys and hits are exchanged, and what passes the bitmap by chance costs a scan and nothing else.
    """
    bitmap, bits = prefilter(wanted, count)
    place = files.select("task_id", "pr_id", "file_seq", "file_path", "diff_content", _place(bits).alias("_place"))
    spot = F.col("_place") % _BITMAP
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (F.floor(byte / F.pow(F.lit(2), spot % 8)).cast("int") % 2) == 1
    near = place.join(F.broadcast(bitmap), F.floor(F.col("_place") / _BITMAP).cast("int") == F.col("part")).where(marked)
    hits = scan(near.select("task_id", "pr_id", "file_seq", "file_path", "diff_content"), rules, keep_position=True)
    found = hits.groupBy("task_id", "file_seq").agg(F.array_sort(F.collect_list(F.struct("hit_rule", "hit_place", "line_number", "rule", "description"))).alias("_hits"))
    one = F.transform(F.coalesce("_hits", F.array().cast(found.schema["_hits"].dataType)), lambda h: F.struct(h["line_number"].alias("line_number"), h["rule"].alias("rule"), h["description"].alias("description")))
    return wanted.join(found, ["task_id", "file_seq"], "left").select("content_hash", one.alias("hits"))


def cached_scan(files: DataFrame, rules: Sequence[Rule], version: str, cache_dir: str, run: int, now: datetime, period: timedelta) -> DataFrame:
    """Rule hits of all files, where a content is scanned at most once in a period (DX4).

    `version` names the rules: hits of another version don't count. Entries older than `now` less `period` don't either, so such
    contents are scanned anew. What a run scans lies in its own subfolder, contents without a hit included. Only hits of one content
    are gathered, as the rows of one file are. Texts that are null or blank have no hits.
    """
    spark = files.sparkSession
    since = (F.col("version") == version) & (F.col("scanned_at") > F.lit(now - period)) & (F.col("scanned_at") <= F.lit(now))
    known = _runs(spark, cache_dir, _CACHE, run).where(since).groupBy("content_hash").agg(F.max_by("hits", "scanned_at").alias("hits"))
    keys = content_keys(files.where(F.col("diff_content").isNotNull()))
    wanted = new_contents(keys, known)
    fresh = hits_of(files, rules, wanted, wanted.count())
    mine = f"{cache_dir}/run={run}"
    fresh.select("content_hash", F.lit(version).alias("version"), F.lit(now).alias("scanned_at"), "hits").write.mode("overwrite").parquet(mine)
    scanned = spark.read.schema(_CACHE).parquet(mine).select("content_hash", "hits")
    return keys.join(known.unionByName(scanned), "content_hash").select("task_id", "pr_id", "file_seq", "file_path", F.inline("hits"))
