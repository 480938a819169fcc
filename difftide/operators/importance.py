"""Which changed files the others of a review rely on: link analysis over its import graph (DX2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from difftide.operators.diffs import dependency_edges
from difftide.session import CLEANUP, job_settings, shared_folder

# Scores are whole numbers, so sums don't depend on their order. A file has FLOOR, and passes PERCENT of its score on
# to the files that it imports, in equal shares.
START, FLOOR, PERCENT, ROUNDS = 1_000_000, 150_000, 85, 5

JOB = {"spark.sql.requireAllClusterKeysForCoPartition": "false", **CLEANUP}


def import_links(files: DataFrame) -> DataFrame:
    """(task_id, importing, imported): file numbers of a changed file and another of its review that it imports.

    A file goes by every name that its path ends in: `a/b/C.java` by `C`, `b.C` and `a.b.C`. An import means the files
    that go by its name or, for members of a class, by the name without its last part. A link counts once. Only
    names move, never texts. All names of a file end alike, so a file moves once, to the last part of its names in its
    review, and is given its names there; `stored_links` lets the join use that. Rows of one last part in a review meet in one task.
    """
    path = F.regexp_replace("file_path", r"\.[^./]*$", "")
    named = F.transform(F.sequence(F.lit(1), F.size(F.split("_path", "/"))), lambda n: F.replace(F.call_function("substring_index", "_path", F.lit("/"), -n), F.lit("/"), F.lit(".")))
    last = lambda name: F.substring_index(name, ".", -1).alias("_last")
    known = files.select("task_id", F.col("file_seq").alias("imported"), path.alias("_path"), last(F.replace(path, F.lit("/"), F.lit("."))))
    known = known.repartition("task_id", "_last").select("task_id", "_last", "imported", F.explode(named).alias("name"))
    outer = F.regexp_extract("imported", r"^(.+\..+)\.[^.]*$", 1)
    asked = dependency_edges(files).select("task_id", F.col("file_seq").alias("importing"), F.explode(F.array("imported", outer)).alias("name"))
    asked = asked.where("name <> ''").select("*", last(F.col("name"))).repartition("task_id", "_last")
    met = asked.join(known.hint("merge"), ["task_id", "_last", "name"]).where(F.col("importing") != F.col("imported"))
    return met.select("task_id", "importing", "imported").repartition("task_id", "importing").distinct()


def stored_links(files: DataFrame) -> DataFrame:
    """The links of the files with the number `out` that the importing file has, written once to the shared folder.

    Joined sides that lie by some of their keys needn't move again, and shuffle files go once the links are written: settings
    for this job alone, which are put back.
    """
    spark, path = files.sparkSession, shared_folder(files.sparkSession, "import-links")
    out = F.count("*").over(Window.partitionBy("task_id", "importing"))
    with job_settings(spark, JOB):
        import_links(files).withColumn("out", out).write.parquet(path)
    return spark.read.parquet(path)


def file_importance(files: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every file with the number of its importers in the review and its importance after `rounds` rounds.

    A round is a join and an aggregate over links of three numbers, keyed by file, so one huge review is spread over
    tasks. Files that nobody imports have FLOOR from the first round on and are not carried along. The links are
    written once to the shared folder. Without links every file has FLOOR.
    """
    links = stored_links(files)
    given = F.floor(F.col("score") * PERCENT / (F.col("out") * 100)).cast("long")
    passing = links.withColumn("score", F.lit(START))
    for left in range(rounds, 0, -1):
        found = passing.groupBy("task_id", "imported").agg((F.sum(given) + FLOOR).alias("score"), F.count("*").alias("importers"))
        if left > 1:
            scores = found.select("task_id", F.col("imported").alias("importing"), "score")
            passing = links.join(scores.hint("merge"), ["task_id", "importing"], "left").fillna(FLOOR, ["score"])
    ranked = found.withColumnRenamed("imported", "file_seq").hint("merge")
    rows = files.select("task_id", "pr_id", "file_seq", "file_path").join(ranked, ["task_id", "file_seq"], "left")
    return rows.select(
        "task_id", "pr_id", "file_seq", "file_path",
        F.coalesce("importers", F.lit(0)).cast("long").alias("importers"), F.coalesce("score", F.lit(FLOOR)).cast("long").alias("importance"),
    )
