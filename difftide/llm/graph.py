"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difftide.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v. The minimum is pre-aggregated; a hot u is split by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id of ``links`` reaches.

    Every round moves links towards the smallest node seen (a logarithmic number of rounds in practice); the
    rounds' tables lie in the shared folder. The driver sees a count and a checksum only.
    """
    edges = stored(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _least(large)
        small = star.select(F.col("u"), F.col("m").alias("v")).unionByName(star.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small)
        before, state = state, _state(edges)
        if before == state:
            break
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
