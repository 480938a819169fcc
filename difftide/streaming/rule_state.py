"""The feedback feed as keyed operator state (SM2), and snapshots of it for reviews (SM3).

A key is a rule in one stretch of time, so a busy rule is many keys in many tasks. Its value holds the counters, the weight sum
and the highest running weight sum; values of consecutive stretches combine in order (`fold_segments`). The state lies in
Spark's RocksDB state store below the query's checkpoint. A micro-batch is visible once Spark has committed it;
readers take one committed batch as a whole, which stays readable while later batches are written, until Spark removes
it (after `spark.sql.streaming.minBatchesToRetain` batches).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from difftide.operators.events import to_feedback
from difftide.operators.memory import DOWNGRADE_THRESHOLD, RULE, dismiss_ratio, feedback_steps, fold_segments
from difftide.sources.webhooks import read_comment_webhooks
from difftide.streaming.feeds import raw_stream

SUMS = "total long, accepted long, dismissed long, weight long, peak long"
SEGMENT = f"agent_type string, rule_category string, segment long, {SUMS}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RuleSegment(StatefulProcessor):
    """State of one (agent, rule, stretch of time): what its rows add up to, in order of arrival.

    A micro-batch's rows of a key are put into the order (created_at, id) first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(rows).sort_values(["created_at", "id"])
        running = new["w"].cumsum()
        total, accepted, dismissed, weight, peak = self.sums.get() or (0, 0, 0, 0, None)
        highest = weight + int(running.max())
        sums = (
            total + len(new), accepted + int(new["a"].sum()), dismissed + int(new["d"].sum()),
            weight + int(running.iloc[-1]), highest if peak is None else max(peak, highest),
        )
        self.sums.update(sums)
        yield pd.DataFrame([(*key, *sums)], columns=[f.split()[0] for f in SEGMENT.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed operators need, for a query that is started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def rule_segments_stream(feedback: DataFrame, threshold: float = DOWNGRADE_THRESHOLD, span: str = "hour") -> DataFrame:
    """The changed (rule, stretch of time) sums of a feedback stream; `span` is a unit of `date_trunc`.

    A key's rows of one micro-batch are sorted in one task, so choose a span in which one rule's rows fit there. A row that comes
    late counts after the rows that its own stretch already has.
    """
    rows = feedback_steps(feedback, threshold).withColumn("segment", F.unix_seconds(F.date_trunc(span, F.col("created_at").cast("timestamp"))))
    return rows.groupBy(*RULE, "segment").transformWithStateInPandas(RuleSegment(), SEGMENT, "Update", "None")


def latest_batch(spark: SparkSession, checkpoint_dir: str) -> int:
    """Number of the newest committed micro-batch; -1 when there is none."""
    try:
        newest = spark.read.format("state-metadata").load(checkpoint_dir).agg(F.max("maxBatchId")).first()[0]
    except PySparkException as e:
        if not _no_state_yet(e):
            raise
        return -1
    return -1 if newest is None else newest


def _no_state_yet(e: PySparkException) -> bool:
    return (e.getCondition() or "").startswith(("STDS_", "PATH_NOT_FOUND")) or "does not exist" in str(e)


def rule_segments_at(spark: SparkSession, checkpoint_dir: str, batch_id: int) -> DataFrame:
    """The state as it was after a committed micro-batch; empty before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], SEGMENT)
    reader = spark.read.format("statestore").option("stateVarName", "sums").option("batchId", batch_id)
    return reader.load(checkpoint_dir).select("key.*", "value.*")


def rule_stats_at(spark: SparkSession, checkpoint_dir: str, batch_id: int | None = None) -> DataFrame:
    """Rule statistics after a micro-batch, by default the newest committed one.

    The batch is chosen when this is called: the result stays that snapshot, whatever is written before it is read.
    """
    at = latest_batch(spark, checkpoint_dir) if batch_id is None else batch_id
    return dismiss_ratio(fold_segments(rule_segments_at(spark, checkpoint_dir, at))).select(
        *RULE, "total", "accepted", "dismissed", "dismiss_ratio", (F.col("peak") > 0).alias("is_downgraded")
    )


def run_rule_stats(feedback: DataFrame, checkpoint_dir: str, threshold: float = DOWNGRADE_THRESHOLD, span: str = "hour") -> None:
    """Take the feedback that has arrived into the state (SM2). A micro-batch that is repeated counts once."""
    with _rocksdb(feedback.sparkSession):
        query = (
            rule_segments_stream(feedback, threshold, span).writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
        )
    query.awaitTermination()


def stream_rule_stats(
    spark: SparkSession, comment_dir: str, checkpoint_dir: str,
    threshold: float = DOWNGRADE_THRESHOLD, files_per_batch: int | None = None, span: str = "hour",
) -> DataFrame:
    """Process the comment feed that has arrived and return the statistics after it (SM2)."""
    run_rule_stats(to_feedback(read_comment_webhooks(raw_stream(spark, comment_dir, files_per_batch))), checkpoint_dir, threshold, span)
    return rule_stats_at(spark, checkpoint_dir)
