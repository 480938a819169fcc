"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that results depend on (UTC, ANSI) or that guard large runs (AQE, skew joins).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Shuffle files of a job go when it has ended, not when the driver forgets its tables.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build_session(app: str = "difftide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `master` is only given for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g")
        )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def job_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs inside alone; they are put back."""
    old = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the one named by `spark.checkpoint.dir`. Without it a run in one process (local tests) uses a
    temporary folder, and a cluster is refused: its machines would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="difftide-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
