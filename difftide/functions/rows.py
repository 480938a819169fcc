"""Row selection that does not repeat costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, condition: Column, *columns: Column | str) -> DataFrame:
    """Filter and project rows whose columns were expensive to make (parsed payloads, matches).

    A plain filter is pushed below the parsing, which puts a copy of the whole parsing expression
    into the filter for each column it mentions. Rows of a generator are not touched that way, so
    everything is evaluated once.
    """
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))
