"""Structured Streaming forms of the counters and folds. They read file streams and keep state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.folds import ema


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def feedback_counts(stream: DataFrame, time: str, keys: list[str], delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by window and keys; a window's count is final when the watermark has passed it, later rows are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def running_ema(stream: DataFrame, key: str, order: str, value: str, alpha: float = 0.3, start: float = 500.0) -> DataFrame:
    """(key, ema, n) after each batch; the average of a key goes on from its state. Rows of a batch are taken in ``order``."""

    def step(key_values: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (start, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[value]:
            average, n = alpha * float(x) + (1 - alpha) * average, n + 1
        state.update((average, n))
        yield pd.DataFrame({"key": [str(key_values[0])], "ema": [average], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(step, "key string, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def batch_ema(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The same averages over a whole table, in Spark's own functions."""
    listed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("v"))
    return listed.select(F.col(key).cast("string").alias("key"), ema(F.transform("v", lambda x: x[value])).alias("ema"), F.size("v").cast("long").alias("n"))
