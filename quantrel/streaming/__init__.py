"""Streaming forms of the one-pass operators: event-time windows, mergeable moments and per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_moments(events: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and variance (ddof 0) by key and tumbling window. Spark's aggregates keep the mergeable state; rows later than the watermark are left out."""
    x = F.col(value).cast("double")
    windows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return windows.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance")).select("w.start", by, "n", "mean", "variance")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), by)
    return s.agg(F.count(F.lit(1)).alias("n")).select("s.start", "s.end", by, "n")


def running_moments(events: DataFrame, key: str, value: str) -> DataFrame:
    """After each batch the moments of every key seen in it, kept by Welford's update in Spark's state store."""
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            for x in b[value]:
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "variance": [m2 / n]})

    out = f"{key} {kind}, n long, mean double, variance double"
    return events.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, out, "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)


def compensated_sums(events: DataFrame, key: str, value: str) -> DataFrame:
    """Running sums by key with Neumaier's correction carried in the state."""
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, lost = state.get if state.exists else (0.0, 0.0)
        for b in batches:
            for x in b[value]:
                new = total + x
                lost += (total - new) + x if abs(total) >= abs(x) else (x - new) + total
                total = new
        state.update((total, lost))
        yield pd.DataFrame({key: [k[0]], "total": [total + lost]})

    return events.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, total double", "total double, lost double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Process what is there and return the in-memory result table (for tests and small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
