"""Live forms of the causal operators: message streams, windowed amplitudes, a latch kept in state, freshness, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldwatch.sources.messages import from_messages


def message_stream(spark: SparkSession, path: str, instrument: str) -> DataFrame:
    """Messages of JSON-lines files as they arrive, with an event time: (sequence_number, us, payload fields, ts)."""
    lines = spark.readStream.schema("value string").text(path).withColumnRenamed("value", "line")
    return from_messages(lines, instrument).withColumn("ts", F.timestamp_micros("us"))


def table_stream(spark: SparkSession, path: str, schema, ts: str = "ts") -> DataFrame:
    """Parquet files of a folder as a stream; a time without zone becomes a UTC timestamp, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_amplitude(stream: DataFrame, key: str, value: str, width: str = "3 hours", step: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Peak-to-peak amplitude of sliding event-time windows; rows later than the watermark are dropped."""
    w = F.window("ts", width, step)
    return stream.withWatermark("ts", late).groupBy(key, w).agg((F.max(value) - F.min(value)).alias("amp"), F.count(value).alias("n")).select(key, F.col("window.end").alias("until"), "amp", "n")


def fresh(now_s: int, newest_s: int | None, most_min: float = 90.0, skew_min: float = 5.0) -> bool:
    """Whether the newest sample is neither too old nor ahead of the clock."""
    return newest_s is not None and -skew_min <= (now_s - newest_s) / 60 <= most_min


def live_latch(stream: DataFrame, key: str, pos: str, value: str, on: float, off: float, min_on: int, min_off: int) -> DataFrame:
    """(key, pos, latched) of a stream of sizes: set after ``min_on`` values of at least ``on`` in a row, released after
    ``min_off`` of at most ``off``; a missing value releases at once.

    The state is one number and the last position a key. Rows of a batch are put in order; rows at or before the last
    position are late and dropped. Replaying the same rows in any number of batches gives what the batch operator gives.
    """
    out = f"{key} string, {pos} long, latched boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        code, last = state.get if state.exists else (0, -(1 << 62))
        rows = pd.concat(list(frames)).sort_values(pos)
        rows = rows[rows[pos] > last]
        seen = []
        for v in rows[value].tolist():
            if v is None or v != v:
                code = 0
            elif code < min_on:
                code = code + 1 if v >= on else 0
            else:
                code = (code + 1 if code + 1 < min_on + min_off else 0) if v <= off else min_on
            seen.append(code >= min_on)
        if len(rows):
            state.update((int(code), int(rows[pos].max())))
            yield pd.DataFrame({key: k[0], pos: rows[pos], "latched": seen})

    return stream.groupBy(key).applyInPandasWithState(step, out, "code int, last long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Take all that is there in batches and stop; restarted with the same checkpoint it goes on where it stopped."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
