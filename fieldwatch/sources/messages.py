"""The message envelope of all instruments: sequence number, timestamps, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwatch.functions.values import epoch_micros

STAMP = "array<struct<seconds: bigint, nanoseconds: bigint, source: string>>"
PAYLOADS = {
    "weather": "struct<temperature: double, humidity_prec: double, barometer: double, wind_speed: double, wind_direction: double, hub_voltage: double, irradiance: double>",
    "seismic": "struct<channel_id: string, sample_rate: double, sample_count: int, samples: array<int>>",
    "magnetometer": "struct<x_nt: double, y_nt: double, z_nt: double>",
}


def schema(instrument: str) -> str:
    """Schema of one instrument's messages."""
    return f"sequence_number bigint, timestamp {STAMP}, payload {PAYLOADS[instrument]}"


def stamp(ts: Column, source: str = "sensor") -> Column:
    """Timestamp array of a message, from a timestamp column (UTC)."""
    us = epoch_micros(ts)
    return F.array(F.struct(F.floor(us / 1_000_000).cast("long").alias("seconds"), (F.pmod(us, F.lit(1_000_000)) * 1000).cast("long").alias("nanoseconds"), F.lit(source).alias("source")))


def to_messages(rows: DataFrame, sequence: Column, ts: Column, payload: Column) -> DataFrame:
    """One JSON line per row."""
    return rows.select(F.to_json(F.struct(sequence.alias("sequence_number"), stamp(ts).alias("timestamp"), payload.alias("payload"))).alias("line"))


def from_messages(lines: DataFrame, instrument: str, text: str = "line") -> DataFrame:
    """(sequence_number, us, payload fields) of JSON lines; blank and unreadable lines, and those without timestamp, are left
    out; the first timestamp counts."""
    m = lines.where(F.trim(text) != "").select(F.from_json(text, schema(instrument)).alias("m"))
    first = F.try_element_at("m.timestamp", F.lit(1))
    us = first["seconds"] * 1_000_000 + F.floor(first["nanoseconds"] / 1000)
    return m.select(F.col("m.sequence_number"), us.cast("long").alias("us"), "m.payload.*").where("us is not null")


def read_messages(spark: SparkSession, path: str, instrument: str) -> DataFrame:
    """Messages of JSON-lines files."""
    return from_messages(spark.read.text(path).withColumnRenamed("value", "line"), instrument)


def channel_parts(channel: Column) -> dict[str, Column]:
    """Station key, component (1 and 2 count as N and E) of a four-part channel id; NULL for other ids."""
    p = F.split(channel, r"\.")
    ok = F.size(p) == 4
    last = F.upper(F.substring(F.try_element_at(p, F.lit(4)), -1, 1))
    return {"key": F.when(ok, F.concat_ws(".", p[0], p[1], p[2])), "component": F.when(ok, F.when(last == "1", "N").when(last == "2", "E").otherwise(last))}


def running_sequence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``sequence_number``, running from 0 within the keys (short streams such as one export)."""
    return rows.withColumn("sequence_number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
