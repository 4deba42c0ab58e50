"""Writers: result documents, gauge lines, sweep tables, picks, per-station state, alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summarised(rows: DataFrame) -> DataFrame:
    """Arrays replaced by what they are: (type, shape, dtype)."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in rows.schema.fields if f.dataType.typeName() == "array"}
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.struct(F.lit("array").alias("type"), F.array(F.size(c)).alias("shape"), F.lit(kind).alias("dtype"))) for c, kind in kinds.items()}) if kinds else rows


def write_documents(rows: DataFrame, path: str, arrays: bool = False) -> None:
    """One JSON document per row, NULLs left out, arrays only described unless asked for; the commit protocol makes the folder appear
    whole."""
    rows = rows if arrays else summarised(rows)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    """Text lines, such as gauges."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A table as CSV with header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def pick_documents(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): JSON with ``count`` and ``picks`` per key, such as station and day."""
    row = F.struct("us", "wave", "p", "model", "pick_id")
    d = picks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("picks"))
    return d.select(*keys, F.to_json(F.struct(F.size("picks").alias("count"), "picks")).alias("document"))


def provenance(rows: DataFrame, **facts: str) -> DataFrame:
    """Add a struct ``provenance`` of constants."""
    return rows.withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in sorted(facts.items())]))


def save_state(state: DataFrame, path: str) -> None:
    """(station, saved_s, beta) as Parquet, one row a station."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, now_s: int, max_age_h: float = 168.0) -> DataFrame:
    """Usable rows of a saved state: finite coefficients, not older than the limit. A missing or broken table is a cold
    start, an empty frame."""
    schema = "station string, saved_s bigint, beta array<double>"
    try:
        state = spark.read.schema(schema).parquet(path)
        state.limit(1).collect()
    except Exception:  # whatever can't be read is a cold start
        return spark.createDataFrame([], schema)
    ok = F.forall("beta", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return state.where(ok & (F.size("beta") > 0) & (F.lit(now_s) - F.col("saved_s") <= max_age_h * 3600))


def deliver_alerts(send: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends each alert row (few by nature) once per batch."""
    def deliver(batch: DataFrame, batch_id: int) -> None:
        for row in batch.where("alert").toLocalIterator():
            send(row.asDict() | {"batch_id": batch_id})

    return deliver
