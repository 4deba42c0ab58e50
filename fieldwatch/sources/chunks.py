"""Ranges of days fetched in chunks on executors, with retries; the first source that has a part of the range."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.session import materialize


def chunk_ranges(start: date, days: int, chunk_days: int) -> list[tuple[date, int]]:
    """(first day, number of days) of every chunk."""
    return [(start + timedelta(days=i), min(chunk_days, days - i)) for i in range(0, days, chunk_days)]


def fetch_chunks(spark: SparkSession, fetch: Callable[[str, date, int], str], stations: list[str], start: date, days: int, chunk_days: int = 7, tries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """(station, first_day, n_days, text, error): one row a station and chunk, fetched side by side.

    ``fetch`` gets station, first day and number of days and returns text; it is tried ``tries`` times with growing pauses.
    What still fails comes out as a row with the error, so that a gap is seen. Write the result once (``materialize``):
    reading it again would fetch again.
    """
    return _fetch(spark, fetch, [(s, d, n) for s in stations for d, n in chunk_ranges(start, days, chunk_days)], tries, wait_s)


def _fetch(spark: SparkSession, fetch: Callable[[str, date, int], str], rows: list[tuple[str, date, int]], tries: int, wait_s: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for s, d, n in zip(b["station"], b["first_day"], b["n_days"]):
                text = error = None
                for k in range(tries):
                    try:
                        text, error = fetch(s, d, int(n)), None
                        break
                    except Exception as e:  # any failure of a source may pass
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait_s * 2**k if k + 1 < tries else 0)
                texts.append(text)
                errors.append(error)
            yield b.assign(text=texts, error=errors)

    todo = spark.createDataFrame(rows, "station string, first_day date, n_days int").repartition(max(1, len(rows)))
    return todo.mapInPandas(run, "station string, first_day date, n_days int, text string, error string")


def first_available(sources: list[DataFrame], part: list[str]) -> DataFrame:
    """Rows of several sources, best first: of every part (such as station and month) the rows of the first source that has
    any. Which source serves a part is decided by one row a part."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s)
    best = both.groupBy(*part).agg(F.min("_rank").alias("_best"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in part] + [F.col("a._rank") == F.col("b._best")]
    return both.alias("a").join(best.alias("b"), on, "left_semi").drop("_rank")


def fetch_cached(spark: SparkSession, fetch: Callable[[str, date, int], str], stations: list[str], start: date, days: int, cache: str, now_s: int, chunk_days: int = 7, ttl_s: int = 86400, settled_days: int = 2, tries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """``fetch_chunks`` over a cache, a Parquet table at ``cache`` that all executors share: only chunks that it lacks are fetched.

    Kept are chunks without error that end at least ``settled_days`` before ``now_s``, for ``ttl_s`` seconds; a failed or fresh one is
    fetched again by the next run, so a rerun after a failure costs what failed. Of several copies the latest counts.
    """
    schema = "station string, first_day date, n_days int, text string, error string, fetched_s bigint"
    try:
        known = spark.read.schema(schema).parquet(cache)
        known.limit(1).collect()
    except AnalysisException:
        known = spark.createDataFrame([], schema)
    key = ["station", "first_day", "n_days"]
    good = known.where(F.col("fetched_s") > now_s - ttl_s).groupBy(*key).agg(F.max_by("text", "fetched_s").alias("text"))
    have = {(r.station, r.first_day, r.n_days) for r in good.select(*key).collect()}  # one row a chunk of the wanted range or fewer
    wanted = [(s, d, n) for s in stations for d, n in chunk_ranges(start, days, chunk_days)]
    todo = [w for w in wanted if w not in have]
    if todo:
        new = materialize(_fetch(spark, fetch, todo, tries, wait_s), "fetched")
        settled = F.unix_timestamp(F.date_add("first_day", F.col("n_days") + settled_days).cast("timestamp")) <= now_s
        new.where(F.col("error").isNull() & settled).withColumn("fetched_s", F.lit(now_s).cast("long")).write.mode("append").parquet(cache)
    else:
        new = spark.createDataFrame([], "station string, first_day date, n_days int, text string, error string")
    ask = spark.createDataFrame([w for w in wanted if w in have], "station string, first_day date, n_days int")
    return new.unionByName(ask.join(good, key).select(*key, "text", F.lit(None).cast("string").alias("error")))
