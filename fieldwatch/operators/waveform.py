"""Waveforms: traces merged on a sample grid, resampled, cut in overlapping windows; slots for trained models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_traces(traces: DataFrame, key: str, chunk_s: int = 3600) -> DataFrame:
    """(key, chunk, i, v): samples of traces (key, t0_us, rate, samples) on the key's grid, 0 in gaps, in chunks of time.

    Overlapping samples take the later trace. Every chunk stands alone, so a channel of any length spreads over tasks; a
    trace lies in each chunk that it touches.
    """
    x = traces.where("size(samples) > 0 and rate > 0").select(key, "t0_us", "rate", F.posexplode("samples").alias("j", "v"))
    n = F.round(F.col("t0_us") / 1e6 * F.col("rate")).cast("long") + F.col("j")
    per = F.round(F.lit(chunk_s) * F.col("rate")).cast("long")
    x = x.select(key, "rate", "t0_us", F.floor(n / per).cast("long").alias("chunk"), F.pmod(n, per).alias("i"), "v")
    seen = x.groupBy(key, "rate", "chunk", "i").agg(F.max_by("v", "t0_us").alias("v"))
    span = seen.groupBy(key, "rate", "chunk").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    grid = span.select(key, "rate", "chunk", F.explode(F.sequence("a", "b")).alias("i"))
    return grid.join(seen, [key, "rate", "chunk", "i"], "left").select(key, "rate", "chunk", "i", F.coalesce("v", F.lit(0)).alias("v"))


def resample(traces: DataFrame, rate: float = 100.0) -> DataFrame:
    """Traces (.., rate, samples) at another rate, by the discrete Fourier transform of each trace; samples become DOUBLE."""
    def change(samples: pd.Series, old: pd.Series) -> pd.Series:
        out = []
        for s, r in zip(samples, old):
            x = np.asarray(s if s is not None else [], float)
            n = int(round(len(x) * rate / r)) if len(x) and r else 0
            if not n:
                out.append([])
                continue
            f = np.fft.rfft(x)
            g = np.zeros(n // 2 + 1, complex)
            m = min(len(f), len(g))
            g[:m] = f[:m]
            out.append((np.fft.irfft(g, n) * n / len(x)).tolist())
        return pd.Series(out)

    f = F.pandas_udf(change, "array<double>")
    return traces.withColumn("samples", f("samples", F.col("rate").cast("double"))).withColumn("rate", F.lit(rate))


def windows(traces: DataFrame, key: str, width_s: float, step_s: float, least: int = 3001) -> DataFrame:
    """(key, idx, start_us, samples) of overlapping windows per trace (key, t0_us, rate, samples), both ends included, padded with
    0 to ``least`` samples; a trace shorter than a window gives one."""
    n = F.size("samples")
    length = (n - 1) / F.col("rate")
    count = F.greatest(F.lit(0), F.floor((length - width_s) / step_s + 1e-9)).cast("int")
    w = traces.where("size(samples) > 0").select(key, "t0_us", "rate", "samples", F.posexplode(F.sequence(F.lit(0), count)).alias("idx", "_"))
    first = F.round(F.col("idx") * step_s * F.col("rate")).cast("int")
    part = F.slice("samples", first + 1, F.round(F.lit(width_s) * F.col("rate")).cast("int") + 1)
    padded = F.concat(part, F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(0), F.lit(least) - F.size(part))))
    return w.select(key, "idx", (F.col("t0_us") + F.round(F.col("idx") * step_s * 1e6).cast("long")).alias("start_us"), padded.alias("samples"))


#: Named models: a function from a pandas frame of windows to one of results; loaded once a task.
BACKENDS: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {}


def register(name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> None:
    """Make a model available under a name."""
    BACKENDS[name] = load


def apply_backend(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """Run a registered model over rows in Arrow batches."""
    load = BACKENDS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return rows.mapInPandas(run, schema)
