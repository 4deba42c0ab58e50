"""Rolling-origin backtests of simple forecasters and their error measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.functions.weather import circular_diff
from fieldwatch.operators.blocks import done_with_halo, with_halo

LEVELS = (0.1, 0.5, 0.9)
Z = 1.28  # distance of the outer levels in spreads


def origins(series: DataFrame, keys: list[str], context: int, horizon: int, splits: int) -> DataFrame:
    """(keys, split, origin): last training position of each split; splits that overrun the series are left out."""
    n = series.groupBy(*keys).agg(F.max("i").alias("n"))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - context - horizon) / splits))
    all_ = n.select(*keys, "n", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("split"))
    return all_.withColumn("origin", F.lit(context) + F.col("split") * F.col("step")).where(F.col("origin") + horizon <= F.col("n")).select(*keys, "split", F.col("origin").cast("long").alias("origin"))


def spread(series: DataFrame, at: DataFrame, keys: list[str], tail: int = 48, least: float = 1e-3) -> DataFrame:
    """(keys, split, sigma): population deviation of the last ``tail`` training values, at least ``least``."""
    want = at.select(*keys, "split", F.explode(F.sequence(F.greatest(F.lit(1), F.col("origin") - tail + 1), F.col("origin"))).alias("i"))
    return want.join(series, [*keys, "i"]).groupBy(*keys, "split").agg(F.greatest(F.lit(least), F.stddev_pop("v")).alias("sigma"))


def mase_scale(series: DataFrame, at: DataFrame, keys: list[str], season: int = 24) -> DataFrame:
    """(keys, split, scale): mean absolute seasonal difference of all training values up to the split (first differences of a
    shorter series), 1e-4 in place of 0. Sums per series and split are combined before any shuffle."""
    cut, parts = with_halo(series, keys, "i", season)
    from pyspark.sql import Window

    w = Window.partitionBy(*parts).orderBy("i")
    d = done_with_halo(cut.withColumns({"ds": F.abs(F.col("v") - F.lag("v", season).over(w)), "d1": F.abs(F.col("v") - F.lag("v").over(w))}))
    pairs = d.join(at, keys).where("i <= origin")
    scale = F.avg(F.when(F.col("origin") > season, F.col("ds")).otherwise(F.col("d1")))
    return pairs.groupBy(*keys, "split").agg(scale.alias("s")).select(*keys, "split", F.when(F.col("s") == 0, F.lit(1e-4)).otherwise(F.col("s")).alias("scale"))


def forecast(series: DataFrame, at: DataFrame, keys: list[str], horizon: int, backend: str, season: int = 24) -> DataFrame:
    """(keys, split, h, p50, sigma): ``persistence`` repeats the last training value, ``seasonal_naive`` the last season."""
    steps = at.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    if backend == "persistence":
        source = F.col("origin")
    elif backend == "seasonal_naive":
        length = F.least(F.lit(season), F.col("origin"))
        source = F.col("origin") - length + F.pmod(F.col("h") - 1, length) + 1
    else:
        raise ValueError(f"unknown backend {backend}")
    told = steps.withColumn("i", source.cast("long")).join(series, [*keys, "i"]).select(*keys, "split", "origin", "h", F.col("v").alias("p50"))
    return told.join(spread(series, at, keys), [*keys, "split"])


def errors(told: DataFrame, series: DataFrame, keys: list[str], circular=None) -> DataFrame:
    """(keys, split, mae, rmse, crps) of forecasts against the truth by position. CRPS is the mean pinball loss of three
    levels; for circular series differences are angles."""
    truth = series.select(*keys, "i", F.col("v").alias("y"))
    rows = told.withColumn("i", F.col("origin") + F.col("h")).join(truth, [*keys, "i"])
    plain = F.col("y") - F.col("p50")
    e = F.abs(plain) if circular is None else F.when(circular, circular_diff(F.col("y"), F.col("p50"))).otherwise(F.abs(plain))
    loss = F.lit(0.0)
    for q in LEVELS:
        x = F.col("y") - (F.col("p50") + F.lit({0.1: -Z, 0.5: 0.0, 0.9: Z}[q]) * F.col("sigma"))
        pin = F.greatest(q * x, (q - 1) * x)
        if circular is not None:
            pin = F.when(circular, q * circular_diff(F.col("y"), F.pmod(F.col("y") - x, F.lit(360.0)))).otherwise(pin)
        loss = loss + pin
    return rows.select(*keys, "split", e.alias("e"), (loss / len(LEVELS)).alias("loss")).groupBy(*keys, "split").agg(
        F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("loss").alias("crps"))


def poisoned(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason): why a field could spoil a joint forecast, the first that applies of ``missing`` (over 15 %), ``short``
    (under 24 values), ``flat`` (MAD below 1e-8) and ``outlier`` (robust score over 5); NULL for sound fields."""
    base = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("c"), F.percentile("v", 0.5).alias("med"))
    dev = F.abs(F.col("v") - F.col("med"))
    stats = series.join(base, keys).groupBy(*keys, "n", "c").agg(F.percentile(dev, 0.5).alias("mad"), F.max(dev).alias("far"))
    return stats.select(*keys, F.when(1 - F.col("c") / F.col("n") > 0.15, "missing").when(F.col("c") < 24, "short").when(F.col("mad") < 1e-8, "flat")
                        .when(F.col("far") / (1.4826 * F.col("mad") + 1e-12) > 5, "outlier").alias("reason"))
