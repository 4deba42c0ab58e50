"""Irregular readings onto a regular grid: harmonic seasonal regression with trend by distributed normal equations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.functions.values import epoch_micros
from fieldwatch.operators.blocks import rows_before_gaps
from fieldwatch.session import materialize

#: Periods of the seasonal terms in hours (fixed values, those of the daily quiet-time curve).
PERIODS_H = (24.0, 12.0, 8.0, 6.0)
#: Days of the trend's origin, so that its numbers stay small (1998-01-01 is day 10227 of the epoch).
TREND_ORIGIN_DAY = 10227.0
KEYS = ["field", "station"]


def design(epoch_s: Column) -> list[Column]:
    """Intercept, trend in years, then sine and cosine of every period, of a time in epoch seconds."""
    row = [F.lit(1.0), (epoch_s / F.lit(86400.0) - F.lit(TREND_ORIGIN_DAY)) / F.lit(365.25)]
    for h in PERIODS_H:
        turn = F.lit(2 * math.pi / (h * 3600.0)) * epoch_s
        row += [F.sin(turn), F.cos(turn)]
    return row


def observed_periods(readings: DataFrame) -> DataFrame:
    """One row a period that has a reading: (field, station, cadence_s, k, value, readings).

    ``readings`` holds (field, station, cadence_s, ts, value, received_at), usable values only. The value is that of the
    reading nearest the middle of the period, of equally near ones the latest delivered, of those the larger value: a total
    order, so the result depends on nothing else. Aggregated before the shuffle.
    """
    micros, step = epoch_micros(F.col("ts")), F.col("cadence_s").cast("long") * F.lit(1_000_000)
    k = F.floor(micros / step).cast("long")
    off = F.abs(micros - k * step - F.floor(step / 2)).cast("long")
    came = F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(1 << 62)))
    best = F.struct((-off).alias("near"), came.alias("came"), F.col("value").cast("double").alias("value"))
    return (
        readings.where("cadence_s > 0 and ts is not null")
        .select(*KEYS, "cadence_s", k.alias("k"), best.alias("best"))
        .groupBy(*KEYS, "cadence_s", "k")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("readings"))
        .select(*KEYS, "cadence_s", "k", "best.value", "readings")
    )


def _middle(k: Column) -> Column:
    return (k.cast("double") + F.lit(0.5)) * F.col("cadence_s")


def _solve(p: int, ridge: float):
    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        upper = np.triu_indices(p)
        out = []
        for gram, rhs in zip(g, b):
            a = np.zeros((p, p))
            a[upper] = gram
            a = a + np.triu(a, 1).T
            n = max(a[0, 0], 1e-9)
            # the trend is centred by algebra, then scaled: its column is nearly the intercept's over a short span
            t = np.eye(p)
            t[1, 0] = -a[0, 1] / n
            a2, b2 = t @ a @ t.T, t @ np.asarray(rhs)
            s = np.sqrt(np.maximum(np.diag(a2) / n, 1e-12))
            a2, b2 = a2 / np.outer(s, s), b2 / s
            lam = ridge * n * np.ones(p)
            lam[0] = 1e-12 * n
            x = np.linalg.lstsq(a2 + np.diag(lam), b2, rcond=None)[0] / s
            out.append((t.T @ x).tolist())
        return pd.Series(out)

    return F.pandas_udf(solve, "array<double>")


def fit(observed: DataFrame, plausible: Column, passes: int = 2, ridge: float = 1e-6) -> DataFrame:
    """Coefficients per series: (field, station, beta, scale).

    The p*(p+1)/2 sums of the normal equations are plain aggregates, combined before the shuffle, so the data moved are a
    few numbers a series and task. After the first pass, values are weighted by Huber's rule at twice the scale of the
    residuals. Only ``plausible`` values enter; a series without any gets the coefficients 0.
    """
    x = design(_middle(F.col("k")))
    p = len(x)
    beta = None
    for _ in range(passes):
        src = observed.where(plausible)
        if beta is None:
            src = src.withColumn("w", F.lit(1.0))
        else:
            r = F.abs(F.col("value") - predict(F.col("k")))
            src = src.join(beta, KEYS).withColumn("w", F.least(F.lit(1.0), 2 * F.col("scale") / F.greatest(r, F.lit(1e-9))))
        cols = src.select(*KEYS, "w", "value", *[c.alias(f"x{i}") for i, c in enumerate(x)])
        xw = [F.col("w") * F.col(f"x{i}") for i in range(p)]
        sums = [F.sum(xw[i] * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
        sums += [F.sum(xw[i] * F.col("value")).alias(f"b{i}") for i in range(p)]
        sums += [F.sum(F.col("w") * F.col("value") * F.col("value")).alias("yy")]
        grams = cols.groupBy(*KEYS).agg(*sums)
        g = F.array(*[F.col(f"g{i}_{j}") for i in range(p) for j in range(i, p)])
        b = F.array(*[F.col(f"b{i}") for i in range(p)])
        solved = grams.select(*KEYS, "g0_0", "yy", b.alias("b"), _solve(p, ridge)(g, b).alias("beta"))
        explained = sum((F.col("beta")[i] * F.col("b")[i] for i in range(p)), F.lit(0.0))
        scale = F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - explained) / F.greatest(F.col("g0_0"), F.lit(1.0)))
        beta = materialize(solved.select(*KEYS, "beta", F.greatest(scale, F.lit(1e-6)).alias("scale")), "grid-fit")
    return beta


def predict(k: Column) -> Column:
    """Value of the fitted curve (columns ``beta``, ``cadence_s``) at the middle of period ``k``."""
    return sum((F.col("beta")[i] * c for i, c in enumerate(design(_middle(k)))), F.lit(0.0))


def regular_series(readings: DataFrame, plausible: Column, chunk: int = 4096) -> DataFrame:
    """A regular series: (field, station, period_start, value, status, readings).

    Every period [k*cadence_s, (k+1)*cadence_s) between the first and last period of a series that has a usable reading
    comes out once, with status ``observed`` or ``filled``. A filled value is the fitted curve plus the line between the
    curve's residuals at the nearest plausible periods on both sides; implausible ones stay ``observed`` as they are and bridge
    nothing. Where there is none on one side, or no fit, the value is NULL and the status ``missing``. Series without
    cadence, or without usable readings, give no rows; an empty table gives none.
    """
    observed = materialize(observed_periods(readings), "grid-observed")
    beta = fit(observed, plausible)
    sound = F.coalesce(plausible, F.lit(False))
    odd = materialize(observed.where(~sound).select(*KEYS, "k"), "grid-odd")  # few; its true size decides how it is joined
    gaps = rows_before_gaps(observed.where(sound), [*KEYS, "cadence_s"], "k", ["value"]).join(beta, KEYS, "left")
    left, right = F.col("value") - predict(F.col("k")), F.col("next_value") - predict(F.col("next_k"))
    gaps = gaps.select(*KEYS, "cadence_s", "beta", F.col("k").alias("k0"), F.col("next_k").alias("k1"), left.alias("r0"), right.alias("r1"))
    # before the first and after the last plausible period of a series there is nothing to bridge
    k = F.col("k")
    ends = observed.groupBy(*KEYS, "cadence_s").agg(F.min(k).alias("a"), F.max(k).alias("b"), F.min(F.when(sound, k)).alias("pa"), F.max(F.when(sound, k)).alias("pb"))
    around = F.array(F.struct((F.col("a") - 1).alias("k0"), F.coalesce(F.col("pa"), F.col("b") + 1).alias("k1")), F.struct(F.col("pb").alias("k0"), (F.col("b") + 1).alias("k1")))
    none = F.lit(None).cast("double")
    outer = ends.select(*KEYS, "cadence_s", F.inline(around)).where("k1 > k0 + 1").select(
        *KEYS, "cadence_s", F.lit(None).cast("array<double>").alias("beta"), "k0", "k1", none.alias("r0"), none.alias("r1"))
    # a gap of any length is cut in chunks before its periods are listed, so no row holds a long array
    parts = gaps.unionByName(outer).withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("k1") - F.col("k0") - 2) / chunk))))
    lo = F.col("k0") + 1 + F.col("c") * chunk
    periods = parts.withColumn("k", F.explode(F.sequence(lo, F.least(lo + chunk - 1, F.col("k1") - 1)))).join(odd, [*KEYS, "k"], "left_anti")
    share = (F.col("k") - F.col("k0")).cast("double") / (F.col("k1") - F.col("k0"))
    value = predict(F.col("k")) + F.col("r0") + (F.col("r1") - F.col("r0")) * share
    filled = periods.withColumn("value", value).select(
        *KEYS, (F.col("k") * F.col("cadence_s")).alias("period_start"), "value",
        F.when(F.col("value").isNull(), "missing").otherwise("filled").alias("status"), F.lit(0).cast("long").alias("readings"),
    )
    kept = observed.select(*KEYS, (F.col("k") * F.col("cadence_s")).alias("period_start"), "value", F.lit("observed").alias("status"), "readings")
    return kept.unionByName(filled)


def holdout_error(readings: DataFrame, plausible: Column, run_s: int = 21600, share: int = 10) -> DataFrame:
    """How well the operator fills what is known: (field, periods, mae_filled, mae_line, rmse_filled, rmse_line).

    Of every ``share`` runs of ``run_s`` seconds of a series one, chosen by a hash, is hidden; the operator fills the rest, and its
    values are held against the hidden plausible readings, beside those of a straight line between the gap's ends.
    """
    hidden = F.pmod(F.xxhash64("station", F.floor(epoch_micros(F.col("ts")) / (run_s * 1_000_000)).cast("long")), F.lit(share)) == 0
    truth = observed_periods(readings.where(hidden)).where(plausible).select(*KEYS, (F.col("k") * F.col("cadence_s")).alias("period_start"), F.col("value").alias("truth"))
    whole = regular_series(readings.where(~hidden), plausible)
    seen = whole.where("status = 'observed'").where(plausible)
    told = whole.where("status = 'filled'").select(*KEYS, "period_start", "value").join(truth, [*KEYS, "period_start"])
    line = rows_before_gaps(seen, KEYS, "period_start", ["value"], 4096 * 60)
    step = F.floor(F.col("period_start") / 86400).cast("long")
    days = line.withColumn("d", F.explode(F.sequence(step, F.floor(F.col("next_period_start") / 86400).cast("long"))))
    days = days.select(*KEYS, "d", F.col("period_start").alias("t0"), F.col("next_period_start").alias("t1"), F.col("value").alias("v0"), F.col("next_value").alias("v1"))
    both = told.withColumn("d", step).join(days, [*KEYS, "d"]).where("period_start > t0 and period_start < t1")
    straight = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("period_start") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    e, g = F.abs(F.col("value") - F.col("truth")), F.abs(straight - F.col("truth"))
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("periods"), F.avg(e).alias("mae_filled"), F.avg(g).alias("mae_line"), F.sqrt(F.avg(e * e)).alias("rmse_filled"), F.sqrt(F.avg(g * g)).alias("rmse_line"))
