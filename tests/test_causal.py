"""The causal baseline: fits of many windows at once, and the whole operator against a plain reading of its definition."""

import math
import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest

from fieldwatch.operators.baseline import BaselineRule, TrailingFits, causal_baseline, harmonics, mean_deviations, robust_fit
from fieldwatch.plans import registry


def signal(n, step, seed=1):
    """A daily curve with noise, a storm, spikes and gaps."""
    rnd = random.Random(seed)
    x = np.array([20 * math.sin(2 * math.pi * i * step / 86400) + rnd.gauss(0, 3) for i in range(n)])
    x[n // 3:n // 3 + n // 20] += 150
    x[rnd.sample(range(n), n // 100)] += 500
    x[n // 2:n // 2 + n // 9] = np.nan
    x[rnd.sample(range(n), n // 50)] = np.nan
    return x


def plainly(x, step, rule=BaselineRule()):
    """Window by window, sample by sample."""
    size, hop = max(12, round(rule.window_h * 3600 / step)), max(1, round(rule.update_min * 60 / step))
    h, base, beta = np.arange(len(x)) * step / 3600, np.full(len(x), np.nan), None
    for at in range(size, len(x), hop):
        y, t = x[at - size:at], h[at - size:at]
        ok = np.isfinite(y)
        if ok.sum() >= max(rule.least_known * size, 12):
            beta = robust_fit(harmonics(t, (t[ok].min(), t[ok].max())), y, rule)
        if beta is not None:
            base[at:at + hop] = harmonics(h[at:at + hop], (t[0], t[-1])) @ beta
    med = pd.Series(x).shift(1).rolling(size, min_periods=1).median().to_numpy()
    return np.where(np.isfinite(base), base, med)


def series(spark, **stations):
    return spark.createDataFrame([(s, k + 7, None if v != v else float(v), step) for s, (x, step) in stations.items() for k, v in enumerate(x)], "station string, k long, v double, step long")


def test_median_distances():
    rnd = np.random.default_rng(1)
    for n in (12, 13, 300):
        r = rnd.normal(size=(50, n)).round(1)
        r[rnd.random(r.shape) < 0.2] = np.nan
        r[0, :] = 5.0
        want = [np.median(np.abs(x[~np.isnan(x)] - np.median(x[~np.isnan(x)]))) for x in r]
        assert np.allclose(mean_deviations(r, np.isfinite(r).sum(1)), want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("step", [60, 600, 10800])
def test_fits_at_once_equal_single_fits(step):
    rule, size = BaselineRule(), max(12, 86400 // step)
    x, i0 = signal(6 * size, step), 1000
    first = np.arange(0, 5 * size, max(1, size // 7))
    got = TrailingFits(size, step, rule).fit(x, first, i0)
    for f, beta in zip(first, got):
        y, h = x[f:f + size], (f + i0 + np.arange(size)) * step / 3600
        ok = np.isfinite(y)
        if ok.sum() < max(size / 2, 12):
            assert np.isnan(beta).all()
        else:
            a = harmonics(h, (h[ok].min(), h[ok].max()))
            assert np.allclose((a @ beta)[ok], (a @ robust_fit(a, y, rule))[ok], rtol=0, atol=1e-6)


def test_fits_at_once_are_faster():
    rule = BaselineRule()
    x, first = signal(6000, 60), np.arange(0, 4500, 15)
    fits = TrailingFits(1440, 60, rule)
    began = time.process_time()
    fits.fit(x, first, 0)
    once = time.process_time() - began
    a = harmonics(np.arange(1440) / 60, (0.0, 1439 / 60))
    began = time.process_time()
    for f in first[::10]:
        robust_fit(a, x[f:f + 1440], rule)
    assert once < 0.5 * 10 * (time.process_time() - began)


def test_equals_the_definition(spark):
    late = signal(9000, 60, 2)
    late[:3000] = np.nan  # no fit for two days, and none over more than a block later on
    late[3500:3500 + 700] = np.nan
    stations = {"MIN": (signal(15000, 60), 60), "FAST": (signal(30000, 20), 20), "LATE": (late, 60), "SHORT": (signal(100, 60), 60), "SLOW": (signal(300, 3600), 3600)}
    gap = signal(20000, 60, 3)
    gap[4000:14500] = np.nan
    stations["GAP"] = (gap, 60)
    got = causal_baseline(series(spark, **stations), "station", "step").toPandas()
    assert len(got) == sum(len(x) for x, _ in stations.values())
    for s, (x, step) in stations.items():
        own = got[got["station"] == s].sort_values("k")
        want = plainly(x, step)
        assert set(own["step"]) == {step} and list(own["k"]) == list(range(7, 7 + len(x)))
        assert np.allclose(own["baseline"].to_numpy(float), want, rtol=0, atol=1e-6, equal_nan=True), s
        assert np.allclose(own["residual"].to_numpy(float), x - want, rtol=0, atol=1e-6, equal_nan=True), s


def test_every_cadence_in_one_pass(spark, tmp_path):
    t0 = datetime(2024, 5, 10, tzinfo=timezone.utc)
    rnd = random.Random(1)
    rows = [(s, t0 + timedelta(seconds=c * i), rnd.gauss(0, 5) + 20) for s, c in (("MIN", 60), ("FAST", 20)) for i in range(2 * 86400 // c) if not 900 <= i < 906]
    spark.createDataFrame(rows, "observatory string, ts timestamp, residual double").write.parquet(f"{tmp_path}/residuals.parquet")
    spark.createDataFrame([("MIN", 60), ("FAST", 20)], "station string, cadence_s int").write.parquet(f"{tmp_path}/stations.parquet")
    df = registry.QUERIES["native_causal_baseline"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "flatmapgroups" not in plan  # no sliding sort, no fit done again
    got = df.toPandas()
    for s, c in (("MIN", 60), ("FAST", 20)):
        x = np.full(2 * 86400 // c, np.nan)
        for name, at, v in rows:
            if name == s:
                x[int((at - t0).total_seconds()) // c] = round(v, 9)
        for k in (900, 901, 902):  # the first three of a gap are filled
            x[k] = x[899] + (x[906] - x[899]) * (k - 899) / 7
        own = got[(got["station"] == s) & (got["cadence_s"] == c)].sort_values("k")
        assert np.allclose(own["baseline"].to_numpy(float), plainly(x, c), rtol=0, atol=1e-6, equal_nan=True)
        assert own["residual"].isna().sum() == 4  # three stay unknown, and nothing is before the first


def test_no_readings_and_one(spark, tmp_path):
    spark.createDataFrame([("MIN", 60), ("OTHER", 60)], "station string, cadence_s int").write.parquet(f"{tmp_path}/stations.parquet")
    for n, rows in enumerate(([], [("MIN", datetime(2024, 5, 10, tzinfo=timezone.utc), 5.0), ("OTHER", datetime(2024, 5, 10, tzinfo=timezone.utc), None)])):
        (at := tmp_path / str(n)).mkdir()
        (at / "stations.parquet").symlink_to(tmp_path / "stations.parquet")
        spark.createDataFrame(rows, "observatory string, ts timestamp, residual double").write.parquet(f"{at}/residuals.parquet")
        got = registry.QUERIES["native_causal_baseline"](spark, str(at)).collect()
        assert [(r.station, r.baseline, r.residual, r.cadence_s) for r in got] == [("MIN", None, None, 60)] * n


def test_keys_that_are_large_numbers(spark):
    df = spark.createDataFrame([(2**60 + 1, k, float(k % 3)) for k in range(40)], "station long, k long, v double")
    assert {(r.station, r.k) for r in causal_baseline(df, "station", 600).collect()} == {(2**60 + 1, k) for k in range(40)}
