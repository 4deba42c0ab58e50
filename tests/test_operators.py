"""Operators on small frames: hand-made cases, brute force, missing values, empty tables, block borders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwatch.functions import tiers
from fieldwatch.operators import blocks, series
from fieldwatch.operators.baseline import causal_baseline, harmonic_baseline
from fieldwatch.operators.latch import LatchRule, bool_events, latch
from fieldwatch.operators.picking import dedup

N = None
GAPS = [N, 1, N, N, N, N, N, 7, 8, 9, N, N, N, N]


def grid_of(spark, values, station="a", start=0):
    rows = [(station, start + i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, k long, v double")


@pytest.mark.parametrize("both, want", [(False, [N, 1, 2, 3, 4, N, N, 7, 8, 9, 9, 9, 9, N]), (True, [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9, N])])
def test_fill_gaps(spark, both, want):
    for start in (0, 4090, -7):  # across the border of a block, and before zero
        got = series.fill_gaps(grid_of(spark, GAPS, start=start), "station", both=both).orderBy("k").select("filled").toPandas()["filled"]
        assert [None if math.isnan(x) else x for x in got] == want


def test_fill_gaps_of_nothing(spark):
    assert series.fill_gaps(grid_of(spark, []), "station").count() == 0
    assert series.fill_gaps(grid_of(spark, [N, N]), "station").where("filled is not null").count() == 0


def test_regular_grid_skips_null_keys_and_times(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1200, 3.0), (None, 5, 1.0), ("a", None, 1.0)], "station string, s long, v double")
    assert [tuple(r) for r in series.regular_grid(rows, "station", "s", "v", 600).orderBy("k").collect()] == [("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0)]


def test_asof_keeps_null_of_the_latest_row(spark):
    left = spark.createDataFrame([("a", 14400), ("a", 3600), ("b", 1), ("a", 90000)], "station string, s long")
    right = spark.createDataFrame([("a", 0, 1.0), ("a", 10800, None)], "station string, s long, kp double")
    got = {(r.station, r.s): r.kp for r in series.asof_backward(left, right, "station", "s", "kp", 10800, "kp").collect()}
    assert got == {("a", 14400): None, ("a", 3600): 1.0, ("b", 1): None, ("a", 90000): None}


@pytest.mark.parametrize("seed", range(3))
def test_block_operators_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    ks = sorted(rnd.sample(range(-50, 400), 120))
    data = [(s, k, None if rnd.random() < 0.4 else float(k)) for s in ("a", "b") for k in ks if rnd.random() < 0.8]
    df = spark.createDataFrame(data, "station string, k long, v double")
    per = {s: sorted((k, v) for t, k, v in data if t == s) for s in ("a", "b")}
    nxt = {(r.station, r.k): r.next_k for r in blocks.with_next(df, ["station"], "k", ["v"], size=7, top=2).collect()}
    filled = {(r.station, r.k): r.f for r in blocks.forward_fill(df, ["station"], "k", "v", "f", size=7).collect()}
    ranks = {(r.station, r.k): r.i for r in blocks.positions(df, ["station"], "k", size=7).collect()}
    runs = {(r.station, r.k): r.session for r in blocks.sessions(df, ["station"], "k", 4, cell=9).collect()}
    gaps = {(r.station, r.k): r.next_k for r in blocks.rows_before_gaps(df, ["station"], "k", ["v"], size=7).collect()}
    for s, rows in per.items():
        last, start, prev = None, None, None
        for i, (k, v) in enumerate(rows):
            last = v if v is not None else last
            start = k if prev is None or k - prev > 4 else start
            prev = k
            after = rows[i + 1][0] if i + 1 < len(rows) else None
            assert (nxt[s, k], filled[s, k], ranks[s, k], runs[s, k]) == (after, last, i + 1, start)
            assert gaps.get((s, k)) == (after if after is not None and after > k + 1 else None)


def test_windows_over_block_borders(spark):
    values = [math.sin(i) * 10 for i in range(300)]
    g = grid_of(spark, values)
    cut, keys = blocks.with_halo(g, ["station"], "k", 9, 4, size=30)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(-9, 4)
    got = {r.k: r.m for r in blocks.done_with_halo(cut.withColumn("m", F.max("v").over(w))).collect()}
    assert got == {i: max(values[max(0, i - 9): i + 5]) for i in range(300)}


def test_latch_example(spark):
    on = [False, True, True, True, False, False, False]
    df = spark.createDataFrame([("a", i, x, not x, True) for i, x in enumerate(on)], "station string, k long, o boolean, f boolean, v boolean")
    got = latch(df, "station", "k", {"l": LatchRule("o", "f", "v", 2, 2)}).orderBy("k").toPandas()["l"].tolist()
    assert got == [False, False, True, True, True, False, False]


def test_latch_blocks_equal_one_pass(spark):
    rnd = random.Random(5)
    rows = [("a", i, rnd.random() < 0.5, rnd.random() < 0.5, rnd.random() < 0.95) for i in range(200)]
    df = spark.createDataFrame(rows, "station string, k long, o boolean, f boolean, v boolean")
    rule = {"l": LatchRule("o", "f", "v", 2, 3)}
    state, count, want = False, 0, []
    for _, _, o, f, v in rows:
        if not v:
            state, count = False, 0
        else:
            count = count + 1 if (f if state else o) else 0
            if count >= (3 if state else 2):
                state, count = not state, 0
        want.append(state)
    for size in (7, 4096):
        assert latch(df, "station", "k", rule, size=size).orderBy("k").toPandas()["l"].tolist() == want


def test_events_merge_and_drop(spark):
    mask = [1, 1, 0, 0, 1, 0, 0, 0, 0, 1]
    df = spark.createDataFrame([("a", i, bool(x)) for i, x in enumerate(mask)], "station string, k long, m boolean")
    assert [(r["first"], r["last"]) for r in bool_events(df, "station", "k", "m", 2, 2).collect()] == [(0, 4)]


def test_dedup_anchor_moves(spark):
    rows = [("P", 0, 0.5), ("P", 900_000, 0.9), ("P", 1_800_000, 0.4), ("P", 3_000_000, 0.1), ("P", 3_000_000, None)]
    df = spark.createDataFrame([(w, u, p, i, "m") for i, (w, u, p) in enumerate(rows)], "wave string, us long, p double, pick_id long, model string")
    assert sorted(r.us for r in dedup(df, ["wave"], 1_000_000).collect()) == [900_000, 3_000_000]
    assert dedup(df.limit(0), ["wave"], 1_000_000).count() == 0


def test_tiers_and_spikes(spark):
    df = spark.createDataFrame([(0.0, 150.0, -150.0), (500.0, 1.0, 1.0), (4000.0, 1.0, 1.0), (None, 1.0, 1.0)], "r double, d double, n double")
    got = [r[0] for r in df.select(tiers.flag(F.col("r"), F.abs("r"), tiers.spike(F.col("d"), F.col("n")))).collect()]
    assert got == ["anomaly", "major_storm", "invalid", "invalid"]


def test_harmonic_baseline_recovers_a_daily_curve(spark):
    x = [10 + 5 * math.sin(2 * math.pi * i / 144) + (200 if i == 300 else 0) for i in range(432)]
    df = grid_of(spark, x).withColumns({"kp": F.lit(1.0), "dst": F.lit(-5.0)})
    got = harmonic_baseline(df, "station", 600).orderBy("k").toPandas()["baseline"].to_numpy()
    want = np.array([10 + 5 * math.sin(2 * math.pi * i / 144) for i in range(432)])
    assert len(got) == 432 and np.abs(got - want)[1:-1].max() < 0.5


def test_causal_baseline_sees_no_future(spark):
    rnd = random.Random(1)
    x = [rnd.gauss(0, 2) + 5 * math.sin(2 * math.pi * i / 144) for i in range(400)]
    whole = causal_baseline(grid_of(spark, x), "station", 600).where("k < 300").orderBy("k").toPandas()["baseline"].to_numpy()
    cut = causal_baseline(grid_of(spark, x[:300]), "station", 600).orderBy("k").toPandas()["baseline"].to_numpy()
    assert np.allclose(whole[1:], cut[1:], equal_nan=True)
