"""Detector profile, event matching, objective, quantile, settings and column names of weather files."""

import random

import pytest
from pyspark.sql import functions as F

from fieldwatch.functions import tiers
from fieldwatch.operators import sweep
from fieldwatch.operators.latch import Profile, Trigger, event_totals, match_events
from fieldwatch.plans.evaluation import quantile
from fieldwatch.session import shared_dir
from fieldwatch.sources.settings import Settings, problems
from fieldwatch.sources.weatherfiles import find_columns


def test_profile_is_loaded_and_checked():
    assert Profile().problems() == []
    p = Profile.load({"unsettled": 5, "tiers": {"storm": {"level": 40.0, "triggers": [["medium", 1.0], ["peak", 2.0, 0.5]]}}})
    assert p.unsettled == 5 and p.tiers[1].level == 40.0 and p.tiers[1].triggers == (Trigger("medium", 1.0), Trigger("peak", 2.0, 0.5)) and p.tiers[0] == Profile().tiers[0]
    for bad in ({"speed": 1}, {"tiers": {"calm": {}}}, {"tiers": {"storm": {"height": 1}}}, {"tiers": {"storm": {"level": 5.0}}}, {"tiers": {"storm": {"release": 1.5}}}, {"tiers": {"major": {"triggers": [["mean", 1.0]]}}}, {"tiers": {"major": {"triggers": []}}}):
        with pytest.raises(ValueError):
            Profile.load(bad)


def test_a_reference_event_gets_its_second_overlap(spark):
    ev = "station string, first long, last long"
    ref = spark.createDataFrame([("a", 0, 10), ("a", 12, 30), ("b", 0, 5), ("c", 1, 2)], ev)
    pred = spark.createDataFrame([("a", 5, 14), ("a", 25, 26), ("b", 6, 9), ("d", 0, 1)], ev)
    out = match_events(ref, pred, "station", cell=8)
    got = {r.station: (r.reference, r.predicted, r.matched, r.missed, r.false_positive) for r in out.collect()}
    assert got == {"a": (2, 2, 2, 0, 0), "b": (1, 1, 0, 1, 1), "c": (1, 0, 0, 1, 0), "d": (0, 1, 0, 0, 1)}
    t = event_totals(out).first()
    assert (t.reference, t.predicted, t.matched, t.precision, t.recall, t.f1) == (4, 4, 2, 0.5, 0.5, 0.5)
    none = event_totals(match_events(ref.limit(0), pred.limit(0), "station")).first()
    assert none.reference == 0 and none.precision is None and none.f1 is None


def test_unknown_costs_count_as_one(spark):
    row = spark.createDataFrame([(None, None, 0.1, 0.2, None, 0.0, 1.0, 2.0)], ", ".join(f"{m} double" for m, _, _ in sweep.COSTS))
    assert row.select(sweep.objective(0.9).alias("o")).first().o == pytest.approx(10 + 5 + 0.1 + 0.1 + 1 + 0 + 0.5 + 0.5)


def test_bucket_is_the_number_of_cuts_reached(spark):
    cuts = [1.0, 2.0, 2.5, 7.0]
    df = spark.createDataFrame([(x,) for x in (None, 0.5, 1.0, 2.2, 2.5, 6.9, 7.0, 9.0)], "x double")
    assert [r.b for r in df.select(sweep.bucket(F.col("x"), cuts).alias("b")).collect()] == [None, 0, 1, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("share", [0.0, 0.37, 0.5, 0.99, 1.0])
def test_quantile(spark, share):
    rnd = random.Random(1)
    x = [round(rnd.expovariate(0.1), 2) for _ in range(301)] + [5.0] * 100
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    assert quantile(df, "x", share, cells=16).first().x == pytest.approx(df.agg(F.percentile("x", share)).first()[0])
    assert quantile(df.limit(0), "x", share).first().x is None and quantile(df.where("x = 5"), "x", share).first().x == 5.0


def test_live_cross_check(spark):
    rows = [("quiet", 5.0, None, "missed_global_event"), ("quiet", 4.0, None, "under_reacting"), ("unsettled", 6.0, None, "under_reacting"), ("major_storm", 3.0, -29.0, "unconfirmed_storm"), ("major_storm", None, -31.0, "ok"), ("quiet", None, None, "ok")]
    df = spark.createDataFrame(rows, "flag string, kp double, dst double, want string")
    assert df.where(tiers.cross_check_live(F.col("flag"), F.col("kp"), F.col("dst")) != F.col("want")).count() == 0


def test_settings_and_columns():
    assert problems(Settings()) == [] and len(problems(Settings(baseline_step_h=0.0))) == 1 and problems(Settings(jump_nt=float("nan")))
    names = ["Date/Time (LST)", "Dew Point Temp", "Temp Flag", "Temp (C)", "Humidity dew", "Barometer", "Wind Speed (km/h)", "Wind Dir (10s deg)"]
    assert find_columns(names) == {"time": names[0], "temperature": "Temp (C)", "humidity_prec": "Humidity dew", "barometer": "Barometer", "wind_speed": names[6], "wind_direction": names[7]}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, other=None: {"spark.master": "spark://host:7077"}.get(name, other))

    with pytest.raises(RuntimeError):
        shared_dir(Session)
