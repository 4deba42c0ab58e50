"""Queries over stations at their own cadence."""

from datetime import datetime, timedelta, timezone

import pytest
from compare import SF, views

from fieldwatch.plans import registry
from fieldwatch.plans.activity import window_sizes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A station of one-minute and one of 20-second readings, each with a spike of one reading and a gap of six."""
    at = tmp_path_factory.mktemp("native")
    t0 = datetime(2024, 5, 10, tzinfo=timezone.utc)
    rows = [(s, t0 + timedelta(seconds=c * i), 500.0 if i == 700 else float(i % 5)) for s, c in (("MIN", 60), ("FAST", 20)) for i in range(1500) if not 900 <= i < 906]
    spark.createDataFrame(rows, "observatory string, ts timestamp, residual double").write.parquet(f"{at}/residuals.parquet")
    spark.createDataFrame([("MIN", 60), ("FAST", 20), ("OTHER", 3600)], "station string, cadence_s int").write.parquet(f"{at}/stations.parquet")
    return str(at)


def test_spike_of_one_reading(spark, folder):
    assert registry.QUERIES["spike_reversal"](spark, folder).count() == 0
    assert {(r.station, r.v, r.cadence_s) for r in registry.QUERIES["native_spike_reversal"](spark, folder).collect()} == {("MIN", 500.0, 60), ("FAST", 500.0, 20)}


def test_gap_of_minutes(spark, folder):
    for name, known in (("forward", 1497), ("both", 1500)):
        got = {r.station: (r.n, r.known) for r in registry.QUERIES[f"native_gap_fill_{name}"](spark, folder).groupBy("station").agg({"*": "count", "filled": "count"}).toDF("station", "n", "known").collect()}
        assert got == {"MIN": (1500, known), "FAST": (1500, known)}


def test_windows_hold_their_minutes(spark, folder):
    assert {n: k for n, (_, k) in window_sizes(60).items()} == {"fast": 5, "medium": 15, "upper": 30, "slow": 60, "slow3": 180, "peak": 5}
    assert {n: k for n, (_, k) in window_sizes(20).items()} == {"fast": 15, "medium": 45, "upper": 90, "slow": 180, "slow3": 361, "peak": 15}
    peak = registry.QUERIES["native_rolling_peak"](spark, folder).where("peak = 500").groupBy("station").count().collect()
    assert {r.station: r["count"] for r in peak} == {"MIN": 5, "FAST": 15}


def test_grid_and_spikes_equal_plain_sql(spark):
    con = views()
    con.execute("""create view gr as with rd as (select observatory as station, cadence_s as c, epoch_us(ts) // 1000000 as s, residual as v from residuals join (select station, max(cadence_s) as cadence_s from stations group by 1) x on observatory = x.station
  where residual is not null and not isnan(residual) and not isinf(residual) and residual <> 99999.0 and abs(residual) <= 3000),
g0 as (select station, c, (s // c)::bigint as k, round(avg(v), 9) as v from rd group by 1, 2, 3), gk as (select station, c, unnest(range(min(k), max(k) + 1)) as k from g0 group by 1, 2)
select gk.station, gk.c, gk.k, g0.v from gk left join g0 using (station, k)""")
    grid = registry.QUERIES["native_regular_grid"](spark, SF)
    assert {(r.station, r.cadence_s, r.k, r.v) for r in grid.collect()} == set(con.sql("select station, c, k, v from gr").fetchall())
    want = con.sql("select station, k from (select *, v - lag(v) over w as d, lead(v) over w - v as n from gr window w as (partition by station order by k)) where abs(d) > 100 and abs(n) > 100 and sign(n) <> sign(d)").fetchall()
    assert want and sorted((r.station, r.k) for r in registry.QUERIES["native_spike_reversal"](spark, SF).collect()) == sorted(want)
