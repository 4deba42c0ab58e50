"""Grid, control charts and raw lines: production rules on small frames with every kind of dirt."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldwatch.operators.controlchart import FieldRule, flag_readings
from fieldwatch.operators.gridfill import holdout_error, regular_series
from fieldwatch.plans.quality import RULES
from fieldwatch.sources.rawcsv import exact, judge_lines, typed_rows

T0 = datetime(1998, 1, 1)
GRID = "field string, station string, ts timestamp_ntz, value double, received_at timestamp_ntz, cadence_s int"


def grid_rows(spark, seconds, cadence=60, station="s"):
    rows = [("residual", station, T0 + timedelta(seconds=s), float(s), T0 + timedelta(seconds=s + 5), cadence) for s in seconds]
    return spark.createDataFrame(rows, GRID)


def test_every_period_once(spark):
    rnd = random.Random(0)
    seconds = sorted(rnd.sample(range(0, 60 * 9000), 300)) + [17, 17]
    out = regular_series(grid_rows(spark, seconds), F.lit(True)).toPandas().sort_values("period_start")
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    seen = {(base + s) // 60 for s in seconds}
    assert out["period_start"].tolist() == [k * 60 for k in range(min(seen), max(seen) + 1)]
    assert {p // 60 for p, s in zip(out["period_start"], out["status"]) if s == "observed"} == seen
    assert out["value"].notna().all()


def test_fill_follows_a_daily_curve(spark):
    import math

    keep = [s for s in range(0, 86400 * 4, 600) if not 86400 * 2 <= s < 86400 * 2 + 43200]
    rows = grid_rows(spark, keep, 600).withColumn("value", 10 * F.sin(F.unix_timestamp(F.col("ts").cast("timestamp")) * (2 * math.pi / 86400)))
    out = regular_series(rows, F.lit(True)).where("status = 'filled'").toPandas()
    want = [10 * math.sin(2 * math.pi * (p + 300) / 86400) for p in out["period_start"]]
    assert len(out) == 72 and max(abs(a - b) for a, b in zip(out["value"], want)) < 1.0


def test_an_implausible_reading_bridges_nothing(spark):
    rows = grid_rows(spark, [*range(0, 6000, 60), *range(6600, 12000, 60)]).withColumn("value", F.when(F.minute("ts") + 60 * F.hour("ts") == 99, 99998.0).otherwise(5.0))
    out = {r.period_start % 86400 // 60: (r.value, r.status) for r in regular_series(rows, F.abs("value") <= 3000).collect()}
    assert out[99] == (99998.0, "observed") and all(out[m][1] == "filled" and abs(out[m][0] - 5) < 1e-6 for m in range(100, 110))
    only = regular_series(grid_rows(spark, [0, 300]).withColumn("value", F.lit(99998.0)), F.abs("value") <= 3000).collect()
    assert sorted(r.status for r in only) == ["missing"] * 4 + ["observed"] * 2


def test_equally_near_readings_have_an_order(spark):
    at = lambda s, v, late: ("residual", "s", T0 + timedelta(seconds=s), v, T0 + timedelta(seconds=late), 60)
    rows = [at(20, 1.0, 100), at(40, 2.0, 90), at(20, 3.0, 100), at(5, 9.0, 500)]
    for k in range(3):
        frame = spark.createDataFrame(rows[k:] + rows[:k], GRID).repartition(3)
        assert [(r.value, r.readings) for r in regular_series(frame, F.lit(True)).collect()] == [(3.0, 4)]


def test_holdout_error_is_small_on_a_daily_curve(spark):
    import math

    rows = grid_rows(spark, range(0, 86400 * 6, 600), 600).withColumn("value", 10 * F.sin(F.unix_timestamp(F.col("ts").cast("timestamp")) * (2 * math.pi / 86400)))
    r = holdout_error(rows, F.lit(True)).first()
    assert r.periods > 10 and r.mae_filled < 0.5 and r.mae_filled < r.mae_line


def test_grid_of_odd_input(spark):
    assert regular_series(grid_rows(spark, []), F.lit(True)).count() == 0
    odd = grid_rows(spark, [1]).unionByName(grid_rows(spark, [1, 200], cadence=0, station="t")).withColumn("ts", F.when(F.col("station") == "t", F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts")))
    assert regular_series(odd, F.lit(True)).count() == 1


def brute(rows, rule, cadence):
    """Flagged ids of one station's (us, id, value), by definition, with the true scatter given."""
    import statistics

    first = {}
    for us, i, v in sorted(rows):
        first.setdefault(us, v)
    t = sorted(first)
    v = [first[x] for x in t]
    sigma = statistics.median(abs(b - a) for a, b in zip(v, v[1:])) / 0.954
    lim = rule.spike * (sigma if rule.relative else 1)
    bad = {i for _, i, x in rows if not rule.low <= x <= rule.high}
    for r in (1, 2, 3):
        for i in range(1, len(v) - r):
            a, b = v[i - 1], v[i + r]
            if abs(a - b) < lim and all(min(abs(x - a), abs(x - b)) > lim for x in v[i: i + r]):
                if rule.max_gap_periods and max(t[i] - t[i - 1], t[i + r] - t[i + r - 1]) > rule.max_gap_periods * cadence * 1e6:
                    continue
                bad |= {k for us, k, x in rows if us in t[i: i + r] and min(abs(x - a), abs(x - b)) > lim}
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if j - i + 1 >= 12 and (rule.stuck_above is None or v[i] > rule.stuck_above):
            bad |= {k for us, k, x in rows if us in t[i: j + 1] and x == v[i]}
        i = j + 1
    return bad


@pytest.mark.parametrize("target", [60, 400, 100_000])
def test_flags_equal_definition_at_any_partitioning(spark, target):
    rnd = random.Random(4)
    rows, want = [], set()
    for station, scale, n in (("a", 2.0, 900), ("b", 30.0, 300), ("c", 1.0, 40)):
        mine = []
        level = 0.0
        for i in range(n):
            if i == n // 2:
                level = 80 * scale  # a lasting shift
            mine.append([i * 60_000_000, i + len(rows), round(rnd.gauss(level, scale), 2)])
        for at, width in ((n // 5, 1), (n // 4, 2), (n // 3, 3), (n - 4, 1)):
            for k in range(width):
                mine[at + k][2] += 60 * scale * (1 if rnd.random() < 0.5 else -1)
        if n > 200:
            for k in range(14):
                mine[n * 2 // 3 + k][2] = 1.25
            mine[10][2] = 88888.0
        mine += [[us, 100_000 + i + len(rows), v] for us, i, v in rnd.sample(mine, n // 10)]  # copies
        want |= {("residual", i) for i in brute([tuple(m) for m in mine], RULES[0], 60)}
        rows += [("residual", station, us, i, v) for us, i, v in mine]
    hot = [("residual", "a", 0, 500_000 + i, -500.0) for i in range(400)]  # a third of all rows copies one reading
    rows += hot
    df = spark.createDataFrame(rows, "field string, station string, ts_us long, row_id long, value double")
    cadence = spark.createDataFrame([("a", 60), ("b", 60), ("c", 60)], "station string, cadence_s int")
    got = {(r.field, r.row_id) for r in flag_readings(df, RULES, cadence, target_rows=target).collect()}
    assert got == want


def test_flags_of_odd_input(spark):
    cadence = spark.createDataFrame([("a", 60)], "station string, cadence_s int")
    empty = spark.createDataFrame([], "field string, station string, ts_us long, row_id long, value double")
    assert flag_readings(empty, RULES, cadence).count() == 0
    odd = spark.createDataFrame([("residual", None, 1, 1, 9e9), (None, "a", 1, 2, 9e9), ("residual", "a", None, 3, 9e9), ("residual", "a", 1, 4, 9e9), ("other", "a", 1, 5, 9e9)], empty.schema)
    assert [r.row_id for r in flag_readings(odd, [FieldRule("residual", -3000, 3000, 15, relative=True)], cadence).collect()] == [4]


GOOD = "A,2001-01-01 00:00,1.0,2,3,4,5,"
CASES = {
    GOOD + "Rain": None, GOOD + '"a ""b"", c"': None, 'A,"2001-01-01 00:00", 1.5 ,,,, 7 ,': None, GOOD + 'Rain "heavy': "quoting", GOOD + '"open': "quoting", GOOD + '"a"b': "quoting", GOOD + ' "q"': "quoting",
    "A,2001-01-01 00:00,1.0,2,3": "column_count", GOOD + "x,": "column_count", GOOD + "x,y": "column_count", "A,2001-02-30 00:00,1,2,3,4,5,": "invalid_value", "A,2001-01-01 24:00,1,2,3,4,5,": "invalid_value",
    "A,2001-01-01 00:00,61,2,3,4,5,": "invalid_value", "A,2001-01-01 00:00,1,2,3,4,36.5,": "invalid_value", "A,2001-01-01 00:00,1e1,2,3,4,5,": "invalid_value", "A,2001-01-01 00:00,٣,2,3,4,5,": "invalid_value",
    'A,2001-01-01 00:00,"1,5",2,3,4,5,': "invalid_value", 'A",2001-01-01': "quoting", "A,2001-01-01 00:00,nan,2,3,4,5,": "invalid_value",
}


def test_lines(spark):
    rows = [(1, "f", 1, "header"), (2, "f", 2, " "), (3, "f", 3, None)] + [(10 + i, "f", 10 + i, x) for i, x in enumerate(CASES)]
    rows += [(900, "g", 5, GOOD + "x" * 1_200_000), (901, "g", None, GOOD + "Fog"), (902, None, 7, GOOD + "Fog\nmore")]
    out = {r.line_id: r for r in judge_lines(spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string")).collect()}
    assert len(out) == len(rows)
    assert [out[i].status for i in (1, 2, 3, 900, 901)] == ["header", "blank", "blank", "valid", "valid"]
    assert {x: out[10 + i].reason for i, x in enumerate(CASES)} == CASES
    assert all(exact(x)[0] == why for x, why in CASES.items())
    typed = typed_rows(judge_lines(spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string"))).collect()
    first = next(r for r in typed if r.line_id == 10)
    assert (first.temperature, first.barometer, first.wind_direction, first.weather) == (1.0, 30.0, 50.0, "Rain")
