"""Weather files, chunked fetching, choice of sources, searches and the forecaster's parts."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from fieldwatch.operators import mlforecast as ml
from fieldwatch.operators import sweep as sw
from fieldwatch.sources import chunks, sinks, weatherfiles

HEADER = 'Longitude (x),Latitude (y),Date/Time (UTC),Temp (C),Dew Point Temp (C),Temp Flag,Rel Hum (%),Stn Press (kPa),Wind Spd (km/h),Wind Dir (10s deg)\n'


def test_hourly_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1.5,50,2001-01-01 00:00,10,3,,50,101.3,36,9\n1.5,50,soon,1,1,,1,1,1,1\n")
    (tmp_path / "b.csv").write_text(HEADER + "1.5,50,2001-01-01 01:00,x,3,,,,,\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    rows = weatherfiles.read_hourly(spark, paths).orderBy("ts").collect()
    assert [round(v, 6) for v in rows[0][1:]] == [10.0, 50.0, 1013.0, 10.0, 90.0] and list(rows[1][1:]) == [None] * 5 and len(rows) == 2
    assert weatherfiles.coordinates(spark, paths[0]) == (50.0, 1.5)
    with pytest.raises(ValueError):
        weatherfiles.find_columns(["Temp (C)"])


def test_synthetic_fill_is_reproducible(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 3.0) for i in range(200)], "id long, v double")
    a, b = (weatherfiles.synthetic_fill(df, "v", 3.3, 0.1, "id").orderBy("id").collect() for _ in range(2))
    assert a == b and all(r.v_synthetic == (r.id % 2 == 1) for r in a) and 3.25 < sum(r.v for r in a if r.v_synthetic) / 100 < 3.35


def test_chunks(spark):
    def fetch(station, day, days):
        if station == "bad":
            raise OSError("down")
        return f"{station} {day} {days}"

    rows = chunks.fetch_chunks(spark, fetch, ["a", "bad"], date(2024, 1, 1), 10, 7, tries=2, wait_s=0.0).collect()
    assert sorted(r.text for r in rows if r.text) == ["a 2024-01-01 7", "a 2024-01-08 3"]
    assert [r.error for r in rows if r.station == "bad"] == ["OSError: down"] * 2


def test_first_available(spark):
    mk = lambda rows: spark.createDataFrame(rows, "station string, month int, v int")
    out = chunks.first_available([mk([("a", 1, 1)]), mk([("a", 1, 2), ("a", 2, 2), (None, 1, 2)]), mk([("a", 2, 3)])], ["station", "month"])
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, 1), ("a", 2, 2), (None, 1, 2)]


def test_coordinate_search():
    runs = []

    def evaluate(settings):
        runs.append(len(settings))
        return [(s["a"] - 3) ** 2 + (s["b"] - 2) ** 2 + abs(s["c"] - 5) for s in settings]

    best, value = sw.coordinate_search(evaluate, {"a": [1, 3], "b": [1, 2]}, {"c": [0, 4, 5], "a": [2, 3]})
    assert best == {"a": 3, "b": 2, "c": 5} and value == 0 and runs[0] == 4
    assert sw.settings_fragment({"x": 1.0}, {"far": 0.01}) == "# far: 0.01\nx: 1\n"


def test_forecaster_parts(spark, tmp_path):
    rows = spark.range(400).select(F.lit("s").alias("station"), F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("m"), F.when(F.col("id") % 20 > 12, 1.0).otherwise(0.0).alias("y"))
    parts = ml.chrono_split(rows, "station", "k").groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("a")).collect()
    assert {(r.part, r.n, r.a) for r in parts} == {("train", 280, 0), ("calibrate", 60, 280), ("test", 60, 340)}
    model = ml.fit_classifier(rows, ["m"], "y", rounds=3)
    ml.save_bundle(model, str(tmp_path), features=["m"])
    again, facts = ml.load_bundle(str(tmp_path))
    told = ml.raw_probability(again, rows)
    assert facts["features"] == ["m"] and told.where("(p > 0.5) = (y = 1)").count() == 400
    assert ml.isotonic(told, "y")(told).where("calibrated between 0 and 1").count() == 400
    spark.createDataFrame([("0", "{}")], "version string, facts string").write.mode("overwrite").json(str(tmp_path / "manifest"))
    with pytest.raises(ValueError):
        ml.load_bundle(str(tmp_path))
    r = ml.against_persistence(spark.createDataFrame([(1.0, 1.5, 3.0), (None, 1.0, 1.0)], "t double, f double, l double"), "t", "f", "l").first()
    assert (r.mae, r.mae_persistence, r.n, r.gain) == (0.5, 2.0, 1, 0.75)
    assert [ml.context_length(x) for x in (336, 31, 64)] == [320, 31, 64]


def test_out_of_fold_trains_on_the_past(spark):
    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("m"), F.when(F.col("id") % 20 > 12, 1.0).otherwise(0.0).alias("y"))
    told = ml.out_of_fold(rows, ["m"], "y", "k", folds=3, gap=10, rounds=2)
    assert told.count() == 300 and told.agg(F.min("k")).first()[0] == 100 and told.where("(p > 0.5) = (y = 1)").count() == 300
    assert ml.out_of_fold(rows.where("y = 0"), ["m"], "y", "k").count() == 0 and ml.out_of_fold(rows.limit(0), ["m"], "y", "k").count() == 0


def test_violation_and_slice(spark):
    from fieldwatch.operators.series import analysis_rows

    df = spark.createDataFrame([(0.9, 0.005, 1), (0.5, None, 5), (None, 0.02, 9)], "precision double, far double, s long")
    got = [round(r[0], 6) for r in df.select(sw.violation({"precision": 0.8}, {"far": 0.01})).collect()]
    assert got == [0.0, 1.29, 0.81]
    assert [r.s for r in analysis_rows(df, "s", 2, 5).collect()] == [5] and analysis_rows(df, "s").count() == 3


def test_cached_chunks_are_not_fetched_again(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), tmp_path / "log"
    broken = tmp_path / "broken"
    broken.write_text("")

    def fetch(station, day, n):
        with open(log, "a") as f:
            f.write(f"{station} {day}\n")
        if station == "b" and broken.exists():
            raise OSError("down")
        return f"{station}:{day}:{n}"

    now = int(datetime(2024, 1, 20, tzinfo=timezone.utc).timestamp())
    ask = lambda: sorted((r.station, str(r.first_day), r.text, r.error is not None) for r in chunks.fetch_cached(spark, fetch, ["a", "b"], date(2024, 1, 1), 21, cache, now, tries=1, wait_s=0.0).collect())
    first = ask()
    assert len(first) == 6 and sum(r[3] for r in first) == 3 and len(log.read_text().splitlines()) == 6
    broken.unlink()
    second = ask()  # the two settled chunks of a are kept; the third ends in the future
    assert not any(r[3] for r in second) and len(second) == 6 and len(log.read_text().splitlines()) == 6 + 4
    assert ask() == second and len(log.read_text().splitlines()) == 6 + 4 + 2


def test_too_few_rows_for_a_forecaster(spark):
    rows = spark.range(1000).select(F.lit("a").alias("station"), F.col("id").alias("k"))
    with pytest.raises(ValueError, match="the table has 1000 rows"):
        ml.require_rows(ml.chrono_split(rows, "station", "k"))
    assert ml.require_rows(ml.chrono_split(rows, "station", "k"), 1000, 700, 150).count() == 1000


def test_arrays_are_described(spark):
    row = sinks.summarised(spark.createDataFrame([([1.0, 2.0], "x"), (None, "y")], "beta array<double>, name string")).orderBy("name").collect()
    assert row[0].beta.asDict() == {"type": "array", "shape": [2], "dtype": "double"} and row[1].beta is None
    cases = spark.createDataFrame([(0.9, 0.8), (0.7, None)], "p double, r double")
    assert sw.worst_case(cases, ["p", "r"]).first().floor == 0.0 and sw.worst_case(cases, ["p"]).first().floor == 0.7 and sw.worst_case(cases.limit(0), ["p"]).first().floor == 1.0
