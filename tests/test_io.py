"""Readers, writers, settings, waveforms and streams."""

import json

import pytest
from pyspark.sql import functions as F

from fieldwatch.operators import waveform
from fieldwatch.operators.latch import LatchRule, latch
from fieldwatch.sources import settings, sinks
from fieldwatch.sources.messages import channel_parts, read_messages
from fieldwatch.sources.observatory import FormatError, iaga_header, parse_iaga
from fieldwatch.streaming import live


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_iaga(spark):
    df = lines(spark, " Format  IAGA-2002 |", "DATE       TIME  DOY  VICX  VICY  VICZ  VICF |", "# note", "", "2024-01-01 00:00:00.000 001 1.5 99999.00 88888.00 x",
               "2024-01-01 00:01:00.000 001 1.5", "2024-13-01 00:00:00.000 001 1 1 1 1")
    rows = parse_iaga(df, iaga_header(df)).collect()
    assert [(r.x_nt, r.y_nt, r.z_nt, r.f_nt) for r in rows] == [(1.5, None, 88888.0, None)]
    for bad in (lines(spark, "<html>"), lines(spark, "DATE TIME DOY X"), lines(spark)):
        with pytest.raises(FormatError):
            iaga_header(bad)


def test_messages_from_files(spark, tmp_path):
    good = {"sequence_number": 1, "timestamp": [{"seconds": 10, "nanoseconds": 5000, "source": "s"}], "payload": {"channel_id": "A.B.C.BHZ", "sample_rate": 1.0, "sample_count": 2, "samples": [1, 2]}}
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"timestamp": []})]))
    rows = read_messages(spark, str(tmp_path), "seismic").collect()
    assert [(r.us, r.samples) for r in rows] == [(10_000_005, [1, 2])]
    parts = channel_parts(F.col("line"))
    got = lines(spark, "A.B.C.BH1", "A.B.BHZ").select(parts["key"].alias("k"), parts["component"].alias("c")).collect()
    assert [tuple(r) for r in got] == [("A.B.C", "N"), (None, None)]


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"tiers": {"unsettled_nt": 5}, "nonsense": 1}))
    with pytest.warns(UserWarning):
        assert settings.load(str(p)).unsettled_nt == 5.0
    for bad in ({"unsettled_nt": 50}, {"min_coverage": 2}, {"baseline_step_h": 48}, {"amplitude_mode": "x"}, {"alert_url": "ftp://x"}, {"jump_nt": True}, {"min_plausible_nt": 4000}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            settings.load(str(p))


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.load_state(spark, path, 0).count() == 0
    sinks.save_state(spark.createDataFrame([("a", 0, [1.0]), ("b", 0, [float("nan")]), ("c", -10**7, [1.0])], "station string, saved_s long, beta array<double>"), path)
    assert [r.station for r in sinks.load_state(spark, path, 3600).collect()] == ["a"]


def test_waveforms(spark):
    t = spark.createDataFrame([("k", 0, 10.0, list(range(100))), ("k", 12_000_000, 10.0, [7] * 10)], "key string, t0_us long, rate double, samples array<int>")
    merged = {r.i: r.v for r in waveform.merge_traces(t, "key").collect()}
    assert len(merged) == 130 and merged[99] == 99 and merged[110] == 0 and merged[125] == 7
    w = waveform.windows(t, "key", 4.0, 2.0, least=50).orderBy("start_us").collect()
    assert [(r.idx, r.start_us, r.samples[0], len(r.samples)) for r in w][:3] == [(0, 0, 0, 50), (1, 2_000_000, 20, 50), (2, 4_000_000, 40, 50)]
    up = waveform.resample(t, 20.0).collect()
    assert [len(r.samples) for r in sorted(up, key=lambda r: r.t0_us)] == [200, 20]
    waveform.register("count", lambda: lambda b: b[["key"]].assign(n=b["samples"].map(len)))
    assert sorted(r.n for r in waveform.apply_backend(t, "count", "key string, n long").collect()) == [10, 100]


def test_stream_equals_batch(spark, tmp_path):
    values = [0, 40, 50, 60, 5, 5, 50, 5, 5, 5, None, 50, 50, 50]
    df = spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "station string, k long, m double")
    for i in range(3):
        df.where(f"k % 14 div 5 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    flow = live.live_latch(stream, "station", "k", "m", 35, 10, 2, 2)
    live.run_available(flow, str(tmp_path / "ck"), lambda b, i: got.extend((r.k, r.latched) for r in b.collect()))
    ready = df.withColumns({"o": F.col("m") >= 35, "f": F.col("m") <= 10, "v": F.col("m").isNotNull()})
    want = [(r.k, r.l) for r in latch(ready, "station", "k", {"l": LatchRule("o", "f", "v", 2, 2)}).orderBy("k").collect()]
    assert sorted(got) == want


def test_windowed_stream(spark, tmp_path):
    df = spark.sql("select 'a' as station, timestamp_seconds(id * 600) as ts, cast(id as double) as v from range(30)")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    flow = live.windowed_amplitude(live.table_stream(spark, str(tmp_path / "in"), df.schema), "station", "v")
    live.run_available(flow, str(tmp_path / "ck"), lambda b, i: got.extend(r.amp for r in b.collect()), "update")
    assert max(got) == 17.0
    assert live.fresh(10_000, 9_000) and not live.fresh(10_000, None) and not live.fresh(10_000, 20_000)


def test_sinks(spark, tmp_path):
    picks = spark.createDataFrame([("s", 1, "P", 0.5, "m", 1), ("s", 2, "S", None, "m", 2)], "sta string, us long, wave string, p double, model string, pick_id long")
    doc = json.loads(sinks.pick_documents(picks, ["sta"]).first().document)
    assert doc["count"] == 2 and [p["wave"] for p in doc["picks"]] == ["P", "S"]
    sinks.write_documents(sinks.provenance(picks, version="1"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).select("provenance.version").distinct().collect()[0][0] == "1"
    sent = []
    sinks.deliver_alerts(sent.append)(spark.createDataFrame([("a", True), ("b", False)], "station string, alert boolean"), 3)
    assert sent == [{"station": "a", "alert": True, "batch_id": 3}]
