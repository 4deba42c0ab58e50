"""Weather queries: hourly series, backtests, error measures, physics and forecast records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwatch.functions.values import r9, sql9, usable
from fieldwatch.functions.weather import FIELDS, circular_diff, clear_sky, clip_field
from fieldwatch.operators import backtest as bt
from fieldwatch.operators.blocks import positions
from fieldwatch.operators.series import regular_grid
from fieldwatch.plans.base import seconds
from fieldwatch.session import table

KEYS = ["station", "field"]
CONTEXT, HORIZON, SPLITS, SEASON = 24, 6, 3, 24
#: Context and horizon in hours and origins of the full benchmark; the smaller tables have no series so long.
FULL = (336, 24, 5)


def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Usable readings of all fields in long form: (station, field, s, v)."""
    w = table(spark, sf, "weather_readings").select("station", seconds().alias("s"), *FIELDS)
    long = w.unpivot(["station", "s"], FIELDS, "field", "v")
    return long.where(usable(F.col("v")))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means per station and field, hours without value left out, numbered: (station, field, k, v, i)."""
    means = field_rows(spark, sf).groupBy(*KEYS, F.floor(F.col("s") / 3600).cast("long").alias("k")).agg(r9(F.avg("v")).alias("v"))
    return positions(means, KEYS, "k")


def hourly_fields(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf)


def _scored(spark: SparkSession, sf: str, backend: str, sizes: tuple[int, int, int] = (CONTEXT, HORIZON, SPLITS)) -> DataFrame:
    s = hourly(spark, sf).drop("k")
    at = bt.origins(s, KEYS, *sizes)
    e = bt.errors(bt.forecast(s, at, KEYS, sizes[1], backend, SEASON), s, KEYS, F.col("field") == "wind_direction")
    return e.join(bt.mase_scale(s, at, KEYS, SEASON), [*KEYS, "split"]).withColumn("mase", F.col("mae") / F.col("scale"))


def _average(backend: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _scored(spark, sf, backend).groupBy("field").agg(*[r9(F.avg(c)).alias(f"avg_{c}") for c in ("mae", "rmse", "mase", "crps")], F.count(F.lit(1)).alias("splits"))

    return query


def full_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Both simple forecasts at the full benchmark's sizes: 336 hours before each of five origins, 24 hours after."""
    parts = [_scored(spark, sf, b, FULL).withColumn("backend", F.lit(b)) for b in ("persistence", "seasonal_naive")]
    return parts[0].unionByName(parts[1]).groupBy("backend", "field").agg(*[r9(F.avg(c)).alias(f"avg_{c}") for c in ("mae", "rmse", "mase", "crps")], F.count(F.lit(1)).alias("splits"))


def mase_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = hourly(spark, sf).drop("k")
    return bt.mase_scale(s, bt.origins(s, KEYS, CONTEXT, HORIZON, SPLITS), KEYS, SEASON).withColumn("scale", r9("scale"))


def circular_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "persistence").where("field = 'wind_direction'").select("station", "split", r9("mae").alias("mae"), r9("rmse").alias("rmse"))


def pinball_crps(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "seasonal_naive").select(*KEYS, "split", r9("crps").alias("crps"))


def backtest_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Backends in order of MASE per field."""
    both = [_average(b)(spark, sf).withColumn("backend", F.lit(b)) for b in ("persistence", "seasonal_naive")]
    w = Window.partitionBy("field").orderBy(F.coalesce("avg_mase", F.lit(999.0)), "backend")  # two rows a field
    return both[0].unionByName(both[1]).select("field", "backend", "avg_mase", F.row_number().over(w).cast("long").alias("place"))


def poison_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly grid of every field, missing hours as NULL."""
    series = F.concat_ws("|", "station", "field")
    g = regular_grid(field_rows(spark, sf).select(series.alias("id"), "s", "v"), "id", "s", "v", 3600)
    return bt.poisoned(g, ["id"]).select(F.split("id", r"\|")[0].alias("station"), F.split("id", r"\|")[1].alias("field"), "reason")


def _sky_rows(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf).where("field = 'irradiance'")
    lat = table(spark, sf, "stations").select("station", "latitude")
    t = F.timestamp_seconds(F.col("k") * 3600)
    return h.join(lat, "station").withColumn("sky", clear_sky(F.col("latitude"), F.dayofyear(t), F.hour(t).cast("double")))


def clear_sky_q(spark: SparkSession, sf: str) -> DataFrame:
    return _sky_rows(spark, sf).select("station", "k", r9("sky").alias("sky"))


def kt_scaled_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Irradiance of the next hours: clear sky times the median clearness of the last 72 daytime hours (1 with 24 or fewer)."""
    rows = _sky_rows(spark, sf)
    day = rows.where("sky > 0")
    ranked = day.withColumn("n", F.row_number().over(Window.partitionBy("station").orderBy(F.col("k").desc())))
    kt = F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col("v") / F.col("sky")))
    clearness = ranked.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("n") <= 72, kt), 0.5).alias("kt"))
    last = rows.groupBy("station", "latitude").agg(F.max("k").alias("k0"))
    ahead = last.join(clearness, "station", "left").withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(HORIZON).cast("long"))))
    t = F.timestamp_seconds((F.col("k0") + F.col("h")) * 3600)
    sky = clear_sky(F.col("latitude"), F.dayofyear(t), F.hour(t).cast("double"))
    factor = F.when(F.col("n") > 24, F.col("kt")).otherwise(1.0)
    return ahead.select("station", "h", r9(F.greatest(F.lit(0.0), sky * factor)).alias("p50"))


def _latest(spark: SparkSession, sf: str, field: str, tail: int) -> DataFrame:
    """The last ``tail`` values of a field with the series' last value: (station, v, last)."""
    h = hourly(spark, sf).where(F.col("field") == field)
    end = h.groupBy("station").agg(F.max("i").alias("n"), F.max_by("v", "i").alias("last"))
    return h.join(end, "station").where(F.col("i") > F.col("n") - tail)


def stable_weather_override(spark: SparkSession, sf: str) -> DataFrame:
    """Temperature where it hardly changes: last value, spread at least 0.3 and half that of the model (persistence)."""
    t = _latest(spark, sf, "temperature", 48).groupBy("station", "last").agg(F.stddev_pop("v").alias("std"))
    sigma = F.greatest(F.lit(1e-3), F.col("std"))
    wide = F.greatest(F.col("std"), F.lit(0.3), 1.28 * sigma * 0.5)
    s = F.when(F.col("std") < 1.5, wide).otherwise(sigma)
    return t.select("station", (F.col("std") < 1.5).alias("stable"), r9(F.col("last") - 1.28 * s).alias("p10"), F.col("last").alias("p50"), r9(F.col("last") + 1.28 * s).alias("p90"))


def wind_direction_persistence(spark: SparkSession, sf: str) -> DataFrame:
    w = _latest(spark, sf, "wind_direction", 48).groupBy("station", "last").agg(F.greatest(F.lit(1e-3), F.avg(circular_diff(F.pmod("v", F.lit(360.0)), F.pmod("last", F.lit(360.0))))).alias("noise"))
    at = lambda z: r9(F.pmod(F.col("last") + F.lit(z) * F.col("noise"), F.lit(360.0)))
    return w.select("station", at(-1.28).alias("p10"), at(0.0).alias("p50"), at(1.28).alias("p90"))


def forecast_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per field and step: its persistence forecast with the last values of all fields beside it."""
    end = hourly(spark, sf).groupBy(*KEYS).agg(F.max("k").alias("k0"), F.max_by("v", "k").alias("last"))
    wide = end.groupBy("station").pivot("field", FIELDS).agg(F.round(F.first("last"), 2))
    steps = end.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(HORIZON).cast("long")))).join(wide, "station")
    return steps.select("station", "field", "h", ((F.col("k0") + F.col("h")) * 3600).alias("at"), F.round(clip_field(F.col("field"), F.col("last")) + 1e-7, 2).alias("p50"), *[F.col(f).alias(f"now_{f}") for f in FIELDS])


def forecast_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """The last 24 values against the persistence forecast from before them: outside the outer levels or z over 3."""
    h = hourly(spark, sf)
    end = h.groupBy(*KEYS).agg(F.max("i").alias("n")).where(f"n >= {CONTEXT + 24}")
    at = end.select(*KEYS, F.lit(0).cast("long").alias("split"), (F.col("n") - 24).alias("origin"))
    told = bt.forecast(h.drop("k"), at, KEYS, 24, "persistence").withColumn("i", F.col("origin") + F.col("h"))
    rows = told.join(h, [*KEYS, "i"])
    circ = F.col("field") == "wind_direction"
    reach = 1.28 * F.col("sigma")
    wide = F.greatest(F.lit(1e-3), F.when(circ, circular_diff(2 * reach, F.lit(0.0)) / 2).otherwise(reach))
    z = F.when(circ, circular_diff(F.col("v"), F.col("p50"))).otherwise(F.abs(F.col("v") - F.col("p50"))) / wide
    out = (z > 3) | (~circ & (F.abs(F.col("v") - F.col("p50")) > 1.28 * F.col("sigma")))
    return rows.where(out).select(*KEYS, "k", "v", r9("p50").alias("p50"), r9(z).alias("z"))


def clip_fields(spark: SparkSession, sf: str) -> DataFrame:
    return field_rows(spark, sf).groupBy("field").agg(F.min(clip_field(F.col("field"), F.col("v") - 50)).alias("low"), F.max(clip_field(F.col("field"), F.col("v") + 50)).alias("high"))


_HOUR = """
with wr as (select station, epoch_us(ts) // 1000000 as s, """ + ", ".join(FIELDS) + """ from weather_readings),
lo as (select station, s, field, v from wr unpivot (v for field in (""" + ", ".join(FIELDS) + """)) where not isnan(v) and not isinf(v)),
ho as (select *, row_number() over (partition by station, field order by k) as i from (select station, field, (s // 3600)::bigint as k, round(avg(v), 9) as v from lo group by 1, 2, 3))
"""
_ORIGIN = _HOUR + f""",
nn as (select station, field, max(i) as n from ho group by 1, 2),
og as (select * from (select station, field, n, sp as split, {CONTEXT} + sp * greatest(1, floor((n - {CONTEXT} - {HORIZON}) / {SPLITS}))::bigint as origin from nn, (select unnest(range(0, {SPLITS})) as sp)) where origin + {HORIZON} <= n),
sg as (select og.station, og.field, og.split, greatest(1e-3, stddev_pop(ho.v)) as sigma from og join ho on ho.station = og.station and ho.field = og.field and ho.i between og.origin - 47 and og.origin group by 1, 2, 3),
df as (select *, abs(v - lag(v, {SEASON}) over w) as ds, abs(v - lag(v) over w) as d1 from ho window w as (partition by station, field order by i)),
sc as (select station, field, split, case when s = 0 then 1e-4 else s end as scale from (select og.station, og.field, og.split, avg(case when og.origin > {SEASON} then ds else d1 end) as s from og join df on df.station = og.station and df.field = og.field and df.i <= og.origin group by 1, 2, 3)),
hz as (select og.*, unnest(range(1, {HORIZON + 1})) as h from og)
"""


def _errors_sql(source: str) -> str:
    circ = "least(abs(y - p) % 360, 360 - abs(y - p) % 360)"
    pins = []
    for q, z in ((0.1, -1.28), (0.5, 0.0), (0.9, 1.28)):
        f = f"(p + {z} * sigma)"
        fm = f"((({f} % 360) + 360) % 360)"
        pins.append(f"case when field = 'wind_direction' then {q} * least(abs(y - {fm}) % 360, 360 - abs(y - {fm}) % 360) else greatest({q}::double * (y - {f}), ({q} - 1)::double * (y - {f})) end")
    return _ORIGIN + f""",
fc as (select hz.station, hz.field, hz.split, hz.h, b.v as p, t.v as y, sg.sigma from hz join ho b on b.station = hz.station and b.field = hz.field and b.i = {source}
  join ho t on t.station = hz.station and t.field = hz.field and t.i = hz.origin + hz.h join sg on sg.station = hz.station and sg.field = hz.field and sg.split = hz.split),
er as (select station, field, split, avg(e) as mae, sqrt(avg(e * e)) as rmse, avg(l) as crps from (select *, case when field = 'wind_direction' then {circ} else abs(y - p) end as e, ({' + '.join(pins)}) / 3 as l from fc) group by 1, 2, 3),
es as (select er.*, sc.scale, mae / scale as mase from er join sc on er.station = sc.station and er.field = sc.field and er.split = sc.split)
"""


_PERSIST, _SEASONAL = _errors_sql("hz.origin"), _errors_sql(f"hz.origin - least({SEASON}, hz.origin) + (hz.h - 1) % least({SEASON}, hz.origin) + 1")
_AVG = "field, " + ", ".join(f"round(avg({c}), 9) as avg_{c}" for c in ("mae", "rmse", "mase", "crps")) + ", count(*) as splits from es group by 1"
_SKY = "case when up <= 0 then 0.0 else greatest(0.0, 750.0 * up) end"
_UP = "sin(radians(latitude)) * sin(d) + cos(radians(latitude)) * cos(d) * cos(radians(15.0 * (hour(t) - 12)))"
_DECL = "radians(23.45 * sin(radians(360.0 / 365.0 * (dayofyear(t) - 81))))"


def _sky_sql(rows: str, name: str) -> str:
    return f"{name} as (select *, {_SKY} as sky from (select *, {_UP} as up from (select *, {_DECL} as d from ({rows}))))"


_SKYROWS = _HOUR + ", " + _sky_sql("select ho.*, latitude::double as latitude, make_timestamp(k * 3600000000) as t from ho join stations s on s.station = ho.station where field = 'irradiance'", "sk")
_LATEST = _HOUR + ", en as (select station, field, max(i) as n, max(k) as k0, arg_max(v, i) as last from ho group by 1, 2), la as (select ho.station, ho.field, ho.v, en.last from ho join en on ho.station = en.station and ho.field = en.field and ho.i > en.n - 48)"
_MOD = lambda x: f"((({x}) % 360 + 360) % 360)"
_CLIP = lambda v: f"case when field = 'humidity_prec' then greatest(0.0, least(100.0, {v})) when field = 'wind_direction' then {_MOD(v)} when field in ('wind_speed', 'irradiance') then greatest(0.0, {v}) else {v} end"
_NOW = ", ".join(f"round(max(last) filter (where field = '{f}'), 2) as now_{f}" for f in FIELDS)

def _second() -> str:
    """The seasonal backend's averages under other names, for one statement with both."""
    tail = _SEASONAL[_SEASONAL.index("fc as ("):].rstrip()
    for name in ("fc", "er", "es"):
        tail = tail.replace(f"{name} as (", f"{name}2 as (").replace(f"from {name} ", f"from {name}2 ").replace(f"from {name})", f"from {name}2)")
    tail = tail.replace("select er.*", "select er2.*").replace("er.station", "er2.station").replace("er.field", "er2.field").replace("er.split", "er2.split")
    return tail + ", b2 as (select field, 'seasonal_naive' as backend, round(avg(mase), 9) as avg_mase from es2 group by 1)"


QUERIES = {
    "hourly_fields": hourly_fields, "persistence_backtest": _average("persistence"), "seasonal_naive_backtest": _average("seasonal_naive"), "mase_scale": mase_scale, "full_backtest": full_backtest, "circular_metrics": circular_metrics,
    "pinball_crps": pinball_crps, "backtest_ranking": backtest_ranking, "poison_fields": poison_fields, "clear_sky": clear_sky_q, "kt_scaled_forecast": kt_scaled_forecast,
    "stable_weather_override": stable_weather_override, "wind_direction_persistence": wind_direction_persistence, "forecast_records": forecast_records, "forecast_anomalies": forecast_anomalies, "clip_fields": clip_fields,
}
SQL = {
    "hourly_fields": _HOUR + "select * from ho",
    "persistence_backtest": _PERSIST + "select " + _AVG, "seasonal_naive_backtest": _SEASONAL + "select " + _AVG,
    "mase_scale": _ORIGIN + "select station, field, split, round(scale, 9) as scale from sc",
    "circular_metrics": _PERSIST + "select station, split, round(mae, 9) as mae, round(rmse, 9) as rmse from es where field = 'wind_direction'",
    "pinball_crps": _SEASONAL + "select station, field, split, round(crps, 9) as crps from es",
    "poison_fields": _HOUR + """, gb as (select station, field, min(k) as a, max(k) as b from ho group by 1, 2), gg as (select station, field, unnest(range(a, b + 1)) as k from gb),
gv as (select gg.*, ho.v from gg left join ho on gg.station = ho.station and gg.field = ho.field and gg.k = ho.k), s1 as (select station, field, count(*) as n, count(v) as c, quantile_cont(v, 0.5) as med from gv group by 1, 2),
s2 as (select gv.station, gv.field, n, c, quantile_cont(abs(v - med), 0.5) as mad, max(abs(v - med)) as far from gv join s1 on gv.station = s1.station and gv.field = s1.field group by 1, 2, 3, 4)
select station, field, case when 1 - c / n > 0.15 then 'missing' when c < 24 then 'short' when mad < 1e-8 then 'flat' when far / (1.4826 * mad + 1e-12) > 5 then 'outlier' end as reason from s2""",
    "clear_sky": _SKYROWS + " select station, k, round(sky, 9) as sky from sk",
    "kt_scaled_forecast": _SKYROWS + f""", dy as (select *, row_number() over (partition by station order by k desc) as n from sk where sky > 0), kt as (select station, count(*) as n, quantile_cont(case when n <= 72 then greatest(0.0, least(1.5, v / sky)) end, 0.5) as kt from dy group by 1),
ah as (select a.station, a.latitude, kt.n, kt.kt, unnest(range(1, {HORIZON + 1})) as h, k0 from (select station, latitude, max(k) as k0 from sk group by 1, 2) a left join kt on kt.station = a.station), """
    + _sky_sql("select *, make_timestamp((k0 + h) * 3600000000) as t from ah", "fs") + " select station, h, round(greatest(0.0, sky * case when n > 24 then kt else 1.0 end), 9) as p50 from fs",
    "stable_weather_override": _LATEST + ", q as (select station, last, stddev_pop(v) as std from la where field = 'temperature' group by 1, 2), s as (select *, case when std < 1.5 then greatest(std, 0.3, 1.28 * greatest(1e-3, std) * 0.5) else greatest(1e-3, std) end as w from q) select station, std < 1.5 as stable, round(last - 1.28 * w, 9) as p10, last as p50, round(last + 1.28 * w, 9) as p90 from s",
    "wind_direction_persistence": _LATEST + f", q as (select station, last, greatest(1e-3, avg(least(abs({_MOD('v')} - {_MOD('last')}), 360 - abs({_MOD('v')} - {_MOD('last')})))) as w from la where field = 'wind_direction' group by 1, 2) select station, round({_MOD('last - 1.28 * w')}, 9) as p10, round({_MOD('last')}, 9) as p50, round({_MOD('last + 1.28 * w')}, 9) as p90 from q",
    "backtest_ranking": _PERSIST.rstrip() + ", b1 as (select field, 'persistence' as backend, round(avg(mase), 9) as avg_mase from es group by 1), " + _second() + " select field, backend, avg_mase, row_number() over (partition by field order by coalesce(avg_mase, 999), backend) as place from (select * from b1 union all select * from b2)",
    "forecast_anomalies": _HOUR + f", en as (select station, field, max(i) as n from ho group by 1, 2 having max(i) >= {CONTEXT + 24}), og as (select station, field, n - 24 as o from en), "
    "sg as (select og.station, og.field, greatest(1e-3, stddev_pop(v)) as sigma from og join ho on ho.station = og.station and ho.field = og.field and ho.i between o - 47 and o group by 1, 2), "
    "fc as (select t.station, t.field, t.k, t.v, b.v as p, sigma, case when t.field = 'wind_direction' then least(abs(t.v - b.v) % 360, 360 - abs(t.v - b.v) % 360) else abs(t.v - b.v) end as e, "
    "greatest(1e-3, case when t.field = 'wind_direction' then least(2 * 1.28 * sigma % 360, 360 - 2 * 1.28 * sigma % 360) / 2 else 1.28 * sigma end) as w from og join ho b on b.station = og.station and b.field = og.field and b.i = o "
    "join ho t on t.station = og.station and t.field = og.field and t.i > o join sg on sg.station = og.station and sg.field = og.field) "
    "select station, field, k, v, round(p, 9) as p50, round(e / w, 9) as z from fc where e / w > 3 or (field <> 'wind_direction' and e > 1.28 * sigma)",
    "clip_fields": _HOUR + f"select field, min({_CLIP('(v - 50)')}) as low, max({_CLIP('(v + 50)')}) as high from lo group by 1",
    "forecast_records": _LATEST + f", nw as (select station, {_NOW} from en group by 1) select en.station, field, h, (k0 + h) * 3600 as at, round({_CLIP('last')} + 1e-7, 2) as p50, " + ", ".join(f"now_{f}" for f in FIELDS) + f" from en join nw on nw.station = en.station, (select unnest(range(1, {HORIZON + 1})) as h)",
}
SQL = {name: sql9(text) for name, text in SQL.items()}
