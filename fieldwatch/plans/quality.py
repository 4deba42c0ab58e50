"""Queries over the driver's sensor tables for the data-quality operators of the core (problems 1, 2 and 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions.values import MISSING_MARK, epoch_micros, usable
from fieldwatch.operators.controlchart import FieldRule, flag_readings
from fieldwatch.operators.gridfill import holdout_error, regular_series
from fieldwatch.session import table
from fieldwatch.sources.rawcsv import judge_lines, typed_rows


def grid_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Usable residual and temperature readings with their station's cadence."""
    stations = table(spark, sf, "stations").where("cadence_s > 0").select("station", "cadence_s")
    mag = table(spark, sf, "residuals").where(usable(F.col("residual"), MISSING_MARK)).select(
        F.lit("residual").alias("field"), F.col("observatory").alias("station"), "ts", F.col("residual").alias("value"), "received_at")
    met = table(spark, sf, "weather_readings").where(usable(F.col("temperature"))).select(
        F.lit("temperature").alias("field"), "station", "ts", F.col("temperature").alias("value"), "received_at")
    return mag.unionByName(met).join(stations, "station")


def plausible() -> Column:
    """Physical limits of the gridded fields."""
    return F.when(F.col("field") == "residual", F.abs("value") <= 3000).otherwise(F.col("value").between(-90, 60))


def p1_series(spark: SparkSession, sf: str) -> DataFrame:
    """The regular series of both fields: observed and filled periods."""
    return regular_series(grid_readings(spark, sf), plausible())


def p1_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Error of filled values against hidden readings."""
    return holdout_error(grid_readings(spark, sf), plausible())


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Periods that the grid operator had to fill or mark."""
    return p1_series(spark, sf).where("status <> 'observed'").select("field", "station", "period_start")


_GRID_SQL = """
with r as (
  select 'residual' as field, observatory as station, ts, residual as v from residuals
  where residual is not null and not isnan(residual) and not isinf(residual) and residual <> 99999.0
  union all
  select 'temperature', station, ts, temperature from weather_readings
  where temperature is not null and not isnan(temperature) and not isinf(temperature)),
k as (
  select distinct r.field, r.station, s.cadence_s, (epoch_us(ts) // (s.cadence_s::bigint * 1000000))::bigint as k
  from r join stations s on r.station = s.station where s.cadence_s > 0),
n as (select *, lead(k) over (partition by field, station order by k) as nk from k)
"""

#: Physical limits and what counts as far for each field.
RULES = [
    FieldRule("residual", -3000.0, 3000.0, 15.0, relative=True),
    FieldRule("barometer", 500.0, 1100.0, 10.0),
    FieldRule("irradiance", -10.0, 1500.0, 300.0, stuck_above=5.0, max_gap_periods=3),
]


def chart_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Usable residual, barometer and irradiance readings as (field, station, ts_us, row_id, value)."""
    mag = table(spark, sf, "residuals").where(usable(F.col("residual"), MISSING_MARK)).select(
        F.lit("residual").alias("field"), F.col("observatory").alias("station"), epoch_micros(F.col("ts")).alias("ts_us"), F.col("reading_id").alias("row_id"), F.col("residual").alias("value"))
    met = table(spark, sf, "weather_readings")
    for x in ("barometer", "irradiance"):
        mag = mag.unionByName(met.where(usable(F.col(x))).select(
            F.lit(x).alias("field"), "station", epoch_micros(F.col("ts")).alias("ts_us"), F.col("record_id").alias("row_id"), F.col(x).alias("value")))
    return mag


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible rows with the reason."""
    rows = table(spark, sf, "residuals").count() + 2 * table(spark, sf, "weather_readings").count()  # from file footers
    return flag_readings(chart_readings(spark, sf), RULES, table(spark, sf, "stations").select("station", "cadence_s"), rows_about=rows)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows flagged for any reason."""
    return p2_flags(spark, sf).select("field", "row_id").distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that fail, with the reason."""
    return judge_lines(table(spark, sf, "raw_weather_lines")).where("status = 'rejected'").select("line_id", "reason")


def p5_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Valid lines as typed readings."""
    return typed_rows(judge_lines(table(spark, sf, "raw_weather_lines")))


QUERIES = {"p1_found": p1_found, "p1_series": p1_series, "p1_holdout": p1_holdout, "p2_found": p2_found, "p2_flags": p2_flags, "p5_found": p5_found, "p5_rows": p5_rows}

_FIELD = r'("([^"]|"")*"|[^",]*)'
_LINES_SQL = f"""
with l as (select line_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*') as quoted from raw_weather_lines where line_no <> 1 and trim(line) <> ''),
f as (select line_id, quoted, case when quoted then list_transform(regexp_extract_all(',' || line, ',{_FIELD}', 1),
  lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) end as f from l),
v as (select line_id, case when not quoted then 'quoting' when len(f) <> 8 then 'column_count'
  when not regexp_full_match(f[2], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}') or try_strptime(f[2], '%Y-%m-%d %H:%M') is null then 'invalid_value'
  when trim(f[3], ' ') <> '' and not coalesce(regexp_full_match(trim(f[3], ' '), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') and try_cast(trim(f[3], ' ') as double) between -90 and 60, false) then 'invalid_value'
  when trim(f[7], ' ') <> '' and not coalesce(regexp_full_match(trim(f[7], ' '), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') and try_cast(trim(f[7], ' ') as double) between 0 and 36, false) then 'invalid_value'
  end as reason, f from f)
"""

def _spikes_sql() -> str:
    """Runs of one to three readings far from both sides, as one branch a length."""
    out = []
    for r in (1, 2, 3):
        a, b = "lag(v) over w", f"lead(v, {r}) over w"
        inner = [f"lead(v, {k}) over w" if k else "v" for k in range(r)]
        far = "least(" + ", ".join(f"abs({x} - {a}), abs({x} - {b})" for x in inner) + ")"
        gap = f"greatest(us - lag(us) over w, lead(us, {r}) over w - " + (f"lead(us, {r - 1}) over w" if r > 1 else "us") + ")"
        ends = f"lead(us, {r - 1}) over w" if r > 1 else "us"
        out.append(f"select field, station, us as u0, {ends} as u1, {a} as a, {b} as b, {far} as far, {gap} as gap from d window w as (partition by field, station order by us)")
    return " union all ".join(out)


_CHART_SQL = f"""
with r as (select 'residual' as field, observatory as station, epoch_us(ts) as us, reading_id as id, residual as v from residuals where residual is not null and not isnan(residual) and not isinf(residual) and residual <> 99999.0
  union all select 'barometer', station, epoch_us(ts), record_id, barometer from weather_readings where barometer is not null and not isnan(barometer) and not isinf(barometer)
  union all select 'irradiance', station, epoch_us(ts), record_id, irradiance from weather_readings where irradiance is not null and not isnan(irradiance) and not isinf(irradiance)),
d as (select field, station, us, arg_min(v, id) as v from r group by 1, 2, 3),
s as (select field, station, median(abs(x)) / 0.954 as sigma from (select field, station, v - lag(v) over (partition by field, station order by us) as x from d) group by 1, 2),
l as (select s.field, s.station, case s.field when 'residual' then 15 * sigma when 'barometer' then 10 else 300 end as lim, t.cadence_s from s left join stations t on t.station = s.station),
c as ({_spikes_sql()}),
k as (select c.*, lim from c join l on c.field = l.field and c.station = l.station where abs(a - b) < lim and far > lim and (c.field <> 'irradiance' or gap <= 3 * cadence_s::bigint * 1000000)),
g as (select *, sum(n) over (partition by field, station order by us) as g from (select *, case when v = lag(v) over (partition by field, station order by us) then 0 else 1 end as n from d)),
u as (select field, station, g, min(us) as u0, max(us) as u1, min(v) as v from g group by 1, 2, 3 having count(*) >= 12)
select field, id as row_id from r where (field = 'residual' and abs(v) > 3000) or (field = 'barometer' and (v < 500 or v > 1100)) or (field = 'irradiance' and (v < -10 or v > 1500))
union select r.field, r.id from r join k on r.field = k.field and r.station = k.station and r.us between k.u0 and k.u1 and least(abs(r.v - k.a), abs(r.v - k.b)) > k.lim
union select r.field, r.id from r join u on r.field = u.field and r.station = u.station and r.us between u.u0 and u.u1 and r.v = u.v where r.field <> 'irradiance' or r.v > 5
"""

SQL = {
    "p2_found": _CHART_SQL,
    "p5_rows": _LINES_SQL + "select r.line_id, r.file_name, r.line_no, f[1] as station_id, strptime(f[2], '%Y-%m-%d %H:%M') as ts, try_cast(trim(f[3]) as double) as temperature, try_cast(trim(f[4]) as double) as humidity_prec, "
    "try_cast(trim(f[5]) as double) * 10 as barometer, try_cast(trim(f[6]) as double) * 1000 / 3600 as wind_speed, try_cast(trim(f[7]) as double) * 10 as wind_direction, nullif(trim(f[8]), '') as weather from v join raw_weather_lines r on v.line_id = r.line_id where reason is null",
    "p5_found": _LINES_SQL + "select line_id, reason from v where reason is not null",
    "p1_found": _GRID_SQL
    + "select field, station, g * cadence_s as period_start from (select field, station, cadence_s::bigint as cadence_s, unnest(range(k + 1, nk)) as g from n where nk > k + 1)",
}
