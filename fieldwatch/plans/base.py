"""Shared inputs of the queries: sensor tables as regular series, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions.values import MISSING_MARK, epoch_micros, usable
from fieldwatch.operators.series import median_cadence, regular_grid
from fieldwatch.session import table

STEP = 600
PLAUSIBLE = 3000.0


def seconds(ts: str = "ts"):
    """Whole epoch seconds of a timestamp column."""
    return F.floor(epoch_micros(F.col(ts)) / 1_000_000).cast("long")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Plausible residuals: (station, s, v)."""
    ok = usable(F.col("residual"), MISSING_MARK) & (F.abs("residual") <= PLAUSIBLE)
    return table(spark, sf, "residuals").where(ok).select(F.col("observatory").alias("station"), seconds().alias("s"), F.col("residual").alias("v"))


def cadences(spark: SparkSession, sf: str) -> DataFrame:
    """(station, cadence_s) of the stations with readings: the listed cadence, the median distance of readings where none is."""
    listed = table(spark, sf, "stations").where("cadence_s > 0").groupBy("station").agg(F.max("cadence_s").cast("long").alias("listed"))
    r = readings(spark, sf)
    found = median_cadence(r.join(listed, "station", "left_anti"), "station", "s").where("cadence_s is not null")
    return r.select("station").distinct().join(listed, "station").select("station", F.col("listed").alias("cadence_s")).unionByName(found)


def grid(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Means of the residuals: (station, k, v); of all stations over ten minutes, or with ``step`` of the stations of that
    cadence over one reading's period."""
    r = readings(spark, sf)
    if step:
        r = r.join(cadences(spark, sf).where(F.col("cadence_s") == step), "station", "left_semi")
    return regular_grid(r, "station", "s", "v", step or STEP)


def in_rows(seconds_: float, step: int, cap: int | None = None) -> int:
    """Rows of a window, at least one and at most ``cap``."""
    n = max(1, round(seconds_ / step))
    return min(n, cap) if cap else n


def natively(query):
    """A query of (spark, sf, step) over every station at its own cadence, with the cadence as ``cadence_s``."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        steps = sorted(r.cadence_s for r in cadences(spark, sf).select("cadence_s").distinct().collect()) or [STEP]
        parts = [query(spark, sf, s).withColumn("cadence_s", F.lit(s).cast("long")) for s in steps]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return run


def bulletins(spark: SparkSession, sf: str) -> DataFrame:
    """Index bulletins: (station, s, kp, dst, bulletin_id), station codes levelled."""
    return table(spark, sf, "index_bulletins").select(F.upper(F.replace("observatory", F.lit(" "), F.lit(""))).alias("station"), seconds().alias("s"), "kp", "dst", "bulletin_id")


#: rd, gr: plausible readings and their ten-minute grid; ix: index bulletins
CTE = """
with rd as (select observatory as station, epoch_us(ts) // 1000000 as s, residual as v from residuals
  where residual is not null and not isnan(residual) and not isinf(residual) and residual <> 99999.0 and abs(residual) <= 3000),
g0 as (select station, (s // 600)::bigint as k, round(avg(v), 9) as v from rd group by 1, 2),
gb as (select station, min(k) as lo, max(k) as hi from g0 group by 1),
gk as (select station, unnest(range(lo, hi + 1)) as k from gb),
gr as (select gk.station, gk.k, g0.v from gk left join g0 on gk.station = g0.station and gk.k = g0.k),
ix as (select upper(replace(observatory, ' ', '')) as station, epoch_us(ts) // 1000000 as s, kp, dst, bulletin_id from index_bulletins)
"""

#: Cadences of the magnetometers, in seconds, for which the SQL of the ``native_`` queries is written.
CADENCES = (20, 60)


def cte(step: int | None = None) -> str:
    """``CTE``, with ``step`` over the stations of that cadence and their own periods."""
    if not step:
        return CTE
    return CTE.replace("// 600", f"// {step}").replace("abs(residual) <= 3000)", f"abs(residual) <= 3000 and observatory in (select station from stations where cadence_s = {step}))")


def natively_sql(build, name: str) -> str:
    """SQL of a query at every cadence, with the cadence as ``cadence_s``; ``build`` gives the SQL of a step by name."""
    return " union all ".join(f"select *, {c}::bigint as cadence_s from ({build(c)[name]})" for c in CADENCES)
