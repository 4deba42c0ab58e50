"""Queries of nearest-time matching and of surviving picks, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions.values import MISSING_MARK, usable
from fieldwatch.llm.nearest import level_code, nearest_in_time
from fieldwatch.llm.survivors import pick_groups
from fieldwatch.session import table


def p3_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every bulletin with its nearest usable reading within 90 seconds, or NULL."""
    left = table(spark, sf, "index_bulletins").select(F.col("bulletin_id").alias("id"), level_code(F.col("observatory")).alias("entity"), "ts")
    right = table(spark, sf, "residuals").where(usable(F.col("residual"), MISSING_MARK)).select(
        F.col("reading_id").alias("id"), level_code(F.col("observatory")).alias("entity"), "ts")
    rows = sum(table(spark, sf, name).count() for name in ("index_bulletins", "residuals"))  # from file footers
    return nearest_in_time(left, right, 90.0, rows_about=rows).select(F.col("left_id").alias("bulletin_id"), F.col("right_id").alias("reading_id"), "offset_us")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Bulletins with a partner."""
    return p3_matches(spark, sf).where("reading_id is not null").select("bulletin_id", "reading_id")


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every group of picks with its survivor, groups of one included."""
    return pick_groups(table(spark, sf, "picks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Survivors of groups of two or more."""
    return p4_groups(spark, sf).where("picks >= 2").select("pick_id")


_PAIRS = """
with b as (select bulletin_id, upper(replace(observatory, ' ', '')) as o, ts from index_bulletins),
r as (select upper(replace(observatory, ' ', '')) as o, ts, min(reading_id) as reading_id from residuals
  where residual is not null and not isnan(residual) and not isinf(residual) and residual <> 99999.0 group by 1, 2),
c as (select bulletin_id, reading_id, epoch_us(r.ts) - epoch_us(b.ts) as off from b asof join r on b.o = r.o and b.ts >= r.ts
  union all select bulletin_id, reading_id, epoch_us(r.ts) - epoch_us(b.ts) from b asof join r on b.o = r.o and b.ts <= r.ts),
m as (select * from c where abs(off) <= 90000000 qualify row_number() over (partition by bulletin_id order by abs(off), reading_id) = 1)
"""

_GROUPS = """
with a as (select *, string_split(replace(upper(trim(trace_id)), '_', '.'), '.') as x, upper(trim(time)) as t, regexp_extract(upper(trim(phase)), '^([PS])(-WAVE)?$', 1) as w from picks
  where trace_id is not null and phase is not null and time is not null),
p as (select pick_id, trim(x[1]) as n, trim(x[2]) as s, replace(trim(x[3]), '--', '') as l, w,
  case when regexp_full_match(t, '-?[0-9]+([.][0-9]+)?') then (t::decimal(20, 6) * 1000000)::bigint
    else epoch_us((case when regexp_full_match(replace(iso, ' ', 'T'), '.*T.*(Z|[+-][0-9]{2}:[0-9]{2})') then iso else iso || 'Z' end)::timestamptz) end as us,
  coalesce(lower(trim(review)) = 'manual', false)::int as m, (probability is not null)::int + (model is not null)::int as f, received_at
  from (select *, regexp_replace(t, '^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9.]+)', '\\1-\\2-\\3T\\4:\\5:\\6') as iso from a) where len(x) in (3, 4) and w <> ''),
g as (select *, sum(case when us - pu <= 1000000 then 0 else 1 end) over (partition by n, s, l, w order by us, pick_id) as g
  from (select *, lag(us) over (partition by n, s, l, w order by us, pick_id) as pu from p)),
k as (select *, count(*) over (partition by n, s, l, w, g) as c, row_number() over (partition by n, s, l, w, g order by m desc, f desc, received_at desc nulls last, pick_id) as rn from g)
"""

QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p4_groups": p4_groups}
SQL = {
    "p3_found": _PAIRS + "select bulletin_id, reading_id from m",
    "p3_matches": _PAIRS + "select b.bulletin_id, m.reading_id, m.off as offset_us from b left join m on b.bulletin_id = m.bulletin_id",
    "p4_found": _GROUPS + "select pick_id from k where rn = 1 and c >= 2",
    "p4_groups": _GROUPS + "select n as network, s as site, l as location, w as wave, min(us) as first_us, max(us) as last_us, count(*) as picks, min(pick_id) filter (where rn = 1) as pick_id from k group by n, s, l, w, g",
}
