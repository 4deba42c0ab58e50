"""Queries of the causal detector, of events, and of seismic picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions.values import known, r9, sql9
from fieldwatch.operators.latch import LatchRule, Profile, bool_events, event_totals, evidence, latch, match_events
from fieldwatch.operators.picking import agreeing, dedup, sliding_windows, triplets
from fieldwatch.plans.activity import _FILL as FILL_ONLY
from fieldwatch.plans.activity import ANOMALIES, FILL, diff_mad_anomaly, magnitude, rolling_stats, window_sizes
from fieldwatch.plans.base import bulletins, cte, in_rows, natively, natively_sql, readings
from fieldwatch.session import table
from fieldwatch.sources.picks import typed_picks

#: On and off lengths of the latches in rows of ten minutes.
LATCH = {"active": (2, 3), "storm": (2, 18), "major": (1, 3), "severe": (1, 3)}
#: The same lengths in minutes.
MINUTES_ON_OFF = {t.name: (t.on_min, t.off_min) for t in Profile().tiers}


def masks(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Rolling statistics with evidence columns: (station, k, x, medium, ready, ..._on, ..._off)."""
    sizes = window_sizes(step)
    s = rolling_stats(magnitude(spark, sf, step), "m", sizes)
    ready = F.col("m").isNotNull()
    for c in sizes:
        ready = ready & F.col(c).isNotNull()
    return s.withColumns({"ready": ready, **evidence(ready)})


def evidence_masks(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return masks(spark, sf, step).select("station", "k", "ready", *[f"{t}_{e}" for t in LATCH for e in ("on", "off")])


def latched(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    df = masks(spark, sf, step).select("station", "k", "x", "medium", "ready", *[f"{t}_{e}" for t in LATCH for e in ("on", "off")])
    lengths = {t: tuple(in_rows(60 * m, step) for m in MINUTES_ON_OFF[t]) for t in LATCH} if step else LATCH
    return latch(df, "station", "k", {t: LatchRule(f"{t}_on", f"{t}_off", "ready", on, off) for t, (on, off) in lengths.items()})


def hysteresis(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return latched(spark, sf, step).select("station", "k", "active", "storm")


def detector_flags(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Final labels: severity is nested (severe within major within storm), then the highest wins; where neither active nor storm is
    latched, a difference far from its rolling median is an anomaly. Samples without value are quiet."""
    storm, major = F.col("storm"), F.col("storm") & F.col("major")
    severe = major & F.col("severe")
    label = (F.when(F.col("x").isNull(), "quiet").when(severe, "severe_storm").when(major, "major_storm").when(storm, "minor_storm").when(F.col("active"), "active")
             .when(F.col("ready") & known(F.col("odd")), "anomaly").when(F.col("ready") & known(F.col("medium") >= Profile().unsettled), "unsettled").otherwise("quiet"))
    odd = diff_mad_anomaly(spark, sf, step).where("anomaly").select("station", "k", F.lit(True).alias("odd"))  # few
    return latched(spark, sf, step).join(odd, ["station", "k"], "left").select("station", "k", label.alias("flag"))


def predicted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of values of at least 15 nT, gaps of up to three samples merged, of at least two samples."""
    m = magnitude(spark, sf).withColumn("mask", F.col("m") >= 15)
    return bool_events(m, "station", "k", "mask", 3, 2)


def event_match(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted events against those of bulletins with Kp of at least 4 (three hours each, merged)."""
    ref = bulletins(spark, sf).where("kp >= 4").select("station", F.floor(F.col("s") / 600).cast("long").alias("k"), F.lit(True).alias("mask")).distinct()
    return match_events(bool_events(ref, "station", "k", "mask", 17, 1), predicted_events(spark, sf), "station")


def event_totals_q(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all stations summed, with precision, recall and F1."""
    t = event_totals(event_match(spark, sf))
    return t.select(*t.columns[:5], *[r9(c).alias(c) for c in t.columns[5:]])


def _picks(spark: SparkSession, sf: str) -> DataFrame:
    return typed_picks(table(spark, sf, "picks"))


def pick_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(_picks(spark, sf), ["sta", "wave"], 1_000_000).select("sta", "wave", "us", "pick_id")


def pick_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _picks(spark, sf).where("p >= 0.3").select("pick_id", r9("p").alias("p"))


def pick_intersection(spark: SparkSession, sf: str) -> DataFrame:
    p = _picks(spark, sf)
    return agreeing(p.where("model = 'phasenet'"), p.where("model = 'eqtransformer'"), ["sta", "wave"], 1_000_000).select("pick_id", "sta", "wave", "us")


def pick_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return pick_intersection(spark, sf).groupBy("wave").agg(F.count(F.lit(1)).alias("agreed"))


def pick_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _picks(spark, sf).groupBy("wave", "model").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("p")).alias("mean_p"))


def pick_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most probable picks (a preview)."""
    return _picks(spark, sf).where("p is not null").orderBy(F.col("p").desc(), "pick_id").limit(10).select("pick_id", "wave", r9("p").alias("p"))


def triplets_q(spark: SparkSession, sf: str) -> DataFrame:
    return triplets(_picks(spark, sf).where("channel is not null"), "sta", "channel", "us", "pick_id")


def sliding_windows_q(spark: SparkSession, sf: str) -> DataFrame:
    return sliding_windows(readings(spark, sf), "station", "s", 3600, 1800)


_STAT = lambda n, q: f"case when count(m) over (partition by station order by k rows between {n - 1} preceding and current row) = {n} then round(quantile_cont(m, {q}) over (partition by station order by k rows between {n - 1} preceding and current row), 9) end"


def masks_sql(step: int | None = None) -> str:
    """m3: evidence on the grid of a step."""
    sizes = {c: (k, n) for c, (k, n) in window_sizes(step).items()}
    stats = ", ".join(f"{_STAT(n, 0.75 if k == 'p75' else 0.5)} as {c}" for c, (k, n) in sizes.items() if k != "max")
    peak = sizes["peak"][1]
    return cte(step) + FILL_ONLY + f""",
ms as (select station, k, filled as x, abs(filled) as m from fl),
m1 as (select *, {stats}, case when count(m) over w = {peak} then max(m) over w end as peak from ms window w as (partition by station order by k rows between {peak - 1} preceding and current row)),
m2 as (select *, m is not null and fast is not null and medium is not null and upper is not null and slow is not null and slow3 is not null and peak is not null as ready from m1),
m3 as (select station, k, x, medium, ready,
  ready and (medium >= 15 or (slow >= 0.65 * 15 and medium >= 0.4 * 15) or (slow3 >= 0.55 * 15 and medium >= 0.4 * 15) or (upper >= 15 and medium >= 0.35 * 15) or (fast >= 1.25 * 15 and medium >= 0.4 * 15) or (peak >= 1.8 * 15 and medium >= 0.25 * 15)) as active_on,
  ready and medium <= 0.6 * 15 as active_off,
  ready and (medium >= 35 or (slow >= 35 and medium >= 0.8 * 35) or (slow3 >= 35 and medium >= 0.8 * 35) or (fast >= 1.8 * 35 and medium >= 0.55 * 35) or (peak >= 1.7 * 35 and medium >= 0.2 * 35) or (upper >= 1.1 * 35 and medium >= 0.7 * 35)) as storm_on,
  ready and medium <= 0.65 * 35 as storm_off,
  ready and (medium >= 100 or (upper >= 90 and medium >= 80) or (peak >= 1.15 * 100 and medium >= 80)) as major_on, ready and medium <= 75 as major_off,
  ready and (medium >= 200 or (upper >= 180 and medium >= 160) or (peak >= 1.1 * 200 and medium >= 160)) as severe_on, ready and medium <= 150 as severe_off from m2)
"""


_MASKS = masks_sql()


def evidence_sql(step: int | None = None) -> dict[str, str]:
    return {"evidence_masks": masks_sql(step) + "select station, k, ready, " + ", ".join(f"coalesce({t}_{e}, false) as {t}_{e}" for t in LATCH for e in ("on", "off")) + " from m3"}


def _latch_sql() -> str:
    """Every latch as a recursion over the rows of a station."""
    seeds = ", ".join(f"false as {t}, 0 as {t}_c" for t in LATCH)
    steps = []
    for t, (on, off) in LATCH.items():
        c = f"case when not m.ready then 0 when not r.{t} then case when m.{t}_on then r.{t}_c + 1 else 0 end else case when m.{t}_off then r.{t}_c + 1 else 0 end end"
        steps.append(f"case when not m.ready then false when not r.{t} then {c} >= {on} else not ({c} >= {off}) end as {t}, case when (not r.{t} and {c} >= {on}) or (r.{t} and {c} >= {off}) then 0 else {c} end as {t}_c")
    return (_MASKS.replace("\nwith rd", "\nwith recursive rd") + ", mn as (select *, row_number() over (partition by station order by k) as i from m3)"
            + f", lt as (select station, 0::bigint as i, 0::bigint as k, {seeds} from (select distinct station from mn) union all select m.station, m.i, m.k, {', '.join(steps)} from lt r join mn m on m.station = r.station and m.i = r.i + 1) ")


_PK = """
with pa as (select *, string_split(replace(upper(trim(trace_id)), '_', '.'), '.') as x, upper(trim(time)) as t, regexp_replace(upper(trim(time)), '^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9.]+)', '\\1-\\2-\\3T\\4:\\5:\\6') as iso,
  regexp_extract(upper(trim(phase)), '^([PS])(-WAVE)?$', 1) as wave from picks where trace_id is not null and phase is not null and time is not null),
pk as (select pick_id, trim(x[1]) || '.' || trim(x[2]) || '.' || replace(trim(x[3]), '--', '') as sta, x[4] as channel, wave,
  case when regexp_full_match(t, '[0-9]+([.][0-9]+)?') then (t::decimal(20, 6) * 1000000)::bigint else epoch_us((case when regexp_full_match(replace(iso, ' ', 'T'), '.*T.*(Z|[+-][0-9]{2}:[0-9]{2})') then iso else iso || 'Z' end)::timestamptz) end as us,
  case when probability > 1 then probability / 100 else probability end as p, lower(model) as model from pa where len(x) in (3, 4) and wave <> '')
"""
_EVENTS = """, ev as (select station, min(k) as first, max(k) as last, count(*) as samples from (select *, sum(n) over (partition by station order by k) as g from (
  select station, k, case when k - lag(k) over (partition by station order by k) <= 4 then 0 else 1 end as n from (select station, k from fl where abs(filled) >= 15))) group by station, g having max(k) - min(k) + 1 >= 2)"""

#: Three rounds of one-to-one matching over the overlaps ``pr``.
_ROUNDS = "k0 as (select station, r, p from pr where false),\n" + "".join(
    f"k{i} as (select station, r, p from k{i - 1} union all select station, min(r), p from (select station, r, min(p) as p from pr where not exists (select 1 from k{i - 1} t where t.station = pr.station and (t.r = pr.r or t.p = pr.p)) group by 1, 2) group by station, p),\n"
    for i in (1, 2, 3)) + "tk as (select * from k3),"

QUERIES = {
    "evidence_masks": evidence_masks, "hysteresis": hysteresis, "detector_flags": detector_flags, "bool_events": predicted_events, "event_match": event_match, "event_totals": event_totals_q, "pick_dedup": pick_dedup,
    "pick_filter": pick_filter, "pick_intersection": pick_intersection, "pick_agreement": pick_agreement, "pick_summary": pick_summary, "pick_top": pick_top, "triplets": triplets_q, "sliding_windows": sliding_windows_q,
}
QUERIES |= {f"native_{n}": natively(QUERIES[n]) for n in ("evidence_masks", "hysteresis", "detector_flags")}
_BOTH = "select pick_id, sta, wave, us from pk a where model = 'phasenet' and exists (select 1 from pk b where b.model = 'eqtransformer' and b.sta = a.sta and b.wave = a.wave and abs(a.us - b.us) <= 1000000)"
SQL = {
    **evidence_sql(), "native_evidence_masks": natively_sql(evidence_sql, "evidence_masks"),
    "hysteresis": _latch_sql() + "select station, k, active, storm from lt where i > 0",
    "detector_flags": _latch_sql() + ", " + ANOMALIES + " select lt.station, lt.k, case when m.x is null then 'quiet' when severe and major and storm then 'severe_storm' when major and storm then 'major_storm' when storm then 'minor_storm' when active then 'active' when m.ready and coalesce(c.dev >= c.lim, false) then 'anomaly' when m.ready and m.medium >= 10 then 'unsettled' else 'quiet' end as flag from lt join mn m on lt.station = m.station and lt.i = m.i left join c on c.station = lt.station and c.k = lt.k",
    "bool_events": FILL + _EVENTS + " select * from ev",
    "event_match": FILL + _EVENTS + """, rf as (select station, min(k) as first, max(k) as last from (select *, sum(n) over (partition by station order by k) as g from (
  select station, k, case when k - lag(k) over (partition by station order by k) <= 18 then 0 else 1 end as n from (select distinct station, (s // 600)::bigint as k from ix where kp >= 4))) group by station, g),
pr as (select distinct rf.station, rf.first as r, ev.first as p from rf join ev on rf.station = ev.station and rf.first <= ev.last and ev.first <= rf.last),
""" + _ROUNDS + """
n1 as (select station, count(*) as reference from rf group by 1), n2 as (select station, count(*) as predicted from ev group by 1), n3 as (select station, count(*) as matched from tk group by 1),
n4 as (select coalesce(n1.station, n2.station) as station, coalesce(reference, 0) as reference, coalesce(predicted, 0) as predicted from n1 full join n2 on n1.station = n2.station)
select n4.*, coalesce(matched, 0) as matched, reference - coalesce(matched, 0) as missed, predicted - coalesce(matched, 0) as false_positive from n4 left join n3 on n4.station = n3.station""",
    "pick_dedup": _PK.replace("with pa", "with recursive pa") + """, pn as (select *, coalesce(p, -1) as q, row_number() over (partition by sta, wave order by us, pick_id) as i from pk),
rc as (select sta, wave, i, us as aus, pick_id as aid, q as aq, null::bigint as done, null::bigint as dus from pn where i = 1
  union all select n.sta, n.wave, n.i, case when n.us - r.aus > 1000000 or n.q > r.aq then n.us else r.aus end, case when n.us - r.aus > 1000000 or n.q > r.aq then n.pick_id else r.aid end,
    case when n.us - r.aus > 1000000 or n.q > r.aq then n.q else r.aq end, case when n.us - r.aus > 1000000 then r.aid end, case when n.us - r.aus > 1000000 then r.aus end from rc r join pn n on n.sta = r.sta and n.wave = r.wave and n.i = r.i + 1)
select sta, wave, dus as us, done as pick_id from rc where done is not null union all select sta, wave, aus, aid from rc qualify row_number() over (partition by sta, wave order by i desc) = 1""",
    "pick_filter": _PK + "select pick_id, round(p, 9) as p from pk where p >= 0.3", "pick_intersection": _PK + _BOTH,
    "pick_agreement": _PK + f"select wave, count(*) as agreed from ({_BOTH}) group by 1",
    "pick_summary": _PK + "select wave, model, count(*) as n, round(avg(p), 9) as mean_p from pk group by 1, 2",
    "pick_top": _PK + "select pick_id, wave, round(p, 9) as p from pk where p is not null order by pk.p desc, pick_id limit 10",
    "triplets": _PK + """, c as (select sta, right(channel, 1) as c, arg_max(us, pick_id) as us from pk where channel is not null group by 1, 2),
g as (select sta, max(us) filter (where c = 'Z') as z, max(us) filter (where c = 'N') as nn, max(us) filter (where c = 'E') as ee, max(us) filter (where c = '1') as n1, max(us) filter (where c = '2') as e2 from c group by 1)
select * from (select sta, z, case when nn is not null and ee is not null then nn else n1 end as n, case when nn is not null and ee is not null then ee else e2 end as e from g) where z is not null and n is not null and e is not null""",
    "sliding_windows": """with rd as (select observatory as station, epoch_us(ts) // 1000000 as s from residuals where residual is not null and not isnan(residual) and not isinf(residual) and residual <> 99999.0 and abs(residual) <= 3000),
sp as (select station, min(s) as lo, max(s) as hi from rd group by 1), wi as (select station, unnest(range(0, greatest(0, (hi - lo - 3600) // 1800) + 1)) as idx, lo from sp)
select wi.station, wi.idx, lo + wi.idx * 1800 as start, count(rd.s) as samples from wi left join rd on rd.station = wi.station and rd.s between lo + wi.idx * 1800 and lo + wi.idx * 1800 + 3600 group by 1, 2, 3""",
}
SQL = {name: sql9(text) for name, text in SQL.items()}
