"""Magnetometer queries: grid, gap filling, as-of indices, rolling amplitudes, tiers, cross-checks, metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions import tiers
from fieldwatch.functions.values import known, r9, ratio, sql9
from fieldwatch.operators.series import asof_backward, fill_gaps, median_cadence, rolling
from fieldwatch.plans.base import CTE, STEP, bulletins, cte, grid, in_rows, natively, natively_sql, readings

WINDOW = 18  # rows of three hours
BASE = 36  # rows of the trailing median baseline


def regular_grid_q(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return grid(spark, sf, step)


def median_cadence_q(spark: SparkSession, sf: str) -> DataFrame:
    return median_cadence(readings(spark, sf), "station", "s")


def gap_fill_forward(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return fill_gaps(grid(spark, sf, step), "station").withColumn("filled", r9("filled"))


def gap_fill_both(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return fill_gaps(grid(spark, sf, step), "station", both=True).withColumn("filled", r9("filled"))


def _asof(column: str, tolerance: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        left = grid(spark, sf).select("station", "k", (F.col("k") * STEP).alias("s"))
        known_rows = bulletins(spark, sf).where(F.col(column).isNotNull())
        return asof_backward(left, known_rows, "station", "s", column, tolerance, column, tie="bulletin_id").select("station", "k", column)

    return query


def amplitude_rows(step: int | None) -> int:
    """Rows of the amplitude's three hours."""
    return in_rows(10800, step) if step else WINDOW


def amplitude(mode: str, centered: bool = False):
    """Disturbance amplitude over three hours: range, hybrid, max or instant."""

    def query(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
        n = amplitude_rows(step)
        before, after = (n // 2, (n - 1) // 2) if centered else (n - 1, 0)
        g = grid(spark, sf, step)
        if mode == "instant":
            return g.select("station", "k", F.abs("v").alias("amp"))
        w = rolling(g, "station", before, after, {"hi": F.max("v"), "lo": F.min("v"), "mean": F.avg("v")})
        span = F.col("hi") - F.col("lo")
        amp = {"range": span, "hybrid": F.greatest(span, 2 * F.abs("mean")), "max": F.greatest(F.abs("hi"), F.abs("lo"))}[mode]
        return w.select("station", "k", F.when(F.col("v").isNotNull(), r9(amp)).alias("amp"))

    return query


def rolling_stats(g: DataFrame, value: str, sizes: dict[str, tuple[str, int]]) -> DataFrame:
    """Add trailing statistics that need every row of their window: name -> (median | p75 | max, rows)."""
    from pyspark.sql import Window

    most = max(n for _, n in sizes.values())

    def column(kind: str, n: int):
        def over(w: Window):
            f = w.rowsBetween(-(n - 1), 0)
            stat = {"median": F.percentile(value, 0.5), "p75": F.percentile(value, 0.75), "max": F.max(value)}[kind]
            return F.when(F.count(value).over(f) == n, r9(stat.over(f)))

        return over

    return rolling(g, "station", most - 1, 0, {name: column(k, n) for name, (k, n) in sizes.items()})


def magnitude(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Forward-filled grid with the size of its values."""
    return fill_gaps(grid(spark, sf, step), "station").select("station", "k", r9("filled").alias("x")).withColumn("m", F.abs("x"))


#: Rows of ten minutes that stand for the detector's windows.
SIZES = {"fast": ("median", 1), "medium": ("median", 3), "upper": ("p75", 4), "slow": ("median", 6), "slow3": ("median", 18), "peak": ("max", 2)}
#: The same windows in minutes, with the most rows each may have.
MINUTES = {"fast": ("median", 5, 31), "medium": ("median", 15, 61), "upper": ("p75", 30, 121), "slow": ("median", 60, 181), "slow3": ("median", 180, 361), "peak": ("max", 5, 61)}


def window_sizes(step: int | None) -> dict[str, tuple[str, int]]:
    """name -> (statistic, rows) of the detector's windows."""
    return {n: (k, in_rows(60 * m, step, cap)) for n, (k, m, cap) in MINUTES.items()} if step else SIZES


def rolling_medians(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    sizes = window_sizes(step)
    s = rolling_stats(magnitude(spark, sf, step), "m", {n: sizes[n] for n in ("fast", "medium", "slow", "slow3")})
    return s.select("station", "k", "fast", "medium", "slow", "slow3")


def rolling_p75(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    sizes = window_sizes(step)
    return rolling_stats(magnitude(spark, sf, step), "m", {"upper": sizes["upper"]}).select("station", "k", "upper")


def rolling_peak(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    sizes = window_sizes(step)
    return rolling_stats(magnitude(spark, sf, step), "m", {"peak": sizes["peak"]}).select("station", "k", "peak")


def prefilter_median(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Centred rolling median of five rows, over what is known."""
    return rolling(grid(spark, sf, step), "station", 2, 2, {"med": F.percentile("v", 0.5)}).select("station", "k", r9("med").alias("med"))


def rolling_p95(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return rolling(magnitude(spark, sf, step), "station", amplitude_rows(step) - 1, 0, {"p95": F.percentile("m", 0.95)}).select("station", "k", r9("p95").alias("p95"))


def spike_reversal(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    g = rolling(grid(spark, sf, step), "station", 1, 1, {"prev": lambda w: F.lag("v").over(w), "next": lambda w: F.lead("v").over(w), "first": lambda w: F.lag("k").over(w).isNull()})
    return g.where(tiers.spike(F.col("v") - F.col("prev"), F.col("next") - F.col("v"))).select("station", "k", "v")


def diff_mad_anomaly(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Differences far from their rolling median, by max(100, 8 * 1.4826 * rolling MAD), full windows of three hours."""
    n = in_rows(10800, step, 721) if step else WINDOW
    g = rolling(grid(spark, sf, step), "station", 1, 0, {"d": lambda w: r9(F.col("v") - F.lag("v").over(w))})
    g = rolling(g, "station", n - 1, 0, {"c": F.count("d"), "med": F.percentile("d", 0.5)})
    g = g.withColumn("dev", F.when(F.col("c") == n, r9(F.abs(F.col("d") - F.col("med")))))
    g = rolling(g, "station", n - 1, 0, {"c2": F.count("dev"), "mad": F.percentile("dev", 0.5)})
    limit = F.greatest(F.lit(100.0), F.coalesce(F.when(F.col("c2") == n, 8 * 1.4826 * F.col("mad")), F.lit(100.0)))
    return g.select("station", "k", "d", r9(limit).alias("limit"), known(F.col("dev") >= limit).alias("anomaly"))


def flagged(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Filled grid, trailing-median baseline, residual, range amplitude and label: (station, k, r, amp, flag)."""
    return labelled(spark, sf, step).select("station", "k", "r", "amp", "flag")


def labelled(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """``flagged`` with the grid's value ``v`` and the filled one ``x``."""
    g = fill_gaps(grid(spark, sf, step), "station").select("station", "k", "v", r9("filled").alias("x"))
    g = rolling(g, "station", in_rows(21600, step) if step else BASE, -1, {"base": F.percentile("x", 0.5)})
    n = amplitude_rows(step)
    g = g.select("station", "k", "v", "x", r9(F.col("x") - F.col("base")).alias("r"))
    g = rolling(g, "station", n - 1, 1, {
        "hi": lambda w: F.max("r").over(w.rowsBetween(-(n - 1), 0)), "lo": lambda w: F.min("r").over(w.rowsBetween(-(n - 1), 0)),
        "prev": lambda w: F.lag("r").over(w), "next": lambda w: F.lead("r").over(w)})
    amp = F.when(F.col("r").isNotNull(), r9(F.col("hi") - F.col("lo")))
    g = g.withColumn("amp", amp)
    spike = tiers.spike(F.col("r") - F.col("prev"), F.col("next") - F.col("r"))
    return g.select("station", "k", "v", "x", "r", "amp", tiers.flag(F.col("r"), F.col("amp"), spike).alias("flag"))


def tier_labels(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    return flagged(spark, sf, step)


def flag_histogram(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Samples per activity tier and station."""
    return flagged(spark, sf, step).groupBy("station", "flag").agg(F.count(F.lit(1)).alias("n"))


def max_local_level(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Most severe tier present per station; NULL if only invalid or anomalous samples are."""
    order = F.array_position(F.array(*[F.lit(x) for x in tiers.LABELS]), F.col("flag")).cast("int")
    top = flagged(spark, sf, step).groupBy("station").agg(F.max(F.when(order > 0, order)).alias("o"))
    return top.select("station", F.element_at(F.array(*[F.lit(x) for x in tiers.LABELS]), F.col("o")).alias("level"))


def level_ladders(spark: SparkSession, sf: str) -> DataFrame:
    return bulletins(spark, sf).select("bulletin_id", tiers.global_level(F.col("kp"), F.col("dst")).alias("level"))


def checked(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with the indices of their time (Kp three hours back at most, Dst one) and the cross-check."""
    return with_indices(spark, sf, flagged(spark, sf))


def with_indices(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    """Labels of the ten-minute grid with indices, cross-check and levels."""
    g = labels.withColumn("s", F.col("k") * STEP)
    ix = bulletins(spark, sf)
    g = asof_backward(g, ix.where("kp is not null"), "station", "s", "kp", 10800, "kp", tie="bulletin_id")
    g = asof_backward(g, ix.where("dst is not null"), "station", "s", "dst", 3600, "dst", tie="bulletin_id")
    g = g.withColumn("validation", tiers.cross_check(F.col("flag"), F.col("kp"), F.col("dst")))
    return g.withColumn("gl", tiers.global_level(F.col("kp"), F.col("dst"))).withColumn("ll", tiers.local_level(F.col("flag")))


def cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf).groupBy("station", "flag", "validation").agg(F.count(F.lit(1)).alias("n"))


def cross_validate_live(spark: SparkSession, sf: str) -> DataFrame:
    """The live form: both indices up to three hours back, own rules."""
    g = flagged(spark, sf).withColumn("s", F.col("k") * STEP)
    ix = bulletins(spark, sf)
    for c in ("kp", "dst"):
        g = asof_backward(g, ix.where(f"{c} is not null"), "station", "s", c, 10800, c, tie="bulletin_id")
    return g.withColumn("validation", tiers.cross_check_live(F.col("flag"), F.col("kp"), F.col("dst"))).groupBy("station", "flag", "validation").agg(F.count(F.lit(1)).alias("n"))


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Detection metrics of rows with local level ``ll``, global level ``gl``, residual ``r``, ``flag`` and ``validation``."""
    n = lambda c: F.count_if(c)
    g, local = F.col("gl"), F.col("ll")
    storm, pred = known(g >= 3), known(local >= 3)
    calm = known(g < 3)
    return df.groupBy(*keys).agg(
        r9(F.sqrt(F.avg(F.when((F.col("flag") == "quiet") & known(g == 0), F.col("r") * F.col("r"))))).alias("quiet_rms"),
        r9(ratio(n(storm & pred), n(storm))).alias("detection_rate"),
        r9(ratio(n(calm & pred), n(calm))).alias("false_alarm_rate"),
        r9(ratio(n(storm & known(local < 2)), n(storm))).alias("missed_rate"),
        r9(ratio(n(known(g >= 2) & known(local < 2)), n(known(g >= 2)))).alias("under_reacting_rate"),
        r9(ratio(n(pred & calm), n(pred))).alias("unconfirmed_rate"),
        r9(F.avg(F.abs(local - g))).alias("level_error"),
        r9(F.avg((F.col("validation") == "ok").cast("int"))).alias("validation_yield"),
        F.count("gl").alias("with_index"), F.count(F.lit(1)).alias("samples"))


def metrics_engine(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(checked(spark, sf), ["station"])


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, share of interpolated samples and the gate's verdict (coverage of at least 0.8)."""
    g = fill_gaps(grid(spark, sf), "station").groupBy("station").agg(
        r9(F.avg(F.col("filled").isNotNull().cast("int"))).alias("coverage"), r9(F.avg((F.col("filled").isNotNull() & F.col("v").isNull()).cast("int"))).alias("interpolated"),
        r9(F.avg(F.col("v").isNull().cast("int"))).alias("missing"))
    return g.withColumn("passed", F.col("coverage") >= 0.8)


def residual_stats(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).groupBy("station").agg(r9(F.stddev_pop("v")).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))


def future_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Largest size of the residual in the next 1, 3 and 6 hours, where all of it is known, and whether it is a storm."""
    cols = {f"p{h}": (lambda h: lambda w: F.when(F.count("m").over(w.rowsBetween(1, 6 * h)) == 6 * h, F.max("m").over(w.rowsBetween(1, 6 * h))))(h) for h in (1, 3, 6)}
    g = rolling(magnitude(spark, sf), "station", 0, 36, cols)
    return g.select("station", "k", *[F.col(f"p{h}").alias(f"target_peak_{h}h") for h in (1, 3, 6)], *[(F.col(f"p{h}") >= 35).alias(f"target_storm_{h}h") for h in (1, 3, 6)])


def lag_features(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    """Trailing means, spreads and extremes, and lags, of the filled residual; names count ten minutes."""
    cols = {}
    rows = lambda n: in_rows(n * STEP, step) if step else n
    for n in (6, 18, 36):
        f = lambda w, n=n: w.rowsBetween(-(rows(n) - 1), 0)
        cols |= {f"mean_{n}": lambda w, f=f: r9(F.avg("x").over(f(w))), f"std_{n}": lambda w, f=f: r9(F.stddev_pop("x").over(f(w))), f"max_{n}": lambda w, f=f: F.max("x").over(f(w))}
    cols |= {f"lag_{n}": lambda w, n=n: F.lag("x", rows(n)).over(w) for n in (1, 3, 6, 18)}
    return rolling(magnitude(spark, sf, step), "station", rows(36), 0, cols).drop("m")


#: fl: filled grid; ff: with both-sided filling; fg: labels; ck: labels with indices
_FILL = """,
fp as (select station, k, v, last_value(v ignore nulls) over w as pv, last_value(case when v is not null then k end ignore nulls) over w as pk,
  first_value(v ignore nulls) over x as nv, first_value(case when v is not null then k end ignore nulls) over x as nk from gr
  window w as (partition by station order by k rows between unbounded preceding and current row), x as (partition by station order by k rows between current row and unbounded following)),
fl as (select station, k, v, round(case when v is not null then v when pk is null then null when k - pk > 3 then null when nk is null then pv else pv + (nv - pv) * (k - pk) / (nk - pk) end, 9) as filled from fp),
ff as (select station, k, v, round(case when v is not null then v when pk is null then case when nk - k <= 3 then nv end when nk is null then case when k - pk <= 3 then pv end
  when k - pk <= 3 or nk - k <= 3 then pv + (nv - pv) * (k - pk) / (nk - pk) end, 9) as filled from fp)
"""
FILL = CTE + _FILL
_MAG = FILL + ", mg as (select station, k, filled as x, abs(filled) as m from fl)"


def flags_sql(step: int | None = None) -> str:
    """fg: labels on the grid of a step."""
    rows, base = amplitude_rows(step), in_rows(21600, step) if step else BASE
    return cte(step) + _FILL + f""",
b1 as (select station, k, round(filled - quantile_cont(filled, 0.5) over (partition by station order by k rows between {base} preceding and 1 preceding), 9) as r from fl),
b2 as (select station, k, r, case when r is not null then round(max(r) over w - min(r) over w, 9) end as amp, lag(r) over (partition by station order by k) as p, lead(r) over (partition by station order by k) as n
  from b1 window w as (partition by station order by k rows between {rows - 1} preceding and current row)),
fg as (select station, k, r, amp, case when r is null or abs(r) > 3000 then 'invalid' when coalesce(abs(r - p) > 100 and abs(n - r) > 100 and sign(n - r) <> sign(r - p), false) then 'anomaly'
  when amp > 800 then 'severe_storm' when amp > 400 then 'major_storm' when amp > 100 then 'minor_storm' when amp > 30 then 'active' when amp > 20 then 'unsettled' else 'quiet' end as flag from b2)
"""


FLAGS = flags_sql()
_LEVEL = "greatest(case when kp is null then null when kp <= 2 then 0 when kp <= 4 then 1 when kp < 6 then 2 when kp < 8 then 3 else 4 end, case when dst is null then null when dst >= -10 then 0 when dst >= -30 then 1 when dst >= -50 then 2 when dst >= -100 then 3 else 4 end)"
CHECKED = FLAGS + f""",
kx as (select station, s, max_by(kp, bulletin_id) as kp from ix where kp is not null group by 1, 2), dx as (select station, s, max_by(dst, bulletin_id) as dst from ix where dst is not null group by 1, 2),
c1 as (select fg.*, fg.k * 600 as s from fg),
c2 as (select c1.*, case when c1.s - kx.s <= 10800 then kx.kp end as kp from c1 asof left join kx on c1.station = kx.station and c1.s >= kx.s),
c3 as (select c2.*, case when c2.s - dx.s <= 3600 then dx.dst end as dst from c2 asof left join dx on c2.station = dx.station and c2.s >= dx.s),
ck as (select *, {_LEVEL} as gl, case flag when 'quiet' then 0 when 'unsettled' then 1 when 'active' then 2 when 'minor_storm' then 3 when 'major_storm' then 4 when 'severe_storm' then 4 end as ll,
  case when flag in ('major_storm', 'severe_storm') and not a and not m then 'unconfirmed_storm' when flag = 'quiet' and not m and a then 'under_reacting' when flag = 'quiet' and m then 'missed_global_event' else 'ok' end as validation
  from (select *, coalesce(dst < -50, false) or coalesce(kp >= 6, false) as m, coalesce(dst < -30, false) or coalesce(kp >= 4, false) as a from c3))
"""
_W = f"rows between {WINDOW - 1} preceding and current row"
_METRICS = """round(sqrt(avg(r * r) filter (where flag = 'quiet' and gl = 0)), 9) as quiet_rms,
round(count(*) filter (where gl >= 3 and ll >= 3) / nullif(count(*) filter (where gl >= 3), 0), 9) as detection_rate,
round(count(*) filter (where gl < 3 and ll >= 3) / nullif(count(*) filter (where gl < 3), 0), 9) as false_alarm_rate,
round(count(*) filter (where gl >= 3 and ll < 2) / nullif(count(*) filter (where gl >= 3), 0), 9) as missed_rate,
round(count(*) filter (where gl >= 2 and ll < 2) / nullif(count(*) filter (where gl >= 2), 0), 9) as under_reacting_rate,
round(count(*) filter (where gl < 3 and ll >= 3) / nullif(count(*) filter (where ll >= 3), 0), 9) as unconfirmed_rate,
round(avg(abs(ll - gl)), 9) as level_error, round(avg((validation = 'ok')::int), 9) as validation_yield, count(gl) as with_index, count(*) as samples"""


def anomalies_sql(step: int | None = None) -> str:
    """c: differences, their distance from the rolling median, and the limit."""
    n = in_rows(10800, step, 721) if step else WINDOW
    w = f"(partition by station order by k rows between {n - 1} preceding and current row)"
    return f"""a as (select station, k, round(v - lag(v) over (partition by station order by k), 9) as d from gr),
b as (select *, case when count(d) over w = {n} then round(abs(d - quantile_cont(d, 0.5) over w), 9) end as dev from a window w as {w}),
c as (select *, greatest(100.0, coalesce(case when count(dev) over w = {n} then 8 * 1.4826 * quantile_cont(dev, 0.5) over w end, 100.0))::double as lim from b window w as {w})"""


ANOMALIES = anomalies_sql()


def _med(n: int, q: float = 0.5) -> str:
    f = f"(partition by station order by k rows between {n - 1} preceding and current row)"
    return f"case when count(m) over {f} = {n} then round(quantile_cont(m, {q}) over {f}, 9) end"


def series_sql(step: int | None = None) -> dict[str, str]:
    """SQL of the queries that run on the grid of a step."""
    gr, fl, flags, n = cte(step), cte(step) + _FILL, flags_sql(step), amplitude_rows(step)
    mag = fl + ", mg as (select station, k, filled as x, abs(filled) as m from fl)"
    back = f"rows between {n - 1} preceding and current row"
    sizes = window_sizes(step)
    rows = lambda k: in_rows(k * STEP, step) if step else k
    amp = lambda expr, frame=back: gr + f"select station, k, case when v is not null then round({expr}, 9) end as amp from gr window w as (partition by station order by k {frame})"
    peak = sizes["peak"][1]
    return {
        "flag_histogram": flags + "select station, flag, count(*) as n from fg group by 1, 2", "regular_grid": gr + "select * from gr",
        "gap_fill_forward": fl + "select station, k, v, filled from fl", "gap_fill_both": fl + "select station, k, v, filled from ff",
        "amp_range": amp("max(v) over w - min(v) over w"), "amp_hybrid": amp("greatest(max(v) over w - min(v) over w, 2 * abs(avg(v) over w))"), "amp_max": amp("greatest(abs(max(v) over w), abs(min(v) over w))"),
        "amp_centered": amp("max(v) over w - min(v) over w", f"rows between {n // 2} preceding and {(n - 1) // 2} following"), "amp_instant": gr + "select station, k, abs(v) as amp from gr",
        "rolling_medians": mag + "select station, k, " + ", ".join(f"{_med(sizes[c][1])} as {c}" for c in ("fast", "medium", "slow", "slow3")) + " from mg",
        "rolling_p75": mag + f"select station, k, {_med(sizes['upper'][1], 0.75)} as upper from mg",
        "rolling_peak": mag + f"select station, k, case when count(m) over w = {peak} then max(m) over w end as peak from mg window w as (partition by station order by k rows between {peak - 1} preceding and current row)",
        "prefilter_median": gr + "select station, k, round(quantile_cont(v, 0.5) over (partition by station order by k rows between 2 preceding and 2 following), 9) as med from gr",
        "rolling_p95": mag + f"select station, k, round(quantile_cont(m, 0.95) over (partition by station order by k {back}), 9) as p95 from mg",
        "spike_reversal": gr + "select station, k, v from (select *, v - lag(v) over w as d, lead(v) over w - v as n from gr window w as (partition by station order by k)) where abs(d) > 100 and abs(n) > 100 and sign(n) <> sign(d)",
        "diff_mad_anomaly": gr + ", " + anomalies_sql(step) + """ select station, k, d, round(lim, 9) as "limit", coalesce(dev >= lim, false) as anomaly from c""",
        "tier_labels": flags + "select * from fg",
        "max_local_level": flags + "select station, ['quiet', 'unsettled', 'active', 'minor_storm', 'major_storm', 'severe_storm'][max(o)] as level from (select station, nullif(list_position(['quiet', 'unsettled', 'active', 'minor_storm', 'major_storm', 'severe_storm'], flag), 0) as o from fg) group by 1",
        "lag_features": mag + "select station, k, x, " + ", ".join(f"round(avg(x) over w{k}, 9) as mean_{k}, round(stddev_pop(x) over w{k}, 9) as std_{k}, max(x) over w{k} as max_{k}" for k in (6, 18, 36)) + ", " + ", ".join(f"lag(x, {rows(k)}) over w as lag_{k}" for k in (1, 3, 6, 18))
        + " from mg window w as (partition by station order by k), " + ", ".join(f"w{k} as (partition by station order by k rows between {rows(k) - 1} preceding and current row)" for k in (6, 18, 36)),
    }


QUERIES = {
    "flag_histogram": flag_histogram, "regular_grid": regular_grid_q, "median_cadence": median_cadence_q, "gap_fill_forward": gap_fill_forward, "gap_fill_both": gap_fill_both,
    "asof_kp": _asof("kp", 10800), "asof_dst": _asof("dst", 3600), "amp_range": amplitude("range"), "amp_hybrid": amplitude("hybrid"), "amp_max": amplitude("max"),
    "amp_centered": amplitude("range", centered=True), "amp_instant": amplitude("instant"), "rolling_medians": rolling_medians, "rolling_p75": rolling_p75,
    "rolling_peak": rolling_peak, "prefilter_median": prefilter_median, "rolling_p95": rolling_p95, "spike_reversal": spike_reversal, "diff_mad_anomaly": diff_mad_anomaly,
    "tier_labels": tier_labels, "max_local_level": max_local_level, "level_ladders": level_ladders, "cross_validate": cross_validate, "cross_validate_live": cross_validate_live, "metrics_engine": metrics_engine,
    "quality_gate": quality_gate, "residual_stats": residual_stats, "future_targets": future_targets, "lag_features": lag_features,
}
#: These over every station at its own cadence, where the ones above (and their SQL) average over ten minutes.
_NATIVE = ["flag_histogram", "regular_grid", "gap_fill_forward", "gap_fill_both", "amp_range", "amp_hybrid", "amp_max", "amp_centered", "amp_instant", "rolling_medians", "rolling_p75", "rolling_peak",
           "prefilter_median", "rolling_p95", "spike_reversal", "diff_mad_anomaly", "tier_labels", "max_local_level", "lag_features"]
QUERIES |= {f"native_{n}": natively(QUERIES[n]) for n in _NATIVE}
_F = lambda n: f"(partition by station order by k rows between 1 following and {6 * n} following)"
SQL = {
    "median_cadence": CTE + "select station, greatest(1, floor(quantile_cont(d, 0.5)))::bigint as cadence_s from (select station, lead(s) over (partition by station order by s) - s as d from (select distinct station, s from rd)) group by 1",
    "asof_kp": CTE + ", x as (select station, s, max_by(kp, bulletin_id) as kp from ix where kp is not null group by 1, 2) select g.station, g.k, case when g.k * 600 - x.s <= 10800 then x.kp end as kp from gr g asof left join x on g.station = x.station and g.k * 600 >= x.s",
    "asof_dst": CTE + ", x as (select station, s, max_by(dst, bulletin_id) as dst from ix where dst is not null group by 1, 2) select g.station, g.k, case when g.k * 600 - x.s <= 3600 then x.dst end as dst from gr g asof left join x on g.station = x.station and g.k * 600 >= x.s",
    "level_ladders": CTE + f"select bulletin_id, {_LEVEL} as level from ix",
    "cross_validate": CHECKED + "select station, flag, validation, count(*) as n from ck group by 1, 2, 3",
    "cross_validate_live": CHECKED.replace("c2.s - dx.s <= 3600", "c2.s - dx.s <= 10800") + """, cl as (select *, coalesce(dst < -50, false) or coalesce(kp >= 5, false) as m5, coalesce(dst < -30, false) or coalesce(kp >= 4, false) as a4 from ck)
select station, flag, case when flag = 'quiet' and m5 then 'missed_global_event' when flag in ('quiet', 'unsettled') and a4 then 'under_reacting' when flag in ('major_storm', 'severe_storm') and not a4 then 'unconfirmed_storm' else 'ok' end as validation, count(*) as n from cl group by 1, 2, 3""",
    "metrics_engine": CHECKED + f"select station, {_METRICS} from ck group by 1",
    "quality_gate": FILL + "select *, coverage >= 0.8 as passed from (select station, round(avg((filled is not null)::int), 9) as coverage, round(avg((filled is not null and v is null)::int), 9) as interpolated, round(avg((v is null)::int), 9) as missing from fl group by 1)",
    "residual_stats": CTE + "select station, round(stddev_pop(v), 9) as std, min(v) as low, max(v) as high, count(*) as n from rd group by 1",
    "future_targets": _MAG + ", t as (select station, k, " + ", ".join(f"case when count(m) over {_F(h)} = {6 * h} then max(m) over {_F(h)} end as target_peak_{h}h" for h in (1, 3, 6)) + " from mg) select *, " + ", ".join(f"target_peak_{h}h >= 35 as target_storm_{h}h" for h in (1, 3, 6)) + " from t",
}
SQL = series_sql() | SQL | {f"native_{n}": natively_sql(series_sql, n) for n in _NATIVE}
SQL = {name: sql9(text) for name, text in SQL.items()}
