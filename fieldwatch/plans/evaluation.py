"""Queries of threshold sweeps, calibration measures, gates, health reports, baselines and the storm forecaster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwatch.functions import tiers
from fieldwatch.functions.values import epoch_micros, finite, known, r9, ratio, sql9
from fieldwatch.operators import mlforecast as ml
from fieldwatch.operators import sweep as sw
from fieldwatch.operators.baseline import causal_baseline, harmonic_baseline
from fieldwatch.operators.blocks import forward_fill, positions
from fieldwatch.operators.series import asof_backward, fill_gaps, period_means, rolling
from fieldwatch.plans import activity
from fieldwatch.plans.activity import CHECKED, FILL, FLAGS
from fieldwatch.plans.base import STEP, bulletins, cadences, grid, natively, readings
from fieldwatch.plans.forecasting import _PERSIST, _average, _second
from fieldwatch.session import materialize, table

#: The candidates of the sweep.
MINORS, MAJORS, SEVERES = [60.0, 80.0, 100.0, 120.0, 140.0, 160.0], [250.0, 300.0, 350.0, 400.0, 450.0], [600.0, 700.0, 800.0, 900.0]


def quantile(rows: DataFrame, column: str, share: float, cells: int = 4096) -> DataFrame:
    """One row with the exact quantile (linear between neighbours) of a column under its name; NULL without values.

    Counts per cell of equal width tell in which cells the two neighbours lie; only the distinct values of those cells are looked at,
    counted, in a second pass. So no task holds all values.
    """
    rows = materialize(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "quantile")
    lo, hi, total = rows.agg(F.min(column), F.max(column), F.sum("n")).first()
    if total is None:
        return rows.agg(F.max(column).cast("double").alias(column))
    width = (hi - lo) / cells or 1.0
    cell = F.least(F.lit(cells - 1), F.floor((F.col(column) - lo) / width)).cast("int")
    counts = sorted((r.c, r.n) for r in rows.groupBy(cell.alias("c")).agg(F.sum("n").alias("n")).collect())  # at most ``cells`` rows
    rank = share * (total - 1)
    wanted, before, seen = [], 0, 0
    for c, n in counts:
        if seen + n > int(rank) and seen <= min(int(rank) + 1, total - 1):
            before = before if wanted else seen
            wanted.append(c)
        seen += n
    near = rows.withColumn("c", cell).where(F.col("c").isin(wanted))
    order = Window.orderBy(column)  # the values of at most two cells
    at = near.select(column, F.sum("n").over(order).alias("upto"), "n")
    reach = lambda r: F.min(F.when(F.col("upto") + before > r, F.col(column)))
    a, b = reach(int(rank)), reach(min(int(rank) + 1, total - 1))
    return at.agg(a.alias("a"), b.alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) * (rank - int(rank))).alias(column))


def quiet_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Lower tiers from the 99th percentile of amplitude at times of global level 0."""
    amp = activity.checked(spark, sf).where("gl = 0 and amp is not null").select(F.round(F.col("amp") + 1e-9, 4).alias("x"))
    q = quantile(amp, "x", 0.99).withColumnRenamed("x", "q")
    u = F.greatest(F.lit(1.0), F.round(F.col("q") + 1e-9, 1))
    return q.select(u.alias("unsettled"), F.round(1.5 * u + 1e-9, 1).alias("active"))


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = activity.checked(spark, sf).select("station", "amp", "gl")
    return sw.sweep(rows, "station", sw.grid(MINORS, MAJORS, SEVERES), MINORS + MAJORS + SEVERES, 20.0, 30.0)


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    agg = sw.aggregate(_sweep(spark, sf)).withColumn("objective", sw.objective())
    return agg.select("minor", "major", "severe", *[r9(c).alias(c) for c in agg.columns[3:]])


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The five best candidates (a top-k report)."""
    return threshold_sweep(spark, sf).orderBy("objective", "minor", "major", "severe").limit(5).select("minor", "major", "severe", "objective")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(station, k, m, y, p): whether the next hour exceeds 15 nT, and a logistic score of the present size, to 4 places."""
    m = activity.magnitude(spark, sf)
    cut = rolling(m, "station", 0, 6, {"peak": lambda w: F.when(F.count("m").over(w.rowsBetween(1, 6)) == 6, F.max("m").over(w.rowsBetween(1, 6)))})
    p = F.round(1 / (1 + F.exp(-(F.col("m") - 15) / 5)) + 1e-9, 4)
    return cut.where("peak is not null and m is not null").select("station", "k", "m", (F.col("peak") >= 15).alias("y"), p.alias("p"))


def _candidates(rows: DataFrame, first: float, step: float, n: int, quantiles: int) -> list[float]:
    shares = [i / (quantiles + 1) for i in range(1, quantiles + 1)]
    q = rows.agg(F.percentile("p", F.array(*[F.lit(s) for s in shares])).alias("q")).first().q or []
    return [round(first + i * step, 4) for i in range(n)] + [round(x + 1e-9, 4) for x in q]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("threshold", "method", *[r9(c).alias(c) for c in ("precision", "recall", "f1", "far")])


def operating_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(scores(spark, sf), "scores")
    return _rounded(sw.choose(sw.threshold_table(rows, _candidates(rows, 0.05, 0.005, 181, 99))))


def robust_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """As above, feasible in the first 60 % of the time span and in the rest."""
    rows = materialize(scores(spark, sf), "scores")
    a, b = rows.agg(F.min("k"), F.max("k")).first()
    early = F.col("k") <= F.lit((a or 0) + int(0.6 * ((b or 0) - (a or 0))))
    t = sw.threshold_table(rows, _candidates(rows, 0.05, 0.01, 95, 49), {"early": early, "late": ~early})
    return _rounded(sw.choose_robust(t))


def ece(spark: SparkSession, sf: str) -> DataFrame:
    return sw.calibration_error(scores(spark, sf)).select(r9("ece").alias("ece"))


def brier_logloss(spark: SparkSession, sf: str) -> DataFrame:
    d = sw.brier_logloss(scores(spark, sf))
    return d.select(*[r9(c).alias(c) for c in d.columns])


#: Lower bounds (nT) of forecast tiers, the best first.
FORECAST_TIERS = ((200.0, 5), (100.0, 4), (35.0, 3), (15.0, 2), (10.0, 1))


def forecast_tier(amplitude: Column, probability: Column, threshold: float = 0.5) -> Column:
    """Tier 0..5 of a predicted amplitude; a probability at or above the threshold lifts it to minor storm."""
    code = F.when(amplitude.isNull(), F.lit(None).cast("int"))
    for least, tier in FORECAST_TIERS:
        code = code.when(amplitude >= least, tier)
    code = code.otherwise(0)
    return F.when((probability >= threshold) & (code < 3), 3).otherwise(code)


def inference_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast tiers of one, three and six hours against the tier that the rules give now.

    The amplitude forecast for h hours is the largest size of the last h hours, its storm probability a sigmoid of it (to four places); with
    the current tier from the labels: tier and confidence (known from 0.55 on) per horizon, how far the highest forecast tier is from
    the current one (in fifths), and whether that is at least 0.4.
    """
    hours = (1, 3, 6)
    m = rolling(activity.magnitude(spark, sf), "station", 35, 0, {f"a{h}": (lambda h: lambda w: F.max("m").over(w.rowsBetween(1 - 6 * h, 0)))(h) for h in hours})
    label = activity.flagged(spark, sf).select("station", "k", F.when(F.col("flag").isin(*tiers.LABELS), F.array_position(F.array(*[F.lit(x) for x in tiers.LABELS]), F.col("flag")).cast("int") - 1).otherwise(0).alias("now"))
    s = m.where("m is not null").join(label, ["station", "k"])
    for h in hours:
        p = F.round(1 / (1 + F.exp(-(F.col(f"a{h}") - 35) / 10)) + 1e-9, 4)
        s = s.withColumn(f"p{h}", p).withColumn(f"t{h}", forecast_tier(F.col(f"a{h}"), F.col(f"p{h}")))
    sure = lambda h: F.greatest(F.col(f"p{h}"), 1 - F.col(f"p{h}"))
    delta = F.abs(F.greatest(*[F.col(f"t{h}") for h in hours]) - F.col("now")) / 5.0
    return s.select("station", "k", *[F.element_at(F.array(*[F.lit(x) for x in tiers.LABELS]), F.col(f"t{h}") + 1).alias(f"tier_{h}h") for h in hours],
                    *[r9(F.when(sure(h) >= 0.55, sure(h))).alias(f"confidence_{h}h") for h in hours], r9(delta).alias("delta"), (F.round(delta, 6) >= 0.4).alias("divergence"))


def pooled_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    day = activity.checked(spark, sf).groupBy("station", F.floor(F.col("s") / 86400).alias("d")).agg(F.max("gl").alias("g"))
    kind = F.when(F.col("g") >= 3, "storm").when(F.col("g") >= 2, "active").otherwise("quiet")
    cases = day.select(F.col("station").alias("observatory"), F.year(F.timestamp_seconds(F.col("d") * 86400)).alias("year"), kind.alias("class_name"))
    return sw.pooled_sufficiency(cases, ["quiet", "active", "storm"])


def micro_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all stations summed, then precision, recall, F1 and false alarm rate (NULL where undefined)."""
    c = activity.checked(spark, sf).where("gl is not null")
    t, p = F.col("gl") >= 3, known(F.col("ll") >= 3)
    s = c.groupBy("station").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    s = s.agg(*[F.sum(x).alias(x) for x in ("tp", "tn", "fp", "fn")])
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("*", r9(pr).alias("precision"), r9(rc).alias("recall"), r9(F.try_divide(2 * pr * rc, pr + rc)).alias("f1"), r9(ratio(F.col("fp"), F.col("fp") + F.col("tn"))).alias("far"))


def assess(coverage: Column, fill: Column, latency_min: Column | None = None, requested: Column | None = None, drift: Column | None = None, quiet_rms: Column | None = None) -> Column:
    """Checks as a map; what is None or unknown is left out, but an unknown latency fails. Limits are fixed values."""
    checks = {"coverage": coverage >= 0.90, "baseline_fit": fill <= 0.20}
    if latency_min is not None:
        checks["data_freshness"] = known(latency_min.between(-5.0, 90.0))  # data from the future are as stale as old ones
    if requested is not None:
        checks["requested_window_returned"] = requested >= 0.80
    if drift is not None:
        checks["baseline_stability"] = F.abs(drift) <= 50.0
    if quiet_rms is not None:
        checks["station_noise"] = quiet_rms <= 30.0
    return F.map_filter(F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with indices, written once for all that reports on them."""
    return materialize(activity.with_indices(spark, sf, activity.labelled(spark, sf)), "labels")


def health(labels: DataFrame) -> DataFrame:
    """Per station coverage, share of interpolated samples, age of the newest sample (minutes behind the newest of all), share of the whole
    span that came back, quiet scatter, the checks and their verdict."""
    span = labels.where("v is not null").agg(F.min("k").alias("k0"), F.max("k").alias("k1"))
    g = labels.groupBy("station").agg(
        r9(F.avg(F.col("x").isNotNull().cast("int"))).alias("coverage"), r9(F.avg((F.col("x").isNotNull() & F.col("v").isNull()).cast("int"))).alias("interpolated"),
        F.count("v").alias("n"), F.max(F.when(F.col("v").isNotNull(), F.col("k"))).alias("last"),
        r9(F.sqrt(F.avg(F.when((F.col("flag") == "quiet") & known(F.col("gl") == 0), F.col("r") * F.col("r"))))).alias("quiet_rms"))
    g = g.join(F.broadcast(span)).withColumns({"latency_min": (F.col("k1") - F.col("last")) * (STEP / 60.0), "requested": r9(F.col("n") / (F.col("k1") - F.col("k0") + 1))})  # the span is one row
    g = g.withColumn("checks", assess(F.col("coverage"), F.col("interpolated"), F.col("latency_min"), F.col("requested"), None, F.col("quiet_rms")))
    return g.withColumn("healthy", F.forall(F.map_values("checks"), lambda v: v)).drop("n", "last", "k0", "k1")


def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    h = health(_labels(spark, sf))
    names = ["coverage", "baseline_fit", "data_freshness", "requested_window_returned", "station_noise"]
    return h.select("station", "healthy", *[F.element_at("checks", x).alias(x) for x in names])


def alerts(labels: DataFrame, floor: str = "minor_storm", least_coverage: float = 0.8) -> DataFrame:
    """Per station whether a label of at least ``floor`` occurs, the quality gate failed or a check failed, and so whether to alert."""
    at = tiers.LABELS.index(floor)
    storm = labels.groupBy("station").agg(F.max(F.col("flag").isin(*tiers.LABELS[at:])).alias("storm"))
    h = health(labels).select("station", (F.col("coverage") < least_coverage).alias("gate_failed"), (~F.col("healthy")).alias("unhealthy"))
    return h.join(storm, "station").select("station", "storm", "gate_failed", "unhealthy", (F.col("storm") | F.col("gate_failed") | F.col("unhealthy")).alias("alert"))


def alert_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(_labels(spark, sf))


#: Gauge, column of the report.
GAUGES = {"mag_coverage_ratio": "coverage", "mag_median_fill_ratio": "interpolated", "mag_data_latency_minutes": "latency_min", "mag_requested_coverage_ratio": "requested", "mag_quiet_rms_nt": "quiet_rms"}
RATES = ["detection_rate", "false_alarm_rate", "missed_rate", "under_reacting_rate", "unconfirmed_rate", "level_error", "validation_yield"]


def prometheus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Gauges as text lines: gate, verdict, time of the newest sample, one per check, level and measure, each gauge with its type; unknown
    values are dropped."""
    labels = _labels(spark, sf)
    h = health(labels)
    stamp = labels.where("v is not null").groupBy("station").agg((F.max("s").cast("double")).alias("value")).select("station", F.lit("mag_run_timestamp_seconds").alias("name"), "value")
    wide = h.withColumns({"mag_run_ok": (F.col("coverage") >= 0.8).cast("double"), "mag_run_healthy": F.col("healthy").cast("double"), **{g: F.col(c).cast("double") for g, c in GAUGES.items()}})
    values = wide.unpivot("station", ["mag_run_ok", "mag_run_healthy", *GAUGES], "name", "value").unionByName(stamp)
    rates = activity.metrics(labels, ["station"]).withColumns({f"mag_metric_{c}": F.col(c).cast("double") for c in RATES}).unpivot("station", [f"mag_metric_{c}" for c in RATES], "name", "value")
    lines = values.unionByName(rates).where("value is not null").select(F.format_string('%s{observatory="%s"} %.6f', "name", "station", "value").alias("line"))
    checks = h.select("station", F.explode("checks")).select(F.format_string('mag_health_check{observatory="%s",check="%s"} %d', "station", "key", F.col("value").cast("int")).alias("line"))
    flags = labels.groupBy("station", "flag").agg(F.count(F.lit(1)).alias("n")).select(F.format_string('mag_flag_samples{observatory="%s",level="%s"} %d', "station", "flag", "n").alias("line"))
    names = ["mag_run_ok", "mag_run_healthy", "mag_run_timestamp_seconds", *GAUGES, *[f"mag_metric_{c}" for c in RATES], "mag_health_check", "mag_flag_samples"]
    types = spark.createDataFrame([(f"# TYPE {n} gauge",) for n in names], "line string")
    return types.unionByName(lines).unionByName(checks).unionByName(flags)


def merge_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Two result documents merged per (field, backend), the right one winning."""
    def doc(backend: str) -> DataFrame:
        rows = _average(backend)(spark, sf).select("field", F.explode(F.array(F.lit(backend), F.lit("latest"))).alias("backend"), "avg_mae")
        return rows

    a, b = doc("persistence").alias("a"), doc("seasonal_naive").alias("b")
    return a.join(b, ["field", "backend"], "full").select("field", "backend", F.coalesce("b.avg_mae", "a.avg_mae").alias("avg_mae"))


def choose_scenario(rows: DataFrame, name: str, interest: Column, least: int = 1, most: int = 5, weighted: bool = True, seed: int = 7) -> DataFrame:
    """One row of those whose interest lies in least..most (a sampling operator): weighted by interest or uniform, the same for the same
    seed. The smallest -ln(u) / weight wins, u being a number from a hash of seed and name. No row fits: an empty frame."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    fit = rows.withColumn("_w", interest).where((F.col("_w") >= least) & (F.col("_w") <= most))
    return fit.orderBy(-F.log(u) / (F.col("_w") if weighted else F.lit(1.0)), name).limit(1).drop("_w")


def scenario_pick(spark: SparkSession, sf: str) -> DataFrame:
    """One weather station by weighted and one by uniform choice, of interest two to four there (a sampling operator)."""
    interest = 1 + F.pmod(F.length("station") + F.ascii(F.substring("station", 2, 1)), F.lit(5))
    rows = table(spark, sf, "stations").where("kind = 'weather'").select("station")
    return choose_scenario(rows, "station", interest).withColumn("how", F.lit("weighted")).unionByName(choose_scenario(rows, "station", interest, 2, 4, False, 11).withColumn("how", F.lit("uniform")))


def chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    return ml.chrono_split(scores(spark, sf), "station", "k").groupBy("station", "part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


def sanitize_features(spark: SparkSession, sf: str) -> DataFrame:
    """Infinite values out, last known value carried on."""
    g = grid(spark, sf).withColumn("v", finite(F.col("v")))
    return forward_fill(g, ["station"], "k", "v", "carried").select("station", "k", "carried")


def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Redelivered readings dropped: the first of each (observatory, ts) stays, combined before the shuffle."""
    r = table(spark, sf, "residuals")
    return r.groupBy("observatory", "ts").agg(F.min("reading_id").alias("reading_id")).select("observatory", "reading_id", epoch_micros(F.col("ts")).alias("us"))


def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "index_bulletins")
    return b.groupBy(F.upper(F.replace("observatory", F.lit(" "), F.lit(""))).alias("station"), "ts").agg(F.max("bulletin_id").alias("bulletin_id")).select("station", "bulletin_id")


def months_covered(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select("station", F.date_format(F.timestamp_seconds("s"), "yyyy-MM").alias("month")).distinct()


def baseline_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Change of the daily mean level against the day before."""
    d = readings(spark, sf).groupBy("station", F.floor(F.col("s") / 86400).alias("k")).agg(r9(F.avg("v")).alias("level"))
    prev = d.select("station", (F.col("k") + 1).alias("k"), F.col("level").alias("before"))
    return d.join(prev, ["station", "k"]).select("station", "k", r9(F.col("level") - F.col("before")).alias("drift"))


def harmonic_baseline_q(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    g = fill_gaps(grid(spark, sf, step), "station").select("station", "k", F.col("filled").alias("v"), (F.col("k") * (step or STEP)).alias("s"))
    ix = bulletins(spark, sf)
    g = asof_backward(g, ix.where("kp is not null"), "station", "s", "kp", 10800, "kp", tie="bulletin_id")
    g = materialize(asof_backward(g, ix.where("dst is not null"), "station", "s", "dst", 3600, "dst", tie="bulletin_id"), "baseline-in")
    return harmonic_baseline(g, "station", step or STEP).withColumn("baseline", r9("baseline"))


def causal_baseline_q(spark: SparkSession, sf: str, step: int | None = None) -> DataFrame:
    g = materialize(fill_gaps(grid(spark, sf, step), "station").select("station", "k", F.col("filled").alias("v")), "causal-in")
    return causal_baseline(g, "station", step or STEP).select("station", "k", r9("baseline").alias("baseline"), r9("residual").alias("residual"))


def native_causal_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """``causal_baseline`` of every station at its own cadence, all cadences in one pass."""
    every = materialize(cadences(spark, sf), "cadences")
    means = period_means(readings(spark, sf).join(every, "station"), "station", "s", "v", F.col("cadence_s"))
    means = materialize(means.join(every, "station"), "causal-in")
    return causal_baseline(means, "station", "cadence_s", fill=3).select("station", "k", r9("baseline").alias("baseline"), r9("residual").alias("residual"), "cadence_s")


FEATURES = ["m", "mean_6", "std_6", "max_18", "lag_1", "lag_6"]


def _learning_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = activity.lag_features(spark, sf).drop("x")
    rows = scores(spark, sf).select("station", "k", "m", F.col("y").cast("double").alias("y")).join(f, ["station", "k"])
    return materialize(ml.chrono_split(rows, "station", "k"), "learning")


def gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Storm probability of the test part, calibrated by a sigmoid on the calibration part."""
    rows = _learning_rows(spark, sf)
    model = ml.fit_classifier(rows.where("part = 'train'"), FEATURES, "y")
    told = ml.raw_probability(model, rows)
    return ml.platt(told.where("part = 'calibrate'"), "y")(told.where("part = 'test'")).select("station", "k", "y", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"))


def isotonic_calibration(spark: SparkSession, sf: str) -> DataFrame:
    s = ml.chrono_split(scores(spark, sf).withColumn("y", F.col("y").cast("double")), "station", "k")
    s = materialize(s, "isotonic")
    return ml.isotonic(s.where("part = 'calibrate'"), "y")(s.where("part = 'test'")).select("station", "k", "p", F.round("calibrated", 6).alias("calibrated"))


_RATES = """precision, recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1, far"""
_SCORES = FILL + """,
sm as (select station, k, abs(filled) as m, case when count(filled) over w = 6 then max(abs(filled)) over w end as peak from fl window w as (partition by station order by k rows between 1 following and 6 following)),
sc as (select station, k, m, peak >= 15 as y, round(1 / (1 + exp(-(m - 15) / 5)) + 1e-9, 4) as p from sm where peak is not null and m is not null)
"""


def _cand(first: float, step: float, n: int, q: int) -> str:
    shares = ", ".join(str(i / (q + 1)) for i in range(1, q + 1))
    return f"cd as (select distinct t from (select round({first} + i * {step}, 4) as t from (select unnest(range(0, {n})) as i) union all select round(x + 1e-9, 4) from (select unnest(quantile_cont(p, [{shares}])) as x from sc)))"


def _counts(where: str = "true", suffix: str = "") -> str:
    return f"count(*) filter (where {where} and p >= t and y) as tp{suffix}, count(*) filter (where {where} and p >= t and not y) as fp{suffix}, count(*) filter (where {where} and p < t and y) as fn{suffix}, count(*) filter (where {where} and p < t and not y) as tn{suffix}"


_R = lambda s="": f"coalesce(tp{s} / nullif(tp{s} + fp{s}, 0), 0) as pr{s}, coalesce(tp{s} / nullif(tp{s} + fn{s}, 0), 0) as rc{s}, coalesce(2 * tp{s} / nullif(2 * tp{s} + fp{s} + fn{s}, 0), 0) as f1{s}, coalesce(fp{s} / nullif(fp{s} + tn{s}, 0), 1) as fr{s}"
_PICK = "round(pr, 9) as precision, round(rc, 9) as recall, round(f1, 9) as f1, round(fr, 9) as far"
_CHOICE = f"select t as threshold, case when ok then 'constrained' else 'fallback' end as method, {_PICK} from (select *, pr >= 0.8 and fr <= 0.01 as ok from rt) order by ok desc, case when ok then rc else f1 end desc, case when ok then f1 else pr end desc, fr, t desc limit 1"
_HEALTH = CHECKED + """,
sn as (select min(k) as k0, max(k) as k1 from fl where v is not null),
qg as (select station, round(avg((filled is not null)::int), 9) as coverage, round(avg((filled is not null and v is null)::int), 9) as interpolated, count(v) as n, max(k) filter (where v is not null) as last from fl group by 1),
qr as (select station, round(sqrt(avg(r * r) filter (where flag = 'quiet' and gl = 0)), 9) as quiet_rms from ck group by 1),
hb as (select qg.*, quiet_rms, (k1 - last) * 10.0 as latency, round(n / (k1 - k0 + 1), 9) as requested from qg join qr on qg.station = qr.station, sn),
hc as (select *, coverage >= 0.9 as c1, interpolated <= 0.2 as c2, coalesce(latency between -5 and 90, false) as c4, requested >= 0.8 as c5, quiet_rms <= 30 as c3 from hb),
fh as (select station, flag, count(*) as n from fg group by 1, 2), hs as (select *, c1 and c2 and c4 and c5 and coalesce(c3, true) as healthy from hc)
"""
_SWEEP = CHECKED + f""",
gd as (select a as minor, b as major, c as severe from (select unnest({MINORS}::double[]) as a), (select unnest({MAJORS}::double[]) as b), (select unnest({SEVERES}::double[]) as c) where a < b and b < c),
sl as (select minor, major, severe, station, gl, case when amp is null then null when amp >= major then 4 when amp >= minor then 3 when amp >= 30 then 2 when amp >= 20 then 1 else 0 end as l from ck, gd),
sp as (select minor, major, severe, station, count(*) filter (where gl >= 3) as storms, count(*) filter (where gl >= 3 and l >= 3) / nullif(count(*) filter (where gl >= 3), 0) as sdr, count(*) filter (where gl < 3 and l >= 3) / nullif(count(*) filter (where gl < 3), 0) as far,
  count(*) filter (where gl >= 3 and l < 2) / nullif(count(*) filter (where gl >= 3), 0) as missed, count(*) filter (where gl >= 2 and l < 2) / nullif(count(*) filter (where gl >= 2), 0) as under, avg(abs(l - gl)) as mae from sl group by 1, 2, 3, 4),
sa as (select minor, major, severe, avg(sdr) filter (where storms > 0) as sdr_mean, min(sdr) filter (where storms > 0) as sdr_worst, avg(far) as far_mean, max(far) as far_worst, avg(missed) filter (where storms > 0) as missed_mean, avg(under) as under_mean, avg(mae) as mae_mean, max(mae) as mae_worst from sp group by 1, 2, 3),
so as (select *, 10 * case when sdr_mean is null then 1 else greatest(0, 0.90 - sdr_mean) end + 5 * case when sdr_worst is null then 1 else greatest(0, 0.90 - sdr_worst) end + coalesce(far_mean, 1) + 0.5 * coalesce(far_worst, 1) + coalesce(missed_mean, 1) + coalesce(under_mean, 1) + 0.5 * coalesce(mae_mean, 1) + 0.25 * coalesce(mae_worst, 1) as objective from sa),
sr as (select minor, major, severe, """ + ", ".join(f"round({c}, 9) as {c}" for c in ("sdr_mean", "sdr_worst", "far_mean", "far_worst", "missed_mean", "under_mean", "mae_mean", "mae_worst", "objective")) + " from so)"

_NAMES = "['quiet', 'unsettled', 'active', 'minor_storm', 'major_storm', 'severe_storm']"
_TIERS_SQL = FLAGS + ", ia as (select station, k, abs(filled) as m, " + ", ".join(f"max(abs(filled)) over (partition by station order by k rows between {6 * h - 1} preceding and current row) as a{h}" for h in (1, 3, 6)) + " from fl), " + (
    f"ib as (select ia.*, coalesce(list_position({_NAMES}, flag) - 1, 0) as now from ia join fg on ia.station = fg.station and ia.k = fg.k where m is not null), "
    + "ic as (select *, " + ", ".join(f"round(1 / (1 + exp(-(a{h} - 35) / 10)) + 1e-9, 4) as p{h}" for h in (1, 3, 6)) + " from ib), "
    + "id as (select *, " + ", ".join(f"case when p{h} >= 0.5 and a{h} < 35 then 3 when a{h} >= 200 then 5 when a{h} >= 100 then 4 when a{h} >= 35 then 3 when a{h} >= 15 then 2 when a{h} >= 10 then 1 else 0 end as t{h}" for h in (1, 3, 6)) + " from ic) "
    + "select station, k, " + ", ".join(f"{_NAMES}[t{h} + 1] as tier_{h}h, round(case when greatest(p{h}, 1 - p{h}) >= 0.55 then greatest(p{h}, 1 - p{h}) end, 9) as confidence_{h}h" for h in (1, 3, 6))
    + ", round(abs(greatest(t1, t3, t6) - now) / 5.0, 9) as delta, round(abs(greatest(t1, t3, t6) - now) / 5.0, 6) >= 0.4 as divergence from id")
QUERIES = {
    "quiet_tiers": quiet_tiers, "threshold_sweep": threshold_sweep, "best_threshold": best_threshold, "operating_threshold": operating_threshold, "robust_threshold": robust_threshold, "ece": ece, "brier_logloss": brier_logloss,
    "inference_tiers": inference_tiers, "pooled_sufficiency": pooled_sufficiency, "micro_aggregate": micro_aggregate, "health_checks": health_checks, "alert_predicate": alert_predicate, "prometheus_lines": prometheus_lines,
    "merge_benchmarks": merge_benchmarks, "scenario_pick": scenario_pick, "chrono_split": chrono_split, "sanitize_features": sanitize_features, "keep_first": keep_first, "keep_last": keep_last, "months_covered": months_covered,
    "baseline_drift": baseline_drift, "harmonic_baseline": harmonic_baseline_q, "causal_baseline": causal_baseline_q, "gbt_forecast": gbt_forecast, "isotonic_calibration": isotonic_calibration,
}
QUERIES |= {"native_harmonic_baseline": natively(harmonic_baseline_q), "native_causal_baseline": native_causal_baseline}
SQL = {
    "quiet_tiers": CHECKED + "select u as unsettled, round(1.5 * u + 1e-9, 1) as active from (select greatest(1.0, round(quantile_cont(round(amp + 1e-9, 4), 0.99) + 1e-9, 1))::double as u from ck where gl = 0 and amp is not null)",
    "threshold_sweep": _SWEEP + " select * from sr", "best_threshold": _SWEEP + " select minor, major, severe, objective from sr order by objective, minor, major, severe limit 5",
    "operating_threshold": _SCORES + ", " + _cand(0.05, 0.005, 181, 99) + f", ct as (select t, {_counts()} from sc, cd group by 1), rt as (select *, {_R()} from ct) " + _CHOICE,
    "robust_threshold": _SCORES + ", " + _cand(0.05, 0.01, 95, 49) + f", lm as (select min(k) + floor(0.6 * (max(k) - min(k))) as lim from sc), ct as (select t, {_counts()}, {_counts('k <= lim', '_e')}, {_counts('k > lim', '_l')} from sc, cd, lm group by 1), rt as (select *, {_R()}, {_R('_e')}, {_R('_l')} from ct), "
    + f"rb as (select t as threshold, 'robust' as method, {_PICK}, 1 as o from rt where tp_e + fp_e + fn_e + tn_e + tp_l + fp_l + fn_l + tn_l >= 400 and least(tp_e + fp_e + fn_e + tn_e, tp_l + fp_l + fn_l + tn_l) >= 200 and least(pr_e, pr_l) >= 0.8 and greatest(fr_e, fr_l) <= 0.01 order by least(rc_e, rc_l) desc, (rc_e + rc_l) / 2 desc, greatest(fr_e, fr_l), t desc limit 1) select threshold, method, precision, recall, f1, far from (select * from rb union all select *, 2 from ({_CHOICE})) order by o limit 1",
    "ece": _SCORES + "select round(sum(n * d) / sum(n), 9) as ece from (select least(floor(p * 10), 9) as b, count(*) as n, abs(avg(y::int) - avg(p)) as d from sc group by 1)",
    "brier_logloss": _SCORES + "select round(avg((p - y::int) ** 2), 9) as brier, round(avg(-case when y then ln(greatest(1e-15, least(1 - 1e-15, p))) else ln(1 - greatest(1e-15, least(1 - 1e-15, p))) end), 9) as log_loss, round(avg(y::int), 9) as positive_rate from sc",
    "inference_tiers": _TIERS_SQL,
    "pooled_sufficiency": CHECKED + ", dd as (select station as o, year(make_timestamp((s // 86400 * 86400000000)::bigint)) as y, max(gl) as g, s // 86400 as d from ck group by station, s // 86400), cs as (select o, y, case when g >= 3 then 'storm' when g >= 2 then 'active' else 'quiet' end as c from dd), "
    "fu as (select a.o, b.y, c.c, (select count(*) from cs where cs.o = a.o and cs.y = b.y and cs.c = c.c) as n from (select distinct o from cs) a, (select distinct y from cs) b, (select unnest(['quiet', 'active', 'storm']) as c) c) "
    "select (select min(n) from fu) >= 4 and (select min(n) from (select sum(n) as n from fu group by y, c)) >= 8 and (select min(n) from (select sum(n) as n from fu group by c)) >= 12 as sufficient",
    "micro_aggregate": CHECKED + ", mc as (select count(*) filter (where gl >= 3 and coalesce(ll >= 3, false)) as tp, count(*) filter (where gl < 3 and not coalesce(ll >= 3, false)) as tn, count(*) filter (where gl < 3 and coalesce(ll >= 3, false)) as fp, count(*) filter (where gl >= 3 and not coalesce(ll >= 3, false)) as fn from ck where gl is not null), "
    "mr as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from mc) select tp, tn, fp, fn, round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / nullif(p + r, 0), 9) as f1, round(fp / nullif(fp + tn, 0), 9) as far from mr",
    "health_checks": _HEALTH + "select station, healthy, c1 as coverage, c2 as baseline_fit, c4 as data_freshness, c5 as requested_window_returned, c3 as station_noise from hs",
    "alert_predicate": _HEALTH + ", st as (select station, bool_or(flag in ('minor_storm', 'major_storm', 'severe_storm')) as storm from fh group by 1) select hs.station, storm, coverage < 0.8 as gate_failed, not healthy as unhealthy, storm or coverage < 0.8 or not healthy as alert from hs join st on hs.station = st.station",
    "prometheus_lines": _HEALTH + f", mt as (select station, {activity._METRICS} from ck group by 1), nm as (select station, unnest([" + ", ".join(f"'{n}'" for n in ["mag_run_ok", "mag_run_healthy", *GAUGES]) + "]) as name, unnest([(coverage >= 0.8)::int::double, healthy::int::double, coverage::double, interpolated::double, latency::double, requested::double, quiet_rms::double]) as value from hs "
    + "union all select station, unnest([" + ", ".join(f"'mag_metric_{c}'" for c in RATES) + "]), unnest([" + ", ".join(f"{c}::double" for c in RATES) + "]) from mt union all select station, 'mag_run_timestamp_seconds', (last * 600)::double from hs) "
    + "select '# TYPE ' || unnest([" + ", ".join(f"'{n}'" for n in ["mag_run_ok", "mag_run_healthy", "mag_run_timestamp_seconds", *GAUGES, *[f"mag_metric_{c}" for c in RATES], "mag_health_check", "mag_flag_samples"]) + "]) || ' gauge' as line "
    + """union all select printf('%s{observatory="%s"} %.6f', name, station, value) from nm where value is not null
union all select printf('mag_health_check{observatory="%s",check="%s"} %d', station, c, v::int) from (select station, unnest(['coverage', 'baseline_fit', 'data_freshness', 'requested_window_returned', 'station_noise']) as c, unnest([c1, c2, c4, c5, c3]) as v from hs) where v is not null
union all select printf('mag_flag_samples{observatory="%s",level="%s"} %d', station, flag, n) from fh""",
    "merge_benchmarks": _PERSIST.rstrip() + ", m1 as (select field, avg(mae) as m from es group by 1), " + _second() + ", m2 as (select field, avg(mae) as m from es2 group by 1) select field, 'persistence' as backend, round(m, 9) as avg_mae from m1 union all select field, 'seasonal_naive', round(m, 9) from m2 union all select field, 'latest', round(m, 9) from m2",
    "scenario_pick": "with w as (select station, 1 + (length(station) + ascii(station[2])) % 5 as i from stations where kind = 'weather') select * from (select station, 'weighted' as how from w where i between 1 and 5 "
    "order by -ln((('0x' || md5('7:' || station)[1:8])::bigint + 1) / 4294967297.0) / i, station limit 1) union all select * from (select station, 'uniform' from w where i between 2 and 4 order by -ln((('0x' || md5('11:' || station)[1:8])::bigint + 1) / 4294967297.0), station limit 1)",
    "chrono_split": _SCORES + ", ci as (select *, row_number() over (partition by station order by k) as i, count(*) over (partition by station) as n from sc) select station, case when i <= floor(0.7::double * n) then 'train' when i <= floor((0.7::double + 0.15::double) * n) then 'calibrate' else 'test' end as part, count(*) as n, min(k) as first, max(k) as last from ci group by station, part",
    "sanitize_features": FILL + "select station, k, pv as carried from fp",
    "keep_first": "select observatory, min(reading_id) as reading_id, epoch_us(ts) as us from residuals group by observatory, ts",
    "keep_last": "select upper(replace(observatory, ' ', '')) as station, max(bulletin_id) as bulletin_id from index_bulletins group by upper(replace(observatory, ' ', '')), ts",
    "months_covered": FILL + "select distinct station, strftime(make_timestamp((s * 1000000)::bigint), '%Y-%m') as month from rd",
    "baseline_drift": FILL + ", bd as (select station, (s // 86400)::bigint as k, round(avg(v), 9) as level from rd group by 1, 2) select a.station, a.k, round(a.level - b.level, 9) as drift from bd a join bd b on a.station = b.station and a.k = b.k + 1",
}
SQL = {name: sql9(text) for name, text in SQL.items()}
