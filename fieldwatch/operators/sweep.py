"""Threshold sweeps and choices from histograms: rows are counted once per bucket of candidates, not once per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.functions.values import known, ratio


def bucket(value: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the value; NULL for NULL. A chain of halvings, so a row costs the logarithm of the cuts."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(float(cuts[mid])), half(mid + 1, hi)).otherwise(half(lo, mid))

    return F.when(value.isNotNull(), half(0, len(cuts)))


def grid(minors: list[float], majors: list[float], severes: list[float]) -> list[tuple[float, float, float]]:
    """Candidates (minor, major, severe) in increasing order."""
    return [(float(a), float(b), float(c)) for a in minors for b in majors for c in severes if a < b < c]


def sweep(rows: DataFrame, period: str, candidates: list[tuple[float, float, float]], cuts: list[float], unsettled: float, active: float) -> DataFrame:
    """Scores of every (candidate, period): rows (period, amp, gl) are reduced to counts by period, global level and amplitude
    bucket, which is all that the candidates need; each of those few rows then meets each candidate."""
    cuts = sorted({*cuts, unsettled, active})
    counts = rows.groupBy(period, "gl", bucket(F.col("amp"), cuts).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    low = F.element_at(F.array(*[F.lit(float(c)) for c in [-1e308, *cuts]]), F.col("b") + 1)  # the largest cut a row reaches
    each = F.array(*[F.struct(F.lit(x).alias("minor"), F.lit(y).alias("major"), F.lit(z).alias("severe")) for x, y, z in candidates])
    c = counts.withColumn("low", F.when(F.col("b").isNotNull(), low)).select("*", F.inline(each))
    level = F.when(F.col("low").isNull(), F.lit(None).cast("int")).when(F.col("low") >= F.col("major"), 4).when(F.col("low") >= F.col("minor"), 3).when(F.col("low") >= active, 2).when(F.col("low") >= unsettled, 1).otherwise(0)
    c = c.withColumn("ll", level)
    n = lambda cond: F.sum(F.when(known(cond), F.col("n")).otherwise(0))
    g, local = F.col("gl"), F.col("ll")
    storm, pred = g >= 3, local >= 3
    both = g.isNotNull() & local.isNotNull()
    return c.groupBy("minor", "major", "severe", period).agg(
        ratio(n(storm & pred), n(storm)).alias("sdr"), ratio(n(pred & (g < 3)), n(g < 3)).alias("far"), ratio(n(storm & (local < 2)), n(storm)).alias("missed"),
        ratio(n((g >= 2) & (local < 2)), n(g >= 2)).alias("under"), ratio(F.sum(F.when(both, F.abs(local - g) * F.col("n")).otherwise(0)), n(both)).alias("mae"), n(storm).alias("storms"))


def aggregate(scores: DataFrame) -> DataFrame:
    """Mean and worst per candidate; detection and misses over storm periods only."""
    kind = F.col("storms") > 0
    return scores.groupBy("minor", "major", "severe").agg(
        F.avg(F.when(kind, F.col("sdr"))).alias("sdr_mean"), F.min(F.when(kind, F.col("sdr"))).alias("sdr_worst"), F.avg("far").alias("far_mean"), F.max("far").alias("far_worst"),
        F.avg(F.when(kind, F.col("missed"))).alias("missed_mean"), F.avg("under").alias("under_mean"), F.avg("mae").alias("mae_mean"), F.max("mae").alias("mae_worst"))


#: What a candidate is judged by, as (measure, weight, TRUE where the shortfall below the wanted recall counts instead of the
#: measure itself).
COSTS = (
    ("sdr_mean", 10.0, True), ("sdr_worst", 5.0, True), ("far_mean", 1.0, False), ("far_worst", 0.5, False), ("missed_mean", 1.0, False), ("under_mean", 1.0, False),
    ("mae_mean", 0.5, False), ("mae_worst", 0.25, False),
)


def objective(recall: float = 0.90, costs: tuple[tuple[str, float, bool], ...] = COSTS) -> Column:
    """Weighted sum of a candidate's costs, lower is better; a cost that is unknown is 1."""
    total = F.lit(0.0)
    for measure, weight, shortfall in costs:
        cost = F.greatest(F.lit(0.0), F.lit(recall) - F.col(measure)) if shortfall else F.col(measure)
        total = total + F.lit(weight) * F.coalesce(F.when(F.col(measure).isNotNull(), cost), F.lit(1.0))
    return total


def threshold_table(rows: DataFrame, candidates: list[float], extra: dict[str, Column] | None = None) -> DataFrame:
    """(threshold, tp, fp, fn, tn) of predictions ``p >= threshold`` against ``y`` for every candidate; with ``extra`` names and
    row conditions the same counts of those rows, as ``tp_<name>`` and so on. One pass, one row a bucket, then running sums."""
    cuts = sorted(set(candidates))
    groups = {"": F.lit(True)} | {f"_{k}": c for k, c in (extra or {}).items()}
    counts = rows.select("p", *[F.when(c & F.col("y"), 1).otherwise(0).alias(f"pos{k}") for k, c in groups.items()], *[F.when(c & ~F.col("y"), 1).otherwise(0).alias(f"neg{k}") for k, c in groups.items()])
    counts = counts.groupBy("p").agg(*[F.sum(f"{s}{k}").alias(f"{s}{k}") for s in ("pos", "neg") for k in groups])  # probabilities are rounded, so these are few
    sums = counts.withColumn("b", bucket(F.col("p"), cuts)).groupBy("b").agg(*[F.sum(f"{s}{k}").alias(f"{s}{k}") for s in ("pos", "neg") for k in groups])
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, float(c)) for i, c in enumerate([float("-inf"), *cuts])], "b int, threshold double").join(F.broadcast(sums), "b", "left").na.fill(0)
    up = Window.orderBy("b").rowsBetween(0, Window.unboundedFollowing)  # at most as many rows as candidates
    down = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(c, F.lit(0))
    out = table.select("b", "threshold", *[z(F.sum(f"pos{k}").over(up)).alias(f"tp{k}") for k in groups], *[z(F.sum(f"neg{k}").over(up)).alias(f"fp{k}") for k in groups],
                       *[z(F.sum(f"pos{k}").over(down)).alias(f"fn{k}") for k in groups], *[z(F.sum(f"neg{k}").over(down)).alias(f"tn{k}") for k in groups])
    return out.where("b > 0").drop("b")


def rates(name: str = "") -> dict[str, Column]:
    """Precision and recall (0 where undefined), F1 and false alarm rate (1 where undefined) of the counts."""
    tp, fp, fn, tn = (F.col(f"{x}{name}") for x in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)), "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)), "far": F.coalesce(ratio(fp, fp + tn), F.lit(1.0))}


def choose(table: DataFrame, least_precision: float = 0.8, most_far: float = 0.01) -> DataFrame:
    """One row: the feasible threshold of highest (recall, F1, -FAR, threshold), else that of highest (F1, precision, -FAR,
    threshold), with its method."""
    t = table.withColumns(rates())
    ok = (F.col("precision") >= least_precision) & (F.col("far") <= most_far)
    t = t.withColumn("feasible", ok)
    order = F.when(ok, F.struct(F.lit(1).alias("a"), F.col("recall").alias("x"), F.col("f1").alias("y"), (-F.col("far")).alias("z"), F.col("threshold").alias("t"))).otherwise(
        F.struct(F.lit(0).alias("a"), F.col("f1").alias("x"), F.col("precision").alias("y"), (-F.col("far")).alias("z"), F.col("threshold").alias("t")))
    best = t.orderBy(order.desc()).limit(1)
    return best.select("threshold", F.when(F.col("feasible"), "constrained").otherwise("fallback").alias("method"), "precision", "recall", "f1", "far")


def choose_robust(table: DataFrame, least_precision: float = 0.8, most_far: float = 0.01, least_rows: int = 400, least_part: int = 200) -> DataFrame:
    """Like ``choose``, but feasible in the early and the late part both, by (smaller recall, mean recall, -larger FAR,
    threshold); without a feasible one, with fewer than ``least_rows`` rows or ``least_part`` rows in a part, the choice over all rows."""
    e, s = rates("_early"), rates("_late")
    t = table.select("*", *[c.alias(f"e_{k}") for k, c in e.items()], *[c.alias(f"l_{k}") for k, c in s.items()])
    rows = lambda part: sum((F.col(f"{x}_{part}") for x in ("tp", "fp", "fn", "tn")), F.lit(0))
    enough = (rows("early") + rows("late") >= least_rows) & (F.least(rows("early"), rows("late")) >= least_part)
    ok = enough & (F.least("e_precision", "l_precision") >= least_precision) & (F.greatest("e_far", "l_far") <= most_far)
    order = F.struct(F.least("e_recall", "l_recall"), ((F.col("e_recall") + F.col("l_recall")) / 2), -F.greatest("e_far", "l_far"), F.col("threshold"))
    best = t.where(ok).orderBy(order.desc()).limit(1).withColumns(rates()).select("threshold", F.lit("robust").alias("method"), "precision", "recall", "f1", "far", F.lit(1).alias("o"))
    other = choose(table, least_precision, most_far).withColumn("o", F.lit(2))
    return best.unionByName(other).orderBy("o").limit(1).drop("o")


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row (ece): bins of equal width, the last closed, weighted distance of mean outcome and mean probability."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    y = F.col("y").cast("int")
    parts = rows.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(y) - F.avg("p")).alias("d"))
    return parts.agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("ece"))


def brier_logloss(rows: DataFrame) -> DataFrame:
    """One row (brier, log_loss, positive_rate); probabilities are clipped by 1e-15 for the logarithm."""
    y, p = F.col("y").cast("int"), F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    return rows.agg(F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(-F.when(F.col("y"), F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"), F.avg(y).alias("positive_rate"))


def pooled_sufficiency(cases: DataFrame, classes: list[str], station: int = 4, year: int = 8, pooled: int = 12) -> DataFrame:
    """One row (sufficient): every (observatory, year, class), (year, class) and class has enough cases, missing ones failing.
    ``cases`` has (observatory, year, class_name); no cases at all is insufficient. One pass with grouping sets: as many
    combinations must have enough cases as there can be."""
    rows = cases.where(F.col("class_name").isin(classes))
    keys = ["observatory", "year", "class_name"]
    n = rows.groupingSets([keys, keys[1:], keys[2:]], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    # observatories and years of any class count as combinations that must be there
    dims = cases.groupBy("observatory", "year").agg(F.lit(0).cast("long").alias("n")).select("observatory", "year", F.lit(None).cast("string").alias("class_name"), "n", F.lit(-1).cast("long").alias("g"))
    both = n.select(*keys, "n", F.col("g").cast("long").alias("g")).unionByName(dims)
    g, k = F.col("g"), len(classes)
    o, y = F.count_distinct(F.when(g == -1, F.col("observatory"))), F.count_distinct(F.when(g == -1, F.col("year")))
    enough = lambda level, least: F.count_if((g == level) & (F.col("n") >= least))
    return both.agg(((o > 0) & (enough(0, station) == o * y * k) & (enough(4, year) == y * k) & (enough(6, pooled) == k)).alias("sufficient"))


def coordinate_search(evaluate, first: dict[str, list[float]], then: dict[str, list[float]], passes: int = 4) -> tuple[dict[str, float], float]:
    """Best setting and its objective (lower is better): a full grid over the names of ``first``, then in turn each name of
    ``then`` over its values. ``evaluate`` takes a list of settings and returns their objectives, so that each step is one
    job over the data; of equal ones the earlier wins."""
    from itertools import product

    settings = [dict(zip(first, values)) | {n: v[0] for n, v in then.items() if n not in first} for values in product(*first.values())]
    scores = evaluate(settings)
    best, value = min(zip(settings, scores), key=lambda x: x[1])
    for _ in range(passes):
        before = value
        for name, values in then.items():
            settings = [best | {name: v} for v in values]
            near, score = min(zip(settings, evaluate(settings)), key=lambda x: x[1])
            if score < value:
                best, value = near, score
        if value == before:
            break
    return best, value


def settings_fragment(best: dict[str, float], evidence: dict[str, float]) -> str:
    """Chosen settings as YAML text, the evidence as comments."""
    return "\n".join([*[f"# {k}: {v:.4g}" for k, v in sorted(evidence.items())], *[f"{k}: {v:g}" for k, v in sorted(best.items())]]) + "\n"


def violation(least: dict[str, float], most: dict[str, float]) -> Column:
    """Sum of how far measures fall short of their floors and exceed their ceilings; an unknown measure counts as 0 against a
    floor and as 1 against a ceiling. 0 for a feasible row."""
    parts = [F.greatest(F.lit(0.0), F.lit(v) - F.coalesce(F.col(c), F.lit(0.0))) for c, v in least.items()]
    parts += [F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(1.0)) - F.lit(v)) for c, v in most.items()]
    return sum(parts, F.lit(0.0))


def worst_case(cases: DataFrame, measures: list[str]) -> DataFrame:
    """One row (floor): the smallest of the measures over all cases, unknown ones counting as 0; 1 without cases."""
    each = F.least(*[F.coalesce(F.col(m), F.lit(0.0)) for m in measures]) if len(measures) > 1 else F.coalesce(F.col(measures[0]), F.lit(0.0))
    return cases.agg(F.least(F.lit(1.0), F.coalesce(F.min(each), F.lit(1.0))).alias("floor"))
