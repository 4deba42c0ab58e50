"""Regular series: cadence, grid, gap filling, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.functions.values import r9
from fieldwatch.operators.blocks import done_with_halo, rows_before_gaps, with_halo
from fieldwatch.session import materialize


def median_cadence(readings: DataFrame, key: str, seconds: str) -> DataFrame:
    """Median distance of consecutive distinct times per key, whole seconds, at least 1: (key, cadence_s). Times are LONG
    epoch seconds. Keys with a single time get NULL. Distances are found inside hourly cells and across their edges."""
    times = readings.select(key, F.col(seconds).alias("_t")).where("_t is not null").distinct().withColumn("_cell", F.floor(F.col("_t") / 3600).cast("long"))
    inside = Window.partitionBy(key, "_cell").orderBy("_t")
    local = times.select(key, (F.lead("_t").over(inside) - F.col("_t")).alias("d")).where("d is not null")
    edges = times.groupBy(key, "_cell").agg(F.min("_t").alias("a"), F.max("_t").alias("b"))
    across = Window.partitionBy(key).orderBy("_cell")  # one row an hour
    steps = edges.select(key, (F.lead("a").over(across) - F.col("b")).alias("d"))
    return local.unionByName(steps).groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.percentile("d", 0.5))).cast("long").alias("cadence_s"))


def period_means(readings: DataFrame, key: str, seconds: str, value: str, step: int | Column) -> DataFrame:
    """(key, k, v): means of the readings in periods of ``step`` seconds, which may be a column that is constant for a key; periods
    without a reading have no row. NULL keys and times are left out."""
    k = F.floor(F.col(seconds) / step).cast("long")
    return readings.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).groupBy(key, k.alias("k")).agg(r9(F.avg(value)).alias("v"))


def regular_grid(readings: DataFrame, key: str, seconds: str, value: str, step: int, chunk: int = 4096) -> DataFrame:
    """(key, k, v): one row for every period of ``step`` seconds between a key's first and last reading; v is the mean of the
    period's values, NULL where there is none. NULL keys and times are left out."""
    means = period_means(readings, key, seconds, value, step)
    span = means.groupBy(key).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    parts = span.select(key, "lo", "hi", F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / chunk))).alias("c"))
    at = F.col("lo") + F.col("c") * chunk
    grid = parts.select(key, F.explode(F.sequence(at, F.least(at + chunk - 1, F.col("hi")))).alias("k"))
    return grid.join(means, [key, "k"], "left")


def fill_gaps(grid: DataFrame, key: str, limit: int = 3, both: bool = False) -> DataFrame:
    """Add ``filled``: linear interpolation of the first ``limit`` NULLs of every gap, with ``both`` of the last ``limit`` too.

    After a key's last value the first ``limit`` NULLs carry it on; before its first value the last ``limit`` NULLs take it
    with ``both`` and stay NULL without. Only gap edges travel: a gap of any length costs one row and its filled periods.
    The grid is written once, since several branches read it.
    """
    grid = materialize(grid, "grid")
    seen = grid.where("v is not null").select(key, "k", "v")
    span = seen.groupBy(key).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min_by("v", "k").alias("first"), F.max_by("v", "k").alias("last"))
    ends = grid.groupBy(key).agg(F.min("k").alias("glo"), F.max("k").alias("ghi")).join(span, key)
    gaps = rows_before_gaps(seen, [key], "k", ["v"])
    n = F.col("next_k") - F.col("k") - 1
    ahead = F.sequence(F.lit(1), F.least(F.lit(limit), n).cast("long"))
    back = F.when(n > limit, F.sequence(F.greatest(F.lit(limit + 1), n - limit + 1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))
    steps = gaps.withColumn("i", F.explode(F.concat(ahead, back) if both else ahead))
    inner = steps.select(key, (F.col("k") + F.col("i")).alias("k"), (F.col("v") + (F.col("next_v") - F.col("v")) * F.col("i") / (n + 1)).alias("f"))
    tail = ends.where("ghi > hi").select(key, F.explode(F.sequence(F.col("hi") + 1, F.least(F.col("hi") + limit, F.col("ghi")))).alias("k"), F.col("last").alias("f"))
    fills = inner.unionByName(tail)
    if both:
        fills = fills.unionByName(ends.where("glo < lo").select(key, F.explode(F.sequence(F.greatest(F.col("lo") - limit, F.col("glo")), F.col("lo") - 1)).alias("k"), F.col("first").alias("f")))
    return grid.join(fills, [key, "k"], "left").withColumn("filled", F.coalesce("v", "f")).drop("f")


def asof_backward(left: DataFrame, right: DataFrame, key: str, seconds: str, value: str, tolerance: int, out: str, tie: str | None = None) -> DataFrame:
    """Add ``out``: the value of the latest right row at or before each left row's time, at most ``tolerance`` seconds back.

    A NULL value of that row is kept, not searched behind. Of right rows at one time the largest ``tie`` (else value) wins.
    Rows are compared in cells of the tolerance's length, a right row standing in its own and the next cell, so no key
    has to fit in one task. Left rows may repeat; those with NULL key or time get NULL.
    """
    cell = F.floor(F.col("_t") / tolerance).cast("long")
    r = right.where(F.col(key).isNotNull() & F.col(seconds).isNotNull()).groupBy(key, F.col(seconds).alias("_t")).agg(
        F.max(F.struct(F.col(tie or value).alias("tie"), F.col(value).alias("x")))["x"].alias("_x"))
    r = r.withColumn("_cell", F.explode(F.array(cell, cell + 1)))
    rows = left.withColumn("_t", F.col(seconds)).withColumn("_cell", cell)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in (key, "_t", "_cell")]
    r = r.select(key, "_t", "_cell", *blank, F.struct("_t", "_x").alias("_r"), F.lit(0).alias("_side"))
    both = rows.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(1)).unionByName(r)
    w = Window.partitionBy(key, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("_r", ignorenulls=True).over(w)
    found = both.withColumn("_m", hit).where("_side = 1")
    near = F.when(F.col(key).isNotNull() & (F.col("_t") - F.col("_m._t") <= tolerance), F.col("_m._x"))
    return found.withColumn(out, near).select(*left.columns, out)


def rolling(grid: DataFrame, key: str, before: int, after: int, columns: dict[str, Column | tuple]) -> DataFrame:
    """Add window columns over the rows ``before``..``after`` positions around each row of a regular series; a column is an
    aggregate, or a pair of a function of the window spec and nothing else."""
    cut, keys = with_halo(grid, [key], "k", max(before, 0), max(after, 0))
    w = Window.partitionBy(*keys).orderBy("k")
    frame = w.rowsBetween(-before, after)
    return done_with_halo(cut.select("*", *[(c(w) if callable(c) else c.over(frame)).alias(n) for n, c in columns.items()]))


def analysis_rows(df: DataFrame, seconds: str, start_s: int | None = None, now_s: int | None = None) -> DataFrame:
    """Rows of the analysis period: at or after its start (earlier ones only warm the windows up, so slice after them) and not
    after the present, as feeds pad the day with times yet to come."""
    ok = F.lit(True)
    if start_s is not None:
        ok = ok & (F.col(seconds) >= start_s)
    if now_s is not None:
        ok = ok & (F.col(seconds) <= now_s)
    return df.where(ok)
