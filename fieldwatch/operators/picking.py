"""Seismic picks: greedy deduplication, agreement of two models, three-component groups, overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.operators.blocks import sessions


def dedup(picks: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Picks kept by the greedy rule: in time order, a pick at most the tolerance after the last kept one replaces it if its
    probability is strictly higher, else is dropped. Order of ties: id.

    A pick farther than the tolerance from its predecessor is farther from every kept one, so runs of close picks are
    independent; only a run is folded in one place. NULL probability counts as the lowest.
    """
    runs = sessions(picks, keys, "us", tolerance_us)
    row = F.struct("us", "pick_id", F.coalesce("p", F.lit(-1.0)).alias("p"), "model")
    lists = runs.groupBy(*keys, "session").agg(F.array_sort(F.collect_list(row)).alias("run"))
    # kept picks in front, the moving anchor last
    fold = F.aggregate(
        F.expr("slice(run, 2, greatest(size(run) - 1, 0))"), F.expr("slice(run, 1, 1)"),
        lambda kept, x: F.when(x["us"] - F.element_at(kept, -1)["us"] > tolerance_us, F.concat(kept, F.array(x)))
        .when(x["p"] > F.element_at(kept, -1)["p"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept))
    return lists.select(*keys, F.explode(fold).alias("x")).select(*keys, "x.us", "x.pick_id", F.nullif(F.col("x.p"), F.lit(-1.0)).alias("p"), "x.model")


def agreeing(a: DataFrame, b: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Rows of ``a`` with at least one row of ``b`` of the same keys within the tolerance (inclusive): a range semi-join,
    looked up in cells of the tolerance's length."""
    cell = F.floor(F.col("us") / tolerance_us).cast("long")
    other = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("us").alias("_us"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [cell == F.col("_cell"), F.abs(F.col("us") - F.col("_us")) <= tolerance_us]
    return a.join(other, on, "left_semi")


def triplets(traces: DataFrame, key: str, channel: str, value: str, order: str) -> DataFrame:
    """Three components per key: the last trace of Z with those of N and E, else of 1 and 2; keys without all are dropped.
    (key, z, n, e)."""
    comp = F.upper(F.substring(channel, -1, 1))
    last = {c: F.max_by(F.when(comp == c, F.col(value)), F.when(comp == c, F.col(order))).alias(c) for c in ("Z", "N", "E", "1", "2")}
    g = traces.groupBy(key).agg(*last.values())
    named = F.col("N").isNotNull() & F.col("E").isNotNull()
    return g.select(key, F.col("Z").alias("z"), F.when(named, F.col("N")).otherwise(F.col("1")).alias("n"), F.when(named, F.col("E")).otherwise(F.col("2")).alias("e")).dropna(subset=["z", "n", "e"])


def sliding_windows(samples: DataFrame, key: str, seconds: str, width: int, step: int) -> DataFrame:
    """Windows [start, start + width] from a key's first time on while they end by its last, a single one if it is shorter:
    (key, idx, start, samples). Samples at both ends count."""
    span = samples.groupBy(key).agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))
    n = F.greatest(F.lit(0), F.floor((F.col("hi") - F.col("lo") - width) / step)).cast("int")
    windows = span.select(key, "lo", F.posexplode(F.sequence(F.lit(0), n))).select(key, F.col("pos").alias("idx"), (F.col("lo") + F.col("pos") * step).alias("start"))
    # a sample names the windows it lies in, so the join is by equality
    rel = F.col(seconds) - F.col("lo")
    first = F.greatest(F.lit(0), F.ceil((rel - width) / step)).cast("int")
    last = F.least(F.floor(rel / step), n).cast("int")
    hits = samples.join(span, key).where(last >= first).select(key, F.explode(F.sequence(first, last)).alias("idx")).groupBy(key, "idx").agg(F.count(F.lit(1)).alias("samples"))
    return windows.join(hits, [key, "idx"], "left").na.fill(0, ["samples"]).withColumn("idx", F.col("idx").cast("long"))
