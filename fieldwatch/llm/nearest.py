"""Nearest record in time of the same entity: range partitions, local scans and a prefix scan over partition edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.functions.values import epoch_micros
from fieldwatch.session import materialize, partitions_for

OUT = "pid int, entity string, id long, us long, prev_us long, prev_id long, next_us long, next_id long, edge boolean"
_SCHEMA = pa.schema([("pid", pa.int32()), ("entity", pa.string()), *[(c, pa.int64()) for c in ("id", "us", "prev_us", "prev_id", "next_us", "next_id")], ("edge", pa.bool_())])
_CHUNK = 256


def level_code(code: Column) -> Column:
    """An entity code without case and blanks; NULL where nothing remains."""
    return F.nullif(F.upper(F.translate(code, " \t\r\n ", "")), F.lit(""))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left rows with the nearest right rows inside the partition, and the right rows at its edges.

    Rows are sorted by (entity, us, side, id), right before left at equal times. Of equal right times the first, which has
    the smallest id, stands for all.
    """
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    pid = TaskContext.get().partitionId()
    t = t.combine_chunks()
    code = t.column("entity").dictionary_encode().combine_chunks()
    code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
    names, ent = code.dictionary, code.indices.to_numpy(zero_copy_only=False)
    us, ids = t.column("us").to_numpy(), t.column("id").to_numpy()
    left = t.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
    n = len(us)
    new = np.ones(n, bool)
    new[1:] = ent[1:] != ent[:-1]
    first_of = np.flatnonzero(new)[np.cumsum(new) - 1]
    rights = np.flatnonzero(~left)
    # first right row of every run of equal (entity, us)
    lead = np.ones(len(rights), bool)
    lead[1:] = (us[rights][1:] != us[rights][:-1]) | (ent[rights][1:] != ent[rights][:-1])
    group = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(rights) else np.zeros(0, int)
    rows = np.flatnonzero(left)

    def take(which: np.ndarray, ok: np.ndarray) -> tuple[pa.Array, pa.Array]:
        at = rights[np.where(ok, which, 0)] if len(rights) else np.zeros(len(which), int)
        return pa.array(us[at], pa.int64(), mask=~ok), pa.array(ids[at], pa.int64(), mask=~ok)

    def emit(at: np.ndarray, before: np.ndarray, after: np.ndarray, edge: bool) -> pa.RecordBatch:
        okb = (before >= 0) if not len(rights) else (before >= 0) & (rights[np.maximum(before, 0)] >= first_of[at])
        oka = (after < len(rights)) if not len(rights) else (after < len(rights)) & (ent[rights[np.minimum(after, len(rights) - 1)]] == ent[at])
        rep = group[np.maximum(before, 0)] if len(rights) else before
        pu, pi = take(rep, okb)
        nu, ni = take(np.minimum(after, max(len(rights) - 1, 0)), oka)
        cols = [pa.array(np.full(len(at), pid), pa.int32()), names.take(pa.array(ent[at])), pa.array(ids[at]), pa.array(us[at]), pu, pi, nu, ni, pa.array(np.full(len(at), edge))]
        return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)

    if len(rows):
        k = np.searchsorted(rights, rows)  # right rows before each left row in sort order
        yield emit(rows, k - 1, k, False)
    # the first and last entity of the partition may go on in its neighbours: their last and first right rows here
    ends = np.unique(np.array([0, first_of[n - 1]]))
    stop = np.array([np.flatnonzero(new)[1] if e == 0 and new.sum() > 1 else n for e in ends])
    yield emit(ends, np.searchsorted(rights, stop) - 1, np.searchsorted(rights, ends), True)


def prefix_scan(edges: DataFrame) -> DataFrame:
    """Per (pid, entity): the last right row of the entity in all earlier partitions and the first in all later ones.

    Both are running maxima and minima, so they combine in any grouping: chunks of partitions are scanned in parallel, then
    the chunks' totals, then both are joined. The table has at most two rows a partition.
    """
    back, ahead = F.struct("prev_us", (-F.col("prev_id")).alias("o")), F.struct("next_us", "next_id")
    e = edges.select("pid", "entity", F.when(F.col("prev_us").isNotNull(), back).alias("last"), F.when(F.col("next_us").isNotNull(), ahead).alias("first"),
                     F.floor(F.col("pid") / _CHUNK).alias("chunk"))
    inside = Window.partitionBy("entity", "chunk").orderBy("pid")
    local = e.select("pid", "entity", "chunk", F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                     F.min("first").over(inside.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    across = Window.partitionBy("entity").orderBy("chunk")
    total = e.groupBy("entity", "chunk").agg(F.max("last").alias("last"), F.min("first").alias("first")).select(
        "entity", "chunk", F.max("last").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("far_before"),
        F.min("first").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("far_after"))
    return local.join(total, ["entity", "chunk"]).select("pid", "entity", F.greatest("before", "far_before").alias("before"), F.least("after", "far_after").alias("after"))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_s: float, target_rows: int = 250_000, rows_about: int | None = None) -> DataFrame:
    """For each row of ``left`` (id, entity, ts) the row of ``right`` (id, entity, ts) of the same entity that is nearest in
    time: (left_id, right_id, offset_us), right minus left in microseconds.

    At most ``tolerance_s`` away, inclusive; on a tie the smaller right id. Rows of ``left`` without partner come out with
    NULLs, also those with NULL entity or time; NULL entities and times never match. Repeated left rows come out as often
    as they come in. Further columns are not passed on.

    Both tables are range-partitioned together by (entity, time, id), so that a large entity spreads over tasks. Partitions
    are scanned locally; right rows at partition edges reach other partitions by a prefix scan. ``rows_about``, such as a count from
    file footers, saves two passes that count the rows.
    """
    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select("entity", epoch_micros(F.col("ts")).alias("us"), F.lit(is_left).alias("is_left"), F.col("id").cast("long").alias("id"))

    lost = side(left, True).where("entity is null or us is null")
    whole = side(left, True).unionByName(side(right, False)).where("entity is not null and us is not null")
    n = partitions_for(left.count() + right.count() if rows_about is None else rows_about, target_rows)
    ranged = whole.repartitionByRange(n, "entity", "us", "is_left", "id").sortWithinPartitions("entity", "us", "is_left", "id")
    scanned = materialize(ranged.mapInArrow(_scan, OUT), "nearest-pass")
    carry = prefix_scan(scanned.where("edge"))
    rows = scanned.where("not edge").join(carry, ["pid", "entity"], "left")
    prev = F.greatest(F.when(F.col("prev_us").isNotNull(), F.struct(F.col("prev_us").alias("us"), (-F.col("prev_id")).alias("o"))),
                      F.when(F.col("before").isNotNull(), F.struct(F.col("before.prev_us").alias("us"), F.col("before.o").alias("o"))))
    after = F.least(F.when(F.col("next_us").isNotNull(), F.struct(F.col("next_us").alias("us"), F.col("next_id").alias("o"))),
                    F.when(F.col("after").isNotNull(), F.struct(F.col("after.next_us").alias("us"), F.col("after.next_id").alias("o"))))
    rows = rows.select("id", "us", prev.alias("p"), after.alias("n"))
    best = F.least(
        F.when(F.col("p").isNotNull(), F.struct((F.col("us") - F.col("p.us")).alias("d"), (-F.col("p.o")).alias("id"), (F.col("p.us") - F.col("us")).alias("off"))),
        F.when(F.col("n").isNotNull(), F.struct((F.col("n.us") - F.col("us")).alias("d"), F.col("n.o").alias("id"), (F.col("n.us") - F.col("us")).alias("off"))))
    rows = rows.select("id", best.alias("m")).withColumn("m", F.when(F.col("m.d") <= round(tolerance_s * 1e6), F.col("m")))
    out = rows.select(F.col("id").alias("left_id"), F.col("m.id").alias("right_id"), F.col("m.off").alias("offset_us"))
    none = F.lit(None).cast("long")
    return out.unionByName(lost.select(F.col("id").alias("left_id"), none.alias("right_id"), none.alias("offset_us")))
