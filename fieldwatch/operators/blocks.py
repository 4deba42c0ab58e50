"""Neighbours along a series that is cut in blocks of positions, so that no series has to fit in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.session import materialize


def with_next(df: DataFrame, keys: list[str], pos: str, values: list[str], size: int = 4096, top: int = 3) -> DataFrame:
    """Add ``next_<pos>`` and ``next_<value>``: position and values of the following row of the same series.

    ``pos`` is a LONG unique within ``keys``. Rows are grouped in blocks of ``size`` positions; within a block the next row
    is a window function; the last row of a block takes the first row of the next block that has one, found by the same
    step over one row a block, ``top`` levels deep, so that a task of the last level sees 1/size**top of a series.
    The last row of a series gets NULLs. An empty table gives an empty table.
    """
    block = f"_block{top}"
    cut = df.withColumn(block, F.floor(F.col(pos) / F.lit(size)).cast("long"))
    w = Window.partitionBy(*keys, block).orderBy(pos)
    cols = [pos, *values]
    local = cut.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols], F.row_number().over(Window.partitionBy(*keys, block).orderBy(pos)).alias("_first"))
    if top == 0:
        whole = Window.partitionBy(*keys).orderBy(pos)
        return df.select("*", *[F.lead(c).over(whole).alias(f"next_{c}") for c in cols])
    at, mine = f"_b{top}", [f"_v{top}_{i}" for i in range(len(cols))]  # names of this level, apart from the caller's columns
    firsts = local.where("_first = 1").select(*keys, F.col(block).alias(at), *[F.col(c).alias(m) for c, m in zip(cols, mine)])
    ahead = with_next(firsts, keys, at, mine, size, top - 1)
    ahead = ahead.select(*[F.col(k).alias(f"_k{top}_{i}") for i, k in enumerate(keys)], at, *[F.col(f"next_{m}").alias(f"_n{m}") for m in mine])
    ends = local.where(f"next_{pos} is null")
    on = [F.col(k).eqNullSafe(F.col(f"_k{top}_{i}")) for i, k in enumerate(keys)] + [F.col(block) == F.col(at)]
    joined = ends.join(ahead, on, "left")
    out = [*df.columns]
    return local.where(f"next_{pos} is not null").select(*out, *[f"next_{c}" for c in cols]).unionByName(
        joined.select(*out, *[F.col(f"_n{m}").alias(f"next_{c}") for c, m in zip(cols, mine)])
    )


def rows_before_gaps(df: DataFrame, keys: list[str], pos: str, values: list[str], size: int = 4096) -> DataFrame:
    """Rows of each series whose following row is not at the very next position, with that row's position and values.

    One window over blocks of ``size`` positions finds gaps inside blocks; of the rest only the first and last row of each
    block are kept (in a written table), and ``with_next`` joins block ends across any number of empty blocks.
    Rows that end their series are not returned.
    """
    block = "_block"
    w = Window.partitionBy(*keys, block).orderBy(pos)
    cols = [pos, *values]
    local = df.withColumn(block, F.floor(F.col(pos) / F.lit(size)).cast("long")).select(
        *keys, block, *cols, *[F.lead(c).over(w).alias(f"next_{c}") for c in cols], F.lag(pos).over(w).isNull().alias("_first")
    )
    kept = materialize(local.where(f"_first or next_{pos} is null or next_{pos} > {pos} + 1"), "gap-edges")
    inner = kept.where(f"next_{pos} > {pos} + 1").select(*keys, *cols, *[f"next_{c}" for c in cols])
    ends = kept.where(f"_first or next_{pos} is null").select(*keys, *cols)
    # first and last rows of blocks in order: the row after a block's last is the first of the next block that has one
    outer = with_next(ends, keys, pos, values, size * size, 1).where(
        f"next_{pos} > {pos} + 1 and floor(next_{pos} / {size}) > floor({pos} / {size})"
    )
    return inner.unionByName(outer.select(*inner.columns))


def with_halo(df: DataFrame, keys: list[str], pos: str, before: int, after: int = 0, size: int = 4096) -> tuple[DataFrame, list[str]]:
    """Cut a regular series in blocks whose windows of ``before``/``after`` positions are complete.

    Returns the frame with columns ``_block`` and ``_halo`` and the partition keys for row-frame windows. Rows within
    ``before`` positions of a block's start also stand in that block as halo, likewise ``after``; take rows with
    ``not _halo`` once the windows are computed. So a window over a series of any length runs in tasks of bounded size, at
    the cost of (before + after) / size copied rows. Series must be regular: one row a position.
    """
    size = max(size, 2 * (before + after))
    own = F.floor(F.col(pos) / size).cast("long")
    first, last = F.floor((F.col(pos) - after) / size).cast("long"), F.floor((F.col(pos) + before) / size).cast("long")
    cut = df.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_halo", F.col("_block") != own)
    return cut, [*keys, "_block"]


def done_with_halo(df: DataFrame) -> DataFrame:
    """Drop copied rows and the block columns."""
    return df.where("not _halo").drop("_block", "_halo")


def sessions(df: DataFrame, keys: list[str], pos: str, gap: int, cell: int | None = None) -> DataFrame:
    """Add ``session``: the first position of the run of rows whose neighbours are at most ``gap`` apart.

    ``pos`` is a LONG and may repeat. Rows are compared inside cells of positions; of each cell only its first and last
    position and last session start travel to the next cells, so a key of any size spreads over tasks.
    """
    size = cell or max(4096, 64 * gap)
    c = df.withColumn("_cell", F.floor(F.col(pos) / size).cast("long"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(pos)
    c = c.withColumn("_p", F.lag(pos).over(inside))
    start = F.when(F.col("_p").isNotNull() & (F.col(pos) - F.col("_p") > gap), F.col(pos))
    c = c.withColumn("_start", F.last(start, ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    ends = c.groupBy(*keys, "_cell").agg(F.min(pos).alias("_a"), F.max(pos).alias("_b"), F.max("_start").alias("_s"))
    across = Window.partitionBy(*keys).orderBy("_cell")
    linked = F.coalesce(F.col("_a") - F.lag("_b").over(across) <= gap, F.lit(False))
    ends = ends.withColumn("_opens", F.when(~linked, F.col("_a")))
    # a cell's first run began at the last break before or at the cell's first row
    carry = F.last(F.coalesce("_s", "_opens"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), F.coalesce("_opens", carry).alias("_from"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_cell") == F.col("_c")]
    return c.join(ends, on).withColumn("session", F.coalesce("_start", "_from")).select(*df.columns, "session")


def positions(df: DataFrame, keys: list[str], pos: str, out: str = "i", size: int = 4096) -> DataFrame:
    """Add ``out``: the 1-based rank of each row within its series, positions being distinct. Rows are ranked inside blocks of
    positions; the blocks' counts, one row a block, are summed along the series."""
    cut = df.withColumn("_block", F.floor(F.col(pos) / size).cast("long"))
    local = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(pos)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return local.join(base, [*keys, "_block"]).withColumn(out, (F.col("_base") + F.col("_r")).cast("long")).select(*df.columns, out)


def forward_fill(df: DataFrame, keys: list[str], pos: str, column: str, out: str, size: int = 4096) -> DataFrame:
    """Add ``out``: the last known value of ``column`` at or before each row. Positions are distinct. Inside a block this is a
    window; into a block comes the last value of the blocks before, of which only one row each travels."""
    cut = df.withColumn("_block", F.floor(F.col(pos) / size).cast("long"))
    local = cut.withColumn("_l", F.last(column, ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy(pos)))
    lasts = cut.groupBy(*keys, "_block").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(pos))).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_block", F.last("_v", ignorenulls=True).over(before).alias("_c"))
    return local.join(carried, [*keys, "_block"]).withColumn(out, F.coalesce("_l", "_c")).select(*df.columns, out)
