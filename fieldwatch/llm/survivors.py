"""One surviving record of each group of duplicate picks: ranked by trust, completeness and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.session import materialize

KEY = ["network", "site", "location", "wave"]
#: Seconds of one cell: a series is cut in cells, so that none has to fit in one task.
CELL_S = 3600


def pick_time_us(text: Column) -> Column:
    """Microseconds since the epoch of a time written in ISO form (any zone; none means UTC), compact form or as epoch
    seconds; NULL for other writings. The usual form is read at once, the others are levelled first."""
    t = F.upper(F.trim(text))
    compact = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    iso = F.regexp_replace(F.regexp_replace(compact, r"(\d)\s+(\d)", "$1T$2"), r"\s+", "")
    zoned = F.when(iso.rlike(r"T.*(Z|[+-]\d{2}:?(\d{2})?)$"), F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(iso, F.lit("Z")))
    seconds = (t.try_cast("decimal(20,6)") * 1000000).cast("long")
    usual = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return (F.when(usual, F.unix_micros(t.try_cast("timestamp"))).when(t.rlike(r"^-?\d+(\.\d+)?$"), seconds)
            .when(t.rlike(r"^\d{4}-?\d{2}-?\d{2}[T\s]+\d{2}:?\d{2}"), F.unix_micros(zoned.try_cast("timestamp"))))


def pick_key(trace_id: Column, phase: Column) -> list[Column]:
    """Network, station, location (empty for ``--``) and wave (P or S); NULL where a form of writing is unknown."""
    parts = F.split(F.replace(F.upper(F.trim(trace_id)), F.lit("_"), F.lit(".")), r"\.")
    return key_of(parts, F.upper(F.trim(phase)))


def key_of(parts: Column, phase: Column) -> list[Column]:
    """The key of a trace's parts and a phase, both in upper case."""
    ok = F.size(parts).isin(3, 4)
    loc = F.trim(F.try_element_at(parts, F.lit(3)))
    wave = F.regexp_extract(phase, r"^([PS])(?:[- _]?WAVE)?$", 1)
    return [F.when(ok, F.trim(parts[0])).alias("network"), F.when(ok, F.trim(F.try_element_at(parts, F.lit(2)))).alias("site"),
            F.when(ok, F.when(loc == "--", "").otherwise(loc)).alias("location"), F.nullif(wave, F.lit("")).alias("wave")]


_OLDEST = 70_000_000_000_000_000  # microseconds from the first representable time to the epoch, rounded up
_SPAN = 330_000_000_000_000_000  # microseconds of all representable times, rounded up


def survivor_rank(review: Column, probability: Column, model: Column, received_at: Column, pick_id: Column) -> Column:
    """One DECIMAL(38) that orders picks: a manual review before any other, then more non-NULL values among probability and model, then
    the later arrival (NULL last), then the smaller id. ``ranked_id`` gives the id back."""
    manual = F.coalesce(F.lower(F.trim(review)) == "manual", F.lit(False)).cast("long")
    complete = probability.isNotNull().cast("long") + model.isNotNull().cast("long")
    recent = F.coalesce(F.unix_micros(received_at.cast("timestamp")) + F.lit(_OLDEST), F.lit(0))
    upper = (manual * 3 + complete) * F.lit(_SPAN) + recent
    low = F.lit(2**63 - 1).cast("decimal(20,0)") - pick_id.cast("long").cast("decimal(20,0)")
    return (upper.cast("decimal(19,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def ranked_id(rank: Column) -> Column:
    """The pick_id inside a ``survivor_rank``."""
    return (F.lit(2**63 - 1).cast("decimal(20,0)") - rank % F.lit(str(2**64)).cast("decimal(20,0)")).cast("long")


def pick_groups(picks: DataFrame, step_s: float = 1.0) -> DataFrame:
    """Groups of picks of one arrival: (network, site, location, wave, first_us, last_us, picks, pick_id).

    Input (pick_id, phase, time, probability, model, trace_id, review, received_at). Picks of one key whose times form a
    chain with steps of at most ``step_s`` are one group; ``pick_id`` is its survivor: a manual review before any other,
    then more non-NULL values among probability and model, then the later arrival (NULL last), then the smaller id.
    Picks without a readable key or time belong to no group. Exact copies under new ids are ordinary members. Further
    columns are ignored; an empty table gives none.

    Picks are first combined per key and step-long bucket, before any shuffle, in a hash aggregate: picks within one bucket
    are always one group, and only neighbouring buckets can be linked. Chains are found in cells of one hour, ordered by a window, and
    reduced there; the few that reach a cell's edge, at most two rows a cell, are joined along their key.
    """
    step = round(step_s * 1e6)
    per_cell = max(1, round(CELL_S * 1e6 / step))
    rank = survivor_rank(F.col("review"), F.col("probability"), F.col("model"), F.col("received_at"), F.col("pick_id"))
    split = F.split(F.replace(F.upper(F.trim("trace_id")), F.lit("_"), F.lit(".")), r"\.")
    texts = picks.select(split.alias("parts"), F.upper(F.trim("phase")).alias("phase"), pick_time_us(F.col("time")).alias("us"), rank.alias("rank"))
    rows = texts.select(*key_of(F.col("parts"), F.col("phase")), "us", "rank")
    sound = F.col("us").isNotNull()
    for c in KEY:
        sound = sound & F.col(c).isNotNull()
    # rows without key or time are left out after they are combined: a filter before would read all texts twice
    buckets = rows.groupBy(*KEY, F.floor(F.col("us") / step).cast("long").alias("b")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.when(sound, 1)).alias("n"), F.max("rank").alias("rank")).where("n > 0")
    cell = F.floor(F.col("b") / per_cell).cast("long")
    # the last bucket of a cell also stands in the next, as a guest that shows whether a group goes on
    own = F.struct(cell.alias("cell"), F.lit(False).alias("guest"))
    guest = F.struct((cell + 1).alias("cell"), F.lit(True).alias("guest"))
    at_end = F.pmod(F.col("b"), F.lit(per_cell)) == per_cell - 1
    placed = buckets.select("*", F.explode(F.when(at_end, F.array(own, guest)).otherwise(F.array(own))).alias("p")).select(*buckets.columns, "p.cell", "p.guest")
    by_cell = Window.partitionBy(*KEY, "cell").orderBy("b")
    linked = F.coalesce((F.lag("b").over(by_cell) == F.col("b") - 1) & (F.col("lo") - F.lag("hi").over(by_cell) <= step), F.lit(False))
    grouped = placed.withColumn("new", (~linked).cast("int")).withColumn("island", F.sum("new").over(by_cell))
    mine = lambda c: F.when(~F.col("guest"), F.col(c))
    islands = grouped.groupBy(*KEY, "cell", "island").agg(
        F.max(mine("rank")).alias("rank"), F.sum(mine("n")).alias("n"), F.max("guest").alias("goes_back"), F.max(mine("b")).alias("last_b"), F.min(mine("lo")).alias("first_us"), F.max(mine("hi")).alias("last_us"))
    islands = islands.where("n is not null").withColumn("goes_on", F.pmod(F.col("last_b"), F.lit(per_cell)) == per_cell - 1)
    out = [*KEY, "first_us", "last_us", F.col("n").alias("picks"), ranked_id(F.col("rank")).alias("pick_id")]
    islands = materialize(islands, "pick-islands")
    whole = islands.where("not goes_back and not goes_on").select(*out)
    chain = Window.partitionBy(*KEY).orderBy("cell", "island")
    crossing = islands.where("goes_back or goes_on").withColumn("chain", F.sum((~F.col("goes_back")).cast("int")).over(chain))
    joined = crossing.groupBy(*KEY, "chain").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.max("rank").alias("rank"))
    return whole.unionByName(joined.select(*out))
