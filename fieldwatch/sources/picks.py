"""Picks as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def typed_picks(picks: DataFrame) -> DataFrame:
    """(pick_id, sta, channel, wave, us, p, model): station code NET.STA.LOC, channel or NULL, P or S, microseconds since the
    epoch, probability 0..1. Times may be ISO with or without zone (then UTC), compact, or epoch seconds; rows without
    readable time, phase or station are left out."""
    text = F.upper(F.trim("time"))
    iso = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})([\d.]+)", "$1-$2-$3T$4:$5:$6")
    zone = iso.rlike(r"^\S+[T ].*(Z|[+-]\d{2}:\d{2})$")
    us = F.when(text.rlike(r"^\d+(\.\d+)?$"), (text.try_cast("decimal(20,6)") * 1_000_000).cast("long")).otherwise(
        F.unix_micros(F.when(zone, iso).otherwise(F.concat(iso, F.lit("Z"))).try_cast("timestamp")))
    part = F.split(F.translate(F.upper(F.trim("trace_id")), "_", "."), r"\.")
    loc = F.replace(F.trim(part[2]), F.lit("--"), F.lit(""))
    sta = F.when(F.size(part).between(3, 4), F.concat_ws(".", F.trim(part[0]), F.trim(part[1]), loc))
    p = F.when(F.col("probability") > 1, F.col("probability") / 100).otherwise(F.col("probability"))
    out = picks.select("pick_id", sta.alias("sta"), F.try_element_at(part, F.lit(4)).alias("channel"), F.nullif(F.regexp_extract(F.upper(F.trim("phase")), "^([PS])(-WAVE)?$", 1), F.lit("")).alias("wave"),
                       us.alias("us"), p.alias("p"), F.lower("model").alias("model"))
    return out.dropna(subset=["sta", "wave", "us"])
