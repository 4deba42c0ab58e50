"""Observatory text formats: IAGA-2002 lines, Kp documents, fixed-width Dst lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwatch.functions.values import finite

#: Fixed value: magnitudes from here on mark missing samples.
MASK = 99999.0


class FormatError(ValueError):
    """A payload that is not in the expected format."""


def column_index(names: list[str], component: str) -> int | None:
    """Position of the four-letter column name that ends with the component."""
    hits = [i for i, n in enumerate(names) if len(n) == 4 and n.upper().endswith(component)]
    return hits[0] if hits else None


def iaga_header(lines: DataFrame, text: str = "line") -> list[str]:
    """Column names of the header line; pages in markup and missing or short headers are errors."""
    if lines.where(F.lower(F.ltrim(text)).rlike(r"^<(!doctype|html)")).limit(1).count():
        raise FormatError("markup instead of data")
    first = lines.where(F.col(text).startswith("DATE")).select(text).first()
    names = first[0].replace("|", " ").split() if first else []
    if len(names) < 7:
        raise FormatError("no header of at least seven names")
    return names


def parse_iaga(lines: DataFrame, names: list[str], keys: list[str] = (), text: str = "line") -> DataFrame:
    """(keys, ts, x_nt, y_nt, z_nt, f_nt) of data lines, those that begin with a digit. Lines with fewer parts than columns, or
    without a readable time, are left out; bad and masked numbers are NULL. Blank lines and comments are skipped."""
    part = F.split(F.trim(text), r"\s+")
    rows = lines.where(F.col(text).rlike("^[0-9]")).withColumn("_p", part).where(F.size("_p") >= len(names))

    def number(component: str) -> Column:
        i = column_index(names, component)
        if i is None:
            return F.lit(None).cast("double")
        x = finite(F.try_element_at("_p", F.lit(i + 1)).try_cast("double"))
        return F.when(F.abs(x) < MASK, x)

    ts = F.concat_ws(" ", F.col("_p")[0], F.col("_p")[1]).try_cast("timestamp")
    out = rows.select(*keys, ts.alias("ts"), *[number(c).alias(f"{c.lower()}_nt") for c in "XYZF"])
    return out.where("ts is not null")


def parse_kp(documents: DataFrame, keys: list[str] = (), text: str = "document") -> DataFrame:
    """(keys, ts, kp) of documents with the parallel arrays ``datetime`` and ``Kp``; unreadable documents give no rows."""
    doc = F.from_json(text, "datetime array<string>, Kp array<double>")
    rows = documents.select(*keys, F.explode(F.arrays_zip(doc["datetime"].alias("t"), doc["Kp"].alias("kp"))).alias("x"))
    return rows.select(*keys, F.col("x.t").try_cast("timestamp").alias("ts"), F.col("x.kp").alias("kp")).where("ts is not null")


def parse_dst(lines: DataFrame, day: Column, keys: list[str] = (), text: str = "line") -> DataFrame:
    """(keys, s, dst) of fixed-width lines: the day in columns 8:10, then 24 values of four characters from column 20.

    ``day`` is the epoch second of the month's first day. Lines under 116 characters or without day are left out; blank
    values and 9999 are missing.
    """
    rows = lines.where((F.length(text) >= 116) & F.substring(text, 9, 2).rlike("^[ 0-9][0-9]$"))
    values = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.substring(F.col(text), F.lit(21) + h * 4, F.lit(4)))
    at = day + (F.trim(F.substring(text, 9, 2)).cast("long") - 1) * 86400
    long = rows.select(*keys, at.alias("_d"), F.posexplode(values).alias("h", "x"))
    v = F.trim("x").try_cast("int")
    return long.where(v.isNotNull() & (v != 9999)).select(*keys, (F.col("_d") + F.col("h") * 3600).alias("s"), v.alias("dst"))
