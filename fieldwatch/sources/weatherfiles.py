"""Hourly weather CSV files: columns found by name parts, units brought to SI, several files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field, parts of the column name of which one must occur, parts that must not, factor to SI units. The first column that fits counts.
PARTS = [
    ("temperature", ("temp",), ("dew", "flag"), 1.0), ("humidity_prec", ("rel hum", "humidity"), ("flag",), 1.0), ("barometer", ("press", "barometer"), ("flag",), 10.0),
    ("wind_speed", ("spd", "wind speed"), ("flag",), 1000.0 / 3600.0), ("wind_direction", ("dir", "wind dir"), ("flag",), 10.0),
]


def find_columns(names: list[str]) -> dict[str, str]:
    """Field -> column name, by lower-case parts; the time column as ``time``. A file without time column is an error."""
    fits = lambda n, parts, without: any(x in n.lower() for x in parts) and not any(x in n.lower() for x in without)
    out = {field: n for field, parts, without, _ in PARTS for n in reversed(names) if fits(n, parts, without)}
    times = [n for n in names if "date/time" in n.lower()]
    if not times:
        raise ValueError("no date/time column")
    return out | {"time": times[0]}


def read_hourly(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ts, fields) of hourly files with one header each; missing columns and readings that are no numbers are NULL, rows
    without readable time are left out."""
    raw = spark.read.option("header", True).csv(paths)
    names = find_columns(raw.columns)
    cell = lambda n: F.trim(F.col(f"`{n}`"))
    value = lambda f, k: (cell(names[f]).try_cast("double") * k if f in names else F.lit(None).cast("double")).alias(f)
    ts = F.try_to_timestamp(cell(names["time"]), F.lit("yyyy-MM-dd HH:mm")).alias("ts")
    return raw.select(ts, *[value(f, k) for f, _, _, k in PARTS]).where("ts is not null")


def coordinates(spark: SparkSession, path: str) -> tuple[float, float] | None:
    """Latitude and longitude of a file's first row; NULL without such columns or rows."""
    raw = spark.read.option("header", True).csv(path)
    lat, lon = ([n for n in raw.columns if p in n.lower()] for p in ("latitude", "longitude"))
    row = raw.select(F.col(f"`{lat[0]}`").try_cast("double"), F.col(f"`{lon[0]}`").try_cast("double")).first() if lat and lon else None
    return (row[0], row[1]) if row and None not in tuple(row) else None


def synthetic_fill(rows: DataFrame, column: str, mean: float, spread: float, *seed: str) -> DataFrame:
    """Fill NULLs of a column with reproducible noise (a normal deviate from a hash of the seed columns) and mark them."""
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *seed), F.lit(1 << 40)).cast("double") + 1) / float((1 << 40) + 1)
    noise = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    gap = F.col(column).isNull()
    return rows.withColumn(f"{column}_synthetic", gap).withColumn(column, F.when(gap, F.round(mean + spread * noise, 2)).otherwise(F.col(column)))
