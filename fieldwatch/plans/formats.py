"""Queries of readers and writers: every format is written from a table and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.functions.values import epoch_micros
from fieldwatch.functions.weather import FIELDS
from fieldwatch.plans.base import bulletins
from fieldwatch.session import table
from fieldwatch.sources.messages import from_messages, to_messages
from fieldwatch.sources.observatory import parse_dst, parse_iaga, parse_kp


def iaga_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals as observatory lines with one masked and one kept marker column."""
    r = table(spark, sf, "residuals")
    ts = F.col("ts").cast("timestamp")
    bad = F.col("residual").isNull() | F.isnan("residual")
    x = F.when(bad, "99999.00").otherwise(F.format_string("%.2f", "residual"))
    line = F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss.SSS"), F.date_format(ts, "DDD"), x, F.lit("99999.00"), F.lit("88888.00"), F.lit("0.00"))
    names = ["DATE", "TIME", "DOY", "OBSX", "OBSY", "OBSZ", "OBSF"]
    rows = parse_iaga(r.select("reading_id", line.alias("line")), names, ["reading_id"])
    return rows.select("reading_id", epoch_micros(F.col("ts")).alias("us"), "x_nt", "y_nt", "z_nt", "f_nt")


def kp_json(spark: SparkSession, sf: str) -> DataFrame:
    """Kp documents per observatory and day."""
    b = bulletins(spark, sf).where("kp is not null")
    row = F.struct("s", "kp", "bulletin_id")
    doc = b.groupBy("station", F.floor(F.col("s") / 86400).alias("d")).agg(F.array_sort(F.collect_list(row)).alias("x"))
    text = F.to_json(F.struct(F.transform("x", lambda v: F.date_format(F.timestamp_seconds(v["s"]), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime"), F.transform("x", lambda v: v["kp"]).alias("Kp")))
    return parse_kp(doc.select("station", text.alias("document")), ["station"]).select("station", F.unix_timestamp("ts").alias("s"), "kp")


def dst_fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly Dst as fixed-width lines per observatory and day."""
    h = bulletins(spark, sf).where("dst between -999 and 9998").groupBy("station", F.floor(F.col("s") / 86400).alias("d"), F.floor(F.pmod(F.col("s"), F.lit(86400)) / 3600).alias("h")).agg(F.min("dst").cast("int").alias("dst"))
    day = h.groupBy("station", "d").agg(F.map_from_entries(F.collect_list(F.struct("h", "dst"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda x: F.lpad(F.coalesce(F.try_element_at("m", x.cast("long")).cast("string"), F.lit("9999")), 4, " "))
    date = F.timestamp_seconds(F.col("d") * 86400)
    line = F.concat(F.lit("DST"), F.date_format(date, "yyMM"), F.lit("*"), F.date_format(date, "dd"), F.lit(" " * 10), F.array_join(cells, ""), F.lit("    "))
    lines = day.select("station", line.alias("line"), F.unix_timestamp(F.date_trunc("month", date)).alias("month"))
    return parse_dst(lines, F.col("month"), ["station"])


def envelope_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Weather readings as JSON messages and back."""
    w = table(spark, sf, "weather_readings")
    w = w.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in FIELDS})
    lines = to_messages(w, F.col("record_id"), F.col("ts"), F.struct(*FIELDS))
    return from_messages(lines, "weather")


def parse_props_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price (thousands) of orders per day and priority as a regular series with empty days."""
    from fieldwatch.operators.series import regular_grid

    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("station"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("s"), (F.col("o_totalprice") / 1000).alias("v"))
    return regular_grid(o, "station", "s", "v", 86400).select("station", "k", "v")


_IX = "with ix as (select upper(replace(observatory, ' ', '')) as station, epoch_us(ts) // 1000000 as s, kp, dst from index_bulletins) "
QUERIES = {"iaga_parse": iaga_parse, "kp_json": kp_json, "dst_fixed_width": dst_fixed_width, "envelope_roundtrip": envelope_roundtrip, "parse_props_json": parse_props_json, "orders_daily": orders_daily}
SQL = {
    "iaga_parse": "select reading_id, epoch_us(ts) // 1000 * 1000 as us, case when residual is null or isnan(residual) or isinf(residual) or abs(residual) >= 99999 then null else round(residual, 2) end as x_nt, null::double as y_nt, 88888.0::double as z_nt, 0.0::double as f_nt from residuals",
    "kp_json": _IX + "select station, s, kp from ix where kp is not null",
    "dst_fixed_width": _IX + "select station, s // 3600 * 3600 as s, trunc(min(dst))::int as dst from ix where dst between -999 and 9998 group by station, s // 3600",
    "envelope_roundtrip": "select record_id as sequence_number, epoch_us(ts) as us, " + ", ".join(f"case when isnan({f}) then null else {f} end as {f}" for f in FIELDS) + " from weather_readings",
    "parse_props_json": "select event_id, (props->>'k')::int as k from events",
    "orders_daily": "with o as (select o_orderpriority as station, (epoch_us(o_orderdate) // 86400000000)::bigint as k, avg(o_totalprice / 1000) as v from orders group by 1, 2), b as (select station, min(k) as a, max(k) as b from o group by 1), g as (select station, unnest(range(a, b + 1)) as k from b) select g.station, g.k, round(o.v + 1e-11, 9) as v from g left join o on g.station = o.station and g.k = o.k",
}
