"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.llm.abuse import AbuseRule, rates_by_source, score_documents
from fieldwatch.llm.leaks import find_leaks, remove_leaks
from fieldwatch.llm.packing import count_tokens, fill_report, pack
from fieldwatch.session import materialize, table


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document with its container, for each kind."""
    return pack(materialize(count_tokens(table(spark, sf, "documents")), "tokens"), table(spark, sf, "capacities"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, the least that could do, and unused room per kind."""
    return fill_report(p6_packed(spark, sf))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with the share of the item and the number of places."""
    leaks = find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return leaks.select("doc_id", "item_id", F.round("share", 6).alias("share"), F.size("spans").alias("places"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return p7_spans(spark, sf).select("doc_id", "item_id").distinct()


def _cleaned(spark: SparkSession, sf: str, how: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return remove_leaks(documents, find_leaks(documents, table(spark, sf, "eval_items")), how)


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, leaked words cut out: its length in code points before and after."""
    return _cleaned(spark, sf, "spans").select("doc_id", "n_chars", F.length("text").alias("kept_chars"))


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without any leak."""
    return _cleaned(spark, sf, "documents").select("doc_id", "source")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every document, weights fitted to the reviewed samples."""
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "review_samples"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents at or above the threshold."""
    return p8_scores(spark, sf).where(F.col("score") >= AbuseRule().threshold).select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates per source."""
    return rates_by_source(p8_scores(spark, sf))


QUERIES = {"p6_packed": p6_packed, "p6_fill": p6_fill, "p7_found": p7_found, "p7_spans": p7_spans, "p7_clean": p7_clean, "p7_kept": p7_kept, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
