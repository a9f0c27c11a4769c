"""Result sinks: folders of JSON and CSV files, written by all tasks at once (SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(items: DataFrame, path: str) -> None:
    """SNK1: one JSON document per filing with its items in order, in a folder a market. items: market, doc_id, seq, …"""
    rest = [c for c in items.columns if c not in ("market", "doc_id")]
    own = items.groupBy("market", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c != "seq"]))).alias("items"))
    own.write.partitionBy("market").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK2, SNK3: CSV with a header; every cell is quoted, quotes inside are doubled."""
    rows.write.csv(path, header=True, quoteAll=True, quote='"', escape='"')


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def review_rows(rows: DataFrame) -> DataFrame:
    """SNK4: rows with the stable id market:code:period:field:period_type in front."""
    return rows.select(F.concat_ws(":", "market", "code", "period", "field", "period_type").alias("id"), "*")


ITEM_COLUMNS = "status field metric_zh metric_en period_type period_end raw_value unit value currency page quote category reason_zh reason_en auxiliary prior_year_raw prior_year_page".split()
COMPARE_COLUMNS = "company code market field raw_value unit value currency status listing_currency fx_rate fx_date fx_type fx_source value_listing".split()


def item_rows(items: DataFrame) -> DataFrame:
    """SNK2: the columns of the item export; what the items lack is empty. The year-on-year change (pct) is written in
    percent with two decimals."""
    have = lambda c: (F.col(c) if c in items.columns else F.lit(None)).cast("string").alias(c)
    return items.select(*map(have, ITEM_COLUMNS), F.replace(F.format_number(F.col("pct") * 100, 2), F.lit(",")).alias("yoy_pct_code"))


def compare_rows(cells: DataFrame, fx_type: str, fx_source: str) -> DataFrame:
    """SNK3: the columns of the cross-company export, from ``converted`` cells; rate columns are empty without a rate, and
    an amount in the listing currency has a rate of type none without a source."""
    own, same = cells.withColumn("fx_rate", F.col("rate")).withColumn("fx_date", F.col("rate_date")), F.col("currency") == F.col("listing_currency")
    kind = lambda c, alone: F.when(same, alone).when(F.col("rate").isNotNull(), c)
    own = own.withColumn("fx_type", kind(fx_type, "none")).withColumn("fx_source", kind(fx_source, ""))
    return own.select(*[F.col(c).cast("string").alias(c) for c in COMPARE_COLUMNS])
