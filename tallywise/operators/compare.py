"""Exchange rates and cross-company comparison (CMP1-CMP4), year-on-year changes (INS3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise


def as_of(asked: DataFrame, rates: DataFrame) -> DataFrame:
    """CMP1: asked (id, ccy, date) with the last rate published on or before the date, and its date.

    A union sorted by time within (ccy, year) takes the last rate of the same year; only questions before a year's first
    rate are then joined with each year's last one, so a currency isn't one task.
    """
    slot = lambda d: F.year(d)
    both = asked.select("id", "ccy", "date", F.lit(1).alias("side"), F.lit(None).cast("double").alias("r")).unionByName(rates.select(F.lit(None).cast("long").alias("id"), "ccy", "date", F.lit(0).alias("side"), F.col("rate").alias("r")))
    w = Window.partitionBy("ccy", "year").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("year", slot("date")).withColumn("rate", F.last("r", ignorenulls=True).over(w)).withColumn("rate_date", F.last(F.when(F.col("r").isNotNull(), F.col("date")), ignorenulls=True).over(w)).where("side = 1")
    ends = rates.groupBy("ccy", slot("date").alias("year")).agg(F.max("date").alias("d"), F.max_by("rate", "date").alias("v"))
    years = near.select("ccy", "year").distinct().join(ends.withColumnRenamed("year", "y"), "ccy").where("y < year").groupBy("ccy", "year").agg(F.max_by("v", "d").alias("v"), F.max("d").alias("d"))
    out = near.join(years, ["ccy", "year"], "left")
    return out.select("id", "ccy", "date", F.coalesce("rate", "v").alias("rate"), F.coalesce("rate_date", "d").alias("rate_date"))


def cross_rate(asked: DataFrame, rates: DataFrame, home: str = "CNY") -> DataFrame:
    """CMP2: asked (id, src, dst, date): rate src -> dst by way of home, with the earlier of the two dates; both null if
    either rate is missing. A currency in itself is 1 at the date asked for."""
    a = as_of(asked.select("id", F.col("src").alias("ccy"), "date"), rates).select("id", F.col("rate").alias("ra"), F.col("rate_date").alias("da"))
    b = as_of(asked.select("id", F.col("dst").alias("ccy"), "date"), rates).select("id", F.col("rate").alias("rb"), F.col("rate_date").alias("db"))
    both = asked.join(a, "id").join(b, "id")
    one = lambda c, r: F.when(F.col(c) == home, F.lit(1.0)).otherwise(F.col(r))
    rate = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(one("src", "ra") / one("dst", "rb"))
    when = F.when(F.col("src") == F.col("dst"), F.col("date")).when(rate.isNotNull(), F.least("da", "db"))
    return both.select("id", rate.alias("rate"), when.alias("rate_date"))


def matrix(cells: DataFrame, fields: list[str]) -> DataFrame:
    """CMP3 and CMP4: first value (by seq) of each field per document, one column a field."""
    at = lambda f: F.when(F.col("field") == f, F.col("seq"))
    return cells.groupBy("doc_id").agg(*[F.when(F.min(at(f)).isNotNull(), F.min_by("value", at(f))).alias(f) for f in fields])


def year_on_year(now: DataFrame, before: DataFrame) -> DataFrame:
    """INS3: (doc_id, pct, note) of rows (doc_id, value, status) and (doc_id, prior): notes missing, prior_not_positive, current_flagged."""
    both = now.join(before, "doc_id", "left")
    note = F.when(F.col("status") == "BAD", "current_flagged").when(F.col("prior").isNull(), "missing").when(F.col("prior") <= 0, "prior_not_positive")
    out = both.withColumn("note", note)
    return out.select("doc_id", F.when(F.col("note").isNull(), F.col("value") / F.col("prior") - 1).alias("pct"), "note")


def converted(cells: DataFrame, listing: DataFrame, rates: DataFrame) -> DataFrame:
    """CMP4: cells (doc_id, seq, field, value, currency) with the listing currency, rate, rate_date, value_listing, and
    missing_rate where a value can't be converted. listing: doc_id, listing_currency, period_end; rates as in ``as_of``.
    Rates are looked up once for each pair of currencies and day."""
    own = cells.join(listing, "doc_id")
    asked = own.where("currency IS NOT NULL").select(F.col("currency").alias("src"), F.col("listing_currency").alias("dst"), F.col("period_end").alias("date")).distinct().withColumn("id", F.monotonically_increasing_id())
    asked = materialise(asked, "rates-asked")
    found = asked.join(cross_rate(asked, rates), "id").drop("id")
    out = own.join(found.select(F.col("src").alias("currency"), F.col("dst").alias("listing_currency"), F.col("date").alias("period_end"), "rate", "rate_date"), ["currency", "listing_currency", "period_end"], "left")
    return out.withColumn("value_listing", F.col("value") * F.col("rate")).withColumn("missing_rate", F.col("value").isNotNull() & F.col("rate").isNull())
