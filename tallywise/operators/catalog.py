"""Filing resolution and reference facts (RES, REF, SRC5-SRC7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.store import materialise, new_path

#: Folders of older listing pages; a bound of what ``older_matches`` broadcasts.
SHARDS = 256

# Candidate tags of structured facts in order.
TAGS = {
    ("general", "revenue"): ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    ("general", "gross_profit"): ["GrossProfit"],
    ("bank", "revenue"): ["RevenuesNetOfInterestExpense", "Revenues"],
    ("bank", "net_interest_income"): ["InterestIncomeExpenseNet"],
    ("insurance", "revenue"): ["Revenues"],
    ("", "net_income_parent"): ["NetIncomeLoss"],
    ("", "eps_basic"): ["EarningsPerShareBasic"],
    ("", "operating_cash_flow"): ["NetCashProvidedByUsedInOperatingActivities"],
    ("", "net_income_common"): ["NetIncomeLossAvailableToCommonStockholdersBasic"],
}


def entity_id(tickers: DataFrame, entities: DataFrame) -> DataFrame:
    """RES1: tickers (ticker) with entity_id, ten digits, whatever the case; null if unknown."""
    known = entities.select(F.upper("ticker").alias("__t"), F.lpad(F.col("entity").cast("string"), 10, "0").alias("entity_id"))
    return tickers.join(known, F.upper(tickers["ticker"]) == known["__t"], "left").drop("__t")


def first_meta(facts: DataFrame, forms: list[str]) -> DataFrame:
    """RES2: (accn, fy, fp, form) first seen per accession among the forms, all from one fact: ``ord`` differs within an
    accession, or it's left open which of equals is taken."""
    first = F.min_by(F.struct("fy", "fp", "form"), "ord").alias("first")
    return facts.where(F.col("form").isin(forms)).groupBy("accn").agg(first).select("accn", "first.*")


def by_period(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """RES3: requests (request, entity, fy, fp) with the earliest filed match (the original, not an amendment)."""
    both = requests.join(listing, ["entity", "fy", "fp"])
    return both.groupBy("request").agg(F.min_by("accn", F.struct("filed", "accn")).alias("accn"))


def by_date(requests: DataFrame, listing: DataFrame, days: int = 10) -> DataFrame:
    """RES4: for requests (…, period_end, annual): report date within so many days, annual form exactly for annual requests."""
    both = requests.join(listing, "entity").where((F.abs(F.datediff("report_date", "period_end")) <= days) & (F.col("annual") == F.col("annual_form")))
    return both.groupBy("request").agg(F.min_by("accn", F.struct("filed", "accn")).alias("accn"))


def first_source(requests: DataFrame, *found: DataFrame) -> DataFrame:
    """RES3-RES5: the first of several resolutions (request, accn) that has each request, and which (source, from 0)."""
    out = None
    for k, f in enumerate(found):
        rows = f.select("request", "accn", F.lit(k).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    best = out.groupBy("request").agg(F.min_by("accn", "source").alias("accn"), F.min("source").alias("source"))
    return requests.select("request").join(best, "request", "left")


def _shard(entity: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(entity.cast("string"), F.lit(""))), F.lit(SHARDS)).cast("int")


def older_store(listing: DataFrame, path: str | None = None) -> DataFrame:
    """RES5: older listing pages (entity, page, fy, fp, filed, accn, …; page counts from 0, the newest) in one folder for
    each shard of entities, read back. A frequent entity's filings go to several files."""
    spark = listing.sparkSession
    path = path or new_path(spark, "older-listings")
    listing.withColumn("shard", _shard(F.col("entity"))).repartitionByRange("shard", "entity", "filed").write.partitionBy("shard").parquet(path)
    return spark.read.schema(StructType([*listing.schema.fields, StructField("shard", IntegerType())])).parquet(path)


def older_matches(requests: DataFrame, older: DataFrame) -> DataFrame:
    """RES5: (request, accn) of requests (request, entity, fy, fp) in stored older pages: the newest page with a match,
    and in it the earliest filing.

    Only the folders of the requests' shards are read: the shards asked for, at most SHARDS numbers, are broadcast and
    prune the scan at run time. Each period of an entity is one row before it is joined, however many filings it has.
    """
    own = requests.select("request", "entity", "fy", "fp", _shard(F.col("entity")).alias("shard"))
    asked = own.where((F.col("shard") >= 0) & F.col("entity").isNotNull()).select("shard").distinct()
    there = older.join(F.broadcast(asked), "shard", "left_semi")
    best = there.groupBy("entity", "fy", "fp").agg(F.min_by("accn", F.struct("page", "filed", "accn")).alias("accn"))
    return own.join(best, ["entity", "fy", "fp"]).select("request", "accn")


def resolved(requests: DataFrame, recent: DataFrame, older: DataFrame, days: int = 10) -> DataFrame:
    """RES3-RES5: every request with (accn, source): 0 by period in the recent listing, 1 by period in the older pages,
    2 by report date in the recent listing; null if none. Each way is only asked for what those before it left open.

    requests: request (unique), entity, fy, fp, period_end, annual; recent: entity, fy, fp, filed, accn, report_date,
    annual_form; older: from ``older_store``.
    """
    first = materialise(by_period(requests, recent), "recent-matches")
    open_ = materialise(requests.join(first, "request", "left_anti"), "open-requests")
    second = materialise(older_matches(open_, older), "older-matches")
    third = by_date(open_.join(second, "request", "left_anti"), recent.drop("fy", "fp"), days)
    return first_source(requests, first, second, third)


def by_title(requests: DataFrame, announcements: DataFrame, skip: str = r"(?i)摘要|英文|取消|abstract|english|cancelled") -> DataFrame:
    """RES6: the newest announcement whose title has the year as a whole number and isn't an abstract or the like."""
    both = requests.join(announcements, "entity").where(~F.col("title").rlike(skip))
    year = F.array_contains(F.regexp_extract_all("title", F.lit(r"(?<!\d)\d{4}(?!\d)"), F.lit(0)), F.col("year").cast("string"))
    return both.where(year).groupBy("request").agg(F.max_by("accn", F.struct("filed", "accn")).alias("accn"))


def in_window(requests: DataFrame, results: DataFrame, reports: DataFrame) -> DataFrame:
    """RES7: results announcements within 150 days after the period's end, else reports within 200; (request, accn, filed, part)."""
    near = lambda t, d: requests.join(t, "entity").where((F.col("filed") > F.col("period_end")) & (F.datediff("filed", "period_end") <= d)).select("request", "accn", "filed", "part")
    first = near(results, 150)
    return first.unionByName(near(reports, 200).join(first.select("request").distinct(), "request", "left_anti"))


def first_day_parts(candidates: DataFrame) -> DataFrame:
    """RES8: documents of each request's first publication day, as parts in order; (request, accn, part_no)."""
    day = candidates.groupBy("request").agg(F.min("filed").alias("day"))
    own = candidates.join(day, "request").where("filed = day")
    return own.select("request", "accn", F.row_number().over(Window.partitionBy("request").orderBy("part", "accn")).alias("part_no"))


def previous(requests: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """RES9: per request (request, entity, part) the first of the part's candidate periods (priority, candidate) that the catalog has."""
    both = requests.join(candidates, "part").join(catalog.withColumnRenamed("period", "candidate"), ["entity", "candidate"])
    return both.groupBy("request").agg(F.min_by("candidate", "priority").alias("previous"))


def flat_feed(json: Column, schema: str) -> Column:
    """SRC5: parses nested facts; explode taxonomy, tag, unit and rows from it."""
    return F.from_json(json, schema)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """SRC5: (…, tag, unit, ord, fact) of a map<tag, map<unit, array<fact>>>."""
    tags = df.select("*", F.explode(column).alias("tag", "units"))
    units = tags.select("*", F.explode("units").alias("unit", "rows"))
    return units.select("*", F.posexplode("rows").alias("ord", "fact")).drop(column, "units", "rows")


def unpivoted(wide: DataFrame, ids: list[str], mapping: dict[str, str]) -> DataFrame:
    """SRC6: mapped columns of a wide statement as rows (field, value), nulls left out."""
    long = wide.unpivot(ids, list(mapping), "source_field", "value").where("value IS NOT NULL")
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return long.withColumn("field", names[F.col("source_field")])


def last_items(*sheets: DataFrame) -> DataFrame:
    """SRC7: per (doc_id, item) the last amount over sheets (doc_id, ord, item, amount) in turn."""
    out = None
    for k, s in enumerate(sheets):
        rows = s.where("amount IS NOT NULL").select("doc_id", "item", "amount", F.struct(F.lit(k), F.col("ord")).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("doc_id", "item").agg(F.max_by("amount", "at").alias("amount"))


# Names of a long feed's items by template ("": every template), and the sheets that are read in turn.
LONG_ITEMS = {
    "general": {"revenue": "营运收入", "gross_profit": "毛利"},
    "bank": {"net_interest_income": "净利息收入"},
    "": {"net_income_parent": "股东应占溢利", "eps_basic": "每股基本盈利", "operating_cash_flow": "经营业务现金净额"},
}
SHEETS = ["利润表", "现金流量表"]


def long_facts(feed: DataFrame, docs: DataFrame) -> DataFrame:
    """REF6: facts (doc_id, field, period_type, period_end, value, currency, source_field) of a long feed, which doesn't
    say its currency: it is null.

    feed: entity, sheet, report_date, ord (place in its sheet), item, amount; docs: doc_id, entity, template, period_end,
    cumulative_type. Rows count whose date is the document's own; of an item's amounts the last of the last sheet. Items
    that no field of the document's template asks for, rows without an amount and other sheets are left out.
    """
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t, f, i) for t, fields in LONG_ITEMS.items() for f, i in fields.items()], "t string, field string, item string"))
    place = F.array_position(F.array(*map(F.lit, SHEETS)), F.col("sheet"))
    named = feed.where(F.col("sheet").isin(SHEETS) & F.col("amount").isNotNull()).join(wanted, "item").select("entity", F.col("report_date").alias("period_end"), "t", "field", "item", "amount", F.struct(place.alias("place"), "ord").alias("at"))
    # one row per entity, date and field before documents are joined
    last = named.groupBy("entity", "period_end", "t", "field").agg(F.max_by("amount", "at").alias("value"), F.first("item").alias("source_field"))
    own = last.join(docs.select("doc_id", "entity", "template", "period_end", "cumulative_type"), ["entity", "period_end"]).where("t = '' OR t = template")
    return own.select("doc_id", "field", F.col("cumulative_type").alias("period_type"), "period_end", F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("currency"), "source_field")


def tagged(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """REF1 and REF2: per document and field, all rows of the first candidate tag that has any; twelve-month rows of
    non-annual documents are left out. facts: doc_id, tag, ord, period_type, value; docs: doc_id, template, annual."""
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(t, f, k, tag) for (t, f), tags in TAGS.items() for k, tag in enumerate(tags)], "t string, field string, priority int, tag string"))
    rows = facts.join(docs.select("doc_id", "template", "annual"), "doc_id").where("annual OR period_type <> 'FY'").join(table, "tag").where("t = '' OR t = template")
    best = rows.groupBy("doc_id", "field").agg(F.min("priority").alias("priority"))
    return rows.join(best, ["doc_id", "field", "priority"]).select("doc_id", "field", "tag", "ord", "period_type", "value")


def parent_income(total: DataFrame, minority: DataFrame, primary: DataFrame) -> DataFrame:
    """REF3: total - non-controlling on equal (unit, start) for documents without a primary row; (doc_id, unit, start, value)."""
    both = total.join(minority.withColumnRenamed("value", "other"), ["doc_id", "unit", "start"])
    return both.join(primary.select("doc_id"), "doc_id", "left_anti").select("doc_id", "unit", "start", (F.col("value") - F.col("other")).alias("value"))


def exchange_symbol(code: Column) -> Column:
    """REF7."""
    return F.concat(F.when(code.rlike("^[03]"), "SZ").when(code.rlike("^[48]"), "BJ").otherwise("SH"), code)


def prior_by_start(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """REF8: per document and field the latest fact with the same start that ends before the document's own; (doc_id, field, period_end, value).

    facts: entity, field, start, period_end, value; docs: doc_id, entity, start, period_end.
    """
    both = facts.withColumnRenamed("period_end", "end").join(docs, ["entity", "start"]).where(F.col("end") < F.col("period_end"))
    return both.groupBy("doc_id", "field").agg(F.max("end").alias("period_end"), F.max_by("value", "end").alias("value"))


def prior_quarter(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """REF9: the entity's row three months back, none for documents that end in a first quarter; rows: entity, period_end, value."""
    back = docs.where(F.month("period_end") > 3).withColumn("prior_end", F.last_day(F.add_months("period_end", -3)))
    return back.join(rows.withColumnRenamed("period_end", "prior_end"), ["entity", "prior_end"]).select("doc_id", "prior_end", "value")


# Statement columns by field, those of one template only, and those of the quarterly sheet.
STATEMENT = {"OPERATE_INCOME": "revenue", "PARENT_NETPROFIT": "net_income_parent", "BASIC_EPS": "eps_basic", "NETCASH_OPERATE": "operating_cash_flow"}
OF_TEMPLATE = {"OPERATE_COST": ("general", "cost_of_revenue"), "INTEREST_NI": ("bank", "net_interest_income")}
QUARTERLY = {"OPERATE_INCOME": "revenue", "PARENT_NETPROFIT": "net_income_parent"}


def statement_facts(wide: DataFrame, docs: DataFrame) -> DataFrame:
    """REF4: facts (doc_id, field, period_type, value, source_field) of wide statements (doc_id and the columns of
    STATEMENT and OF_TEMPLATE); gross profit is revenue less cost, for the general template with both. docs: doc_id,
    template, cumulative_type."""
    own = wide.join(docs.select("doc_id", "template", "cumulative_type"), "doc_id")
    for column, (template, _) in OF_TEMPLATE.items():
        own = own.withColumn(column, F.when(F.col("template") == template, F.col(column)))
    own = own.withColumn("OPERATE_COST", F.when(F.col("OPERATE_INCOME").isNotNull(), F.col("OPERATE_COST"))).withColumn("OPERATE_INCOME-OPERATE_COST", F.col("OPERATE_INCOME") - F.col("OPERATE_COST"))
    fields = STATEMENT | {c: f for c, (_, f) in OF_TEMPLATE.items()} | {"OPERATE_INCOME-OPERATE_COST": "gross_profit"}
    return unpivoted(own.select("doc_id", "cumulative_type", *[F.col(f"`{c}`") for c in fields]), ["doc_id", "cumulative_type"], fields).select("doc_id", "field", F.col("cumulative_type").alias("period_type"), "value", "source_field")


def quarter_facts(quarterly: DataFrame, docs: DataFrame) -> DataFrame:
    """REF5: single-quarter facts of documents whose statements run over more than a quarter, half-year reports aside.
    quarterly: doc_id and the columns of QUARTERLY; docs: doc_id, period, cumulative_type."""
    asked = docs.where((F.col("cumulative_type") != "Q") & ~F.col("period").endswith("H1")).select("doc_id")
    rows = unpivoted(quarterly.join(asked, "doc_id").select("doc_id", *QUARTERLY), ["doc_id"], QUARTERLY)
    return rows.select("doc_id", "field", F.lit("Q").alias("period_type"), "value", F.concat(F.lit("quarterly "), "source_field").alias("source_field"))


def market_facts(docs: DataFrame, branches: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """REF10: one table of each document's facts from its market's branch (doc_id, field, period_type, value), and the
    documents without any, with the reason; they don't stop the others."""
    facts = None
    for market, rows in branches.items():
        own = rows.select("doc_id", "field", "period_type", "value").join(docs.where(F.col("market") == market).select("doc_id"), "doc_id", "left_semi")
        facts = own if facts is None else facts.unionByName(own)
    without = docs.join(facts.select("doc_id").distinct(), "doc_id", "left_anti")
    return facts, without.select("doc_id", F.when(F.col("market").isin(list(branches)), "no facts").otherwise("unknown market").alias("error"))


def holdout(sample: DataFrame, candidates: DataFrame, catalog: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SMP3: the previous period of every sampled entity (request, entity, part), split into usable ones (with their
    number of pages) and unavailable ones with the reason. pages: entity, period, pages."""
    found = sample.join(previous(sample, candidates, catalog), "request", "left")
    both = found.join(pages.withColumnRenamed("period", "previous"), ["entity", "previous"], "left")
    usable = both.where("previous IS NOT NULL AND pages > 0").select("request", "entity", "previous", "pages")
    lost = both.where("previous IS NULL OR coalesce(pages, 0) <= 0").select("request", "entity", F.when(F.col("previous").isNull(), "no previous period").otherwise("no pages").alias("error"))
    return usable, lost
