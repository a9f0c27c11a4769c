"""Queries of statement facts, exports, cards, narration, reasons, run summaries, governance and settled calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import compare as cmp
from ..operators import evaluate as ev
from ..operators import ledger as led
from ..operators import report as rep
from ..sources import sinks
from ..sources.store import new_path
from .registry import query
from .views import load, view

view("statement_docs", "SELECT doc_id, market, template, period, CASE q WHEN 1 THEN 'Q' WHEN 2 THEN 'H' WHEN 3 THEN 'YTD' ELSE 'FY' END AS cumulative_type, nk, y, q, rev, n, rev_cum FROM filings")
view("statements", "SELECT doc_id, CASE WHEN nk % 6 <> 5 THEN CAST(rev_cum AS DOUBLE) END AS income, CAST(rev AS DOUBLE) / 10 AS parent, CAST(rev AS DOUBLE) / 100 AS eps, CASE WHEN q <> 2 THEN CAST(n AS DOUBLE) END AS cash, CAST(rev AS DOUBLE) / 2 AS cost, CAST(n AS DOUBLE) * 2 AS interest FROM statement_docs")
view("o_statement_facts", """SELECT s.doc_id, field, cumulative_type AS period_type, value, source_field FROM statement_docs d JOIN statements s ON s.doc_id = d.doc_id, LATERAL (VALUES ('revenue', income, 'OPERATE_INCOME'), ('net_income_parent', parent, 'PARENT_NETPROFIT'), ('eps_basic', eps, 'BASIC_EPS'), ('operating_cash_flow', cash, 'NETCASH_OPERATE'),
  ('cost_of_revenue', CASE WHEN template = 'general' AND income IS NOT NULL THEN cost END, 'OPERATE_COST'), ('gross_profit', CASE WHEN template = 'general' THEN income - cost END, 'OPERATE_INCOME-OPERATE_COST'), ('net_interest_income', CASE WHEN template = 'bank' THEN interest END, 'INTEREST_NI')) t(field, value, source_field) WHERE value IS NOT NULL""")
view("o_quarter_facts", """SELECT doc_id, field, 'Q' AS period_type, value, 'quarterly ' || source_field AS source_field FROM statement_docs, LATERAL (VALUES ('revenue', rev::DOUBLE, 'OPERATE_INCOME'), ('net_income_parent', CASE WHEN n % 3 <> 0 THEN n::DOUBLE END, 'PARENT_NETPROFIT')) t(field, value, source_field)
  WHERE q IN (3, 4) AND value IS NOT NULL""")


def _statement(spark, sf):
    names = {"income": "OPERATE_INCOME", "parent": "PARENT_NETPROFIT", "eps": "BASIC_EPS", "cash": "NETCASH_OPERATE", "cost": "OPERATE_COST", "interest": "INTEREST_NI"}
    return cat.statement_facts(load(spark, sf, "statements").withColumnsRenamed(names), load(spark, sf, "statement_docs"))


def _quarter(spark, sf):
    d = load(spark, sf, "statement_docs")
    return cat.quarter_facts(d.select("doc_id", F.col("rev").cast("double").alias("OPERATE_INCOME"), F.when(F.col("n") % 3 != 0, F.col("n").cast("double")).alias("PARENT_NETPROFIT")), d)


@query("ref4_statement_facts", "SELECT * FROM o_statement_facts")
def ref4(spark, sf):
    return _statement(spark, sf)


@query("ref5_quarter_facts", "SELECT * FROM o_quarter_facts")
def ref5(spark, sf):
    return _quarter(spark, sf)


@query("ref10_market_dispatch", """WITH f AS (SELECT d.doc_id, f.field, f.period_type, f.value FROM statement_docs d JOIN facts f ON f.doc_id = d.doc_id WHERE market = 'us' AND d.nk % 5 <> 0 UNION ALL SELECT d.doc_id, field, period_type, value FROM statement_docs d JOIN (SELECT * FROM o_statement_facts UNION ALL SELECT * FROM o_quarter_facts) s ON s.doc_id = d.doc_id WHERE market = 'a')
  SELECT d.doc_id, count(f.doc_id)::BIGINT AS n, round(coalesce(sum(value), 0), 2) AS total, CASE WHEN count(f.doc_id) = 0 THEN CASE WHEN market = 'hk' THEN 'unknown market' ELSE 'no facts' END END AS error FROM statement_docs d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id, market""")
def ref10_dispatch(spark, sf):
    d = load(spark, sf, "statement_docs")
    us = load(spark, sf, "facts").join(d.where("nk % 5 <> 0").select("doc_id"), "doc_id", "left_semi")
    facts, errors = cat.market_facts(d, {"us": us, "a": _statement(spark, sf).unionByName(_quarter(spark, sf))})
    n = facts.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return d.select("doc_id").join(n, "doc_id", "left").join(errors, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), "error")


@query("smp3_holdout", """SELECT w.request, p.previous, CASE WHEN p.previous IS NULL THEN 'no previous period' WHEN coalesce(g.pages, 0) <= 0 THEN 'no pages' END AS error FROM wanted w
  LEFT JOIN (SELECT request, arg_min(candidate, priority) AS previous FROM wanted w JOIN (VALUES (0, 0, 1995), (0, 1, 1996), (1, 0, 1997), (1, 1, 1996), (2, 0, 1998), (2, 1, 1999)) c(part, priority, candidate) ON c.part = w.part JOIN (SELECT DISTINCT entity, fy FROM listing) l ON l.entity = w.entity AND l.fy = candidate GROUP BY request) p ON p.request = w.request
  LEFT JOIN (SELECT entity, fy, count_if(accn % 3 = 0) AS pages FROM listing GROUP BY ALL) g ON g.entity = w.entity AND g.fy = p.previous""")
def smp3(spark, sf):
    c = spark.createDataFrame([(0, 0, 1995), (0, 1, 1996), (1, 0, 1997), (1, 1, 1996), (2, 0, 1998), (2, 1, 1999)], "part long, priority int, candidate int")
    listing = load(spark, sf, "listing")
    pages = listing.groupBy("entity", F.col("fy").alias("period")).agg(F.count_if(F.col("accn") % 3 == 0).alias("pages"))
    usable, lost = cat.holdout(load(spark, sf, "wanted").select("request", "entity", "part"), c, listing.select("entity", F.col("fy").alias("period")).distinct(), pages)
    previous = cat.previous(load(spark, sf, "wanted").select("request", "entity", "part"), c, listing.select("entity", F.col("fy").alias("period")).distinct())
    both = usable.select("request", F.lit(None).cast("string").alias("error")).unionByName(lost.select("request", "error"))
    return both.join(previous, "request", "left").select("request", "previous", "error")


view("cells", "SELECT doc_id, market, CAST(fno AS INT) AS seq, field, period_end, CAST(v AS DOUBLE) AS value, CAST(v AS STRING) AS raw_value, 'thousands' AS unit, CASE v % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'HKD' WHEN 2 THEN 'CNY' ELSE 'GBP' END AS currency, CASE market WHEN 'us' THEN 'USD' WHEN 'a' THEN 'CNY' ELSE 'HKD' END AS listing_currency, 'OK' AS status FROM figures")
#: The events' month moved to the filings' years, so that some days have a rate and others don't.
view("old_rates", "SELECT ccy, add_months(date, -12 * 27) AS date, rate FROM rates")
view("o_old_rates", "SELECT ccy, (date - INTERVAL 324 MONTH)::DATE AS date, rate FROM rates")
view("o_converted", """SELECT c.*, CASE WHEN currency = listing_currency THEN 1.0 ELSE (CASE WHEN currency = 'CNY' THEN 1.0 ELSE r.rate END) / (CASE WHEN listing_currency = 'CNY' THEN 1.0 ELSE s.rate END) END AS rate, CASE WHEN currency = listing_currency THEN period_end WHEN (currency = 'CNY' OR r.rate IS NOT NULL) AND (listing_currency = 'CNY' OR s.rate IS NOT NULL) THEN coalesce(least(r.date, s.date), r.date, s.date) END AS rate_date
  FROM cells c ASOF LEFT JOIN o_old_rates r ON c.currency = r.ccy AND c.period_end >= r.date ASOF LEFT JOIN o_old_rates s ON c.listing_currency = s.ccy AND c.period_end >= s.date""")


def _converted(spark, sf):
    c = load(spark, sf, "cells")
    listing = c.select("doc_id", "listing_currency", "period_end").distinct()
    return cmp.converted(c.drop("listing_currency", "period_end"), listing, load(spark, sf, "old_rates"))


@query("cmp4_converted_matrix", """SELECT doc_id, round(arg_min_null(value * rate, seq) FILTER (field = 'revenue'), 6) AS revenue, round(arg_min_null(value * rate, seq) FILTER (field = 'net_income_parent'), 6) AS net_income_parent, count_if(rate IS NULL)::BIGINT AS missing FROM o_converted GROUP BY doc_id""")
def cmp4_converted(spark, sf):
    own = _converted(spark, sf)
    m = cmp.matrix(own.select("doc_id", "seq", "field", F.col("value_listing").alias("value")), ["revenue", "net_income_parent"])
    missing = own.groupBy("doc_id").agg(F.count_if("missing_rate").alias("missing"))
    return m.join(missing, "doc_id").select("doc_id", F.round("revenue", 6).alias("revenue"), F.round("net_income_parent", 6).alias("net_income_parent"), "missing")


@query("snk3_compare_csv", """SELECT doc_id AS code, field, raw_value, currency, listing_currency, round(rate, 9) AS fx_rate, strftime(rate_date, '%Y-%m-%d') AS fx_date, CASE WHEN currency = listing_currency THEN 'none' WHEN rate IS NOT NULL THEN 'central "parity", daily' END AS fx_type, round(value * rate, 6) AS value_listing FROM o_converted""")
def snk3(spark, sf):
    path = new_path(spark, "compare")
    own = _converted(spark, sf).withColumn("company", F.lit("a, b")).withColumn("code", F.col("doc_id"))
    rows = sinks.compare_rows(own, 'central "parity", daily', "central bank")
    sinks.write_csv(rows, path)
    back = sinks.read_csv(spark, path, rows.schema)
    return back.select("code", "field", "raw_value", "currency", "listing_currency", F.round(F.col("fx_rate").cast("double"), 9).alias("fx_rate"), "fx_date", "fx_type", F.round(F.col("value_listing").cast("double"), 6).alias("value_listing"))


view("told", """SELECT s.doc_id, s.seq, s.field, s.period_type, s.aux, s.status, CASE WHEN f.v % 5 <> 0 THEN CAST(f.v AS STRING) END AS raw, CAST(f.v AS DOUBLE) AS value, 'Name ' || s.field AS name_en, '名 ' || s.field AS name_zh, 'USD thousands' AS unit_en, '千美元' AS unit_zh, 2 AS page, CASE WHEN f.v % 4 = 0 THEN CAST(f.v - 1 AS STRING) END AS prev_raw, 9 AS prev_page, CASE WHEN f.v % 6 = 0 THEN CAST(f.v % 9 - 4 AS DOUBLE) / 100 END AS pct, f.market, f.q
  FROM shown s JOIN figures f ON f.doc_id = s.doc_id AND f.fno = s.seq""")
view("told_ratios", "SELECT doc_id, 'gross_margin' AS key, 'Q' AS period_type, CAST(q AS DOUBLE) / 8 AS now, CASE WHEN nk % 2 = 0 THEN CAST(q AS DOUBLE) / 8 - 0.25 END AS prev, CASE WHEN nk % 2 = 0 THEN CAST(25 AS DOUBLE) END AS change_pp FROM filings WHERE nk % 3 = 0")


@query("ins6_cards", """WITH d AS (SELECT doc_id, CASE q WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' WHEN 3 THEN 'Q3' ELSE 'FY' END AS part, CASE q WHEN 1 THEN 'Q' WHEN 2 THEN 'H' WHEN 3 THEN 'YTD' ELSE 'FY' END AS cum FROM filings), c AS (SELECT doc_id, CASE WHEN part IN ('Q1', 'Q3') AND EXISTS (SELECT 1 FROM told t WHERE t.doc_id = d.doc_id AND NOT aux AND t.period_type = 'Q') THEN 'Q' ELSE cum END AS pt FROM d)
  SELECT c.doc_id, CASE field WHEN 'revenue' THEN 1 WHEN 'net_income_parent' THEN 2 ELSE 4 END AS place, field AS key, pt AS period_type, arg_min_null(raw, seq) AS raw, NULL::DOUBLE AS value FROM c JOIN told t ON t.doc_id = c.doc_id AND t.period_type = pt WHERE NOT aux AND field IN ('revenue', 'net_income_parent', 'eps_basic') GROUP BY ALL
  UNION ALL SELECT c.doc_id, 3, key, pt, NULL, now FROM c JOIN told_ratios r ON r.doc_id = c.doc_id AND r.period_type = pt""")
def ins6(spark, sf):
    part = F.element_at(F.array(*map(F.lit, ["Q1", "H1", "Q3", "FY"])), F.col("q").cast("int"))
    cum = F.element_at(F.array(*map(F.lit, ["Q", "H", "YTD", "FY"])), F.col("q").cast("int"))
    return rep.cards(load(spark, sf, "told"), load(spark, sf, "told_ratios"), load(spark, sf, "filings").select("doc_id", part.alias("part"), cum.alias("cumulative_type")))


def _facts_sql(lang: str) -> str:
    name, unit = f"name_{lang}", f"unit_{lang}"
    flat, up, down, pp = ("'flat'", "'up '", "'down '", "' percentage points'") if lang == "en" else ("'持平'", "'增长 '", "'下降 '", "' 个百分点'")
    up_pp = up if lang == "en" else "'增加 '"
    periods = "CASE period_type WHEN 'Q' THEN 'quarter' WHEN 'H' THEN 'six months' WHEN 'YTD' THEN 'nine months' WHEN 'FY' THEN 'full year' END" if lang == "en" else "CASE period_type WHEN 'Q' THEN '单季' WHEN 'H' THEN '上半年累计' WHEN 'YTD' THEN '前三季度累计' WHEN 'FY' THEN '全年' END"
    return f"""SELECT doc_id, {name} AS metric, {periods} AS period, coalesce(raw, format('{{:,.1f}}', value)) || ' ' || {unit} AS value, prev_raw || ' ' || {unit} AS prior_value, CASE WHEN pct = 0 THEN {flat} WHEN pct > 0 THEN {up} || format('{{:.1f}}%', abs(pct * 100)) ELSE {down} || format('{{:.1f}}%', abs(pct * 100)) END AS change,
  CASE WHEN prev_raw IS NULL THEN '2' ELSE '2,9' END AS pages, false AS computed FROM told WHERE NOT aux AND status <> 'BAD' UNION ALL SELECT doc_id, {"'Gross margin'" if lang == 'en' else "'毛利率'"}, {periods}, format('{{:.1f}}%', now * 100), format('{{:.1f}}%', prev * 100), CASE WHEN prev IS NOT NULL THEN {up_pp} || '25.0' || {pp} END, '3', true FROM told_ratios"""


def _told(spark, sf, lang):
    ratios = load(spark, sf, "told_ratios").withColumn("pages", F.array(F.lit(3)))
    return rep.narration_facts(load(spark, sf, "told"), ratios, lang).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("ins7_narration_facts", _facts_sql("en"))
def ins7(spark, sf):
    return _told(spark, sf, "en")


@query("ins7_narration_facts_zh", _facts_sql("zh"))
def ins7_zh(spark, sf):
    return _told(spark, sf, "zh")


view("excused", "SELECT doc_id, fno, market, CAST(v AS STRING) AS raw_value, CASE v % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FOUND' ELSE 'BAD' END AS status, CASE v % 9 WHEN 0 THEN 'FABRICATED' WHEN 1 THEN 'WRONG_PAGE' WHEN 2 THEN 'PARAPHRASED' WHEN 3 THEN 'UNIT' WHEN 4 THEN 'PARSE_ARTEFACT' WHEN 5 THEN 'MISSING' WHEN 6 THEN 'NO_SOURCE' WHEN 7 THEN 'PERIOD' END AS category, CASE WHEN v % 11 = 0 THEN 'S3' END AS rule, CASE WHEN v % 4 = 0 THEN 'mismatch' END AS state, CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) * 2 AS ref_value FROM figures")


@query("ins12_reasons", """SELECT doc_id, fno, CASE status WHEN 'OK' THEN '' WHEN 'FOUND' THEN CASE WHEN market = 'hk' THEN 'HK has no reliable structured data: source and unit checked, no external figure to compare.' ELSE 'Source and unit checked; no structured figure available to compare.' END
  ELSE CASE WHEN rule IS NOT NULL THEN 'Fails a consistency check: ' || rule WHEN state IS NOT NULL AND coalesce(category, '') IN ('', 'UNIT', 'PERIOD') THEN 'Differs from reference: filing ' || format('{:,.2f}', value) || ' vs reference ' || format('{:,.2f}', ref_value) || CASE WHEN category = 'PERIOD' THEN ' (matches another period)' ELSE '' END || '.'
  ELSE CASE category WHEN 'FABRICATED' THEN 'The number ' || raw_value || ' does not appear anywhere in the filing.' WHEN 'WRONG_PAGE' THEN 'The number is in the filing, but not on the page given.' WHEN 'PARAPHRASED' THEN 'The number is on the page, but the quote is not verbatim.' WHEN 'UNIT' THEN 'The unit or currency could not be parsed.'
    WHEN 'PARSE_ARTEFACT' THEN 'The number is split across lines in the PDF text.' WHEN 'MISSING' THEN 'Expected for this period, but not extracted (asked once more).' WHEN 'NO_SOURCE' THEN 'No page or quote was given, so the source cannot be checked.' ELSE 'Failed a check.' END END END AS reason_en, length(reason_en) > 0 AS told FROM excused""")
def ins12(spark, sf):
    return rep.with_reasons(load(spark, sf, "excused")).select("doc_id", "fno", "reason_en", (F.length("reason_zh") > 0).alias("told"))


view("ruled", """SELECT doc_id, fno, market, 'BAD' AS status, CAST(v AS STRING) AS raw_value, CASE WHEN v % 4 = 0 THEN 'PERIOD' WHEN v % 4 = 1 THEN 'UNIT' END AS category, CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) * CASE WHEN v % 5 = 0 THEN -1 ELSE 100 END AS ref_value, 'mismatch' AS state, CASE v % 5 WHEN 0 THEN 'SIGN' WHEN 1 THEN 'POWER' END AS how,
  CASE WHEN v % 3 = 0 THEN CASE fno WHEN 1 THEN '毛利 ' WHEN 2 THEN '拨备前利润 ' WHEN 3 THEN '推导值 ' WHEN 4 THEN 'EPS × 加权股数 ' WHEN 5 THEN '单季 ' ELSE 'S' END || CAST(v AS STRING) END AS rule FROM figures""")


@query("ins12_rule_reasons", """SELECT doc_id, fno, CASE WHEN rule IS NOT NULL THEN '合理性检查：' || rule ELSE '与 reference 不一致：原文 ' || format('{:,.2f}', value) || '，reference ' || format('{:,.2f}', ref_value) || CASE WHEN how = 'SIGN' THEN '（符号相反）' WHEN how = 'POWER' THEN '（差 10 的整数次幂倍）' WHEN category = 'PERIOD' THEN '（等于另一期间的值）' ELSE '' END || '。' END AS reason_zh,
  CASE WHEN rule LIKE '%毛利%' THEN 'Gross profit is larger than revenue, or the cost used is negative.' WHEN rule LIKE '%拨备前利润%' THEN 'Pre-provision profit is larger than revenue.' WHEN rule LIKE '%推导值%' THEN 'Derived value differs from the total disclosed in the filing.' WHEN rule LIKE '%EPS%' THEN 'EPS × weighted shares is far from net income (order of magnitude).'
    WHEN rule LIKE '%单季%' THEN 'Quarter + previous cumulative does not add up to the cumulative figure.' WHEN rule IS NOT NULL THEN 'Fails a consistency check: ' || rule
    ELSE 'Differs from reference: filing ' || format('{:,.2f}', value) || ' vs reference ' || format('{:,.2f}', ref_value) || CASE WHEN how = 'SIGN' THEN ' (opposite sign)' WHEN how = 'POWER' THEN ' (off by a power of ten)' WHEN category = 'PERIOD' THEN ' (matches another period)' ELSE '' END || '.' END AS reason_en FROM ruled""")
def ins12_rules(spark, sf):
    return rep.with_reasons(load(spark, sf, "ruled")).select("doc_id", "fno", "reason_zh", "reason_en")


@query("snk2_item_columns", """SELECT doc_id AS quote, status, field, raw AS raw_value, name_en AS metric_en, CASE WHEN pct IS NOT NULL THEN format('{:.2f}', pct * 100) END AS yoy_pct_code FROM told""")
def snk2_columns(spark, sf):
    path = new_path(spark, "items")
    t = load(spark, sf, "told").withColumnsRenamed({"raw": "raw_value", "name_en": "metric_en", "name_zh": "metric_zh", "unit_en": "unit", "aux": "auxiliary", "prev_raw": "prior_year_raw", "prev_page": "prior_year_page"}).withColumn("quote", F.col("doc_id"))
    rows = sinks.item_rows(t)
    assert len(rows.columns) == 19
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path, rows.schema).select("quote", "status", "field", "raw_value", "metric_en", "yoy_pct_code")


@query("eva14_unanswered", "SELECT DISTINCT doc_id, field, period_type FROM figures f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.doc_id = f.doc_id AND g.field = f.field AND g.period_type = f.period_type)")
def eva14(spark, sf):
    return ev.unanswered(load(spark, sf, "figures"), load(spark, sf, "facts"))


@query("eva22_errors", "SELECT doc_id AS report, 'pipeline' AS cell, field, period_type AS ptype, ref AS truth, v AS pred, coalesce(nullif(concat_ws(' ', status, category), ''), '-') AS state FROM (SELECT s.doc_id, s.field, s.period_type, f.v::DOUBLE AS v, f.v * 2.0 AS ref, CASE WHEN s.status <> 'OK' THEN s.status END AS status, CASE WHEN f.v % 2 = 0 THEN 'UNIT' END AS category, f.v % 5 = 0 AS strict FROM shown s JOIN figures f ON f.doc_id = s.doc_id AND f.fno = s.seq) WHERE NOT strict")
def eva22(spark, sf):
    t = load(spark, sf, "told")
    rows = t.select(F.col("doc_id").alias("report"), F.lit("pipeline").alias("cell"), "field", F.col("period_type").alias("ptype"), (F.col("value") * 2).alias("truth"), F.col("value").alias("pred"), F.when(F.col("status") != "OK", F.col("status")).alias("status"), F.when(F.col("value") % 2 == 0, "UNIT").alias("category"), (F.col("value") % 5 == 0).alias("strict"))
    return ev.errors(rows)


view("run_calls", "SELECT doc_id, CAST(n AS BIGINT) * 100 AS input, CAST(n AS BIGINT) * 10 AS cached, CASE WHEN nk % 5 <> 0 THEN CAST(q AS BIGINT) END AS output, CAST(rev AS DOUBLE) / 1000 AS usd FROM filings WHERE q <> 3")


@query("eva28_run_totals", """SELECT doc_id, sum(ok)::BIGINT AS ok, sum(found)::BIGINT AS found, sum(bad)::BIGINT AS bad, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(output)::BIGINT AS output, round(sum(usd), 6) AS usd FROM (SELECT doc_id, (status = 'OK')::INT AS ok, (status = 'FOUND')::INT AS found, (status = 'BAD')::INT AS bad, 0 AS input, 0 AS cached, 0 AS output, 0.0::DOUBLE AS usd FROM shown
  UNION ALL SELECT doc_id, 0, 0, 0, input, cached, coalesce(output, 0), usd FROM run_calls) GROUP BY ROLLUP (doc_id)""")
def eva28(spark, sf):
    return ev.run_summary(load(spark, sf, "shown"), load(spark, sf, "run_calls")).withColumn("usd", F.round("usd", 6))


@query("eva29_market_coverage", """WITH d AS (SELECT market, template, CASE nk % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' END AS currency, CASE WHEN nk % 5 <> 0 THEN q - 2 END AS income FROM filings), g AS (SELECT market, unnest([['template', template], ['currency', coalesce(currency, 'unknown')], ['result', CASE WHEN income < 0 THEN 'loss' WHEN income IS NOT NULL THEN 'profit' ELSE 'unknown' END]]) AS g FROM d)
  SELECT market, g[1] AS dimension, g[2] AS part, count(*)::BIGINT AS n FROM g GROUP BY ALL""")
def eva29(spark, sf):
    d = load(spark, sf, "filings").select("market", "template", F.when(F.col("nk") % 4 == 0, "USD").when(F.col("nk") % 4 == 1, "CNY").alias("currency"), F.when(F.col("nk") % 5 != 0, F.col("q") - 2).alias("net_income"))
    return ev.coverage(d)


@query("gov2_revision_log", "SELECT '2024-01-01' AS at, 'first' AS reason, 1::BIGINT AS n, 'a' AS first UNION ALL SELECT '2024-02-01', 'second', count(*)::BIGINT, min(code) FROM (SELECT DISTINCT lpad(doc_id::VARCHAR, 12, '0') AS code FROM documents WHERE doc_id % 5 = 0) HAVING count(*) > 0")
def gov2(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "doc_id", "text")
    frozen = d.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    now = d.select("path", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")), 256).alias("sha256"))
    log = spark.createDataFrame([("2024-01-01", "first", ["a"])], "at string, reason string, changed array<string>")
    log = ev.revised(log, ev.manifest_diff(frozen, now), "second", "2024-02-01")
    log = ev.revised(log, ev.manifest_diff(frozen, frozen), "nothing", "2024-03-01")
    return log.select("at", "reason", F.size("changed").cast("long").alias("n"), F.col("changed")[0].alias("first"))


view("call_events", "SELECT CAST(user_id % 50 AS BIGINT) AS ledger, CAST(event_id AS BIGINT) - CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS id, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 3 = 1 THEN 'settle' ELSE 'reserve' END AS kind, CASE WHEN event_id % 3 <> 1 OR event_id % 5 <> 0 THEN CAST(event_id % 97 AS DOUBLE) END AS usd FROM events")


@query("bud6_settled_calls", """SELECT ledger, id, coalesce(actual, worst) AS usd, actual IS NULL AS estimated FROM (SELECT ledger, id, arg_max(usd, seq) FILTER (kind = 'reserve') AS worst, arg_max(usd, seq) FILTER (kind = 'settle') AS actual, count_if(kind = 'settle') AS ends FROM call_events GROUP BY ledger, id) WHERE ends > 0""")
def bud6(spark, sf):
    return led.settled(load(spark, sf, "call_events"))


@query("bud7_extraction_usage", "SELECT doc_id, count(*)::BIGINT AS calls, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(coalesce(output, 0))::BIGINT AS output FROM run_calls GROUP BY doc_id")
def bud7(spark, sf):
    return led.usage(load(spark, sf, "run_calls"), "doc_id")
