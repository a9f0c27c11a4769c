"""Queries of replies, insights, triggers, cost projections and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import report as rep
from ..sources import sinks
from ..sources.store import new_path
from .registry import query
from .views import load, read, view


view("all_replies", "SELECT doc_id, text FROM replies UNION ALL SELECT CAST(doc_id AS STRING), text FROM documents")


@query("fn24_reply_kinds", r"""SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '\S') THEN 'empty' WHEN regexp_matches(text, '^\s*([\[{]|```)') OR regexp_matches(text, '(?s)```(?:json|JSON)?\s*\n\s*[\[{].*?\n\s*```') THEN 'json' ELSE 'table' END AS kind FROM all_replies""")
def fn24(spark, sf):
    return read(spark, sf, "SELECT doc_id, text FROM all_replies").select("doc_id", tx.reply_kind(F.col("text")).alias("kind"))


@query("src8_reply_items", "SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR) - 1)::INT AS seq, 'line ' || l_linenumber AS field, l_partkey::VARCHAR AS raw_value, l_linenumber::INT AS page FROM lineitem")
def src8(spark, sf):
    l = read(spark, sf, "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
    item = F.struct(F.col("l_linenumber").cast("int").alias("page"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("field"), F.col("l_partkey").cast("string").alias("raw_value"))
    own = l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("j"))
    return rep.reply_items(own.select("doc_id", F.concat(F.lit("Here it is:\n```json\n"), "j", F.lit("\n```\nThat is all.")).alias("text")), "field:string,raw_value:string,page:int")


view("priors", """SELECT doc_id, nk, y, q, field, 'Q' AS period_type, CAST(v AS DOUBLE) AS value FROM figures WHERE fno IN (1, 2, 3)
  UNION ALL SELECT doc_id, nk, y, q, 'gross_profit', 'Q', CAST(v AS DOUBLE) FROM figures WHERE fno = 4 AND nk % 4 = 0""")


@query("ins2_derived_prior_gross_profit", """SELECT doc_id, field, period_type, value, false AS derived FROM priors UNION ALL
  SELECT r.doc_id, 'gross_profit', 'Q', r.value - abs(c.value), true FROM priors r JOIN priors c ON r.doc_id = c.doc_id AND r.field = 'revenue' AND c.field = 'cost_of_revenue' WHERE r.nk % 4 <> 0""")
def ins2(spark, sf):
    return rep.with_derived_gross_profit(load(spark, sf, "priors"))


@query("ins4_margins", """WITH w AS (SELECT doc_id, nk, y, q, max(value) FILTER (field = 'revenue') AS r, max(value) FILTER (field = 'net_income_parent') AS n, max(value) FILTER (field = 'gross_profit') AS g FROM priors GROUP BY ALL),
  m AS (SELECT a.doc_id, 'net_margin' AS key, a.n / a.r AS now, CASE WHEN b.r > 0 THEN b.n / b.r END AS prev FROM w a LEFT JOIN w b ON b.nk = a.nk AND b.q = a.q AND b.y = a.y - 1 WHERE a.r > 0 AND (a.nk + a.q) % 6 <> 0
  UNION ALL SELECT a.doc_id, 'gross_margin', a.g / a.r, CASE WHEN b.r > 0 THEN b.g / b.r END FROM w a LEFT JOIN w b ON b.nk = a.nk AND b.q = a.q AND b.y = a.y - 1 WHERE a.r > 0 AND a.g IS NOT NULL)
  SELECT doc_id, 'Q' AS period_type, key, round(now, 9) AS now, round(prev, 9) AS prev, round((now - prev) * 100, 7) AS change_pp FROM m""")
def ins4(spark, sf):
    p = load(spark, sf, "priors")
    now = p.withColumn("status", F.when((F.col("field") == "net_income_parent") & ((F.col("nk") + F.col("q")) % 6 == 0), "BAD").otherwise("OK"))
    docs = p.select("doc_id", "nk", "y", "q").distinct()
    old = p.drop("doc_id").withColumn("y", F.col("y") + 1).join(docs, ["nk", "y", "q"])
    return rep.margins(now, old).select("doc_id", "period_type", "key", F.round("now", 9).alias("now"), F.round("prev", 9).alias("prev"), F.round("change_pp", 7).alias("change_pp"))


view("shown", "SELECT doc_id, fno AS seq, field, period_type, field IN ('eps_basic', 'operating_cash_flow') AS aux, CASE v % 3 WHEN 0 THEN 'OK' WHEN 1 THEN 'FOUND' ELSE 'BAD' END AS status FROM figures")


@query("ins5_status_summary", """SELECT doc_id, count(*)::BIGINT AS n, count_if(status = 'OK')::BIGINT AS ok, count_if(status = 'FOUND')::BIGINT AS warn, coalesce(string_agg(field, ',' ORDER BY seq) FILTER (status = 'BAD'), '') AS bad FROM shown WHERE NOT aux GROUP BY doc_id""")
def ins5(spark, sf):
    return rep.status_summary(load(spark, sf, "shown")).withColumn("bad", F.array_join("bad", ","))


@query("ins11_display_order", """SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE status WHEN 'BAD' THEN 1 WHEN 'FOUND' THEN 2 ELSE 3 END, aux,
  CASE field WHEN 'revenue' THEN 1 WHEN 'net_income_parent' THEN 2 WHEN 'eps_basic' THEN 3 ELSE 9 END, period_type <> 'Q', seq)::INT AS place FROM shown""")
def ins11(spark, sf):
    return rep.display_order(load(spark, sf, "shown"), ["revenue", "net_income_parent", "eps_basic"]).select("doc_id", "seq", "place")


view("points", """SELECT doc_id, fno, v, k, fno * 10 + k AS seq, CASE WHEN k = 3 AND fno = 5 THEN '' ELSE '数字 ' || CAST(v + CASE WHEN k = 3 AND fno = 4 THEN 1 ELSE 0 END AS STRING) END AS text_zh,
  'It was ' || CAST(v AS STRING) || CASE WHEN k = 3 AND fno = 6 THEN ', a strong one' ELSE '' END AS text_en, CASE WHEN k = 3 AND fno = 3 THEN 0 WHEN k = 3 AND fno = 2 THEN 9 ELSE 2 END AS page
  FROM figures CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey BETWEEN 1 AND 3) r""")


@query("ins8_ins9_ins10_checked_points", """SELECT doc_id, seq, why, CASE WHEN why IS NOT NULL THEN 'dropped' WHEN row_number() OVER (PARTITION BY doc_id, why IS NULL ORDER BY seq) <= 5 THEN 'kept' ELSE 'over' END AS route FROM (
  SELECT p.doc_id, seq, CASE WHEN text_zh = '' THEN 'language missing' WHEN k = 3 AND fno = 4 AND NOT EXISTS (SELECT 1 FROM figures f WHERE f.doc_id = p.doc_id AND f.v = p.v + 1) THEN 'numbers: ' || (v + 1) WHEN page = 0 THEN 'no page' WHEN page = 9 THEN 'pages: 9' WHEN k = 3 AND fno = 6 THEN 'wording: strong' END AS why FROM points p)""")
def ins10(spark, sf):
    p = load(spark, sf, "points").withColumn("pages", F.when(F.col("page") > 0, F.array(F.col("page").cast("int"))))
    facts = load(spark, sf, "figures").select("doc_id", F.format_number("v", 0).alias("text"), F.lit(2).alias("page"))
    return rep.checked_points(p, facts).select("doc_id", "seq", "why", "route")


view("judged", "SELECT doc_id, fno, field, v % 2 = 0 AS c1, v % 3 <> 0 AS c2, v % 5 <> 0 AS c3, v % 7 = 0 AS off, v % 11 = 0 AS rule, fno = 4 AS parts, v % 13 = 0 AS re, CASE WHEN v % 17 = 0 THEN 'MISSING' ELSE 'UNIT' END AS category FROM figures")


def _judged(spark, sf):
    j = load(spark, sf, "judged")
    part = F.array(F.struct(F.lit(True).alias("c1"), F.lit(True).alias("c2"), F.lit(True).alias("c3")), F.struct("c1", "c2", "c3"))
    return j.withColumns({"components": F.when(F.col("parts"), part), "state": F.when(F.col("off"), "mismatch").otherwise("none"), "sanity": F.when(F.col("rule"), F.array(F.lit("S1"))), "recomputed": F.col("re")})


view("o_fired", """SELECT *, CASE WHEN category = 'MISSING' THEN 'MISSING' ELSE coalesce(nullif(concat_ws(',', CASE WHEN NOT c1 THEN CASE WHEN parts THEN 'C1_PART' ELSE 'C1' END END, CASE WHEN NOT c2 THEN CASE WHEN parts THEN 'C2_PART' ELSE 'C2' END END,
  CASE WHEN NOT c3 THEN CASE WHEN parts THEN 'C3_PART' ELSE 'C3' END END, CASE WHEN off THEN 'C4' END, CASE WHEN rule THEN 'S1' END, CASE WHEN re THEN 'RECOMPUTED' END), ''), 'UNKNOWN') END AS fired FROM judged""")


@query("eva5_eva18_triggers", "SELECT doc_id, fno, fired, NOT (c1 AND c2 AND c3) OR rule OR category = 'MISSING' AS flagged FROM o_fired")
def eva18(spark, sf):
    return _judged(spark, sf).select("doc_id", "fno", F.array_join(rep.triggers(), ",").alias("fired"), rep.flagged_without_reference().alias("flagged"))


@query("eva19_eva20_trigger_counts", "SELECT trigger, count(*)::BIGINT AS n, count_if(NOT contains(fired, ','))::BIGINT AS sole FROM (SELECT fired, unnest(string_split(fired, ',')) AS trigger FROM o_fired) GROUP BY trigger")
def eva19(spark, sf):
    return rep.trigger_counts(_judged(spark, sf).select(rep.triggers().alias("triggers")))


@query("eva22_tier_matrix", "SELECT doc_id AS report, field || ' ' || period_type || ' ' || fno AS field, 'R' AS simple, CASE WHEN v % 5 = 0 THEN 'W' ELSE 'R' END AS expert, CASE WHEN v % 3 <> 0 THEN 'R' END AS pipeline FROM figures")
def eva22(spark, sf):
    f = load(spark, sf, "figures").select(F.col("doc_id").alias("report"), F.concat_ws(" ", "field", "period_type", "fno").alias("field"), "v", F.explode(F.array(*map(F.lit, ["simple", "expert", "pipeline"]))).alias("cell"))
    rows = f.where("cell <> 'pipeline' OR v % 3 <> 0").withColumn("strict", (F.col("cell") != "expert") | (F.col("v") % 5 != 0))
    return rep.tier_matrix(rows, ["simple", "expert", "pipeline"])


@query("bud8_projected_costs", """SELECT model, round(avg(CASE WHEN model = 'tiered' AND t > 2000 THEN t * 4 + 1500 * 20 WHEN model = 'tiered' THEN t * 2 + 1500 * 12 ELSE t + 1500 * 3 END / 1e6) * 1.2, 10) AS usd
  FROM (SELECT length(coalesce(text, '')) * 0.3 + 400 AS t FROM documents), (VALUES ('tiered'), ('plain')) m(model) GROUP BY model""")
def bud8(spark, sf):
    docs = read(spark, sf, "SELECT length(coalesce(text, '')) AS chars FROM documents")
    prices = [{"model": "tiered", "in": 2, "out": 12, "long_from": 2000, "long_in": 4, "long_out": 20}, {"model": "plain", "in": 1, "out": 3}]
    return rep.projected_costs(docs, prices, 0.3, 400, 1500, 0.2).withColumn("usd", F.round("usd", 10))


@query("bud9_scaled_costs", """SELECT round(sum(n * greatest(1.0, sqrt(k))), 4) AS pipeline, round(sum(2 * n * k), 4) AS direct, round(sum(2 * n * k), 4) AS simple, round(1.3 * sum(2 * n * k), 4) AS verified FROM (SELECT n, rev / greatest(1, 1000 * q) AS k FROM filings)""")
def bud9(spark, sf):
    f = load(spark, sf, "filings").select(F.col("n").alias("pipeline"), (2 * F.col("n")).alias("direct"), F.col("n").alias("simple"), F.col("rev").alias("chars"), (1000 * F.col("q")).alias("last_chars"))
    return rep.scaled_costs(f).select(*[F.round(c, 4).alias(c) for c in ("pipeline", "direct", "simple", "verified")])


@query("snk1_result_documents", "SELECT market, doc_id, count(*)::BIGINT AS n, string_agg(raw_value, ';' ORDER BY seq) AS raw FROM claims GROUP BY market, doc_id")
def snk1(spark, sf):
    path = new_path(spark, "results")
    sinks.write_results(load(spark, sf, "claims").select("market", "doc_id", "seq", "field", "raw_value"), path)
    back = spark.read.schema("doc_id string, items array<struct<seq:int,field:string,raw_value:string>>, market string").json(path)
    return back.select("market", "doc_id", F.size("items").cast("long").alias("n"), F.array_join(F.col("items.raw_value"), ";").alias("raw"))


@query("snk2_item_csv", "SELECT doc_id, seq, field || ' \"as printed\", net' AS field, raw_value, quote FROM claims")
def snk2(spark, sf):
    path, rows = new_path(spark, "csv"), load(spark, sf, "claims").select("doc_id", "seq", F.concat("field", F.lit(' "as printed", net')).alias("field"), "raw_value", "quote")
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path, rows.schema)


@query("snk4_review_rows", "SELECT f.market || ':' || 'N' || f.nk || ':' || d.period || ':' || f.field || ':' || f.period_type AS id, v FROM figures f JOIN filings d ON d.doc_id = f.doc_id")
def snk4(spark, sf):
    rows = load(spark, sf, "figures").select("doc_id", "market", "field", "period_type", "v").join(load(spark, sf, "filings").select("doc_id", "code", "period"), "doc_id")
    path = new_path(spark, "review")
    sinks.review_rows(rows).write.json(path)
    return spark.read.schema("id string, v long").json(path)


view("last_year", """SELECT a.doc_id, CAST(a.fno * 10 + p.n AS INT) AS seq, CASE WHEN a.fno = 4 THEN 'unasked' ELSE a.field END AS field, a.period_type, a.period_end, CASE WHEN p.n = 2 THEN a.period_end ELSE add_months(a.period_end, -12) END AS prior_end, (a.v + a.nk) % 4 <> 0 AS passed, a.v + p.n AS v
  FROM figures a CROSS JOIN (SELECT CAST(r_regionkey AS INT) AS n FROM region WHERE r_regionkey < 4) p""")


@query("ins1_comparatives", """SELECT doc_id, seq, CASE WHEN fno4 THEN 'not asked for' WHEN n = 2 THEN 'not a year before' WHEN NOT passed THEN 'failed checks' WHEN row_number() OVER (PARTITION BY doc_id, field, period_type, fno4, n = 2, passed ORDER BY seq) > 1 THEN 'repeated' END AS why
  FROM (SELECT a.doc_id, a.fno * 10 + n AS seq, a.fno = 4 AS fno4, n, a.field, a.period_type, (a.v + a.nk) % 4 <> 0 AS passed FROM figures a, range(4) r(n))""")
def ins1(spark, sf):
    old = read(spark, sf, "SELECT doc_id, seq, field, period_type, prior_end AS period_end, passed, CAST(v AS STRING) AS raw_value FROM last_year")
    now = load(spark, sf, "figures").select("doc_id", "field", "period_type", "period_end").distinct()
    return rep.comparatives(old, now).select("doc_id", "seq", "why")


@query("src12_listing_rows", "SELECT o_orderkey AS doc_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS pos, o_custkey::VARCHAR AS filer, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders")
def src12(spark, sf):
    o = read(spark, sf, "SELECT o_custkey, o_orderkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders")
    own = o.groupBy(F.col("o_custkey").cast("string").alias("filer")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "d"))).alias("x"))
    text = F.to_json(F.struct(F.struct(F.col("x.o_orderkey").alias("doc_id"), F.col("x.o_orderpriority").alias("form"), F.col("x.d").alias("filed")).alias("recent")))
    return rep.listing_rows(own.select("filer", text.alias("text")), {"doc_id": "long", "form": "string", "filed": "string"})


@query("eva25_snippets", """SELECT doc_id, seq, page, hit, (SELECT string_agg(l.line, chr(10) ORDER BY l.line_no) FROM lines l WHERE l.doc_id = c.doc_id AND l.page = c.page AND abs(l.line_no - c.hit) <= 1) AS lines
  FROM (SELECT k.doc_id, k.seq, min_by(l.page, l.page * 100 + l.line_no)::INT AS page, min_by(l.line_no, l.page * 100 + l.line_no)::INT AS hit FROM claims k JOIN lines l ON l.doc_id = k.doc_id AND list_contains(regexp_extract_all(l.line, '[0-9]+'), k.v::VARCHAR) GROUP BY k.doc_id, k.seq) c""")
def eva25(spark, sf):
    rows = load(spark, sf, "lines").withColumn("line_no", F.col("line_no").cast("int"))
    asked = load(spark, sf, "claims").select("doc_id", "seq", F.col("v").cast("string").alias("raw"), F.lit(None).cast("int").alias("hint"))
    return rep.snippets(asked, rows, 1).withColumn("lines", F.array_join("lines", "\n"))
