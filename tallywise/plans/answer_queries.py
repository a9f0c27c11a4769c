"""Queries of pasted and free-text answers, answer keys and review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answer_key as key
from ..operators import evaluate as ev
from ..operators import paste
from .registry import query
from .views import load, read, view

view("replies", """SELECT doc_id || ':' || CAST(fno AS STRING) AS doc_id, 'Q' AS cumulative_type, CAST(period_end AS STRING) AS period_end, CASE (nk * 3 + y + q * 5 + fno) % 8
  WHEN 0 THEN '| Metric | Value | Unit | Period | Page |' || chr(10) || '|---|:--:|---|---|---|' || chr(10) || '| ' || field || ' | ' || CASE WHEN v % 10 = 0 THEN 'none' ELSE CAST(v AS STRING) END || ' | USD | ' || CASE WHEN v % 3 = 0 THEN 'the nine months' ELSE '' END || ' | p. 2 |' || chr(10) || '| Revenue | ' || CAST(v AS STRING) || ' |'
  WHEN 1 THEN 'metric' || chr(9) || 'amount' || chr(9) || 'period' || chr(10) || chr(10) || field || chr(9) || CAST(v AS STRING) || chr(9) || CASE WHEN v % 4 = 0 THEN 'sometime' ELSE 'FY' END
  WHEN 2 THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"items": [{"field": "' || field || '", "raw_value": "' || CAST(v AS STRING) || '", "page": "p. 7"}, 5, {"metric": "goodwill", "value": ' || CAST(v AS STRING) || '}]}' || chr(10) || '```' || chr(10) || 'Bye.'
  WHEN 3 THEN '[{"field": "' || field || '", "status": "not_disclosed", "note": "n/a"}, {"field": "' || field || '", "raw_value": "' || CAST(v AS STRING) || '", "period_type": "sometime"}]'
  WHEN 4 THEN '[{"field": ' || CAST(v AS STRING) WHEN 5 THEN 'Thing | Worth' || chr(10) || 'Revenue | ' || CAST(v AS STRING) WHEN 6 THEN ' ' ELSE '{"rows": []}' END AS text FROM figures""")

view("o_bodies", r"""SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?s)```(?:json|JSON)?\s*\n(.*?)\n\s*```') THEN trim(regexp_extract(text, '(?s)```(?:json|JSON)?\s*\n(.*?)\n\s*```', 1)) ELSE trim(text) END AS body FROM replies""")
view("o_kinds", "SELECT doc_id, text, body, CASE WHEN trim(text) = '' THEN 'empty' WHEN left(body, 1) IN ('[', '{') THEN 'json' ELSE 'table' END AS kind FROM o_bodies")
view("o_lists", "SELECT doc_id, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN CASE WHEN left(body, 1) = '[' THEN body::JSON ELSE json_extract(body, '$.items') END END AS items FROM o_kinds WHERE kind = 'json'")
view("o_json", """SELECT doc_id, 1 AS line, CASE WHEN NOT valid THEN 'not JSON' ELSE 'no list of items' END AS why, NULL AS x FROM o_lists WHERE NOT valid OR items IS NULL
  UNION ALL SELECT doc_id, line, CASE WHEN json_type(x) <> 'OBJECT' THEN 'not an object' END, x FROM (SELECT doc_id, generate_subscripts(json_extract(items, '$[*]'), 1) AS line, unnest(json_extract(items, '$[*]')) AS x FROM o_lists WHERE valid AND items IS NOT NULL)""")
view("o_lines", r"""SELECT doc_id, line, raw, CASE WHEN contains(raw, chr(9)) THEN string_split(raw, chr(9)) ELSE list_transform(string_split(regexp_replace(trim(raw), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) END AS cells
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS raw FROM o_kinds WHERE kind = 'table') WHERE trim(raw) <> ''""")
view("o_heads", """SELECT doc_id, cells AS head, list_transform(cells, lambda c: CASE WHEN lower(c) IN ('metric') THEN 'field' WHEN lower(c) IN ('value', 'amount') THEN 'raw_value' WHEN lower(c) = 'unit' THEN 'raw_unit' WHEN lower(c) = 'period' THEN 'period_type' WHEN lower(c) = 'page' THEN 'page' END) AS roles
  FROM o_lines l WHERE line = (SELECT min(line) FROM o_lines m WHERE m.doc_id = l.doc_id)""")
view("o_table", r"""SELECT doc_id, line, CASE WHEN len(cells) <> len(head) THEN len(cells) || ' cells, header has ' || len(head) END AS why, cells, roles FROM (SELECT l.doc_id, l.line, l.cells, h.head, h.roles, min(l.line) OVER (PARTITION BY l.doc_id) AS first FROM o_lines l JOIN o_heads h ON h.doc_id = l.doc_id
  WHERE list_contains(roles, 'field') AND list_contains(roles, 'raw_value')) WHERE line > first AND NOT regexp_full_match(array_to_string(cells, ''), '(:?-{2,}:?)+')""")
view("o_pasted", """SELECT doc_id, line, why, json_extract_string(x, '$.field') AS name, json_extract_string(x, '$.metric') AS metric, coalesce(json_extract_string(x, '$.raw_value'), json_extract_string(x, '$.value'), '') AS raw, json_extract_string(x, '$.period_type') AS period, json_extract_string(x, '$.page') AS page, json_extract_string(x, '$.status') AS status FROM o_json
  UNION ALL SELECT doc_id, line, why, cells[list_position(roles, 'field')], NULL, cells[list_position(roles, 'raw_value')], cells[list_position(roles, 'period_type')], cells[list_position(roles, 'page')], NULL FROM o_table""")
view("o_routed", r"""SELECT *, CASE WHEN why0 IS NOT NULL THEN why0 WHEN known IS NULL THEN 'unknown metric' WHEN status = 'not_disclosed' THEN NULL WHEN NOT regexp_matches(raw, '[0-9]') THEN 'not a number' WHEN ptype IS NULL THEN 'unknown period' END AS why FROM (SELECT doc_id, line, why AS why0, raw, page, status,
  CASE WHEN lower(coalesce(name, metric)) IN ('revenue', 'net_income_parent', 'eps_basic', 'operating_cash_flow', 'cost_of_revenue') THEN lower(coalesce(name, metric)) END AS known,
  CASE WHEN coalesce(period, '') = '' THEN 'Q' WHEN lower(period) = 'fy' THEN 'FY' WHEN contains(lower(period), 'nine months') THEN 'YTD' END AS ptype FROM o_pasted)""")


@query("src9_json_replies", "SELECT doc_id, line::INT AS line, coalesce(why, '') AS why, coalesce(name, metric) AS name, CASE WHEN why IS NULL THEN raw END AS raw FROM o_pasted WHERE doc_id IN (SELECT doc_id FROM o_kinds WHERE kind = 'json')")
def src9(spark, sf):
    rows = paste.json_rows(load(spark, sf, "replies"))
    raw = F.coalesce("row.raw_value", "row.value", F.lit(""))
    return rows.select("doc_id", "line", F.coalesce("why", F.lit("")).alias("why"), F.coalesce("row.field", "row.metric").alias("name"), F.when(F.col("row").isNotNull(), raw).alias("raw"))


@query("src10_table_replies", """SELECT h.doc_id, array_to_string(head, ',') AS columns, array_to_string(list_transform(roles, lambda r: coalesce(r, '-')), ',') AS roles, NOT (list_contains(roles, 'field') AND list_contains(roles, 'raw_value')) AS needs_mapping, coalesce(n, 0)::BIGINT AS n, coalesce(bad, 0)::BIGINT AS bad
  FROM o_heads h LEFT JOIN (SELECT doc_id, count(*) AS n, count(why) AS bad FROM o_table GROUP BY doc_id) t ON t.doc_id = h.doc_id""")
def src10(spark, sf):
    replies = load(spark, sf, "replies")
    n = paste.table_rows(replies).groupBy("doc_id").agg(F.count("*").alias("n"), F.count("why").alias("bad"))
    heads = paste.table_heads(replies).select("doc_id", F.array_join("columns", ",").alias("columns"), F.array_join("roles", ",", "-").alias("roles"), "needs_mapping")
    return heads.join(n, "doc_id", "left").fillna(0, ["n", "bad"])


@query("src11_routed_items", """SELECT doc_id, line::INT AS line, CASE WHEN why IS NOT NULL THEN 'bad' WHEN status = 'not_disclosed' THEN 'absent' ELSE 'item' END AS route, coalesce(why, '') AS why, CASE WHEN why IS NULL THEN known END AS field, CASE WHEN why IS NULL THEN ptype END AS period_type,
  CASE WHEN why IS NULL AND status IS NULL THEN raw END AS raw_value, CASE WHEN why IS NULL AND status IS NULL THEN coalesce(try_cast(regexp_extract(page, '[0-9]+') AS INT), 0) END AS page FROM o_routed""")
def src11(spark, sf):
    return paste.pasted(load(spark, sf, "replies")).select("doc_id", "line", "route", F.coalesce("why", F.lit("")).alias("why"), "field", "period_type", "raw_value", "page")


view("said", """SELECT doc_id, CAST(fno AS INT) AS seq, field, period_type, period_end, v, CASE WHEN v % 11 = 0 THEN 'not_disclosed' ELSE 'answered' END AS status, CASE WHEN v % 5 = 0 THEN CAST(v + 1 AS STRING) ELSE CAST(v AS STRING) END AS raw_value, v % 7 = 0 AS computed, v % 2 = 0 AS negative,
  'Item ' || field || ' was ' || CAST(v AS STRING) || ' thousand.' AS answer FROM figures""")


@query("ver27_free_text_claims", r"""SELECT doc_id, seq, CASE WHEN neg AND raw_value <> '' THEN '-' || raw_value ELSE raw_value END AS raw_value, CASE WHEN NOT list_contains(numbers, raw_value) THEN 'not in the answer' END AS note, CASE WHEN computed AND seq <> 2 THEN 'derived' ELSE 'reported' END AS derivation,
  CASE WHEN computed AND seq <> 2 THEN 'part thousands' END AS part, computed AND seq = 2 AS computed_without_inputs FROM (SELECT s.*, negative AS neg, a.numbers FROM said s JOIN (SELECT doc_id, list_distinct(flatten(list(regexp_extract_all(answer, '\d+')))) AS numbers FROM said GROUP BY doc_id) a ON a.doc_id = s.doc_id WHERE status = 'answered')""")
def ver27(spark, sf):
    s = load(spark, sf, "said")
    answers = s.groupBy("doc_id", "period_end").agg(F.array_distinct(F.flatten(F.collect_list(tx.number_set(F.col("answer"))))).alias("answer_numbers"))
    part = F.struct(F.lit("part").alias("name"), F.lit(1).alias("sign"), F.col("raw_value"), F.lit("").alias("raw_unit"), F.lit(None).cast("string").alias("raw_currency"), F.lit(2).alias("page"), F.lit("").alias("quote"))
    parts = F.when(F.col("seq") == 2, F.array(part.withField("raw_value", F.lit("")))).otherwise(F.array(part))
    parsed = s.drop("period_end").withColumns({"raw_unit": F.lit("thousands"), "raw_currency": F.lit("USD"), "page": F.lit(2), "source_quote": F.lit(""), "components": parts})
    out = paste.free_text_claims(parsed, answers)
    shown = F.when(F.col("components").isNotNull(), F.concat(F.col("components")[0]["name"], F.lit(" "), F.col("components")[0]["raw_unit"]))
    return out.select("doc_id", "seq", "raw_value", "note", "derivation", shown.alias("part"), "computed_without_inputs")


view("page_numbers", "SELECT doc_id, CAST(v AS STRING) AS number FROM figures WHERE v % 6 <> 0 UNION SELECT doc_id, CAST(v * 10 AS STRING) || '.0' FROM figures WHERE v % 6 = 0 UNION SELECT doc_id, CAST(v AS STRING) || '.5' FROM figures WHERE v % 4 = 0")
view("key_manual", """SELECT doc_id, field, period_type, CAST(v + 2 AS STRING) || CASE WHEN v % 2 = 0 THEN '.25' ELSE '' END AS raw_value, 'in thousands' AS raw_unit, 'USD' AS raw_currency, CASE WHEN v % 3 = 0 THEN CAST(7 AS DOUBLE) END AS tol, v % 5 = 0 AS na, v FROM figures WHERE (nk + fno) % 4 = 0""")
view("o_shown", """SELECT DISTINCT doc_id, field, value, text, half FROM (SELECT doc_id, field, value, 0.5 * power(10, -d) * s AS half, replace(format('{:.' || d || 'f}', abs(value) / s), ',', '') AS text, d, s FROM
  (SELECT DISTINCT doc_id, field, value FROM o_values_shown), (SELECT unnest([1, 1000, 10000, 1000000, 100000000, 1000000000])::DOUBLE AS s), range(5) r(d)) WHERE CASE WHEN field = 'eps_basic' THEN s = 1 AND length(ltrim(replace(text, '.', ''), '0')) >= 2 ELSE d < 4 AND length(ltrim(replace(text, '.', ''), '0')) >= 4 END""")
view("o_values_shown", """SELECT doc_id, field, value FROM facts UNION SELECT doc_id, field, value + 1000 FROM facts UNION SELECT doc_id, field, v * 10 + 7.0 FROM figures UNION SELECT doc_id, field, v * 1000.0 FROM figures UNION SELECT doc_id, field, v::DOUBLE FROM figures""")
view("o_printed", "SELECT o.doc_id, o.field, o.value, max(half) AS half FROM o_shown o JOIN page_numbers p ON p.doc_id = o.doc_id AND p.number = o.text GROUP BY ALL")


@query("eva1_printed_tolerances", "SELECT f.doc_id, f.ord::BIGINT AS ord, half AS half_unit FROM facts f JOIN o_printed p ON p.doc_id = f.doc_id AND p.field = f.field AND p.value = f.value")
def eva1_printed(spark, sf):
    return key.printed(load(spark, sf, "facts"), load(spark, sf, "page_numbers"), ["doc_id", "ord"]).select("doc_id", "ord", "half_unit")


view("o_key", """SELECT coalesce(a.doc_id, m.doc_id) AS doc_id, coalesce(a.field, m.field) AS field, coalesce(a.period_type, m.period_type) AS period_type, CASE WHEN m.v IS NULL THEN a.value ELSE m.truth END AS truth, CASE WHEN m.v IS NULL THEN a.currency ELSE 'USD' END AS currency, m.own_tol, m.v IS NOT NULL AS manual FROM
  (SELECT f.doc_id, f.field, f.period_type, arg_min(f.value, f.ord) AS value, arg_min(f.currency, f.ord) AS currency FROM facts f JOIN filings d ON d.doc_id = f.doc_id AND d.market IN ('us', 'a') AND strftime(f.period_end, '%Y-%m') = strftime(d.period_end, '%Y-%m') WHERE f.field IN ('revenue', 'net_income_parent', 'eps_basic', 'operating_cash_flow') GROUP BY ALL) a
  FULL JOIN (SELECT *, raw_value::DECIMAL(18, 2)::DOUBLE * 1000 AS truth, coalesce(tol, CASE WHEN contains(raw_value, '.') THEN 5 ELSE 500 END) AS own_tol FROM key_manual) m ON m.doc_id = a.doc_id AND m.field = a.field AND m.period_type = a.period_type WHERE NOT coalesce(na, false)""")
view("o_answer_key", "SELECT k.doc_id, k.field, k.period_type, k.truth, k.currency, coalesce(own_tol, half, 5e-6 * abs(truth)) AS tol, CASE WHEN manual THEN 'manual' ELSE 'automatic' END AS source FROM o_key k LEFT JOIN o_printed p ON p.doc_id = k.doc_id AND p.field = k.field AND p.value = k.truth")


def keyed(spark, sf):
    fields = F.array(*map(F.lit, ["revenue", "net_income_parent", "eps_basic", "operating_cash_flow"]))
    return key.answer_key(load(spark, sf, "filings").withColumn("fields", fields), load(spark, sf, "facts"), load(spark, sf, "key_manual"), load(spark, sf, "page_numbers"))


@query("eva2_answer_key", "SELECT doc_id, field, period_type, round(truth, 2) AS truth, currency, round(tol, 6) AS tol, source FROM o_answer_key")
def eva2(spark, sf):
    return keyed(spark, sf).select("doc_id", "field", "period_type", F.round("truth", 2).alias("truth"), "currency", F.round("tol", 6).alias("tol"), "source")


view("key_preds", """SELECT doc_id, field, period_type, CASE v % 7 WHEN 0 THEN NULL WHEN 1 THEN v * 10 + 7.0 ELSE CASE WHEN field = 'eps_basic' THEN v / 100.0 ELSE v * 1000.0 END END AS value, CASE WHEN v % 13 = 0 THEN 'EUR' WHEN v % 3 = 0 THEN NULL ELSE 'USD' END AS currency, CAST(v AS STRING) AS raw_value, v % 4 = 0 AS flagged, market, fno FROM figures""")
view("o_scored", """SELECT k.*, p.value, value IS NOT NULL AS answered, coalesce(p.currency <> k.currency AND value IS NOT NULL, false) AS conflict, coalesce(NOT conflict AND abs(value - truth) <= tol + 1e-9 * abs(truth), false) AS strict, coalesce(NOT conflict AND abs(value - truth) <= 0.01 * abs(truth), false) AS approx, p.raw_value, coalesce(p.flagged, false) AS flagged FROM o_answer_key k LEFT JOIN key_preds p ON p.doc_id = k.doc_id AND p.field = k.field AND p.period_type = k.period_type""")
view("o_plain", "SELECT DISTINCT doc_id, value, format('{:.' || d || 'f}', abs(value) / s) AS text FROM (SELECT DISTINCT doc_id, value FROM key_preds WHERE value IS NOT NULL), (SELECT unnest([1, 1000, 10000, 1000000, 100000000, 1000000000])::DOUBLE AS s), range(3) r(d) WHERE abs(value) / s >= 100")
O_SCORES = """SELECT doc_id, field, period_type, answered, conflict, strict, approx, answered AND NOT approx AND NOT (EXISTS (SELECT 1 FROM page_numbers n WHERE n.doc_id = o.doc_id AND n.number = o.raw_value)
  OR EXISTS (SELECT 1 FROM page_numbers n JOIN o_plain t ON t.doc_id = n.doc_id AND t.text = n.number WHERE t.doc_id = o.doc_id AND t.value = o.value) OR EXISTS (SELECT 1 FROM page_numbers n JOIN o_shown t ON t.doc_id = n.doc_id AND t.text = n.number WHERE t.doc_id = o.doc_id AND t.field = o.field AND t.value = o.value)) AS fabricated FROM o_scored o"""


def scored(spark, sf):
    return key.scores(keyed(spark, sf), load(spark, sf, "key_preds"), load(spark, sf, "page_numbers"))


@query("eva6_eva7_key_scores", O_SCORES)
def eva7(spark, sf):
    return scored(spark, sf).select("doc_id", "field", "period_type", "answered", "conflict", "strict", "approx", "fabricated")


@query("eva10_breakdown", """WITH r AS (SELECT o.*, d.market, d.template, CASE WHEN d.market = 'hk' THEN 'hk' ELSE 'us+a' END AS side FROM o_scored o JOIN filings d ON d.doc_id = o.doc_id), g AS (SELECT *, unnest([['market', market], ['side', side], ['field', field], ['period_type', period_type], ['template', template]]) AS g FROM r)
  SELECT g[1] AS dimension, g[2] AS part, count(*)::BIGINT AS n, count_if(strict) / count(*) AS strict_accuracy, count_if(NOT strict AND NOT flagged AND answered)::BIGINT AS silent FROM g GROUP BY ALL""")
def eva10(spark, sf):
    rows = scored(spark, sf).join(load(spark, sf, "filings").select("doc_id", "market", "template"), "doc_id").withColumn("side", F.when(F.col("market") == "hk", "hk").otherwise("us+a"))
    flags = load(spark, sf, "key_preds").select("doc_id", "field", "period_type", "flagged")
    rows = rows.join(flags, key.KEY, "left").fillna(False, ["flagged"])
    return key.breakdown(rows, ["market", "side", "field", "period_type", "template"], ev.summary).select("dimension", "part", "n", "strict_accuracy", "silent")


@query("eva13_item_set", """WITH own AS (SELECT DISTINCT doc_id, field, period_type FROM figures WHERE fno IN (1, 2) AND v % 3 <> 0 UNION SELECT doc_id, field, period_type FROM facts WHERE field = 'revenue'), cum AS (SELECT doc_id, min(period_type) AS c FROM own WHERE period_type <> 'Q' GROUP BY doc_id)
  SELECT * FROM own UNION SELECT doc_id, field, period_type FROM (SELECT doc_id, CASE WHEN fno = 3 THEN 'gross_profit' ELSE field END AS field, CASE WHEN fno = 6 THEN 'FY' ELSE period_type END AS period_type FROM figures WHERE v % 2 = 0) f WHERE field IN ('gross_profit', 'eps_basic') AND (period_type <> 'Q' AND period_type = (SELECT c FROM cum WHERE cum.doc_id = f.doc_id)
  OR period_type = 'Q' AND EXISTS (SELECT 1 FROM own o WHERE o.doc_id = f.doc_id AND o.period_type = 'Q' AND o.field IN ('revenue', f.field)))""")
def eva13(spark, sf):
    f = load(spark, sf, "figures")
    answered = f.where("v % 2 = 0").select("doc_id", F.when(F.col("fno") == 3, "gross_profit").otherwise(F.col("field")).alias("field"), F.when(F.col("fno") == 6, "FY").otherwise(F.col("period_type")).alias("period_type"))
    return key.item_set(f.where("fno IN (1, 2) AND v % 3 <> 0"), load(spark, sf, "facts").where("field = 'revenue'"), answered, ["gross_profit", "eps_basic"])


@query("eva16_adjusted_scores", """SELECT cell, count(*)::BIGINT AS n, count_if(CASE WHEN adjusted THEN coalesce(abs(value - majority) <= 0.5 + 1e-9 * abs(majority), false) ELSE strict END)::BIGINT AS strict FROM (SELECT 'c' || fno AS cell, f.v::DOUBLE AS value, f.v % 2 = 0 AS strict, f.v * 1000.0 AS majority,
  f.v % 3 = 0 AND NOT EXISTS (SELECT 1 FROM o_printed p WHERE p.doc_id = f.doc_id AND p.field = f.field AND p.value = f.v * 10 + 7.0) AND EXISTS (SELECT 1 FROM o_printed p WHERE p.doc_id = f.doc_id AND p.field = f.field AND p.value = f.v * 1000.0) AS adjusted FROM figures f) GROUP BY cell""")
def eva16(spark, sf):
    f = load(spark, sf, "figures").withColumn("period_type", F.concat_ws(":", "period_type", "fno"))
    rows = f.select(*key.KEY, F.concat(F.lit("c"), F.col("fno").cast("string")).alias("cell"), F.col("v").cast("double").alias("value"), (F.col("v") % 2 == 0).alias("strict"), F.lit(0.5).alias("tol"))
    disputes = f.where("v % 3 = 0").select(*key.KEY, (F.col("v") * 10 + 7.0).alias("truth"), (F.col("v") * 1000.0).alias("majority"))
    return key.adjusted(rows, disputes, load(spark, sf, "page_numbers"))


@query("eva21_not_applicable", """SELECT tier, count(*)::BIGINT AS asked, count(value)::BIGINT AS gave, count_if(value IS NOT NULL AND flagged)::BIGINT AS flagged FROM (SELECT t.tier, CASE WHEN t.tier = 'simple' OR p.fno % 2 = 0 THEN p.value END AS value, p.flagged FROM (SELECT DISTINCT doc_id, field, period_type FROM key_manual WHERE na) m
  CROSS JOIN (VALUES ('simple'), ('expert')) t(tier) LEFT JOIN key_preds p ON p.doc_id = m.doc_id AND p.field = m.field AND p.period_type = m.period_type) GROUP BY tier""")
def eva21(spark, sf):
    p = load(spark, sf, "key_preds")
    preds = p.select(*key.KEY, "value", "flagged", F.lit("simple").alias("tier")).unionByName(p.where("fno % 2 = 0").select(*key.KEY, "value", "flagged", F.lit("expert").alias("tier")))
    return key.not_applicable_totals(key.not_applicable(load(spark, sf, "key_manual"), preds, ["simple", "expert"]), ["simple", "expert"])


view("o_candidates", """SELECT doc_id, field, period_type, 'verified' AS source, v * 1000.0 AS value, 'USD' AS currency, CASE WHEN fno % 2 = 1 THEN 'derived: ' || v || ' - 7 thousands' ELSE v || ' thousands' END AS label, CAST(v AS STRING) AS raw FROM figures WHERE field <> 'eps_basic'
  UNION ALL SELECT doc_id, field, period_type, 'answer', CASE WHEN v % 3 = 0 THEN v * 1001.0 ELSE v * 1000.0 END, 'USD', v || ' USD', CAST(v AS STRING) FROM figures WHERE field <> 'eps_basic' UNION ALL SELECT doc_id, field, period_type, 'key', v * 1000.0 + 5000, 'USD', NULL, NULL FROM figures WHERE fno < 3
  UNION ALL SELECT doc_id, field, period_type, 'reference', value, currency, NULL, NULL FROM facts WHERE field <> 'eps_basic' AND doc_id NOT IN (SELECT doc_id FROM filings WHERE nk % 3 = 0)""")


def candidate_rows(spark, sf):
    f = load(spark, sf, "figures").withColumn("text", F.col("v").cast("string"))
    part = lambda sign, raw: F.struct(F.lit(sign).alias("sign"), raw.alias("raw_value"), F.lit("thousands").alias("raw_unit"))
    odd = F.col("fno") % 2 == 1
    verified = f.select(*key.KEY, (F.col("v") * 1000.0).alias("value"), F.lit("USD").alias("currency"), F.when(~odd, F.col("text")).alias("raw_value"), F.lit("thousands").alias("raw_unit"), F.when(odd, "derived").otherwise("reported").alias("derivation"), F.when(odd, F.array(part(1, F.col("text")), part(-1, F.lit("(7)")))).alias("components"))
    answers = f.select(*key.KEY, (F.col("v") * F.when(F.col("v") % 3 == 0, 1001.0).otherwise(1000.0)).alias("value"), F.lit("USD").alias("currency"), F.col("text").alias("raw_value"), F.lit("").alias("raw_unit"), F.lit("USD").alias("raw_currency"))
    keyed_ = f.where("fno < 3").select(*key.KEY, (F.col("v") * 1000.0 + 5000).alias("truth"), F.lit("USD").alias("currency"))
    return key.candidates(verified, answers, keyed_, load(spark, sf, "facts"), load(spark, sf, "filings").where("nk % 3 = 0"), ["revenue", "net_income_parent", "cost_of_revenue", "operating_cash_flow"])


@query("eva23_candidates", "SELECT doc_id, field, period_type, source, round(value, 2) AS value, currency, label, raw FROM o_candidates")
def eva23(spark, sf):
    return candidate_rows(spark, sf).withColumn("value", F.round("value", 2))


#: Within one percent with the same digits: the answer's v * 1001 joins v * 1000; other values join when they are equal.
view("o_merged", """SELECT doc_id, field, period_type, lead AS value, count(*) AS votes FROM (SELECT *, CASE WHEN source = 'answer' AND (SELECT count(*) FROM o_candidates b WHERE b.doc_id = a.doc_id AND b.field = a.field AND b.period_type = a.period_type AND b.raw = a.raw AND b.source = 'verified' AND abs(a.value - b.value) <= 0.01 * abs(b.value)) > 0
  THEN (SELECT min(b.value) FROM o_candidates b WHERE b.doc_id = a.doc_id AND b.field = a.field AND b.period_type = a.period_type AND b.raw = a.raw AND b.source = 'verified') ELSE value END AS lead FROM o_candidates a) GROUP BY doc_id, field, period_type, lead""")


@query("eva24_merged_by_digits", "SELECT doc_id, field, period_type, round(value, 2) AS value, votes::BIGINT AS votes FROM o_merged")
def eva24(spark, sf):
    return key.merged(candidate_rows(spark, sf)).select(*key.KEY, F.round("value", 2).alias("value"), "votes")


@query("eva26_review_order", """SELECT doc_id, field, period_type, n::BIGINT AS n, agree, row_number() OVER (PARTITION BY doc_id ORDER BY NOT agree, list_position(['revenue', 'net_income_parent', 'cost_of_revenue', 'operating_cash_flow'], field), field, period_type)::INT AS place
  FROM (SELECT doc_id, field, period_type, count(*) AS n, count(*) = 1 AND max(votes) > 1 AS agree FROM o_merged GROUP BY ALL)""")
def eva26(spark, sf):
    return key.review_order(key.merged(candidate_rows(spark, sf)), ["revenue", "net_income_parent", "cost_of_revenue", "operating_cash_flow"])


@query("eva27_values_in_text", r"""WITH tokens AS (SELECT DISTINCT o_custkey % 50 AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN format('{:,}', floor(o_totalprice)::BIGINT) WHEN 1 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE format('{:,}', floor(o_totalprice)::BIGINT) || '.0' END AS token FROM orders),
  ways AS (SELECT DISTINCT o_custkey % 50 AS doc_id, o_orderkey AS ord, unnest([format('{:,}', v), v::VARCHAR, format('{:,}', v) || '.0', v::VARCHAR || '.0']) AS token FROM (SELECT *, floor(o_totalprice)::BIGINT AS v FROM orders))
  SELECT o.o_orderkey AS ord, coalesce(string_agg(DISTINCT w.token, '|' ORDER BY w.token), '') AS found_as FROM orders o LEFT JOIN (SELECT w.* FROM ways w JOIN tokens t ON t.doc_id = w.doc_id AND t.token = w.token) w ON w.ord = o.o_orderkey GROUP BY o.o_orderkey""")
def eva27(spark, sf):
    o = read(spark, sf, "SELECT o_custkey % 50 AS doc_id, o_orderkey AS ord, floor(o_totalprice) AS v FROM orders")
    text = F.when(F.col("ord") % 3 == 0, F.format_number("v", 0)).when(F.col("ord") % 3 == 1, F.col("v").cast("string")).otherwise(F.format_number("v", 1))
    pages = o.select("doc_id", F.concat(F.lit("Paid "), text, F.lit(" in 2,5")).alias("text"))
    out = key.found_as(o.select("doc_id", "ord", F.col("v").cast("double").alias("value")), key.page_tokens(pages), [1.0], 2)
    return out.select("ord", F.array_join(F.array_sort("found_as"), "|").alias("found_as"))


@query("eva30_manual_key", """SELECT f.doc_id, f.field, f.period_type, CASE f.v % 3 WHEN 0 THEN 'na' WHEN 1 THEN 'edit' ELSE 'pick' END AS decision, f.v % 3 = 0 AS na, CASE f.v % 3 WHEN 1 THEN '9' WHEN 2 THEN (f.v * 1000)::VARCHAR END AS raw_value, CASE f.v % 3 WHEN 1 THEN 'thousands' WHEN 2 THEN '元' END AS raw_unit, CASE WHEN f.v % 3 = 2 THEN round(coalesce(half, 5e-6 * f.v * 1000), 6) END AS tol,
  CASE WHEN f.fno = 1 THEN 'seen' WHEN f.v % 3 = 2 THEN 'candidate ' || f.fno END AS note FROM figures f LEFT JOIN o_printed p ON p.doc_id = f.doc_id AND p.field = f.field AND p.value = f.v * 1000.0""")
def eva30(spark, sf):
    f = load(spark, sf, "figures")
    m = F.col("v") % 3
    d = f.select(*key.KEY, F.when(m == 0, "na").when(m == 1, "edit").otherwise("pick").alias("decision"), (F.col("v") * 1000.0).alias("value"), F.lit("9").alias("raw_value"), F.lit("thousands").alias("raw_unit"), F.lit("USD").alias("currency"), F.col("fno").alias("candidate"), F.when(F.col("fno") == 1, "seen").alias("comment"))
    own = key.manual_rows(d.withColumn("period_type", F.concat_ws(":", "period_type", "candidate")), load(spark, sf, "page_numbers"))
    return own.select("doc_id", "field", F.substring_index("period_type", ":", 1).alias("period_type"), "decision", "na", "raw_value", "raw_unit", F.round("tol", 6).alias("tol"), "note")
