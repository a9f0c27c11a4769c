"""Queries of the verification and consistency operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import consistency as con
from ..operators import verify as ver
from ..sources.store import materialise, new_path
from ..streaming.answers import current, verify_arriving
from .registry import query
from .views import load, read, view

view("page_rows", "SELECT doc_id, page, array_join(array_agg(line), '  ') AS text FROM lines GROUP BY doc_id, page")


def pages(spark, sf):
    own = load(spark, sf, "lines").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return materialise(ver.prepared_pages(own.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))), "pages")


def verified(spark, sf):
    return ver.verify(load(spark, sf, "claims"), pages(spark, sf), load(spark, sf, "facts"))


# the same chain in SQL, for the oracle only
view("o_pages", "SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page")
view("o_normal", """SELECT * REPLACE (CASE WHEN d IS NULL THEN period_type WHEN d <= 100 THEN 'Q' WHEN d BETWEEN 170 AND 190 THEN 'H' WHEN d BETWEEN 350 AND 371 THEN 'FY' ELSE 'YTD' END AS period_type)
  FROM (SELECT *, try_cast(period_end AS DATE) - try_cast(period_start AS DATE) + 1 AS d FROM claims)""")
view("o_kept", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field, period_type ORDER BY seq) AS nth FROM o_normal WHERE abs(try_cast(period_end AS DATE) - doc_end) <= 7) WHERE nth = 1""")
view("o_match", "SELECT doc_id, page, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM o_pages")
view("o_quotes", """SELECT c.doc_id, c.seq, arg_min(m.page, CASE WHEN m.page = c.page THEN 0 WHEN m.page = c.page - 1 THEN 1 ELSE 2 END) AS page_used
  FROM o_kept c JOIN o_match m ON m.doc_id = c.doc_id AND abs(m.page - c.page) <= 1
  WHERE quote <> '' AND contains(m.t, lower(regexp_replace(quote, '\\s+', '', 'g'))) GROUP BY c.doc_id, c.seq""")
view("o_numbers", "SELECT DISTINCT doc_id, page, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS number FROM o_pages")
view("o_units", """SELECT *, replace(replace(raw_value, '(', ''), ')', '') AS digits,
  CASE WHEN field = 'eps_basic' THEN CASE WHEN raw_unit <> 'widgets' THEN 1 END WHEN raw_unit LIKE 'in millions%' THEN 1000000 WHEN raw_unit LIKE 'in thousands%' THEN 1000 END AS mult,
  CASE WHEN raw_currency = 'USD' THEN 'USD' WHEN raw_currency = 'RMB' THEN 'CNY' WHEN raw_currency = 'HK$' THEN 'HKD' END AS cur FROM o_kept""")
view("o_values", """SELECT *, ((CASE WHEN raw_value LIKE '(%' THEN -1 ELSE 1 END) * digits::DECIMAL(24, 8))::DOUBLE * mult AS value,
  5 * power(10, -(CASE WHEN contains(digits, '.') THEN length(digits) - strpos(digits, '.') ELSE 0 END + 1)) * mult AS tolerance, mult IS NOT NULL AND cur IS NOT NULL AS c3 FROM o_units""")


@query("ver1_period_normalisation", """SELECT n.doc_id, n.seq, n.period_type, CASE WHEN n.period_type <> c.period_type THEN 'period ' || c.period_type || ' -> ' || n.period_type END AS period_note
  FROM o_normal n JOIN claims c ON n.doc_id = c.doc_id AND n.seq = c.seq""")
def ver1(spark, sf):
    return ver.normalise_periods(load(spark, sf, "claims")).select("doc_id", "seq", "period_type", "period_note")


@query("ver2_ver3_target_period_and_first_wins", """SELECT n.doc_id, n.seq, CASE WHEN abs(try_cast(n.period_end AS DATE) - n.doc_end) > 7 THEN 'period' WHEN k.seq IS NULL THEN 'duplicate' END AS dropped
  FROM o_normal n LEFT JOIN o_kept k ON n.doc_id = k.doc_id AND n.seq = k.seq""")
def ver2(spark, sf):
    return ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).select("doc_id", "seq", "dropped")


@query("ver4_ver7_exact_quotes_on_tried_pages", "SELECT doc_id, seq, page_used FROM o_quotes")
def ver4(spark, sf):
    return ver.exact_quotes(ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL"), pages(spark, sf))


view("o_all_quotes", """SELECT c.doc_id, c.seq, c.page, arg_min(m.page, CASE WHEN m.page = c.page THEN 0 WHEN m.page = c.page - 1 THEN 1 ELSE 2 END) FILTER (abs(m.page - c.page) <= 1) AS page_used, string_agg(m.page::VARCHAR, ',' ORDER BY m.page) FILTER (abs(m.page - c.page) > 1) AS far
  FROM claims c JOIN o_match m ON m.doc_id = c.doc_id AND quote <> '' AND contains(m.t, lower(regexp_replace(quote, '\\s+', '', 'g'))) GROUP BY c.doc_id, c.seq, c.page""")


#: No quote of these claims is in pieces or nearly right; such cases are in the printed quotes below and in the tests.
@query("ver5_ver6_ver8_quote_check", """SELECT c.doc_id, c.seq, q.page_used IS NOT NULL AS c1, q.page_used, CASE WHEN q.page_used IS NOT NULL THEN 1.0 END AS quote_ratio, coalesce(q.page_used <> c.page, false) AS page_off, CASE WHEN q.page_used IS NULL THEN q.far END AS other_pages FROM claims c LEFT JOIN o_all_quotes q ON q.doc_id = c.doc_id AND q.seq = c.seq""")
def ver5(spark, sf):
    return ver.check_quotes(load(spark, sf, "claims"), pages(spark, sf)).select("doc_id", "seq", "c1", "page_used", F.round("quote_ratio", 6).alias("quote_ratio"), "page_off", F.array_join(F.col("other_pages").cast("array<string>"), ",").alias("other_pages"))


@query("ver9_ver11_number_check", """SELECT c.doc_id, c.seq, n.number IS NOT NULL AS c2, coalesce(a.pages, '') AS number_pages FROM
  (SELECT u.*, coalesce(page_used, page) AS at_page FROM o_units u LEFT JOIN o_quotes q ON q.doc_id = u.doc_id AND q.seq = u.seq) c
  LEFT JOIN o_numbers n ON n.doc_id = c.doc_id AND n.page = c.at_page AND n.number = c.digits
  LEFT JOIN (SELECT u.doc_id, u.seq, string_agg(n.page::VARCHAR, ',' ORDER BY n.page) AS pages FROM o_units u LEFT JOIN o_quotes q ON q.doc_id = u.doc_id AND q.seq = u.seq
    JOIN o_numbers n ON n.doc_id = u.doc_id AND n.number = u.digits AND n.page <> coalesce(q.page_used, u.page) GROUP BY u.doc_id, u.seq) a ON a.doc_id = c.doc_id AND a.seq = c.seq""")
def ver9(spark, sf):
    kept = ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL")
    p = pages(spark, sf)
    asked = kept.join(ver.exact_quotes(kept, p), ["doc_id", "seq"], "left")
    return ver.check_numbers(asked, p).select("doc_id", "seq", "c2", F.coalesce(F.array_join(F.col("number_pages").cast("array<string>"), ","), F.lit("")).alias("number_pages"))


@query("ver10_split_numbers", """SELECT doc_id, line_no AS seq, NOT regexp_matches(line, '(^|[^0-9.])' || v || '($|[^0-9.])') AND contains(replace(line, ' ', ''), v) AS split FROM (
  SELECT f.doc_id, fno AS line_no, fno % 2 AS odd, v::VARCHAR AS v, CASE WHEN fno % 2 = 1 THEN 'Row ' || left(v::VARCHAR, 1) || ' ' || substr(v::VARCHAR, 2) ELSE 'Row ' || v::VARCHAR END AS line FROM figures f)""")
def ver10(spark, sf):
    own = load(spark, sf, "figures").withColumn("s", F.col("v").cast("string"))
    line = F.concat(F.lit("Row "), F.when(F.col("fno") % 2 == 1, F.concat(F.substring("s", 1, 1), F.lit(" "), F.substring("s", 2, 99))).otherwise(F.col("s")))
    p = ver.prepared_pages(own.select("doc_id", F.col("fno").alias("page"), line.alias("text")))
    c = own.select("doc_id", F.col("fno").alias("seq"), F.col("fno").alias("page"), F.lit(None).cast("int").alias("page_used"), F.col("s").alias("raw_value"))
    return ver.check_numbers(c, p).select("doc_id", "seq", "split")


@query("ver12_units_and_values", "SELECT doc_id, seq, round(value, 2) AS value, CASE WHEN mult IS NULL THEN NULL ELSE mult::DOUBLE END AS mult, round(tolerance, 6) AS tolerance, cur AS currency, c3 FROM o_values")
def ver12(spark, sf):
    kept = ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL")
    return ver.check_units(kept).select("doc_id", "seq", F.round("value", 2).alias("value"), "mult", F.round("tolerance", 6).alias("tolerance"), "currency", "c3")


view("o_pairs", """SELECT v.doc_id, v.seq, v.value, v.tolerance, f.value AS r, f.ord, f.period_type = v.period_type AS mine FROM o_values v JOIN facts f ON f.doc_id = v.doc_id AND f.field = v.field
  WHERE c3 AND abs(f.period_end - try_cast(v.period_end AS DATE)) <= 7 AND (f.currency IS NULL OR f.currency = v.cur)""")
view("o_refs", "SELECT doc_id, seq, arg_min(r, ord) FILTER (mine) AS ref_value, bool_or(NOT mine AND abs(value - r) <= tolerance + 1e-9 * abs(r)) AS other_type FROM o_pairs GROUP BY doc_id, seq")
view("o_probe", """SELECT v.doc_id, arg_min(abs(e.r / v.value - 1) > 0.02, v.seq) AS unusable FROM o_values v JOIN (SELECT doc_id, period_type, arg_min(value, ord) AS r FROM facts WHERE field = 'eps_basic' GROUP BY ALL) e
  ON e.doc_id = v.doc_id AND e.period_type = v.period_type WHERE v.market = 'hk' AND v.field = 'eps_basic' AND c3 AND v.value <> 0 AND e.r <> 0 GROUP BY v.doc_id""")


@query("ver16_eps_probe", "SELECT * FROM o_probe")
def ver16(spark, sf):
    kept = ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL")
    return ver.eps_probe(ver.check_units(kept), load(spark, sf, "facts"))


view("o_states", """SELECT doc_id, seq, state, ref_value, CASE WHEN state <> 'mismatch' THEN NULL WHEN other_type THEN 'PERIOD'
  WHEN ref_value <> 0 AND len(list_filter([3, 4, 6, 8, -3, -4, -6, -8], lambda k: abs(value * power(10, k) - ref_value) <= abs(ref_value) * 1e-6 + tolerance * power(10, k) + 1e-9 * abs(ref_value))) > 0 THEN 'UNIT' ELSE 'DEFINITION' END AS ref_category
  FROM (SELECT v.doc_id, v.seq, v.value, v.tolerance, r.ref_value, r.other_type, CASE WHEN NOT c3 OR r.ref_value IS NULL THEN 'none' WHEN coalesce(p.unusable, false) THEN 'invalid'
    WHEN abs(v.value - r.ref_value) <= v.tolerance + 1e-9 * abs(r.ref_value) THEN 'match' ELSE 'mismatch' END AS state
  FROM o_values v LEFT JOIN o_refs r ON r.doc_id = v.doc_id AND r.seq = v.seq LEFT JOIN o_probe p ON p.doc_id = v.doc_id)""")


@query("ver17_ver18_ver19_reference_check", "SELECT doc_id, seq, state, round(ref_value, 2) AS ref_value, ref_category FROM o_states")
def ver17(spark, sf):
    kept = ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL")
    return ver.check_references(ver.check_units(kept), load(spark, sf, "facts")).select("doc_id", "seq", "state", F.round("ref_value", 2).alias("ref_value"), "ref_category")


view("o_checked", """SELECT v.*, q.page_used, q.page_used IS NOT NULL AS c1, q.far, coalesce(q.page_used, v.page) AS at_page, EXISTS (SELECT 1 FROM o_numbers n WHERE n.doc_id = v.doc_id AND n.page = coalesce(q.page_used, v.page) AND n.number = v.digits) AS c2,
  EXISTS (SELECT 1 FROM o_numbers n WHERE n.doc_id = v.doc_id AND n.page <> coalesce(q.page_used, v.page) AND n.number = v.digits) AS away FROM o_values v LEFT JOIN o_all_quotes q ON q.doc_id = v.doc_id AND q.seq = v.seq""")
view("o_verified", """SELECT c.*, s.state, s.ref_value, s.ref_category, CASE WHEN NOT c2 AND NOT away THEN 'FABRICATED' WHEN NOT c3 THEN 'UNIT' WHEN NOT c1 AND far IS NOT NULL THEN 'WRONG_PAGE' WHEN NOT c2 THEN 'WRONG_PAGE' WHEN NOT c1 THEN 'PARAPHRASED' END AS own FROM o_checked c JOIN o_states s ON s.doc_id = c.doc_id AND s.seq = c.seq""")


#: No number of these claims is split by white space; the tests have such ones.
@query("ver13_ver21_verified", """SELECT doc_id, seq, field, period_type, c1, c2, c3, state, CASE WHEN NOT (c1 AND c2 AND c3) OR state = 'mismatch' THEN 'BAD' WHEN state = 'match' THEN 'OK' ELSE 'FOUND' END AS status, coalesce(own, ref_category) AS category, page_used, round(value, 2) AS value, round(ref_value, 2) AS ref_value FROM o_verified""")
def ver21(spark, sf):
    return verified(spark, sf).select("doc_id", "seq", "field", "period_type", "c1", "c2", "c3", "state", "status", "category", "page_used", F.round("value", 2).alias("value"), F.round("ref_value", 2).alias("ref_value"))


@query("slice_found_where_claimed", """SELECT contains(lower(regexp_replace(d.text, '\\s+', '', 'g')), lower(regexp_replace(b.text, '\\s+', '', 'g'))) AS quote_found, count(*)::BIGINT AS n
  FROM benchmark b CROSS JOIN documents d GROUP BY 1""")
def slice_(spark, sf):
    """How many (quote, document) pairs match: the stated set of quotes, in blocks, against all documents."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return ver.passages_found(read(spark, sf, "SELECT text FROM documents").select(plain("text").alias("text")), read(spark, sf, "SELECT text FROM benchmark").select(plain("text").alias("text")))


view("printed_quotes", """SELECT o_orderkey AS doc_id, CAST(o_custkey AS STRING) AS n, CAST(o_orderkey % 5 AS INT) AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'Revenue $ ' || CAST(o_custkey AS STRING) || ' of Ｔotal' WHEN 1 THEN 'Revenue' || chr(10) || 'notes' || chr(10) || CAST(o_custkey AS STRING) || ' in all' WHEN 2 THEN 'Ｒｅｖｅｎｕｅ  US$' || CAST(o_custkey AS STRING) ELSE 'Cover' END AS one,
  CASE o_orderkey % 5 WHEN 3 THEN 'Revenue － £' || CAST(o_custkey AS STRING) ELSE 'Nothing' END AS five FROM orders""")
view("o_printed_pages", r"""SELECT doc_id, page, regexp_replace(lower(regexp_replace(translate(text, 'ＴＲｅｖｎｕ－', 'TRevnu-'), '\s+', '', 'g')), '(us|hk|nt|a|c|s)?\$|[¥￥€£]', '', 'g') AS t, n, kind FROM (SELECT doc_id, 1 AS page, one AS text, n, kind FROM printed_quotes UNION ALL SELECT doc_id, 5, five, n, kind FROM printed_quotes)""")


@query("ver4_ver8_printed_quotes", """SELECT p.doc_id, contains(t, q) OR kind = 1 AND contains(t, 'revenue') AND contains(t, n || 'inall') AS c1, CASE WHEN contains(t, q) THEN 1.0 WHEN kind = 1 AND contains(t, 'revenue') AND contains(t, n || 'inall') THEN 0.99 END AS quote_ratio, CASE WHEN EXISTS (SELECT 1 FROM o_printed_pages f WHERE f.doc_id = p.doc_id AND f.page = 5 AND contains(f.t, q)) THEN '5' END AS other_pages
  FROM (SELECT *, CASE kind WHEN 1 THEN 'revenue' || n || 'inall' WHEN 3 THEN 'revenue-' || n WHEN 4 THEN 'qqqq' || n || 'zzzz' ELSE 'revenue' || n END AS q FROM o_printed_pages WHERE page = 1) p""")
def ver4_printed(spark, sf):
    """Signs, full-width letters, quotes in pieces and on far pages."""
    p = load(spark, sf, "printed_quotes")
    pages_ = p.select("doc_id", F.lit(1).alias("page"), F.col("one").alias("text")).unionByName(p.select("doc_id", F.lit(5).alias("page"), F.col("five").alias("text")))
    k = F.col("kind")
    quote = F.when(k == 1, F.concat(F.lit("Revenue "), "n", F.lit(" in all"))).when(k == 2, F.concat(F.lit("Revenue ￥"), "n")).when(k == 3, F.concat(F.lit("Revenue - "), "n")).when(k == 4, F.concat(F.lit("qqqq"), "n", F.lit("zzzz"))).otherwise(F.concat(F.lit("Revenue $"), "n"))
    claims = p.select("doc_id", F.lit(1).alias("seq"), F.lit(1).alias("page"), quote.alias("quote"))
    prepared = materialise(ver.prepared_pages(pages_), "printed-pages")
    return ver.check_quotes(claims, prepared).select("doc_id", "c1", F.round("quote_ratio", 6).alias("quote_ratio"), F.array_join(F.col("other_pages").cast("array<string>"), ",").alias("other_pages"))


@query("ver14_derived_components", """SELECT doc_id, 1 AS seq, sum(CASE WHEN fno = 3 THEN -1 ELSE 1 END * v)::DOUBLE AS value, (count(*) * 0.5)::DOUBLE AS tolerance, CASE WHEN count(DISTINCT cur) = 1 THEN min(cur) END AS currency,
  bool_and(v > 10) AS c1, bool_and(v > 20) AS c2, bool_and(v > 30) AS c3 FROM (SELECT *, CASE WHEN v % 3 = 0 OR market = 'us' THEN 'USD' ELSE 'CNY' END AS cur FROM figures) GROUP BY doc_id""")
def ver14(spark, sf):
    f = load(spark, sf, "figures")
    parts = f.select("doc_id", F.lit(1).alias("seq"), F.when(F.col("fno") == 3, -1).otherwise(1).alias("sign"), F.col("v").cast("double").alias("value"), F.lit(0.5).alias("tolerance"), F.when((F.col("v") % 3 == 0) | (F.col("market") == "us"), "USD").otherwise("CNY").alias("currency"), (F.col("v") > 10).alias("c1"), (F.col("v") > 20).alias("c2"), (F.col("v") > 30).alias("c3"))
    return ver.derived_items(parts)


@query("ver15_derived_gross_profit", """SELECT r.doc_id, r.period_type, round(r.value - abs(c.value), 2) AS value, round(c.value, 2) AS cost_used FROM
  (SELECT doc_id, period_type, arg_min(value, seq) AS value FROM o_values WHERE field = 'revenue' AND value IS NOT NULL AND template = 'general' GROUP BY ALL) r
  JOIN (SELECT doc_id, period_type, arg_min(value, seq) AS value FROM o_values WHERE field = 'cost_of_revenue' AND value IS NOT NULL AND template = 'general' GROUP BY ALL) c
  ON r.doc_id = c.doc_id AND r.period_type = c.period_type""")
def ver15(spark, sf):
    kept = ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL")
    return ver.derived_gross_profit(ver.check_units(kept)).select("doc_id", "period_type", F.round("value", 2).alias("value"), F.round("cost_used", 2).alias("cost_used"))


view("o_filing_cum", "SELECT *, CASE q WHEN 1 THEN 'Q' WHEN 2 THEN 'H' WHEN 3 THEN 'YTD' ELSE 'FY' END AS cum FROM filings")
view("o_required", """SELECT 'general' AS template, unnest(['revenue', 'net_income_parent', 'eps_basic', 'operating_cash_flow']) AS field
  UNION ALL SELECT 'bank', unnest(['revenue', 'net_income_parent', 'eps_basic', 'operating_cash_flow', 'net_interest_income', 'ppop'])
  UNION ALL SELECT 'insurance', unnest(['revenue', 'net_income_parent', 'eps_basic', 'operating_cash_flow'])""")
view("o_expected", """SELECT doc_id, field, cum AS period_type FROM o_filing_cum JOIN o_required USING (template)
  UNION SELECT f.doc_id, f.field, f.period_type FROM facts f JOIN filings d ON d.doc_id = f.doc_id WHERE abs(f.period_end - d.period_end) <= 7 AND f.field IN ('revenue', 'net_income_parent', 'eps_basic', 'operating_cash_flow')
  UNION SELECT d.doc_id, unnest(['revenue', 'net_income_parent', 'eps_basic']), 'Q' FROM o_filing_cum d
  WHERE cum <> 'Q' AND (SELECT count(DISTINCT period_type) FROM figures g WHERE g.doc_id = d.doc_id AND g.field = 'revenue' AND g.v > 5000) = 2""")


def _asked(spark, sf):
    seen = load(spark, sf, "figures").where("field = 'revenue' AND v > 5000").select("doc_id", "field", "period_type", F.lit(True).alias("c2"), F.lit(2).alias("at"))
    docs = load(spark, sf, "filings").select("doc_id", "period", "period_end", "template")
    return ver.expected_pairs(seen, load(spark, sf, "facts"), docs)


@query("ver22_expected_pairs", "SELECT * FROM o_expected")
def ver22(spark, sf):
    return _asked(spark, sf)


@query("ver23_missing_rows", """SELECT e.doc_id, e.field, e.period_type, (SELECT arg_min(value, ord) FROM facts f WHERE f.doc_id = e.doc_id AND f.field = e.field AND f.period_type = e.period_type) AS ref_value, 'BAD' AS status, 'MISSING' AS category
  FROM o_expected e WHERE NOT EXISTS (SELECT 1 FROM o_kept k WHERE k.doc_id = e.doc_id AND k.field = e.field AND k.period_type = e.period_type)""")
def ver23(spark, sf):
    kept = ver.dedup(ver.normalise_periods(load(spark, sf, "claims"))).where("dropped IS NULL")
    return ver.missing_rows(_asked(spark, sf), kept, load(spark, sf, "facts"))


@query("ver20_parent_reclassification", """SELECT doc_id, CASE WHEN abs(common - ref) <= 0.5 + 1e-9 * abs(ref) THEN 'DEFINITION' ELSE 'UNIT' END AS category FROM (SELECT doc_id, rev::DOUBLE AS ref, rev * CASE WHEN (nk + q) % 3 = 0 THEN 1.0 ELSE 3.0 END AS common FROM filings)""")
def ver20(spark, sf):
    d = load(spark, sf, "filings")
    parent = d.select("doc_id", F.lit("Q").alias("period_type"), F.lit(1).alias("seq"), F.lit("net_income_parent").alias("field"), F.lit("mismatch").alias("state"), (F.col("rev") * 2.0).alias("value"), F.col("rev").cast("double").alias("ref_value"), F.lit(0.5).alias("tolerance"), F.lit("UNIT").alias("category"))
    common = d.select("doc_id", F.lit("Q").alias("period_type"), F.lit(2).alias("seq"), F.lit("net_income_common").alias("field"), F.lit("none").alias("state"), F.when((F.col("nk") + F.col("q")) % 3 == 0, F.col("rev") * 1.0).otherwise(F.col("rev") * 3.0).alias("value"), F.lit(None).cast("double").alias("ref_value"), F.lit(0.5).alias("tolerance"), F.lit(None).cast("string").alias("category"))
    return ver.reclassify_parent(parent.unionByName(common)).where("field = 'net_income_parent'").select("doc_id", "category")


view("owner_claims", """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CASE WHEN max(l_partkey) % 2 = 0 THEN 'net_income_parent' ELSE 'net_income_common' END AS field, CASE WHEN l_linenumber < 5 THEN 'Q' ELSE 'FY' END AS period_type, CASE WHEN max(l_suppkey) % 4 = 0 THEN 'none' ELSE 'mismatch' END AS state,
  CASE WHEN max(l_suppkey) % 5 > 0 THEN CAST(round(max(l_discount) * 50) AS DOUBLE) END AS value, CASE WHEN max(l_suppkey) % 7 > 0 THEN CAST(round(max(l_tax) * 50) AS DOUBLE) + 0.25 END AS ref_value, CASE WHEN max(l_partkey) % 3 = 0 THEN 0.25 ELSE 0.125 END AS tolerance, CASE max(l_partkey) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SIGN' ELSE 'UNIT' END AS category FROM lineitem GROUP BY l_orderkey, l_linenumber""")


@query("ver20_owner_definitions", """SELECT r.doc_id, r.seq, CASE WHEN field = 'net_income_parent' AND state = 'mismatch' AND abs(common - ref_value) <= tolerance + 1e-9 * abs(ref_value) THEN 'DEFINITION' ELSE category END AS category FROM owner_claims r
  LEFT JOIN (SELECT doc_id, period_type, arg_min(value, seq) AS common FROM owner_claims WHERE field = 'net_income_common' AND value IS NOT NULL GROUP BY ALL) c ON c.doc_id = r.doc_id AND c.period_type = r.period_type""")
def ver20_owners(spark, sf):
    return ver.reclassify_parent(load(spark, sf, "owner_claims")).select("doc_id", "seq", "category")


@query("ver24_industry_metrics", """SELECT doc_id, 'industry:orders' AS field, CASE WHEN list_contains(regexp_extract_all(text, '[0-9]+'), raw) THEN 'FOUND' ELSE 'BAD' END AS status FROM (SELECT doc_id, 'Orders handled: ' || n || ' accounts' AS text, (CASE WHEN nk % 3 = 0 THEN n + 1 ELSE n END)::VARCHAR AS raw FROM filings)""")
def ver24(spark, sf):
    d = load(spark, sf, "filings")
    text = F.concat(F.lit("Orders handled: "), F.col("n").cast("string"), F.lit(" accounts"))
    p = ver.prepared_pages(d.select("doc_id", F.lit(1).alias("page"), text.alias("text")))
    m = d.select("doc_id", "market", F.lit(1).alias("seq"), F.lit("orders").alias("field"), F.when(F.col("nk") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")).cast("string").alias("raw_value"), F.lit("accounts").alias("raw_unit"), F.lit("").alias("raw_currency"), F.lit(1).alias("page"), text.alias("quote"))
    return ver.industry_metrics(m, p).select("doc_id", "field", "status")


@query("ver25_ver26_predictions", """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'not_disclosed' WHEN turn % 4 = 2 THEN 'parser_error' ELSE 'answered' END AS outcome, CASE WHEN turn % 4 < 2 THEN (conv_id + 100)::DOUBLE * 1000000 END AS value FROM conversations""")
def ver26(spark, sf):
    c = read(spark, sf, "SELECT conv_id, turn, text FROM conversations")
    said = F.concat(F.lit("It was "), F.when(F.col("turn") % 4 == 2, F.col("conv_id") + 990000001).otherwise(F.col("conv_id") + 100).cast("string"), F.lit(" million dollars."))
    rows = c.select("conv_id", "turn", F.lit("revenue").alias("field"), F.when(F.col("turn") % 4 == 3, "not_disclosed").otherwise("answered").alias("status"), (F.col("conv_id") + 100).cast("string").alias("raw_value"), F.lit("million").alias("raw_unit"), F.lit("USD").alias("raw_currency"), F.lit("us").alias("market"), said.alias("answer"))
    return ver.predictions(rows).select("conv_id", "turn", "outcome", "value")


#: Answers print a number among others; what was read from them is the whole number, a part of it, another one or none.
view("read_answers", """SELECT o_orderkey, 'In ' || CAST(year(o_orderdate) AS STRING) || ' it was ' || CASE o_custkey % 3 WHEN 0 THEN CAST(n AS STRING) WHEN 1 THEN CAST(n AS STRING) || '.' || CAST(o_custkey % 90 + 10 AS STRING) ELSE CAST(CAST(floor(n / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(n % 1000 AS STRING), 3, '0') END || CASE o_custkey % 2 WHEN 0 THEN ' million dollars.' ELSE '% up, 7 more.' END AS answer,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(CAST(floor(n / 10) AS BIGINT) AS STRING) WHEN 2 THEN CAST(n AS STRING) || '.' || CAST(o_custkey % 90 + 10 AS STRING) WHEN 3 THEN '(' || CAST(n AS STRING) || ')' WHEN 4 THEN CAST(CAST(floor(n / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(n % 1000 AS STRING), 3, '0') WHEN 5 THEN CAST(year(o_orderdate) AS STRING) ELSE 'about ' || CAST(n AS STRING) END AS raw_value,
  CASE o_orderstatus WHEN 'P' THEN 'ambiguous' ELSE 'answered' END AS status FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")


@query("ver25_ver26_read_answers", r"""WITH t AS (SELECT *, nullif(regexp_extract(regexp_replace(raw_value, '[, ]', '', 'g'), '\d+(\.\d+)?'), '') AS digits,
  list_transform(regexp_extract_all(regexp_replace(answer, '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '[0-9.]+'), lambda x: rtrim(x, '.')) AS numbers FROM read_answers), o AS (SELECT *, CASE WHEN status <> 'answered' THEN status WHEN coalesce(list_contains(numbers, digits), false) THEN 'answered' ELSE 'parser_error' END AS outcome FROM t)
  SELECT o_orderkey, outcome, round(CASE WHEN outcome = 'answered' THEN digits::DOUBLE * CASE WHEN starts_with(raw_value, '(') THEN -1 ELSE 1 END * 1000000 END, 2) AS value FROM o""")
def ver26_read(spark, sf):
    a = load(spark, sf, "read_answers")
    rows = a.select("o_orderkey", F.lit("revenue").alias("field"), "status", "raw_value", F.lit("million").alias("raw_unit"), F.lit("USD").alias("raw_currency"), F.lit("us").alias("market"), "answer")
    return ver.predictions(rows).select("o_orderkey", "outcome", F.round("value", 2).alias("value"))


@query("ver28_recomputed", """SELECT *, CASE WHEN abs(value - recomputed) > 0.5 + 0.5 + 1e-9 * abs(value) THEN 'BAD' ELSE 'OK' END AS status FROM (SELECT doc_id, 1 AS seq, rev::DOUBLE AS value, (rev + nk % 4 * 0.5)::DOUBLE AS recomputed FROM filings)""")
def ver28(spark, sf):
    d = load(spark, sf, "filings")
    own = d.select("doc_id", F.lit(1).alias("seq"), F.col("rev").cast("double").alias("value"), F.lit(0.5).alias("tolerance"), F.lit("OK").alias("status"))
    parts = d.select("doc_id", F.lit(1).alias("seq"), (F.col("rev") + F.col("nk") % 4 * 0.5).cast("double").alias("value"), F.lit(0.5).alias("tolerance"))
    return ver.recomputed(own, parts).select("doc_id", "seq", "value", "recomputed", "status")


@query("ver29_no_source", """SELECT doc_id, seq, CASE WHEN seq % 3 = 0 OR p = 9 THEN 'BAD' ELSE 'OK' END AS status, CASE WHEN seq % 3 = 0 OR p = 9 THEN 'NO_SOURCE' END AS category FROM claims""")
def ver29(spark, sf):
    c = load(spark, sf, "claims").select("doc_id", "seq", F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("page")).alias("page"), F.when(F.col("p") == 9, " ").otherwise(F.col("quote")).alias("quote"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("category"))
    return ver.mark_no_source(c).select("doc_id", "seq", "status", "category")


@query("ver30_follow_up", """SELECT doc_id, field, period_type, CASE WHEN seq >= 4 THEN 2 ELSE 1 END AS round, c1, c2, c3, state, CASE WHEN NOT (c1 AND c2 AND c3) OR state = 'mismatch' THEN 'BAD' WHEN state = 'match' THEN 'OK' ELSE 'FOUND' END AS status, coalesce(own, ref_category) AS category,
  CASE WHEN EXISTS (SELECT 1 FROM claims s WHERE s.seq >= 4 AND s.doc_id = v.doc_id AND s.field = v.field AND s.period_type = v.period_type) THEN 'follow-up' END AS note FROM o_verified v""")
def ver30(spark, sf):
    """Claims 4 and up come in the second round, to questions about their pairs; the first round is verified and stored before."""
    c, p, facts = load(spark, sf, "claims"), pages(spark, sf), load(spark, sf, "facts")
    first, second = c.where("seq < 4"), c.where("seq >= 4")
    stored = materialise(ver.verify(first, p, facts), "first-round")
    out = ver.verify_follow_up(stored, ver.follow_up(first, second, second), second, p, facts)
    return out.select("doc_id", "field", "period_type", "round", "c1", "c2", "c3", "state", "status", "category", "note")


def _items(spark, sf):
    """Quarter items with invented gross profit, shares and ordinary income beside the figures."""
    d = load(spark, sf, "filings").crossJoin(F.broadcast(spark.sql("SELECT * FROM VALUES (1, 'revenue', 1.0), (2, 'gross_profit', 0.4), (3, 'ppop', 0.5), (4, 'net_income_parent', 0.1), (5, 'net_income_common', 0.09), (6, 'eps_basic', 0.01), (7, 'weighted_avg_shares_basic', 10.0) AS t(seq, field, share)")))
    value = F.col("rev") * F.col("share") * F.when((F.col("nk") + F.col("q") + F.col("seq")) % 6 == 0, 4.0).otherwise(1.0)
    return d.select("doc_id", "seq", "field", F.lit("Q").alias("period_type"), F.floor(value).cast("double").alias("value"), F.lit(0.5).alias("tolerance"), F.lit(3).alias("page_used"), F.lit("derived").alias("derivation"), F.when(F.col("nk") % 7 == 0, -1.0).otherwise(1.0).alias("cost_used"), F.lit("OK").alias("status"), "nk", "q", "rev")


view("o_items", """SELECT doc_id, seq, field, floor(rev * share * CASE WHEN (nk + q + seq) % 6 = 0 THEN 4.0 ELSE 1.0 END) AS value, nk FROM filings
  CROSS JOIN (VALUES (1, 'revenue', 1.0::DOUBLE), (2, 'gross_profit', 0.4), (3, 'ppop', 0.5), (4, 'net_income_parent', 0.1), (5, 'net_income_common', 0.09), (6, 'eps_basic', 0.01), (7, 'weighted_avg_shares_basic', 10.0)) t(seq, field, share)""")


@query("con1_con2_con3_con5_con7_rules", """SELECT doc_id, gp <= rev + 1 AS con1, nk % 7 <> 0 AS con1_cost, pp <= rev + 1 AS con2, CASE WHEN nk % 2 = 0 THEN ni - nc > 1 END AS con3, CASE WHEN nc <> 0 AND eps <> 0 THEN eps * sh / nc BETWEEN 0.5 AND 2.0 END AS con5,
  array_to_string(list_filter([CASE WHEN gp > rev + 1 THEN 'con1' END, CASE WHEN nk % 7 = 0 THEN 'con1_cost' END, CASE WHEN pp > rev + 1 THEN 'con2' END, CASE WHEN nk % 2 = 0 AND ni - nc <= 1 THEN 'con3' END, CASE WHEN nc <> 0 AND eps <> 0 AND NOT eps * sh / nc BETWEEN 0.5 AND 2.0 THEN 'con5' END], lambda x: x IS NOT NULL), ',') AS failed
  FROM (SELECT doc_id, any_value(nk) AS nk, max(value) FILTER (field = 'revenue') AS rev, max(value) FILTER (field = 'gross_profit') AS gp, max(value) FILTER (field = 'ppop') AS pp, max(value) FILTER (field = 'net_income_parent') AS ni,
    max(value) FILTER (field = 'net_income_common') AS nc, max(value) FILTER (field = 'eps_basic') AS eps, max(value) FILTER (field = 'weighted_avg_shares_basic') AS sh FROM o_items GROUP BY doc_id)""")
def con1(spark, sf):
    flags = con.rules(_items(spark, sf), pages(spark, sf))
    names = ["con1", "con1_cost", "con2", "con3", "con5"]
    return con.listed(flags, names).select("doc_id", *names, F.array_join("failed", ",").alias("failed"))


@query("con4_disclosed_totals", """SELECT doc_id, 2 AS seq, len(list_filter(numbers, lambda x: abs(x - value) <= 0.005 * abs(value) OR abs(x * 1e3 - value) <= 0.005 * abs(value) OR abs(x * 1e4 - value) <= 0.005 * abs(value) OR abs(x * 1e6 - value) <= 0.005 * abs(value) OR abs(x * 1e8 - value) <= 0.005 * abs(value) OR abs(x * 1e9 - value) <= 0.005 * abs(value))) > 0 AS con4
  FROM (SELECT doc_id, rev * CASE WHEN (nk + q) % 4 = 0 THEN 1.02 ELSE 1.001 END * 1000 AS value, list_slice(list_filter([1::DOUBLE * rev, n, 600, 700, 800, 900, 1000, 1100, 1200], lambda x: abs(x) >= 100), 1, 6) AS first, CASE WHEN nk % 2 = 0 THEN list_slice(list_filter([600, 700, 800, 900, n, 1000, 1::DOUBLE * rev], lambda x: abs(x) >= 100), 1, 6) ELSE first END AS numbers FROM filings) WHERE len(numbers) > 0""")
def con4(spark, sf):
    d = load(spark, sf, "filings")
    rev, n = F.format_number("rev", 0), F.format_number("n", 0)
    line = F.when(F.col("nk") % 2 == 0, F.concat(F.lit("Gross profit (12) 600 700 800 900 "), n, F.lit(" 1,000 "), rev)).otherwise(F.concat(F.lit("Gross profit (12) "), rev, F.lit(" "), n, F.lit(" 600 700 800 900 1,000 1,100 1,200")))
    p = d.select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("Revenue 1\n"), line).alias("text"))
    items = d.select("doc_id", F.lit(2).alias("seq"), F.lit("gross_profit").alias("field"), (F.col("rev") * F.when((F.col("nk") + F.col("q")) % 4 == 0, 1.02).otherwise(1.001) * 1000).alias("value"), F.lit("derived").alias("derivation"), F.lit("OK").alias("status"))
    return con.disclosed_totals(items, p)


@query("con6_quarter_sums", """SELECT doc_id, 'revenue' AS field, abs(rev + prior - rev_cum) <= 0.5 + 0.5 + 0.002 * abs(rev_cum) AS con6 FROM (SELECT doc_id, rev, rev_cum, (rev_cum - rev) * CASE WHEN nk % 5 = 0 THEN 1.01 WHEN nk % 5 = 1 THEN 1.001 ELSE 1 END AS prior FROM filings WHERE q > 1)""")
def con6(spark, sf):
    d = load(spark, sf, "filings").where("q > 1")
    row = lambda seq, kind, value: d.select("doc_id", F.lit(seq).alias("seq"), F.lit("revenue").alias("field"), F.lit(kind).alias("period_type"), value.cast("double").alias("value"), F.lit(0.5).alias("tolerance"))
    items = row(1, "Q", F.col("rev")).unionByName(row(2, "FY", F.col("rev_cum")))
    prior = d.select("doc_id", F.lit("revenue").alias("field"), F.col("year_start").alias("period_end"), ((F.col("rev_cum") - F.col("rev")) * F.when(F.col("nk") % 5 == 0, 1.01).when(F.col("nk") % 5 == 1, 1.001).otherwise(1.0)).alias("value"))
    return con.quarter_sums(items, prior)


_ = Window


@query("str2_verified_stream", "SELECT doc_id, seq, field, period_type, c1, c2, c3, state, CASE WHEN NOT (c1 AND c2 AND c3) OR state = 'mismatch' THEN 'BAD' WHEN state = 'match' THEN 'OK' ELSE 'FOUND' END AS status, coalesce(own, ref_category) AS category FROM o_verified")
def str2(spark, sf):
    """The claims in three arrivals, later ones first: a document's come in several micro-batches of one stream that stops and goes on."""
    claims, p, facts = load(spark, sf, "claims"), pages(spark, sf), load(spark, sf, "facts")
    came, out, state = (new_path(spark, name) for name in ("came", "stream", "progress"))
    for arrival in (2, 1, 0):
        claims.where((F.col("seq") >= 10).cast("int") + (F.col("seq") >= 4).cast("int") == arrival).write.mode("append").parquet(came)
        verify_arriving(spark.readStream.schema(claims.schema).parquet(came), p, facts, out, state).awaitTermination()
    return current(spark, out).select("doc_id", "seq", "field", "period_type", "c1", "c2", "c3", "state", "status", "category")
