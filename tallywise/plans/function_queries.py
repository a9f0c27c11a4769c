"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods as per
from ..functions import text as tx
from ..functions import units as un
from .registry import query
from .views import load, read, view


# the documents' texts hold no characters that folding changes but these; the tests have the others
view("o_folded", r"""SELECT doc_id, replace(replace(translate(coalesce(text, ''), chr(160) || '−–—‐‑‒―﹣－', ' ---------'), '…', '...'), '№', 'No') AS t FROM documents""")
view("o_tokens", r"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '[0-9.]+'),
  lambda x: rtrim(x, '.')), lambda x: regexp_full_match(x, '\d+(\.\d+)?')) AS numbers, t FROM o_folded""")
view("o_loose", r"""SELECT doc_id, list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '(\d),(\d{3})(\D|$)', '\1\2\3', 'g'), '[0-9.]+'), lambda x: regexp_matches(x, '^\d')), lambda x: regexp_extract(x, '^\d+(\.\d+)?')) AS numbers FROM o_tokens""")


@query("fn1_fn2_match_text", r"SELECT doc_id, sha256(lower(regexp_replace(replace(replace(replace(replace(translate(t, '、。「」『』', ',.????'), '“', chr(34)), '”', chr(34)), '‘', chr(39)), '’', chr(39)), '[\s\x0B\p{Z}\x{1C}-\x{1F}\x{85}]+', '', 'g'))) AS h FROM o_folded")
def fn2(spark, sf):
    return read(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.sha2(tx.for_match(F.col("text")), 256).alias("h"))


@query("fn3_fn17_number_tokens", "SELECT doc_id, array_to_string(numbers, ',') AS numbers FROM o_tokens")
def fn17(spark, sf):
    return read(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.array_join(tx.number_tokens(tx.for_numbers(F.col("text"))), ",").alias("numbers"))


@query("fn18_number_sets", "SELECT doc_id, array_to_string(list_sort(list_distinct(numbers)), ',') AS numbers FROM o_loose WHERE len(numbers) > 0")
def fn18(spark, sf):
    d = read(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", tx.number_set(tx.for_numbers(F.col("text"))).alias("n"))
    return d.where(F.size("n") > 0).select("doc_id", F.array_join(F.array_sort("n"), ",").alias("numbers"))


@query("fn4_fn5_fn6_fn16_raw_numbers", """SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18, 2)::VARCHAR AS digits, round(CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END, 2) AS value, 2 AS decimals FROM lineitem""")
def fn5(spark, sf):
    l = read(spark, sf, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
    raw = tx.signed(F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("("), F.format_number("l_extendedprice", 2), F.lit(")"))).otherwise(F.format_number("l_extendedprice", 2)), F.col("l_linenumber") % 4 == 2)
    return l.select("l_orderkey", "l_linenumber", un.digits_of(raw).alias("digits"), F.round(un.parse_raw(raw).cast("double"), 2).alias("value"), un.decimals_of(raw).alias("decimals"))


@query("fn7_fn8_fn9_fn10_fn21_units", """SELECT p_partkey, m::DOUBLE AS mult, k AS kind, c AS currency, lab AS label FROM part JOIN (VALUES (0, 1000000, 'amount', 'USD', 'USD millions'), (1, 1000, 'amount', 'CNY', 'RMB thousands'), (2, 1, 'ratio', NULL, NULL), (3, 1, 'per_share', 'HKD', 'HKD per share'), (4, NULL, NULL, NULL, NULL), (5, 100000000, 'amount', 'CNY', 'RMB hundred-millions')) v(k6, m, k, c, lab) ON p_partkey % 6 = k6""")
def fn7(spark, sf):
    p = read(spark, sf, "SELECT p_partkey FROM part").withColumn("k6", F.col("p_partkey") % 6)
    words = spark.createDataFrame([(0, "US$ in millions, except per share data"), (1, "RMB thousands"), (2, "percentage point"), (3, "HK$ per share"), (4, "furlongs"), (5, "人民币亿元")], "k6 long, raw_unit string")
    d = p.join(F.broadcast(words), "k6").withColumn("raw_value", F.lit("1.5")).withColumn("raw_currency", F.lit("")).withColumn("market", F.lit("us"))
    v = un.to_value(d)
    return v.select("p_partkey", "mult", "kind", "currency", un.unit_label(F.col("currency"), F.col("mult"), F.col("kind") == "per_share").alias("label"))


@query("fn11_fn12_fn13_fn14_periods", """SELECT o_orderkey, y, part, CASE part WHEN 'FY' THEN make_date(y, 3, 31) WHEN 'Q3' THEN make_date(y - 1, 12, 31) WHEN 'H1' THEN make_date(y - 1, 9, 30) ELSE make_date(y - 1, 6, 30) END AS period_end,
  CASE part WHEN 'FY' THEN 'FY' WHEN 'Q3' THEN 'YTD' WHEN 'H1' THEN 'H' ELSE 'Q' END AS cumulative, CASE WHEN d <= 100 THEN 'Q' WHEN d BETWEEN 170 AND 190 THEN 'H' WHEN d BETWEEN 350 AND 371 THEN 'FY' ELSE 'YTD' END AS by_days
  FROM (SELECT o_orderkey, year(o_orderdate) AS y, CASE o_orderkey % 4 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' WHEN 2 THEN 'H1' ELSE 'Q1' END AS part, o_custkey % 400 AS d FROM orders)""")
def fn12(spark, sf):
    o = read(spark, sf, "SELECT o_orderkey, o_custkey % 400 AS d, CAST(year(o_orderdate) AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' WHEN 2 THEN 'H1' ELSE 'Q1' END AS p FROM orders")
    p = F.col("p")
    return o.select("o_orderkey", per.period_year(p).alias("y"), per.period_part(p).alias("part"), per.period_end(p, F.lit("03-31")).alias("period_end"), per.cumulative_type(per.period_part(p)).alias("cumulative"), per.type_from_days(F.col("d")).alias("by_days"))


@query("fn15_aliases", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'eps_basic' WHEN 2 THEN 'cost_of_revenue' END AS field, CASE p_partkey % 3 WHEN 0 THEN 'YTD' WHEN 1 THEN 'FY' END AS period FROM part""")
def fn15(spark, sf):
    p = read(spark, sf, "SELECT p_partkey FROM part")
    name = F.element_at(F.array(*map(F.lit, ["Total Revenue (restated)", "EPS", "cost of sales", "goodwill"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    span = F.element_at(F.array(*map(F.lit, ["the nine months ended", "", "sometime"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", per.field_of(name).alias("field"), per.period_of(span, F.lit("FY")).alias("period"))


#: Names and spans in many wordings; which ones mean something is told by the alias tables only.
view("alias_texts", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'Total ' WHEN 2 THEN ' NET ' WHEN 3 THEN 'Basic ' ELSE '' END || CASE o_custkey % 8 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'sales' WHEN 2 THEN 'EPS' WHEN 3 THEN 'earnings per share' WHEN 4 THEN 'cost of revenues' WHEN 5 THEN '毛利' WHEN 6 THEN 'Interest Income' ELSE 'goodwill' END
  || CASE CAST(floor(o_totalprice) AS BIGINT) % 4 WHEN 1 THEN ' (restated)' WHEN 2 THEN '（未经审计） ' WHEN 3 THEN ' basic' ELSE '' END AS name, CASE o_custkey % 4 WHEN 1 THEN 'for the ' WHEN 2 THEN 'As of ' WHEN 3 THEN '截至' ELSE '' END
  || CASE CAST(floor(o_totalprice) AS BIGINT) % 11 WHEN 0 THEN 'three months' WHEN 1 THEN 'Quarter' WHEN 2 THEN 'NINE MONTHS' WHEN 3 THEN 'year' WHEN 4 THEN 'full year' WHEN 5 THEN 'H1' WHEN 6 THEN 'ytd' WHEN 7 THEN '中期' WHEN 8 THEN '前三季度' WHEN 9 THEN '' ELSE 'date' END || CASE o_orderkey % 3 WHEN 1 THEN ' ended June' WHEN 2 THEN 'ly' ELSE '' END AS span FROM orders""")


def _pairs(table: dict[str, list[str]], own: bool) -> str:
    return ", ".join(f"('{alias}', '{to}')" for to, names in table.items() for alias in dict.fromkeys([*names, to] if own else names))


@query("fn15_alias_lookup", f"""WITH fields(alias, field) AS (VALUES {_pairs(per.FIELD_ALIASES, True)}), periods(alias, period) AS (VALUES {_pairs(per.PERIOD_ALIASES, False)}),
  t AS (SELECT o_orderkey, trim(regexp_replace(lower(trim(name)), '[（(].*?[)）]', '', 'g')) AS n, lower(trim(span)) AS s FROM alias_texts),
  longest AS (SELECT s, arg_max(period, length(alias)) AS period FROM (SELECT DISTINCT s FROM t) JOIN periods ON length(alias) > 2 AND contains(s, alias) GROUP BY s)
  SELECT o_orderkey, field, CASE WHEN t.s = '' THEN 'FY' ELSE coalesce(p.period, l.period) END AS period FROM t LEFT JOIN fields f ON f.alias = t.n LEFT JOIN periods p ON p.alias = t.s LEFT JOIN longest l ON l.s = t.s""")
def fn15_lookup(spark, sf):
    t = load(spark, sf, "alias_texts")
    return t.select("o_orderkey", per.field_of(F.col("name")).alias("field"), per.period_of(F.col("span"), F.lit("FY")).alias("period"))


@query("fn22_fn23_labels", """SELECT doc_id, CASE WHEN q = 4 THEN 'FY' || y ELSE CASE q WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' ELSE 'Q3' END || ' ' || y END AS label, false AS fiscal, CASE WHEN nk % 3 = 0 THEN 'flat' WHEN nk % 3 = 1 THEN 'up ' || q || '.5%' ELSE 'down ' || q || '.5%' END AS words FROM filings""")
def fn22(spark, sf):
    d = load(spark, sf, "filings")
    lab = per.period_label(F.col("period"), F.col("period_end"))
    delta = F.when(F.col("nk") % 3 == 0, 0.01).when(F.col("nk") % 3 == 1, F.col("q") + 0.5).otherwise(-F.col("q") - 0.5)
    return d.select("doc_id", lab["label"].alias("label"), lab["fiscal"].alias("fiscal"), per.change_words(delta).alias("words"))


# units as tables print them: currency words, a scale, and what is said behind it
view("printed_units", """SELECT p_partkey, trim(CASE p_partkey % 8 WHEN 0 THEN 'US$' WHEN 1 THEN 'RMB' WHEN 2 THEN 'HK$' WHEN 3 THEN '' WHEN 4 THEN '人民币' WHEN 5 THEN 'Dollars' WHEN 6 THEN 'Eur' ELSE 'widgets' END || ' ' ||
  CASE CAST(floor(p_partkey / 8) AS INT) % 12 WHEN 0 THEN 'in millions' WHEN 1 THEN 'Thousands' WHEN 2 THEN 'billion' WHEN 3 THEN '亿元' WHEN 4 THEN '' WHEN 5 THEN 'per share' WHEN 6 THEN '%' WHEN 7 THEN 'million shares' WHEN 8 THEN 'cents per share' WHEN 9 THEN '千元' WHEN 10 THEN 'percentage points' ELSE '万股' END ||
  CASE p_size % 5 WHEN 0 THEN ', except per share data' WHEN 1 THEN ' (unaudited)' WHEN 2 THEN ',每股数据除外' WHEN 3 THEN '; except as noted' ELSE '' END) AS raw_unit, CASE p_size % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'a' ELSE 'hk' END AS market FROM part""")
view("o_unit_words", r"""SELECT *, lower(raw_unit) AS u, regexp_replace(lower(raw_unit), 'except\b.*$', '') AS e FROM printed_units""")
view("o_units", r"""SELECT *, CASE WHEN regexp_matches(u, 'hk\$') THEN 'HKD' WHEN regexp_matches(u, '\$') THEN 'USD' WHEN regexp_matches(u, '人民币|rmb') THEN 'CNY' WHEN regexp_matches(u, 'eur') THEN 'EUR' WHEN u LIKE '%元%' AND market = 'a' THEN 'CNY' WHEN regexp_matches(u, '\bdollars?\b') AND market = 'us' THEN 'USD' END AS currency,
  CASE WHEN trim(regexp_replace(e, '[^,;(]*除外.*$', ''), ' ,;()') = '' THEN e ELSE trim(regexp_replace(e, '[^,;(]*除外.*$', ''), ' ,;()') END AS w,
  trim(regexp_replace(u, '亿|千|万|billions?|millions?|thousands?|\bin\b|\bshares?\b|\bdata\b|except\b|除外|[,;()]', ' ', 'g')) AS rest FROM o_unit_words""")


@query("fn7_fn8_fn9_printed_units", r"""SELECT p_partkey, currency, CASE WHEN u = '' THEN NULL WHEN regexp_matches(w, '%|percentage point') OR regexp_matches(w, '每股|per share') THEN 1 WHEN w LIKE '%billion%' THEN 1e9 WHEN w LIKE '%亿%' THEN 1e8 WHEN w LIKE '%million%' THEN 1e6 WHEN w LIKE '%万%' THEN 1e4 WHEN regexp_matches(w, '千|thousand') THEN 1e3 WHEN regexp_matches(w, '元|人|\$|rmb|dollar|股') THEN 1 END::DOUBLE AS mult,
  CASE WHEN u = '' THEN NULL WHEN regexp_matches(w, '%|percentage point') THEN 'ratio' WHEN regexp_matches(w, '每股|per share') THEN 'per_share' WHEN regexp_matches(w, 'billion|亿|million|万|千|thousand|元|人|\$|rmb|dollar|股') THEN 'amount' END AS kind,
  CASE WHEN u = '' THEN NULL WHEN u LIKE '%cents%' THEN 0.01 WHEN regexp_matches(u, '每股|per share') OR rest = '' OR regexp_matches(rest, '元|\$|rmb|dollars?|股|人民币|eur') THEN 1 END::DOUBLE AS per_share FROM o_units""")
def fn7_printed(spark, sf):
    p = load(spark, sf, "printed_units").withColumn("raw_currency", F.lit(""))
    both = None
    for per_share in (False, True):
        rows = un.to_value(p.withColumn("raw_value", F.lit("1")), per_share=F.lit(per_share)).select("p_partkey", *([F.col("mult").alias("per_share")] if per_share else ["currency", "mult", "kind"]))
        both = rows if both is None else both.join(rows, "p_partkey")
    return both


@query("fn21_fn22_both_languages", """WITH l AS (SELECT *, last_day(make_date(y, 3 * q, 1)) AS nominal, CASE q WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' WHEN 3 THEN 'Q3' ELSE 'FY' END AS part FROM (SELECT doc_id, y, q, n, rev, (period_end + CAST(rev % 60 AS INT))::DATE AS ends FROM filings)),
  m AS (SELECT *, abs(ends - nominal) > 15 AS fiscal FROM l)
  SELECT doc_id, fiscal, CASE WHEN fiscal THEN 'FY' || y || CASE WHEN part = 'FY' THEN '' ELSE ' ' || part END || '（财年）' ELSE y || ' 年' || CASE part WHEN 'Q1' THEN '第一季度' WHEN 'H1' THEN '上半年' WHEN 'Q3' THEN '第三季度' ELSE '全年' END END AS period_zh,
  CASE WHEN fiscal THEN 'FY' || y || CASE WHEN part = 'FY' THEN '' ELSE ' ' || part END || ' (fiscal)' WHEN part = 'FY' THEN 'FY' || y ELSE part || ' ' || y END AS period_en,
  CASE WHEN rev % 4 = 0 THEN c.zh || '/股' ELSE s.zh || c.zh END AS unit_zh, CASE WHEN rev % 4 = 0 THEN c.en || ' per share' ELSE c.en || CASE WHEN s.en = '' THEN '' ELSE ' ' || s.en END END AS unit_en
  FROM m LEFT JOIN (VALUES (0, '美元', 'USD'), (1, '人民币', 'RMB'), (2, '港元', 'HKD'), (3, '欧元', 'EUR'), (4, '日元', 'JPY'), (5, '英镑', 'GBP'), (6, '新台币', 'TWD'), (7, '新加坡元', 'SGD')) c(k, zh, en) ON c.k = n % 9 LEFT JOIN (VALUES (0, '', ''), (1, '千', 'thousands'), (2, '万', 'ten-thousands'), (3, '百万', 'millions'), (4, '亿', 'hundred-millions'), (5, '十亿', 'billions'), (7, '', '')) s(k, zh, en) ON s.k = rev % 8""")
def fn21_both(spark, sf):
    """Years that end up to two months late; every currency and scale, an unknown one of each among them."""
    d = load(spark, sf, "filings")
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key + 1).cast("int"))
    currency, mult = pick(["USD", "CNY", "HKD", "EUR", "JPY", "GBP", "TWD", "SGD", "XYZ"], F.col("n") % 9), pick([1.0, 1e3, 1e4, 1e6, 1e8, 1e9, 7.0, None], F.col("rev") % 8)
    ends, per_share = F.date_add("period_end", (F.col("rev") % 60).cast("int")), F.col("rev") % 4 == 0
    labels = {lang: per.period_label(F.col("period"), ends, lang) for lang in ("zh", "en")}
    return d.select("doc_id", labels["en"]["fiscal"].alias("fiscal"), *[labels[x]["label"].alias(f"period_{x}") for x in labels], *[un.unit_label(currency, mult, per_share, x).alias(f"unit_{x}") for x in labels])


@query("fn23_quarterly_changes", """WITH d AS (SELECT doc_id, (rev - p) * 100.0 / p AS pct FROM (SELECT doc_id, rev::DOUBLE AS rev, lag(rev::DOUBLE) OVER (PARTITION BY nk ORDER BY y, q) AS p FROM filings)), s AS (SELECT *, format('{:.1f}', abs(pct)) AS size FROM d WHERE pct IS NOT NULL)
  SELECT doc_id, CASE WHEN size = '0.0' THEN 'flat' WHEN pct > 0 THEN 'up ' || size || '%' ELSE 'down ' || size || '%' END AS words_en, CASE WHEN size = '0.0' THEN '持平' WHEN pct > 0 THEN '增加 ' || size || ' 个百分点' ELSE '减少 ' || size || ' 个百分点' END AS points_zh FROM s""")
def fn23_quarterly(spark, sf):
    d = load(spark, sf, "filings").select("doc_id", F.col("rev").cast("double").alias("rev"), F.lag(F.col("rev").cast("double")).over(Window.partitionBy("nk").orderBy("y", "q")).alias("p"))
    pct = (F.col("rev") - F.col("p")) * 100.0 / F.col("p")
    return d.where("p IS NOT NULL").select("doc_id", per.change_words(pct).alias("words_en"), per.change_words(pct, "pp", "zh").alias("points_zh"))
