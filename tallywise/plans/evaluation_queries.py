"""Queries of comparison, scoring, sampling and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import evaluate as ev
from .registry import query
from .views import load, read, view

view("rates", "SELECT CASE CAST(user_id AS BIGINT) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'HKD' ELSE 'EUR' END AS ccy, CAST(ts AS DATE) AS date, CAST(max(event_id % 900 + 100) AS DOUBLE) / 100 AS rate FROM events WHERE event_type = 'view' GROUP BY 1, 2")
view("asks", "SELECT event_id AS id, CASE CAST(user_id AS BIGINT) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'HKD' ELSE 'EUR' END AS src, CASE event_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'HKD' WHEN 2 THEN 'EUR' ELSE 'CNY' END AS dst, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'purchase'")
view("scored", "SELECT l.doc_id, source AS cell, l.quality = 1 AS strict, l.toxic = 1 AS flagged FROM labels l JOIN documents d ON d.doc_id = l.doc_id")


@query("cmp1_as_of_rates", "SELECT a.id, a.src AS ccy, a.date, r.rate, r.date AS rate_date FROM asks a ASOF LEFT JOIN rates r ON a.src = r.ccy AND a.date >= r.date")
def cmp1(spark, sf):
    return cmp.as_of(load(spark, sf, "asks").withColumnRenamed("src", "ccy"), load(spark, sf, "rates"))


@query("cmp2_cross_rates", """SELECT a.id, round(CASE WHEN src = dst THEN 1 ELSE r.rate / CASE WHEN dst = 'CNY' THEN 1 ELSE s.rate END END, 9) AS rate, CASE WHEN src = dst THEN a.date WHEN r.rate IS NOT NULL AND (dst = 'CNY' OR s.rate IS NOT NULL) THEN coalesce(least(r.date, s.date), r.date, s.date) END AS rate_date
  FROM asks a ASOF LEFT JOIN rates r ON a.src = r.ccy AND a.date >= r.date ASOF LEFT JOIN rates s ON a.dst = s.ccy AND a.date >= s.date""")
def cmp2(spark, sf):
    return cmp.cross_rate(load(spark, sf, "asks"), load(spark, sf, "rates")).withColumn("rate", F.round("rate", 9))


@query("cmp3_cmp4_matrix", "SELECT doc_id, max(v) FILTER (field = 'revenue' AND fno = 1)::DOUBLE AS revenue, max(v) FILTER (field = 'net_income_parent')::DOUBLE AS net_income_parent FROM figures GROUP BY doc_id")
def cmp4(spark, sf):
    f = load(spark, sf, "figures").select("doc_id", F.col("fno").alias("seq"), "field", F.col("v").cast("double").alias("value"))
    return cmp.matrix(f, ["revenue", "net_income_parent"])


@query("ins3_year_on_year", """SELECT a.doc_id, CASE WHEN a.nk % 6 <> 0 AND b.rev > 0 THEN round(a.rev / b.rev - 1, 9) END AS pct, CASE WHEN a.nk % 6 = 0 THEN 'current_flagged' WHEN b.rev IS NULL THEN 'missing' WHEN b.rev <= 0 THEN 'prior_not_positive' END AS note
  FROM filings a LEFT JOIN filings b ON b.nk = a.nk AND b.q = a.q AND b.y = a.y - 1""")
def ins3(spark, sf):
    d = load(spark, sf, "filings")
    now = d.select("doc_id", F.col("rev").cast("double").alias("value"), F.when(F.col("nk") % 6 == 0, "BAD").otherwise("OK").alias("status"))
    prior = d.select("nk", "q", (F.col("y") + 1).alias("y"), F.col("rev").alias("prior")).join(d.select("doc_id", "nk", "q", "y"), ["nk", "q", "y"]).select("doc_id", "prior")
    return cmp.year_on_year(now, prior).withColumn("pct", F.round("pct", 9))


@query("fn19_eva1_renderings", """SELECT o_orderkey, count(*)::BIGINT AS n, string_agg(t, ',' ORDER BY t) AS texts FROM (SELECT o_orderkey, unnest([v::VARCHAR, v::VARCHAR || '.0']) AS t FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders)) WHERE length(replace(t, '.', '')) >= 3 GROUP BY o_orderkey""")
def eva1(spark, sf):
    o = read(spark, sf, "SELECT o_orderkey, floor(o_totalprice) AS v FROM orders")
    r = o.select("o_orderkey", F.explode(ev.rendered(F.col("v").cast("double"), [1.0], [0, 1])).alias("r"))
    return r.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("r.text")), ",").alias("texts"))


@query("eva3_eva4_predictions", """SELECT doc_id, field, period_type, coalesce(min(seq) FILTER (v % 3 <> 0), max(seq)) AS seq, arg_min(v, seq) FILTER (v % 3 <> 0)::DOUBLE AS value FROM (SELECT doc_id, field, 'Q' AS period_type, fno AS seq, v FROM figures) GROUP BY ALL""")
def eva3(spark, sf):
    f = load(spark, sf, "figures").select("doc_id", "field", F.lit("Q").alias("period_type"), F.col("fno").alias("seq"), F.when(F.col("v") % 3 != 0, F.col("v").cast("double")).alias("value"))
    return ev.predictions(f)


@query("eva2_eva6_scores", """SELECT f.doc_id, f.field, f.period_type, f.fno, value IS NOT NULL AS answered, coalesce(abs(value - truth) <= 0.5 + 1e-9 * abs(truth), false) AS strict, coalesce(abs(value - truth) <= 0.01 * abs(truth), false) AS approx FROM (SELECT *, v::DOUBLE AS truth, CASE WHEN v % 7 <> 0 THEN v + v % 5 * 0.25 END AS value FROM figures) f""")
def eva6(spark, sf):
    f = load(spark, sf, "figures").withColumn("k", F.concat_ws(":", "period_type", "fno"))
    key = f.select("doc_id", "field", F.col("k").alias("period_type"), "fno", F.col("v").cast("double").alias("truth"), F.lit(0.5).alias("tol"))
    preds = f.where("v % 7 <> 0").select("doc_id", "field", F.col("k").alias("period_type"), (F.col("v") + F.col("v") % 5 * 0.25).cast("double").alias("value"))
    out = ev.score(key, preds)
    return out.select("doc_id", "field", F.split("period_type", ":")[0].alias("period_type"), "fno", "answered", "strict", "approx")


@query("eva8_eva9_eva10_summary", """SELECT cell, count(*)::BIGINT AS n, count_if(strict) / count(*) AS strict_accuracy, count_if(NOT strict AND NOT flagged)::BIGINT AS silent, count_if(flagged) / count(*) AS workload, count_if(flagged AND NOT strict) / nullif(count_if(NOT strict), 0) AS flag_recall,
  count_if(flagged AND strict) / nullif(count_if(flagged), 0) AS false_alarms FROM scored GROUP BY cell""")
def eva8(spark, sf):
    return ev.summary(load(spark, sf, "scored"), ["cell"])


@query("eva11_bootstrap", """WITH own AS (SELECT row_number() OVER (ORDER BY cell NULLS FIRST) - 1 AS pos, count_if(strict) AS good, count(*) AS n FROM scored GROUP BY cell), draws AS (
  SELECT r, ('0x' || substr(md5(r || ':' || k), 1, 12))::BIGINT % (SELECT count(*) FROM own) AS pos FROM range(1000) a(r), (SELECT pos AS k FROM own) b), shares AS (SELECT r, sum(good) / sum(n) AS share FROM draws JOIN own USING (pos) GROUP BY r)
SELECT round(list_sort(list(share))[26], 9) AS lo, round(list_sort(list(share))[975], 9) AS hi FROM shares""")
def eva11(spark, sf):
    return ev.bootstrap(load(spark, sf, "scored"), "cell").select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query("eva12_costs", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, list_sort(list(value))[(count(*) // 2)::BIGINT + 1] AS median, max(value) AS most FROM events GROUP BY event_type")
def eva12(spark, sf):
    rows = read(spark, sf, "SELECT event_type, value FROM events")
    m = ev.upper_medians(rows, "event_type", "value").withColumnRenamed("event_type", "type")
    own = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return own.join(m, F.col("event_type").eqNullSafe(F.col("type")), "left").select("event_type", "n", "mean", "median", "most")


view("runs3", "SELECT DISTINCT o_orderkey AS key, CAST(r_regionkey AS INT) AS run, CAST(o_custkey + CASE WHEN r_regionkey = 2 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value, NOT (r_regionkey = 1 AND o_orderkey % 7 = 0) AS strict FROM orders CROSS JOIN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) r WHERE o_orderkey % 11 <> 0 OR r_regionkey > 0")


@query("eva17_stability", "SELECT count(*)::BIGINT AS keys, count_if(v = 1)::BIGINT AS agree, count_if(s > 1)::BIGINT AS flips FROM (SELECT key, count(DISTINCT run) AS r, count(DISTINCT value) AS v, count(DISTINCT strict) AS s FROM runs3 GROUP BY key) WHERE r = 3")
def eva17(spark, sf):
    return ev.stability(load(spark, sf, "runs3"), 3)


@query("eva15_disputes", """SELECT key, min_by(value, run) AS value, max(votes)::BIGINT AS votes FROM (SELECT a.key, a.run, a.value, count(DISTINCT b.run) AS votes FROM runs3 a JOIN runs3 b ON a.key = b.key AND abs(a.value - b.value) <= 0.5 WHERE a.key % 3 = 0 GROUP BY ALL HAVING count(DISTINCT b.run) >= 2) GROUP BY key""".replace("min_by(value, run)", "arg_min(value, run)"))
def eva15(spark, sf):
    v = load(spark, sf, "runs3")
    truth = v.groupBy("key").agg(F.min("value").alias("m")).select("key", F.when(F.col("key") % 3 == 0, F.col("m") + 50).otherwise(F.col("m")).alias("truth"), F.when(F.col("key") % 3 == 0, 0.5).otherwise(1.5).alias("tol"))
    return ev.disputes(v.withColumnRenamed("run", "tier"), truth)


@query("eva24_eva26_merged_candidates", "SELECT key, value, count(*)::BIGINT AS votes FROM runs3 GROUP BY key, value")
def eva24(spark, sf):
    return ev.merged_candidates(load(spark, sf, "runs3").select("key", "value"))


@query("eva28_run_summary", "SELECT doc_id, count(*)::BIGINT AS n, sum(v)::BIGINT AS total FROM figures GROUP BY ROLLUP (doc_id)")
def eva28(spark, sf):
    f = load(spark, sf, "figures")
    calls = f.select("doc_id", F.col("v").alias("input"), *[F.lit(None).cast("long").alias(c) for c in ("cached", "output", "usd")])
    return ev.run_summary(f.select("doc_id", F.lit("OK").alias("status")), calls).select("doc_id", F.col("ok").alias("n"), F.col("input").alias("total"))


@query("eva29_coverage", "SELECT market, template, count(*)::BIGINT AS n FROM filings GROUP BY CUBE (market, template)")
def eva29(spark, sf):
    return load(spark, sf, "filings").cube("market", "template").agg(F.count("*").alias("n"))


@query("eva14_eva21_pending", "SELECT doc_id, field FROM figures f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.doc_id = f.doc_id AND g.field = f.field AND g.period_type = f.period_type)")
def eva14(spark, sf):
    return ev.unanswered(load(spark, sf, "figures"), load(spark, sf, "facts")).select("doc_id", "field")


@query("smp1_smp2_stratified_sample", """SELECT market, stratum, entity, nth FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY turn, (stratum * 48271 + 7 * 7919) % 2147483647, stratum)::INT AS nth FROM (SELECT c_mktsegment AS market, c_nationkey AS stratum, c_custkey AS entity,
  row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY (c_custkey * 48271 + 7 * 7919) % 2147483647, c_custkey) AS turn FROM customer)) WHERE nth <= 12""")
def smp1(spark, sf):
    return ev.stratified(read(spark, sf, "SELECT c_mktsegment AS market, c_nationkey AS stratum, c_custkey AS entity FROM customer").withColumn("stratum", F.col("stratum").cast("long")), 12, 7).withColumn("stratum", F.col("stratum").cast("int"))


@query("gov1_gov2_manifest", """SELECT f.path, CASE WHEN n.sha256 IS NULL THEN 'vanished' ELSE 'changed' END AS what FROM (SELECT doc_id AS path, sha256(text) AS sha256 FROM documents) f
  LEFT JOIN (SELECT doc_id AS path, sha256(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS sha256 FROM documents WHERE doc_id % 10 <> 0) n ON n.path = f.path WHERE n.sha256 IS NULL OR n.sha256 <> f.sha256""")
def gov1(spark, sf):
    d = read(spark, sf, "SELECT doc_id AS path, text FROM documents")
    now = d.where("path % 10 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("path") % 5 == 0, "!").otherwise("")), 256).alias("sha256"))
    return ev.manifest_diff(d.select("path", F.sha2("text", 256).alias("sha256")), now)


# documents as files of several kinds, with lines in the other script, some of them comments
view("files", """SELECT CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'src/' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN 'web/' || CAST(doc_id AS STRING) || '.js' WHEN 2 THEN 'docs/' || CAST(doc_id AS STRING) || '.md' WHEN 3 THEN 'web/' || CAST(doc_id AS STRING) || '.css' WHEN 4 THEN 'LICENSE' || CAST(doc_id AS STRING) || '/LICENSE'
  WHEN 5 THEN 'a/' || CAST(doc_id AS STRING) || '.json' ELSE 'data/' || CAST(doc_id AS STRING) || '.py' END AS path,
  replace(replace(replace(text, 'the ', '的'), chr(10), chr(10) || CASE doc_id % 3 WHEN 0 THEN '  # ' WHEN 1 THEN '// ' ELSE '' END), 'er ', '、') AS text, source, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang FROM documents""")


@query("aud1_script_lines", r"""SELECT path, kind, count(*)::BIGINT AS n_lines, count_if(foreign_)::BIGINT AS n_foreign, CASE WHEN kind = 'code' THEN count_if(foreign_ AND own)::BIGINT END AS n_comments FROM (
  SELECT path, kind, regexp_matches(line, '[\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]') AS foreign_, starts_with(bare, '*') OR starts_with(bare, repeat(chr(34), 3)) OR starts_with(bare, repeat(chr(39), 3)) OR starts_with(bare, CASE WHEN path LIKE '%.py' THEN '#' WHEN path LIKE '%.js' THEN '//' ELSE '/*' END) AS own
  FROM (SELECT *, regexp_replace(line, '^\s+', '') AS bare FROM (SELECT path, CASE WHEN path LIKE '%.md' OR path LIKE '%LICENSE' THEN 'reader' WHEN path LIKE '%.json' THEN 'data' ELSE 'code' END AS kind, unnest(string_split(text, chr(10))) AS line FROM files WHERE NOT starts_with(path, 'data/')))) GROUP BY path, kind HAVING count_if(foreign_) > 0""")
def aud1(spark, sf):
    return ev.script_lines(load(spark, sf, "files"))


@query("aud1_foreign_texts", r"""WITH ls AS (SELECT DISTINCT lang, unnest(string_split(text, chr(10))) AS text FROM files), found AS (SELECT lang, text, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z_''-]*'), lambda w: lower(w) NOT IN ('the', 'and', 'and-so') AND w <> upper(w) AND NOT regexp_matches(w, '[0-9_-]') AND length(w) > 1) AS ws FROM ls)
  SELECT lang, text, CASE WHEN lang = 'zh' THEN array_to_string(list_sort(list_distinct(ws)), ', ') END AS words FROM found WHERE CASE WHEN lang = 'en' THEN regexp_matches(text, '[\x{3000}-\x{303F}\x{3400}-\x{9FFF}\x{FF00}-\x{FFEF}]') ELSE len(ws) > 0 END""")
def aud1_texts(spark, sf):
    f = load(spark, sf, "files")
    allowed = spark.createDataFrame([("The",), ("and",), ("and-so",)], "word string")
    return ev.foreign_texts(f.select("lang", F.explode(F.split("text", "\n")).alias("text")), allowed)
