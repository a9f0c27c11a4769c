"""Queries of the spend operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as led
from ..sources.store import materialise, new_path
from ..streaming import ledger as stream
from .registry import query
from .views import load, read, view

view("ledger_events", "SELECT CAST(user_id % 50 AS BIGINT) AS ledger, CAST(event_id AS BIGINT) - CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS id, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 3 = 1 THEN 'settle' ELSE 'reserve' END AS kind, CAST(event_id % 97 AS DOUBLE) AS usd FROM events")


@query("bud1_call_costs", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE round((10 * h + 90 * m + 50 * o) / 1e6, 12) END AS usd FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.25 WHEN pk THEN 0.06 ELSE 0.03 END AS h, CASE WHEN event_id % 3 = 0 THEN 10 WHEN pk THEN 3 ELSE 1.5 END AS m, CASE WHEN event_id % 3 = 0 THEN 50 WHEN pk THEN 12 ELSE 6 END AS o
  FROM (SELECT event_id, isodow(ts) <= 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) AS pk FROM events))""")
def bud1(spark, sf):
    prices = spark.createDataFrame([("flat-one", "flat", 0.25, 10.0, 50.0), ("timed", "peak", 0.06, 3.0, 12.0), ("timed", "offpeak", 0.03, 1.5, 6.0)], "model string, tariff string, hit double, miss double, out double")
    calls = read(spark, sf, "SELECT event_id, ts AS at, CASE event_id % 3 WHEN 0 THEN 'flat-one' WHEN 1 THEN 'timed' ELSE 'unknown' END AS model FROM events").withColumns({"input": F.lit(100), "cached": F.lit(10), "output": F.lit(50)})
    return led.call_costs(calls, prices).select("event_id", F.round("usd", 12).alias("usd"))


@query("bud2_worst_case", "SELECT doc_id, round((length(text) * 0.8 * 3 + 16000 * 12) / 1e6, 12) AS usd FROM documents")
def bud2(spark, sf):
    return read(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.round(led.worst_case(F.length("text"), F.lit(16000), F.lit(3.0), F.lit(12.0)), 12).alias("usd"))


@query("bud3_bud5_bud6_balance", """SELECT ledger, round(sum(spent), 6) AS spent, round(sum(reserved), 6) AS reserved, round(1000 - sum(spent) - sum(reserved), 6) AS "left" FROM (SELECT ledger, id, sum(CASE WHEN kind = 'settle' THEN usd ELSE 0 END) AS spent, CASE WHEN arg_max(kind, seq) = 'reserve' THEN arg_max(usd, seq) ELSE 0 END AS reserved FROM ledger_events GROUP BY ledger, id) GROUP BY ledger""")
def bud3(spark, sf):
    return led.balance(load(spark, sf, "ledger_events"), 1000.0).select("ledger", *[F.round(c, 6).alias(c) for c in ("spent", "reserved", "left")])


@query("bud4_admission", """WITH RECURSIVE s AS (SELECT ledger, seq, usd, row_number() OVER (PARTITION BY ledger ORDER BY seq, usd) AS nth FROM ledger_events WHERE kind = 'reserve'),
  w AS (SELECT DISTINCT ledger, 0::BIGINT AS nth, 0::DOUBLE AS used, NULL::BIGINT AS seq, NULL::BOOLEAN AS ok FROM s
    UNION ALL SELECT s.ledger, s.nth, CASE WHEN w.used + s.usd <= 500 THEN w.used + s.usd ELSE w.used END, s.seq, w.used + s.usd <= 500 FROM w JOIN s ON s.ledger = w.ledger AND s.nth = w.nth + 1)
  SELECT ledger, seq, ok FROM w WHERE nth > 0""")
def bud4(spark, sf):
    return led.admitted(load(spark, sf, "ledger_events").where("kind = 'reserve'").select("ledger", "seq", "usd"), 500.0)


@query("bud7_usage", "SELECT user_id, sum(event_id)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM events GROUP BY user_id")
def bud7(spark, sf):
    calls = read(spark, sf, "SELECT user_id, event_id AS input, NULL AS cached, 0 AS output FROM events")
    return led.usage(calls, "user_id").select("user_id", F.col("input").alias("tokens"), "calls")


@query("req1_req2_pending", "SELECT conv_id, turn, sha256(role || chr(31) || text) AS key, turn % 2 = 0 AS served FROM conversations")
def req1(spark, sf):
    c = read(spark, sf, "SELECT conv_id, turn, role, text FROM conversations").withColumn("key", led.request_key(F.col("role"), F.col("text"))).withColumn("own", F.concat_ws(":", "conv_id", "turn"))
    replies = c.where("turn % 2 = 0").select(F.col("own").alias("key"), F.col("text").alias("data"))
    out = led.pending(c.select(F.col("own").alias("key"), "conv_id", "turn", F.col("key").alias("digest")), replies)
    return out.select("conv_id", "turn", F.col("digest").alias("key"), "served")


@query("req3_same_requests", "SELECT NOT EXISTS (SELECT 1 FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)) AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)) AS same")
def req3(spark, sf):
    c = read(spark, sf, "SELECT DISTINCT conv_id AS key FROM conversations")
    return led.same_requests(c, read(spark, sf, "SELECT DISTINCT doc_id AS key FROM documents"))


view(
    "arrivals",
    """SELECT ledger, id, seq, kind, usd, CASE WHEN seq % 11 = 5 THEN t - INTERVAL 3 DAYS ELSE t END AS t, CAST(floor(seq * 3 / (m + 1)) AS INT) AS arrival FROM (
    SELECT CAST(user_id % 50 AS BIGINT) AS ledger, CAST(event_id - CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS id, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 3 = 1 THEN 'settle' ELSE 'reserve' END AS kind, value AS usd, ts AS t FROM events
    UNION ALL SELECT CAST(user_id % 50 AS BIGINT), CAST(event_id - CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT), CAST(event_id + 40 AS BIGINT), CASE WHEN event_id % 3 = 1 THEN 'settle' ELSE 'reserve' END, value, ts FROM events WHERE event_id % 5 = 2
  ) CROSS JOIN (SELECT max(event_id) + 40 AS m FROM events)""",
)


def _streamed(spark, events, run):
    """Lays down each arrival and lets the stream take it; between arrivals the stream stops and goes on from its checkpoint."""
    came, state = new_path(spark, "came"), new_path(spark, "progress")
    kept = events.drop("arrival")
    for arrival in range(3):
        events.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(came)
        run(spark.readStream.schema(kept.schema).parquet(came), state).awaitTermination()


@query("str1_ledger_stream", """SELECT ledger, round(sum(spent), 6) AS spent, round(sum(reserved), 6) AS reserved FROM (SELECT ledger, id, sum(CASE WHEN kind = 'settle' THEN usd ELSE 0 END) AS spent, CASE WHEN arg_max(kind, seq) = 'reserve' THEN arg_max(usd, seq) ELSE 0 END AS reserved FROM ledger_events GROUP BY ledger, id) GROUP BY ledger""")
def str1(spark, sf):
    """The ledgers of bud3, whose settlements differ from what they reserved, in three arrivals."""
    events = read(spark, sf, "SELECT l.*, CAST(e.ts AS TIMESTAMP) AS t FROM ledger_events l JOIN events e ON l.seq = e.event_id")
    n = events.agg(F.max("seq")).first()[0] or 0
    events = materialise(events.withColumn("t", F.col("t").cast("timestamp")).withColumn("arrival", F.least(F.lit(2), (F.col("seq") * 3 / (n + 1)).cast("int"))), "ledger-events")
    out = new_path(spark, "balances")
    provider, spark_conf = "spark.sql.streaming.stateStore.providerClass", spark.conf
    before = spark_conf.get(provider)
    spark_conf.set(provider, stream.PROVIDER)
    try:
        _streamed(spark, events, lambda came, state: stream.balances(came, out, state, buckets=4))
    finally:
        spark_conf.set(provider, before)
    return stream.latest(spark, out).select("ledger", F.round("spent", 6).alias("spent"), F.round("reserved", 6).alias("reserved"))


@query("str3_late_and_repeated", """WITH marks AS (SELECT a.n AS arrival, (SELECT max(t) FROM arrivals WHERE arrival < a.n) - INTERVAL 2 HOURS AS mark FROM (SELECT unnest([0, 1, 2]) AS n) a),
  told AS (SELECT x.*, mark, coalesce(t < mark, false) AS late FROM arrivals x JOIN marks ON marks.arrival = x.arrival),
  one AS (SELECT *, row_number() OVER (PARTITION BY ledger, id, kind, arrival, late ORDER BY t, seq) AS nth FROM told),
  zero AS (SELECT ledger, id, kind, t FROM one WHERE arrival = 0 AND NOT late AND nth = 1),
  first AS (SELECT o.* FROM one o WHERE arrival = 1 AND NOT late AND nth = 1 AND NOT EXISTS (SELECT 1 FROM zero z WHERE z.ledger = o.ledger AND z.id = o.id AND z.kind = o.kind AND z.t >= o.mark - INTERVAL 2 HOURS)),
  seen AS (SELECT 0 AS arrival, * FROM zero UNION ALL SELECT 1, ledger, id, kind, t FROM first)
  SELECT ledger, id, seq, kind, CASE WHEN late THEN 'late' WHEN nth > 1 OR EXISTS (SELECT 1 FROM seen s WHERE s.arrival < o.arrival AND s.ledger = o.ledger AND s.id = o.id AND s.kind = o.kind AND s.t >= o.mark - INTERVAL 2 HOURS) THEN 'repeated' ELSE 'clean' END AS verdict FROM one o""")
def str3(spark, sf):
    """Events of which some come days late and some again, in three arrivals."""
    out = new_path(spark, "verdicts")
    _streamed(spark, load(spark, sf, "arrivals").withColumn("t", F.col("t").cast("timestamp")), lambda came, state: stream.clean_and_late(came, out, state, "2 HOURS"))
    return stream.verdicts(spark, out).select("ledger", "id", "seq", "kind", "verdict")
