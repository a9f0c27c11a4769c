"""Older listings, long feeds, labels in both languages and rule wording on small cases."""

import datetime
import pathlib
import random

from pyspark.sql import functions as F

from tallywise.functions import periods, units
from tallywise.operators import catalog, pages, report

LISTING = "entity long, page int, fy int, fp int, filed date, accn long, report_date date, annual_form boolean"
REQUESTS = "request long, entity long, fy int, fp int, period_end date, annual boolean"


def one_request(r, recent, older):
    """The rule for one request, listing after listing."""
    _, entity, fy, fp, end, annual = r
    first = lambda rows: min(((x[4], x[5]) for x in rows), default=(None, None))[1]
    same = lambda rows: [x for x in rows if x[0] is not None and x[0] == entity and (x[2], x[3]) == (fy, fp)]
    if same(recent):
        return first(same(recent)), 0
    for page in sorted({x[1] for x in older}):
        if same([x for x in older if x[1] == page]):
            return first(same([x for x in older if x[1] == page])), 1
    near = [x for x in recent if x[0] == entity and abs((x[6] - end).days) <= 10 and x[7] == annual]
    return (first(near), 2) if near else (None, None)


def listing(r, n, first):
    day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(days=r.randrange(700))
    entity = lambda: r.choice([None, 7, 7, 7, *range(40)])
    return [(entity(), r.randrange(3), r.choice([2020, 2021]), r.choice([1, 2, 3, 4]), day(), first + k, day(), r.random() < 0.3) for k in range(n)]


def test_requests_in_recent_and_older_listings(spark):
    r = random.Random(5)
    recent, older = listing(r, 60, 0), listing(r, 300, 1000)
    wanted = [(k, r.choice([7, 99, *range(40)]), r.choice([2020, 2021]), r.choice([1, 2, 3, 4]), datetime.date(2020, 1, 1) + datetime.timedelta(days=r.randrange(700)), r.random() < 0.3) for k in range(400)]
    store = catalog.older_store(spark.createDataFrame(older, LISTING).drop("report_date", "annual_form"))
    got = catalog.resolved(spark.createDataFrame(wanted, REQUESTS), spark.createDataFrame(recent, LISTING), store)
    want = {w[0]: one_request(w, recent, older) for w in wanted}
    assert {x.request: (x.accn, x.source) for x in got.collect()} == want
    assert {s for _, s in want.values()} == {None, 0, 1, 2}
    empty = catalog.resolved(spark.createDataFrame([], REQUESTS), spark.createDataFrame(recent, LISTING), store)
    assert empty.count() == 0


def test_only_the_folders_asked_for_are_read(spark, tmp_path):
    rows = [(e, 0, 2020, 1, datetime.date(2020, 1, 1), e, datetime.date(2020, 1, 1), False) for e in range(50)]
    store = catalog.older_store(spark.createDataFrame(rows, LISTING), f"file://{tmp_path}/older")
    shard = store.where("entity = 7").first().shard
    for f in pathlib.Path(tmp_path, "older").glob("shard=*/*.parquet"):
        if f.parent.name != f"shard={shard}":
            f.write_bytes(b"not parquet")
    asked = spark.createDataFrame([(1, 7, 2020, 1), (2, None, 2020, 1)], "request long, entity long, fy int, fp int")
    found = catalog.older_matches(asked, store)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert [tuple(x) for x in found.collect()] == [(1, 7)]


def test_long_feed(spark):
    end, other = datetime.date(2025, 6, 30), datetime.date(2024, 6, 30)
    feed = [
        ("x", "利润表", end, 1, "营运收入", 5.0), ("x", "利润表", end, 2, "营运收入", 6.0), ("x", "利润表", end, 3, "营运收入", None), ("x", "现金流量表", end, 0, "股东应占溢利", 8.0), ("x", "利润表", end, 9, "股东应占溢利", 7.0),
        ("x", "利润表", other, 4, "毛利", 1.0), ("x", "资产负债表", end, 1, "毛利", 2.0), ("x", "利润表", end, 5, "净利息收入", 3.0), ("x", "利润表", end, 6, "存货", 4.0), (None, "利润表", end, 1, "毛利", 1.0),
    ]
    docs = [("g", "x", "general", end, "H"), ("b", "x", "bank", end, "H"), ("i", "x", "insurance", end, "H"), ("n", None, "general", end, "H"), ("t", "x", None, end, "H")]
    got = catalog.long_facts(spark.createDataFrame(feed, "entity string, sheet string, report_date date, ord int, item string, amount double"), spark.createDataFrame(docs, "doc_id string, entity string, template string, period_end date, cumulative_type string"))
    assert {(x.doc_id, x.field): (x.value, x.period_type, x.currency, x.source_field) for x in got.collect()} == {
        ("g", "revenue"): (6.0, "H", None, "营运收入"), ("b", "net_interest_income"): (3.0, "H", None, "净利息收入"), **{(d, "net_income_parent"): (8.0, "H", None, "股东应占溢利") for d in "gbit"},
    }


def test_labels_in_both_languages(spark):
    rows = [("USD", 1e6, False, "2026Q3", "2026-09-30"), ("CNY", None, False, "2026FY", "2026-12-31"), ("HKD", 1.0, True, "2026H1", "2026-03-31"), ("XXX", 1.0, False, "soon", "2026-03-31"), ("USD", 7.0, False, "2026FY", "2026-06-30"), (None, 1.0, True, None, None)]
    df = spark.createDataFrame(rows, "c string, m double, s boolean, p string, e string").withColumn("e", F.col("e").cast("date"))
    cols = [f(lang) for lang in ("zh", "en") for f in (lambda x: units.unit_label(F.col("c"), F.col("m"), F.col("s"), x), lambda x: periods.period_label(F.col("p"), F.col("e"), x)["label"])]
    assert [tuple(x) for x in df.select(*cols, periods.period_label(F.col("p"), F.col("e"))["fiscal"]).collect()] == [
        ("百万美元", "2026 年第三季度", "USD millions", "Q3 2026", False), ("人民币", "2026 年全年", "RMB", "FY2026", False), ("港元/股", "FY2026 H1（财年）", "HKD per share", "FY2026 H1 (fiscal)", True),
        (None, "soon", None, "soon", False), (None, "FY2026（财年）", None, "FY2026 (fiscal)", True), (None, "", None, "", False),
    ]


def test_failed_rules_in_english(spark):
    rules = {"毛利 5 大于营业收入 3": "Gross profit is larger than revenue, or the cost used is negative.", "报告列示了其他权益持有人，疑似只取了普通股口径": "Looks like only the ordinary-shareholder line was taken.", "单季 1 + 累计 2": "Quarter + previous cumulative does not add up to the cumulative figure.", "new rule": "Fails a consistency check: new rule"}
    df = spark.createDataFrame([(k,) for k in rules], "rule string").select("rule", F.lit("BAD").alias("status"), F.lit("us").alias("market"), F.lit(None).cast("string").alias("category"), F.lit("1").alias("raw_value"))
    got = {x.rule: (x.reason_zh, x.reason_en) for x in report.with_reasons(df).collect()}
    assert got == {k: ("合理性检查：" + k, v) for k, v in rules.items()}


def test_shortest_documents(spark):
    df = spark.createDataFrame([("b", 1, "xx"), ("b", 2, None), ("a", 1, "xx"), ("c", 1, "x"), ("c", 2, "xxxx"), ("d", 1, None)], "doc_id string, page int, text string")
    assert [tuple(x) for x in pages.shortest(df, 3).collect()] == [("d", 0), ("a", 2), ("b", 2)]
    assert pages.shortest(df.where("false")).count() == 0
