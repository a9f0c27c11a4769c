"""What the findings of the third round were about, on small cases."""

import datetime as dt
import sys

import duckdb

sys.path.insert(0, "tools")
import compare  # noqa: E402

from tallywise.operators import pages, verify  # noqa: E402
from tallywise.plans import registry, views  # noqa: E402
from tallywise.sources.store import materialise  # noqa: E402
from tallywise.streaming import answers  # noqa: E402


def same_as_sql(spark, name, table, sql, folder):
    """Runs a query and its SQL on a folder that holds one table, the rows of ``sql``."""
    c = duckdb.connect()
    c.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    said, ok = compare.compare(spark, c, name, registry.QUERIES[name], registry.ORACLES[name], str(folder))
    assert ok, said


def test_f1_lines_of_one_price(spark, tmp_path):
    rows = "SELECT (i % 40)::BIGINT AS l_orderkey, i::BIGINT AS l_partkey, (i % 7)::BIGINT AS l_suppkey, CASE i % 9 WHEN 8 THEN NULL ELSE (i % 3)::DOUBLE END AS l_extendedprice, ['A', 'N', 'R'][1 + (i * i % 3)::INT] AS l_returnflag FROM range(1000) r(i)"
    same_as_sql(spark, "res2_accession_meta", "lineitem", rows, tmp_path)


def test_f2_entities_without_a_semicolon(spark, tmp_path):
    texts = ["<title>a &amp; b &amp</title>", "<p>&copy &copy; &notit; &bogus; &#233;&#233 &#xE9; &lt;&amp;lt;</p>", "&", "x&&&amp"]
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS page_id, '{t}' AS html" for k, t in enumerate(texts)) + " UNION ALL SELECT 9, NULL"
    same_as_sql(spark, "src2_html_text", "pages", rows, tmp_path)


def test_f4_chunks_shuffle_no_lines(spark):
    texts = spark.createDataFrame([(1, "a\nbb\nccc"), (2, None)], "doc_id long, text string")
    got = pages.chunks(texts, 5)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a\nbb\n"), (1, 2, "ccc\n"), (2, 1, "\n")]


def test_f5_orders_are_summed_up_once(spark):
    claims = views.read(spark, "/root/testdata/sf0.001", "SELECT * FROM claims")
    assert "orders.parquet" not in claims._jdf.queryExecution().toString() and claims.count() > 0


def test_f5_a_micro_batch_reads_its_state_once(spark, tmp_path):
    kind = "doc_id string, seq int, field string, period_type string, period_start string, period_end string, doc_end date, page int, quote string, raw_value string, raw_unit string, raw_currency string, market string"
    end, read = dt.date(2024, 12, 31), []
    pages_ = materialise(verify.prepared_pages(spark.createDataFrame([("d", 1, "Item 100")], "doc_id string, page int, text string")), "pages")
    facts = spark.createDataFrame([("d", 1, "cost", "FY", end, 1e5, "HKD")], "doc_id string, ord long, field string, period_type string, period_end date, value double, currency string")
    spark.createDataFrame([("d", 1, "cost", "FY", None, "2024-12-31", end, 1, "Item 100", "100", "in thousands", "HKD", "hk")], kind).write.parquet(str(tmp_path / "in"))
    own = verify.on_pages
    try:
        verify.on_pages = lambda new, p: (read.append("ExistingRDD" in new._jdf.queryExecution().toString()), own(new, p))[1]
        answers.verify_arriving(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), pages_, facts, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    finally:
        verify.on_pages = own
    assert read and not any(read) and answers.current(spark, str(tmp_path / "out")).first().status == "OK"


def test_f3_match_forms_are_made_once(spark):
    pages = verify.prepared_pages(spark.createDataFrame([("a", 1, "Cover"), ("a", 5, "Revenue 12345")], "doc_id string, page int, text string"))
    pages = materialise(pages, "pages")
    claims = spark.createDataFrame([("a", 1, 1, "Revenue 12345"), ("a", 2, 5, "revenue １2345"), ("a", 3, 1, "")], "doc_id string, seq int, page int, quote string")
    got = verify.check_quotes(claims, pages)
    assert "nfkc" not in got._jdf.queryExecution().toString()
    assert sorted((x.seq, x.c1, x.page_used, x.other_pages) for x in got.collect()) == [(1, False, None, [5]), (2, True, 5, None), (3, False, None, None)]


def test_f3_a_page_too_short_for_a_quote_is_not_matched():
    assert verify.likeness("revenue-12345", "cover") == 0.0
    assert verify.likeness("revenue12345", "revenue1234") > 0.9
