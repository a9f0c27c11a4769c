import datetime

from pyspark.sql import functions as F

from tallywise.functions import periods, text, units
from tallywise.operators import ledger, verify


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_raw_numbers(spark):
    cases = {"(2,353)": -2353, "−4,672,487": -4672487, "-0.76": -0.76, "401,243": 401243}
    for raw, want in cases.items():
        assert float(one(spark, units.parse_raw(F.col("r")), r=raw)) == want
    assert one(spark, units.digits_of(F.col("r")), r="none") is None


def test_units_and_currencies(spark):
    for unit, want in {"in millions, except per share data": 10**6, "人民币百万元，每股数据除外": 10**6, "亿元": 10**8, "thousands": 10**3, "%": 1, "HK$": 1}.items():
        assert float(one(spark, units.unit_multiplier(F.col("u")), u=unit).mult) == want, unit
    assert one(spark, units.unit_multiplier(F.col("u")), u="furlongs") is None
    assert float(one(spark, units.per_share_multiplier(F.col("u")), u="US cents per share").mult) == 0.01
    assert float(one(spark, units.per_share_multiplier(F.col("u")), u="in millions, except per share amounts").mult) == 1
    code = units.currency_code(F.col("c"), F.col("u"), F.col("m"))
    assert one(spark, code, c="", u="Millions of dollars", m="us") == "USD"
    assert one(spark, code, c="", u="Millions of dollars", m="hk") is None
    assert one(spark, code, c="元", u="", m="a") == "CNY"


def test_normalisation_and_numbers(spark):
    assert one(spark, text.for_match(text.nfkc(F.col("t"))), t="綜合損益表 −１２") == "综合损益表-12"
    assert one(spark, text.for_numbers(F.col("t")), t="1,234 5,67 1,234,567") == "1234 5,67 1234567"
    assert one(spark, text.number_tokens(F.col("t")), t="12 3.5 2026.06.30 x7") == ["12", "3.5", "7"]


def test_periods(spark):
    assert one(spark, periods.period_end(F.col("p"), F.lit("03-31")), p="2026H1") == datetime.date(2025, 9, 30)
    assert one(spark, periods.type_from_days(F.col("d")), d=181) == "H"
    assert one(spark, periods.change_words(F.col("d")), d=-4.94) == "down 4.9%"


def test_quotes(spark):
    assert verify.in_pieces("revenue401,243", "revenuexx401,243") and not verify.in_pieces("revenue999", "revenuexx401")
    assert verify.likeness("revenue:401243", "totalrevenue401243cost") > 0.9
    claims = spark.createDataFrame([("d", 1, 2, "Revenue  401,243"), ("d", 2, 1, "Cost 17"), ("d", 3, 1, "absent line 5")], "doc_id string, seq int, page int, quote string")
    pages = verify.prepared_pages(spark.createDataFrame([("d", 1, "cover"), ("d", 2, "Revenue 401,243"), ("d", 5, "Cost 17")], "doc_id string, page int, text string"))
    got = {r.seq: r for r in verify.check_quotes(claims, pages).collect()}
    assert got[1].c1 and got[1].page_used == 2 and not got[2].c1 and got[2].other_pages == [5] and not got[3].c1


def test_number_inside_a_longer_number_is_not_found(spark):
    pages = verify.prepared_pages(spark.createDataFrame([("d", 1, "Total 14,012,433")], "doc_id string, page int, text string"))
    claims = spark.createDataFrame([("d", 1, 1, 1, "401243"), ("d", 2, 1, 1, "14,012,433")], "doc_id string, seq int, page int, page_used int, raw_value string")
    assert {r.seq: r.c2 for r in verify.check_numbers(claims, pages).collect()} == {1: False, 2: True}


def test_ledger(spark):
    rows = spark.createDataFrame([("l", 1, 0.6), ("l", 2, 0.6), ("l", 3, 0.3)], "ledger string, seq long, usd double")
    assert {r.seq: r.ok for r in ledger.admitted(rows, 1.0).collect()} == {1: True, 2: False, 3: True}
