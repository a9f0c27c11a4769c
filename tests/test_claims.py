"""Folding, currency signs, pieces, precedence of categories, pages of numbers, pasted answers and answer keys on small cases."""

import random

from pyspark.sql import functions as F

from tallywise.functions import text, units
from tallywise.operators import answer_key, pages, paste, verify


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_full_width_numbers_and_units(spark):
    assert one(spark, units.digits_of(F.col("r")), r="（１２，３４５．６０）") == "12345.60"
    assert float(one(spark, units.parse_raw(F.col("r")), r="（１２，３４５）")) == -12345
    assert one(spark, units.decimals_of(F.col("r")), r="１．２５") == 2
    assert float(one(spark, units.unit_multiplier(F.col("u")), u="ＵＳ＄ ｍｉｌｌｉｏｎｓ").mult) == 10**6
    assert one(spark, units.currency_code(F.col("c"), F.lit(""), F.lit("us")), c="ＨＫ＄") == "HKD"
    assert one(spark, text.for_match(F.col("t")), t="⺟公司 １２－３") == "母公司12-3"


CLAIMS = "doc_id string, seq int, field string, period_type string, period_start string, period_end string, doc_end date, page int, quote string, raw_value string, raw_unit string, raw_currency string, market string"


def verified(spark, claims, page_texts):
    rows = [("d", k, f"f{k}", "FY", None, "2024-12-31", None, page, quote, raw, unit, cur, "us") for k, (page, quote, raw, unit, cur) in enumerate(claims)]
    c = spark.createDataFrame(rows, CLAIMS).withColumn("doc_end", F.to_date(F.lit("2024-12-31")))
    p = spark.createDataFrame([("d", k, t) for k, t in page_texts.items()], "doc_id string, page int, text string")
    facts = spark.createDataFrame([], "doc_id string, ord long, field string, period_type string, period_end date, value double, currency string")
    return {r.seq: r for r in verify.verify(c, verify.prepared_pages(p), facts).collect()}


def test_precedence_of_categories(spark):
    texts = {1: "Revenue NT$ 401,243 in all", 2: "Cost $17", 3: "Ｔａｘ １２３", 4: "Split 4 56 here", 5: "nothing", 9: "A far quote 88", 12: "Number 777 only here"}
    usd = ("USD thousands", "USD")
    got = verified(spark, [
        (1, "Revenue 401,243", "401,243", *usd), (2, "Cost 17", "17", *usd), (3, "Tax 123", "123", *usd), (5, "A far quote 88", "4 56", *usd), (4, "Split 4 56 here", "456", *usd),
        (5, "absent wording", "777", *usd), (5, "absent wording", "999", "widgets", ""), (1, "Revenue", "none", *usd), (1, "Revenue", "401,243", "widgets", ""), (1, "not the words", "401,243", *usd), (1, "not the words", "", *usd),
    ], texts)
    assert [got[k].c1 for k in range(3)] == [True] * 3 and [got[k].status for k in range(3)] == ["FOUND"] * 3
    assert got[3].category == "FABRICATED" and got[3].other_pages == [9]
    assert got[4].c1 and not got[4].c2 and got[4].category == "PARSE_ARTEFACT"
    assert got[5].category == "WRONG_PAGE" and got[5].number_pages == [12]
    assert got[6].category == "FABRICATED" and got[7].category == "FABRICATED" and got[8].category == "UNIT" and got[9].category == "PARAPHRASED"
    assert got[10].category == "UNIT"


def test_a_quote_elsewhere_outdoes_a_split_number(spark):
    got = verified(spark, [(5, "A far quote 4 56", "456", "USD", "USD")], {5: "has 4 56 too", 9: "A far quote 4 56"})
    assert got[0].category == "WRONG_PAGE" and got[0].split


def test_all_pages_of_a_number_are_listed(spark):
    got = verified(spark, [(1, "x", "555", "USD", "USD")], {1: "none"} | {k: "see 555" for k in range(3, 10)})
    assert got[0].number_pages == list(range(3, 10))


def test_likeness_of_long_pages():
    page = "x" * 50_000 + "revenue:1401243total" + "y" * 300_000
    assert verify.likeness("revenue1401243total", page) > 0.9 and verify.likeness("zebra" * 5, page) == 0.0


def test_context_skips_a_page_that_does_not_fit(spark):
    p = spark.createDataFrame([("d", k, "t" * n) for k, n in ((1, 50), (2, 500), (3, 60))], "doc_id string, page int, text string")
    chosen = spark.createDataFrame([("d", 2, 0), ("d", 1, 1), ("d", 3, 2)], "doc_id string, page int, priority int")
    assert sorted(r.page for r in pages.packed(chosen, p, 120).collect()) == [1, 3]


def test_pasted_table_and_reply(spark):
    table = "| 指标 | 数值 | 期间 |\n|---|---|---|\n| 营业收入 | 1,234 | 全年 |\n| 不明指标 | 1 | 全年 |\n| 净利 | x |\n| 收入 | abc | 全年 |"
    reply = 'ok\n```json\n{"items": [{"field": "revenue", "raw_value": 5, "page": "7"}, {"field": "eps", "raw_value": "原文没有"}, 3]}\n```\n|a|b|'
    rows = spark.createDataFrame([("t", table, "FY", "2024-12-31"), ("r", reply, "H", "2024-06-30"), ("e", None, "FY", None), ("b", "[1", "FY", None)], "doc_id string, text string, cumulative_type string, period_end string")
    got = sorted((r.doc_id, r.line, r.route, r.field, r.raw_value, r.period_type) for r in paste.pasted(rows).collect())
    assert got == [("b", 1, "bad", None, None, None), ("r", 1, "item", "revenue", "5", "H"), ("r", 2, "absent", "eps_basic", None, "H"), ("r", 3, "bad", None, None, None), ("t", 3, "item", "revenue", "1,234", "FY"), ("t", 4, "bad", None, None, None), ("t", 5, "bad", None, None, None), ("t", 6, "bad", None, None, None)]
    own = spark.createDataFrame([("m", "Thing\tWorth\nrevenue\t7", {"0": "field", "1": "raw_value"})], "doc_id string, text string, mapping map<string,string>")
    assert [(r.row.field, r.row.raw_value) for r in paste.table_rows(own).collect()] == [("revenue", "7")]
    assert paste.table_heads(own.drop("mapping")).first().needs_mapping


def test_merged_candidates(spark):
    rows = [("d", "f", "Q", s, v, "USD", l, r) for s, v, l, r in (("a", 1000.0, None, None), ("b", 1000.0 + 1e-7, "x", None), ("c", 5000.0, "y", "5,000"), ("d", 5040.0, "z", "5000"), ("e", 5100.0, "w", "51"))]
    df = spark.createDataFrame(rows, "doc_id string, field string, period_type string, source string, value double, currency string, label string, raw string")
    assert sorted((r.value, r.votes, r.label) for r in answer_key.merged(df).collect()) == [(1000.0, 2, "x"), (5000.0, 2, "y"), (5100.0, 1, "w")]



def test_context_has_pages_in_order(spark):
    p = spark.createDataFrame([("d", k, f"text {k}") for k in (1, 2, 10)] + [("e", 1, "other")], "doc_id string, page int, text string")
    kept = spark.createDataFrame([("d", 10), ("d", 2)], "doc_id string, page int")
    assert [tuple(r) for r in pages.context(kept, p).collect()] == [("d", "[PAGE 2]\ntext 2\n[PAGE 10]\ntext 10")]


def test_far_pages_are_found_without_comparing_all(spark):
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123"
    body = {k: "".join(r.choice(letters) for _ in range(r.choice([5, 40, 300, 900]))) for k in range(1, 25)}
    quotes = []
    for k in range(120):
        page = body[r.randint(1, 24)]
        n = r.choice([1, 2, 3, 5, 6, 9, 11, 20, 40, 80])
        a = r.randint(0, max(0, len(page) - n))
        q = list(page[a : a + n])
        for _ in range(r.choice([0, 0, 1, 1, 2, n // 10, n // 7])):
            at = r.randrange(len(q)) if q else 0
            r.choice([lambda at=at: q.__setitem__(slice(at, at + 1), [r.choice(letters)]), lambda at=at: q.__delitem__(slice(at, at + 1)), lambda at=at: q.insert(at, r.choice(letters))])()
        if n >= 20 and k % 5 == 0:
            other = body[r.randint(1, 24)]
            q = q[: n // 2] + list(other[: n // 2])
        quotes.append((k, "".join(q)))
    quotes = [x for x in quotes if x[1]] + [(900, body[3] + "abc"), (901, "zzzz" * 9), (902, "a" * 30)]
    pages_ = spark.createDataFrame([("d", k, t) for k, t in body.items()] + [("e", 1, "other")], "doc_id string, try_page int, match_text string")
    lost = spark.createDataFrame([("d", k, 99, q) for k, q in quotes] + [("f", 1, 1, "no pages")], "doc_id string, seq int, page int, q string")
    ratio = lambda q, t: 1.0 if q in t else 0.99 if verify.in_pieces(q, t) else verify.likeness(q, t)
    want = {(k, p) for k, q in quotes for p, t in body.items() if ratio(q, t) >= verify.FUZZY}
    near = verify.may_be_alike(lost, pages_)
    got = {(x.seq, x.try_page) for x in near.where(verify.quote_ratio("q", "match_text") >= verify.FUZZY).collect()}
    assert got == want and len(want) > 60
    # what reaches the comparison grows with the hits, not with all pairs
    long = {k for k, q in quotes if len(q) >= 20}
    far = [x for x in near.select("seq").collect() if x.seq in long]
    assert len(far) < 2 * len([k for k, _ in want if k in long]) + 20 < len(long) * len(body) / 4
    assert verify.may_be_alike(lost.limit(0), pages_).count() == 0
