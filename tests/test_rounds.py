"""Second rounds, merged readings, resamples, script audits and missing rates on small cases."""

import datetime as dt
import math
import random

from tallywise.operators import answer_key, compare, evaluate, verify

END = dt.date(2024, 12, 31)
CLAIM = "doc_id string, seq int, field string, period_type string, period_start string, period_end string, doc_end date, page int, quote string, raw_value string, raw_unit string, raw_currency string, market string"


def test_second_round_equals_a_full_run(spark):
    def claim(doc, seq, field, raw):
        return (doc, seq, field, "FY", None, "2024-12-31", END, 1, f"Item {raw}", raw, "per share" if field == "eps_basic" else "in thousands", "HKD", "hk")

    first = spark.createDataFrame([claim("a", 0, "revenue", "100"), claim("a", 2_000_000, "cost", "7"), claim("b", 0, "revenue", "100"), claim("b", 1, "revenue", "100")], CLAIM)
    second = spark.createDataFrame([claim("a", 0, "eps_basic", "5"), claim("a", 3, "revenue", "200"), claim("c", 0, "revenue", "100"), claim("b", 0, "cost", "9")], CLAIM)
    asked = spark.createDataFrame([("a", "eps_basic", "FY"), ("a", "revenue", "FY"), ("c", "revenue", "FY")], "doc_id string, field string, period_type string")
    pages = verify.prepared_pages(spark.createDataFrame([(d, 1, "Item 100, Item 200, Item 5, Item 7, Item 9") for d in "abc"], "doc_id string, page int, text string"))
    facts = spark.createDataFrame([(d, 1, f, "FY", END, v, "HKD") for d in "abc" for f, v in (("revenue", 100_000.0), ("eps_basic", 9.0))], "doc_id string, ord long, field string, period_type string, period_end date, value double, currency string")
    both = verify.follow_up(first, second, asked)
    assert sorted((r.doc_id, r["round"], r.seq) for r in both.collect()) == [("a", 1, 0), ("a", 1, 2_000_000), ("a", 2, 2_000_001), ("a", 2, 2_000_004), ("b", 1, 0), ("b", 1, 1), ("c", 2, 0)]
    out = verify.verify_follow_up(verify.verify(first, pages, facts), both, asked, pages, facts)
    cols = ["doc_id", "seq", "round", "field", "c1", "c2", "c3", "state", "status", "category"]
    got = {(r.doc_id, r.field): r for r in out.collect()}
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, verify.verify(both, pages, facts).select(cols).collect()))
    assert {k for k, r in got.items() if r.note} == {("a", "eps_basic"), ("a", "revenue"), ("c", "revenue")}
    # the second round's per-share figure makes the first round's references unusable
    assert got["a", "revenue"].state == "invalid" and got["b", "revenue"].state == "match"


def taken_in_turn(rows):
    """One reading after the other."""
    done = []
    for value, raw, label in rows:
        digits = lambda x: (x or "").replace(",", "").strip("()")
        same = next((m for m in done if abs(m[0] - value) <= max(1e-6, 1e-9 * abs(m[0])) or m[1] and raw and digits(m[1]) == digits(raw) and abs(m[0] - value) <= 0.01 * abs(m[0])), None)
        if same:
            same[1], same[2], same[3] = same[1] or raw, same[2] or label, same[3] + 1
        else:
            done.append([value, raw, label, 1])
    return sorted(map(tuple, done), key=str)


def test_readings_are_merged_in_their_order(spark):
    r = random.Random(8)
    items = {0: [(1000.0, None, None), (1000.0 + 1e-7, "1,000", "x"), (1005.0, "1000", None), (1012.0, "1,000", "far"), (1006.0, "1006", None), (1006.0, "1000", None)]}
    for k in range(1, 40):
        items[k] = [(r.choice([100.0, 100.4, 101.0, 101.5, 100.0 + 1e-8, -100.0]), r.choice([None, "", "100", "1,00", "101"]), r.choice([None, "", "a", "b"])) for _ in range(r.randint(1, 7))]
    rows = [("d", f"f{k}", "FY", f"s{n:02}", v, "USD", label, raw) for k, own in items.items() for n, (v, raw, label) in enumerate(own)]
    got = {}
    for x in answer_key.merged(spark.createDataFrame(rows, "doc_id string, field string, period_type string, source string, value double, currency string, label string, raw string"), []).collect():
        got.setdefault(int(x.field[1:]), []).append((x.value, x.raw, x.label, x.votes))
    plain = lambda out: sorted(((v, a or None, b or None, n) for v, a, b, n in out), key=str)
    assert {k: plain(v) for k, v in got.items()} == {k: plain(taken_in_turn(v)) for k, v in items.items()}
    assert plain(got[0]) == [(1000.0, "1,000", "x", 4), (1006.0, "1006", None, 1), (1012.0, "1,000", "far", 1)]


def test_resamples_are_as_wide_as_theory_says(spark):
    rows = [(f"c{k}", j < (k % 10)) for k in range(100) for j in range(10)]
    lo, hi = evaluate.bootstrap(spark.createDataFrame(rows, "cell string, strict boolean"), "cell").first()
    shares = [k % 10 / 10 for k in range(100)]
    mean = sum(shares) / 100
    half = 1.96 * math.sqrt(sum((x - mean) ** 2 for x in shares)) / 100
    assert abs(lo - (mean - half)) < 0.25 * half and abs(hi - (mean + half)) < 0.25 * half
    assert tuple(evaluate.bootstrap(spark.createDataFrame([], "cell string, strict boolean"), "cell").first()) == (None, None)
    places = evaluate.numbered(spark.createDataFrame([(x,) for x in "dbca"] + [(None,)], "x string"), "x").collect()
    assert {r.x: r["at"] for r in places} == {None: 0, "a": 1, "b": 2, "c": 3, "d": 4}


def test_scripts_of_files_and_texts(spark):
    files = {"a.py": "# 中文\nx = '中' # c\n  '''中\n*中\nplain", "b.md": "中\nb", "c.json": "中", "data/x.py": "中", "d.py": "plain", "LICENSE": "。", "e.css": "/* 中\n//中", "f.html": " <!-- ｆ", "g.tar.gz": "豈"}
    got = {r.path: (r.kind, r.n_lines, r.n_foreign, r.n_comments) for r in evaluate.script_lines(spark.createDataFrame([*files.items(), ("n.py", None)], "path string, text string")).collect()}
    assert got == {"a.py": ("code", 5, 4, 3), "b.md": ("reader", 2, 1, None), "c.json": ("data", 1, 1, None), "LICENSE": ("reader", 1, 1, None), "e.css": ("code", 2, 2, 1), "f.html": ("code", 1, 1, 1), "g.tar.gz": ("data", 1, 1, None)}
    texts = [("en", "plain"), ("en", "中 x"), ("en", "中 x"), ("zh", "中文"), ("zh", "Revenue and EPS of X q4-b a_b b zoo"), ("zh", "AND api"), ("zh", None), (None, "x中")]
    allowed = spark.createDataFrame([("API",), ("of",)], "word string")
    assert {(r.lang, r.text, r.words) for r in evaluate.foreign_texts(spark.createDataFrame(texts, "lang string, text string"), allowed).collect()} == {("en", "中 x", None), ("zh", "Revenue and EPS of X q4-b a_b b zoo", "Revenue, and, zoo")}


def test_a_missing_rate_has_no_date(spark):
    rates = spark.createDataFrame([("USD", dt.date(2024, 1, 2), 7.0), ("HKD", dt.date(2024, 1, 5), 0.9)], "ccy string, date date, rate double")
    asks = [(1, "USD", "HKD", 4), (2, "USD", "HKD", 6), (3, "USD", "CNY", 6), (4, "EUR", "USD", 6), (5, "EUR", "EUR", 6), (6, "CNY", "HKD", 6)]
    got = compare.cross_rate(spark.createDataFrame([(*x[:3], dt.date(2024, 1, x[3])) for x in asks], "id long, src string, dst string, date date"), rates).collect()
    day = lambda n: dt.date(2024, 1, n)
    assert {r.id: (r.rate and round(r.rate, 6), r.rate_date) for r in got} == {1: (None, None), 2: (round(7 / 0.9, 6), day(2)), 3: (7.0, day(2)), 4: (None, None), 5: (1.0, day(6)), 6: (round(1 / 0.9, 6), day(5))}
