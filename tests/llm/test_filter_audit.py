"""The audit of filters against a plain walk through every order."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallywise.llm import filter_audit


def failing(rows):
    """Letters that each (doc_id, text, lang) fails."""
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > smallest[t]]
        yield {x for x, y in zip("ABCDE", fails, strict=True) if y}


def by_hand(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    out, shares = Counter(), Counter()
    for (d, _, lang), fails in zip(rows, failing(rows), strict=True):
        for order in map("".join, permutations("ABCDE")):
            first = min((order.index(f) for f in fails), default=9)
            for step, f in enumerate(order):
                key = (lang or "", order, step + 1)
                out[*key, "unique_fails"] += fails == {f}
                out[*key, "redundant"] += f in fails and first < step
                out[*key, "kept"] += first > step
                if first == step:
                    out[*key, "removed"] += 1
                    out[*key, "good_lost"] += d in good
                    out[*key, "toxic_lost"] += d in toxic
                    shares[lang or "", f] += 1
    for part in {x or "" for _, _, x in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                out[part, order, step + 1, "shapley"] = shares[part, f]
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, quality int, mask string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, said, filter_audit.text_filters(F.coalesce("text", F.lit(""))), "E").collect()
    assert len(got) == 600 * len({x or "" for _, _, x in rows})
    want = by_hand(rows, labels)
    for r in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"):
            assert r[c] == want[r.part, r.filter_order, r.step, c], (r, c)


def test_every_order_by_hand(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["W", "w%", "word", "other", "x#"] if r.random() < 0.2 else [f"v{r.randint(0, 9999)}"]) for _ in range(r.choice([3, 150, 250, 400]))) for _ in range(30)]
    texts += ["", None, " \t", "same " * 300, "ALL CAPS " * 120, "w " * 100_000]
    rows = [(k, r.choice(texts), r.choice(["en", "de", None, "", "one" if k == 5 else "en"])) for k in range(150)]
    rows += [(7, "of one id", "en"), (7, "of one id", "en"), (7, "of one id", "de"), (3, "of one id", "fr"), (None, "of one id", "en"), (None, None, None), (None, "no id", "en")]
    labels = [(k, r.randint(0, 1), r.choice([0, 1, None])) for k in range(0, 150, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    check(spark, rows, labels)


def test_a_text_of_most_rows_and_empty_tables(spark):
    check(spark, [(k, "the same text" if k % 3 else f"own {k}", "en") for k in range(60)], [(k, 1, 0) for k in range(60)])
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels, filter_audit.text_filters(F.col("text")), "E").count() == 0
    check(spark, [(1, "a", "en"), (2, "a", None)], [])


def test_labels_are_not_broadcast(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "'en' AS part", "0 AS mask", "unhex(sha2(string(id), 256)) AS digest").write.parquet(f"{tmp_path}/marks")
    spark.range(0, 400, 2).selectExpr("id AS doc_id", "1 AS quality", "int(id % 4 = 0) AS toxic").write.parquet(f"{tmp_path}/labels")
    hist = filter_audit.histogram(spark.read.parquet(f"{tmp_path}/marks"), spark.read.parquet(f"{tmp_path}/labels"), 1)
    assert [tuple(r) for r in hist.collect()] == [("en", 0, 400, 200, 100)]
    plan = hist._jdf.queryExecution().executedPlan().toString()  # the one that ran
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("filters", [1, 2, 3, 6])
def test_fit_is_the_mean_over_orders(filters):
    r = random.Random(filters)
    removed = [0] + [r.randint(0, 50) for _ in range((1 << filters) - 1)]
    total, orders = [0] * filters, list(permutations(range(filters)))
    for order in orders:
        before = 0
        for k in order:
            total[k] += removed[before | 1 << k] - removed[before]
            before |= 1 << k
    assert [x * len(orders) for x in filter_audit.shapley(removed, filters)] == total
