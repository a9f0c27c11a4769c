import math
import zlib
from collections import Counter, defaultdict

import pytest

from tallywise.llm import kneser_ney


def brute(train: list[str], texts: list[str]):
    low = lambda t: [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    uni, bi = Counter(), Counter()
    for t in train:
        toks = [*low(t), None]
        uni.update(toks)
        bi.update(zip(["<s>", *toks[:-1]], toks, strict=True))
    n, v = sum(uni.values()), len(uni)
    behind, after = Counter(w for _, w in bi), defaultdict(Counter)
    for (a, w), c in bi.items():
        after[a][w] = c
    d = lambda cs: (0.0, *kneser_ney.discounts([sum(c == k for c in cs) for k in (1, 2, 3, 4)]))
    d1, d2 = d(behind.values()), d(bi.values())
    rest = sum(d1[min(c, 3)] for c in behind.values())
    for t in texts:
        toks, base, score, last = [*low(t), None], 0.0, 0.0, "<s>"
        for w in toks:
            base += math.log10((uni[w] + 1) / (n + v + 1))
            p = (behind[w] - d1[min(behind[w], 3)]) / len(bi) + rest / len(bi) / (v + 1) if bi else 1 / (v + 1)
            if last in after:
                total = sum(after[last].values())
                c = after[last][w]
                p = (c - d2[min(c, 3)]) / total + sum(d2[min(x, 3)] for x in after[last].values()) / total * p
            score, last = score + math.log10(p), w
        yield len(toks), sum(uni[w] > 0 for w in toks), n, base, score


def check(spark, train, texts):
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in kneser_ney.score(rows.selectExpr("*", "'x' score", "1 n_tokens"), model).collect()}
    for i, want in enumerate(brute(train, texts)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def test_edges(spark):
    texts = ["The cat sat", "the cat SAT the cat", "", None, "a a a a a b", "b a\tb\n\na", "a a a a a b", "unseen words here the cat", "é É"]
    check(spark, texts[:7], texts)
    check(spark, [], texts)
    check(spark, ["x"], texts)


def test_same_as_brute_force_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    check(spark, train, [t for _, t in docs])


def test_unseen_words_keep_some_mass(spark):
    train = ["c", "d", "d d b a", "a d d a", "c b a c", "a", "a", "b d a b", "d b c b", "d c", "d", "b"]
    texts = [*train, "zzz", "zzz zzz a", "a zzz", "d d d d"]
    check(spark, train, texts)
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(math.isfinite(r.score) for r in kneser_ney.score(rows, model).collect())
    # all that can follow a context sums to one: the words, the end, and one place for any unknown word
    one = spark.createDataFrame(list(enumerate(["a", "b", "c", "d", "zzz", ""])), "doc_id long, text string")
    first = {r.doc_id: r.score for r in kneser_ney.score(one, model).collect()}
    after = {r.doc_id: r.score for r in kneser_ney.score(spark.createDataFrame([(k, w + " zzz") for k, w in enumerate(["a", "b", "c", "d"])], "doc_id long, text string"), model).collect()}
    assert first[5] < 0 and all(math.isfinite(x) for x in [*first.values(), *after.values()])


def test_a_lost_shard_is_an_error(spark):
    import os

    rows = spark.createDataFrame([(1, "a b c a b")], "doc_id long, text string")
    for kind in ("words-", "counts-", "pairs-", "paircounts-", "contexts-"):
        model = kneser_ney.fit(rows)
        os.remove(f"{model.folder}/{next(x for x in sorted(model.stored) if x.startswith(kind))}")
        lost = sorted(x for x in model.stored if x.startswith(kind) and not os.path.exists(f"{model.folder}/{x}"))
        # of several shards, those that hold the text's words have to raise
        for x in model.stored:
            if x.startswith(kind) and os.path.exists(f"{model.folder}/{x}"):
                os.remove(f"{model.folder}/{x}")
        assert lost
        with pytest.raises(Exception, match="No such file"):
            kneser_ney.score(rows, model).collect()
