"""Votes, posteriors, cycles, signatures and clashing names against plain versions."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tallywise.llm import decontaminate, language_id, packing, quality, reply_trees
from tallywise.llm.jaccard_join import Keys, allocate, bands, differ
from tallywise.llm.textkit import shingles
from tests.llm.brute import words_of


def prose(r, k):
    good = [f"word{r.randrange(60)}" for _ in range(r.randrange(3, 60))]
    return " ".join(good) if k % 3 else " ".join(f"{w}{r.randrange(4)}" for w in good)


def test_votes_against_brute_force(spark):
    r = random.Random(3)
    texts = {k: prose(r, k) for k in range(120)} | {900: None, 901: "", 902: "one"}
    docs = spark.createDataFrame([*texts.items(), (5, "a repeated row")], "doc_id long, text string")
    labels = [(k, int(k % 3 > 0)) for k in range(0, 120, 2)] + [(4, 0), (7, None)]
    voters = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(voters.labels) == 60 and voters.labels.sum() == sum(k % 3 > 0 and k != 4 for k in range(0, 120, 2))
    got = {x.doc_id: x.score for x in quality.score(docs.where("text is null or text <> 'a repeated row'"), voters).collect()}
    for d, t in texts.items():
        (_, _, c), = quality.terms(pa.array([t], pa.string()))
        v = [0.0] * voters.axes.shape[1]
        for term, share in zip(c.term, c.value, strict=True):
            v = [a + float(share) * float(voters.idf[term]) * float(b) for a, b in zip(v, voters.axes[term], strict=True)]
        size = math.sqrt(sum(a * a for a in v))
        if not size:
            assert got[d] == pytest.approx(voters.prior)
            continue
        near = sorted(((sum(a / size * float(b) for a, b in zip(v, w, strict=True)), y) for w, y in zip(voters.vectors, voters.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(x, 0) ** 8 for x, _ in near]
        assert got[d] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight), abs=2e-3), (d, size, near[-2:])


def test_terms_hold_words(spark):
    (_, _, one), = quality.terms(pa.array(["the river was calm and blue"]))
    (_, _, two), = quality.terms(pa.array(["the motor was loud and grey"]))
    words = lambda c: {t for t in c.term.tolist() if t >= quality.FORMS}
    assert len(words(one)) == 11 and words(one) & words(two) and len(words(one) - words(two)) >= 6


def test_axes_span_the_leading_directions():
    r = np.random.default_rng(1)
    dense = np.zeros((40, quality.TERMS), np.float32)
    dense[:, :30] = r.normal(size=(40, 4)) @ r.normal(size=(4, 30))
    row, term = np.nonzero(dense)
    c = quality.Counts(40, row, term, dense[row, term])
    axes = quality._axes(c)
    assert np.allclose(c.times(axes), dense @ axes, atol=1e-3)
    assert np.allclose(dense @ axes @ axes.T, dense, atol=1e-2)


def test_posteriors_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = {"de": ["der", "und", "nicht", "haus"], "en": ["the", "and", "house", "not"], "fr": ["le", "et", "maison", "pas"]}
    say = lambda x, n: " ".join(r.choice(vocabulary[x]) for _ in range(n))
    docs = spark.createDataFrame([(say(x, 30), x) for x in vocabulary for _ in range(5)] + [("z", None), (None, "de")], "text string, lang string")
    model = language_id.fit_text(docs)
    rows = []
    for k in range(60):
        x = r.choice(list(vocabulary))
        host = r.choice([f"a.{x}", "b.com", "c.org", "d.com"])
        tag = r.choice([f"<html lang={x}>", "<html>", "<html lang=en>"])
        rows.append((k, r.choice([f"http://{host}/p", f"http://{host}:80/", None]), r.choice([f"{tag}<p>{say(x, r.choice([1, 2, 20]))}", tag, None])))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = {e.page_id: e for e in language_id.evidence(pages).collect()}
    names, ll = model.languages, {}
    for k, e in seen.items():
        data = np.frombuffer(e["__text"].encode(), np.uint8)
        ll[k] = [float(model.log_p[j][language_id.trigrams(data)].sum()) if len(data) >= 3 else 0.0 for j in range(len(names))]
    guess = {k: max(range(len(names)), key=lambda j: (x[j], -j)) for k, x in ll.items() if max(x) < 0}
    for got in language_id.identify(pages, model).collect():
        e, k = seen[got.page_id], got.page_id
        count = lambda own: [sum(guess[i] == j for i in guess if i != k and own(seen[i])) for j in range(len(names))]  # noqa: E731, B023
        share = lambda n, p: [(a + language_id.STRENGTH * b) / (sum(n) + language_id.STRENGTH) for a, b in zip(n, p, strict=True)]
        total = count(lambda x: True)
        flat = [(a + 1) / (sum(total) + len(names)) for a in total]
        host = share(count(lambda x: x["__host"] == e["__host"]), share(count(lambda x: x["__suffix"] == e["__suffix"]), flat))  # noqa: B023
        declared = [a / b for a, b in zip(share(count(lambda x: x["__declared"] == e["__declared"]), flat), flat, strict=True)] if e["__declared"] else [1.0] * len(names)  # noqa: B023
        logs = [language_id.TEMPER * (x - max(ll[k])) + math.log(a) + math.log(b) for x, a, b in zip(ll[k], host, declared, strict=True)]
        odds = [math.exp(x - max(logs)) for x in logs]
        assert got.probability == pytest.approx(max(odds) / sum(odds)) and got.lang == names[odds.index(max(odds))]


def test_cycles_repeats_and_null_conversations(spark):
    rows = [("c", 1, 2, "user", "x"), ("c", 2, 1, "user", "y"), ("c", 3, 1, "assistant", "below a cycle"), ("c", 5, None, "user", "q"), ("c", 6, 5, "assistant", "a"), ("c", 6, 5, "assistant", "b"), ("c", 6, 5, "assistant", "a")]
    rows += [("", 1, None, "user", "empty"), (None, 1, None, "user", "null"), ("s", 1, 1, "user", "itself")]
    nodes = spark.createDataFrame([(*x[:3], 1.0, *x[3:]) for x in rows], "conv_id string, node long, parent long, score double, role string, text string")
    back = reply_trees.read_back(reply_trees.format_paths(reply_trees.reply_paths(nodes), nodes)).collect()
    assert {(x.conv_id, x.leaf): [t.text for t in x.turns] for x in back} == {("c", 6): ["q", "a"], ("", 1): ["empty"], (None, 1): ["null"]}
    deep = spark.range(5000).selectExpr("'d' AS conv_id", "id AS node", "IF(id = 0, NULL, id - 1) AS parent", "0D AS score", "'user' AS role", "repeat('<', 20) AS text")
    assert reply_trees.reply_paths(deep).where("leaf = 4999").count() == 5000


def test_signatures_find_contained_items_among_many():
    r = random.Random(9)
    items = [(k, " ".join(f"t{r.randrange(4000)}" for _ in range(r.choice([5, 6, 9, 14, 20, 30, 60, 120, 300])))) for k in range(300)]
    sets = [(k, np.unique(s)) for k, (_, s) in zip([k for k, _ in items], shingles(pa.array([t for _, t in items])), strict=True)]
    found, wanted = 0, 0
    signatures = decontaminate.Signatures(sets)
    for _ in range(400):
        k, text = r.choice(items)
        own = text.split()
        for _ in range(len(own) // 25):
            own[r.randrange(len(own))] = "other"
        words = [f"d{r.randrange(9000)}" for _ in range(r.choice([0, 50, 3000]))]
        words[r.randrange(len(words) + 1) : 0] = own
        (_, s), = shingles(pa.array([" ".join(words)]))
        u = dict(sets)[k]
        if 100 * len(np.intersect1d(u, s)) >= 75 * len(u):
            wanted += 1
            found += k in [i for i, _, _ in signatures.contained(s, 75)]
    assert wanted > 200 and found == wanted
    assert sum(len(u) for _, u in sets) > 1.3 * len(signatures.values)


def test_segments_of_linked_sets_agree():
    r = np.random.default_rng(2)
    schemes = [allocate(low, high, 1000, 75) for low, high in bands(75) if low < 5000]
    common = np.sort(r.integers(0, 1 << 63, 300).astype(np.uint64))
    keys = Keys(schemes, 75, common)
    for hot in (None, np.sort(r.integers(0, 1 << 63, 10).astype(np.uint64))):
        keys.hot = hot
        for n in (1, 2, 3, 4, 5, 7, 10, 20, 50, 120, 400, 900):
            for share in (0.0, 0.6, 1.0):
                for _ in range(12):
                    base = np.unique(np.concatenate((r.choice(common, min(300, int(share * n)), replace=False), r.integers(0, 1 << 63, n - min(300, int(share * n))).astype(np.uint64))))
                    gone = r.integers(0, differ(len(base), len(base), 75) // 2 + 1)
                    other = np.unique(np.concatenate((np.delete(base, r.choice(len(base), gone, replace=False)), r.integers(0, 1 << 63, r.integers(0, gone + 1)).astype(np.uint64))))
                    both = len(np.intersect1d(base, other))
                    if 100 * both >= 75 * (len(base) + len(other) - both):
                        (a, p), (b, q) = keys.of(base), keys.of(other)
                        assert len(np.intersect1d(a, b)) >= max(1, p if len(base) <= len(other) else q)


def test_packing_takes_any_other_columns(spark):
    names = ["at", "first", "lo", "hi", "times", "before", "n"]
    pieces = spark.createDataFrame([(k, k % 3, 400 + k % 5 * 100, *range(7)) for k in range(30)], "doc_id long, piece int, length long, " + ", ".join(f"{x} int" for x in names))
    rows = packing.pack(pieces, ["doc_id", "piece"]).collect()
    assert len(rows) == 30 and rows[0].asDict().keys() == {"doc_id", "piece", "length", *names, "sequence_id", "offset"}
    own = {}
    for x in rows:
        own.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for x in own.values():
        assert sum(n for _, n in x) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False))


def test_large_counts_of_pairs_keep_64_bits(tmp_path):
    from tallywise.llm import kneser_ney

    model = kneser_ney.Model(str(tmp_path), word_base=[0, 3], pair_bits=1, n=10, v=3)
    pairs = np.array([5, 9, 12], np.uint64)
    parts = model.parts(pairs)
    for p in set(parts.tolist()):
        own = pairs[parts == p]
        counts = np.where(own == 9, 7_000_000_000, 4)
        kneser_ney._store(str(tmp_path), f"pairs-{p}", own)
        kneser_ney._store(str(tmp_path), f"paircounts-{p}", np.minimum(counts, kneser_ney.LARGE).astype(np.uint32))
        if (large := counts >= kneser_ney.LARGE).any():
            kneser_ney._store(str(tmp_path), f"largepairs-{p}", own[large])
            kneser_ney._store(str(tmp_path), f"largecounts-{p}", counts[large])
    model.stored = set(os.listdir(tmp_path))
    assert model.pair_counts(pairs).tolist() == [4, 7_000_000_000, 4]
    assert words_of("A b") == ["a", "b"]
