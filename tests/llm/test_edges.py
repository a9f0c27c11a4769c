"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for the other operators."""

import hashlib
import random
import time

import numpy as np

from tallywise.llm import cover_tree, decontaminate, language_id, line_dedup, quality, reply_trees, shared, textkit
from tallywise.llm.jaccard_join import jaccard_classes
from tests.llm.brute import components_of, shingle_set


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows, k = [(0, None), (1, []), (2, [0.0] * 8), (3, [float("nan")] + [1.0] * 7), (4, [1.0] * 8), (5, [2.0] * 8)], 6
    for _ in range(25):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 12)):
            rows.append((k, [float(x) for x in base + r.normal(size=8) * r.choice([0.0, 0.05, 0.2, 0.4])]))
            k += 1
    df = spark.createDataFrame([(*x, "l", 1) for x in rows], "vec_id long, embedding array<double>, label string, links int")
    good = {i: np.array(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    linked = lambda a, b: a in good and b in good and float(good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b]))) >= 0.95
    comp = components_of([i for i, _ in rows], linked)
    for x in cover_tree.linked(df).collect():
        assert x.n_links == sum(linked(x.vec_id, i) for i, _ in rows if i != x.vec_id) and x.component_id == comp[x.vec_id] and x.kept == (x.vec_id == comp[x.vec_id])
    assert cover_tree.linked(df.limit(0)).count() == 0


def test_links_of_near_copies_at_the_threshold():
    r, rows = np.random.default_rng(7), []
    unit = lambda x: x / np.linalg.norm(x)
    reach = np.sqrt(2 - 2 * 0.95)
    for _ in range(600):
        centre, way = unit(r.normal(size=64)), unit(r.normal(size=64))
        way = unit(way - (way @ centre) * centre)
        angle = lambda d: 2 * np.arcsin(d / 2)
        turned = lambda a, c=centre, w=way: np.cos(a) * c + np.sin(a) * w
        gap, off = r.uniform(1e-4, 1e-3), angle(reach) - r.uniform(1e-6, 2e-5)
        # a copy on one side of the centre and a third vector that links only with the copy, or only with the centre
        rows += [centre, turned(gap), turned(off + gap)] if r.random() < 0.5 else [centre, turned(-gap), turned(off)]
    x = np.array(rows)
    tree = cover_tree.Tree(np.arange(len(x)), x)
    links, _ = cover_tree.dual(tree, tree, 0.95, True)
    want = (((x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))) >= 0.95).sum(1) - 1
    assert (links[0] == want[tree.ids]).all()


def test_reply_trees(spark):
    nodes = spark.createDataFrame(
        [("t", 1, None, 0.0, "user", "q <x> \\l"), ("t", 2, 1, 1.0, "assistant", None), ("t", 3, 1, 5.0, "assistant", "b"), ("t", 4, 3, 0.0, "user\nx", "</turn>\n"), ("u", 1, None, None, None, ""), ("v", 9, 8, 1.0, "assistant", "orphan")],
        "conv_id string, node long, parent long, score double, role string, text string",
    )
    back = reply_trees.read_back(reply_trees.format_paths(reply_trees.reply_paths(nodes), nodes)).collect()
    got = {(r.conv_id, r["rank"]): ([(t.role, t.text) for t in r.turns], r.loss_text) for r in back}
    q = ("user", "q <x> \\l")
    assert got == {("t", 1): ([q, ("assistant", "b"), ("user\nx", "</turn>\n")], "b"), ("t", 2): ([q, ("assistant", "")], ""), ("u", 1): ([("", "")], ""), ("v", 1): ([("assistant", "orphan")], "orphan")}
    assert reply_trees.reply_paths(nodes.limit(0)).count() == 0


def test_site_lines(spark):
    rows = [(k, "a", ["menu", f"own {k}", "", " menu "]) for k in range(10)] + [(20, None, None), (21, None, []), (22, "b", ["menu"]), (23, "a", ["menu"])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, host string, lines array<string>, n_dropped int")
    got = {r.page_id: (r.lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df, "host", "lines").collect()}
    assert got[3] == (["own 3", ""], 2) and got[23] == ([], 1) and got[22] == (["menu"], 0) and got[20] == (None, 0)
    assert line_dedup.drop_boilerplate(df.limit(0), "host", "lines").count() == 0


def test_contained_items_against_brute_force(spark):
    r = random.Random(2)
    items = {k: " ".join(f"i{k}.{j}" for j in range(n)) for k, n in enumerate([1, 3, 5, 6, 12, 20, 40, 90, 300])} | {50: None, 51: " "}
    docs = {0: None, 1: "", 2: items[1], 3: items[0].upper()}
    for k in range(60):
        parts = [f"w{r.randint(0, 999)}" for _ in range(r.choice([5, 300, 4000]))]
        words = items[r.choice(range(9))].split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "x"
        parts[r.randrange(len(parts)) : 0] = words
        docs[10 + k] = " ".join(parts)
    d = spark.createDataFrame([(*x, 1) for x in docs.items()], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([*items.items(), (5, items[5])], "item_id long, text string")
    want = {(a, b) for a, t in docs.items() for b, u in items.items() if shingle_set(u) and 100 * len(shingle_set(u) & shingle_set(t)) >= 75 * len(shingle_set(u))}
    assert {(x.doc_id, x.item_id) for x in decontaminate.contained_items(d, i).collect()} == want
    assert decontaminate.contained_items(d, i.limit(0)).count() == 0 and decontaminate.contained_items(d.limit(0), i).count() == 0


def test_declared_language_far_into_a_page(spark):
    late = {1: "<!-- " + "licence " * 1000 + '--><html class="x" lang="de"><p>hallo', 2: "<script>" + "x = '<html lang=xx>';\n" * 400 + '</script>\n<HTML LANG=fr-CA>', 3: " " * 300_000 + "<html lang='ES'>", 4: "<p>" + "no tag " * 2000, 5: "<html lang=en>"}
    df = spark.createDataFrame([(k, "http://a.com/", h) for k, h in late.items()], "page_id long, url string, html string")
    assert {r.page_id: r["__declared"] for r in language_id.evidence(df).collect()} == {1: "de", 2: "fr", 3: "es", 4: "", 5: "en"}


def test_quality_and_language_on_odd_rows(spark):
    docs = spark.createDataFrame([(k, f"plain words here number {k}" if k % 2 else "ALL CAPS!! NOISE!! HERE!!", "en", "s") for k in range(40)] + [(90, None, None, None), (91, "", "en", None), (92, "x" * 200_000, "en", "s")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(0, 0), (90, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == 43 and all(got[k].predicted == k % 2 for k in range(40)) and 0 <= got[90].score <= 1
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    model = language_id.fit_text(docs)
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.com/", "<html lang=en><p>plain words here", "y"), (2, "http://a.com/", "<html lang=en><p>plain words here", "y")], "page_id long, url string, html string, lang string")
    assert {r.page_id: r.lang for r in language_id.identify(pages, model).collect()} == {1: "en", 2: "en"}
    assert language_id.identify(pages.limit(0), model).count() == 0
    empty = language_id.fit_text(docs.limit(0))
    assert {r.lang for r in language_id.identify(pages, empty).collect()} == {None}
    assert hashlib.sha256(b"").hexdigest()


def test_hosts_that_hold_most_pages(spark, monkeypatch):
    """The join of uneven keys, and languages by it, are those of the plain join."""
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"h{k}" if k % 2 else None) for k in range(300)], "id long, host string")
    table = spark.createDataFrame([("hot", 1), ("h3", 2), ("h9", 3), ("none", 4)], "host string, v int")
    for most in (1, 2, 1000):
        monkeypatch.setattr(shared, "HOT", most)
        got = shared.join_uneven(rows, table, "host")
        assert sorted(map(tuple, got.select("id", "host", "v").collect())) == sorted(map(tuple, rows.join(table, "host", "left").select("id", "host", "v").collect()))
    assert shared.join_uneven(rows.limit(0), table, "host").count() == 0
    model = language_id.fit_text(spark.createDataFrame([("the house and not", "en"), ("der und nicht haus", "de")], "text string, lang string"))
    pages = spark.createDataFrame([(k, f"http://{'hot' if k % 3 else k}.com/", f"<p>{'the house' if k % 2 else 'der haus'}" if k % 5 else None, "x") for k in range(60)], "page_id long, url string, html string, host string")
    want = sorted(map(str, language_id.identify(pages, model).collect()))
    monkeypatch.setattr(language_id, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(shared, "HOT", 3)
    assert sorted(map(str, language_id.identify(pages, model).collect())) == want and len(want) == 60


def test_vectors_over_many_blocks_with_copies(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    monkeypatch.setattr(cover_tree, "VISITORS", 4)
    monkeypatch.setattr(cover_tree, "HOT", 20)
    r, rows = np.random.default_rng(5), []
    for _ in range(60):
        base = r.normal(size=12)
        for _ in range(r.integers(1, 9)):
            x = [float(v) for v in np.float32(base + r.normal(size=12) * r.choice([0.0, 0.03, 0.1, 0.2]))]
            rows += [x] * int(r.choice([1, 1, 1, 2, 40]))
    rows = list(enumerate(rows)) + [(9000, [1.0] * 5), (9001, [3.0] * 5), (9002, [1.0] * 5)]
    # a repeated id counts once, with the smallest of its vectors
    twice = [*rows, (0, [99.0] * 12), rows[7]]
    for kind in ("float", "double"):
        got = cover_tree.linked(spark.createDataFrame(twice, f"vec_id long, embedding array<{kind}>")).collect()
        assert len(got) == len(twice)
        x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
        linked = lambda a, b: len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.95  # noqa: E731, B023
        comp = components_of(list(x), linked)
        for y in got:
            assert (y.n_links, y.component_id) == (sum(linked(y.vec_id, i) for i in x if i != y.vec_id), comp[y.vec_id])


def test_blocks_visit_alike():
    for n in (1, 2, 7, 64):
        met = [(k, other) for k in range(n) for other in range(n) if cover_tree.visits(k, other)]
        assert sorted(tuple(sorted(x)) for x in met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        received = np.bincount([other for _, other in met], minlength=n)
        assert received.max() - received.min() <= 1


def test_part_of_a_tree_keeps_links():
    r = np.random.default_rng(8)
    base = r.normal(size=(30, 16))
    x = base[r.integers(0, 30, 400)] + r.normal(size=(400, 16)) * r.choice([0.01, 0.1, 0.25], (400, 1))
    one, two = cover_tree.Tree(np.arange(200), x[:200]), cover_tree.Tree(np.arange(200, 400), x[200:], np.full(200, 3))
    for share in (0.0, 0.05, 0.5, 1.0):
        keep = r.random(200) < share
        if not keep.any():
            keep[17] = True
        part = cover_tree.Tree.unpacked(two.packed(keep))
        links, _ = cover_tree.dual(one, part, 0.95, False)
        u = lambda t: t.vectors / np.linalg.norm(t.vectors, axis=1, keepdims=True)
        want = u(one) @ u(part).T >= 0.95
        assert (part.ids == two.ids[keep]).all() and (links[0] == 3 * want.sum(1)).all() and (links[1] == want.sum(0)).all()


def test_rows_without_an_id(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, cover_tree.linked(vectors).collect()), key=str) == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, None), (None, 0, None, None)]
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A b c d e f"), (None, "x y z 1 2 3 4")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_classes(docs).collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 0, None), (None, 2, None), (None, 3, None)]
    items = spark.createDataFrame([(1, "a b c d e f"), (None, "x y z 1 2 3 4"), (None, None)], "item_id long, text string")
    found = decontaminate.contained_items(docs, items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found), key=str) == [(1, 1), (2, 1), (None, 1), (None, None)]


def test_hashes_of_long_texts_are_those_of_the_whole():
    r = np.random.default_rng(1)
    for n in (0, 1, textkit.HASHED, textkit.HASHED + 1, 3 * textkit.HASHED + 17):
        for share in (0.2, 0.00001):
            inside, data = r.random(n) < 0.8, r.integers(0, 256, n).astype(np.uint8)
            start = inside & (r.random(n) < share)
            start[np.flatnonzero(inside)[:1]] = True
            for x, y in zip(textkit.run_hashes(data, inside, start), textkit._run_hashes(data, inside, start), strict=True):
                assert x.dtype == y.dtype and (x == y).all()


def test_vectors_of_extreme_scale(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e198]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [5e-324, 0.0]), (6, [1.7e308, 1.7e308]), (7, [1e-310, 1e-310]), (8, [0.0, 0.0])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in cover_tree.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: (4, 1) for k in range(1, 6)} | {6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_an_item_that_a_document_repeats_for_long():
    r = np.random.default_rng(3)
    item = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    signatures = decontaminate.Signatures([(1, item), (2, item[:7]), (3, r.integers(0, 1 << 63, 50).astype(np.uint64))])
    doc = np.concatenate((r.integers(0, 1 << 63, 1000).astype(np.uint64), np.full(500_000, item[5]), r.permutation(item), np.tile(item[:9], 5_000)))
    began = time.time()
    assert {(a, n, k) for a, n, k in signatures.contained(doc, 75)} == {(1, len(item), len(item)), (2, 7, 7)}
    assert time.time() - began < 60


def test_items_of_one_id_go_out_in_many_parts(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(30)]
    items = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in enumerate(texts[:20])], "doc_id long, text string")
    want = sorted(map(str, decontaminate.contained_items(docs, items).collect()))
    made, own = [], decontaminate.Signatures.__init__
    monkeypatch.setattr(decontaminate.Signatures, "__init__", lambda self, found: (made.append(len(found)), own(self, found))[1])
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 24)
    assert sorted(map(str, decontaminate.contained_items(docs, items).collect())) == want and len(want) == 20
    assert sum(made) == 30 and len(made) == 10 and max(made) <= 10


def test_host_without_user_and_port(spark):
    urls = ["http://a:b@News.example.de:80/x@y", "https://news.example.de?q=a@b", "http://u@host.fr#f", "HTTP://h.uk:1/", None, "no address"]
    pages = spark.createDataFrame([(k, u, "<p>x</p>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = language_id.evidence(pages).orderBy("page_id").select("__host", "__suffix").collect()
    assert [tuple(r) for r in got] == [("news.example.de", "de"), ("news.example.de", "de"), ("host.fr", "fr"), ("h.uk", "uk"), ("", ""), ("", "")]


def test_dropped_lines_with_clashing_names_and_empty_tables(spark):
    rows = [(k, "h", ["menu", f"own {k}"] if k else ["menu"] * 50_000, -1) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, host string, lines array<string>, n_dropped int")
    got = {r.page_id: (r.n_lines, r.n_dropped, r.lines) for r in line_dedup.drop_boilerplate(pages, "host", "lines").collect()}
    assert got == {0: (50_000, 50_000, []), **{k: (2, 1, [f"own {k}"]) for k in (1, 2, 3)}}
    assert line_dedup.drop_boilerplate(pages.limit(0), "host", "lines").count() == 0
