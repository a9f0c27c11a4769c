import random

import numpy as np

from tallywise.llm import jaccard_join
from tallywise.llm.jaccard_join import allocate, bands, jaccard_classes
from tests.llm.brute import jaccard_components, shingle_set


def check(spark, texts):
    df = spark.createDataFrame([(*x, "a", 1) for x in texts.items()], "doc_id long, text string, n string, rep int")
    got = {r.doc_id: r for r in jaccard_classes(df).collect()}
    want = jaccard_components(texts)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingle_set(texts[d])) for d, r in got.items())


def test_links_around_the_threshold_and_edges(spark):
    r = random.Random(5)
    texts, vocabulary = {0: None, 1: "", 2: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "a b c d", 7: "A b\tc d"}, [f"w{k}" for k in range(300)]
    for _ in range(45):
        base = [r.choice(vocabulary) for _ in range(r.choice([5, 6, 8, 9, 12, 15, 20, 30, 45, 80, 150, 400]))]
        texts[len(texts)] = " ".join(base)
        for _ in range(r.randint(0, 5)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                at = r.randrange(len(own))
                own[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 2)
            texts[len(texts)] = " ".join(own)
    check(spark, texts)


def test_large_groups_chains_and_shared_passages(spark):
    r = random.Random(6)
    base, shared = [f"b{k}" for k in range(90)], " ".join(f"s{k}" for k in range(40))
    texts = {}
    for k in range(120):  # near copies, many of them under the threshold with each other
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = f"x{r.random()}"
        texts[k] = " ".join(own)
    chain = [f"c{k}" for k in range(200)]
    for k in range(40):
        texts[1000 - k] = " ".join(chain[3 * k : 3 * k + 60])
    for k in range(150):
        texts[2000 + k] = shared + " " + " ".join(f"u{k}.{j}" for j in range(r.randint(20, 80)))
    for k in range(30):
        texts[3000 + k] = texts[5]
    check(spark, texts)


def test_members_of_runs_grow_with_the_sets_of_near_copies(spark, monkeypatch):
    r, kept, real = random.Random(7), {}, jaccard_join.materialise

    def noted(df, name):
        kept[name] = out = real(df, name)
        return out

    monkeypatch.setattr(jaccard_join, "materialise", noted)
    base = [f"b{k}" for k in range(300)]
    for common, copies in ((2, 40), (2, 160), (0.004, 160)):  # no key is hot, or all are
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        texts = {}
        for k in range(copies):
            own = list(base)
            own[r.randrange(len(own))] = f"x{k}"
            texts[k] = " ".join(own)
        check(spark, texts)
        assert 0 < kept["members"].count() <= (4 if common > 1 else 40) * copies


def test_unions_hold_all_runs_and_cost_no_more():
    r = np.random.default_rng(8)
    for own in (0, 8, 30):
        runs = [np.unique(np.concatenate(([1], r.choice(own or 2000, own or 40), r.choice(np.arange(100, 160), r.integers(20, 60))))) for _ in range(150)]
        runs += [np.arange(1, 3000), np.arange(1, 3001), np.arange(1, 3000)]
        runs = sorted(runs, key=len, reverse=True)
        out = jaccard_join._unions(runs)
        assert all(any(np.isin(x, u).all() for _, u in out) for x in runs)
        assert len({first for first, _ in out}) == len(out) and all((np.diff(u) > 0).all() for _, u in out)
        assert sum(len(u) ** 2 for _, u in out) <= sum(len(x) ** 2 for x in runs)
        assert sum(jaccard_join._cost(len(u)) for _, u in out) <= sum(jaccard_join._cost(len(x)) for x in runs)


def test_heavy_smallest_ids_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "UNITED", 100)
    test_large_groups_chains_and_shared_passages(spark)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_classes(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard_classes(df.limit(0)).count() == 0


def test_allocations_reach_the_needed_differences():
    for low, high in bands(75)[:40]:
        s = allocate(low, high, 1000, 75)
        assert s.segments + s.twos >= (high + s.top) * 25 // 175 + 1 or s.segments >= 3 * high


def test_further_links_extend_components(spark):
    import random

    from tallywise.llm.components import components, extended

    r = random.Random(5)
    for n in (0, 3, 60):
        one, two = ([(r.randrange(80), r.randrange(80)) for _ in range(k)] for k in (n, 40))
        frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
        got = {tuple(x) for x in extended(components(frame(one)), frame(two)).collect()}
        assert got == {tuple(x) for x in components(frame(one + two)).collect()}
