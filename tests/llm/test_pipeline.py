import corpus_pipeline
from tests.llm.brute import jaccard_components, shingle_set
from tallywise.llm import line_dedup, quality
from tallywise.llm.queries import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    good = corpus_pipeline.quality_classifier(spark, docs, SF)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept, given = rows(good), rows(docs)
    assert good.columns == columns and all((d in kept) == bool(q) for d, q in labels.items())
    voters = quality.fit(docs, table(spark, SF, "labels").where("crc32(string(doc_id)) % 3 <> 1"))
    assert set(kept) == {r.doc_id for r in quality.score(docs, voters).collect() if r.predicted}

    lined = corpus_pipeline.site_line_dedup(spark, good, SF)
    pages, counts = {}, {}
    for r in kept.values():
        pages[r.source] = pages.get(r.source, 0) + 1
        for x in {x.strip(" \t\r\f") for x in r.text.split("\n")} - {""}:
            counts[r.source, x] = counts.get((r.source, x), 0) + 1
    drop = {k for k, n in counts.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * pages[k[0]]}
    own = rows(lined)
    assert lined.columns == columns and set(own) == set(kept) and [f.dataType for f in lined.schema] == [f.dataType for f in docs.schema]
    for d, r in own.items():
        text = "\n".join(x for x in kept[d].text.split("\n") if (r.source, x.strip(" \t\r\f")) not in drop)
        assert r.text == text and r.n_chars == (len(text) if text != kept[d].text else given[d].n_chars)

    single = corpus_pipeline.ngram_jaccard_join(spark, lined, SF)
    comp = jaccard_components({d: r.text for d, r in own.items()})
    assert single.columns == columns and set(rows(single)) == {d for d, c in comp.items() if d == c}

    clean = corpus_pipeline.benchmark_decontamination(spark, single, SF)
    items = [shingle_set(r.text) for r in table(spark, SF, "benchmark").collect()]
    left = {d for d, r in rows(single).items() if not any(i and 100 * len(i & shingle_set(r.text)) >= 75 * len(i) for i in items)}
    assert clean.columns == columns and set(rows(clean)) == left

    packed = corpus_pipeline.best_fit_packing(spark, clean, SF).collect()
    assert {r.doc_id for r in packed} == left
    assert {(r.doc_id, r.piece) for r in packed} == {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect()}


def test_odd_rows_go_through(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 3000, "en", "s", 6000), (4, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        lined = corpus_pipeline.site_line_dedup(spark, df, SF)
        assert sorted(map(tuple, lined.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
        single = corpus_pipeline.ngram_jaccard_join(spark, lined, SF)
        assert single.count() == df.count()
        assert corpus_pipeline.benchmark_decontamination(spark, single, SF).count() == df.count()
        assert corpus_pipeline.best_fit_packing(spark, single, SF).count() == (6 if df is docs else 0) or df is docs
        assert corpus_pipeline.quality_classifier(spark, df, SF).columns == docs.columns


def test_repeated_rows_of_one_id(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (1, long), (2, long + " x"), (3, "other text of five words"), (3, "other text of five words"), (None, "a"), (None, "a"), (4, None), (4, None), (5, "single")]
    docs = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.ngram_jaccard_join(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 4, 5, None, None]
