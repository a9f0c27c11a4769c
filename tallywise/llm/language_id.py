"""Language of web pages by Bayesian fusion of evidence.

Text likelihoods come from byte trigrams counted over labelled documents. Each page's declared markup language and
address suffix are further evidence, and its host gives a prior that is smoothed towards its suffix, and that towards
all pages; these tables are grouped aggregates of a first guess from text alone, of which a page leaves out its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import html_lines, markup
from .shared import join_uneven, materialise
from .textkit import LOWER, pieces

BUCKETS, SLICE = 1 << 14, 256
#: Weight of one trigram's evidence (neighbouring trigrams overlap), and pseudo-counts of the next wider group.
TEMPER, STRENGTH = 0.3, 20.0
#: Hosts (suffixes, declarations) whose tables are broadcast; more are joined by shuffling.
BROADCAST_HOSTS = 50_000


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of all byte trigrams, A-Z lower-cased."""
    b = LOWER[data].astype(np.uint32)
    x = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def _row_of(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each trigram place, and which places lie within one row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return row[:-2], row[2:] == row[:-2]


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets


def fit_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Trigram counts of all rows with a language, added up by language and slice of buckets."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                if len(data) < 3:
                    continue
                names = sorted({x for x in langs[lo:hi] if x is not None})
                code = np.array([names.index(x) if x is not None else -1 for x in langs[lo:hi]])
                row, whole = _row_of(offsets, len(data))
                own = code[row]
                whole &= own >= 0
                counts = np.bincount(own[whole] * BUCKETS + trigrams(data)[whole], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + counts[k]
        for name, counts in total.items():
            n = BUCKETS // SLICE
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), pa.array([x.astype(np.int64).tobytes() for x in counts.reshape(n, SLICE)], pa.binary())], ["lang", "slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"])
        return pa.table({"lang": [table["lang"][0].as_py()], "slice": [table["slice"][0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(lang_col, text_col).mapInArrow(run, "lang string, slice long, counts binary").groupBy("lang", "slice").applyInArrow(add, "lang string, slice long, counts binary").collect()
    languages = sorted({r.lang for r in rows})
    counts = np.zeros((len(languages), BUCKETS))
    for r in rows:
        counts[languages.index(r.lang), r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, np.int64)
    return TextModel(languages, np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)))


def evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, suffix, declared (lower case, '' if absent) and visible text, added to the pages' own columns as __ columns.

    The host is an address's without user and port. declared is that of the page's first <html> tag with a language, wherever it stands outside comments and scripts.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(markup(F.col(html)), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return pages.select("*", host.alias("__host"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("__suffix"), declared.alias("__declared"), F.array_join(html_lines(F.col(html)), " ").alias("__text"))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, host, declared, lang, probability, text_lang): the likeliest language and its posterior probability.

    Null or empty pages are told by declared language, suffix and host alone; null addresses are the host ''. Ties go
    to the alphabetically first language. Repeated rows each give a row. Without a fitted language, lang is null. An
    empty table gives no row. Other columns are left out, whatever their names; the pages' own may not begin with __.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        log_p = sent.value.log_p.T.copy()
        k = log_p.shape[1]
        for batch in batches:
            out = np.zeros((batch.num_rows, k))
            for lo, hi, data, offsets in pieces(batch.column(4)):
                if len(data) < 3 or not k:
                    continue
                row, whole = _row_of(offsets, len(data))
                grams = trigrams(data)[whole]
                for j in range(k):
                    out[lo:hi, j] = np.bincount(row[whole], log_p[grams, j], hi - lo)
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(4)], values], [id_col, "host", "suffix", "declared", "text_ll"])

    seen = evidence(pages, url, html).select(F.col(id_col), F.col("__host").alias("host"), F.col("__suffix").alias("suffix"), F.col("__declared").alias("declared"), F.col("__text").alias("text"))
    seen = materialise(seen.mapInArrow(run, f"`{id_col}` {kind}, host string, suffix string, declared string, text_ll array<double>"), "text-evidence")
    names = model.languages
    if not names:
        return seen.select(id_col, "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int")
    first = seen.where(F.array_max("text_ll") < 0).select("host", "suffix", "declared", best(F.col("text_ll")).alias("k"))
    guess = materialise(first.groupBy("host", "suffix", "declared", "k").agg(F.count("*").alias("n")), "first-guess")
    hit = [F.sum(F.when(F.col("k") == j + 1, F.col("n")).otherwise(0)).cast("double").alias(f"n{j}") for j in range(len(names))]
    array = F.array(*[F.col(f"n{j}") for j in range(len(names))])
    everywhere = guess.agg(*hit).select(array.alias("n_all"))
    by_suffix = guess.groupBy("suffix").agg(*hit).select("suffix", array.alias("n_suffix"))
    by_host = guess.groupBy("host").agg(*hit).select("host", array.alias("n_host"))
    by_declared = guess.groupBy("declared").agg(*hit).select("declared", array.alias("n_declared"))
    sizes = guess.agg(*[F.countDistinct(c).alias(c) for c in ("host", "suffix", "declared")]).first()
    sent_out = lambda table, c: F.broadcast(table) if sizes[c] <= BROADCAST_HOSTS else table
    zeros = F.array(*[F.lit(0.0)] * len(names))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = lambda n, wider: F.zip_with(n, wider, lambda x, p: (x + STRENGTH * p) / (total(n) + STRENGTH))
    # one host may have a third of all pages: it isn't left to one task where there are too many hosts to send out
    joined = seen.join(F.broadcast(by_host), "host", "left") if sizes["host"] <= BROADCAST_HOSTS else join_uneven(seen, by_host, "host")
    joined = joined.join(F.broadcast(everywhere)).join(sent_out(by_suffix, "suffix"), "suffix", "left").join(sent_out(by_declared, "declared"), "declared", "left")
    # a page's own guess isn't evidence for it a second time
    own = F.when(F.array_max("text_ll") < 0, best(F.col("text_ll"))).otherwise(0)
    others = lambda c: F.transform(F.coalesce(c, zeros), lambda x, j: F.coalesce(x, F.lit(0.0)) - F.when(j + 1 == own, 1.0).otherwise(0.0))
    filled = joined.select(id_col, "host", "declared", "text_ll", *[others(c).alias(c) for c in ("n_all", "n_suffix", "n_host", "n_declared")])
    flat = F.transform("n_all", lambda x: (x + 1) / (total(F.col("n_all")) + len(names)))
    filled = filled.withColumn("p_suffix", share(F.col("n_suffix"), flat)).withColumn("p_host", share(F.col("n_host"), F.col("p_suffix")))
    # P(declared | language) up to a factor: how often the declaration comes with the language, over the language's share
    filled = filled.withColumn("p_declared", F.when(F.col("declared") == "", F.transform(zeros, lambda x: x + 1.0)).otherwise(F.zip_with(share(F.col("n_declared"), flat), flat, lambda x, p: x / p)))
    tempered = F.transform("text_ll", lambda x: (x - F.array_max("text_ll")) * TEMPER)
    logs = F.zip_with(F.zip_with(tempered, "p_host", lambda x, p: x + F.log(p)), "p_declared", lambda x, p: x + F.log(p))
    scored = filled.withColumn("logs", logs).withColumn("odds", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    table = F.array(*[F.lit(x) for x in names])
    return scored.select(
        id_col, "host", "declared",
        F.element_at(table, best(F.col("odds"))).alias("lang"),
        (F.array_max("odds") / total(F.col("odds"))).alias("probability"),
        F.when(F.array_max("text_ll") < 0, F.element_at(table, best(F.col("text_ll")))).alias("text_lang"),
    )
