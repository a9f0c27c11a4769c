"""From raw documents to packed training sequences: five stages, each a training-data operator.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; the last returns a row per packed piece. A row without an id can't be named, so the stages
that leave documents out by id keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import decontaminate, line_dedup, packing, quality
from tallywise.llm.jaccard_join import jaccard_classes
from tallywise.llm.queries import table, tokenizer_path
from tallywise.llm.shared import materialise, without


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than bad; learns from the labels whose crc32(doc_id) mod 3 is not 1."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return quality.keep_good(docs, quality.fit(docs, labels))


def site_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over three tenths of their source's documents (and on two at least) go, from text and n_chars; rows stay, null texts too."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("host"), F.split("text", "\n").alias("lines"))
    out = line_dedup.drop_boilerplate(rows, "host", "lines")
    text = F.when(F.col("n_dropped") > 0, F.array_join("lines", "\n")).otherwise(F.col("row.text"))
    kind = docs.schema["n_chars"].dataType
    n_chars = F.when(F.col("n_dropped") > 0, F.length(F.array_join("lines", "\n"))).otherwise(F.col("row.n_chars")).cast(kind)
    own = {"text": text, "n_chars": n_chars}
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.75 of five-word shingles, the one with the smallest id.

    Of rows that repeat an id and its text, one stays.
    """
    classes = jaccard_classes(docs)
    kept = without(docs, classes.where("doc_id <> component_id").select("doc_id"))
    twice = materialise(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    return without(kept, twice).unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than three quarters of the five-word shingles of every benchmark item."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids (little-endian unsigned 32-bit), their sequence and place in it."""
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), added=True)
    pieces = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return packing.pack(pieces, ["doc_id", "piece"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", site_line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier and the packing; the run is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
