"""Verification of claims as they arrive (STR2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import verify as ver
from ..sources.store import materialise

PAIR = ["doc_id", "field", "period_type"]


def verify_arriving(claims: DataFrame, pages: DataFrame, facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Verifies a stream of claims against the tables of pages and facts, under ``path``; ends when all there is has been read.

    A document's claims may come in any micro-batches, in any order: the first (by seq) of each document, field and
    period type is kept as the stream's state. A micro-batch checks on the pages what is new or has become the first
    (checked/batch=n), and compares all claims of the documents it touches with the references, since one claim can
    decide on those of others (verified/batch=n). A batch that runs again after a failure replaces its own folders.
    """
    own = ver.inside_period(ver.normalise_periods(claims))
    others = [c for c in own.columns if c not in PAIR and c != "seq"]
    first = own.groupBy(*PAIR).agg(F.min(F.struct("seq", *others)).alias("first"))

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*PAIR, "first.*").select(own.columns)
        if number:
            # a pair comes again with each of its claims; what was checked as its first already stays
            done = spark.read.parquet(f"{path}/checked").where(F.col("batch") < number)
            new = new.join(done.select(*PAIR, "seq").distinct(), [*PAIR, "seq"], "left_anti")
        # written once: each further use of a micro-batch reads and keeps the stream's whole state again
        new = materialise(new, "new-firsts")
        ver.on_pages(new, pages).write.mode("overwrite").parquet(f"{path}/checked/batch={number}")
        checked = spark.read.parquet(f"{path}/checked").where(F.col("batch") <= number)
        touched = checked.join(checked.where(F.col("batch") == number).select("doc_id").distinct(), "doc_id", "left_semi")
        nth = F.row_number().over(Window.partitionBy(*PAIR).orderBy("seq"))
        firsts = touched.withColumn("nth", nth).where("nth = 1").drop("nth", "batch")
        ver.status(ver.check_references(firsts, facts)).write.mode("overwrite").parquet(f"{path}/verified/batch={number}")

    return first.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The verified first claims: of each document what the last micro-batch that touched it says."""
    rows = spark.read.parquet(f"{path}/verified")
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc_id", "batch"]).drop("batch")
