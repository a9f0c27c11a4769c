"""Tables and folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset and Spark is one process, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallywise-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallywise/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch of rows that goes to a Python worker: long texts make 10,000 rows many times that, twice (there and in the JVM).
BATCH_BYTES = 4 << 20


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Batches to Python workers of at most about ``BATCH_BYTES`` for what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, never computed twice."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with bounded_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids up to which a set of rows to leave out is broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 300_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``ids`` (one column of that name; nulls leave nothing out)."""
    ids = materialise(ids.distinct(), "left-out")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, "left_anti")


#: Keys with over one in so many of all rows count as hot; there can't be as many of them.
HOT = 1000


def join_uneven(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key at most), whatever share of the rows one key holds.

    Rows are read three times, so they should be stored. Those of hot keys meet their part of the table, under HOT rows,
    where they lie; only the others are shuffled. Null keys keep their rows and match nothing.
    """
    counts = materialise(rows.groupBy(key).agg(F.count("*").alias("__n")), "rows-per-key")
    n = counts.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(counts.where((F.col("__n") * HOT > n) & F.col(key).isNotNull()).select(key))
    few = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, "left")
    return few.unionByName(rows.join(hot, key, "left_anti").join(table, key, "left"))
