"""Ledgers as streams: open reservations as keyed state (STR1), late and repeated events told apart (STR3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Keys that a ledger's ids are dealt to: a ledger that holds most events is so many tasks.
BUCKETS = 16
#: State of Python processors is kept by this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reservations(StatefulProcessor):
    """State of a (ledger, bucket): per id the last event, while it is an open reservation or may still be overtaken.

    Emits what a micro-batch changes in the ledger's balance. A settlement drops what its id reserved, whatever it says
    itself. Events count in the order of ``seq``, also when they come in another: a settled id is kept until the
    watermark passes it, so that an older reservation that comes later doesn't open it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "id long, seq long, usd double, t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # usd: null once settled
        held = {x[0]: (x[1], x[2], x[3]) for x in self.held.get()}
        spent = reserved = 0.0
        for frame in rows:
            for e in frame[["id", "seq", "kind", "usd", "t"]].itertuples(index=False):
                usd = 0.0 if pd.isna(e.usd) else float(e.usd)
                settles = e.kind == "settle"
                spent += usd if settles else 0.0
                last = held.get(e.id)
                if last is None or e.seq > last[0]:
                    reserved += (0.0 if settles else usd) - (last[1] or 0.0 if last else 0.0)
                    held[e.id] = (int(e.seq), None if settles else usd, int(pd.Timestamp(e.t).timestamp() * 1000))
        behind = timerValues.getCurrentWatermarkInMs()
        kept = [(int(i), *x) for i, x in held.items() if x[1] is not None or x[2] >= behind]
        if kept:
            self.held.put(kept)
        else:
            self.held.clear()
        yield pd.DataFrame({"ledger": [key[0]], "spent": [spent], "reserved": [reserved]})

    def close(self) -> None:
        pass


def changes(events: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """STR1: (ledger, spent, reserved), what each micro-batch of a stream changes. events: ledger, id, seq, kind, usd, t.

    Events over ``delay`` behind the latest of earlier micro-batches don't count (STR3 keeps them apart).
    """
    kind = events.schema["ledger"].dataType.simpleString()
    dealt = events.withWatermark("t", delay).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return dealt.groupBy("ledger", "bucket").transformWithStateInPandas(Reservations(), f"ledger {kind}, spent double, reserved double", "Update", "EventTime")


def _batch(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={number}")


def balances(events: DataFrame, path: str, checkpoint: str, delay: str = "30 days", buckets: int = BUCKETS) -> StreamingQuery:
    """STR1: keeps each ledger's spent and reserved after every micro-batch under ``path``/batch=n; reads what is there.

    A micro-batch that runs again after a failure gets the same state and replaces its own folder; a stream that goes on
    later goes on from its checkpoint. The session's state store has to be ``PROVIDER``.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("ledger").agg(F.sum("spent").alias("spent"), F.sum("reserved").alias("reserved"))
        if number:
            own = own.unionByName(_batch(own.sparkSession, path, number - 1)).groupBy("ledger").agg(F.sum("spent").alias("spent"), F.sum("reserved").alias("reserved"))
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes(events, delay, buckets).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last micro-batch's table under ``path``."""
    return spark.read.parquet(path).where(F.col("batch") == spark.read.parquet(path).agg(F.max("batch")).first()[0]).drop("batch")


#: Salts under which repeats of one event are looked for before they meet.
SALTS = 16


def _firsts(events: DataFrame) -> DataFrame:
    """``events`` with ``nth``: 1 for the first (by t and seq) of each (ledger, id, kind), found in two steps, so that an event repeated very often isn't one task."""
    key, order = ["ledger", "id", "kind"], ["t", "seq"]
    salted = events.withColumn("salt", F.pmod(F.xxhash64("seq", "t"), F.lit(SALTS)))
    salted = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "salt").orderBy(*order)))
    best = salted.where("nth = 1").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return best.unionByName(salted.where("nth > 1")).drop("salt")


def clean_and_late(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """STR3: every event of a stream into exactly one of ``path``/events/batch=n/verdict=clean, late or repeated.

    late: its t is more than ``delay`` before the latest t of earlier micro-batches (the watermark). repeated: not late,
    but its (ledger, id, kind) has come before, in this micro-batch or as a clean event up to ``delay`` before the
    watermark. An event without t is never late. The watermark is a table of its own, so late rows aren't dropped by it;
    a micro-batch that runs again replaces its own folders.
    """
    schema = events.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest_t = _batch(spark, f"{path}/marks", number - 1).first()["t"] if number else None
        mark = F.lit(latest_t).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        told = batch.withColumn("late", F.coalesce(F.col("t") < mark, F.lit(False)))
        late = told.where("late").drop("late").withColumn("verdict", F.lit("late"))
        rest = _firsts(told.where("NOT late").drop("late"))
        if number:
            seen = spark.read.schema(schema.add("batch", "long").add("verdict", "string")).parquet(f"{path}/events")
            seen = seen.where((F.col("batch") < number) & (F.col("verdict") == "clean") & (F.col("t").isNull() | (F.col("t") >= mark - F.expr(f"INTERVAL {delay}"))))
            rest = rest.join(seen.select("ledger", "id", "kind", F.lit(1).alias("seen")).distinct(), ["ledger", "id", "kind"], "left")
        else:
            rest = rest.withColumn("seen", F.lit(None).cast("int"))
        rest = rest.withColumn("verdict", F.when((F.col("nth") > 1) | F.col("seen").isNotNull(), "repeated").otherwise("clean"))
        own = late.unionByName(rest.drop("nth", "seen"))
        own.write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/events/batch={number}")
        top = batch.agg(F.max("t").alias("t")).select(F.greatest("t", F.lit(latest_t).cast("timestamp")).alias("t"))
        top.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """All events that ``clean_and_late`` has placed, with their verdict."""
    return spark.read.parquet(f"{path}/events").drop("batch")
