"""Spend: call costs, ledgers, request matching (BUD, REQ)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def peak(at: Column) -> Column:
    """BUD1: weekdays 01-04 and 06-10 UTC."""
    h = F.hour(at)
    return F.dayofweek(at).between(2, 6) & ((h.between(1, 3)) | (h.between(6, 9)))


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """BUD1: calls (…, model, at, input, cached, output) with usd; prices: model, tariff (flat, peak, offpeak), hit, miss, out per million. Unknown models are null."""
    tariff = F.when(peak(F.col("at")), "peak").otherwise("offpeak")
    both = calls.join(F.broadcast(prices), (calls["model"] == prices["model"]) & ((prices["tariff"] == "flat") | (prices["tariff"] == tariff)), "left").drop(prices["model"])
    usd = (F.col("cached") * F.col("hit") + (F.col("input") - F.col("cached")) * F.col("miss") + F.col("output") * F.col("out")) / 1e6
    return both.withColumn("usd", usd).drop("tariff", "hit", "miss", "out")


def worst_case(chars: Column, max_output: Column, miss: Column, out: Column, per_char: float = 0.8) -> Column:
    """BUD2."""
    return (chars * per_char * miss + max_output * out) / 1e6


def balance(events: DataFrame, cap: float) -> DataFrame:
    """BUD3, BUD5 and BUD6: per ledger spent, reserved and left. events: ledger, id, seq, kind (reserve, settle), usd.

    An id's reservation is open until it is settled; a settlement counts what it says.
    """
    ids = events.groupBy("ledger", "id").agg(
        F.sum(F.when(F.col("kind") == "settle", F.col("usd")).otherwise(0.0)).alias("spent"),
        F.when(F.max_by("kind", "seq") == "reserve", F.max_by("usd", "seq")).otherwise(0.0).alias("reserved"),
    )
    out = ids.groupBy("ledger").agg(F.sum("spent").alias("spent"), F.sum("reserved").alias("reserved"))
    return out.withColumn("left", F.lit(cap) - F.col("spent") - F.col("reserved"))


def settled(events: DataFrame) -> DataFrame:
    """BUD6: (ledger, id, usd, estimated) of every call: what it settled for, or, for one that ended without reporting a
    cost (its settlement has no usd), the reserved worst case, marked as estimated. Calls that still run aren't listed."""
    own = events.groupBy("ledger", "id").agg(
        F.max_by("usd", F.when(F.col("kind") == "reserve", F.col("seq"))).alias("worst"), F.count_if(F.col("kind") == "settle").alias("ends"), F.max_by("usd", F.when((F.col("kind") == "settle") & F.col("usd").isNotNull(), F.col("seq"))).alias("actual"))
    return own.where("ends > 0").select("ledger", "id", F.coalesce("actual", "worst").alias("usd"), F.col("actual").isNull().alias("estimated"))


def usage(calls: DataFrame, by: str) -> DataFrame:
    """BUD7: calls, and sums of input, cached and output tokens, of each extraction."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input", "cached", "output")])


def admitted(requests: DataFrame, cap: float) -> DataFrame:
    """BUD4: (ledger, seq, ok) of reservations in order; one that doesn't fit is refused and doesn't count.

    Each ledger's rows pass through one task in order; only the amount used so far is held.
    """

    def run(batches):
        ledger, used, begun = None, 0.0, False
        for batch in batches:
            ok = []
            for own, usd in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or own != ledger:
                    ledger, used, begun = own, 0.0, True
                ok.append(None if usd is None else used + usd <= cap)
                if ok[-1]:
                    used += usd
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["ledger", "seq", "ok"])

    own = requests.select("ledger", F.col("seq").cast("long").alias("seq"), F.col("usd").cast("double").alias("usd"))
    kind = own.schema["ledger"].dataType.simpleString()
    return own.repartition("ledger").sortWithinPartitions("ledger", "seq", "usd").mapInArrow(run, f"ledger {kind}, seq long, ok boolean")


def request_key(*parts: Column) -> Column:
    """REQ1: the digest of provider, model, prompt, mode and salt."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def pending(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """REQ1 and REQ2: requests (key) with served, from replies (key, data); failed replies have null data."""
    return requests.join(replies.select("key", "data", F.lit(True).alias("served")), "key", "left").withColumn("served", F.coalesce("served", F.lit(False)))


def same_requests(a: DataFrame, b: DataFrame) -> DataFrame:
    """REQ3: one row: whether both have exactly the same keys."""
    both = a.select("key", F.lit(1).alias("x")).unionByName(b.select("key", F.lit(-1).alias("x"))).groupBy("key").agg(F.sum("x").alias("x"))
    return both.agg((F.count_if(F.col("x") != 0) == 0).alias("same"))
