"""Minimum-bin-slack packing of token sequences.

Texts become ids, and only ids longer than a sequence are cut. Packing looks at the histogram of lengths alone (at
most ``capacity`` rows): for the longest length left, a bitset subset-sum dynamic programme over the available
lengths finds the fullest combination with it; that bin is removed as often as the supply allows, so each step uses up
a length and there are few different bins. Pieces then take the places of their length by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .shared import materialise, partitions
from .textkit import release

#: Counts of lengths by hashed part that are broadcast (24 bytes each).
BROADCAST_COUNTS = 1_000_000


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """One row per piece: id, piece (int, from 0), start, length (long), ids (binary: little-endian unsigned 32-bit).

    A document's ids are those of its whole text (null: empty), then end_id; ``added`` as in ``Encoder``. Those over ``capacity`` are cut into
    pieces of that many, of which the first takes the remainder. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, added)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows, places, starts, lengths, blobs, held = [], [], [], [], [], 0

            def flush():
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())]
                for x in (rows, places, starts, lengths, blobs):
                    x.clear()
                return pa.RecordBatch.from_arrays(out, [id_col, "piece", "start", "length", "ids"])

            for row, ids in encoder.encode(batch.column(1)):
                ids = np.concatenate((ids, end))
                a, piece = 0, 0
                b = (len(ids) - 1) % capacity + 1
                while a < len(ids):
                    rows.append(row)
                    places.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    blobs.append(ids[a:b].astype("<u4").tobytes())
                    held += 4 * (b - a)
                    a, b, piece = b, b + capacity, piece + 1
                if held > 4 << 20:
                    yield flush()
                    held = 0
            if rows:
                yield flush()
            release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def fullest(lengths: list[int], left: list[int], space: int) -> list[tuple[int, int]]:
    """The (length, times) whose total is the most that fits in ``space``; lengths ascend, longer ones are preferred."""
    layers = [1]
    mask = (1 << (space + 1)) - 1
    for length, n in zip(lengths, left, strict=True):
        reach, n = layers[-1], min(n, space // length)
        step = 1
        while n > 0:
            take = min(step, n)
            reach |= (reach << (take * length)) & mask
            n -= take
            step *= 2
        layers.append(reach)
    total, chosen = layers[-1].bit_length() - 1, []
    for k in range(len(lengths) - 1, -1, -1):
        times, most = 0, min(left[k], total // lengths[k])
        for x in range(most, 0, -1):
            if layers[k] >> (total - x * lengths[k]) & 1:
                times = x
                break
        if times:
            chosen.append((lengths[k], times))
            total -= times * lengths[k]
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(bin as (length, times) pairs, how many of it), until no length is left."""
    left, bins = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        others = sorted(left)
        spare = [left[k] - (k == longest) for k in others]
        use = dict(fullest([k for k, n in zip(others, spare, strict=True) if n], [n for n in spare if n], capacity - longest))
        use[longest] = use.get(longest, 0) + 1
        copies = min(left[k] // n for k, n in use.items())
        bins.append((sorted(use.items(), reverse=True), copies))
        for k, n in use.items():
            left[k] -= n * copies
            if not left[k]:
                del left[k]
    return bins


def pack(pieces: DataFrame, key: list[str], capacity: int = 1024) -> DataFrame:
    """``pieces`` (a table that can be read again) plus sequence_id and offset (long), gapless from 0 in each sequence.

    key: columns that tell pieces apart; equal keys are different pieces but get their places in any order. Only the
    histogram of lengths (at most ``capacity`` rows) and its bins reach the driver. Lengths are 1 to ``capacity``.
    Ranks within a length are counted in as many hashed parts as there are partitions, so a common length isn't one task.
    Other columns may have any names but those of the two new columns and such that begin with two underscores.
    """
    spark = pieces.sparkSession
    parts = max(64, partitions(spark))
    dealt = pieces.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    counts = materialise(dealt.groupBy("length", "__part").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for use, copies in plan_bins(histogram, capacity):
        offset = 0
        for length, times in use:
            slots.append((length, taken[length], taken[length] + times * copies, sequence, times, offset))
            taken[length] += times * copies
            offset += times * length
        sequence += copies
    places = spark.createDataFrame(slots, "__length long, __lo long, __hi long, __first long, __times long, __at long")
    before = counts.select("length", "__part", (F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*key)) - 1
    # beyond the size of a broadcast both sides are already dealt by length and part
    ranked = dealt.withColumn("__rank", rank).join(F.broadcast(before) if counts.count() <= BROADCAST_COUNTS else before.hint("shuffle_hash"), ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    own = F.col("__rank") - F.col("__lo")
    sequence_id, offset = F.col("__first") + F.floor(own / F.col("__times")), F.col("__at") + own % F.col("__times") * F.col("length")
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], sequence_id.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
