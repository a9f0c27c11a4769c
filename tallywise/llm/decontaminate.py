"""Size-partitioned MinHash containment search of short test items in long documents.

Items are partitioned by the size of their shingle set (powers of two). A partition's items and documents' windows of
twice its size, half a window apart, have one-permutation MinHash signatures: shingles are dealt to bins, and a bin's
value is its least shingle. A short item inside a long document is so compared with a set of about its own size. Bands
have one bin each: an item is a candidate for a document if a bin of one of its windows has the item's value. Only
these candidates are verified, by exact containment of the item's shingles in the whole document.

A window of a contained item has a Jaccard similarity of over 0.17 with it (three quarters of more than half the
partition's size, in twice that size); with BINS bins all of them differ with a chance under 1e-5. Window bins are
computed where they hold a value of some item, which is the only way they can agree with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .textkit import mix, shingles

#: Bins of the signatures of partitions up to a size (few shingles need finer bins, since few have to agree).
BINS = ((8, 1024), (32, 256), (1 << 62, 128))
#: Item shingles broadcast at once (about 30 bytes each); more items take further passes over the documents.
BROADCAST_SHINGLES = 1_000_000
FILTER_BITS = 21


def _bins(s: np.ndarray, size: int) -> np.ndarray:
    """The bin of each shingle in the signatures of a partition."""
    return mix(s + np.uint64(0x5EED)) % np.uint64(next(bins for most, bins in BINS if size <= most))


class Signatures:
    """Items' shingles, and the values of their signatures: sorted, each with its item."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.items = [u for _, u in items]
        self.partition = np.array([1 << int(len(u) - 1).bit_length() for u in self.items], np.int64)
        values, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, u in enumerate(self.items):
            bins = _bins(u, self.partition[k])
            order = np.lexsort((u, bins))
            values.append(u[order][np.concatenate(([True], bins[order][1:] != bins[order][:-1]))])
            owner.append(np.full(len(values[-1]), k))
        values, owner = np.concatenate(values), np.concatenate(owner)
        order = np.lexsort((self.partition[owner], values)) if len(owner) else []
        self.values, self.owner = values[order], owner[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(values & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def candidates(self, s: np.ndarray) -> np.ndarray:
        """Items of which a signature value is that of a window of the document, whose shingles s are in text order."""
        near = np.flatnonzero(self.maybe[(s & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.values, s[near], "left"), np.searchsorted(self.values, s[near], "right")
        near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
        # each place in turn with the items of its value, those of one partition side by side
        item = self.owner[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum())] if len(lo) else lo
        at = np.repeat(near, hi - lo)
        size = self.partition[item]
        head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (size[1:] != size[:-1])))) if len(at) else at
        agrees = self._agreeing(s, at[head], size[head])
        return np.unique(item[np.repeat(agrees, np.diff(np.append(head, len(at))))])

    @staticmethod
    def _agreeing(s: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the shingle at each place (ascending) is its bin's value in a window of the partition that holds it.

        A window's values are computed once, however many places it holds.
        """
        out = np.zeros(len(at), bool)
        for z in np.unique(size).tolist():
            own = np.flatnonzero(size == z)
            for back in (1, 0):
                nth = at[own] // z - back
                cuts = np.flatnonzero(np.concatenate(([True], nth[1:] != nth[:-1])))
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(own)).tolist(), strict=True):
                    first = int(nth[a])
                    window = np.unique(s[max(0, first * z) : (first + 2) * z])
                    _, least = np.unique(_bins(window, z), return_index=True)
                    out[own[a:b]] |= np.isin(s[at[own[a:b]]], window[least])
        return out

    def contained(self, s: np.ndarray, percent: int) -> Iterator[tuple[int | None, int, int]]:
        """(item id, its shingles, those in the document) of the candidates that are contained."""
        found = self.candidates(s)
        if len(found):
            whole = np.unique(s)
            for k in found.tolist():
                u = self.items[k]
                shared = int((whole[np.minimum(np.searchsorted(whole, u), len(whole) - 1)] == u).sum())
                if 100 * shared >= percent * len(u):
                    yield self.ids[k], len(u), shared


def item_sets(items: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows, sets = [], []
            for row, s in shingles(batch.column(1), words):
                if len(s):
                    rows.append(row)
                    sets.append(np.unique(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], ["item_id", "items"])

    return items.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "item_id long, items binary")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, item_id, n_shingles, n_shared, containment): items of which at least ``percent`` of the shingles are in the document.

    Sets are distinct ``words``-word shingles of lower-cased words; with fewer words, the whole sequence is one
    shingle (so such an item is only found in a document that is that sequence); null and empty texts have none and
    match nothing. Repeated documents each give their rows; a repeated item id with the same text counts once; an id may
    be null. Other columns are ignored. Items go out in parts of a bounded number of shingles (dealt by id and
    shingles, so rows without an id or with the same one aren't one part), with a pass over the documents each.
    """
    spark = docs.sparkSession
    sets = materialise(item_sets(items, item_id, item_text, words).dropDuplicates(), "items")
    total = sets.select(F.sum(F.length("items") / 8)).first()[0] or 0
    parts = int(-(-total // BROADCAST_SHINGLES)) or 1
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for part in range(parts):
        own = sets if parts == 1 else sets.where(F.pmod(F.xxhash64("item_id", "items"), F.lit(parts)) == part)
        found = Signatures([(r.item_id, np.frombuffer(r["items"], np.uint64)) for r in own.collect()])
        sent = spark.sparkContext.broadcast(found)

        def run(batches, sent=sent):
            signatures = sent.value
            for batch in batches:
                rows, got = [], []
                for row, s in shingles(batch.column(1), words):
                    for item in signatures.contained(s, percent):
                        rows.append(row)
                        got.append(item)
                ids = pa.array([k for k, _, _ in got], pa.int64())
                sizes, shared = (np.array([g[k] for g in got], np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), ids, *map(pa.array, (sizes, shared, shared / np.maximum(sizes, 1)))], [id_col, "item_id", "n_shingles", "n_shared", "containment"])

        some = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_id long, n_shingles long, n_shared long, containment double")
        out = some if out is None else out.unionByName(some)
    return out
