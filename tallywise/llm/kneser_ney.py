"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays, mapped by workers.

Files in the shared folder, in shards by the top bits of a hash:
- words: sorted 64-bit hashes and counts; a word's number is its rank among all hashes;
- pairs: sorted 64-bit pairs of word numbers and counts (those over 32 bits apart, in 64); a frequent first word's pairs
  are dealt to all shards;
- contexts, by ranges of word numbers: followers' total, followers seen once, twice, more often, and distinct
  predecessors.

A text is its words, then one end, seen after one start. p(w | v) = (c(vw) - D) / c(v.) + gamma(v) p(w), where
p(w) = (n(.w) - D') / n(..) + lambda / (V + 1) is built from numbers of distinct predecessors; words outside the
training set share one place of the V + 1. After a context never seen, p(w | v) = p(w).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bits_for, dealt, gathered, summed, top_bits
from .shared import new_folder, partitions
from .textkit import mix, pieces, words

END = mix(np.array([0xE4D], np.uint64))[0]
FLUSH = 3_000_000
#: A first word seen this often has its pairs spread over all shards, so no shard is hot.
FREQUENT = 4096
#: Counts of pairs have 32 bits; from here on they stand, in 64 bits, in a shard's short list of large ones.
LARGE = 2**32 - 1


def local(path: str) -> str:
    """The mounted path of a shared folder; workers map files there, so it has to be one that all machines mount."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model's arrays are memory-mapped: spark.checkpoint.dir has to be a mounted folder (file:), not {path}")
    return path


def _store(folder: str, name: str, array: np.ndarray) -> None:
    """Under its final name only when whole, so a task that is run again or twice does no harm."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    array.tofile(own)
    os.replace(own, f"{folder}/{name}")


def _map(folder: str, name: str, dtype) -> np.ndarray:
    """A stored array; one that isn't there is an error."""
    path = f"{folder}/{name}"
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def _with_ends(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, each row's words and then END; and where each row starts (one more than rows)."""
    start = first + np.arange(len(first))
    out = np.full(start[-1], END, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[start[1:] - 1] = True
    out[~ends] = hashes
    return out, start


@dataclass
class Model:
    folder: str
    word_bits: int = 1
    word_base: list[int] = field(default_factory=list)
    pair_bits: int = 1
    range_bits: int = 16
    n: int = 0
    v: int = 0
    types: int = 0
    d1: tuple[float, ...] = (0.5, 1.0, 1.5)
    d2: tuple[float, ...] = (0.5, 1.0, 1.5)
    low: tuple[int, int, int] = (0, 0, 0)
    #: Names of all arrays that were stored: any other is empty, and one of these that is missing is an error.
    stored: set[str] = field(default_factory=set)

    def __post_init__(self):
        self._open: dict = {}

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "_open"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._open = {}

    def array(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            self._open[name] = _map(self.folder, name, dtype) if name in self.stored else np.zeros(0, dtype)
        return self._open[name]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: unknown) and training counts of sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for p, a, b in _runs(top_bits(hashes, self.word_bits)):
            keys = self.array(f"words-{p}", np.uint64)
            at = np.searchsorted(keys, hashes[a:b])
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == hashes[a:b][hit]]
            number[a + hit] = self.word_base[p] + at[hit]
            count[a + hit] = self.array(f"counts-{p}", np.int64)[at[hit]]
        return number, count

    def counts(self, number: np.ndarray) -> np.ndarray:
        """Training counts of sorted word numbers; of the start, all tokens; of unknown words, 0."""
        out = np.where(number == self.v, self.n, 0)
        part = np.searchsorted(self.word_base, number, side="right") - 1
        for p, a, b in _runs(part):
            own, at = self.array(f"counts-{p}", np.int64), number[a:b] - self.word_base[p]
            hit = np.flatnonzero(at < len(own))
            out[a + hit] = own[at[hit]]
        return out

    def parts(self, pairs: np.ndarray) -> np.ndarray:
        """Shards of sorted pairs."""
        before = pairs >> np.uint64(32)
        head = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), before[1:] != before[:-1])))
        often = np.repeat(self.counts(before[head].astype(np.int64)) >= FREQUENT, np.diff(np.append(head, len(pairs))))
        return top_bits(np.where(often, mix(pairs), mix(before)), self.pair_bits)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs."""
        out = np.zeros(len(pairs), np.int64)
        part = self.parts(pairs)
        order = np.argsort(part.astype(np.int16) if self.pair_bits < 16 else part, kind="stable")
        pairs = pairs[order]
        for p, a, b in _runs(part[order]):
            keys = self.array(f"pairs-{p}", np.uint64)
            at = np.searchsorted(keys, pairs[a:b])
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == pairs[a:b][hit]]
            out[order[a + hit]] = self.array(f"paircounts-{p}", np.uint32)[at[hit]]
            if len(large := self.array(f"largepairs-{p}", np.uint64)):
                hit = hit[out[order[a + hit]] == LARGE]
                out[order[a + hit]] = self.array(f"largecounts-{p}", np.int64)[np.searchsorted(large, pairs[a:b][hit])]
        return out

    def contexts(self, number: np.ndarray) -> np.ndarray:
        """Rows (followers' total, once, twice, more, distinct predecessors) of sorted word numbers; zeros at -1."""
        out = np.zeros((len(number), 5), np.int64)
        for q, a, b in _runs(number >> self.range_bits):
            own = self.array(f"contexts-{q}", np.int64).reshape(-1, 5)
            if q >= 0 and len(own):
                out[a:b] = own[number[a:b] - (q << self.range_bits)]
        return out


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(part):
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(part[a]), a, b


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, and 3 or more, from how many types have counts 1 to 4; defaults where those are too few.

    One that isn't positive would leave nothing for what wasn't seen: it is half a count instead.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [k - (k + 1) * y * (b / a) if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(x, k) if x > 0 else 0.5 for k, x in zip((1.0, 2.0, 3.0), d, strict=True))


def _word_blobs(bits: int):
    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return dealt(top_bits(keys, bits), keys, counts.astype(np.uint32))

        for batch in batches:
            for _, _, data, at in pieces(batch.column(0), 4 << 20):
                held.append(_with_ends(*words(data, at))[0])
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return run


def _pair_blobs(model: Model):
    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = model.parts(pairs)
            order = np.argsort(part, kind="stable")
            return dealt(part[order], pairs[order], counts.astype(np.uint32)[order])

        for batch in batches:
            for _, _, data, at in pieces(batch.column(0), 4 << 20):
                held.append(_pairs(model, *_with_ends(*words(data, at)))[0])
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if sum(map(len, held)):
            yield flush()

    return run


def _pairs(model: Model, tokens: np.ndarray, start: np.ndarray):
    """Packed (previous number, number) of each token, known counts, numbers; an unknown word is all ones."""
    keys, inverse = np.unique(tokens, return_inverse=True)
    number, count = model.numbers(keys)
    own = number[inverse]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[start[:-1]] = model.v
    bits = np.uint64(0xFFFFFFFF)
    return ((before.astype(np.uint64) & bits) << np.uint64(32)) | (own.astype(np.uint64) & bits), count[inverse], own, before


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all rows of ``docs`` (null: empty text) and stores the model in the shared folder. Empty tables are allowed."""
    spark = docs.sparkSession
    folder = local(new_folder(spark, "kneser-ney"))
    texts = docs.select(text_col)
    model = Model(folder, word_bits=bits_for(2 * partitions(spark)))

    def words_of(table: pa.Table) -> pa.Table:
        p = table["p"][0].as_py()
        keys, counts = summed(gathered(table, "c0", np.uint64), gathered(table, "c1", np.uint32).astype(np.int64))
        _store(folder, f"words-{p}", keys)
        _store(folder, f"counts-{p}", counts)
        return pa.table({"p": [p], "size": [len(keys)], "total": [int(counts.sum())]})

    found = texts.mapInArrow(_word_blobs(model.word_bits), "p long, c0 binary, c1 binary").groupBy("p").applyInArrow(words_of, "p long, size long, total long").collect()
    sizes = np.zeros(1 << model.word_bits, np.int64)
    for r in found:
        sizes[r.p] = r["size"]
        model.stored |= {f"words-{r.p}", f"counts-{r.p}"}
    model.word_base = (np.cumsum(sizes) - sizes).tolist()
    model.v, model.n = int(sizes.sum()), sum(r.total for r in found)
    if model.v >= 2**32 - 2:
        raise ValueError("pairs hold 32-bit word numbers: over 4 billion distinct words")
    model.pair_bits = bits_for(max(2 * partitions(spark), model.n / 1e6))
    model.range_bits = max(16, bits_for(model.v / (4 * partitions(spark))))
    bits = model.range_bits

    def pairs_of(table: pa.Table) -> pa.Table:
        p = table["p"][0].as_py()
        pairs, counts = summed(gathered(table, "c0", np.uint64), gathered(table, "c1", np.uint32).astype(np.int64))
        _store(folder, f"pairs-{p}", pairs)
        _store(folder, f"paircounts-{p}", np.minimum(counts, LARGE).astype(np.uint32))
        large = counts >= LARGE
        if large.any():
            _store(folder, f"largepairs-{p}", pairs[large])
            _store(folder, f"largecounts-{p}", counts[large])
        before, own = (pairs >> np.uint64(32)).astype(np.int64), np.sort((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
        one = np.ones(len(pairs), np.int64)
        v, total, *kinds = summed(before, counts, *[(counts == 1) * one, (counts == 2) * one, (counts > 2) * one])
        low = np.int64((1 << bits) - 1)
        n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.concat_tables(
            [
                pa.table({"p": [-1], "c0": pa.array([np.array([*n, len(pairs), p, large.any()], np.int64).tobytes()], pa.binary())}),
                pa.Table.from_batches([dealt(v >> bits, (v & low).astype(np.uint32), total, np.column_stack(kinds).astype(np.uint32))]),
                pa.Table.from_batches([dealt(own >> bits, (own & low).astype(np.uint32))]).rename_columns(["p", "c3"]),
            ],
            promote_options="default",
        )

    def contexts_of(table: pa.Table) -> pa.Table:
        q = table["p"][0].as_py()
        if q < 0:
            shards = gathered(table, "c0", np.int64).reshape(-1, 7)
            total = shards[:, :5].sum(0)
            return pa.table({"q": [q], **{f"n{k}": [int(total[k])] for k in range(5)}, "shards": [shards[:, 5].tolist()], "large": pa.array([shards[shards[:, 6] > 0, 5].tolist()], pa.list_(pa.int64()))})
        out = np.zeros((min(1 << bits, model.v + 1 - (q << bits)), 5), np.int64)
        v, kinds = gathered(table, "c0", np.uint32), gathered(table, "c2", np.uint32).reshape(-1, 3)
        np.add.at(out[:, 0], v, gathered(table, "c1", np.int64))
        for k in range(3):
            out[:, k + 1] = np.bincount(v, kinds[:, k], len(out))
        behind = out[:, 4] = np.bincount(gathered(table, "c3", np.uint32), minlength=len(out))
        _store(folder, f"contexts-{q}", out)
        return pa.table({"q": [q], **{f"n{k - 1}": [int((behind == k).sum())] for k in (1, 2, 3, 4)}, "n4": [int((behind > 2).sum())], "shards": [[q]], "large": pa.array([[]], pa.list_(pa.int64()))})

    counted = texts.mapInArrow(_pair_blobs(model), "p long, c0 binary, c1 binary").groupBy("p").applyInArrow(pairs_of, "p long, c0 binary, c1 binary, c2 binary, c3 binary")
    stats = counted.groupBy("p").applyInArrow(contexts_of, "q long, n0 long, n1 long, n2 long, n3 long, n4 long, shards array<long>, large array<long>")
    stats = stats.groupBy(F.col("q") < 0).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(5)], *[F.flatten(F.collect_list(c)).alias(c) for c in ("shards", "large")]).collect()
    for r in stats:
        n = [r[f"n{k}"] for k in range(5)]
        if r[0]:
            model.d2, model.types = discounts(n[:4]), n[4]
            model.stored |= {f"{kind}-{p}" for kind in ("pairs", "paircounts") for p in r["shards"]} | {f"{kind}-{p}" for kind in ("largepairs", "largecounts") for p in r["large"]}
        else:
            model.stored |= {f"contexts-{q}" for q in r["shards"]}
            model.d1, model.low = discounts(n[:4]), (n[0], n[1], n[4])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens (long), base_score, score (double, log10).

    Null and empty texts are one end token. Repeated rows each give a row; other columns are ignored. No shuffle.
    base_score is that of the add-one unigram model over the V training words and one unknown.
    """
    d1, d2 = np.array([0.0, *model.d1]), np.array([0.0, *model.d2])
    rest = sum(d * n for d, n in zip(model.d1, model.low, strict=True))

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in pieces(batch.column(1), 4 << 20):
                tokens, start = _with_ends(*words(data, at))
                pair, count, own, before = _pairs(model, tokens, start)
                base = np.log10((count + 1.0) / (model.n + 1.0 * (model.v + 1)))
                distinct, inverse = np.unique(pair, return_inverse=True)
                c = model.pair_counts(distinct)[inverse]
                keys, at_own = np.unique(np.concatenate((own, before)), return_inverse=True)
                table = model.contexts(keys)
                behind, after = table[at_own[: len(own)], 4], table[at_own[len(own) :]]
                if model.types:
                    p = (behind - d1[np.minimum(behind, 3)]) / model.types + rest / model.types / (model.v + 1)
                else:
                    p = np.full(len(own), 1 / (model.v + 1))
                total = np.maximum(after[:, 0], 1)
                gamma = (after[:, 1:4] @ d2[1:]) / total
                p = np.where(after[:, 0] > 0, (c - d2[np.minimum(c, 3)]) / total + gamma * p, p)
                sums = [np.add.reduceat(x, start[:-1]) for x in ((count > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(start)), pa.array(sums[0]), pa.array(np.full(hi - lo, model.n)), pa.array(sums[1]), pa.array(sums[2])],
                    [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
