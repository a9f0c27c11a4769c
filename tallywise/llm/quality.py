"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are its words and pairs of neighbouring words, hashed to buckets, and how it is written: shapes of
words (case, ends, length, symbols), pairs of these, and repetitions. Weighted by inverse document frequency, the term
vectors of a bounded sample of labelled documents are reduced by a (randomised) singular value decomposition; the
labelled vectors are broadcast (their number is the bound), every document's cosine with each is computed in blocks,
and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, ngrams, pieces, release, words

#: Documented bounds: labelled documents that are fitted and broadcast, dimensions kept, neighbours that vote.
SAMPLE, DIMENSIONS, NEIGHBOURS = 4096, 48, 25
SHAPES = 256
FORMS = 3 * SHAPES + 8
#: Buckets of words and of pairs of words; each half of a vector has a weight of its own.
WORDS = 1 << 13
TERMS = FORMS + 2 * WORDS
WORD_WEIGHT = 0.5
FIRST = np.zeros(256, np.int64)
FIRST[65:91], FIRST[97:123], FIRST[48:58], FIRST[128:] = 1, 2, 3, 4
FIRST[33:48] = FIRST[58:65] = FIRST[91:97] = FIRST[123:127] = 5


@dataclass
class Counts:
    """Sparse rows: those of ``row`` ascending, each with its terms ascending and their square-rooted shares."""

    rows: int
    row: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The product with a dense matrix (terms x columns), some rows at a time."""
        out = np.zeros((self.rows, matrix.shape[1]), np.float32)
        for a in range(0, len(self.row), 50_000):
            row, term, value = (x[a : a + 50_000] for x in (self.row, self.term, self.value))
            head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[head]] += np.add.reduceat(matrix[term] * value[:, None], head, 0)
        return out

    def transposed(self) -> Counts:
        order = np.argsort(self.term, kind="stable")
        return Counts(TERMS, self.term[order], self.row[order], self.value[order])


def terms(column: pa.Array):
    """(first row, end row, counts of terms) of the column's rows."""
    for lo, hi, data, offsets in pieces(column, 1 << 18):
        forms = _forms(data, offsets, hi - lo)
        hashes, first = words(data, offsets)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        pairs, both = ngrams(hashes, 2), row[1:] == row[:-1]
        kinds = [(row, (hashes % np.uint64(WORDS)).astype(np.int64)), (row[1:][both], WORDS + (pairs[both] % np.uint64(WORDS)).astype(np.int64))] if len(row) else []
        key, n = np.unique(np.concatenate([r * TERMS + FORMS + t for r, t in kinds]) if kinds else np.zeros(0, np.int64), return_counts=True)
        total = np.maximum(np.diff(first), 1)
        at, form = np.nonzero(forms)
        rows = np.concatenate((at, key // TERMS))
        term = np.concatenate((form, key % TERMS))
        of_forms = forms[at, form] / np.maximum(forms[:, :SHAPES].sum(1), 1)[at]
        value = np.sqrt(np.concatenate((of_forms, WORD_WEIGHT**2 * n / total[key // TERMS])))
        order = np.lexsort((term, rows))
        yield lo, hi, Counts(hi - lo, rows[order], term[order], value[order].astype(np.float32))


def _forms(data: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """How often each row has each shape of a word, pair of shapes and kind of repetition."""
    out = np.zeros((rows, FORMS), np.float32)
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    start[firsts] = inside[firsts]
    at = np.flatnonzero(start)
    if len(at):
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        end = np.flatnonzero(stop)
        row = np.searchsorted(offsets, at, side="right") - 1
        kind = FIRST[data]
        upper = np.concatenate(([0], np.cumsum(kind == 1)))
        lower = np.concatenate(([0], np.cumsum(kind == 2)))
        marks = np.concatenate(([0], np.cumsum(kind == 5)))
        size = end - at + 1
        ups, downs, signs = upper[end + 1] - upper[at], lower[end + 1] - lower[at], marks[end + 1] - marks[at]
        case = np.where(ups == 0, 0, np.where(downs == 0, 1, 2))
        shape = ((case * 6 + kind[end]) * 4 + np.minimum(signs, 3)) * 3 + np.minimum(size // 5, 2)
        tail = data[end].astype(np.int64)
        one, two = shape % SHAPES, SHAPES + (tail * 37 + np.minimum(signs, 3)) % SHAPES
        three = 2 * SHAPES + (shape[1:] * 31 + shape[:-1] * 7) % SHAPES
        same_row = row[1:] == row[:-1]
        value = _word_values(data, at, end)
        again = (value[1:] == value[:-1]) & (size[1:] == size[:-1]) & same_row
        near = row[2:] == row[:-2]
        apart = (value[2:] == value[:-2]) & near
        for r, t in ((row, one), (row, two), (row[1:][same_row], three[same_row]), (row[1:][same_row], 3 * SHAPES + again[same_row]), (row[2:][near], 3 * SHAPES + 2 + apart[near])):
            out += np.bincount(r * FORMS + t, minlength=out.size).reshape(out.shape)
    return out


def _word_values(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers that tell words apart well enough to notice repetition: sums of bytes and of their squares."""
    total = np.concatenate(([0], np.cumsum(data.astype(np.int64))))
    square = np.concatenate(([0], np.cumsum(data.astype(np.int64) ** 2)))
    return (total[end + 1] - total[at]) * 1_000_003 + (square[end + 1] - square[at]) * 31 + data[at]


@dataclass
class Voters:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, counts: Counts) -> np.ndarray:
        return _unit(counts.times(self.axes * self.idf[:, None]))

    def vote(self, counts: Counts) -> np.ndarray:
        """Scores of documents from their term counts: similarity-weighted share of label 1 among the nearest."""
        out = np.full(counts.rows, self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        placed = self.place(counts)
        for a in range(0, counts.rows, 256):
            near = placed[a : a + 256] @ self.vectors.T
            top = np.argpartition(-near, k - 1, 1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, 1).astype(np.float64), 0) ** 8
            total = weight.sum(1)
            there = total > 0
            out[a : a + 256][there] = (weight * self.labels[top]).sum(1)[there] / total[there]
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Voters:
    """Fits on at most ``sample`` labelled documents, those with the smallest hash of their id; null labels are left out.

    Of several labels, or texts, of one id the least counts. Without any labelled document every score is 0.5.
    """
    chosen = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("__label").alias("__label"), F.min("__text").alias("__text"))

    def run(batches):
        for batch in batches:
            for lo, hi, counts in terms(batch.column(1)):
                cuts = np.searchsorted(counts.row, np.arange(hi - lo + 1))
                cells = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (counts.term.astype(np.int32), counts.value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int32()), *cells], ["label", "terms", "shares"])

    rows = texts.select("__label", "__text").mapInArrow(run, "label int, terms binary, shares binary").collect()
    if not rows:
        return Voters(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    rows.sort(key=lambda r: (bytes(r.terms), bytes(r.shares), r.label))
    term = [np.frombuffer(r.terms, np.int32) for r in rows]
    counts = Counts(len(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in term]), np.concatenate(term), np.concatenate([np.frombuffer(r.shares, np.float32) for r in rows]))
    label = np.array([float(r.label) for r in rows])
    del rows, term
    idf = (1 + np.log(counts.rows / (1 + np.bincount(counts.term, minlength=TERMS)))).astype(np.float32)
    weighted = Counts(counts.rows, counts.row, counts.term, counts.value * idf[counts.term])
    found = Voters(idf, _axes(weighted), np.zeros((0, 1), np.float32), label, float(label.mean()))
    found.vectors = found.place(counts)
    release()
    return found


def _axes(weighted: Counts) -> np.ndarray:
    """The leading right singular vectors of the rows (terms x dimensions), by subspace iteration from a fixed start."""
    width = min(DIMENSIONS + 16, weighted.rows)
    across = weighted.transposed()
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, width)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(across.times(np.linalg.qr(weighted.times(q))[0]))[0]
    _, _, turn = np.linalg.svd(weighted.times(q), full_matrices=False)
    return (q @ turn.T)[:, : min(DIMENSIONS, width)].astype(np.float32)


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double in 0 to 1, predicted int): predicted is 1 from 0.5. Null and empty texts get the sample's mean label.

    Repeated rows each give a row; other columns are ignored; whole texts are read; no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in batches:
            for lo, hi, counts in terms(batch.column(1)):
                s = sent.value.vote(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, voters: Voters, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least 0.5; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for lo, hi, counts in terms(batch.column(at)):
                good = sent.value.vote(counts) >= 0.5
                if good.any():
                    yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
