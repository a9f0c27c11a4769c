"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Sets are grouped in size bands. In a band's scheme the hashed universe is cut into m segments; two sets of the band
that reach the threshold differ in at most H shingles, so, when each segment i is given v_i of 1 (must be equal) or 2
(may differ by one, through one-deletion neighbourhoods) and the v_i add up to more than H, some segment agrees. How
many segments get which v is chosen for each band by cost, from how many sets there are. A set's segments without
shingles can't be looked up, and common shingles are left out of segments; a set that this leaves with too few also has
its segments of all shingles indexed, and where even those are too few, segments of one shingle each. A pair is missed
by a level only where both of its sets are short there, and then both are on the next one.

Sets that agree somewhere are candidates. Large runs of sets that share a key are united where they have their smallest
id in common and that makes neither more rows nor more comparisons than the runs had, since near copies share most of
their keys and would stand in a run for each of them. Parity bitmaps, whose differences can't exceed the sets' own, leave those that
could be linked, and only a spanning forest of these is ever written: its components are clusters within which all
links lie. A cluster's shingles meet once (in blocks and pairs of blocks, if it is large), where intersections are
counted exactly and each set gives at most one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bits_for, dealt, gathered, top_bits
from .components import components, extended
from .shared import materialise, partitions
from .textkit import mix, shingles

FLUSH = 1_000_000
#: Sets of a run that are compared by their bitmaps at once, and sets and shingles of a cluster that are verified at once.
BLOCK, SETS, VOLUME = 1024, 512, 1_000_000
#: Runs up to this size give their pairs with a count of shared keys; larger ones are compared in blocks.
SMALL = 24
#: Ids of the larger runs that are united at once, and unions that a run is held against, with the cells of their table.
UNITED, UNIONS, CELLS = 200_000, 64, 1 << 25
#: Ids of candidate documents up to which they are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 300_000
#: Documents whose copies a task remembers, so that copies are indexed once.
REMEMBERED = 200_000
#: Shingles in this share of a sample of about so many documents are common; they are left out of the segments, which
#: loses no pair (two sets differ in no more of the others than in all) but spares runs that agree in nothing else.
SAMPLED, COMMON = 4000, 0.004
#: Assumed chance that a shingle of one set is also in an unlinked one, for the allocation's cost.
ALIKE = 0.002
_C1, _C2, _C3 = (np.uint64(x) for x in (0x51_7C_C1_B7_27_22_0A_95, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Scheme:
    """Sets of ``low`` to ``high`` shingles, and larger ones up to ``top`` that may link to them."""

    low: int
    high: int
    top: int
    segments: int
    twos: int


def bands(percent: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, low * 100 // percent - 1)
        out.append((low, high))
        low = high + 1
    return out


def differ(a: int, b: int, percent: int) -> int:
    """The most shingles in which linked sets of sizes a and b can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def allocate(low: int, high: int, sets: int, percent: int) -> Scheme:
    """The cheapest of a few allocations: entries indexed, and pairs expected to agree by chance."""
    top = high * 100 // percent
    need = differ(high, top, percent) + 1
    best = None
    for share in (0.0, 0.25, 0.5, 1.0):
        m = 1
        while True:
            load = low / m
            none, one = math.exp(-load), load * math.exp(-load)
            each = (1 - share) * (1 - none) + share * (2 * (1 - none - one) + one)
            if m * each - 2 * math.sqrt(m * none) >= need or m >= 3 * high:
                break
            m += max(1, m // 50)
        twos = round(share * m)
        entries = m + share * low
        chance = sets * m * ((1 - share) * ALIKE**load + share * (1 + load) * ALIKE ** max(load - 1, 0))
        if best is None or entries + chance < best[0]:
            best = (entries + chance, Scheme(low, high, top, max(m, 1), twos))
    return best[1]


def _keys(u: np.ndarray, n: int, k: int, scheme: Scheme, percent: int, level: int) -> tuple[np.ndarray, int]:
    """Index keys in scheme k of a set of n shingles, of which u (sorted hashes) are cut into segments, and how many of
    them a partner shares at least (under 1: partners can be missed)."""
    if not len(u):
        return np.zeros(0, np.uint64), 0
    segment = ((u >> np.uint64(32)) * np.uint64(scheme.segments) >> np.uint64(32)).astype(np.int64)
    token = mix(u ^ _C3)
    head = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    size = np.diff(np.append(head, len(u)))
    own = segment[head]
    value = np.where((own < scheme.twos) & (size > 1) & (level == 0), 2, 1)
    need = differ(n, scheme.high if n > scheme.high else n * 100 // percent, percent) + 1
    spare = int(value.sum()) - need + 1
    total = np.add.reduceat(token, head)
    tag = mix(own.astype(np.uint64) ^ np.uint64((2 * k + level) << 40))
    keys = [mix(total ^ tag)]
    if level:
        return keys[0], spare
    fewer = np.repeat(value == 2, size)
    if fewer.any():
        keys.append(mix((np.repeat(total, size)[fewer] - token[fewer]) ^ np.repeat(tag, size)[fewer]))
    return np.concatenate(keys), spare if not scheme.twos else -(-spare // 2)


class Keys:
    """Index keys of sets, and how many of them the set surely shares with a partner of at least its size."""

    def __init__(self, schemes: list[Scheme], percent: int, common: np.ndarray):
        self.schemes, self.percent, self.common = schemes, percent, common
        self.hot: np.ndarray | None = None
        self.alike: np.ndarray | None = None
        self.lows = np.array([s.low for s in schemes])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, u: np.ndarray) -> tuple[np.ndarray, int]:
        k = int(np.searchsorted(self.lows, len(u), side="right")) - 1
        known = self.maybe[(u & np.uint64((1 << 20) - 1)).astype(np.int64)]
        if known.any():
            at = np.searchsorted(self.common, u[known])
            known[known] = self.common[np.minimum(at, len(self.common) - 1)] == u[known]
        out, least, n = [], 1, len(u)
        for level, own in enumerate((u[~known], u)):
            shared = []
            for at in (k, k - 1):
                if at >= 0 and n <= self.schemes[at].top:
                    keys, many = _keys(own, n, at, self.schemes[at], self.percent, level)
                    out.append(self.subset(keys, len(keys) - many + 1) if level and many > 1 else keys)
                    shared.append(many)
            if not level:
                least = max(1, shared[0])
            if min(shared) >= 1:
                return np.concatenate(out), least
        out.append(self.subset(mix(u ^ _C1), differ(n, n * 100 // self.percent, self.percent) + 1))
        return np.concatenate(out), least

    def subset(self, keys: np.ndarray, need: int) -> np.ndarray:
        """The first keys in one order for all sets, in which hot ones come last: of two sets' keys before the first one
        they share, each stands for a difference of theirs, so as many as the differences and one more are enough."""
        return keys if self.hot is None else keys[np.lexsort((keys, self.hot_of(keys)))][:need]

    def united(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hot keys and ids, keys that nearly the same sets hold as one of them, each pair once."""
        keys = self.alike[np.searchsorted(self.hot, keys)]
        order = np.lexsort((keys, ids))
        keys, ids = keys[order], ids[order]
        first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))[: len(keys)]
        return keys[first], ids[first]

    def hot_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, keys)
        return self.hot[np.minimum(at, len(self.hot) - 1)] == keys if len(self.hot) else np.zeros(len(keys), bool)


def _index(made: Keys, bits: int, words: int):
    def run(batches):
        seen: set = set()
        keys, ids, held = [], [], 0

        def flush():
            k, i = np.concatenate(keys), np.repeat(np.array(ids, np.int64), [len(x) for x in keys])
            hot = made.hot_of(k)
            few, own = made.united(k[hot], i[hot])
            k, i, hot = np.concatenate((k[~hot], few)), np.concatenate((i[~hot], own)), np.arange(len(k) - hot.sum() + len(few)) >= len(k) - hot.sum()
            part = top_bits(k, bits)
            part[hot] = (1 << bits) + (mix(i[hot].astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(part.astype(np.int16) if bits < 15 else part, kind="stable")
            keys.clear()
            ids.clear()
            # a key's low 32 bits do within its part: what they confuse is verified later
            return _compact(dealt(part[order], (k[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), i[order]))

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for row, s in shingles(batch.column(1), words):
                if not len(s):
                    continue
                u = np.unique(s)
                mark = (len(u), *_mark(u))
                if mark in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(mark)
                keys.append(made.of(u)[0])
                ids.append(own[row])
                held += len(keys[-1])
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    return run


def _common(texts: DataFrame, words: int, n: int, keys_of=np.unique) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles (or other keys) in over COMMON of a hashed sample of documents (at most the sample's
    keys x its share), and for each one that stands for all that have the same smallest documents in two orders, which
    keys of nearly the same documents have."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held = [(ids[row], np.unique(keys_of(s))) for row, s in shingles(batch.column(1), words) if len(s)]
            keys = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in held]])
            orders = [mix(np.repeat(np.array([i for i, _ in held], np.int64), np.array([len(x) for _, x in held], np.int64)).astype(np.uint64) ^ c).astype(np.int64) for c in (_C1, _C2)]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
            least = [np.minimum.reduceat(x[order], head) if len(head) else x for x in orders]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys[head], np.diff(np.append(head, len(keys))), *least)], ["s", "n", "one", "two"])

    own = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLED))) == 0)
    often = own.mapInArrow(run, "s long, n long, one long, two long").groupBy("s").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.min("two").alias("two"))
    rows = sorted((r.s % (1 << 64), r.one, r.two) for r in often.where(F.col("n") >= max(8, COMMON * min(n, SAMPLED))).collect())
    stands: dict = {}
    return np.array([s for s, *_ in rows], np.uint64), np.array([stands.setdefault((one, two), s) for s, one, two in rows], np.uint64)


def _compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Ids of a cell as steps from one to the next, in 32 bits where they fit; (part, keys, first id, steps, wide steps)."""
    first, steps, wide, keys = [], [], [], []
    for cell, key in zip(batch.column(2), batch.column(1), strict=True):
        ids, key = np.frombuffer(cell.as_buffer(), np.int64), np.frombuffer(key.as_buffer(), np.uint32)
        order = np.argsort(ids, kind="stable")
        ids, key = ids[order], key[order]
        step = np.diff(ids)
        small = not len(step) or int(step.max()) < 1 << 32
        first.append(int(ids[0]))
        keys.append(key.tobytes())
        steps.append(step.astype(np.uint32).tobytes() if small else None)
        wide.append(None if small else step.tobytes())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(first, pa.int64()), pa.array(steps, pa.binary()), pa.array(wide, pa.binary())], ["p", "c0", "first", "steps", "wide"])


def _ids(table: pa.Table) -> np.ndarray:
    out = []
    for first, steps, wide in zip(table["first"].to_pylist(), table["steps"], table["wide"], strict=True):
        step = np.frombuffer(steps.as_buffer(), np.uint32).astype(np.int64) if steps.is_valid else np.frombuffer(wide.as_buffer(), np.int64)
        out.append(np.concatenate(([first], first + np.cumsum(step))))
    return np.concatenate(out)


def _mark(u: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(u ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in (_C1, _C2))


def _agreeing(bits: int):
    """Ids that share keys: of runs of up to SMALL ids (kind 0), pairs (x, y) with how many keys they share (z); larger
    runs (kind 1) as run x, smallest id y, size z and sorted ids, once for runs of the same ids. Parts from 2 ** bits on
    hold some ids of hot keys, by id: members (kind 2), run x, id y."""

    def run(table: pa.Table) -> pa.Table:
        part = table["p"][0].as_py()
        keys, ids = gathered(table, "c0", np.uint32), _ids(table)
        if part < 1 << bits:
            return _runs(part, keys, ids)
        return pa.table({"kind": np.full(len(keys), 2), "x": -1 - keys.astype(np.int64), "y": ids, "z": np.ones(len(keys), np.int64), "ids": pa.nulls(len(keys), pa.binary())})

    return run


def _runs(part: int, keys: np.ndarray, ids: np.ndarray) -> pa.Table:
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    same = keys[1:] == keys[:-1]
    many = np.zeros(len(keys), bool)
    many[1:] |= same
    many[:-1] |= same
    keys, ids = keys[many], ids[many]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    out, cells = [], []
    if len(keys):
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(head, len(keys)))
        one, two = (np.add.reduceat(mix(ids.astype(np.uint64) ^ c), head) for c in (_C1, _C2))
        order = np.lexsort((two, one, size))
        new = np.ones(len(head), bool)
        new[order[1:]] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (size[order][1:] != size[order][:-1])
        large = np.flatnonzero(new & (size > SMALL))
        out.append((np.ones(len(large), np.int64), (np.int64(part) << np.int64(32)) + keys.astype(np.int64)[head[large]], ids[head[large]], size[large]))
        cells = [ids[a : a + n].tobytes() for a, n in zip(head[large].tolist(), size[large].tolist(), strict=True)]
        few = np.repeat((size > 1) & (size <= SMALL), size)
        keys, ids = keys[few], ids[few]
        pairs = []
        for d in range(1, SMALL):
            a = np.flatnonzero(keys[:-d] == keys[d:])
            if not len(a):
                break
            pairs.append(np.column_stack((ids[a], ids[a + d])))
        if pairs:
            pairs = np.concatenate(pairs)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1))))
            out.append((np.zeros(len(first), np.int64), pairs[first, 0], pairs[first, 1], np.diff(np.append(first, len(pairs)))))
    kind, x, y, z = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), (), ())))
    return pa.table({"kind": kind, "x": x, "y": y, "z": z, "ids": pa.array(cells + [None] * (len(x) - len(cells)), pa.binary())})


def _cost(size: np.ndarray) -> np.ndarray:
    """Rows that a run of so many ids takes where its blocks meet."""
    return size * -(-size // BLOCK)


def _unions(runs: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Unions (first run, sorted ids) of runs, the largest first, such that each run lies in one of them. None has more
    pairs of ids than its runs together, nor takes more rows than they."""
    universe, flat = np.unique(np.concatenate(runs), return_inverse=True)
    ends = np.cumsum([len(x) for x in runs])
    many = int(max(1, min(UNIONS, len(runs), CELLS // len(universe))))
    held = np.zeros((many, len(universe)), bool)
    first, size, pairs, rows = np.full(many, -1), *np.zeros((3, many), np.int64)
    out, oldest = [], 0
    for k, end in enumerate(ends.tolist()):
        own = flat[end - len(runs[k]) : end]
        n = len(own)
        both = size + n - held[:, own].sum(1)
        fits = (first >= 0) & (both**2 <= pairs + n * n) & (_cost(both) <= rows + _cost(n))
        if fits.any():
            at = int(np.where(fits, both - size, n + 1).argmin())
        else:
            at, oldest = oldest, (oldest + 1) % many
            if first[at] >= 0:
                out.append((int(first[at]), universe[held[at]]))
            held[at], first[at], size[at], pairs[at], rows[at], both[at] = False, k, 0, 0, 0, n
        held[at, own] = True
        size[at], pairs[at], rows[at] = both[at], pairs[at] + n * n, rows[at] + _cost(n)
    return out + [(int(first[at]), universe[held[at]]) for at in np.flatnonzero(first >= 0)]


def _united(table: pa.Table) -> pa.Table:
    """Members (run, id) of the unions of large runs (run, low, salt, ids) of the same smallest id."""
    cols = {c: table[c].to_numpy() for c in ("low", "salt", "size", "run")}
    order = np.lexsort((cols["run"], -cols["size"], cols["salt"], cols["low"]))
    cols = {c: x[order] for c, x in cols.items()}
    run, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in _slices(cols["low"], cols["salt"]):
        for first, own in _unions([np.frombuffer(table["ids"][k].as_buffer(), np.int64) for k in order[lo:hi].tolist()]):
            run.append(np.full(len(own), cols["run"][lo + first]))
            ids.append(own)
    return pa.table({"run": np.concatenate(run), "id": np.concatenate(ids)})


def _members(found: DataFrame) -> DataFrame:
    """Members (run, id) of hot keys' runs (united where they were indexed) and of unions of the other large runs. A smallest id of many large runs is
    dealt to several tasks, each of which unites its share of them."""
    large = found.where("kind = 1").select(F.col("x").alias("run"), F.col("y").alias("low"), F.col("z").alias("size"), "ids")
    volume = large.agg(F.sum("size")).first()[0] or 0
    much = large.groupBy("low").agg(F.sum("size").alias("total")).where(F.col("total") > UNITED)  # fewer than the volume / UNITED
    salted = large.join(F.broadcast(much), "low", "left").withColumn("salt", F.pmod(F.xxhash64("run"), F.ceil(F.coalesce("total", F.lit(1)) / UNITED)))
    groups = max(partitions(found.sparkSession), volume // UNITED)
    united = salted.select("run", "low", "salt", "size", "ids").groupBy(F.pmod(F.xxhash64("low", "salt"), F.lit(groups)).alias("group")).applyInArrow(_united, "run long, id long")
    return materialise(united.unionByName(found.where("kind = 2").select(F.col("x").alias("run"), F.col("y").alias("id"))), "united")


def _bitmap(u: np.ndarray, finer: int = 0) -> bytes:
    """Parities of the shingles' counts in 64 or more bits, about one or two a shingle, or more by a power of two."""
    n = 1 << max(6, (len(u) - 1).bit_length() + finer)
    bits = np.bincount((mix(u ^ _C2) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` words: halves laid over each other keep the parities."""
    own = np.array([len(b) // 8 for b in blobs])
    out = np.zeros((len(blobs), width), np.uint64)
    for w in np.unique(own).tolist():
        rows = np.flatnonzero(own == w)
        flat = np.frombuffer(b"".join([blobs[k] for k in rows]), np.uint64)
        out[rows] = np.bitwise_xor.reduce(flat.reshape(len(rows), w // width, width), 1)
    return out


def _near(apart: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m whose bitmaps differ in so many bits could be linked."""
    return ((100 + percent) * apart <= (100 - percent) * (n + m)) & (percent * np.maximum(n, m) <= 100 * np.minimum(n, m))


def _slices(*columns: np.ndarray) -> list[tuple[int, int]]:
    """First and end rows of runs of equal rows."""
    if not len(columns[0]):
        return []
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])], strict=True))


def _could(blobs: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets could be linked by their bitmaps: those that pass folded ones are compared in full."""
    width = min(len(b) for b in blobs) // 8
    full = _matrix(blobs, width)
    some = min(width, 16)
    maps = np.bitwise_xor.reduce(full.reshape(len(full), width // some, some), 1)
    ok = np.zeros((len(n), len(n)), bool)
    step = max(1, 4_000_000 // (some * len(n)))
    for a in range(0, len(n), step):
        apart = np.bitwise_count(maps[a : a + step, None] ^ maps[None]).sum(2, dtype=np.int64)
        ok[a : a + step] = _near(apart, n[a : a + step, None], n[None], percent)
    if some < width:
        one, two = np.nonzero(np.triu(ok, 1))
        step = max(1, 4_000_000 // width)
        for a in range(0, len(one), step):
            x, y = one[a : a + step], two[a : a + step]
            ok[x, y] = ok[y, x] = _near(np.bitwise_count(full[x] ^ full[y]).sum(1, dtype=np.int64), n[x], n[y], percent)
    return ok


def _forest(percent: int):
    """Of the pairs of sets of a run that could be linked, as few as join the same clusters.

    A group holds many runs' blocks, each of at most two blocks' sets; sets of two blocks are compared across.
    """

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_numpy() for c in ("run", "i", "j", "rep", "n", "cluster", "block")}
        order = np.lexsort((cols["j"], cols["i"], cols["run"]))
        cols = {c: x[order] for c, x in cols.items()}
        blobs = [table["bitmap"][k].as_py() for k in order.tolist()]
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in _slices(cols["run"], cols["i"], cols["j"]):
            rep, cluster, block = (cols[c][lo:hi] for c in ("rep", "cluster", "block"))
            if (cluster == cluster[0]).all():
                continue
            ok = _could(blobs[lo:hi], cols["n"][lo:hi], percent)
            if cols["i"][lo] != cols["j"][lo]:
                ok &= block[:, None] != block[None]
            cluster = cluster.copy()
            ok &= cluster[:, None] != cluster[None]
            for a in np.flatnonzero(ok.any(1)).tolist():
                others = np.flatnonzero(ok[a] & (cluster != cluster[a]))
                if len(others):
                    names, first = np.unique(cluster[others], return_index=True)
                    found.append(np.column_stack((np.full(len(first), rep[a]), rep[others[first]])))
                    cluster[np.isin(cluster, names)] = cluster[a]
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    column = np.cumsum(np.concatenate(([False], tokens[1:] != tokens[:-1])))
    several = np.bincount(column)[column] > 1
    row, column = row[several], column[several]
    column = np.cumsum(np.concatenate(([False], column[1:] != column[:-1]))) if len(column) else column
    out = np.zeros((len(sets), len(sets)))
    step = max(64, 2_000_000 // len(sets))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (first, first + step))
        part = np.zeros((len(sets), min(step, int(column[-1]) + 1 - first)), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def _linked(percent: int):
    """(a, b) for sets a of clusters' blocks that are connected with another set b by links; at most a row for each set."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_numpy() for c in ("cluster", "i", "j", "id", "comp", "block")}
        order = np.lexsort((cols["id"], cols["j"], cols["i"], cols["cluster"]))
        cols = {c: x[order] for c, x in cols.items()}
        items = table["items"]
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in _slices(cols["cluster"], cols["i"], cols["j"]):
            ids, comp, block = (cols[c][lo:hi] for c in ("id", "comp", "block"))
            if (comp == comp[0]).all():
                continue
            both = _shared([np.frombuffer(items[k].as_buffer(), np.int64) for k in order[lo:hi].tolist()])
            n = both.diagonal()
            ok = (100 * both >= percent * (n[:, None] + n[None] - both)) & (comp[:, None] != comp[None])
            if cols["i"][lo] != cols["j"][lo]:
                ok &= block[:, None] != block[None]
            label, old = np.arange(len(ids)), None
            while old is None or (label != old).any():
                old = label
                label = np.minimum(label, np.where(ok, label[None], len(ids)).min(1))
                label = label[label]
            moved = label != np.arange(len(ids))
            found.append(np.column_stack((ids[moved], ids[label[moved]])))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _possible(percent: int):
    """Rows (a, b, n, m, x, y) whose bitmaps x and y allow a link."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (4, 5))
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            width = np.array([min(len(p), len(q)) // 8 for p, q in zip(x, y, strict=True)], np.int64)
            ok = np.zeros(len(x), bool)
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                apart = np.bitwise_count(_matrix([x[k] for k in rows], w) ^ _matrix([y[k] for k in rows], w)).sum(1).astype(np.int64)
                ok[rows] = _near(apart, n[rows], m[rows], percent)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id (long). Linked: 100 * intersection >= percent * union.

    A document's set is its distinct ``words``-word shingles; with fewer words, the whole sequence as one; null and
    empty texts have none, link with nothing and are their own component. Equal sets are one class, whatever the
    texts. Ids are unique (long); a repeated row is returned as often as it comes, and one without an id links with
    nothing and has no component. Other columns are ignored. No text is cut, no group is capped. Shingles stand as 64-bit hashes of their words' hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def fingerprint(batches):
        for batch in batches:
            n, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, s in shingles(batch.column(1), words):
                if len(s):
                    u = np.unique(s)
                    n[row] = len(u)
                    one[row], two[row] = _mark(u)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two)], ["id", "n", "one", "two"])

    sets = materialise(texts.mapInArrow(fingerprint, "id long, n long, one long, two long"), "sets")
    texts, nameless = texts.where("id IS NOT NULL"), sets.where("id IS NULL").select("id", "n", F.col("id").alias("rep"))
    sets = sets.where("id IS NOT NULL")
    classes = materialise(sets.where("n > 0").groupBy("n", "one", "two").agg(F.min("id").alias("rep")), "classes")
    whole = sets.join(classes, ["n", "one", "two"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    whole = materialise(whole, "representatives")
    counts = {r.k: (r.sets, r.total) for r in classes.groupBy(F.floor(F.log2("n") * 2).alias("k")).agg(F.count("*").alias("sets"), F.sum("n").alias("total")).collect()}
    most = sum(t for _, t in counts.values())
    schemes = [allocate(low, high, counts.get(math.floor(math.log2(low) * 2), (1, 0))[0], percent) for low, high in bands(percent) if low <= 4 * max(1, most)]
    bits = bits_for(max(2 * partitions(spark), most / 500_000))
    common, _ = _common(texts, words, sum(n for n, _ in counts.values()))
    made = Keys(schemes, percent, common)
    made.hot, made.alike = _common(texts, words, sum(n for n, _ in counts.values()), lambda s: made.of(np.unique(s))[0])
    entries = texts.mapInArrow(_index(made, bits, words), "p long, c0 binary, first long, steps binary, wide binary")
    found = materialise(entries.groupBy("p").applyInArrow(_agreeing(bits), "kind long, x long, y long, z long, ids binary"), "runs")
    runs = _members(found)
    few = found.where("kind = 0").groupBy("x", "y").agg(F.sum("z").alias("z"))

    rep = whole.groupBy("id").agg(F.min("rep").alias("rep"), F.min("n").alias("n"))
    seen = found.where("kind = 0").select(F.explode(F.array("x", "y")).alias("id")).unionByName(runs.select("id")).distinct()
    rep = materialise(rep.join(seen, "id", "left_semi"), "run-representatives")
    own = materialise(runs.join(rep, "id").select("run", "rep", "n").distinct(), "members")
    # copies indexed in several tasks share their keys; one of them is enough, so the largest count stands for a pair
    few = few.join(rep.select(F.col("id").alias("x"), F.col("rep").alias("a"), F.col("n").alias("na")), "x").join(rep.select(F.col("id").alias("y"), F.col("rep").alias("b"), F.col("n").alias("nb")), "y")
    few = few.where("a <> b").where(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
    least = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b"))
    few = few.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), least.alias("smaller")).agg(F.max("z").alias("z"))
    few = materialise(few, "sharing")
    ids = materialise(own.select(F.col("rep").alias("id")).unionByName(few.select(F.col("a").alias("id"))).unionByName(few.select(F.col("b").alias("id"))).distinct(), "candidates")

    def bitmaps(batches):
        for batch in batches:
            at, n, maps, fine, least = [], [], [], [], []
            for row, x in shingles(batch.column(1), words):
                u = np.unique(x)
                at.append(row)
                n.append(len(u))
                maps.append(_bitmap(u))
                fine.append(_bitmap(u, 2))
                least.append(made.of(u)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, (np.array(n, np.int64), maps, fine, np.array(least, np.int64)))], ["id", "n", "coarse", "fine", "least"])

    maps = materialise(_chosen(texts, ids, ids.count()).mapInArrow(bitmaps, "id long, n long, coarse binary, fine binary, least long"), "bitmaps")
    enough = few.join(maps.select(F.col("id").alias("smaller"), "least"), "smaller").where("z >= least").select("a", "b")
    enough = enough.join(maps.select(F.col("id").alias("a"), "n", F.col("coarse").alias("x")), "a").join(maps.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("coarse").alias("y")), "b")
    clusters = components(enough.select("a", "b", "n", "m", "x", "y").mapInArrow(_possible(percent), "a long, b long"))

    for across in (False, True):
        named = materialise(own.join(clusters.select(F.col("id").alias("rep"), "component"), "rep", "left").select("run", "rep", "n", F.coalesce("component", "rep").alias("cluster")), "named")
        mixed = named.groupBy("run").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        mixed = materialise((mixed.where(F.col("size") > BLOCK) if across else mixed).select("run", F.ceil(F.col("size") / BLOCK).alias("blocks"), "size"), "mixed")
        rows = mixed.select(F.sum(F.col("size") * F.col("blocks") if across else F.col("size"))).first()[0]
        if rows:
            open_ = named.join(mixed, "run").join(maps.select(F.col("id").alias("rep"), F.col("fine").alias("bitmap")), "rep")
            pairs = _dealt(_blocks(open_, "rep", across), "run", max(partitions(spark), rows // 4000)).applyInArrow(_forest(percent), "a long, b long")
            clusters = extended(clusters, materialise(pairs.distinct(), "forest"))

    comp = _components_within(clusters, rep, texts, words, percent)
    out = whole.unionByName(nameless).join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _chosen(texts: DataFrame, rows: DataFrame, count: int) -> DataFrame:
    """The texts of the rows' ids, with the rows' other columns."""
    return texts.join(F.broadcast(rows) if count <= BROADCAST_IDS else rows, "id")


def _blocks(rows: DataFrame, key: str, across: bool) -> DataFrame:
    """Deals rows to one of their ``blocks``: (i, j) is (block, block), or, ``across``, each pair of different blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
    if not across:
        return rows.withColumn("i", F.col("block")).withColumn("j", F.col("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> other")
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _dealt(rows: DataFrame, key: str, groups: int):
    return rows.groupBy(F.pmod(F.xxhash64(key, "i", "j"), F.lit(groups)).alias("group"))


def _components_within(clusters: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Components (id, component) of the exact links, all of which are inside clusters (id, component).

    ``sizes``: rep, n. A cluster's sets meet in blocks first; pairs of blocks only follow where a cluster has several
    and isn't one component yet.
    """
    spark = texts.sparkSession
    own = clusters.withColumnRenamed("component", "cluster").join(sizes.groupBy(F.col("rep").alias("id")).agg(F.min("n").alias("n")), "id")
    own = materialise(own, "clustered")
    size = own.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") / VOLUME)).alias("blocks"), F.sum("n").alias("total"))

    def arrays(batches):
        for batch in batches:
            at, sets, held = [], [], 0
            for row, x in shingles(batch.column(1), words):
                at.append(row)
                sets.append(np.unique(x).tobytes())
                held += len(x)
                if held > FLUSH:
                    yield cells(batch, at, sets)
                    at, sets, held = [], [], 0
            yield cells(batch, at, sets)

    def cells(batch, at, sets):
        own = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([own.column(0), *own.columns[2:], pa.array(sets, pa.binary())], ["id", "cluster", "blocks", "comp", "items"])

    comp = None
    for across in (False, True):
        rows = own.join(size, "cluster")
        if across and comp is None:
            break
        if across:
            rows = rows.where("blocks > 1").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
            open_ = rows.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cluster")
            rows = rows.join(open_, "cluster", "left_semi")
        else:
            rows = rows.withColumn("comp", F.col("id"))
        rows = materialise(rows.select("id", "cluster", "blocks", "comp", "n"), "to-verify")
        count, volume = rows.select(F.count("*"), F.sum(F.col("n") * F.when(F.lit(across), F.col("blocks")).otherwise(1))).first()
        if not count:
            continue
        shingled = _chosen(texts, rows.drop("n"), 8 * count).select("id", "text", "cluster", "blocks", "comp").mapInArrow(arrays, "id long, cluster long, blocks long, comp long, items binary")
        links = _dealt(_blocks(shingled, "id", across), "cluster", max(partitions(spark), volume // VOLUME)).applyInArrow(_linked(percent), "a long, b long")
        links = materialise(links, "links")
        comp = components(links) if comp is None else extended(comp, links)
    return comp if comp is not None else clusters
