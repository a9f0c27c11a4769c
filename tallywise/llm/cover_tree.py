"""All pairs of vectors over a cosine threshold, by dual traversal of cover trees.

Copies count as one vector with a weight. The top of the tree is a broadcast set of pivots (its size bounded in bytes);
a vector belongs to the cell of its nearest pivot, and a cell to blocks of about ``BLOCK`` vectors. Each block becomes a
tree of nested levels: the radius halves from level to level, a node keeps its centre as its first child, and every
node knows a distance that none of its vectors exceeds. Of two blocks one's tree travels to the other (which one, their
numbers' parity tells, so all blocks receive alike), without those vectors that the cell's covering radius or the plane
between the two pivots keeps too far away to link with any vector there. In a pair of trees, pairs of nodes are pruned when even their nearest vectors could not link, taken whole when
all of theirs must, and otherwise opened; vectors are compared in double precision. Each traversal gives one row per
vector it linked (links, and one vector it is connected to), so a group of copies never becomes a list of pairs.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise

BLOCK = 2048
RADII = (1.0, 0.5, 0.25, 0.125)
#: Pivots that are broadcast, in bytes at most (for each length of vectors).
PIVOT_BYTES = 32 << 20
#: Copies of one vector that are over this part of all rows are joined by broadcast: at most so many groups are.
HOT = 1000
SLACK = 1e-4
#: A block's visitors are dealt to as many tasks as there are this many blocks; its own tree goes to each of them.
VISITORS = 128


def _error(width: int) -> float:
    """Bounds the rounding error of the single-precision dot product of two unit vectors (each rounded itself)."""
    return (width + 8) * 2.0**-24


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _apart(cos: np.ndarray, error: float) -> np.ndarray:
    """The largest distance of unit vectors whose cosine is ``cos`` give or take ``error``; the least for a negative one.

    Near copies need this: an error of 1e-7 in their cosine is one of 4e-4 in their distance.
    """
    return np.sqrt(np.maximum(2 - 2 * cos.astype(np.float64) + 2 * error, 0))


class Tree:
    """Vectors in tree order and, for each level, where nodes start, and their radii; the last level is the vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray | None = None):
        unit = _unit(vectors)
        cos = unit @ unit.T
        order, starts = np.arange(len(ids)), [np.array([0])]
        for radius in RADII:
            least = 1 - radius * radius / 2
            parts, cuts, at = [], [], 0
            for a, b in zip(starts[-1], np.append(starts[-1][1:], len(ids)), strict=True):
                left = order[a:b]
                while len(left):
                    near = cos[left[0], left] >= least
                    near[0] = True
                    parts.append(left[near])
                    cuts.append(at)
                    at += len(parts[-1])
                    left = left[~near]
            order, starts = np.concatenate(parts), [*starts, np.array(cuts)]
        weights = np.ones(len(ids), np.int64) if weights is None else weights
        self._set(ids[order], vectors[order], unit[order], weights[order], [*starts, np.arange(len(ids))])

    def _set(self, ids, vectors, unit, weights, starts):
        self.ids, self.vectors, self.unit, self.weights, self.starts = ids, vectors, unit, weights, starts
        self.radii, error = [], _error(vectors.shape[1])
        for s in starts[:-1]:
            owner = np.repeat(s, np.diff(np.append(s, len(ids))))
            self.radii.append(np.maximum.reduceat(_apart(np.einsum("ij,ij->i", unit[owner], unit), error), s))
        self.radii.append(np.zeros(len(ids)))

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.starts[level][1:], len(self.ids))

    def packed(self, keep: np.ndarray) -> bytes:
        """The tree of the vectors in ``keep``: nodes that lose all of theirs go, others get their first one as centre."""
        place = np.cumsum(keep) - keep
        starts = [np.unique(place[s[np.logical_or.reduceat(keep, s)]]).astype(np.int32) for s in self.starts[:-1]]
        return pickle.dumps((self.ids[keep], self.vectors[keep], self.weights[keep], starts))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        ids, vectors, weights, starts = pickle.loads(data)
        tree = cls.__new__(cls)
        tree._set(ids, vectors, _unit(vectors), weights, [*[s.astype(np.int64) for s in starts], np.arange(len(ids))])
        return tree


def _opened(tree: Tree, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children (in the next level) of nodes, and how many each has."""
    first = np.searchsorted(tree.starts[level + 1], tree.starts[level][node])
    last = np.searchsorted(tree.starts[level + 1], tree.ends(level)[node])
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def dual(one: Tree, two: Tree, cosine: float, same: bool):
    """Links of each vector of both trees (sums of weights) and connections (pairs of places: one's, then two's after one's)."""
    reach, error = math.sqrt(2 - 2 * cosine), _error(one.vectors.shape[1])
    links = [np.zeros(len(one.ids), np.int64), np.zeros(len(two.ids), np.int64)]
    ties: list[np.ndarray] = []

    def connect(a, b):
        ties.append(np.column_stack((a, b + len(one.ids))))

    before = [np.concatenate(([0], np.cumsum(t.weights))) for t in (one, two)]
    norms = [np.linalg.norm(t.vectors.astype(np.float64), axis=1) for t in (one, two)]
    deepest = len(RADII) + 1

    def descend(level: int, a: np.ndarray, b: np.ndarray):
        while len(a):
            if len(a) > 2_000_000:
                for k in range(0, len(a), 2_000_000):
                    descend(level, a[k : k + 2_000_000], b[k : k + 2_000_000])
                return
            sa, sb = one.starts[level][a], two.starts[level][b]
            cos = np.einsum("ij,ij->i", one.unit[sa], two.unit[sb])
            if level == deepest:
                close = cos >= cosine - SLACK - error
                a, b = a[close], b[close]
                exact = np.einsum("ij,ij->i", one.vectors[a].astype(np.float64), two.vectors[b].astype(np.float64)) / (norms[0][a] * norms[1][b])
                hit = (exact >= cosine) & ((a != b) if same else True)
                a, b = a[hit], b[hit]
                np.add.at(links[0], a, two.weights[b])
                np.add.at(links[1], b, one.weights[a])
                connect(a, b)
                return
            r = one.radii[level][a] + two.radii[level][b]
            whole = _apart(cos, error) + r <= reach - SLACK
            for x, y in zip(a[whole].tolist(), b[whole].tolist(), strict=True):
                xs, ys = np.arange(one.starts[level][x], one.ends(level)[x]), np.arange(two.starts[level][y], two.ends(level)[y])
                links[0][xs] += before[1][ys[-1] + 1] - before[1][ys[0]]
                links[1][ys] += before[0][xs[-1] + 1] - before[0][xs[0]]
                if same and x == y:
                    links[0][xs] -= one.weights[xs]
                    links[1][ys] -= one.weights[ys]
                connect(xs, np.full(len(xs), ys[0]))
                connect(np.full(len(ys), xs[0]), ys)
            open_ = ~whole & (_apart(cos, -error) - r <= reach + SLACK)
            a, b = a[open_], b[open_]
            ca, na = _opened(one, level, a)
            cb, nb = _opened(two, level, b)
            times = na * nb
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            wide = np.repeat(nb, times)
            a = ca[np.repeat(np.cumsum(na) - na, times) + place // np.maximum(wide, 1)]
            b = cb[np.repeat(np.cumsum(nb) - nb, times) + place % np.maximum(wide, 1)]
            level += 1

    # levels down to the first radius are few nodes or, in high dimensions, nearly all vectors: as one product in rows
    ends_b = two.starts[1]
    for k in range(0, len(one.starts[1]), 512):
        rows = np.arange(k, min(k + 512, len(one.starts[1])))
        cos = one.unit[one.starts[1][rows]] @ two.unit[ends_b].T
        bound = np.minimum(reach + SLACK + one.radii[1][rows][:, None] + two.radii[1][None, :], 2)
        i, j = np.nonzero(cos >= 1 - bound * bound / 2 - error)
        descend(1, rows[i], j)
    pairs = np.concatenate(ties) if ties else np.zeros((0, 2), np.int64)
    return links, pairs


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the smallest place it is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _found(one: Tree, two: Tree, cosine: float) -> pa.RecordBatch:
    """A row for each vector that the traversal of two trees (or of one with itself) links: its links, and its group."""
    same = one is two
    links, pairs = dual(one, two, cosine, same)
    if same:
        ids, n, pairs = one.ids, links[0], pairs % len(one.ids)
    else:
        ids, n = np.concatenate((one.ids, two.ids)), np.concatenate(links)
    root, some = _roots(pairs, len(ids)), n > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(ids[root][some])], ["id", "links", "to"])


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, k1, k2) of the vectors that can link; of rows that repeat an id, the smallest vector counts."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    single = vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    kept = v if single else F.transform(v, lambda x: x.cast("double"))
    own = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), kept.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    if not single:
        # squares of such components would overflow or vanish; cosines don't depend on the scale
        most = F.array_max(F.transform("vector", F.abs))
        own = own.withColumn("vector", F.when((most > 1e100) | (most < 1e-100), F.transform("vector", lambda x: x / most)).otherwise(F.col("vector")))
    return own.select("id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64("vector", F.lit(1)).alias("k2"))


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (long), kept (whether the id is its component's smallest).

    Vectors that are null or empty, zero, or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other. Ids are unique (long): a repeated id is one vector, the smallest of its rows, and
    each of its rows gets the same result; a row without an id links with nothing and has neither component nor
    ``kept``. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = materialise(distinct_vectors(vectors, id_col, vector_col), "vectors")
    single = own.schema["vector"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64
    # partial counts come before the shuffle, so any number of copies is few rows
    groups = materialise(own.groupBy("k1", "k2", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "groups")
    pivots: dict[int, np.ndarray] = {}
    for r in groups.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect():
        k = min(max(1, PIVOT_BYTES // (4 * r.width)), -(-r.n // BLOCK))
        rows = groups.where(F.size("vector") == r.width).orderBy(F.xxhash64("id"), "id").limit(k).select("vector").collect()
        pivots[r.width] = _unit(np.array([x.vector for x in rows]))

    def cells(batches):
        for batch in batches:
            blobs, cell, far = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            flat, at = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(batch.column(3).to_numpy())))
            width = np.diff(at)
            for w in np.unique(width).tolist():
                of_width = np.flatnonzero(width == w)
                for rows in np.array_split(of_width, -(-len(of_width) // 1024)):
                    x = np.stack([flat[at[r] : at[r] + w] for r in rows]).astype(kind)
                    cos = _unit(x) @ pivots[w].T
                    cell[rows] = np.argmax(cos, 1)
                    far[rows] = _apart(cos.max(1), _error(w))
                    for r, blob in zip(rows.tolist(), x, strict=True):
                        blobs[r] = blob.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(cell), pa.array(far), pa.array(blobs, pa.binary())], ["id", "copies", "width", "cell", "far", "vector"])

    dealt = materialise(groups.select("id", "copies", "vector", F.size("vector").alias("width")).mapInArrow(cells, "id long, copies long, width int, cell long, far double, vector binary"), "cells")
    n_of, radius = {w: np.zeros(len(p), np.int64) for w, p in pivots.items()}, {w: np.zeros(len(p)) for w, p in pivots.items()}
    # as many rows as pivots
    for r in dealt.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
        n_of[r.width][r.cell], radius[r.width][r.cell] = r.n, r.radius
    subs = {w: -(-n // BLOCK) for w, n in n_of.items()}
    first, at = {}, 0
    for w in sorted(subs):
        first[w] = at + np.cumsum(subs[w]) - subs[w]
        at += int(subs[w].sum())
    places = [(w, c, int(subs[w][c]), int(first[w][c])) for w in subs for c in range(len(subs[w])) if subs[w][c]]
    per_cell = F.broadcast(spark.createDataFrame(places, "width int, cell long, subs long, first long"))
    reach = math.sqrt(2 - 2 * cosine)

    def build(table: pa.Table) -> pa.Table:
        ids, w = table["id"].to_numpy(), table["width"][0].as_py()
        x = np.frombuffer(b"".join(b.as_py() for b in table["vector"]), kind).reshape(-1, w)
        order = np.argsort(ids)
        tree = Tree(ids[order], x[order], table["copies"].to_numpy()[order])
        return pa.table({"block": table["block"].slice(0, 1), "width": table["width"].slice(0, 1), "cell": table["cell"].slice(0, 1), "tree": [tree.packed(np.ones(len(ids), bool))]})

    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("subs"))
    trees = dealt.join(per_cell, ["width", "cell"]).withColumn("block", block).groupBy("block").applyInArrow(build, "block long, width int, cell long, tree binary")
    trees = materialise(trees, "blocks")

    slices = -(-at // VISITORS)

    def hosts(k, w, cell):
        own = np.arange(first[w][cell], first[w][cell] + subs[w][cell])
        return own[[visits(k, int(other)) for other in own]].tolist()

    def travel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, w, cell, tree = row["block"], row["width"], row["cell"], Tree.unpacked(row["tree"])
                for s in range(slices):
                    yield _sent(k, s, False, row["tree"])
                error = _error(w)
                whole = tree.packed(np.ones(len(tree.ids), bool))
                for other in hosts(k, w, cell):
                    yield _sent(other, k // 2 % slices, True, whole)
                to_own = tree.unit @ pivots[w][cell]
                for low in range(0, len(pivots[w]), 1024):
                    some = pivots[w][low : low + 1024]
                    cos = tree.unit @ some.T
                    between = _apart(some @ pivots[w][cell], error)
                    near = (to_own[:, None] - cos - 4 * error <= (reach + SLACK) * between) & (_apart(cos, -error) - radius[w][low : low + 1024] <= reach + SLACK)
                    near[:, subs[w][low : low + 1024] == 0] = False
                    for q in np.flatnonzero(near.any(0)).tolist():
                        others = hosts(k, w, low + q) if low + q != cell else []
                        part = tree.packed(near[:, q]) if others else b""
                        for other in others:
                            yield _sent(other, k // 2 % slices, True, part)

    def traverse(batches):
        place, home = None, None
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.unpacked(row["tree"])
                if not row["guest"]:
                    place, home = (row["block"], row["slice"]), tree
                    if row["slice"] == 0:
                        yield _found(home, home, cosine)
                elif place == (row["block"], row["slice"]):
                    yield _found(home, tree, cosine)

    # a block's own tree comes first, the others stream past it; a block that got no vectors gets no own tree
    sent = trees.mapInArrow(travel, "block long, slice long, guest boolean, tree binary").repartition("block", "slice").sortWithinPartitions("block", "slice", "guest")
    found = materialise(sent.mapInArrow(traverse, "id long, links long, to long"), "links")
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    known = groups.select("k1", "k2", "id", "copies").join(total, "id", "left").join(comp, "id", "left")
    known = materialise(known.select("k1", "k2", "copies", links.alias("links"), F.coalesce("component", "id").alias("component")), "known")
    keyed, hot = own.select("id", "k1", "k2"), F.col("copies") * HOT > own.count()
    many, few = known.where(hot).drop("copies"), known.where(~hot).drop("copies")
    members = keyed.join(F.broadcast(many), ["k1", "k2"]).unionByName(keyed.join(F.broadcast(many.select("k1", "k2")), ["k1", "k2"], "left_anti").join(few, ["k1", "k2"]))
    out = vectors.select(F.col(id_col).cast("long").alias("id")).join(members.drop("k1", "k2"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def visits(k: int, other: int) -> bool:
    """Whether block ``k`` goes to block ``other``: of two blocks exactly one does, and each receives half of the others."""
    return k != other and ((k + other) % 2 == 0) == (k < other)


def _sent(block: int, slice_: int, guest: bool, tree: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([slice_], pa.int64()), pa.array([guest]), pa.array([tree], pa.binary())], ["block", "slice", "guest", "tree"])
