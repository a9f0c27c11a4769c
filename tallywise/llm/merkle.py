"""Merkle manifest of a dataset: nodes labelled by the interval of leaf ranks they cover, inclusion proofs, verification.

Leaves of a group are ranked without gathering the group (ranges of a global order, then offsets of their counts). A
node at level k of a group is the interval [j * 2**k, (j + 1) * 2**k) of leaf ranks, cut at the group's end. Levels are
bucketed by eights: a bucket holds the subtree over up to 256 consecutive units (leaves, or roots of the buckets below),
so a dataset of n leaves takes log2(n) / 8 rounds, each over 1/256 of the rows of the one before, and no row grows with
the data. Proofs go down the same way: every unit is joined to the bucket whose interval contains its own, which
attaches its ancestors; at each level the parent's interval less its own is the sibling's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, partitions

#: Levels in a bucket, and the units that its subtree covers.
LEVELS = 8
UNITS = 1 << LEVELS
#: Counts of (range, group) up to which they are broadcast; more are joined by shuffling.
BROADCAST_COUNTS = 200_000


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lowercase hex sha256 of the fields in order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rank`` (from 0) of each row in its group by ``order``, and ``units``, the group's rows. Nulls come first.

    A group may hold any share of the rows: ranges of the order over all groups are sorted apart; a row's rank is its
    place in its range plus what the ranges before hold of its group. Equal rows share ranges by their place in the input.
    """
    marked = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [group, *order, "__tie"]
    sorted_ = marked.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = materialise(sorted_.drop("__tie").withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy(group, "__range").agg(F.count("*").alias("n"), F.min("__place").alias("first"))
    # a group has as many rows here as there are ranges, whatever it holds
    own = Window.partitionBy(group)
    offsets = counts.select(group, "__range", "first", (F.sum("n").over(own.orderBy("__range")) - F.col("n")).alias("skip"), F.sum("n").over(own).alias("units"))
    offsets = materialise(offsets, "range-offsets")
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_COUNTS else offsets
    return placed.join(small, [group, "__range"]).withColumn("rank", F.col("__place") - F.col("first") + F.col("skip")).drop("__range", "__place", "first", "skip")


def _next_level(level: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda j: F.sha2(F.concat(F.get(level, 2 * j), F.coalesce(F.get(level, 2 * j + 1), F.lit(""))), 256))


def _height(units: Column) -> Column:
    """Levels of a bucket in a group of so many units of its kind: up to eight, or up to the single root."""
    return F.least(F.lit(LEVELS), F.length(F.bin(units - 1)) - F.when(units == 1, 1).otherwise(0))


def buckets(units: DataFrame, group: str) -> DataFrame:
    """Subtrees over 256 units each: (group, bucket, lo, hi, units, levels), ``levels`` all digests from the units up.

    units: group, rank, digest, units (the number of the group's). lo and hi count units.
    """
    own = units.groupBy(group, F.shiftright("rank", LEVELS).alias("bucket"), "units").agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("rows"))
    levels = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, F.col("height")), F.array(F.col("rows.digest")), lambda done, _: F.concat(done, F.array(_next_level(F.element_at(done, -1)))))
    at = F.col("bucket") * UNITS
    return own.withColumn("height", _height(F.col("units"))).select(group, "bucket", at.alias("lo"), F.least(at + UNITS, F.col("units")).alias("hi"), "units", levels.alias("levels"))


def nodes(tier: DataFrame, group: str, below: int = 0) -> DataFrame:
    """(group, level, lo, hi, digest): all nodes of buckets, each with the interval [lo, hi) of leaf ranks it covers.

    ``below``: levels under the buckets' units. The last interval of a group ends where its last unit would.
    """
    per_level = tier.select(group, "lo", "hi", F.posexplode("levels").alias("k", "digests")).select(group, "lo", "hi", "k", F.posexplode("digests").alias("j", "digest"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    lo = F.col("lo") + F.col("j") * width
    return per_level.select(group, (F.col("k") + below).alias("level"), (lo * (1 << below)).alias("lo"), (F.least(lo + width, F.col("hi")) * (1 << below)).alias("hi"), "digest")


def _attached(units: DataFrame, above: DataFrame, group: str, more: list[str]) -> DataFrame:
    """``units`` with ``path``: for each level up to the root, the sibling's digest (null: none) and whether it stands left.

    Each unit [rank, rank + 1) is joined to the bucket whose interval contains it; ``path`` of the bucket follows.
    """
    up = above.select(F.col(group).alias("__group"), "bucket", "lo", "hi", "levels", F.col("path").alias("upper"), *more)
    within = (F.col(group) == F.col("__group")) & (F.shiftright("rank", LEVELS) == F.col("bucket")) & (F.col("lo") <= F.col("rank")) & (F.col("rank") + 1 <= F.col("hi"))

    def step(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        place = F.col("rank") - F.col("lo")
        own = place - place % width
        parent = place - place % (2 * width)
        # parent [parent, parent + 2 * width) less own [own, own + width)
        left = own > parent
        sibling = F.when(left, parent).otherwise(own + width)
        return F.struct(F.get(F.element_at(F.col("levels"), k + 1), (sibling / width).cast("int")).alias("digest"), left.alias("left"))

    steps = F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), 1, F.size("levels") - 1), step)
    return units.join(up, within).withColumn("path", F.concat(steps, F.col("upper"))).drop("__group", "bucket", "lo", "hi", "levels", "upper")


_NO_PATH = "array<struct<digest:string,left:boolean>>"


def trees(leaves: DataFrame, group: str = "group", top=None) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``path`` and ``subroot``, table of (group, subroot)) of one tree per group.

    leaves: group (not null), rank, units, digest and any other columns. ``top`` maps the table of subroots to one with
    ``path`` (onward from a subroot) and more columns per group, which all leaves get; by default there is none onward.
    """
    units, tiers = leaves, []
    # every round leaves 1/256 of the rows; it ends when each group is one bucket
    while True:
        tiers.append(materialise(buckets(units, group), "buckets"))
        root = F.element_at(F.element_at("levels", -1), 1)
        if tiers[-1].where(F.col("units") > UNITS).isEmpty():
            break
        # groups that are done leave with their root; the others go up
        units = tiers[-1].where(F.col("units") > UNITS).select(group, F.col("bucket").alias("rank"), root.alias("digest"), F.shiftright(F.col("units") + UNITS - 1, LEVELS).alias("units"))
    done = [t.where(F.col("units") <= UNITS).select(group, root.alias("subroot")) for t in tiers]
    subroots = done[0]
    for t in done[1:]:
        subroots = subroots.unionByName(t)
    onward = top(subroots) if top else subroots.withColumn("path", F.array().cast(_NO_PATH))
    more = [c for c in onward.columns if c not in (group, "path")]
    known = None
    for tier in reversed(tiers):
        # the bucket that is its group's root is told the way on by group, any other by the bucket that contains it
        rooted = tier.where(F.col("units") <= UNITS).join(onward, group)
        lower = tier if known is None else tier.where(F.col("units") > UNITS)
        told = rooted if known is None else rooted.unionByName(_attached(lower.withColumn("rank", F.col("bucket")).drop("lo", "hi", "bucket").withColumnRenamed("levels", "own"), known, group, more).select(group, F.col("rank").alias("bucket"), (F.col("rank") * UNITS).alias("lo"), F.least((F.col("rank") + 1) * UNITS, F.col("units")).alias("hi"), "units", F.col("own").alias("levels"), "path", *more))
        known = told
    return _attached(leaves, known, group, more), subroots


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    def up(acc: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, acc)).otherwise(F.concat(acc, other)), 256)

    return F.aggregate(path, digest, up)


def proof(path: Column) -> Column:
    """Digest of the siblings on a path, in order; levels without one leave nothing."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.coalesce(s["digest"], F.lit(""))), ""), 256)


def manifest(docs: DataFrame, fields: list[str], part: str = "lang", id_col: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """Each row's place in the tree: its id, ``leaf``, ``subroot``, ``root``, ``path``, and ``tampered``, the leaf of the changed row.

    ``fields`` in order make a leaf. A part's leaves ascend by id (nulls first; equal ids by leaf), in pairs up to its
    subroot; subroots, by part (null first, UTF-8 bytewise), likewise to the root. ``changed`` maps field names to what
    an altered row would hold (null map: as it is). Rows that are equal throughout are leaves of their own. Empty tables
    give no rows; other columns are ignored, whatever their names.
    """
    given = {f: F.col(f) for f in fields}
    altered = given | (changed or {})
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("")).alias("group"),
        leaf(*[given[f] for f in fields]).alias("digest"),
        leaf(*[altered[f] for f in fields]).alias("tampered"),
    )
    # the texts are read here, once; ranges are then cut over the digests
    own = ranked(materialise(rows, "leaves"), "group", ["id", "digest"])

    def over_parts(subroots: DataFrame) -> DataFrame:
        units = ranked(subroots.select(F.lit("").alias("all"), "group", F.col("subroot").alias("digest")), "all", ["group"])
        found, roots = trees(units, "all")
        return materialise(found.select("group", F.col("digest").alias("subroot"), "path", F.col("subroot").alias("root")), "parts")

    found, _ = trees(own, "group", over_parts)
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")
