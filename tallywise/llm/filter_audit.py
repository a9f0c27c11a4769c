"""How quality filters act together: what each removes at each place of each order, and its Shapley share.

A document that fails some filters is a bit mask. All coalitions of filters are tabulated per part: how many documents
a coalition removes is the number whose mask meets it. Every figure of an order is then a difference of two coalitions
(the filters up to a step, and those before it), and Shapley values are the exact solution of the kernel-weighted
least-squares fit of an additive game to that table, constrained to share out what all filters together remove.

Texts are read once; what is kept of a row is its id, part, mask and digest. Copies of a text are found through the
smallest id of each digest (aggregated before the shuffle, so one text may make up any share of the rows); everything
after that is at most 2**filters rows a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Salts that a row's label is looked up under, so that one id with very many texts isn't one task.
SALTS = 8


def text_filters(text: Column) -> dict[str, Column]:
    """A to D, whether a text (not null) fails: short, repetitive, shouting, holding symbols."""
    blank = text
    for c in "\t\n\x0b\f\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(blank, " "), "")  # one plain separator is split without a regular expression
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicates: str, text: str = "text", part: str = "lang") -> DataFrame:
    """A row per part, order of filters (``filter_order``) and ``step``, zeros included.

    ``filters`` map one-letter names to failure conditions over ``docs``' columns (null: passed); ``duplicates`` names
    one more filter, failed by a document whose text is that of a smaller doc_id in any part, removed or not. Null texts
    are empty, null parts the empty string. Long columns, counted within the part: kept, removed, redundant (fails the
    step's filter, removed earlier), unique_fails, good_lost and toxic_lost (removed at the step with quality or toxic 1
    in ``labels``; of repeated labels one with 1 counts), shapley (the filter's removed, summed over all orders).

    Repeated rows count each; rows of one id and one text aren't copies of each other. A row without an id has no label,
    fails ``duplicates`` never and makes no other fail it. Empty tables give no rows; columns of other names are ignored.
    """
    names = [*filters, duplicates]
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(filters.values())), F.lit(0))
    own = docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    hist = histogram(materialise(own, "filter-marks"), labels, 1 << len(filters))
    return steps(coalitions(hist, len(names)), names)


def histogram(marks: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic), with ``copy_bit`` in the mask of what fails as a copy. marks: doc_id, part, mask, digest."""
    said = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good OR toxic")
    said = said.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a null id finds no label under any salt: many salts keep such rows from meeting in one task
    salt = F.pmod(F.xxhash64("digest"), F.when(F.col("doc_id").isNull(), F.lit(SALTS << 10)).otherwise(F.lit(SALTS))).cast("int")
    # never broadcast: Spark judges labels by their files' size, which are a few bytes a row before there are SALTS of each
    rows = marks.withColumn("salt", salt).join(said.hint("merge"), ["doc_id", "salt"], "left")
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)).cast("long"), "toxic": F.coalesce("toxic", F.lit(False)).cast("long")})

    kinds = ["part", "mask", "good", "toxic"]
    every = rows.groupBy(kinds).agg(F.count("*").alias("n"))
    # partitioned by the join's keys already; then the smallest id of each text, rows of that id and text together
    same = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "salt", "digest", *kinds).agg(F.count("*").alias("n"))
    same = same.groupBy("doc_id", "salt", "digest").agg(F.collect_list(F.struct(*kinds, "n")).alias("rows"))
    first = same.groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.inline("rows")).unionByName(rows.where("doc_id IS NULL").groupBy(kinds).agg(F.count("*").alias("n")))
    both = every.unionByName(first.groupBy(kinds).agg((-F.sum("n")).alias("n"))).withColumn("mask", F.col("mask").bitwiseOR(copy_bit)).unionByName(first)
    out = both.groupBy(kinds).agg(F.sum("n").alias("n")).where("n > 0")
    return out.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalitions(hist: DataFrame, filters: int) -> DataFrame:
    """(part, total, n, good, toxic): arrays over all coalitions, by bit mask, of what each removes."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    met = hist.withColumn("s", F.explode(every)).withColumn("hit", (F.col("mask").bitwiseAND(F.col("s")) != 0).cast("long"))
    sums = met.groupBy("part", "s").agg(F.sum("n").alias("total"), *[F.sum(F.col(c) * F.col("hit")).alias(c) for c in ("n", "good", "toxic")])
    rows = F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic")))
    return sums.groupBy("part").agg(F.first("total").alias("total"), rows.alias("rows")).select("part", "total", *[F.col(f"rows.{c}").alias(c) for c in ("n", "good", "toxic")])


def shapley(removed: list[int], filters: int) -> list[Fraction]:
    """The additive game that fits ``removed`` (by coalition) best under Shapley's kernel, its values summing to what all remove.

    Normal equations with a multiplier for the constraint, by elimination in rationals.
    """
    full = (1 << filters) - 1
    rows = [[Fraction(0)] * (filters + 2) for _ in range(filters + 1)]
    for s in range(1, full):
        size = s.bit_count()
        weight = Fraction(filters - 1, comb(filters, size) * size * (filters - size))
        inside = [k for k in range(filters) if s >> k & 1]
        for a in inside:
            rows[a][-1] += weight * removed[s]
            for b in inside:
                rows[a][b] += weight
    for k in range(filters):
        rows[k][filters] = rows[filters][k] = Fraction(1)
    rows[filters][-1] = Fraction(removed[full])
    for k in range(filters + 1):
        pivot = next(r for r in range(k, filters + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(filters + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [rows[k][-1] for k in range(filters)]


def steps(table: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``audit`` from the table of coalitions: the same small work for each part."""
    m, full = len(names), (1 << len(names)) - 1

    def of_part(part: str, total: int, n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
        shares = [x * factorial(m) for x in shapley(n, m)]
        if any(x.denominator != 1 for x in shares):
            raise ArithmeticError(f"the shares of part {part!r} aren't whole: {shares}")
        for order in permutations(range(m)):
            before = 0
            for step, k in enumerate(order, 1):
                after = before | 1 << k
                gone = n[after] - n[before]
                yield (part, "".join(names[x] for x in order), step, total - n[after], gone, n[1 << k] - gone, n[full] - n[full & ~(1 << k)], good[after] - good[before], toxic[after] - toxic[before], int(shares[k]))
                before = after

    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame(of_part(row.part, int(row.total), *([int(x) for x in v] for v in (row.n, row.good, row.toxic))), columns=columns)

    return table.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[3:]))
