"""The manifest against trees built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallywise.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def paths(level):
    """The root over some digests, and for each the siblings up to it as (digest or None, is left)."""
    at, out = list(range(len(level))), [[] for _ in level]
    while len(level) > 1:
        for k, j in enumerate(at):
            other = j ^ 1
            out[k].append((level[other] if other < len(level) else None, other < j))
        level = [digest("".join(level[j : j + 2])) for j in range(0, len(level), 2)]
        at = [j // 2 for j in at]
    return level[0], out


def by_hand(rows):
    parts = {}
    for doc_id, source, lang, n, text in rows:
        hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = (leaf((doc_id, source, lang, n, text)), leaf((doc_id, source, lang, n + 1 if hit else n, text)))
        parts.setdefault(lang, []).append((doc_id is not None, doc_id or 0, *own, doc_id))
    order = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {p: paths([x[2] for x in sorted(parts[p])]) for p in order}
    root, upper = paths([trees[p][0] for p in order])
    for p, onward in zip(order, upper, strict=True):
        for (_, _, own, tampered, doc_id), path in zip(sorted(parts[p]), trees[p][1], strict=True):
            acc = tampered
            for other, left in path + onward:
                acc = digest((other or "") + acc if left else acc + (other or ""))
            yield doc_id, own, trees[p][0], root, digest("".join(x or "" for x, _ in path + onward)), acc, acc == root


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, `group` string, rank int")
    changed = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=changed)
    fold = merkle.folded(F.col("tampered"), F.col("path"))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), fold, fold == F.col("root")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows), key=str)


def test_parts_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "UNITS", 4)
    monkeypatch.setattr(merkle, "BROADCAST_COUNTS", 0)
    r, rows = random.Random(4), []
    for lang, n in [("en", 70), ("de", 16), ("fr", 17), (None, 5), ("", 1), ("zz", 2), ("é", 33), ("Z", 3), ("a", 4)]:
        rows += [(r.randrange(10**6), r.choice(["s", None, "ü:"]), lang, r.choice([None, 0, 5]), r.choice([None, "", "text é", "-", "w " * 50_000])) for _ in range(n)]
    rows += rows[:3] + [rows[0]] * 20 + [(rows[5][0], "other", "en", 1, "same id"), (None, None, None, None, None), (None, "s", "en", 3, "no id"), (None, "s", "en", 3, "no id")]
    r.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 700])
def test_one_part(spark, n):
    check(spark, [(k * 3 - 5, "s", "en", k, f"text {k}") for k in range(n)])


def test_empty_table_and_intervals(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle.manifest(docs, ["doc_id", "lang", "text"]).count() == 0
    leaves = spark.range(10).select(F.lit("g").alias("group"), F.col("id").alias("rank"), F.lit(10).cast("long").alias("units"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = {(x.level, x.lo): (x.hi, x.digest) for x in merkle.nodes(merkle.buckets(leaves, "group"), "group").collect()}
    assert [sum(level == k for level, _ in got) for k in range(5)] == [10, 5, 3, 2, 1] and got[4, 0][0] == 10 and got[2, 8][0] == 10
    assert got[1, 4] == (6, digest(digest("4") + digest("5"))) and got[2, 8][1] == digest(got[1, 8][1])
