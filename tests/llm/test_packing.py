import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywise.llm import packing
from tallywise.llm.bpe import Encoder
from tallywise.llm.shared import materialise

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n x", "a\n b", "it's, 'sx \"'t\" don't", " x 　y", "naïve É,é", "漢字 x", "a  b   c", "\t\ttab", "x\n", "x \n", "<|endoftext|> y", "a\u0085b", "12,345.6abc", "!!'s", " 's", "x" * 4000]


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_stretches_give_the_tokenizers_ids():
    r = random.Random(3)
    alphabet = ["a", "B", "é", "'", "s", "t", " ", " ", "\n", "\t", ",", "!", "1", "²", " ", " ", "漢", "😀", "\x1c", "\x00", "ll", "­"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    got = dict(Encoder(PATH).encode(pa.array(texts, pa.string())))
    for i, want in enumerate(ids_of(texts)):
        assert got[i].tolist() == want, repr(texts[i])


def test_added_tokens_get_their_ids_as_in_tokenizers():
    r = random.Random(5)
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"{mark}{mark}", f"x\n{mark}\n\n y", f"it{mark}'s", f" {mark}  é", "<|endoftext", "|>", f"<|{mark}|>", "<|endof", "text|> a", *ODD]
    texts += ["".join(r.choice(["a", "é", "'", "s", " ", "\n", "1", "<", "|>", "漢", mark]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    plain = Tokenizer.from_file(PATH)
    got = dict(Encoder(PATH, added=True).encode(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert got[i].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_packing_query_keeps_added_tokens(spark, tmp_path):
    from tallywise.llm import queries

    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.op10_best_fit_packing(spark, str(tmp_path)).collect()[0]
    ids = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 2]
    assert 50256 in ids and row.length == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_fullest_is_the_best_subset():
    r = random.Random(4)
    for _ in range(200):
        items = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
        space = r.randint(0, 60)
        best = max(s for m in range(1 << len(items)) if (s := sum(x for i, x in enumerate(items) if m >> i & 1)) <= space)
        kinds = sorted(set(items))
        use = packing.fullest(kinds, [items.count(k) for k in kinds], space)
        assert sum(k * n for k, n in use) == best and all(n <= items.count(k) for k, n in use)


def test_whole_packing(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(7, ODD[7]), (500_000, "word " * 5000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, sequence_id string, length int")
    pieces = materialise(packing.token_pieces(df, PATH).withColumn("crc", F.crc32("ids")), "pieces")
    rows = packing.pack(pieces.drop("ids"), ["doc_id", "piece"]).collect()
    want = []
    for (i, _), ids in zip(docs, ids_of([t for _, t in docs]), strict=True):
        ids = [*ids, 2]
        at, end, n = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want.append((i, n, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes())))
            at, end, n = end, end + 1024, n + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows) == sorted(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // 1024) * 1.02 + 1
    assert packing.pack(materialise(pieces.drop("ids").limit(0), "none"), ["doc_id", "piece"]).count() == 0
