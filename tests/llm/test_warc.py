"""Archives written and read back, with records inside payloads and splits everywhere."""

import glob
import hashlib
import random
from collections import Counter

import pytest

from tallywise.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def by_hand(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    for i, url, h in rows:
        data = (h or "").encode()
        to = last.get(h or "") if len(data) >= 1000 else None
        to = None if to is None or i is not None and i >= to else to
        yield i, (url or "").replace("\r", "%0D").replace("\n", "%0A") or None, "revisit" if to is not None else "response", to, len(data), hashlib.sha1(data).hexdigest()


def pages():
    r = random.Random(5)
    texts = [None, "", "short", "é" * 499, "é" * 500, "x" * 1000, "y" * 300_000, "\r\n\r\n", "WARC/1.0", "WARC/1.0\r\n", "a WARC/1.0\r\n", "\r\n\r\nWARC/1.0\r\n\r\n"]
    texts += [FAKE, FAKE * 2, "p" + FAKE * 40, FAKE + "tail", "head\n" + FAKE.replace("5", "999999"), FAKE * 30 + "z" * 5000 + FAKE, FAKE[:-4], FAKE.replace("Content-Length: 5", "Content-Length: x"), "HTTP/1.1 200 OK\r\n\r\nx"]
    rows = [(k, r.choice([None, "http://a.com/é", "http://b.com/x\r\nWARC-Type: revisit", f"http://c.com/{k}"]), r.choice(texts) if k % 3 else f"own {k} " * r.choice([1, 200])) for k in range(400)]
    rows += [(9000 + k, "http://hot.com/", "hot " * 600) for k in range(200)] + [rows[7], (None, None, "x" * 1000), (None, None, "of none " * 300), (None, None, "of none " * 300), (9199, "http://hot.com/again", "hot " * 600)]
    r.shuffle(rows)
    return rows


def read_back(spark, rows, path, parts):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(parts)
    warc.write(df, path)
    return [(x.page_id, x.url, x.record_type, x.refers_to, x.payload_bytes, x.payload_digest) for x in warc.read(spark, path).where("intact IS NULL OR intact").collect()]


@pytest.mark.parametrize("split", [200, 4096, 1 << 27])
def test_records_inside_payloads_and_splits(spark, tmp_path, monkeypatch, split):
    rows = pages()
    if split == 4096:
        monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
        monkeypatch.setattr(warc, "STRETCH", 1000)
    if split == 200:  # so many splits that fewer rows do
        rows = [x for x in rows if len(x[2] or "") < 5000][:60]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = read_back(spark, rows, str(tmp_path / "w"), 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(got) == Counter(by_hand(rows))


def test_no_rows_and_a_torn_archive(spark, tmp_path):
    assert read_back(spark, [], str(tmp_path / "none"), 1) == []
    rows = [(k, f"http://a.com/{k}", f"page {k} " * 50) for k in range(30)]
    assert len(read_back(spark, rows, str(tmp_path / "torn"), 1)) == 30
    (name,) = glob.glob(str(tmp_path / "torn" / "part-*"))
    whole = open(name, "rb").read()
    (tmp_path / "cut").mkdir()
    for kept in (whole[:-7], whole[: len(whole) // 2], whole[5:], whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        (tmp_path / "cut" / "part-0.txt").write_bytes(kept)
        with pytest.raises(ValueError, match="chain"):
            warc.read(spark, str(tmp_path / "cut"))
    at = whole.index(b"page 3 page 3")
    (tmp_path / "cut" / "part-0.txt").write_bytes(whole[:at] + b"P" + whole[at + 1 :])
    assert [x.page_id for x in warc.read(spark, str(tmp_path / "cut")).where("NOT intact").collect()] == [3]
