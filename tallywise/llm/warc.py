"""WARC archives written and read by Spark's own text files, records found by verified chains of boundaries.

Writing: a record is a text that ends in two line breaks, so Spark's writer commits whole archives to any file system.

Reading: files are split anywhere. Tasks cut their part at the magic ``WARC/1.0``; each cut is a candidate whose header
tells where its successor would begin. Payloads may hold the magic, even whole records, so a candidate counts only if the
chain from the file's start gets to it. Candidates that follow each other without a gap are one run of their block; runs
point to the run that holds their exit, and pointer jumping (pointers double their reach in each round) finds the runs
that the start reaches. A chain that doesn't end at its file's end is an error, not a shorter archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Payloads of so many bytes at least are stored once.
MIN_BYTES = 1000
#: Repeated payloads up to which they are broadcast (some 60 bytes each); more are joined under SALTS salts.
BROADCAST_PAYLOADS, SALTS = 300_000, 32
#: Bytes of file by which records that hold the magic are joined to their pieces.
STRETCH = 1 << 20
#: The profile of revisits, as the format names it.
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def deduplicated(pages: DataFrame, id_col: str = "page_id", text: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` with payload, bytes, digest (sha1) and refers_to: the largest id of an equal payload, null where it's the own.

    Payloads under ``min_bytes`` refer to none; null texts are empty. Rows that repeat the largest id don't refer either; a
    row without an id refers to the largest there is, and none to it.
    """
    payload = F.coalesce(F.col(text), F.lit(""))
    rows = pages.withColumn("payload", payload).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "__more": F.xxhash64("payload")})
    key = ["digest", "bytes", "__more"]
    heads = rows.where(F.col("bytes") >= min_bytes).groupBy(*key).agg(F.max(id_col).alias("__first"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = materialise(heads, "payload-heads")
    if heads.count() <= BROADCAST_PAYLOADS:
        both = rows.join(F.broadcast(heads), key, "left")
    else:
        salted = heads.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, [*key, "__salt"], "left").drop("__salt")
    first = F.col("__first")
    return both.withColumn("refers_to", F.when(F.col(id_col).isNull() | (F.col(id_col) < first), first)).drop("__first", "__more")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", text: str = "html", min_bytes: int = MIN_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
    """A record per row of ``pages`` under ``path``, one archive per partition: a response, or a revisit of an equal payload.

    Records are named by the row's id (rows that repeat an id repeat the name); line breaks in addresses are escaped, a
    null address is left out. An empty table leaves no record. Other columns are ignored.
    """
    own = deduplicated(pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(text).alias("html")), min_bytes=min_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit\r\n").otherwise("response\r\n"),
        F.lit("WARC-Record-ID: "),
        name(F.col("page_id")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), address, F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
        F.col("block"),
    )
    own.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, value): what stands between two marks of the magic, in order of ``place`` in each block of a file."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def _parsed(value: Column) -> dict[str, Column]:
    """Of a record without its magic: ``size`` in bytes with it (null: no record), ``whole``, and what its header and payload say."""
    head = F.substring_index(value, END, 1)
    body = F.octet_length(head) + len(END)
    length = F.when(body <= F.octet_length(value), _field(head, "Content-Length").try_cast("long"))
    size = len(MAGIC) + body + length + len(END)
    whole = size == len(MAGIC) + F.octet_length(value)
    raw = value.cast("binary")
    block = F.substring(raw, body + 1, length.cast("int"))
    http = F.substring_index(block.cast("string"), END, 1)
    is_http = _field(head, "Content-Type").startswith("application/http") & (F.octet_length(http) < F.octet_length(block))
    payload = F.when(is_http, F.substring(block, F.octet_length(http) + len(END) + 1, length.cast("int"))).otherwise(block)
    named = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    kind = F.lower(_field(head, "WARC-Type"))
    stored = whole & (kind != "revisit")
    return {
        "size": size,
        "whole": whole,
        "page_id": named(_field(head, "WARC-Record-ID")),
        "record_type": kind,
        "refers_to": F.when(kind == "revisit", named(_field(head, "WARC-Refers-To"))),
        "url": F.nullif(_field(head, "WARC-Target-URI"), F.lit("")),
        "said_digest": F.lower(F.regexp_extract(_field(head, "WARC-Payload-Digest"), "(?i)^sha1:(.*)$", 1)),
        "said_bytes": F.when(is_http, _field(http, "Content-Length").try_cast("long")),
        "payload_bytes": F.when(stored, F.octet_length(payload).cast("long")),
        "payload_digest": F.when(stored, F.sha1(payload)),
    }


def _located(cuts: DataFrame) -> DataFrame:
    """Candidates with their ``offset``, ``next`` and ``start``, the offset of their run; ``end`` is the file's size.

    What lies before the first magic of a file is no candidate. Windows run over a block of a file, and over a file's blocks.
    """
    step = F.col("bytes") + len(MAGIC)
    blocks = cuts.groupBy("file", "block").agg(F.sum(step).alias("total"))
    own = Window.partitionBy("file")
    starts = blocks.select("file", "block", (F.sum("total").over(own.orderBy("block")) - F.col("total")).alias("before"), (F.sum("total").over(own) - len(MAGIC)).alias("end"))
    in_block = Window.partitionBy("file", "block").orderBy("place")
    at = cuts.withColumns({"within": F.sum(step).over(in_block) - step, "nth": F.row_number().over(in_block)}).join(starts, ["file", "block"])
    at = at.withColumn("offset", F.col("before") + F.col("within") - len(MAGIC)).withColumn("next", F.col("offset") + F.col("size")).where("offset >= 0")
    opens = F.when(F.lag("next").over(in_block) == F.col("offset"), None).otherwise(F.col("offset"))
    return at.withColumn("opens", opens).withColumn("start", F.max("opens").over(in_block)).drop("opens", "within", "before", "total")


def _reached(at: DataFrame) -> DataFrame:
    """(file, start, entry): runs on the chain from their file's start, and the offset at which it enters them."""
    exits = at.groupBy("file", "start").agg(F.max_by("next", "offset").alias("exit"))
    landing = at.select("file", F.col("offset").alias("exit"), F.col("start").alias("to"))
    jump = materialise(exits.join(landing, ["file", "exit"]).select("file", F.col("start").alias("from"), "to", F.col("exit").alias("entry")), "jumps")
    found = at.where("offset = 0 AND start = 0").select("file", "start", F.lit(0).cast("long").alias("entry"))
    while not jump.isEmpty():
        further = found.join(jump, (found["file"] == jump["file"]) & (found["start"] == jump["from"])).select(found["file"], F.col("to").alias("start"), jump["entry"])
        found = materialise(found.unionByName(further), "reached-runs")
        # pointers of pointers: all runs within twice the distance are found in the next round
        a, b = jump.alias("a"), jump.alias("b")
        jump = materialise(a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.from"))).select("a.file", "a.from", "b.to", "b.entry"), "jumps")
    return found


def _in_pieces(spark: SparkSession, path: str, at: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, put together from all their pieces: (file, offset, value).

    ``broken``: their file, offset and next. Only blocks that hold such pieces are read again.
    """
    stretch = lambda c: F.floor(c / STRETCH).cast("long")
    spans = broken.select(F.col("file").alias("of"), F.col("offset").alias("first"), F.col("next").alias("last"), F.explode(F.sequence(stretch(F.col("offset")), stretch(F.col("next") - 1))).alias("stretch"))
    within = (F.col("file") == F.col("of")) & (stretch(F.col("offset")) == F.col("stretch")) & (F.col("offset") >= F.col("first")) & (F.col("offset") < F.col("last"))
    wanted = materialise(at.select("file", "block", "nth", "offset").join(spans, within).select("file", "block", "nth", "offset", "first"), "wanted-pieces")
    again = _pieces(spark, path).join(wanted.select("file", "block").distinct(), ["file", "block"], "left_semi")
    again = again.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))).join(wanted, ["file", "block", "nth"])
    parts = again.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    return parts.select("file", F.col("first").alias("offset"), F.array_join("parts.value", MAGIC).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact) of each record under ``path``.

    Bytes and digest are those of the full payload: computed from it in a response, told by the header in a revisit.
    ``intact``: the digest is the one that the header tells (null where it tells none). Raises ValueError where the chain
    of a file breaks before its end. Empty files hold no record.
    """
    cuts = _pieces(spark, path)
    own = _parsed(F.col("value"))
    cuts = materialise(cuts.select("file", "block", "place", F.octet_length("value").cast("long").alias("bytes"), *[c.alias(k) for k, c in own.items()]), "boundaries")
    at = materialise(_located(cuts), "candidates")
    runs = _reached(at)
    kept = at.join(runs, ["file", "start"]).where(F.col("offset") >= F.col("entry")).drop("entry")
    kept = materialise(kept, "records")
    files = at.select("file", "end").distinct().join(kept.groupBy("file").agg(F.max_by("next", "offset").alias("reach")), "file", "left")
    torn = [r["file"] for r in files.where("reach IS NULL OR reach <> end").limit(5).collect()]
    if torn:
        raise ValueError(f"records don't chain to the end of {torn}")
    result = ["file", "offset", "page_id", "url", "record_type", "refers_to", "said_digest", "said_bytes", "payload_bytes", "payload_digest"]
    out, broken = kept.where("whole").select(result), kept.where("NOT whole").select("file", "offset", "next")
    if not broken.isEmpty():
        joined = _in_pieces(spark, path, at, broken)
        out = out.unionByName(joined.select("file", "offset", *[c.alias(k) for k, c in _parsed(F.col("value")).items()]).select(result))
    stored = F.col("payload_digest").isNotNull()
    return out.select(
        *result[:6],
        F.when(stored, F.col("payload_bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.coalesce("payload_digest", "said_digest").alias("payload_digest"),
        F.when(stored & (F.col("said_digest") != ""), F.col("payload_digest") == F.col("said_digest")).alias("intact"),
    )
