"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, decontaminate, filter_audit, kneser_ney, language_id, line_dedup, merkle, packing, quality, reply_trees, warc
from .jaccard_join import jaccard_classes
from .shared import materialise, new_folder
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary file; operators take any other path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.linked(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT node, b FROM reach JOIN links ON links.a = seen
), own AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM embeddings JOIN own ON node = vec_id LEFT JOIN degree ON a = vec_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_sides AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_sides JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT node, b FROM reach JOIN links ON links.a = seen
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(seen)::BIGINT AS component_id
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = kneser_ney.fit(docs.where(~held_out))
    return kneser_ney.score(docs, model).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    voters = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(docs, voters).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


#: A conversation whose texts hold the template's own marks.
MARKS = r"\### Assistant: </turn> ok"


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    nodes = reply_trees.chain(given.unionByName(own))
    back = reply_trees.read_back(reply_trees.format_paths(reply_trees.reply_paths(nodes, top=1), nodes))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKS}' UNION ALL SELECT -7, 1, 'assistant', '{MARKS}'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<turn>') + length(role) + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM clean GROUP BY conv_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = materialise(table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"), line_dedup.html_lines(F.col("html")).alias("lines")), "page-lines")
    out = line_dedup.drop_boilerplate(pages, "host", "lines")
    text = F.array_join(F.filter(F.transform("lines", line_dedup._trimmed), lambda x: x != ""), "\n")
    return out.select("page_id", "host", "n_lines", "n_dropped", text.alias("text"))


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
    regexp_split_to_array(regexp_replace(coalesce(html, ''), '(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)', ' ', 'g'),
      '(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|title|head|body|html|nav|article|section|header|footer|br|main|aside|blockquote|pre)(?:\s[^>]*)?/?>|\n') AS parts
  FROM pages
), lines AS (
  SELECT page_id, host, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part FROM cut
), clean AS (
  SELECT page_id, host, pos, regexp_replace(
    replace(replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
    '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') AS line
  FROM lines
), totals AS (
  SELECT host, count(*) AS pages FROM cut GROUP BY host
), boiler AS (
  SELECT host, line FROM clean JOIN totals USING (host) WHERE line <> ''
  GROUP BY host, line, pages HAVING count(DISTINCT page_id) >= 2 AND count(DISTINCT page_id) > 0.3 * pages
)
SELECT page_id, c.host, count(*)::BIGINT AS n_lines, count(b.line)::BIGINT AS n_dropped,
  coalesce(string_agg(CASE WHEN b.line IS NULL AND c.line <> '' THEN c.line END, chr(10) ORDER BY pos), '') AS text
FROM clean c LEFT JOIN boiler b ON c.host = b.host AND c.line = b.line
GROUP BY page_id, c.host
"""

def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.fit_text(table(spark, sf_dir, "documents")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM texts
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE kind = 'b' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM shingles d JOIN shingles b ON d.s = b.s
  WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, n_shared::BIGINT AS n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_shingles
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), added=True)
    pieces = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces, ["doc_id", "piece"])


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"), filter_audit.text_filters(F.col("text")), "E")


OP11_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, [CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN own.doc_id > min(own.doc_id) OVER (PARTITION BY t) THEN 'E' END] AS fs, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM own LEFT JOIN said ON said.doc_id = own.doc_id
), kinds AS (
  SELECT part, fs, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM fails GROUP BY part, fs
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), met AS (
  SELECT *, list_min(list_transform(list_filter(fs, lambda f: f IS NOT NULL), lambda f: instr(filter_order, f))) AS hit FROM kinds, orders
), placed AS (
  SELECT *, substr(filter_order, step, 1) AS f FROM met, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), out AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN hit IS NULL OR hit > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit < step AND list_contains(fs, f) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN list_contains(fs, f) AND len(list_filter(fs, lambda y: y IS NOT NULL)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = step THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN x ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM out
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed=changed)
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH RECURSIVE told AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS part, n_chars,
    concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::UBIGINT)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, part, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + (xor(crc, 4294967295::UBIGINT) % 7 = 0)::INT)::VARCHAR) || ':' || (n_chars + (xor(crc, 4294967295::UBIGINT) % 7 = 0)::INT) END || tail) AS tampered
  FROM told
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM leaves
), tree AS (
  SELECT part, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT part, level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY part, level, pos // 2
), subroots AS (
  SELECT part, digest AS subroot, level AS height, row_number() OVER (ORDER BY encode(part)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2
), walk AS (
  SELECT l.doc_id, l.leaf, l.part, l.pos, l.pos AS at, 0 AS level, l.n, l.tampered AS folded, '' AS siblings FROM placed l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.part, w.pos, w.at // 2, w.level + 1, (w.n + 1) // 2,
    sha256(CASE WHEN s.digest IS NULL THEN w.folded WHEN w.at % 2 = 1 THEN s.digest || w.folded ELSE w.folded || s.digest END), w.siblings || coalesce(s.digest, '')
  FROM walk w LEFT JOIN tree s ON s.part = w.part AND s.level = w.level AND s.pos = CASE WHEN w.at % 2 = 1 THEN w.at - 1 ELSE w.at + 1 END WHERE w.n > 1
), onward AS (
  SELECT w.doc_id, w.leaf, r.subroot, r.pos AS at, 0 AS level, r.n, w.folded, w.siblings FROM walk w JOIN subroots r ON r.part = w.part WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.at // 2, w.level + 1, (w.n + 1) // 2,
    sha256(CASE WHEN s.digest IS NULL THEN w.folded WHEN w.at % 2 = 1 THEN s.digest || w.folded ELSE w.folded || s.digest END), w.siblings || coalesce(s.digest, '')
  FROM onward w LEFT JOIN upper s ON s.level = w.level AND s.pos = CASE WHEN w.at % 2 = 1 THEN w.at - 1 ELSE w.at + 1 END WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM onward, (SELECT digest AS root FROM upper WHERE n = 1) WHERE n = 1
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND page_id < last THEN last END AS refers_to
FROM own
"""


QUERIES = {"op1_embedding_near_dedup": op1_embedding_near_dedup, "op5_quality_classifier": op5_quality_classifier, "op8_language_id": op8_language_id, "op9_benchmark_decontamination": op9_benchmark_decontamination, "op2_ngram_jaccard_join": op2_ngram_jaccard_join, "op10_best_fit_packing": op10_best_fit_packing, "op3_lm_scoring": op3_lm_scoring, "op4_token_counts": op4_token_counts, "op6_reply_trees": op6_reply_trees, "op7_line_dedup": op7_line_dedup, "op11_filter_interaction_audit": op11_filter_interaction_audit, "op12_merkle_manifest": op12_merkle_manifest, "op13_warc": op13_warc}
ORACLES = {"op1_embedding_near_dedup": OP1_SQL, "op9_benchmark_decontamination": OP9_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op6_reply_trees": OP6_SQL, "op7_line_dedup": OP7_SQL, "op11_filter_interaction_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc": OP13_SQL}
