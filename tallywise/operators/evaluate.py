"""Scoring of whole runs (EVA), sampling and governance (SMP, GOV, AUD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise


def rendered(value: Column, scales: list[float], decimals: list[int]) -> Column:
    """FN19 and EVA1: array of struct(text, half_unit): the value printed at each scale and number of decimals, without
    separators; those of under three digits are left out."""
    out = []
    for s in scales:
        for d in decimals:
            text = F.replace(F.format_number(F.abs(value) / s, d), F.lit(","))
            out.append(F.when(F.length(F.regexp_replace(text, r"\D", "")) >= 3, F.struct(text.alias("text"), F.lit(0.5 * 10.0**-d * s).alias("half_unit"))))
    return F.array_compact(F.array(*out))


def predictions(rows: DataFrame) -> DataFrame:
    """EVA3 and EVA4: per (doc_id, field, period_type) the first non-null value's row, else the last null row."""
    null = F.col("value").isNull()
    order = F.struct(null, F.when(null, -F.col("seq")).otherwise(F.col("seq")))
    return rows.groupBy("doc_id", "field", "period_type").agg(F.min_by("seq", order).alias("seq"), F.min_by("value", order).alias("value"))


def score(key: DataFrame, preds: DataFrame) -> DataFrame:
    """EVA6: truth rows (doc_id, field, period_type, truth, tol) with answered, strict and approx (within 1 %)."""
    both = key.join(preds, ["doc_id", "field", "period_type"], "left")
    gap = F.abs(F.col("value") - F.col("truth"))
    return both.withColumn("answered", F.col("value").isNotNull()).withColumn("strict", F.coalesce(gap <= F.col("tol") + 1e-9 * F.abs("truth"), F.lit(False))).withColumn("approx", F.coalesce(gap <= 0.01 * F.abs("truth"), F.lit(False)))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """EVA8 and EVA9 per group: counts, accuracy, silent errors (answered, wrong, not flagged), workload, flag recall and
    false-alarm share; where rows have approx, fabricated or flagged_no_c4, also approx accuracy, fabrication rate
    among the answered, and recall without reference checks."""
    n = F.count("*")
    flagged, wrong = F.count_if(F.col("flagged")), F.count_if(~F.col("strict"))
    caught = F.count_if(F.col("flagged") & ~F.col("strict"))
    given = F.col("answered") if "answered" in rows.columns else F.lit(True)
    silent = F.count_if(~F.col("strict") & ~F.col("flagged") & given)
    more = []
    if "approx" in rows.columns:
        more.append((F.count_if("approx") / n).alias("approx_accuracy"))
    if "fabricated" in rows.columns:
        more.append(F.try_divide(F.count_if(F.col("fabricated") & given), F.count_if(given)).alias("fabrication_rate"))
    if "flagged_no_c4" in rows.columns:
        more.append(F.try_divide(F.count_if(F.col("flagged_no_c4") & ~F.col("strict")), wrong).alias("flag_recall_no_c4"))
    return rows.groupBy(*by).agg(
        n.alias("n"), (F.count_if("strict") / n).alias("strict_accuracy"), silent.alias("silent"), (flagged / n).alias("workload"),
        F.try_divide(caught, wrong).alias("flag_recall"), F.try_divide(flagged - caught, flagged).alias("false_alarms"), *more,
    )


def bootstrap(rows: DataFrame, cluster: str, times: int = 1000) -> DataFrame:
    """EVA11: (lo, hi) of the strict share over ``times`` resamples of whole clusters, as many as there are.

    Clusters are numbered by name. Draw k of resample r is a digest of both, so draws are independent of each other,
    the same on any machine, and made where they are used; only sums per cluster and resample are shuffled. Empty rows
    give nulls.
    """
    own = rows.groupBy(cluster).agg(F.count_if("strict").alias("good"), F.count("*").alias("all"))
    own = materialise(numbered(own, cluster), "clusters")
    n = own.count()
    draws = own.select(F.col("at").alias("k")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "r", "k").cast("binary")), 1, 12), 16, 10).cast("long")
    drawn = draws.groupBy("r", F.pmod(digest, F.lit(max(n, 1))).alias("at")).agg(F.count("*").alias("times"))
    shares = drawn.join(own, "at").groupBy("r").agg((F.sum(F.col("good") * F.col("times")) / F.sum(F.col("all") * F.col("times"))).alias("share"))
    sorted_ = F.array_sort(F.collect_list("share"))
    return shares.agg(F.try_element_at(sorted_, F.lit(int(0.025 * times) + 1)).alias("lo"), F.try_element_at(sorted_, F.lit(int(0.975 * times))).alias("hi"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in this order (nulls first): ranges are sorted apart and follow each other."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(ranges, order).sortWithinPartitions(order)
    placed = materialise(sorted_.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ranges")
    # as many rows as ranges
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = sizes.select(F.col("part").alias("b"), F.col("n").alias("m"))
    skips = sizes.join(F.broadcast(before), F.col("b") < F.col("part"), "left").groupBy("part", "first").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("skip"))
    return placed.join(F.broadcast(skips), "part").withColumn("at", F.col("place") - F.col("first") + F.col("skip")).drop("part", "place", "first", "skip")


def upper_medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """EVA12: (by, median): element n // 2 of each group's sorted values that aren't null.

    Counts of distinct values are dealt by ranges; running sums over ranges tell the one that holds the element, and
    only its values are ordered, so no group is gathered in an array or a task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    counts = materialise(counts.repartitionByRange("by", "value").withColumn("part", F.spark_partition_id()), "value-counts")
    sums, whole = counts.groupBy("by", "part").agg(F.sum("n").alias("own")), Window.partitionBy("by")
    sums = sums.withColumn("before", F.sum("own").over(whole.orderBy("part")) - F.col("own")).withColumn("rank", F.floor(F.sum("own").over(whole) / 2))
    hit = sums.where("before <= rank AND rank < before + own").select(F.col("by").alias("by2"), F.col("part").alias("part2"), "before", "rank")
    near = counts.join(F.broadcast(hit), F.col("by").eqNullSafe(F.col("by2")) & (F.col("part") == F.col("part2")))
    upto = F.sum("n").over(Window.partitionBy("by").orderBy("value")) + F.col("before")
    return near.withColumn("upto", upto).where("upto > rank").groupBy(F.col("by").alias(by)).agg(F.min("value").alias("median"))


def stability(rows: DataFrame, runs: int) -> DataFrame:
    """EVA17: over keys in every run: how many agree in all values, and how many flip between right and wrong."""
    per = rows.groupBy("key").agg(F.count_distinct("run").alias("runs"), F.count_distinct("value").alias("values"), F.count_distinct("strict").alias("verdicts")).where(F.col("runs") == runs)
    return per.agg(F.count("*").alias("keys"), F.count_if(F.col("values") == 1).alias("agree"), F.count_if(F.col("verdicts") > 1).alias("flips"))


def disputes(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """EVA15: keys where two tiers or more agree, within the truth's tolerance, on a value that isn't the truth; the
    first such value by tier. votes: key, tier, value; truth: key, truth, tol."""
    own = votes.where("value IS NOT NULL").join(truth, "key")
    other = votes.select("key", F.col("tier").alias("t2"), F.col("value").alias("v2"))
    both = own.join(other, "key").where((F.abs(F.col("value") - F.col("v2")) <= F.col("tol")) & (F.abs(F.col("value") - F.col("truth")) > F.col("tol")))
    return both.groupBy("key", "tier", "value").agg(F.count_distinct("t2").alias("votes")).where("votes >= 2").groupBy("key").agg(F.min_by("value", "tier").alias("value"), F.max("votes").alias("votes"))


def merged_candidates(rows: DataFrame) -> DataFrame:
    """EVA24: per key, values in clusters whose neighbours differ by at most 1e-9 of them; (key, value, votes)."""
    w = Window.partitionBy("key").orderBy("value")
    gap = F.col("value") - F.lag("value").over(w) > 1e-9 * F.abs("value")
    cluster = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w)
    return rows.withColumn("cluster", cluster).groupBy("key", "cluster").agg(F.min("value").alias("value"), F.count("*").alias("votes")).drop("cluster")


def stratified(entities: DataFrame, k: int, seed: int) -> DataFrame:
    """SMP1 and SMP2: per market k entities: strata in seeded order, a seeded member of each in turn, no repeats.

    entities: market, stratum, entity (long). Order is by an integer hash, the same in any engine.
    """
    h = lambda c: (c * 48271 + seed * 7919) % 2147483647
    turn = F.row_number().over(Window.partitionBy("market", "stratum").orderBy(h(F.col("entity")), "entity"))
    ranked = entities.withColumn("turn", turn)
    nth = F.row_number().over(Window.partitionBy("market").orderBy("turn", h(F.col("stratum")), "stratum"))
    return ranked.withColumn("nth", nth).where(F.col("nth") <= k).select("market", "stratum", "entity", "nth")


def manifest_diff(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """GOV1: paths of ``frozen`` (path, sha256) that changed or vanished."""
    now = current.select("path", F.col("sha256").alias("now"))
    return frozen.join(now, "path", "left").where("now IS NULL OR now <> sha256").select("path", F.when(F.col("now").isNull(), "vanished").otherwise("changed").alias("what"))


# The other script, what kind of file a path is, and how its comments begin.
CJK = r"[\u3000-\u303f\u3400-\u9fff\uf900-\ufaff\uff00-\uffef]"
CJK_TEXT = r"[\u3000-\u303f\u3400-\u9fff\uff00-\uffef]"
READER = r"(?:\.md|\.txt|LICENSE|\.example)$"
COMMENTS = {"py": "#", "yml": "#", "yaml": "#", "toml": "#", "sh": "#", "js": "//", "css": "/*", "html": "<!--"}


def script_lines(files: DataFrame) -> DataFrame:
    """AUD1: (path, kind, n_lines, n_foreign, n_comments) of files (path, text) that have lines in the other script.

    kind: reader (for people), code or data; of code, comment lines are counted apart (null otherwise). Paths under
    data/ and null texts are left out.
    """
    lines = files.where("text IS NOT NULL AND NOT startswith(path, 'data/')").select("path", F.explode(F.split("text", "\n")).alias("line"))
    ending = F.regexp_extract("path", r"\.([^./]*)$", 1)
    kind = F.when(F.col("path").rlike(READER), "reader").when(ending.isin(*COMMENTS), "code").otherwise("data")
    mark = F.coalesce(*[F.when(ending == e, m) for e, m in COMMENTS.items()])
    bare = F.regexp_replace("line", r"(?U)^\s+", "")
    comment = F.coalesce(F.startswith(bare, mark), F.lit(False)) | bare.rlike("^(?:\"{3}|'{3}|[*])")
    foreign = F.col("line").rlike(CJK)
    told = lines.groupBy("path", kind.alias("kind")).agg(F.count("*").alias("n_lines"), F.count_if(foreign).alias("n_foreign"), F.count_if(foreign & comment).alias("n_comments"))
    return told.where("n_foreign > 0").withColumn("n_comments", F.when(F.col("kind") == "code", F.col("n_comments")))


def foreign_texts(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """AUD1: distinct (lang, text, words) of texts (lang, text) in the other script than their language's.

    English texts (lang en) with a character of the other script (words null); of other texts those with Latin words,
    sorted, but for allowed ones (a table of ``word``, in any case), single letters, all capitals and names with digits,
    hyphens or underscores.
    """
    own = texts.where("text IS NOT NULL").select("lang", "text").distinct()
    english = own.where((F.col("lang") == "en") & F.col("text").rlike(CJK_TEXT)).withColumn("words", F.lit(None).cast("string"))
    words = own.where("lang <> 'en'").select("lang", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z_'\-]*"), F.lit(0)))).alias("word"))
    odd = words.where((F.length("word") > 1) & (F.col("word") != F.upper("word")) & ~F.col("word").rlike(r"[\d\-_]")).withColumn("low", F.lower("word"))
    odd = odd.join(allowed.select(F.lower("word").alias("low")).distinct(), "low", "left_anti")
    return english.unionByName(odd.groupBy("lang", "text").agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("words")))


def revised(log: DataFrame, changes: DataFrame, reason: str, at: str) -> DataFrame:
    """GOV2: the revision log (at, reason, changed) with one more row that lists the changed paths; none if nothing did."""
    new = changes.agg(F.array_sort(F.collect_list("path")).alias("changed")).where(F.size("changed") > 0)
    return log.select("at", "reason", "changed").unionByName(new.select(F.lit(at).alias("at"), F.lit(reason).alias("reason"), "changed"))


def unanswered(asked: DataFrame, done: DataFrame) -> DataFrame:
    """EVA14: asked items (doc_id, field, period_type) that have no row in ``done`` yet; distinct."""
    key = ["doc_id", "field", "period_type"]
    return asked.select(*key).distinct().join(done.select(*key), key, "left_anti")


def errors(rows: DataFrame) -> DataFrame:
    """EVA22: rows that aren't strictly right, as report, cell, field, ptype, truth, pred, and state (status and category)."""
    state = F.coalesce(F.nullif(F.concat_ws(" ", "status", "category"), F.lit("")), F.lit("-"))
    return rows.where("NOT strict").select("report", "cell", "field", "ptype", "truth", "pred", state.alias("state"))


def run_summary(items: DataFrame, calls: DataFrame) -> DataFrame:
    """EVA28: ok, found, bad, input, cached, output, usd per document, and in total (doc_id null)."""
    marks, sums = {"ok": "OK", "found": "FOUND", "bad": "BAD"}, ("input", "cached", "output", "usd")
    none = lambda c: F.lit(0).cast("double" if c == "usd" else "long").alias(c)
    one = items.select("doc_id", *[(F.col("status") == s).cast("long").alias(c) for c, s in marks.items()], *map(none, sums))
    two = calls.select("doc_id", *map(none, marks), *[F.coalesce(F.col(c).cast("double" if c == "usd" else "long"), none(c)).alias(c) for c in sums])
    return one.unionByName(two).rollup("doc_id").agg(*[F.sum(c).alias(c) for c in (*marks, *sums)])


def coverage(docs: DataFrame) -> DataFrame:
    """EVA29: market, dimension (template, currency, result), part and how many of the market's documents: documents by
    template and currency, and those with a loss."""
    loss = F.when(F.col("net_income") < 0, "loss").when(F.col("net_income").isNotNull(), "profit").otherwise("unknown")
    parts = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("part")) for d, c in (("template", F.col("template")), ("currency", F.coalesce("currency", F.lit("unknown"))), ("result", loss))])
    return docs.select("market", F.explode(parts).alias("g")).groupBy("market", "g.dimension", "g.part").agg(F.count("*").alias("n"))
