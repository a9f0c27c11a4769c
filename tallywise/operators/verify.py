"""Checks of claimed numbers against pages and reference facts, for all documents at once (VER1-VER30).

Tables: claims (doc_id, seq, field, raw_value, raw_unit, raw_currency, period_type, period_start, period_end, page,
quote, ...), pages (doc_id, page, text), facts (doc_id, ord, field, period_type, period_end, value, currency).
Joins are on (doc_id, page) or (doc_id, field); what can't be told from equality is a filter on top of such a join.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import cumulative_type, period_part, type_from_days
from ..functions.text import for_match, for_numbers, number_tokens
from ..functions.units import digits_of, to_value
from ..sources.store import materialise

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

MIN_PIECE, MAX_PIECES, FUZZY = 4, 3, 0.90
# Fields a complete filing states, by template.
REQUIRED = {
    "general": ["revenue", "net_income_parent", "eps_basic", "operating_cash_flow"],
    "bank": ["revenue", "net_income_parent", "eps_basic", "operating_cash_flow", "net_interest_income", "ppop"],
    "insurance": ["revenue", "net_income_parent", "eps_basic", "operating_cash_flow"],
}
CORE = {
    "general": ["revenue", "net_income_parent", "eps_basic", "gross_profit", "operating_cash_flow"],
    "bank": ["revenue", "net_income_parent", "eps_basic", "operating_cash_flow", "net_interest_income", "ppop"],
    "insurance": ["revenue", "net_income_parent", "eps_basic", "operating_cash_flow", "insurance_revenue", "insurance_service_result"],
}
FLOWS = ["revenue", "net_income_parent", "eps_basic"]
PER_SHARE_FIELDS = ["eps_basic", "eps_basic_per_ads"]


def close(a: Column, b: Column, tolerance: Column) -> Column:
    """VER19."""
    return F.abs(a - b) <= tolerance + 1e-9 * F.abs(b)


def normalise_periods(claims: DataFrame) -> DataFrame:
    """VER1: the type is recomputed from start and end days and a change is noted; a point in time has no start."""
    start, end = F.col("period_start").try_cast("date"), F.col("period_end").try_cast("date")
    computed = type_from_days(F.datediff(end, start) + 1)
    new = F.when((F.col("period_type") != "PIT") & computed.isNotNull(), computed).otherwise(F.col("period_type"))
    note = F.when(new != F.col("period_type"), F.concat(F.lit("period "), "period_type", F.lit(" -> "), new))
    return claims.withColumn("period_note", note).withColumn("period_type", new).withColumn("period_start", F.when(F.col("period_type") == "PIT", None).otherwise(F.col("period_start")))


def same_end(a: Column, b: Column, days: int = 7) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(False))


def inside_period(claims: DataFrame) -> DataFrame:
    """VER2: the claims that end when their document does."""
    return claims.where(same_end(F.col("period_end").try_cast("date"), F.col("doc_end")))


def dedup(claims: DataFrame) -> DataFrame:
    """VER2 and VER3: adds ``dropped``: null for the first claim of a (doc, field, period type) at the document's end,
    else 'period' or 'duplicate'. Input order is ``seq``."""
    inside = same_end(F.col("period_end").try_cast("date"), F.col("doc_end"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "field", "period_type", "inside").orderBy("seq"))
    out = claims.withColumn("inside", inside)
    return out.withColumn("dropped", F.when(~F.col("inside"), "period").when(nth > 1, "duplicate")).drop("inside")


# Currency signs, which don't count in quotes and on pages.
SIGNS = r"(?:us|hk|nt|a|c|s)?\$|[¥￥€£]"


def match_form(c: Column) -> Column:
    """The form in which quotes and pages are compared: FN2 without currency signs."""
    return F.regexp_replace(for_match(c), SIGNS, "")


def prepared_pages(pages: DataFrame) -> DataFrame:
    """match_text, number_text and the strict numbers of each page; materialise at ingest."""
    return pages.withColumn("match_text", match_form(F.col("text"))).withColumn("number_text", for_numbers(F.col("text"))).withColumn("numbers", number_tokens(for_numbers(F.col("text"))))


def tried_pages(claims: DataFrame) -> DataFrame:
    """VER7: the claimed page, the one before and the one after, in that order (pos)."""
    return claims.select("*", F.posexplode(F.array(F.col("page"), F.col("page") - 1, F.col("page") + 1)).alias("pos", "try_page"))


def exact_quotes(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """VER4 and VER7: (doc_id, seq, page_used) of the first tried page that holds the quote verbatim."""
    return _verbatim(claims.select("doc_id", "seq", "page", match_form(F.col("quote")).alias("q")), pages)


def _verbatim(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """exact_quotes of quotes in match form (doc_id, seq, page, q)."""
    tried = tried_pages(asked.where("q <> ''"))
    on = pages.select("doc_id", F.col("page").alias("try_page"), "match_text")
    hit = tried.join(on, ["doc_id", "try_page"]).where(F.contains("match_text", "q"))
    return hit.groupBy("doc_id", "seq").agg(F.min_by("try_page", "pos").alias("page_used"))


def in_pieces(q: str, t: str) -> bool:
    """VER5: whether q is at most MAX_PIECES stretches of t, each of MIN_PIECE characters or more, taken greedily."""
    for _ in range(MAX_PIECES):
        size = next((n for n in range(len(q), MIN_PIECE - 1, -1) if q[:n] in t), 0)
        if not size:
            return False
        q = q[size:]
        if not q:
            return True
    return False


def likeness(q: str, t: str) -> float:
    """VER6: best ratio of q with a window of t of its length: a coarse walk by upper bounds, refined around the best.

    0 where no window can reach FUZZY."""
    if not q or not t:
        return 0.0
    if q in t:
        return 1.0
    matcher, n = SequenceMatcher(None, autojunk=False), len(q)
    if n >= len(t):
        matcher.set_seqs(q, t)
        return matcher.ratio() if matcher.real_quick_ratio() >= FUZZY and matcher.quick_ratio() >= FUZZY else 0.0
    matcher.set_seq1(q)
    step, last = max(1, n // 8), len(t) - n
    # the multiset bound of every coarse window at once; a window between two shares all but a step with one of them
    at = np.arange(0, last + 1, step)
    codes, bound = np.frombuffer(t.encode("utf-32-le"), np.uint32), np.zeros(len(at))
    for c in set(q):
        places = np.flatnonzero(codes == ord(c))
        bound += np.minimum(np.searchsorted(places, at + n) - np.searchsorted(places, at), q.count(c)) / n
    if bound.max() + step / n < FUZZY:
        return 0.0
    middle = int(at[bound.argmax()])

    def ratio(i: int) -> float:
        matcher.set_seq2(t[i : i + n])
        return matcher.ratio()

    return max(map(ratio, range(max(0, middle - step), min(last, middle + step) + 1)))


@F.pandas_udf(T.DoubleType())
def quote_ratio(q: pd.Series, t: pd.Series) -> pd.Series:
    """VER4-VER6 for a quote and a page, both in match form: 1, 0.99 for pieces, or the fuzzy ratio."""
    return pd.Series([1.0 if a and a in b else 0.99 if a and in_pieces(a, b) else likeness(a, b) for a, b in zip(q.fillna(""), t.fillna(""), strict=True)])


#: Length of the grams by which lost quotes and pages meet.
GRAM = 3


def grams(text: Column) -> Column:
    """All stretches of GRAM characters, one from each place."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def needed_grams(n: Column) -> Column:
    """Of how many places of a stretch of n characters of a page, at least, the grams are a quote's of n characters where
    the quote can be found there (VER4-VER6).

    A ratio of 0.9 with a window of n characters leaves n / 10 characters unmatched on either side, so the rest is in at
    most n / 5 + 1 stretches, each of which loses two grams: 0.9 n - 2 (0.2 n + 1). A whole page shorter than the quote
    matches in 0.81 n characters at least and as many stretches. Of three pieces one has n / 3 characters at least.
    """
    return F.greatest(F.lit(1), F.ceil(n / 3) - 2)


def may_be_alike(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """VER6: ``quotes`` (doc_id, seq, q and more) with those pages (doc_id, try_page, match_text) of their document of
    which some stretch shares enough grams with them; no page on which a quote is found is lost.

    Quotes and pages meet by an equi-join of their grams. Places are counted by stretches of the quote's length, since
    any window lies in two neighbouring ones. A quote shorter than a gram only comes with pages that hold it.
    """
    asked = materialise(quotes.where(F.length("q") >= GRAM), "lost-quotes")
    on = pages.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    held = on.select("doc_id", "try_page", F.posexplode(grams(F.col("match_text"))).alias("at", "gram"))
    places = asked.select("doc_id", "seq", F.length("q").alias("n"), F.explode(F.array_distinct(grams(F.col("q")))).alias("gram"))
    pair = ["doc_id", "seq", "try_page", "n"]
    met = held.join(places, ["doc_id", "gram"]).groupBy(*pair, F.floor(F.col("at") / F.col("n")).alias("stretch")).agg(F.count("*").alias("places"))
    met = met.select(*pair, "places", F.explode(F.array(F.col("stretch"), F.col("stretch") - 1)).alias("stretch")).groupBy(*pair, "stretch").agg(F.sum("places").alias("places"))
    near = met.where(F.col("places") >= needed_grams(F.col("n"))).select("doc_id", "seq", "try_page").distinct()
    kept = asked.join(near, ["doc_id", "seq"]).join(pages, ["doc_id", "try_page"])
    short = quotes.where(F.length("q") < GRAM).join(pages, "doc_id").where(F.contains("match_text", "q"))
    return kept.unionByName(short)


def check_quotes(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """C1 (VER4-VER8): adds c1, page_used, quote_ratio, page_off and other_pages.

    Exact matches are found by a join alone; only quotes without one go on to pieces and likeness on the tried pages,
    and only those that still fail are compared with those of the document's other pages that share enough grams.
    """
    asked = materialise(claims.select("doc_id", "seq", "page", match_form(F.col("quote")).alias("q")).where("q <> ''"), "quotes")
    exact = materialise(_verbatim(asked, pages), "exact-quotes")
    rest = materialise(asked.join(exact.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti"), "other-quotes")
    on = pages.select("doc_id", F.col("page").alias("try_page"), "match_text")
    near = tried_pages(rest).join(on, ["doc_id", "try_page"]).withColumn("ratio", quote_ratio("q", "match_text")).where(F.col("ratio") >= FUZZY)
    near = near.groupBy("doc_id", "seq").agg(F.min_by("try_page", "pos").alias("page_used"), F.min_by("ratio", "pos").alias("ratio"))
    near = materialise(near, "near-quotes")
    lost = rest.join(near.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti")
    far = may_be_alike(lost, on).where(F.abs(F.col("try_page") - F.col("page")) > 1).where(quote_ratio("q", "match_text") >= FUZZY)
    far = far.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_set("try_page")).alias("other_pages"))
    found = exact.withColumn("ratio", F.lit(1.0)).unionByName(near)
    out = claims.join(found, ["doc_id", "seq"], "left").join(far, ["doc_id", "seq"], "left")
    return out.withColumn("c1", F.col("ratio").isNotNull()).withColumn("quote_ratio", F.col("ratio")).withColumn("page_off", F.coalesce(F.col("page_used") != F.col("page"), F.lit(False))).drop("ratio")


def number_index(pages: DataFrame) -> DataFrame:
    """(doc_id, page, number), distinct: where each strict number token stands."""
    return pages.select("doc_id", "page", F.explode(F.array_distinct("numbers")).alias("number"))


#: Characters of quotes that are sent out at once; more take further passes over the documents.
QUOTE_BLOCK = 8_000_000


def passages_found(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_found, n): how many pairs of a document and a quote (both: text, in match form) have the quote in the
    document. The stated quotes go out in blocks, as one automaton each, through which every document passes once;
    only counts come back, and misses are what is left of all pairs."""
    spark = docs.sparkSession
    sized = quotes.where("text IS NOT NULL")
    total, n = sized.select(F.sum(F.length("text")), F.count("*")).first()
    blocks, out = -(-(total or 0) // QUOTE_BLOCK) or 1, None
    for k in range(blocks):
        own = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast({r.text: r.n for r in own.groupBy("text").agg(F.count("*").alias("n")).collect()})

        def run(batches, sent=sent):
            times = sent.value
            everywhere, words = times.get("", 0), {q: c for q, c in times.items() if q}
            machine = None
            if ahocorasick is not None and words:
                machine = ahocorasick.Automaton()
                for q in words:
                    machine.add_word(q, q)
                machine.make_automaton()
            for batch in batches:
                hits = 0
                for t in batch.column(0).to_pylist():
                    t = t or ""
                    found = {q for _, q in machine.iter(t)} if machine is not None else [q for q in words if q in t]
                    hits += everywhere + sum(words[q] for q in found)
                yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["hits", "docs"])

        part = docs.select("text").mapInArrow(run, "hits long, docs long")
        out = part if out is None else out.unionByName(part.withColumn("docs", F.lit(0).cast("long")))
    sums = out.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"))
    both = sums.select(F.explode(F.array(F.struct(F.lit(True).alias("quote_found"), F.col("hits").alias("n")), F.struct(F.lit(False).alias("quote_found"), (F.col("docs") * F.lit(n) - F.col("hits")).alias("n")))).alias("x"))
    return both.select("x.*").where("n > 0")


def check_numbers(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """C2 (VER9-VER11): adds c2, split (found only without white space) and number_pages (other pages).

    The page is the one C1 used, else the claimed one (columns page_used, page).
    """
    index = number_index(pages)
    asked = claims.withColumn("digits", digits_of(F.col("raw_value"))).withColumn("at", F.coalesce("page_used", "page"))
    here = index.select("doc_id", F.col("page").alias("at"), F.col("number").alias("digits"), F.lit(True).alias("here"))
    out = asked.join(here, ["doc_id", "at", "digits"], "left")
    away = asked.select("doc_id", "seq", "at", "digits").join(index.withColumnRenamed("number", "digits"), ["doc_id", "digits"]).where("page <> at")
    away = away.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_set("page")).alias("number_pages"))
    failed = out.where("here IS NULL AND digits IS NOT NULL").select("doc_id", "seq", "at", "digits")
    squashed = pages.select("doc_id", F.col("page").alias("at"), number_tokens(F.regexp_replace("number_text", r"(?U)\s+", "")).alias("tokens"))
    split = failed.join(squashed, ["doc_id", "at"]).where(F.array_contains("tokens", F.col("digits"))).select("doc_id", "seq", F.lit(True).alias("split"))
    out = out.join(away, ["doc_id", "seq"], "left").join(split, ["doc_id", "seq"], "left")
    return out.withColumn("c2", F.coalesce("here", F.lit(False))).withColumn("split", F.coalesce("split", F.lit(False))).drop("here")


def check_units(claims: DataFrame, cents_fail: bool = True) -> DataFrame:
    """C3 (VER12): adds value, mult, kind, tolerance, currency, c3.

    Money needs a currency (not ratios, share counts or industry metrics); a per-share figure's multiplier has to be 1,
    so cents convert but fail unless ``cents_fail`` is off.
    """
    per = F.col("field").isin(PER_SHARE_FIELDS)
    out = to_value(claims.withColumn("__per", per), per_share=F.col("__per"))
    free = (F.col("kind") == "ratio") | (F.col("field") == "weighted_avg_shares_basic") | F.col("field").startswith("industry:")
    ok = F.col("value").isNotNull() & (free | F.col("currency").isNotNull())
    if cents_fail:
        ok &= ~per | (F.col("mult") == 1)
    return out.withColumn("c3", F.coalesce(ok, F.lit(False))).drop("__per")


def categorise(checked: DataFrame) -> DataFrame:
    """VER13: category of what failed. A number found nowhere (or none at all) outdoes the rest; else the first check
    that failed names it: units, then a quote elsewhere, then a split number or one elsewhere, then the quote."""
    failed2 = ~F.col("c2") & (F.coalesce("raw_value", F.lit("")) != "")
    category = (
        F.when(failed2 & ~F.col("split") & F.col("number_pages").isNull(), "FABRICATED")
        .when(~F.col("c3"), "UNIT")
        .when(~F.col("c1") & F.col("other_pages").isNotNull(), "WRONG_PAGE")
        .when(failed2 & F.col("split"), "PARSE_ARTEFACT")
        .when(failed2, "WRONG_PAGE")
        .when(~F.col("c1"), "PARAPHRASED")
    )
    return checked.withColumn("category", category)


def eps_probe(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """VER16: (doc_id, unusable) for market hk: the first EPS claim with a usable reference tells if all were converted."""
    eps = claims.where("market = 'hk' AND field = 'eps_basic' AND c3 AND value <> 0")
    ref = facts.where("field = 'eps_basic'").groupBy("doc_id", "period_type").agg(F.min_by("value", "ord").alias("ref"))
    return eps.join(ref, ["doc_id", "period_type"]).where("ref <> 0").groupBy("doc_id").agg(F.min_by(F.abs(F.col("ref") / F.col("value") - 1) > 0.02, "seq").alias("unusable"))


def check_references(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """C4 (VER16-VER18): adds state (match, mismatch, none, invalid), ref_value, ref_ord, ref_category.

    A claim that fails C3 isn't compared. References agree in field, in end within seven days, in type, and in
    currency where both are known; the first by ord counts. Mismatches are classed by the field's other references.
    """
    ref = facts.select("doc_id", "field", F.col("ord").alias("r_ord"), F.col("period_type").alias("r_type"), F.col("period_end").alias("r_end"), F.col("value").alias("r_value"), F.col("currency").alias("r_currency"))
    pairs = claims.where("c3").select("doc_id", "seq", "field", "period_type", "period_end", "value", "tolerance", "currency").join(ref, ["doc_id", "field"])
    pairs = pairs.where(same_end(F.col("r_end"), F.col("period_end").try_cast("date"))).where("currency IS NULL OR r_currency IS NULL OR currency = r_currency")
    mine = F.col("r_type") == F.col("period_type")
    found = pairs.groupBy("doc_id", "seq").agg(
        F.min_by("r_value", F.when(mine, F.col("r_ord"))).alias("ref_value"),
        F.min(F.when(mine, F.col("r_ord"))).alias("ref_ord"),
        F.bool_or(~mine & close(F.col("value"), F.col("r_value"), F.col("tolerance"))).alias("other_type"),
    )
    out = claims.join(found, ["doc_id", "seq"], "left").join(eps_probe(claims, facts), "doc_id", "left")
    out = out.withColumn("ref_value", F.when(F.col("ref_ord").isNotNull(), F.col("ref_value")))
    good = close(F.col("value"), F.col("ref_value"), F.col("tolerance"))
    state = F.when(~F.col("c3") | F.col("ref_ord").isNull(), "none").when(F.coalesce("unusable", F.lit(False)), "invalid").when(good, "match").otherwise("mismatch")
    power = F.lit(False)
    for k in (3, 4, 6, 8, -3, -4, -6, -8):
        power |= close(F.col("value") * 10.0**k, F.col("ref_value"), F.abs("ref_value") * 1e-6 + F.col("tolerance") * 10.0**k)
    kind = F.when(F.col("other_type"), "PERIOD").when((F.col("ref_value") != 0) & power, "UNIT").otherwise("DEFINITION")
    out = out.withColumn("state", state)
    return out.withColumn("ref_category", F.when(F.col("state") == "mismatch", kind)).drop("other_type", "unusable")


def status(checked: DataFrame) -> DataFrame:
    """VER21: BAD unless C1, C2 and C3 hold and no reference disagrees; OK with a reference, FOUND without."""
    s = F.when(~(F.col("c1") & F.col("c2") & F.col("c3")) | (F.col("state") == "mismatch"), "BAD").when(F.col("state") == "match", "OK").otherwise("FOUND")
    return checked.withColumn("status", s).withColumn("category", F.coalesce("category", "ref_category"))


def verify(claims: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """The whole chain on claims that weren't dropped (VER1-VER21)."""
    return verify_kept(dedup(normalise_periods(claims)).where("dropped IS NULL").drop("dropped"), pages, facts)


def verify_kept(kept: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """VER4-VER21 on the first claim of each document, field and period type."""
    return status(check_references(on_pages(kept, pages), facts))


def on_pages(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """VER4-VER13: what a claim and its document's pages decide; references also depend on the document's other claims."""
    quoted = materialise(check_quotes(kept, pages), "quoted")
    return categorise(check_units(check_numbers(quoted, pages)))


def reclassify_parent(verified: DataFrame) -> DataFrame:
    """VER20: a parent figure's mismatch that the ordinary-shareholder claim explains is a matter of definition."""
    common = verified.where("field = 'net_income_common' AND value IS NOT NULL").groupBy("doc_id", "period_type").agg(F.min_by("value", "seq").alias("common"))
    out = verified.join(common, ["doc_id", "period_type"], "left")
    explained = (F.col("field") == "net_income_parent") & (F.col("state") == "mismatch") & close(F.col("common"), F.col("ref_value"), F.col("tolerance"))
    return out.withColumn("category", F.when(explained, "DEFINITION").otherwise(F.col("category"))).drop("common")


def derived_items(components: DataFrame) -> DataFrame:
    """VER14: per (doc_id, seq) of checked components (sign, value, tolerance, currency, c1, c2, c3): the sum of
    sign x |value|, summed tolerance, the currency if there is only one, and whether all pass."""
    return components.groupBy("doc_id", "seq").agg(
        F.sum(F.col("sign") * F.abs("value")).alias("value"),
        F.sum("tolerance").alias("tolerance"),
        F.when(F.count_distinct("currency") == 1, F.min("currency")).alias("currency"),
        *[F.bool_and(c).alias(c) for c in ("c1", "c2", "c3")],
    )


def derived_gross_profit(verified: DataFrame) -> DataFrame:
    """VER15: revenue - |cost| per period where a general filing states no gross profit; (doc_id, period_type, value, tolerance, cost_used)."""
    own = verified.where("template = 'general' AND value IS NOT NULL")
    sides = own.groupBy("doc_id", "period_type").agg(
        *[F.min_by(c, F.when(F.col("field") == f, F.col("seq"))).alias(f"{c}_{f}") for f in ("revenue", "cost_of_revenue") for c in ("value", "tolerance")],
        *[F.bool_or(F.col("field") == f).alias(f"has_{f}") for f in ("revenue", "cost_of_revenue", "gross_profit")],
    )
    got = sides.where("has_revenue AND has_cost_of_revenue AND NOT has_gross_profit")
    return got.select("doc_id", "period_type", (F.col("value_revenue") - F.abs("value_cost_of_revenue")).alias("value"), (F.col("tolerance_revenue") + F.col("tolerance_cost_of_revenue")).alias("tolerance"), F.col("value_cost_of_revenue").alias("cost_used"))


def _table(spark, mapping: dict[str, list[str]], names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, x) for k, xs in mapping.items() for x in xs], names))


def expected_pairs(verified: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """VER22: distinct (doc_id, field, period_type) that a complete extraction has. docs: doc_id, period, period_end, template."""
    spark = docs.sparkSession
    cum = docs.withColumn("cum", cumulative_type(period_part(F.col("period"))))
    required = cum.join(_table(spark, REQUIRED, "template string, field string"), "template").select("doc_id", "field", F.col("cum").alias("period_type"))
    core = facts.join(docs.select("doc_id", "template", F.col("period_end").alias("doc_end")), "doc_id").where(same_end(F.col("period_end"), F.col("doc_end"))).join(_table(spark, CORE, "template string, field string"), ["template", "field"])
    pages = verified.where("field = 'revenue' AND c2").groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("period_type", "at"))).alias("at"))
    both = cum.join(pages, "doc_id").where((F.col("cum") != "Q") & (F.element_at("at", F.lit("Q")) == F.element_at("at", F.col("cum"))))
    quarter = both.select("doc_id", F.explode(F.array(*map(F.lit, FLOWS))).alias("field"), F.lit("Q").alias("period_type"))
    return required.unionByName(core.select("doc_id", "field", "period_type")).unionByName(quarter).distinct()


def missing_rows(expected: DataFrame, verified: DataFrame, facts: DataFrame) -> DataFrame:
    """VER23: expected pairs without a claim, as BAD / MISSING rows with the first reference's value, if any."""
    lost = expected.join(verified.select("doc_id", "field", "period_type"), ["doc_id", "field", "period_type"], "left_anti")
    ref = facts.groupBy("doc_id", "field", "period_type").agg(F.min_by("value", "ord").alias("ref_value"))
    return lost.join(ref, ["doc_id", "field", "period_type"], "left").withColumn("status", F.lit("BAD")).withColumn("category", F.lit("MISSING"))


def industry_metrics(metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """VER24: C1-C3 only, so FOUND at best; the field is 'industry:' and the name."""
    named = metrics.withColumn("field", F.concat(F.lit("industry:"), "field"))
    checked = categorise(check_units(check_numbers(check_quotes(named, pages), pages)))
    return checked.withColumn("status", F.when(F.col("c1") & F.col("c2") & F.col("c3"), "FOUND").otherwise("BAD"))


def in_answer(raw: Column, answer: Column) -> Column:
    """VER25: whether the raw value's digits are a whole number of the answer's text."""
    return F.array_contains(number_tokens(for_numbers(answer)), digits_of(raw))


def predictions(parsed: DataFrame) -> DataFrame:
    """VER26: rows (…, status, raw_value, raw_unit, raw_currency, market, answer) with outcome and value.

    Outcomes: not_disclosed, not_answered and ambiguous as parsed; an answered number that isn't in the answer or
    can't be read is parser_error.
    """
    out = to_value(parsed.withColumn("__per", F.col("field").isin(PER_SHARE_FIELDS)), per_share=F.col("__per")).drop("__per")
    ok = in_answer(F.col("raw_value"), F.col("answer")) & F.col("value").isNotNull()
    outcome = F.when(F.col("status") != "answered", F.col("status")).when(F.coalesce(ok, F.lit(False)), "answered").otherwise("parser_error")
    return out.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "answered", F.col("value")))


def recomputed(claimed: DataFrame, parts: DataFrame) -> DataFrame:
    """VER28: derived answers whose components (VER14) sum to something else beyond both tolerances are BAD; the scored value stays."""
    own = parts.select("doc_id", "seq", F.col("value").alias("recomputed"), F.col("tolerance").alias("own_tolerance"))
    out = claimed.join(own, ["doc_id", "seq"], "left")
    off = F.coalesce(F.abs(F.col("value") - F.col("recomputed")) > F.col("tolerance") + F.col("own_tolerance") + 1e-9 * F.abs("value"), F.lit(False))
    return out.withColumn("status", F.when(off, "BAD").otherwise(F.col("status"))).drop("own_tolerance")


def mark_no_source(verified: DataFrame) -> DataFrame:
    """VER29: items without a page or a quote are BAD / NO_SOURCE, missing ones aside."""
    bare = ((F.coalesce("page", F.lit(0)) == 0) | (F.trim(F.coalesce("quote", F.lit(""))) == "")) & (F.coalesce("category", F.lit("")) != "MISSING")
    return verified.withColumn("status", F.when(bare, "BAD").otherwise(F.col("status"))).withColumn("category", F.when(bare, "NO_SOURCE").otherwise(F.col("category")))


def follow_up(first: DataFrame, second: DataFrame, asked: DataFrame) -> DataFrame:
    """VER30: claims of both rounds with ``round`` and ``seq`` in one order: second-round claims of pairs that were asked
    for, after all of the document's first round."""
    again = second.join(asked.select("doc_id", "field", "period_type").distinct(), ["doc_id", "field", "period_type"], "left_semi")
    last = first.groupBy("doc_id").agg(F.max("seq").alias("last"), F.min("seq").alias("least"))
    after = again.join(last, "doc_id", "left").join(again.groupBy("doc_id").agg(F.min("seq").alias("begin")), "doc_id")
    seq = F.when(F.col("last").isNull(), F.col("seq")).otherwise(F.col("seq") - F.col("begin") + F.col("last") + 1)
    after = after.withColumn("seq", seq.cast(first.schema["seq"].dataType)).drop("last", "least", "begin")
    return first.withColumn("round", F.lit(1)).unionByName(after.withColumn("round", F.lit(2)))


def verify_follow_up(stored: DataFrame, claims: DataFrame, asked: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """VER30: ``stored`` (the first round verified) after the second: only documents with second answers are verified
    again, all of their claims (of both rounds, from ``follow_up``) together; the others keep what they have.

    Adds ``note``: 'follow-up' where the pair was asked for and is there.
    """
    changed = materialise(claims.where("round = 2").select("doc_id").distinct(), "followed-up")
    again = verify(claims.join(changed, "doc_id", "left_semi"), pages.join(changed, "doc_id", "left_semi"), facts.join(changed, "doc_id", "left_semi"))
    kept = stored.join(changed, "doc_id", "left_anti").withColumn("round", F.lit(1))
    both = again.unionByName(kept, allowMissingColumns=True)
    pairs = asked.select("doc_id", "field", "period_type", F.lit("follow-up").alias("note")).distinct()
    return both.join(pairs, ["doc_id", "field", "period_type"], "left").withColumn("note", F.when(F.coalesce("category", F.lit("")) != "MISSING", F.col("note")))
