"""Answer keys, scoring against them, and review tables (EVA1, EVA2, EVA6-EVA8, EVA10, EVA13, EVA16, EVA21, EVA23,
EVA24, EVA26, EVA27, EVA30). Numbers printed in documents are looked up by equi-joins with (doc_id, number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import digits_of, to_value

# Scales in which numbers are printed, and fields printed per share.
SCALES = [1.0, 1e3, 1e4, 1e6, 1e8, 1e9]
PER_SHARE = ["eps_basic"]


def renderings(value: Column, field: Column) -> Column:
    """EVA1: array of struct(text, half_unit) of a value at each scale and number of decimals that shows enough digits:
    four (any scale, up to three decimals), or two of per-share figures (as they are, up to four decimals)."""
    out = []
    per = F.coalesce(field.isin(PER_SHARE), F.lit(False))
    for scale in SCALES:
        for decimals in range(5 if scale == 1 else 4):
            text = F.replace(F.format_number(F.abs(value) / scale, decimals), F.lit(","))
            shown = F.length(F.regexp_replace(F.replace(text, F.lit(".")), "^0+", ""))
            ok = F.when(per, F.lit(scale == 1) & (shown >= 2)).otherwise(F.lit(decimals < 4) & (shown >= 4))
            out.append(F.when(ok, F.struct(text.alias("text"), F.lit(0.5 * 10.0**-decimals * scale).alias("half_unit"))))
    return F.array_compact(F.array(*out))


def printed(values: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """EVA1: keys with half_unit (the largest of its renderings in the document) and printed_as, where there is any.

    values: doc_id, field, value and the keys; numbers: doc_id, number.
    """
    shown = values.where("value IS NOT NULL").select("doc_id", *[k for k in keys if k != "doc_id"], F.explode(renderings(F.col("value"), F.col("field"))).alias("r"))
    hit = shown.join(numbers.select("doc_id", F.col("number").alias("text")).distinct(), (F.col("r.text") == F.col("text")) & (shown["doc_id"] == numbers["doc_id"])).drop(numbers["doc_id"])
    return hit.groupBy(*keys).agg(F.max("r.half_unit").alias("half_unit"), F.array_sort(F.collect_set("text")).alias("printed_as"))


KEY = ["doc_id", "field", "period_type"]


def answer_key(docs: DataFrame, facts: DataFrame, manual: DataFrame, numbers: DataFrame) -> DataFrame:
    """EVA2: doc_id, field, period_type, truth, currency, tol, source.

    Facts of the document's fields and end month count for markets us and a, the first by ord; a manual row (raw_value,
    raw_unit, raw_currency, tol, na) replaces them, ``na`` removes the item. tol is the manual one, else half a unit of
    the manual number, else the largest printed half unit, else 5e-6 of the truth.
    """
    auto = facts.join(docs.where("market IN ('us', 'a')").select("doc_id", "fields", F.col("period_end").alias("doc_end")), "doc_id").where("array_contains(fields, field)")
    auto = auto.where(F.date_format("period_end", "yyyy-MM") == F.date_format("doc_end", "yyyy-MM")).groupBy(*KEY).agg(F.min_by("value", "ord").alias("auto"), F.min_by("currency", "ord").alias("auto_currency"))
    given = to_value(manual.join(docs.select("doc_id", "market"), "doc_id")).select(*KEY, F.col("value").alias("own"), "raw_currency", F.coalesce("tol", "tolerance").alias("own_tol"), F.coalesce("na", F.lit(False)).alias("na"), F.lit(True).alias("manual"))
    both = auto.join(given, KEY, "full").where("NOT coalesce(na, false)").withColumn("manual", F.coalesce("manual", F.lit(False)))
    key = both.select(*KEY, F.when(F.col("manual"), F.col("own")).otherwise(F.col("auto")).alias("truth"), F.when(F.col("manual"), F.col("raw_currency")).otherwise(F.col("auto_currency")).alias("currency"), F.when(F.col("manual"), F.col("own_tol")).alias("tol"), F.when(F.col("manual"), "manual").otherwise("automatic").alias("source"))
    seen = printed(key.withColumnRenamed("truth", "value"), numbers, KEY)
    return key.join(seen.drop("printed_as"), KEY, "left").withColumn("tol", F.coalesce("tol", "half_unit", 5e-6 * F.abs("truth"))).drop("half_unit")


def scores(key: DataFrame, preds: DataFrame, numbers: DataFrame) -> DataFrame:
    """EVA6 and EVA7: the key's rows with answered, conflict (currencies differ), strict, approx (within 1 %) and
    fabricated: not even nearly right, and in no way printed in the document. preds: the key's columns, value,
    currency, raw_value."""
    both = key.join(preds.select(*KEY, "value", F.col("currency").alias("pred_currency"), "raw_value"), KEY, "left")
    gap, size = F.abs(F.col("value") - F.col("truth")), F.abs("truth")
    conflict = F.coalesce(F.col("value").isNotNull() & (F.col("currency") != F.col("pred_currency")) & (F.col("currency") != "") & (F.col("pred_currency") != ""), F.lit(False))
    out = both.withColumn("answered", F.col("value").isNotNull()).withColumn("conflict", conflict)
    out = out.withColumn("strict", F.coalesce(~conflict & (gap <= F.col("tol") + 1e-9 * size), F.lit(False))).withColumn("approx", F.coalesce(~conflict & (gap <= 0.01 * size), F.lit(False)))
    asked = out.where("answered AND NOT approx")
    plain = [F.when(F.abs("value") / s >= 100, F.replace(F.format_number(F.abs("value") / s, d), F.lit(","))) for s in SCALES for d in range(3)]
    texts = F.array_compact(F.array_union(F.transform(renderings(F.col("value"), F.col("field")), lambda r: r["text"]), F.array(digits_of(F.col("raw_value")), *plain)))
    shown = asked.select(*KEY, F.explode(texts).alias("number")).join(numbers.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")
    found = shown.select(*KEY, F.lit(True).alias("found")).distinct()
    return out.join(found, KEY, "left").withColumn("fabricated", F.col("answered") & ~F.col("approx") & F.col("found").isNull()).drop("found")


def breakdown(rows: DataFrame, by: list[str], summary) -> DataFrame:
    """EVA10: ``summary`` (of rows and columns) of each value of each of the columns: (dimension, part, ...)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("part")) for c in by])).alias("g")
    return summary(rows.select("*", parts).select("*", "g.dimension", "g.part"), ["dimension", "part"])


def item_set(expected: DataFrame, key: DataFrame, answered: DataFrame, optional: list[str]) -> DataFrame:
    """EVA13: expected and key items, and optional fields that a base tier answered for the document's cumulative type,
    or for Q where the field or revenue has a Q item. All: doc_id, field, period_type; cumulative: the first type but Q."""
    own = expected.select(*KEY).unionByName(key.select(*KEY)).distinct()
    whole = own.where("period_type <> 'Q'").groupBy("doc_id").agg(F.min("period_type").alias("cumulative"))
    quarters = own.where("period_type = 'Q'").select("doc_id", F.col("field").alias("q_field")).distinct()
    extra = answered.where(F.col("field").isin(optional)).select(*KEY).distinct().join(whole, "doc_id", "left")
    quarterly = extra.where("period_type = 'Q'").join(quarters, "doc_id").where("q_field = field OR q_field = 'revenue'").select(*KEY)
    return own.unionByName(extra.where("period_type = cumulative AND period_type <> 'Q'").select(*KEY)).unionByName(quarterly).distinct()


def adjusted(rows: DataFrame, disputes: DataFrame, numbers: DataFrame) -> DataFrame:
    """EVA16: (cell, n, strict) where disputes (key columns, truth, majority) whose truth isn't printed in the document,
    but whose majority value is, count by the majority value. rows: cell, key columns, value, strict, tol."""
    seen = lambda c: printed(disputes.select(*KEY, F.col(c).alias("value")), numbers, KEY).select(*KEY)
    own = disputes.join(seen("truth"), KEY, "left_anti").join(seen("majority"), KEY, "left_semi").select(*KEY, "majority")
    both = rows.join(own, KEY, "left")
    right = F.when(F.col("majority").isNull(), F.col("strict")).otherwise(F.coalesce(F.abs(F.col("value") - F.col("majority")) <= F.col("tol") + 1e-9 * F.abs("majority"), F.lit(False)))
    return both.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(right).alias("strict"))


def not_applicable(manual: DataFrame, preds: DataFrame, tiers: list[str]) -> DataFrame:
    """EVA21: items marked na, with what each tier answered: columns <tier> (value) and <tier>_flagged; null where it
    gave none. preds: tier, key columns, value, flagged."""
    na = manual.where("na").select(*KEY).distinct()
    own = na.join(preds.where("value IS NOT NULL"), KEY, "left")
    return own.groupBy(*KEY).agg(*[x for t in tiers for x in (F.max(F.when(F.col("tier") == t, F.col("value"))).alias(t), F.max(F.when(F.col("tier") == t, F.col("flagged"))).alias(f"{t}_flagged"))])


def not_applicable_totals(matrix: DataFrame, tiers: list[str]) -> DataFrame:
    """EVA21: per tier how many of the items were asked, answered with a number, and flagged of these."""
    rows = matrix.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("value"), F.col(f"{t}_flagged").alias("flagged")) for t in tiers])).alias("r")).select("r.*")
    return rows.groupBy("tier").agg(F.count("*").alias("asked"), F.count("value").alias("gave"), F.count_if(F.col("value").isNotNull() & F.coalesce("flagged", F.lit(False))).alias("flagged"))


def candidates(verified: DataFrame, answers: DataFrame, key: DataFrame, facts: DataFrame, invalid: DataFrame, fields: list[str]) -> DataFrame:
    """EVA23: every source's values of an item: key columns, source, value, currency, label, raw.

    verified: key columns, value, currency, raw_value, raw_unit, derivation, components (array of sign, raw_value,
    raw_unit); a derived row's label shows its components, and its raw number is the first one's. Facts of documents in
    ``invalid`` (doc_id) don't count.
    """
    amount = lambda c: F.regexp_replace(c["raw_value"], r"^\(|\)$", "")
    minus = lambda c: F.coalesce(c["sign"], F.lit(1)) < 0
    shown = F.transform("components", lambda c, k: F.concat(F.when(k > 0, F.when(minus(c), "- ").otherwise("+ ")).when(minus(c), "- ").otherwise(""), amount(c)))
    first = F.try_element_at("components", F.lit(1))
    derived = F.coalesce((F.col("derivation") == "derived") & (F.size("components") > 0) & (F.coalesce("raw_value", F.lit("")) == ""), F.lit(False))
    label = F.when(derived, F.concat(F.lit("derived: "), F.array_join(shown, " "), F.lit(" "), F.coalesce(first["raw_unit"], F.lit("")))).otherwise(F.concat_ws(" ", "raw_value", F.coalesce("raw_unit", F.lit(""))))
    ours = verified.select(*KEY, F.lit("verified").alias("source"), "value", "currency", F.btrim(label).alias("label"), F.when(derived, first["raw_value"]).otherwise(F.col("raw_value")).alias("raw"))
    text = answers.select(*KEY, F.lit("answer").alias("source"), "value", "currency", F.btrim(F.concat_ws(" ", "raw_value", F.coalesce(F.nullif("raw_unit", F.lit("")), "raw_currency", F.lit("")))).alias("label"), F.col("raw_value").alias("raw"))
    none = F.lit(None).cast("string")
    keyed = key.select(*KEY, F.lit("key").alias("source"), F.col("truth").alias("value"), "currency", none.alias("label"), none.alias("raw"))
    other = facts.join(invalid.select("doc_id"), "doc_id", "left_anti").select(*KEY, F.lit("reference").alias("source"), "value", "currency", none.alias("label"), none.alias("raw"))
    return ours.unionByName(text).unionByName(keyed).unionByName(other).where(F.col("value").isNotNull() & F.col("field").isin(fields))


#: Sources in the order in which their candidates are taken; others follow by name.
ORDER = ["verified", "answer", "key", "reference"]


def merged(rows: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """EVA24: key columns, value, votes, label and raw of an item's candidates once those that are the same are one.

    Candidates are taken by source, value and raw. One is the same as the first of those already taken that is equal to
    it within 1e-9 (1e-6 at least), or that prints the same digits and is within 1 %; it then adds a vote, and its label
    and raw where that has none yet (so a later candidate may be the same by them). Value stays the first one's.
    Candidates that agree in all of this are counted before they meet, so an item holds as many rows as it has readings.
    """
    own = rows.groupBy(*KEY, "source", "value", "label", "raw").agg(F.count("*").alias("votes"))
    place = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col("source")), F.lit(0)), F.lit(len(order) + 1))
    one = F.struct(place.alias("place"), "source", F.col("value").cast("double").alias("value"), "raw", "label", digits_of(F.col("raw")).alias("digits"), "votes")
    items = own.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("taken"))
    none = F.array().cast("array<struct<value:double,raw:string,label:string,digits:string,votes:bigint>>")

    def same(m: Column, c: Column) -> Column:
        gap = F.abs(m["value"] - c["value"])
        digits = F.coalesce((m["raw"] != "") & (c["raw"] != "") & (m["digits"] == c["digits"]), F.lit(False))
        return (gap <= F.greatest(F.lit(1e-6), 1e-9 * F.abs(m["value"]))) | (digits & (gap <= 0.01 * F.abs(m["value"])))

    def either(m: Column, c: Column, name: str) -> Column:
        return F.coalesce(F.nullif(m[name], F.lit("")), c[name])

    def take(done: Column, c: Column) -> Column:
        at = F.array_position(F.transform(done, lambda m: same(m, c)), True)
        new = F.struct(c["value"].alias("value"), c["raw"].alias("raw"), c["label"].alias("label"), c["digits"].alias("digits"), c["votes"].alias("votes"))

        def voted(m: Column, k: Column) -> Column:
            more = F.struct(m["value"].alias("value"), either(m, c, "raw").alias("raw"), either(m, c, "label").alias("label"), either(m, c, "digits").alias("digits"), (m["votes"] + c["votes"]).alias("votes"))
            return F.when(k == at - 1, more).otherwise(m)

        return F.when(at > 0, F.transform(done, voted)).otherwise(F.concat(done, F.array(new)))

    return items.select(*KEY, F.inline(F.aggregate("taken", none, take))).drop("digits")


def review_order(candidates_: DataFrame, fields: list[str]) -> DataFrame:
    """EVA26: key columns, n (candidates), agree (one candidate with several votes) and place in the document: items that
    agree first, then in the fields' order."""
    items = candidates_.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("votes").alias("votes")).withColumn("agree", (F.col("n") == 1) & (F.col("votes") > 1)).drop("votes")
    at = F.coalesce(F.nullif(F.array_position(F.lit(fields), F.col("field")), F.lit(0)), F.lit(len(fields) + 1))
    return items.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(~F.col("agree"), at, "field", "period_type")))


def found_as(facts: DataFrame, tokens: DataFrame, scales: list[float] = SCALES, decimals: int = 3) -> DataFrame:
    """EVA27: facts (doc_id, ord, value) with found_as: the ways, with and without separators, in which the document's
    tokens (doc_id, token) show the value; longest first. Ways of under three digits don't count."""
    ways = []
    for s in scales:
        for d in range(decimals):
            text = F.format_number(F.abs("value") / s, d)
            ways += [F.when(F.length(F.regexp_replace(text, r"\D", "")) >= 3, x) for x in (text, F.replace(text, F.lit(",")))]
    shown = facts.select("doc_id", "ord", F.explode(F.array_distinct(F.array_compact(F.array(*ways)))).alias("token"))
    hit = shown.join(tokens.select("doc_id", "token").distinct(), ["doc_id", "token"], "left_semi").groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct(F.length("token").alias("n"), "token")), asc=False).alias("t"))
    return facts.join(hit, ["doc_id", "ord"], "left").withColumn("found_as", F.coalesce(F.transform("t", lambda x: x["token"]), F.array().cast("array<string>"))).drop("t")


def page_tokens(pages: DataFrame) -> DataFrame:
    """EVA27: (doc_id, token): whole numbers of pages as they are printed, with their separators."""
    return pages.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\d.,])\d[\d,]*(?:\.\d+)?(?!\d|[.,]\d)"), F.lit(0))).alias("token")).distinct()


def manual_rows(decisions: DataFrame, numbers: DataFrame) -> DataFrame:
    """EVA30: manual key rows of review decisions (pick, edit, na). decisions: key columns, decision, value, raw_value,
    raw_unit, currency, candidate, comment. A picked value is kept in plain units with its printed tolerance."""
    seen = printed(decisions.where("decision = 'pick'"), numbers, KEY)
    both = decisions.join(seen, KEY, "left")
    pick, edit = F.col("decision") == "pick", F.col("decision") == "edit"
    note = F.coalesce("comment", F.when(pick, F.concat(F.lit("candidate "), F.col("candidate").cast("string"))))
    plain = F.regexp_replace(F.regexp_replace(F.col("value").cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return both.select(
        *KEY, "decision", (F.col("decision") == "na").alias("na"), F.when(pick, plain).when(edit, F.col("raw_value")).alias("raw_value"), F.when(pick, "元").when(edit, F.col("raw_unit")).alias("raw_unit"),
        F.when(pick | edit, F.col("currency")).alias("raw_currency"), F.when(pick, F.coalesce("half_unit", 5e-6 * F.abs("value"))).alias("tol"), F.when(pick, F.coalesce("printed_as", F.array().cast("array<string>"))).alias("printed_as"), note.alias("note"),
    )
