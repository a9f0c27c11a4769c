"""Replies, insight tables, checks of written points, triggers and cost projections (SRC8, INS, EVA, BUD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import change_words
from ..functions.text import for_numbers, number_tokens
from ..functions.units import digits_of

# Numbers as they are written, and wording that a point may not hold.
WRITTEN_NUMBER = r"\d[\d,]*(?:\.\d+)?"
BANNED = (
    r"(?i)建议|买入|卖出|增持|减持|持有|目标价|预计|预期|预测|有望|将会|看好|看空|强劲|亮眼|出色|优异|稳健|疲软|惨淡|超预期|不及预期|靓丽|喜人|"
    r"\b(?:buy|sell|hold|overweight|underweight|outperform|underperform|target price|recommend\w*|expect\w*|forecast\w*|predict\w*|outlook|will|likely|"
    r"should|strong\w*|robust|impressive|solid|weak\w*|disappoint\w*|beat|miss\w*|stellar|healthy|remarkabl\w*)\b"
)
MOST_POINTS = 5


def reply_items(replies: DataFrame, item: str) -> DataFrame:
    """SRC8: (doc_id, seq, item fields) of replies (doc_id, text): what stands from the first { to the last } is an
    object with ``items``; fences and prose around it are ignored. Unreadable replies give no rows."""
    found = F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), f"struct<items:array<struct<{item}>>>")
    return replies.select("doc_id", F.posexplode(found["items"]).alias("seq", "item")).select("doc_id", "seq", "item.*")


def with_derived_gross_profit(prior: DataFrame) -> DataFrame:
    """INS2: prior values (doc_id, field, period_type, value) and revenue - |cost| as gross profit where none is given."""
    key = ["doc_id", "period_type"]
    of = lambda field: F.first(F.when(F.col("field") == field, F.col("value")), ignorenulls=True)
    own = prior.groupBy(*key).agg(of("revenue").alias("r"), of("cost_of_revenue").alias("c"), of("gross_profit").alias("g"))
    new = own.where("r IS NOT NULL AND c IS NOT NULL AND g IS NULL").select("doc_id", F.lit("gross_profit").alias("field"), "period_type", (F.col("r") - F.abs("c")).alias("value"))
    return prior.select("doc_id", "field", "period_type", "value", F.lit(False).alias("derived")).unionByName(new.withColumn("derived", F.lit(True)))


def margins(now: DataFrame, prior: DataFrame) -> DataFrame:
    """INS4: (doc_id, period_type, key, now, prev, change_pp) of gross and net margin. now: with status, BAD rows don't
    count; a margin needs revenue over 0. prev is null without both prior values or with prior revenue of 0 or less."""
    key = ["doc_id", "period_type"]
    of = lambda field: F.first(F.when(F.col("field") == field, F.col("value")), ignorenulls=True).alias(field)
    fields = ("revenue", "gross_profit", "net_income_parent")
    own = now.where("status <> 'BAD'").groupBy(*key).agg(*map(of, fields)).where("revenue > 0")
    old = prior.groupBy(*key).agg(*map(of, fields)).select(*key, *[F.col(f).alias(f"p_{f}") for f in fields])
    rows = own.join(old, key, "left")
    one = lambda name, f: F.struct(F.lit(name).alias("key"), (F.col(f) / F.col("revenue")).alias("now"), F.when(F.col("p_revenue") > 0, F.try_divide(F.col(f"p_{f}"), F.col("p_revenue"))).alias("prev"))
    out = rows.select(*key, F.explode(F.array(one("gross_margin", "gross_profit"), one("net_margin", "net_income_parent"))).alias("m")).select(*key, "m.*").where("now IS NOT NULL")
    return out.withColumn("change_pp", (F.col("now") - F.col("prev")) * 100)


def status_summary(items: DataFrame) -> DataFrame:
    """INS5: per document, over its core items (not aux): n, ok, warn and the fields that are BAD, in order."""
    bad = F.array_sort(F.collect_list(F.when(F.col("status") == "BAD", F.struct("seq", "field"))))
    core = items.where("NOT aux").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "FOUND").alias("warn"), bad.alias("bad"))
    return core.withColumn("bad", F.transform("bad", lambda x: x["field"]))


CARDS = ["revenue", "net_income_parent", "gross_margin", "eps_basic"]
# Names of periods and ratios in narration, and sentences on what a status means.
PERIOD_WORDS = {"zh": {"Q": "单季", "H": "上半年累计", "YTD": "前三季度累计", "FY": "全年"}, "en": {"Q": "quarter", "H": "six months", "YTD": "nine months", "FY": "full year"}}
RATIO_NAMES = {"zh": {"gross_margin": "毛利率", "net_margin": "归母净利率"}, "en": {"gross_margin": "Gross margin", "net_margin": "Net margin (attributable)"}}
FOUND_REASONS = {
    "hk": ("港股没有可靠的结构化数据：出处和单位已核验，没有外部数字可比。", "HK has no reliable structured data: source and unit checked, no external figure to compare."),
    "": ("出处和单位已核验，没有取到可比的结构化数据。", "Source and unit checked; no structured figure available to compare."),
}
TAILS = {"SIGN": ("（符号相反）", " (opposite sign)"), "POWER": ("（差 10 的整数次幂倍）", " (off by a power of ten)"), "PERIOD": ("（等于另一期间的值）", " (matches another period)")}
BAD_REASONS = {
    "FABRICATED": ("数字 %s 在全文任何一页都找不到。", "The number %s does not appear anywhere in the filing."),
    "WRONG_PAGE": ("数字在原文里，但不在给出的那一页。", "The number is in the filing, but not on the page given."),
    "PARAPHRASED": ("数字在那一页上，但引用句不是逐字原文。", "The number is on the page, but the quote is not verbatim."),
    "UNIT": ("单位或币种无法解析。", "The unit or currency could not be parsed."),
    "PARSE_ARTEFACT": ("数字在 PDF 抽出的文字里被拆开了。", "The number is split across lines in the PDF text."),
    "MISSING": ("按报告期应有这一项，但没有取到（已补问一次）。", "Expected for this period, but not extracted (asked once more)."),
    "NO_SOURCE": ("没有给页码或原文引用，无法核对出处。", "No page or quote was given, so the source cannot be checked."),
    "": ("未通过核验。", "Failed a check."),
}


# What a failed rule's Chinese words hold, in the order in which they are tried, and its English sentence.
RULE_WORDS = {
    "毛利": "Gross profit is larger than revenue, or the cost used is negative.",
    "拨备前利润": "Pre-provision profit is larger than revenue.",
    "归母合计": "Parent net income vs ordinary shareholders check failed.",
    "疑似只取了普通股口径": "Looks like only the ordinary-shareholder line was taken.",
    "推导值": "Derived value differs from the total disclosed in the filing.",
    "EPS": "EPS × weighted shares is far from net income (order of magnitude).",
    "单季": "Quarter + previous cumulative does not add up to the cumulative figure.",
}


def rule_in_english(rule: Column) -> Column:
    """INS12: the English sentence of a failed rule's words; words that no sentence is known for are told as they are."""
    out = F.concat(F.lit("Fails a consistency check: "), rule)
    for words, said in reversed(RULE_WORDS.items()):
        out = F.when(rule.contains(words), F.lit(said)).otherwise(out)
    return out


def cards(items: DataFrame, ratios: DataFrame, docs: DataFrame) -> DataFrame:
    """INS6: (doc_id, place, key, period_type, raw, value) of the key figures of each document, in order.

    The period type is Q where the document's part is a quarter's and it has core items of a quarter, else the
    cumulative one. items: doc_id, seq, field, period_type, raw, aux; ratios: doc_id, key, period_type, now; docs:
    doc_id, part, cumulative_type. The first item by seq counts.
    """
    core = items.where("NOT aux")
    quarterly = core.where("period_type = 'Q'").select("doc_id", F.lit(True).alias("has")).distinct()
    chosen = docs.join(quarterly, "doc_id", "left").select("doc_id", F.when(F.col("part").isin("Q1", "Q2", "Q3") & F.coalesce("has", F.lit(False)), "Q").otherwise(F.col("cumulative_type")).alias("period_type"))
    first = core.where(F.col("field").isin(CARDS)).groupBy("doc_id", F.col("field").alias("key"), "period_type").agg(F.min_by("raw", "seq").alias("raw")).withColumn("value", F.lit(None).cast("double"))
    margin = ratios.where("key = 'gross_margin'").select("doc_id", "key", "period_type", F.lit(None).cast("string").alias("raw"), F.col("now").alias("value"))
    return first.unionByName(margin).join(chosen, ["doc_id", "period_type"]).select("doc_id", F.array_position(F.array(*map(F.lit, CARDS)), F.col("key")).cast("int").alias("place"), "key", "period_type", "raw", "value")


def narration_facts(items: DataFrame, ratios: DataFrame, lang: str) -> DataFrame:
    """INS7: facts that may be told: (doc_id, metric, period, value, prior_value, change, pages, computed) of core items
    that aren't BAD and of ratios, in one language.

    items: doc_id, name_zh, name_en, period_type, raw, value, unit_zh, unit_en, page, status, aux, prev_raw, prev_page,
    pct; ratios: doc_id, key, period_type, now, prev, change_pp, pages.
    """
    words = lambda table, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
    unit = F.coalesce(f"unit_{lang}", F.lit(""))
    amount = lambda c: F.trim(F.concat_ws(" ", c, unit))
    percent = lambda c: F.concat(F.replace(F.format_number(c * 100, 1), F.lit(",")), F.lit("%"))
    told = items.where("NOT aux AND status <> 'BAD' AND (raw IS NOT NULL OR value IS NOT NULL)").select(
        "doc_id", F.col(f"name_{lang}").alias("metric"), words(PERIOD_WORDS[lang], F.col("period_type")).alias("period"), amount(F.coalesce("raw", F.format_number("value", 1))).alias("value"),
        F.when(F.col("prev_raw").isNotNull(), amount(F.col("prev_raw"))).alias("prior_value"), F.when(F.col("pct").isNotNull(), change_words(F.col("pct") * 100, "%", lang)).alias("change"),
        F.array_compact(F.array("page", F.when(F.col("prev_raw").isNotNull(), F.col("prev_page")))).alias("pages"), F.lit(False).alias("computed"),
    )
    own = ratios.select(
        "doc_id", words(RATIO_NAMES[lang], F.col("key")).alias("metric"), words(PERIOD_WORDS[lang], F.col("period_type")).alias("period"), percent(F.col("now")).alias("value"), F.when(F.col("prev").isNotNull(), percent(F.col("prev"))).alias("prior_value"),
        F.when(F.col("prev").isNotNull(), change_words(F.col("change_pp"), "pp", lang)).alias("change"), "pages", F.lit(True).alias("computed"),
    )
    return told.unionByName(own)


def with_reasons(items: DataFrame) -> DataFrame:
    """INS12: items (market, status, category, raw_value, and, where a reference differs, state, value, ref_value,
    ref_source) with reason_zh and reason_en; empty for OK. A failed rule (column rule, in Chinese words) goes first. How
    value and reference differ (column how: SIGN, POWER) is told in brackets, else whether another period's agrees."""
    have = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    rule, state, source = have("rule", "string"), have("state", "string"), F.coalesce(have("ref_source", "string"), F.lit("reference"))
    number = lambda c: F.format_number(have(c, "double"), 2)
    out = items
    for k, lang in enumerate(("zh", "en")):
        found = F.when(F.col("market") == "hk", FOUND_REASONS["hk"][k]).otherwise(FOUND_REASONS[""][k])
        fixed = F.lit(BAD_REASONS[""][k])
        for name, said in BAD_REASONS.items():
            if name:
                fixed = F.when(F.col("category") == name, F.format_string(said[k].replace("%s", "%1$s"), F.coalesce("raw_value", F.lit("")))).otherwise(fixed)
        differs = (state == "mismatch") & (F.coalesce("category", F.lit("")).isin("", "DEFINITION", "PERIOD", "UNIT"))
        tail = F.when(have("how", "string") == "SIGN", TAILS["SIGN"][k]).when(have("how", "string") == "POWER", TAILS["POWER"][k]).when(F.col("category") == "PERIOD", TAILS["PERIOD"][k]).otherwise("")
        apart = F.concat(F.lit("与 "), source, F.lit(" 不一致：原文 "), number("value"), F.lit("，"), source, F.lit(" "), number("ref_value"), tail, F.lit("。")) if lang == "zh" else F.concat(F.lit("Differs from "), source, F.lit(": filing "), number("value"), F.lit(" vs "), source, F.lit(" "), number("ref_value"), tail, F.lit("."))
        broken = F.concat(F.lit("合理性检查："), rule) if lang == "zh" else rule_in_english(rule)
        bad = F.when(rule.isNotNull(), broken).when(F.coalesce(differs, F.lit(False)), apart).otherwise(fixed)
        out = out.withColumn(f"reason_{lang}", F.when(F.col("status") == "FOUND", found).when(F.col("status") == "BAD", bad).otherwise(""))
    return out


def display_order(items: DataFrame, fields: list[str]) -> DataFrame:
    """INS11: items with ``place`` in their document: BAD, FOUND, OK; core before aux; order of fields; quarters first."""
    rank = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)), F.lit(len(names) + 1))
    w = Window.partitionBy("doc_id").orderBy(rank(F.col("status"), ["BAD", "FOUND", "OK"]), "aux", rank(F.col("field"), fields), F.col("period_type") != "Q", "seq")
    return items.withColumn("place", F.row_number().over(w))


def _problem(text: Column, pages: Column) -> Column:
    bad = F.filter(F.regexp_extract_all(text, F.lit(WRITTEN_NUMBER), F.lit(0)), lambda n: ~F.array_contains("numbers", F.replace(n, F.lit(","))))
    foreign = F.array_except(pages, F.col("fact_pages"))
    word = F.regexp_extract(text, BANNED, 0)
    return (
        F.when(text == "", "language missing").when(F.size(bad) > 0, F.concat(F.lit("numbers: "), F.array_join(bad, ", "))).when(F.size(pages) == 0, "no page")
        .when(F.size(foreign) > 0, F.concat(F.lit("pages: "), F.array_join(foreign.cast("array<string>"), ", "))).when(word != "", F.concat(F.lit("wording: "), word))
    )


def checked_points(points: DataFrame, facts: DataFrame) -> DataFrame:
    """INS8-INS10: points (doc_id, seq, text_zh, text_en, pages) with why and route (kept, dropped, over).

    Every number of both texts must be among the document's facts (doc_id, text, page), every page among the facts'
    pages, and no wording banned; the first problem is told, the Chinese text's before the English one's. The first five
    good points are kept. Null texts are empty; null pages are none. A document's facts are a short list.
    """
    numbers = F.array_distinct(F.flatten(F.collect_list(F.transform(F.regexp_extract_all("text", F.lit(WRITTEN_NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","))))))
    own = facts.groupBy("doc_id").agg(numbers.alias("numbers"), F.collect_set("page").alias("fact_pages"))
    both = points.join(own, "doc_id", "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<string>"))).withColumn("fact_pages", F.coalesce("fact_pages", F.array().cast("array<int>")))
    pages = F.coalesce("pages", F.array().cast("array<int>"))
    why = F.coalesce(*[_problem(F.trim(F.coalesce(t, F.lit(""))), pages) for t in ("text_zh", "text_en")])
    nth = F.row_number().over(Window.partitionBy("doc_id", F.col("why").isNull()).orderBy("seq"))
    route = F.when(F.col("why").isNotNull(), "dropped").when(nth <= MOST_POINTS, "kept").otherwise("over")
    return both.withColumn("why", why).withColumn("route", route).drop("numbers", "fact_pages")


def flagged_without_reference() -> Column:
    """EVA5: C1-C3 failed, or a consistency rule did, or the item is missing."""
    passed = F.coalesce(F.col("c1") & F.col("c2") & F.col("c3"), F.lit(False))
    return ~passed | (F.size(F.coalesce("sanity", F.array().cast("array<string>"))) > 0) | F.coalesce(F.col("category") == "MISSING", F.lit(False))


def triggers() -> Column:
    """EVA18: array of every check that failed: C1-C3 (of a part, for derived items with components), C4, consistency
    rules, RECOMPUTED; or MISSING alone; or UNKNOWN. Columns: c1-c3, components (c1-c3 each), state, sanity, recomputed, category."""
    parts = F.coalesce(F.size("components") > 0, F.lit(False))
    failed = []
    fails = lambda c: F.exists("components", lambda p: ~F.coalesce(p[c], F.lit(False)))
    for c in ("c1", "c2", "c3"):
        of_part = fails(c)
        failed.append(F.when(parts & of_part, f"{c.upper()}_PART").when(~parts & ~F.coalesce(F.col(c), F.lit(False)), c.upper()))
    failed.append(F.when(F.col("state") == "mismatch", "C4"))
    own = F.concat(F.array_compact(F.array(*failed)), F.coalesce("sanity", F.array().cast("array<string>")), F.array_compact(F.array(F.when(F.col("recomputed"), "RECOMPUTED"))))
    return F.when(F.col("category") == "MISSING", F.array(F.lit("MISSING"))).when(F.size(own) == 0, F.array(F.lit("UNKNOWN"))).otherwise(own)


def trigger_counts(rows: DataFrame) -> DataFrame:
    """EVA19 and EVA20: (trigger, n, sole) of rows with ``triggers``: on how many it fired, and on how many alone."""
    each = rows.select((F.size("triggers") == 1).alias("alone"), F.explode("triggers").alias("trigger"))
    return each.groupBy("trigger").agg(F.count("*").alias("n"), F.count_if("alone").alias("sole"))


def tier_matrix(rows: DataFrame, cells: list[str]) -> DataFrame:
    """EVA22: (report, field, one column a cell) with R, W or null for right, wrong and absent."""
    verdict = F.first(F.when(F.col("strict"), "R").otherwise("W"))
    return rows.groupBy("report", "field").pivot("cell", cells).agg(verdict)


def projected_costs(docs: DataFrame, prices: list[dict], per_char: float, overhead: float, out_tokens: float, follow_up: float) -> DataFrame:
    """BUD8: mean usd a document for each model. docs: chars. A model's price (model, in, out, per million) changes to
    long_in, long_out beyond long_from input tokens; a share ``follow_up`` of documents is asked twice."""
    offers = F.array(*[F.struct(F.lit(p["model"]).alias("model"), *[F.lit(float(p.get(k, p[d]) if d else p.get(k, "inf"))).alias(k) for k, d in (("in", "in"), ("out", "out"), ("long_from", None), ("long_in", "in"), ("long_out", "out"))]) for p in prices])
    each = docs.select((F.col("chars") * per_char + overhead).alias("t"), F.explode(offers).alias("p"))
    long = F.col("t") > F.col("p.long_from")
    usd = (F.col("t") * F.when(long, F.col("p.long_in")).otherwise(F.col("p.in")) + out_tokens * F.when(long, F.col("p.long_out")).otherwise(F.col("p.out"))) / 1e6
    return each.groupBy(F.col("p.model").alias("model")).agg((F.avg(usd) * (1 + follow_up)).alias("usd"))


def scaled_costs(last: DataFrame) -> DataFrame:
    """BUD9: totals from rows (pipeline, direct, simple, chars, last_chars): costs grow with the document's size, those
    of the pipeline, which sees selected pages, with its square root and never under the last."""
    k = F.col("chars") / F.greatest(F.lit(1), F.col("last_chars"))
    asked = F.greatest("direct", "simple") * k
    return last.agg(F.sum(F.col("pipeline") * F.greatest(F.lit(1.0), F.sqrt(k))).alias("pipeline"), F.sum(asked).alias("direct"), F.sum(asked).alias("simple"), (1.3 * F.sum(asked)).alias("verified"))


def comparatives(prior: DataFrame, now: DataFrame) -> DataFrame:
    """INS1: prior-year claims (doc_id, seq, field, period_type, period_end, raw_value, passed: C1-C3) with why: null for
    those kept. A claim is kept if its pair is among ``now`` (doc_id, field, period_type, period_end), it ends 350 to 380
    days earlier, passed its checks, and no earlier claim of its pair is kept."""
    own = now.groupBy("doc_id", "field", "period_type").agg(F.min("period_end").alias("end"))
    both = prior.join(own, ["doc_id", "field", "period_type"], "left")
    days = F.datediff("end", "period_end")
    why = F.when(F.col("end").isNull() | (F.coalesce("raw_value", F.lit("")) == ""), "not asked for").when(~F.coalesce(days.between(350, 380), F.lit(False)), "not a year before").when(~F.coalesce("passed", F.lit(False)), "failed checks")
    nth = F.row_number().over(Window.partitionBy("doc_id", "field", "period_type", F.col("why").isNull()).orderBy("seq"))
    return both.withColumn("why", why).drop("end").withColumn("why", F.when(F.col("why").isNull() & (nth > 1), "repeated").otherwise(F.col("why")))


def listing_rows(listings: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SRC12: one row per entry of listings (filer, text), whose ``recent`` object holds parallel arrays."""
    kind = ",".join(f"{c}:array<{t}>" for c, t in columns.items())
    recent = F.from_json("text", f"struct<recent:struct<{kind}>>")["recent"]
    zipped = F.arrays_zip(*[recent[c].alias(c) for c in columns])
    return listings.select("filer", F.posexplode(zipped).alias("pos", "x")).select("filer", "pos", *[F.col("x")[c].alias(c) for c in columns])


def snippets(asked: DataFrame, lines: DataFrame, around: int = 3) -> DataFrame:
    """EVA25: (doc_id, seq, page, hit, lines) for each (doc_id, seq, raw, hint) whose number stands on a line as a whole:
    the hint page's first hit, else the first by page and line, with the lines around it. lines: doc_id, page, line_no, line."""
    numbers = lines.select("doc_id", "page", "line_no", F.explode(F.array_distinct(number_tokens(for_numbers(F.col("line"))))).alias("number"))
    found = asked.withColumn("number", digits_of(F.col("raw"))).join(numbers, ["doc_id", "number"])
    order = F.struct(~F.coalesce(F.col("page") == F.col("hint"), F.lit(False)), "page", "line_no")
    best = found.groupBy("doc_id", "seq").agg(F.min_by(F.struct(F.col("page").alias("page"), F.col("line_no").alias("hit")), order).alias("at")).select("doc_id", "seq", "at.*")
    near = best.join(lines, ["doc_id", "page"]).where(F.abs(F.col("line_no") - F.col("hit")) <= around)
    context = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return near.groupBy("doc_id", "seq", "page", "hit").agg(context.alias("lines"))
