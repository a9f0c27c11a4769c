"""Pages: concatenation, HTML, chunks, scoring, selection, templates (SRC1-SRC4, FN20, LOC, TPL)."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc
from ..sources.store import materialise

# Phrases of page groups (match form), picks per group in priority order.
GROUPS = {
    "income": r"合并利润表|综合损益表|综合收益表|损益表|收益表|利润表|经营状况表|损益账|经营业绩表|全面亏损表|亏损表|statementsofoperations|statementsofcomprehensiveloss|statementofcomprehensiveloss|statementsofincome|incomestatement|statementofincome|statementofprofitorloss|consolidatedstatementsofcomprehensiveincome",
    "highlights": r"主要会计数据和财务指标|主要会计数据|财务摘要|财务概要|业绩摘要|financialhighlights|selectedfinancialdata|financialsummary|keyfinancial|同比变动",
    "cashflow": r"现金流量表|现金流动表|statementsofcashflows|statementofcashflows|cashflowstatement|netcash(?:provided|used|generated)|经营活动",
    "eps": r"基本每股收益|每股基本盈利|每股盈利|每股收益|basicearningspershare|earningspershare|basic",
    "bank": r"利息净收入|净利息收入|netinterestincome|拨备前|preprovision|信用减值损失|预期信贷损失|provisionforcreditlosses|业务及管理费|营业支出",
    "mdna": r"管理层讨论与分析|管理层讨论及分析|management'?sdiscussionandanalysis|业务回顾|经营情况讨论|分部|segment|业务概要|经营情况|运营数据|净息差|不良贷款率|netinterestmargin|毛利率|grossmargin",
}
PICKS = {"income": 3, "highlights": 3, "cashflow": 2, "eps": 2, "bank": 2, "mdna": 4}
UNIT_PHRASE = r"(?i)(?:in (?:thousands|millions|billions)|单位[:：]\s*[^\s，,；;]{1,8})"


def parts_to_pages(pages: DataFrame) -> DataFrame:
    """SRC1: pages (doc_id, part, part_page, text) with page numbers that go on from part to part.

    Offsets come from a table of part sizes, so a document with very many pages isn't ranked in one task.
    """
    sizes = pages.groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("doc_id").orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("part_page"))
    return pages.withColumn("rank", rank).join(before, ["doc_id", "part"]).withColumn("page", F.col("before") + F.col("rank")).drop("before", "rank")


# Tags whose style breaks the page, what is no text, and tags that end a line or a cell.
PAGE_BREAK = r'(?i)<[^>]+style="[^"]*(?:page-break-(?:before|after)\s*:\s*always|break-(?:before|after)\s*:\s*page)[^"]*"[^>]*>'
TAGGED_HEADER = r"(?is)<ix:header\b.*?</ix:header>"
NO_TEXT = r"(?is)<(?:script\b.*?</script|style\b.*?</style|ix:header\b.*?</ix:header)>"
LINE_END, CELL_END = r"(?i)</(?:tr|p|div|h[1-6]|li|table)>|<br\s*/?>", r"(?i)</t[dh]>"
#: Characters of a chunk, and pages under which a document is cut into chunks instead.
CHUNK, FEWEST_PAGES = 6000, 3


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: A numeric or named entity that ends in a semicolon.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def _closed_unescaped(s: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return s.map(lambda t: CLOSED.sub(one, t), na_action="ignore")


def html_text(part: Column, open_entities: bool = True) -> Column:
    """SRC2: the text of a piece of HTML: no scripts or styles, a line for each block, a space after each cell, all named
    and numeric entities resolved, brackets glued to their numbers, blanks and empty lines collapsed, folded (FN1).

    Entities without a semicolon (a cut ``&amp``) are resolved like HTML does, or stay where ``open_entities`` is off.
    """
    t = F.regexp_replace(F.coalesce(part, F.lit("")), NO_TEXT, " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, LINE_END, "\n"), CELL_END, " "), r"<[^>]+>", "")
    t = F.regexp_replace((_unescaped if open_entities else _closed_unescaped)(t), r"[ \t\u00a0]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\(\s+(?=\d)", "("), r"(?U)(?<=\d)\s+\)", ")")
    t = nfkc(F.regexp_replace(t, r"(?U)\n\s*\n", "\n"))
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def html_pages(docs: DataFrame, html_col: str = "html", limit: int = CHUNK) -> DataFrame:
    """SRC2 and SRC3: (doc_id, page, text), pages from 1. Documents (doc_id, unique, and their HTML) are cut at the tags
    that break pages; parts without text are no pages; a document with under three pages is chunked by lines instead.

    A document without any text (null too) is one page of an empty line.
    """
    whole = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), TAGGED_HEADER, " ")
    parts = docs.select("doc_id", F.posexplode(F.split(whole, PAGE_BREAK)).alias("nth", "part"))
    parts = materialise(parts.select("doc_id", "nth", html_text(F.col("part")).alias("text")).where("text <> ''"), "html-parts")
    counted = parts.groupBy("doc_id").agg(F.count("*").alias("n"))
    enough = counted.where(F.col("n") >= FEWEST_PAGES).select("doc_id")
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth"))
    paged = parts.join(enough, "doc_id", "left_semi").select("doc_id", page.alias("page"), "text")
    few = parts.join(enough, "doc_id", "left_anti").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("nth", "text")))["text"], "\n").alias("text"))
    bare = docs.select("doc_id").join(counted, "doc_id", "left_anti").select("doc_id", F.lit("").alias("text"))
    return paged.unionByName(chunks(few.unionByName(bare), limit))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _line_chunks(text: pd.Series, limit: pd.Series) -> pd.Series:
    def cut(t: str, most: int) -> list[str]:
        out, used = [], most
        for line in t.split("\n"):
            if not out or used + len(line) > most:
                out.append([])
                used = 0
            out[-1].append(line)
            used += len(line) + 1
        return ["\n".join(c) + "\n" for c in out]

    return pd.Series([cut(t, n) for t, n in zip(text, limit, strict=True)], dtype=object)


def chunks(texts: DataFrame, limit: int = CHUNK) -> DataFrame:
    """SRC3: (doc_id, page, text) of texts (doc_id, text) as whole lines, in order, in chunks of at most ``limit``
    characters but for the last line break; a longer line stands alone. Each line of a chunk ends in a line break.

    A text is cut where its row lies, in one pass over its lines; no lines are shuffled.
    """
    return texts.select("doc_id", F.posexplode(_line_chunks(F.coalesce("text", F.lit("")), F.lit(limit))).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


def readability(pages: DataFrame) -> DataFrame:
    """SRC4: per document: empty (no page has text) and scanned (at most half of the first 20 pages have over 200 characters)."""
    long = F.when(F.col("page") <= 20, (F.length("text") > 200).cast("int"))
    return pages.groupBy("doc_id").agg((~F.bool_or(F.trim("text") != "")).alias("empty"), (F.avg(long) <= 0.5).alias("scanned"))


def unit_phrases(text: Column) -> Column:
    """FN20: the first three distinct unit declarations."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(UNIT_PHRASE), F.lit(0))), 1, 3)


def page_scores(pages: DataFrame) -> DataFrame:
    """LOC1: (doc_id, page, group, score) over pages with text and match_text: capped body hits and ten for each hit in
    the first three lines, weighed by how many large numbers the page has."""
    dense = F.lit(0.3) + F.log1p(F.size(F.regexp_extract_all("text", F.lit(r"\d{1,3}(?:,\d{3})+"), F.lit(0))))
    head = F.lower(F.regexp_replace(F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n"), r"(?U)\s+", ""))
    score = lambda p: (F.least(F.lit(3), F.regexp_count("match_text", F.lit(p))) + 10 * F.regexp_count(head, F.lit(p))) * dense
    rows = F.array(*[F.struct(F.lit(g).alias("group"), score(p).alias("score")) for g, p in GROUPS.items()])
    return pages.select("doc_id", "page", F.explode(rows).alias("s")).select("doc_id", "page", "s.group", "s.score")


def picks(scores: DataFrame) -> DataFrame:
    """LOC2: best pages of each group with a score, ties in page order; (doc_id, group, page, rank)."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "group").orderBy(F.desc("score"), "page"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in PICKS.items() for x in kv]), F.col("group"))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "group", "page", "rank")


def with_neighbours(picked: DataFrame, pages: DataFrame) -> DataFrame:
    """LOC3: statement pages bring the next page if there is one; (doc_id, page, priority), each page at its first place."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, g in enumerate(PICKS) for x in (g, k)]), F.col("group"))
    more = F.when(F.col("group").isin("income", "cashflow"), F.array(F.col("page"), F.col("page") + 1)).otherwise(F.array("page"))
    out = picked.select("doc_id", "group", "rank", F.posexplode(more).alias("step", "page")).join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    return out.groupBy("doc_id", "page").agg(F.min(order * 1000 + F.col("rank") * 10 + F.col("step")).alias("priority"))


def packed(chosen: DataFrame, pages: DataFrame, budget: int = 90_000) -> DataFrame:
    """LOC4: (doc_id, page) kept in priority order under a character budget; a page that doesn't fit is skipped, not a stop."""
    sized = chosen.join(pages.select("doc_id", "page", F.length("text").alias("size")), ["doc_id", "page"])
    sorted_ = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("priority", "page", "size"))).alias("ps"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    fold = F.aggregate("ps", start, lambda a, p: F.when(a["used"] + p["size"] > budget, a).otherwise(F.struct((a["used"] + p["size"]).alias("used"), F.concat(a["kept"], F.array(p["page"].cast("int"))).alias("kept"))), lambda a: a["kept"])
    return sorted_.select("doc_id", F.explode(fold).alias("page"))


def context(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """LOC5: one text per document, pages in order under their numbers."""
    rows = kept.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    said = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("[PAGE "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    return rows.groupBy("doc_id").agg(F.array_join(said, "\n").alias("context"))


def shortest(pages: DataFrame, n: int = 1) -> DataFrame:
    """SMP4: (doc_id, size) of the n documents with the fewest characters, ties by id; pages without text count as 0."""
    own = pages.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size"))
    return own.orderBy("size", "doc_id").limit(n)


def template_by_code(source: Column, code: Column, name: Column) -> Column:
    """TPL1."""
    n = code.try_cast("int")
    sic = F.when(n.isin(6021, 6022, 6029, 6035, 6036), "bank").when(n.between(6311, 6399) | (n == 6411), "insurance").otherwise("general")
    named = F.when(name.rlike("货币金融服务|^银行|銀行"), "bank").when(name.rlike("保险|保險"), "insurance").when(name != "", "general")
    return F.when(source.contains("SIC") & n.isNotNull(), sic).otherwise(named)


def template_by_structure(match_text: Column) -> Column:
    """TPL2, on the match form of the top income pages; banks are tested first."""
    cost = match_text.rlike("营业成本|销售成本|收入成本|costofrevenue|costofsales|costofgoodssold|totalcostofsales")
    nii = match_text.rlike("利息净收入|净利息收入|净利息收益|netinterestincome")
    ins = match_text.rlike("保险服务收入|已赚保费|insurancerevenue|netpremiumsearned")
    return F.when(nii & ~cost, "bank").when(ins & ~cost, "insurance").when(cost, "general")


def choose_template(by_code: Column, by_structure: Column) -> Column:
    """TPL3: struct(template, conflict): a financial code wins, else the structure."""
    financial = by_code.isin("bank", "insurance")
    template = F.when(financial, by_code).otherwise(F.coalesce(by_structure, by_code, F.lit("general")))
    return F.struct(template.alias("template"), F.coalesce(by_code != by_structure, F.lit(False)).alias("conflict"))
