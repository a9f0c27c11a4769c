"""Pasted answers to claims (SRC9-SRC11) and free-text answers to claims (VER27). No row is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import field_of, period_of, role_of
from ..functions.text import json_block, nfkc, reply_kind, signed
from ..functions.units import digits_of

ROW = "field string, metric string, raw_value string, value string, raw_unit string, unit string, raw_currency string, currency string, period_type string, period string, period_end string, page string, quote string, status string, note string, derivation string, components string"
TABLE_ROLES = ("field", "raw_value", "raw_unit", "raw_currency", "period_type", "page", "quote")
# Texts that say that a report doesn't state an item.
NOT_DISCLOSED = ["原文没有", "not disclosed"]


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def json_rows(replies: DataFrame) -> DataFrame:
    """SRC9: replies (doc_id, text) of kind json as rows (doc_id, line, text, row, why): an object with ``items``, or a
    bare list; lines count from 1. What is no list, or isn't JSON, is one row with the reason; what is no object as well."""
    own = replies.where(reply_kind(F.col("text")) == "json").select("doc_id", F.regexp_replace(F.btrim(json_block(F.col("text")), F.lit("`")), r"^json\s*", "").alias("body"))
    items = F.when(F.col("body").rlike(r"^\s*\["), F.col("body")).otherwise(F.get_json_object("body", "$.items"))
    parsed = own.withColumn("valid", F.expr("try_parse_json(body)").isNotNull()).withColumn("list", F.when(F.col("valid") & items.startswith("["), F.from_json(items, "array<string>")))
    whole = F.when(~F.col("valid"), "not JSON").when(F.col("list").isNull(), "no list of items")
    rows = parsed.select("doc_id", whole.alias("whole"), F.posexplode_outer("list").alias("at", "x")).where("at IS NOT NULL OR whole IS NOT NULL")
    why = F.coalesce("whole", F.when(~F.coalesce(F.col("x").startswith("{"), F.lit(False)), "not an object"))
    return rows.select("doc_id", F.coalesce(F.col("at") + 1, F.lit(1)).alias("line"), F.coalesce(F.substring("x", 1, 160), F.lit("")).alias("text"), F.when(why.isNull(), F.from_json("x", ROW)).alias("row"), why.alias("why"))


def split_row(line: Column) -> Column:
    """Cells of a line of a tab-separated or piped table."""
    cut = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(F.split(F.regexp_replace(F.regexp_replace(_stripped(line), r"^\|", ""), r"\|$", ""), r"\|"))
    return F.transform(cut, _stripped)


def table_heads(replies: DataFrame) -> DataFrame:
    """SRC10: doc_id, columns, roles, needs_mapping and lines (line, text, cells) of replies of kind table. A column
    ``mapping`` (map of a column's number, from "0", to a role) overrides what the header says."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x, k: F.struct((k + 1).alias("line"), x.alias("text"))), lambda x: x["text"].rlike(r"\S"))
    own = replies.where(reply_kind(F.col("text")) == "table").withColumn("lines", lines).withColumn("head", F.col("lines")[0]["text"])
    own = own.withColumn("columns", split_row(F.col("head"))).withColumn("folded", split_row(nfkc(F.col("head"))))
    given = F.col("mapping") if "mapping" in replies.columns else F.lit(None).cast("map<string,string>")
    own = own.withColumn("roles", F.transform("folded", lambda c, k: F.coalesce(F.try_element_at(given, k.cast("string")), role_of(c))))
    known = F.array_contains("roles", "field") & F.array_contains("roles", "raw_value")
    rest = F.transform(F.slice("lines", 2, 2**30), lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), split_row(x["text"]).alias("cells")))
    return own.select("doc_id", "columns", "roles", (~F.coalesce(known, F.lit(False))).alias("needs_mapping"), rest.alias("lines"))


def table_rows(replies: DataFrame) -> DataFrame:
    """SRC10: rows (doc_id, line, text, row, why) of tables whose columns are known; rules are skipped, and lines with
    another number of cells than the header are rows with the reason."""
    rows = table_heads(replies).where("NOT needs_mapping").select("doc_id", "columns", "roles", F.explode("lines").alias("l"))
    rows = rows.where(~F.forall("l.cells", lambda c: (c == "") | c.rlike("^:?-{2,}:?$")))
    why = F.when(F.size("l.cells") != F.size("columns"), F.concat(F.size("l.cells").cast("string"), F.lit(" cells, header has "), F.size("columns").cast("string")))
    said = lambda role: F.try_element_at(F.filter(F.zip_with("roles", "l.cells", lambda r, c: F.struct(r.alias("r"), c.alias("c"))), lambda x: x["r"] == role), F.lit(-1))["c"]
    names = [x.split()[0] for x in ROW.split(", ")]
    row = F.struct(*[(said(n) if n in TABLE_ROLES else F.lit(None).cast("string")).alias(n) for n in names])
    return rows.select("doc_id", "l.line", F.substring("l.text", 1, 160).alias("text"), F.when(why.isNull(), row).alias("row"), why.alias("why"))


def routed(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """SRC11: every row with its route (item, absent or bad) and, for bad ones, why. replies: doc_id, cumulative_type,
    period_end, which stand where a row says nothing."""
    own = rows.join(replies.select("doc_id", "cumulative_type", F.col("period_end").alias("own_end")), "doc_id").select("doc_id", "line", "text", "why", "row.*", "cumulative_type", "own_end")
    raw = _stripped(F.coalesce("raw_value", "value", F.lit("")))
    own = own.withColumn("name", F.coalesce(F.nullif("field", F.lit("")), "metric")).withColumn("field", field_of(F.col("name"))).withColumn("raw_value", raw)
    own = own.withColumn("period_type", period_of(F.coalesce(F.nullif("period_type", F.lit("")), "period"), F.col("cumulative_type")))
    absent = (F.lower(F.coalesce("status", F.lit(""))) == "not_disclosed") | F.lower(nfkc(F.col("raw_value"))).isin(NOT_DISCLOSED)
    bad = F.coalesce("why", F.when(F.col("field").isNull(), "unknown metric").when(absent, None).when(digits_of(F.col("raw_value")).isNull(), "not a number").when(F.col("period_type").isNull(), "unknown period"))
    own = own.withColumn("why", bad).withColumn("route", F.when(bad.isNotNull(), "bad").when(absent, "absent").otherwise("item"))
    item = lambda c: F.when(F.col("route") == "item", c)
    page = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("page", F.lit("")), r"\d+", 0), F.lit("")).cast("int"), F.lit(0))
    return own.select(
        "doc_id", "line", "text", "route", "why", F.when(F.col("route") != "bad", F.col("field")).alias("field"), F.when(F.col("route") != "bad", F.col("period_type")).alias("period_type"), item(F.col("raw_value")).alias("raw_value"),
        item(F.coalesce("raw_unit", "unit", F.lit(""))).alias("raw_unit"), item(F.coalesce("raw_currency", "currency", F.lit(""))).alias("raw_currency"), item(F.coalesce("period_end", "own_end")).alias("period_end"),
        item(page).alias("page"), item(F.coalesce("quote", F.lit(""))).alias("quote"), item(F.coalesce("derivation", F.lit("reported"))).alias("derivation"), item(F.col("components")).alias("components"), F.when(F.col("route") == "absent", F.substring(F.coalesce("note", F.lit("")), 1, 200)).alias("note"),
    )


def pasted(replies: DataFrame) -> DataFrame:
    """SRC9-SRC11: all rows of all replies (doc_id, text, cumulative_type, period_end), routed."""
    return routed(json_rows(replies).unionByName(table_rows(replies)), replies)


def free_text_claims(parsed: DataFrame, answers: DataFrame) -> DataFrame:
    """VER27: claims of parsed answers. parsed: doc_id, seq, field, period_type, status, raw_value, raw_unit,
    raw_currency, negative, page, source_quote, computed, components (array of name, sign, raw_value, raw_unit,
    raw_currency, page, quote); answers: doc_id, answer_numbers (array of number tokens of the answer), period_end.

    Rows that aren't answered are left out. A row whose number isn't in the answer, or isn't one, gives only a note. A
    computed row's components are the derivation, and inherit unit and currency; without any it is marked.
    """
    own = parsed.where(F.coalesce(F.nullif("status", F.lit("")), F.lit("answered")) == "answered").join(answers, "doc_id").withColumn("raw_value", signed(F.col("raw_value"), F.col("negative")))
    digits = digits_of(F.col("raw_value"))
    note = F.when(F.coalesce("raw_value", F.lit("")) == "", "not in the answer").when(digits.isNull(), "not a number").when(~F.coalesce(F.array_contains("answer_numbers", digits), F.lit(False)), "not in the answer")
    own = own.withColumn("note", note).withColumn("raw_unit", F.coalesce(F.nullif("raw_unit", F.lit("")), "raw_currency", F.lit(""))).withColumn("raw_currency", F.coalesce("raw_currency", F.lit("")))
    parts = F.filter("components", lambda c: F.coalesce(c["raw_value"], F.lit("")) != "")
    inherit = lambda c, name: F.coalesce(F.nullif(c[name], F.lit("")), F.col(name)).alias(name)
    parts = F.transform(parts, lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["sign"], F.lit(1)).alias("sign"), c["raw_value"].alias("raw_value"), inherit(c, "raw_unit"), inherit(c, "raw_currency"), F.coalesce(c["page"], F.lit(0)).alias("page"), F.coalesce(c["quote"], F.lit("")).alias("quote")))
    computed, some = F.coalesce("computed", F.lit(False)), F.coalesce(F.size(parts), F.lit(0)) > 0
    return own.select(
        "doc_id", "seq", "field", "period_type", F.lit(None).cast("string").alias("period_start"), "period_end", "raw_value", "raw_unit", "raw_currency", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("source_quote", F.lit("")).alias("quote"),
        F.when(computed & some, "derived").otherwise("reported").alias("derivation"), F.when(computed & some, parts).alias("components"), (computed & ~some).alias("computed_without_inputs"), "note",
    )
