"""Accounting consistency rules on verified items (CON1-CON7); a rule runs only where all its inputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_numbers

# Other holders of equity, labels of disclosed totals, and scales of printed numbers.
OTHER_EQUITY = r"(?i)其他權益持有人|其他权益持有人|其他权益工具持有者|永续债持有|永續債持有|优先股股东|優先股股東|other equity holders|preference shareholders|perpetual"
DISCLOSED = {
    "ppop": r"(?i)拨备前利润|撥備前利潤|拨备前营业利润|pre-?provision (?:operating )?profit",
    "gross_profit": r"(?i)^\s*毛利(?![率潤润])|^\s*gross (?:profit|margin)(?! percentage| %)",
    "net_income_parent": r"(?i)归属于(?:母公司|本行|本公司)(?:所有者|股东)的净利润|本公司(?:擁有人|权益持有人|權益持有人)應佔|attributable to (?:owners|shareholders|equity holders) of the (?:parent|company)",
}
PRINTED = (1.0, 1e3, 1e4, 1e6, 1e8, 1e9)
ADDITIVE = ["revenue", "net_income_parent", "gross_profit", "net_interest_income", "operating_cash_flow"]
FIELDS = ["revenue", "gross_profit", "ppop", "net_income_parent", "net_income_common", "eps_basic", "weighted_avg_shares_basic"]


def wide(items: DataFrame) -> DataFrame:
    """One row per (doc_id, period_type): first value, tolerance, page_used, derivation and cost_used of each field."""
    aggs = []
    for f in FIELDS:
        at = F.when((F.col("field") == f) & F.col("value").isNotNull(), F.col("seq"))
        there = F.min(at).isNotNull()
        for c in ("value", "tolerance", "page_used", "derivation", "cost_used", "status"):
            if c in items.columns:
                aggs.append(F.when(there, F.min_by(c, at)).alias(f"{f}__{c}"))
    return items.groupBy("doc_id", "period_type").agg(*aggs)


def rules(items: DataFrame, pages: DataFrame) -> DataFrame:
    """CON1-CON3, CON5 per (doc_id, period_type): null if not applicable, else whether the rule holds."""
    w = wide(items)
    v = lambda f: F.col(f"{f}__value")
    tol = lambda *fs: sum((F.coalesce(F.col(f"{f}__tolerance"), F.lit(0.0)) for f in fs), F.lit(0.0))
    note = pages.select("doc_id", F.col("page").alias("net_income_common__page_used"), F.col("text").rlike(OTHER_EQUITY).alias("others"))
    w = w.join(note, ["doc_id", "net_income_common__page_used"], "left")
    base = F.coalesce(v("net_income_common"), v("net_income_parent"))
    ratio = F.try_divide(v("eps_basic") * v("weighted_avg_shares_basic"), base)
    out = w.withColumn("con1", v("gross_profit") <= v("revenue") + tol("gross_profit", "revenue"))
    out = out.withColumn("con1_cost", F.col("gross_profit__cost_used") >= 0 if "gross_profit__cost_used" in w.columns else F.lit(None).cast("boolean"))
    out = out.withColumn("con2", v("ppop") <= v("revenue") + tol("ppop", "revenue"))
    out = out.withColumn("con3", F.when(F.col("others"), v("net_income_parent") - v("net_income_common") > tol("net_income_parent", "net_income_common")))
    out = out.withColumn("con5", F.when((base != 0) & (v("eps_basic") != 0), ratio.between(0.5, 2.0)))
    return out.select("doc_id", "period_type", "con1", "con1_cost", "con2", "con3", "con5")


def disclosed_numbers(pages: DataFrame) -> DataFrame:
    """(doc_id, field, number): the first six numbers of 100 or more of each line labelled with a total."""
    lines = pages.select("doc_id", F.explode(F.split(for_numbers(F.col("text")), "\n")).alias("line"))
    label = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), f) for f, p in DISCLOSED.items()]))
    size = lambda x: F.regexp_replace(x, r"[()\-]", "").cast("double")
    numbers = F.transform(F.regexp_extract_all("line", F.lit(r"\(?-?\d+(?:\.\d+)?\)?"), F.lit(0)), lambda x: F.when(x.rlike(r"^[(\-]"), -size(x)).otherwise(size(x)))
    first = F.slice(F.filter(numbers, lambda x: F.abs(x) >= 100), 1, 6)
    return lines.select("doc_id", "line", F.explode(label).alias("field")).select("doc_id", "field", F.explode(first).alias("number"))


def disclosed_totals(items: DataFrame, pages: DataFrame) -> DataFrame:
    """CON4: (doc_id, seq, con4) of derived items that aren't BAD yet and whose total is printed: whether one agrees within 0.5 %."""
    own = items.where("derivation = 'derived' AND status <> 'BAD' AND value IS NOT NULL").select("doc_id", "seq", "field", "value")
    hit = F.exists(F.array(*map(F.lit, PRINTED)), lambda s: F.abs(F.col("number") * s - F.col("value")) <= 0.005 * F.abs("value"))
    return own.join(disclosed_numbers(pages), ["doc_id", "field"]).groupBy("doc_id", "seq").agg(F.bool_or(hit).alias("con4"))


def quarter_sums(items: DataFrame, prior: DataFrame) -> DataFrame:
    """CON6: (doc_id, field, con6): quarter + prior cumulative = cumulative, within 0.2 % and the tolerances."""
    own = items.where(F.col("field").isin(ADDITIVE) & F.col("value").isNotNull())
    q = F.when(F.col("period_type") == "Q", F.col("seq"))
    c = F.when(F.col("period_type").isin("H", "YTD", "FY"), F.col("seq"))
    w = own.groupBy("doc_id", "field").agg(*[F.min_by(x, k).alias(f"{n}_{x}") for n, k in (("q", q), ("c", c)) for x in ("value", "tolerance")], F.min(q).alias("q"), F.min(c).alias("c")).where("q IS NOT NULL AND c IS NOT NULL")
    w = w.join(prior.groupBy("doc_id", "field").agg(F.min_by("value", F.col("period_end")).alias("before")), ["doc_id", "field"])
    gap = F.abs(F.col("q_value") + F.col("before") - F.col("c_value"))
    return w.select("doc_id", "field", (gap <= F.col("q_tolerance") + F.col("c_tolerance") + 0.002 * F.abs("c_value")).alias("con6"))


def listed(flags: DataFrame, names: list[str]) -> DataFrame:
    """CON7: failed and passed rule names, in rule order, for boolean columns that are null where a rule didn't run."""
    failed = F.array_compact(F.array(*[F.when(~F.col(c), c) for c in names]))
    passed = F.array_compact(F.array(*[F.when(F.col(c), c) for c in names]))
    return flags.withColumn("failed", failed).withColumn("passed", passed)
