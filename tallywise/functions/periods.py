"""Periods and aliases (FN11-FN15, FN22, FN23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc

# Months from the year's end, and the type of what is summed up to it.
BACK = {"FY": 0, "Q3": -3, "H1": -6, "Q2": -6, "Q1": -9}
CUMULATIVE = {"Q1": "Q", "H1": "H", "Q2": "H", "Q3": "YTD", "FY": "FY"}
# Parts of a calendar year in Chinese.
PARTS_ZH = {"Q1": "第一季度", "Q2": "第二季度", "H1": "上半年", "Q3": "第三季度", "FY": "全年"}
# Aliases of periods.
PERIOD_ALIASES = {
    "Q": ["q", "单季", "单季度", "三个月", "本季度", "quarter", "three months", "3m", "3 months"],
    "H": ["h", "h1", "半年", "六个月", "上半年", "中期", "six months", "6m", "half year", "6 months"],
    "YTD": ["ytd", "年初至今", "九个月", "前三季度", "nine months", "9m", "9 months"],
    "FY": ["fy", "全年", "年度", "十二个月", "full year", "year", "12m", "annual"],
    "PIT": ["pit", "时点", "期末"],
}
FIELD_ALIASES = {
    "revenue": ["营业收入", "收入", "营收", "營業收入", "營業額", "收益", "revenue", "revenues", "total revenues", "total revenue", "net sales", "total net sales", "net revenue", "total net revenue"],
    "net_income_parent": ["归母净利润", "归属于母公司股东的净利润", "归属于母公司所有者的净利润", "本公司拥有人应占溢利", "net income attributable", "net income attributable to parent", "net income", "profit attributable to owners", "profit attributable to equity holders"],
    "eps_basic": ["基本每股收益", "每股收益", "基本eps", "eps", "basic eps", "basic earnings per share", "earnings per share basic"],
    "gross_profit": ["毛利", "毛利润", "gross profit", "gross margin"],
    "operating_cash_flow": ["经营活动现金流量净额", "经营活动产生的现金流量净额", "经营现金流", "operating cash flow", "net cash provided by operating activities", "net cash from operating activities", "cfo"],
    "net_interest_income": ["净利息收入", "利息净收入", "net interest income"],
    "ppop": ["拨备前利润", "pre-provision profit", "ppop"],
    "insurance_revenue": ["保险服务收入", "insurance revenue"],
    "insurance_service_result": ["保险服务业绩", "insurance service result"],
    "cost_of_revenue": ["营业成本", "cost of revenue", "cost of revenues", "cost of sales"],
}
HEADER_WORDS = {
    "field": ["指标", "科目", "项目", "metric", "item", "field", "line item"],
    "raw_value": ["数值", "提取数值", "数字", "金额", "value", "amount", "figure", "raw_value"],
    "raw_unit": ["单位", "报告单位", "unit", "units", "raw_unit"],
    "raw_currency": ["币种", "货币", "currency", "raw_currency"],
    "period_type": ["期间", "期间类型", "period", "period type", "period_type"],
    "page": ["页码", "出现页码", "页", "page", "page no", "page number"],
    "quote": ["原文", "原文句子", "原文引用", "引用", "quote", "source", "source quote", "source text"],
}


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def period_year(label: Column) -> Column:
    """FN11: null unless the label reads like 2026H1."""
    return F.nullif(F.regexp_extract(F.upper(label), r"^(\d{4})(H1|Q1|Q2|Q3|FY)$", 1), F.lit("")).cast("int")


def period_part(label: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(label), r"^(\d{4})(H1|Q1|Q2|Q3|FY)$", 2), F.lit(""))


def period_end(label: Column, fye: Column) -> Column:
    """FN12: the fiscal year's end itself for FY, else the end of the month so many months before."""
    end = F.make_date(period_year(label), F.substring(fye, 1, 2).cast("int"), F.substring(fye, 4, 2).cast("int"))
    back = F.element_at(_map(BACK.items()), period_part(label))
    return F.when(back == 0, end).otherwise(F.last_day(F.add_months(end, back)))


def cumulative_type(part: Column) -> Column:
    """FN13."""
    return F.element_at(_map(CUMULATIVE.items()), part)


def type_from_days(days: Column) -> Column:
    """FN14."""
    return F.when(days <= 100, "Q").when(days.between(170, 190), "H").when(days.between(350, 371), "FY").when(days.isNotNull(), "YTD")


def field_of(name: Column) -> Column:
    """FN15: canonical field of an alias; a bracketed suffix doesn't count."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(nfkc(name))), r"[（(].*?[)）]", ""))
    return F.element_at(_map([(a, f) for f, names in FIELD_ALIASES.items() for a in dict.fromkeys([*names, f])]), t)


def period_of(text: Column, default: Column) -> Column:
    """FN15: an alias, else the longest alias of over two characters that the text contains."""
    t = F.lower(F.trim(nfkc(text)))
    aliases = [(a, p) for p, names in PERIOD_ALIASES.items() for a in names]
    out = F.when(t == "", default).when(t.isin([a for a, _ in aliases]), F.element_at(_map(aliases), t))
    for a, p in sorted(aliases, key=lambda x: -len(x[0])):
        if len(a) > 2:
            out = out.when(t.contains(a), p)
    return out


def role_of(word: Column) -> Column:
    """FN15: role of a table header."""
    return F.element_at(_map([(w, r) for r, words in HEADER_WORDS.items() for w in words]), F.lower(F.trim(word)))


def period_label(period: Column, end: Column, lang: str = "en") -> Column:
    """FN22: struct(label, fiscal); fiscal if the end is over 15 days off the calendar's. A label that isn't a period,
    or has no end, stays as it is."""
    part, year = period_part(period), period_year(period).cast("string")
    fiscal = F.coalesce(F.abs(F.datediff(end, period_end(period, F.lit("12-31")))) > 15, F.lit(False))
    tail = F.when(part == "FY", "").otherwise(F.concat(F.lit(" "), part))
    shifted = F.concat(F.lit("FY"), year, tail, F.lit("（财年）" if lang == "zh" else " (fiscal)"))
    if lang == "zh":
        plain = F.concat(year, F.lit(" 年"), F.element_at(_map(PARTS_ZH.items()), part))
    else:
        plain = F.when(part == "FY", F.concat(F.lit("FY"), year)).otherwise(F.concat(part, F.lit(" "), year))
    label = F.when(part.isNull() | end.isNull(), F.coalesce(period, F.lit(""))).when(fiscal, shifted).otherwise(plain)
    return F.struct(label.alias("label"), (fiscal & part.isNotNull()).alias("fiscal"))


def change_words(delta: Column, unit: str = "%", lang: str = "en") -> Column:
    """FN23: direction in words and an unsigned magnitude, flat if it rounds to 0."""
    size = F.replace(F.format_number(F.abs(delta), 1), F.lit(","))
    if lang == "zh":
        up, down = ("增长 ", "下降 ") if unit == "%" else ("增加 ", "减少 ")
        return F.when(size == "0.0", "持平").otherwise(F.concat(F.when(delta > 0, up).otherwise(down), size, F.lit("%" if unit == "%" else " 个百分点")))
    words = F.concat(F.when(delta > 0, "up ").otherwise("down "), size, F.lit("%" if unit == "%" else " percentage points"))
    return F.when(size == "0.0", "flat").otherwise(words)
