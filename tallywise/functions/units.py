"""Raw numbers, units and currencies (FN4-FN10, FN21). The unit grammar runs on distinct strings and is joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import nfkc

# Patterns in the order in which they are tried.
SCALES = [
    (r"十亿|billions?|\bbn\b", 9),
    (r"亿|億", 8),
    (r"千万|千萬", 7),
    (r"百万|百萬|millions?|\bmn\b|\bmm\b|\$m\b|\bm\b", 6),
    (r"万|萬", 4),
    (r"千|thousands?|'000|’000|\bk\b", 3),
]
RATIO = r"%|％|百分点|个百分点|percentage point|\bpp\b|\bbps?\b|基点|倍|\btimes\b|\bx\b"
PER_SHARE = r"/股|每股|per[ -]share|/share|per[ -]ads|/ads"
BASE = r"元|圆|\$|usd|rmb|cny|hkd|dollars?|户|人|家|个|辆|台|吨|千瓦时|gwh|mwh|kwh|users?|accounts?|股|份"
PER_SHARE_WORDS = r"/股|每股|per[ -](?:common |ordinary )?(?:share|ads)|/share|/ads"
SCALE_WORDS = r"十亿|亿|億|千万|千萬|百万|百萬|万|萬|千|billions?|millions?|thousands?|\bbn\b|\bmn\b|\bmm\b|'000|’000|\bin\b|\bof\b|\band\b|\bshares?\b|\bdata\b|\bamounts?\b|except\b|除外|[,，;；()（）]"
CENTS = r"仙|美分|\bcents?\b|¢"
CURRENCIES = [
    (r"港元|港币|港幣|港仙|hk\$|hkd|hk cents?", "HKD"),
    (r"美元|美仙|美分|us\$|usd|u\.s\. dollars?|us cents?|\$", "USD"),
    (r"人民币|人民幣|rmb|cny|renminbi", "CNY"),
    (r"欧元|eur|€", "EUR"),
    (r"英镑|gbp|£", "GBP"),
    (r"日元|jpy|円", "JPY"),
]


def digits_of(raw: Column) -> Column:
    """FN4: the bare number as it stands in a document; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(nfkc(raw), "[, ]", ""), r"\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit(""))


def parse_raw(raw: Column) -> Column:
    """FN5: decimal(24,8); brackets around, or a leading dash, make it negative."""
    negative = F.trim(nfkc(raw)).rlike(r"^\(.*\)$|^[-−–—]")
    value = digits_of(raw).try_cast("decimal(24,8)")
    return F.when(negative, -value).otherwise(value)


def decimals_of(raw: Column) -> Column:
    """FN6."""
    return F.when(digits_of(raw).isNotNull(), F.coalesce(F.length(F.try_element_at(F.split(digits_of(raw), r"\."), F.lit(2))), F.lit(0)))


def _clean(unit: Column) -> Column:
    return F.lower(F.trim(nfkc(unit)))


def unit_multiplier(unit: Column) -> Column:
    """FN7: struct(mult decimal(12,2), kind); null if empty or unknown. "Except ..." clauses don't describe the number."""
    u = F.regexp_replace(_clean(unit), r"except\b.*$", "")
    cut = F.regexp_replace(F.regexp_replace(u, r"[^,，;；(（]*除外.*$", ""), r"^[ ,，;；(（)）]+|[ ,，;；(（)）]+$", "")
    u = F.when(cut == "", u).otherwise(cut)
    give = lambda m, kind: F.struct(F.lit(m).cast("decimal(12,2)").alias("mult"), F.lit(kind).alias("kind"))
    out = F.when(_clean(unit) == "", None).when(u.rlike(RATIO), give(1, "ratio")).when(u.rlike(PER_SHARE), give(1, "per_share"))
    for pattern, power in SCALES:
        out = out.when(u.rlike(pattern), give(10**power, "amount"))
    return out.when(u.rlike(BASE), give(1, "amount"))


def per_share_multiplier(unit: Column) -> Column:
    """FN8: cents are 0.01; a table's amount scale is never inherited; unknown units are null."""
    u = _clean(unit)
    rest = F.trim(F.regexp_replace(u, SCALE_WORDS, " "))
    known = (rest == "") | rest.rlike(BASE) | currency_code(rest, F.lit(""), F.lit("us")).isNotNull() | currency_code(rest, F.lit(""), F.lit("a")).isNotNull()
    give = lambda m: F.struct(F.lit(m).cast("decimal(12,2)").alias("mult"), F.lit("per_share").alias("kind"))
    return F.when(u == "", None).when(u.rlike(CENTS), give("0.01")).when(u.rlike(PER_SHARE_WORDS) | known, give("1"))


def currency_code(currency: Column, unit: Column, market: Column) -> Column:
    """FN9: by currency words, then by the unit's; a bare yuan is CNY for market a, bare dollars USD for market us."""
    texts = [_clean(currency), _clean(unit)]
    out = None
    for t in texts:
        for pattern, code in CURRENCIES:
            out = F.when(t.rlike(pattern), code) if out is None else out.when(t.rlike(pattern), code)
    for t in texts:
        out = out.when(t.contains("元") & (market == "a"), "CNY")
    for t in texts:
        out = out.when(t.rlike(r"\bdollars?\b") & (market == "us"), "USD")
    return out


def unit_dictionary(df: DataFrame, per_share: Column, unit: str = "raw_unit", currency: str = "raw_currency", market: str = "market") -> DataFrame:
    """Distinct (unit, currency words, market, per share) with mult, kind and currency code: the grammar runs once for each."""
    keys = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((unit, "__u"), (currency, "__c"), (market, "__m"))], per_share.alias("__p")).distinct()
    parsed = F.when(F.col("__p"), per_share_multiplier(F.col("__u"))).otherwise(unit_multiplier(F.col("__u")))
    out = keys.withColumn("__parsed", parsed).withColumn("currency", currency_code(F.col("__c"), F.col("__u"), F.col("__m")))
    return out.select("__u", "__c", "__m", "__p", F.col("__parsed.mult").alias("__mult"), F.col("__parsed.kind").alias("kind"), "currency")


def to_value(df: DataFrame, raw: str = "raw_value", per_share: Column | None = None) -> DataFrame:
    """FN10: adds value, mult, kind, tolerance (half a unit of the last printed digit) and currency, from raw_value,
    raw_unit, raw_currency and market. Null where number or unit is unknown."""
    df = df.withColumn("__per_share", F.lit(False) if per_share is None else per_share)
    d = unit_dictionary(df, F.col("__per_share"))
    on = (F.coalesce("raw_unit", F.lit("")) == d["__u"]) & (F.coalesce("raw_currency", F.lit("")) == d["__c"]) & (F.coalesce("market", F.lit("")) == d["__m"]) & (F.col("__per_share") == d["__p"])
    out = df.join(d, on, "left").drop("__u", "__c", "__m", "__p", "__per_share")
    half = 5 * F.pow(F.lit(10.0), -(decimals_of(F.col(raw)) + 1)) * F.col("__mult").cast("double")
    out = out.withColumn("value", (parse_raw(F.col(raw)) * F.col("__mult")).cast("double")).withColumn("mult", F.col("__mult").cast("double"))
    return out.withColumn("tolerance", F.when(digits_of(F.col(raw)).isNotNull(), half)).drop("__mult")


# Display names of currencies and scales in Chinese and English.
CURRENCY_NAMES = {
    "zh": {"USD": "美元", "CNY": "人民币", "HKD": "港元", "EUR": "欧元", "JPY": "日元", "GBP": "英镑", "TWD": "新台币", "SGD": "新加坡元"},
    "en": {"USD": "USD", "CNY": "RMB", "HKD": "HKD", "EUR": "EUR", "JPY": "JPY", "GBP": "GBP", "TWD": "TWD", "SGD": "SGD"},
}
SCALE_NAMES = {
    "zh": {1: "", 10**3: "千", 10**4: "万", 10**6: "百万", 10**8: "亿", 10**9: "十亿"},
    "en": {1: "", 10**3: " thousands", 10**4: " ten-thousands", 10**6: " millions", 10**8: " hundred-millions", 10**9: " billions"},
}


def unit_label(currency: Column, mult: Column, per_share: Column, lang: str = "en") -> Column:
    """FN21: 'USD millions' and 'USD per share', in Chinese '百万美元' and '美元/股'; no multiplier is 1. Null if the
    currency or the scale is unknown."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES[lang].items() for x in kv]), currency)
    scale = F.element_at(F.create_map(*[F.lit(x) for k, v in SCALE_NAMES[lang].items() for x in (float(k), v)]), F.coalesce(F.nullif(mult.cast("double"), F.lit(0.0)), F.lit(1.0)))
    if lang == "zh":
        return F.when(per_share, F.concat(name, F.lit("/股"))).otherwise(F.concat(scale, name))
    return F.when(per_share, F.concat(name, F.lit(" per share"))).otherwise(F.concat(name, scale))
