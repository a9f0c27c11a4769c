"""Site-relative line frequency, with DataFrame operations only.

A line's share of a host is the number of the host's pages that contain it over all pages of the host; lines above
``max_ratio`` are boilerplate and dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: A line is boilerplate above this share of its host's pages; a line of one page only never is.
MAX_RATIO, MIN_PAGES = 0.3, 2
#: Boilerplate lines up to which they are broadcast; more are joined by shuffling.
BROADCAST_LINES = 200_000


def markup(html: Column) -> Column:
    """A page without its scripts, styles and comments; null is empty."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->)", " ")


def html_lines(html: Column) -> Column:
    """Visible lines of a page: scripts, styles and comments go, block tags end lines, other tags vanish."""
    cut = F.split(markup(html), r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|title|head|body|html|nav|article|section|header|footer|br|main|aside|blockquote|pre)(?:\s[^>]*)?/?>|\n")
    return F.transform(cut, lambda x: entities(F.regexp_replace(x, "<[^>]*>", "")))


def entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f"))


def _key(line: Column) -> Column:
    """Stands for a trimmed line: 64 and 32 bits of two hashes, and its length."""
    return F.concat_ws(".", F.xxhash64(line), F.hash(line), F.length(line))


def boilerplate(pages: DataFrame, host: str, lines: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): the keys of each host's boilerplate lines. Blank lines are never boilerplate."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines, _trimmed), lambda x: x != ""), _key))
    own = pages.select(F.coalesce(F.col(host), F.lit("")).alias("host"), keys.alias("keys"))
    seen = own.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    # a line of too few pages can't exceed the ratio; the host's total is needed only for the others
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    return seen.join(totals, "host").where(F.col("n") > max_ratio * F.col("pages")).groupBy("host").agg(F.collect_set("key").alias("boiler"))


def drop_boilerplate(pages: DataFrame, host: str, lines: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``pages`` but ``lines`` changed to the kept lines, plus n_lines and n_dropped (long).

    Null hosts form one group; null lines are none; blank lines stay. A line goes if it stands on at least
    ``min_pages`` pages of its host and on more than ``max_ratio`` of them; repeated rows count as pages of their own.
    An empty table gives none. Columns n_lines and n_dropped that are there already are overwritten; none may be named
    __host, __boiler or __kept.
    Per host there are at most mean-lines-a-page / max_ratio such lines, so they are gathered per host; their table is
    broadcast only up to a checked size and otherwise joined by host.
    """
    found = materialise(boilerplate(pages, host, lines, max_ratio, min_pages), "boilerplate")
    small = found.select(F.sum(F.size("boiler"))).first()[0] or 0
    found = found.select(F.col("host").alias("__host"), F.col("boiler").alias("__boiler"))
    found = F.broadcast(found) if small <= BROADCAST_LINES else found
    joined = pages.join(found, F.coalesce(pages[host], F.lit("")) == F.col("__host"), "left")
    kept = F.filter(lines, lambda x: F.col("__boiler").isNull() | ~F.array_contains("__boiler", _key(_trimmed(x))))
    out = joined.withColumn("__kept", kept).withColumn("n_lines", F.coalesce(F.size(F.col(lines)), F.lit(0)).cast("long"))
    return out.withColumn("n_dropped", F.col("n_lines") - F.coalesce(F.size("__kept"), F.lit(0))).withColumn(lines, F.col("__kept")).drop("__kept", "__boiler", "__host")
