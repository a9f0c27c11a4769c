"""Input tables of the claim-checking queries, derived from the star schema in SQL that both engines read.

A filing is a nation's quarter; its facts are totals of that quarter's orders, its pages print them, and claims copy
them with errors chosen by key modulus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import materialise

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


view(
    "quarters",
    """SELECT c_nationkey AS nk, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
  CAST(floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100000) AS BIGINT) AS rev, CAST(count(*) AS BIGINT) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate), quarter(o_orderdate)""",
)
view(
    "filings",
    """SELECT CASE n_regionkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'a' ELSE 'hk' END AS market, 'N' || CAST(nk AS STRING) AS code,
  CAST(y AS STRING) || CASE q WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' WHEN 3 THEN 'Q3' ELSE 'FY' END AS period,
  CASE n_regionkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'a' ELSE 'hk' END || ':N' || CAST(nk AS STRING) || ':' || CAST(y AS STRING) || 'Q' || CAST(q AS STRING) AS doc_id,
  nk, y, q, rev, n, last_day(make_date(y, q * 3, 1)) AS period_end, make_date(y, q * 3 - 2, 1) AS quarter_start, make_date(y, 1, 1) AS year_start,
  sum(rev) OVER (PARTITION BY nk, y ORDER BY q ROWS UNBOUNDED PRECEDING) AS rev_cum,
  CASE nk % 5 WHEN 3 THEN 'bank' WHEN 4 THEN 'insurance' ELSE 'general' END AS template
  FROM quarters JOIN nation ON nk = n_nationkey""",
)
view(
    "figures",
    """SELECT doc_id, market, nk, y, q, period_end, quarter_start, year_start, template, 1 AS fno, 'revenue' AS field, 'Q' AS period_type, rev AS v FROM filings
  UNION ALL SELECT doc_id, market, nk, y, q, period_end, quarter_start, year_start, template, 2, 'net_income_parent', 'Q', CAST(floor(rev / 10) AS BIGINT) FROM filings
  UNION ALL SELECT doc_id, market, nk, y, q, period_end, quarter_start, year_start, template, 3, 'cost_of_revenue', 'Q', CAST(floor(rev * 6 / 10) AS BIGINT) FROM filings
  UNION ALL SELECT doc_id, market, nk, y, q, period_end, quarter_start, year_start, template, 4, 'operating_cash_flow', 'Q', CAST(floor(rev / 8) AS BIGINT) FROM filings
  UNION ALL SELECT doc_id, market, nk, y, q, period_end, quarter_start, year_start, template, 5, 'revenue', CASE q WHEN 1 THEN 'Q' WHEN 2 THEN 'H' WHEN 3 THEN 'YTD' ELSE 'FY' END, CAST(rev_cum AS BIGINT) FROM filings WHERE q > 1
  UNION ALL SELECT doc_id, market, nk, y, q, period_end, quarter_start, year_start, template, 6, 'eps_basic', 'Q', CAST(floor(rev / 100) AS BIGINT) FROM filings""",
)
view(
    "facts",
    """SELECT doc_id, CAST(fno AS BIGINT) AS ord, field, period_type, period_end,
  CASE WHEN field = 'eps_basic' THEN CAST(v AS DOUBLE) / 100 ELSE CAST(v AS DOUBLE) * 1000 END AS value,
  CASE WHEN market = 'us' THEN 'USD' WHEN market = 'a' THEN 'CNY' END AS currency
  FROM figures WHERE (nk + y + q + fno) % 9 <> 0""",
)
view(
    "claims",
    """SELECT doc_id, market, template, CAST(fno AS INT) AS seq, field, v, p,
  CASE WHEN p = 5 THEN '(' || CAST(v AS STRING) || ')' WHEN p = 0 THEN CAST(v * 10 + 7 AS STRING) WHEN field = 'eps_basic' THEN CAST(CAST(floor(v / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(v % 100 AS STRING), 2, '0') ELSE CAST(v AS STRING) END AS raw_value,
  CASE WHEN p = 1 THEN 'in millions' WHEN p = 4 THEN 'widgets' WHEN field = 'eps_basic' THEN 'per share' ELSE 'in thousands, except per share data' END AS raw_unit,
  CASE WHEN p = 6 THEN '' WHEN market = 'us' THEN 'USD' WHEN market = 'a' THEN 'RMB' ELSE 'HK$' END AS raw_currency,
  CASE WHEN p = 7 THEN 'FY' ELSE period_type END AS period_type,
  CASE WHEN period_type = 'Q' THEN CAST(quarter_start AS STRING) ELSE CAST(year_start AS STRING) END AS period_start,
  CASE WHEN p = 8 THEN CAST(quarter_start AS STRING) ELSE CAST(period_end AS STRING) END AS period_end,
  CASE WHEN p = 2 THEN 1 WHEN p = 3 THEN 3 ELSE 2 END AS page,
  CASE WHEN p = 9 THEN 'something not printed ' || CAST(v AS STRING) ELSE 'Line ' || CAST(fno AS STRING) || ' ' || field || ':  ' || CAST(v AS STRING) END AS quote, period_end AS doc_end
  FROM (SELECT *, (nk * 31 + y * 7 + q * 3 + fno * 5) % 13 AS p FROM figures) WHERE p <> 12
  UNION ALL
  SELECT doc_id, market, template, CAST(fno + 10 AS INT), field, v, 13, CAST(v + 1 AS STRING), 'in thousands', 'USD', period_type, CAST(quarter_start AS STRING), CAST(period_end AS STRING), 2, 'again', period_end
  FROM figures WHERE fno = 1 AND nk % 4 = 0""",
)
view(
    "lines",
    """SELECT doc_id, 2 AS page, fno AS line_no, 'Line ' || CAST(fno AS STRING) || ' ' || field || ': ' || CAST(v AS STRING) AS line FROM figures
  UNION ALL SELECT doc_id, 1, 1, 'Highlights of ' || period || ', consolidated' FROM filings
  UNION ALL SELECT doc_id, 3, 1, 'Statements of cash flows, in thousands' FROM filings
  UNION ALL SELECT doc_id, 3, 2, CASE WHEN nk % 2 = 0 THEN 'Other equity holders ' ELSE 'Holders ' END || CAST(rev + 11 AS STRING) FROM filings""",
)


def deps(sql: str) -> list[str]:
    """Views that the text needs, each after those it needs itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"(?<![.\w'`]){name}\b", text):
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str, given: Iterable[str] = ()) -> str:
    """The text with the views it needs in front, but for given ones, as one statement."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in deps(sql) if v not in given]
    body = sql.strip()
    head = re.match(r"(?i)WITH (RECURSIVE )?", body)
    if head:
        return head[0] + ", ".join([*parts, body[head.end() :]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs portable SQL over the tables of a folder; quarters, which filings and figures read many times, are summed up
    from the orders once and written."""
    once = {"quarters": load(spark, sf_dir, "quarters")} if "quarters" in deps(sql) and sql != QUARTERS else {}
    text = with_views(sql, once).replace("{", "{{").replace("}", "}}")
    given = once | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"(?:FROM|JOIN)\s+{t}\b", text)}
    text = re.sub(rf"((?:FROM|JOIN)\s+)({'|'.join(given) or '-'})\b", lambda m: f"{m[1]}{{{m[2]}}}", text)
    return spark.sql(text, **given)


#: What ``load`` reads of them.
QUARTERS = "SELECT * FROM quarters"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written once: queries use it several times."""
    return materialise(read(spark, sf_dir, f"SELECT * FROM {name}"), name)
