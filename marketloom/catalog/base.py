"""Registration of named queries with their ANSI-SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketloom.sources.tables import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# SQL forms of the canonical views, in dependency order.
VIEWS: dict[str, str] = {
    "assets": """SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS asset_id,
        p_brand AS ticker, min(p_type) AS asset_name FROM part GROUP BY p_brand""",
    "bars": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close,
        CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "price_daily": """SELECT CAST(regexp_extract(ticker, '[0-9]+') AS INTEGER) AS asset_id, ticker,
        d, (high + low) / 2 AS open, high, low, close, volume FROM bars""",
    "prices": """SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS return_1d,
        (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS pct_change,
        row_number() OVER w AS rn
        FROM price_daily WINDOW w AS (PARTITION BY asset_id ORDER BY d)""",
    "mentions": """SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS asset_id,
        p_brand AS ticker, l_suppkey AS source_id, CAST(l_shipdate AS DATE) AS published_d,
        round((l_discount - 0.05) * 20, 2) AS sentiment_score,
        CASE WHEN l_discount >= 0.055 THEN 'pos' WHEN l_discount <= 0.045 THEN 'neg'
             ELSE 'neu' END AS sentiment_label
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sentiment_daily": """SELECT asset_id, published_d AS d,
        CAST(count(sentiment_score) AS BIGINT) AS news_count,
        round(avg(sentiment_score), 12) + 0.0 AS sentiment_mean, median(sentiment_score) AS sentiment_median,
        count(*) FILTER (WHERE sentiment_label = 'pos') AS pos_count,
        count(*) FILTER (WHERE sentiment_label = 'neu') AS neu_count,
        count(*) FILTER (WHERE sentiment_label = 'neg') AS neg_count
        FROM mentions GROUP BY 1, 2""",
    "metrics": """SELECT p.*, s.sentiment_mean AS sentiment_index, s.news_count
        FROM prices p LEFT JOIN sentiment_daily s ON s.asset_id = p.asset_id AND s.d = p.d""",
    "lagged": """SELECT *, lag(sentiment_index, 1) OVER w AS sentiment_lag1,
        lag(sentiment_index, 2) OVER w AS sentiment_lag2
        FROM metrics WINDOW w AS (PARTITION BY asset_id ORDER BY d)""",
    "headlines": """SELECT event_id, CAST(user_id % 25 + 1 AS INTEGER) AS asset_id,
        'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS ticker,
        'src' || CAST(user_id % 20 AS VARCHAR) AS source_name, ts AS published_at,
        CAST(ts AS DATE) AS published_d, event_type || ' ' || props AS title,
        'http://n/' || CAST(user_id AS VARCHAR) AS url,
        round(least(greatest((value - 20) / 40, -1.0), 1.0), 5) AS sentiment_score
        FROM events""",
    "facts": """SELECT CAST(o_custkey % 25 + 1 AS INTEGER) AS entity_id, o_orderpriority AS tag,
        CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
        CASE WHEN o_orderkey % 5 = 0 THEN last_day(CAST(o_orderdate AS DATE)) - 364
             ELSE last_day(CAST(o_orderdate AS DATE)) - 90 END AS start_d,
        last_day(CAST(o_orderdate AS DATE)) AS end_d,
        last_day(CAST(o_orderdate AS DATE)) + CAST(o_orderkey % 60 + 1 AS INTEGER) AS filed_d,
        o_totalprice AS val, o_orderkey AS pos FROM orders""",
    "news_text": """SELECT dc.doc_id, dc.text, dc.lang, dc.source, lb.quality, lb.toxic
        FROM documents dc LEFT JOIN labels lb ON lb.doc_id = dc.doc_id""",
    "dim_source": "SELECT s_suppkey AS source_id, s_name AS source_name FROM supplier",
}


def view(name: str, sql: str) -> None:
    """Declare a further shared SQL view for the equivalents."""
    VIEWS[name] = sql


def _mentions(name: str, text: str) -> bool:
    return re.search(rf"(?<![\w.]){name}(?![\w(])", text) is not None


def expand(body: str) -> str:
    """Prepend the views `body` uses, directly or through other views."""
    needed: set[str] = set()
    for name in reversed(list(VIEWS)):
        if _mentions(name, body) or any(_mentions(name, VIEWS[n]) for n in needed):
            needed.add(name)
    ctes = [f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed]
    body = body.strip()
    own = body if not body.upper().startswith("SELECT") else None
    if not ctes:
        return f"WITH {own}" if own else body
    head = "WITH " + ", ".join(ctes)
    return f"{head}, {own}" if own else f"{head} {body}"


def query(name: str, sql: str | None = None, dates: str = "", doubles: str = ""):
    """Register `fn(market) -> DataFrame` as a query. `sql` is its equivalent;
    it may start with further common table expressions. Columns named in
    `dates` leave as ISO text and nullable counts named in `doubles` as doubles
    on both sides, so that every reader sees the same type."""
    casts = {**{c: "string" for c in dates.split()}, **{c: "double" for c in doubles.split()}}
    sql_types = {"string": "VARCHAR", "double": "DOUBLE"}

    def wrap(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Market(spark, folder))
            return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}) if casts else df

        QUERIES[name] = run
        if sql is not None:
            text = expand(sql)
            if casts:
                parts = ", ".join(f"CAST({c} AS {sql_types[t]}) AS {c}" for c, t in casts.items())
                text = f"SELECT * REPLACE ({parts}) FROM ({text})"
            ORACLE[name] = text
        return fn
    return wrap
