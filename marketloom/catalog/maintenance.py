"""Intake, table rules and maintenance jobs. Jobs that need stored tables build
them from the given ones below the shared scratch folder first. Conditions on
keys and dates below deal the whole tables out to the sides a rule needs: stored
and incoming, primary and secondary provider, purged and kept."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.catalog.filings import filings
from marketloom.catalog.news import CRED_SQL, publishers
from marketloom.catalog.quality import dirty_prices
from marketloom.functions import params as P
from marketloom.functions import text as T
from marketloom.functions.numeric import r
from marketloom.operators import news as N
from marketloom.operators import returns, signals
from marketloom.plans import dashboard, maintenance
from marketloom.session import scratch_path
from marketloom.sources import feeds, prices as S
from marketloom.sources import filings as FS
from marketloom.sources import store as ST
from marketloom.sources.tables import Market


def rows():
    return F.count(F.lit(1))


@query("price_intake", """SELECT ticker, d, open, high, low, close, close AS adj_close, volume FROM price_daily
    WHERE NOT (month(d) = 2 AND day(d) = 13)""", "d")
def price_intake(m: Market):
    path = scratch_path(m.spark, "provider-csv")
    close = F.when(~((F.month("d") == 2) & (F.dayofmonth("d") == 13)), F.col("close"))
    m.price_daily.select(
        F.col("ticker").alias("Ticker"), F.col("d").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), close.alias("Close"), close.alias("Adj Close"), F.col("volume").alias("Volume")
    ).write.csv(path, header=True)
    return S.read_provider(m.spark, path)


@query("daily_file_intake", """SELECT upper(ticker) AS ticker, d, open, high, low, close, CAST(NULL AS DOUBLE) AS adj_close, CAST(0 AS BIGINT) AS volume
    FROM price_daily WHERE d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""", "d")
def daily_file_intake(m: Market):
    path = scratch_path(m.spark, "daily-csv")
    m.price_daily.select("asset_id", F.col("d").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
                         F.col("low").alias("Low"), F.col("close").alias("Close")).write.partitionBy("asset_id").csv(path, header=True)
    layout = "Date date, Open double, High double, Low double, Close double"
    ticker = F.concat(F.lit("brand#"), F.regexp_extract(F.input_file_name(), r"asset_id=(\d+)", 1))
    return S.read_daily_files(m.spark, path, ticker, dt.date(1997, 1, 1), dt.date(1999, 12, 31), layout)


@query("wide_to_long", "SELECT d, ticker, close, volume FROM price_daily", "d")
def wide_to_long(m: Market):
    tickers = [f"Brand#{i}" for i in range(1, 26)]
    wide = m.price_daily.groupBy("d").agg(*[
        F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{f}|{t}") for t in tickers for f in ("close", "volume")])
    return S.wide_to_long(wide, "d", tickers, ["close", "volume"])


@query("provider_fallback", """SELECT ticker, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM
    (SELECT ticker, volume FROM price_daily WHERE asset_id % 3 = 0 AND d >= DATE '1999-01-01' UNION ALL SELECT ticker, volume FROM price_daily WHERE asset_id % 3 <> 0) GROUP BY 1""")
def provider_fallback(m: Market):
    primary = m.price_daily.filter((F.col("asset_id") % 3 == 0) & (F.col("d") >= "1999-01-01")).drop("open")
    both = S.with_fallback(primary, m.price_daily)
    return both.groupBy("ticker").agg(rows().alias("n"), F.sum("volume").alias("volume"))


@query("gap_fill", """s AS (SELECT ticker, d FROM price_daily WHERE day(d) % 10 <> 3),
    w AS (SELECT ticker, CAST(u AS DATE) AS d FROM (SELECT DISTINCT ticker FROM s), (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS u)
      WHERE isodow(u) <= 5),
    x AS (SELECT w.ticker, w.d, p.close FROM w LEFT JOIN s ON s.ticker = w.ticker AND s.d = w.d LEFT JOIN price_daily p ON p.ticker = w.ticker AND p.d = w.d WHERE s.d IS NULL)
    SELECT ticker, count(close) AS n_filled, count(*) - count(close) AS n_skipped FROM x GROUP BY 1""")
def gap_fill(m: Market):
    stored = m.price_daily.filter(F.dayofmonth("d") % 10 != 3).select("ticker", "d")
    fetched = m.price_daily.select("ticker", "d", "close")
    return S.gap_fill_summary(S.gap_fill(stored, fetched, dt.date(1998, 1, 1), dt.date(1998, 12, 31)))


@query("feed_intake", """SELECT event_id, ticker, CASE WHEN event_id % 7 = 0 THEN 'feeds.example.com' ELSE source_name END AS source_name,
    CASE WHEN event_id % 7 = 0 THEN 'https://www.feeds.example.com' ELSE 'http://pub/' || source_name END AS base_url,
    date_trunc('second', published_at) AS published_at, title, url FROM headlines WHERE event_id % 11 <> 0""")
def feed_intake(m: Market):
    eid = F.col("event_id")
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    offset = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = (F.when(eid % 11 == 0, "<pubDate>soon</pubDate>").when(eid % 11 == 1, F.concat(F.lit("<updated>"), iso, F.lit("</updated>")))
             .when(eid % 11 == 2, F.concat(F.lit("<pubDate>"), offset, F.lit("</pubDate>")))
             .otherwise(F.concat(F.lit("<pubDate>"), rfc, F.lit("</pubDate>"))))
    src = F.when(eid % 7 == 0, "").otherwise(F.concat(F.lit('<source url="http://pub/'), "source_name", F.lit('">'), "source_name", F.lit("</source>")))
    xml = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), "url", F.lit("</link>"), stamp, src, F.lit("</item>"))
    items = m.headlines.select("event_id", "ticker", xml.alias("xml"), F.lit("https://www.feeds.example.com/rss?q=x").alias("feed"))
    return feeds.parse_items(items, "xml", "feed")


@query("nested_facts", """SELECT entity_id, tag, unit, start_d, end_d, val, filed_d FROM filings WHERE pos % 13 <> 0""", "start_d end_d filed_d")
def nested_facts(m: Market):
    fact = F.struct(F.col("start_d").cast("string").alias("start"), F.col("end_d").cast("string").alias("end"),
                    F.when(F.col("pos") % 13 != 0, F.col("val")).alias("val"), F.col("filed_d").cast("string").alias("filed"))
    units = F.struct(F.map_from_arrays(F.array("unit"), F.array(F.array(fact))).alias("units"))
    payload = F.to_json(F.map_from_arrays(F.array("tag"), F.array(units)))
    return FS.flatten_facts(filings(m).select("entity_id", payload.alias("json")), "entity_id", "json").drop("pos")


FORMS = ["10-K", "10-Q", "8-K", "4", "DEF 14A"]


def _index(m: Market):
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " +"), lambda w: F.length(w) > 0)
    forms = F.array(*[F.lit(f) for f in FORMS])
    return m.table("documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("cik"), words.alias("w")).select(
        "doc_id", "cik", F.transform("w", lambda x: F.element_at(forms, F.length(x) % 5 + 1)).alias("form"),
        F.transform("w", lambda x: F.concat(F.lit("0-"), x)).alias("accession"),
        F.transform("w", lambda x: F.lit("2020-01-31")).alias("filed"),
        F.transform("w", lambda x: F.concat(x, F.lit(".htm"))).alias("document"))


@query("filing_index", r"""w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +'), lambda x: length(x) > 0) AS w FROM documents),
    f AS (SELECT doc_id, list_filter(w, lambda x: length(x) % 5 < 3) AS k, list_filter(w, lambda x: length(x) % 5 = 0)[1] AS k10 FROM w)
    SELECT doc_id, array_to_string(list_transform(k[1:8], lambda x: ['10-K', '10-Q', '8-K'][length(x) % 5 + 1] || ' 0-' || x), ',') AS recent, CAST(least(len(k), 8) AS INTEGER) AS n,
      '0-' || k10 AS latest_10k_accession, CASE WHEN k10 IS NOT NULL THEN '2020-01-31' END AS latest_10k_filed,
      'https://www.sec.gov/Archives/edgar/data/' || CAST(doc_id AS VARCHAR) || '/0' || k10 || '/' || k10 || '.htm' AS latest_10k_url FROM f""", "latest_10k_filed")
def filing_index(m: Market):
    x = FS.filing_index(_index(m))
    recent = F.array_join(F.transform("recent_filings", lambda e: F.concat(e["form"], F.lit(" "), e["accession"])), ",")
    return x.select("doc_id", recent.alias("recent"), F.size("recent_filings").alias("n"), "latest_10k_accession", "latest_10k_filed", "latest_10k_url")


@query("registrant_profiles", """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS sic_description,
    CASE WHEN c_custkey % 3 = 0 AND c_mktsegment = 'MACHINERY' THEN NULL WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_mktsegment = 'MACHINERY' THEN n_name
      ELSE n_name || ', ' || c_mktsegment END AS exchanges FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def registrant_profiles(m: Market):
    raw = m.table("customer").join(m.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment"))
    listed = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(""), seg)).otherwise(F.array("n_name", seg))
    df = raw.select("c_custkey", seg.alias("sic_description"), FS.joined_list(listed).alias("exchanges"))
    return FS.blank_to_null(df, ["sic_description"])


@query("statement_rows", """y AS (SELECT ticker, CAST(year(d) AS INTEGER) AS y, CAST(sum(volume) AS DOUBLE) AS revenue, max(close) AS net_income FROM price_daily GROUP BY 1, 2)
    SELECT ticker, make_date(y, 12, 31) AS fiscal_period_end, CASE WHEN y <> 1996 THEN revenue END AS revenue, CASE WHEN y <> 1996 THEN net_income END AS net_income,
      CAST(NULL AS DOUBLE) AS eps_diluted, CASE WHEN y <> 1996 THEN round(net_income / nullif(revenue, 0), 6) END AS net_margin FROM y WHERE y BETWEEN 1995 AND 2001 AND y <> 1996""", "fiscal_period_end")
def statement_rows(m: Market):
    years = list(range(1995, 2002))
    of = lambda y, c: F.when((F.year("d") == y) & (y != 1996), c)
    wide = m.price_daily.groupBy("ticker").agg(*[F.sum(of(y, F.col("volume"))).cast("double").alias(f"r{y}") for y in years],
                                               *[F.max(of(y, F.col("close"))).alias(f"i{y}") for y in years])
    items = F.array(*[F.struct(F.lit(name).alias("item"), *[F.col(f"{p}{y}").alias(f"y{y}") for y in years])
                      for name, p in (("Total Revenue", "r"), ("Net Income", "i"))])
    matrix = wide.select("ticker", F.inline(items))
    s = FS.statement_rows(matrix, "ticker", "item", {f"y{y}": f"{y}-12-31" for y in years})
    return s.select("ticker", "fiscal_period_end", "revenue", "net_income", "eps_diluted", F.round("net_margin", 6).alias("net_margin"))


@query("registrant_ids", """SELECT upper(c_name) AS ticker, CASE WHEN upper(c_name) = 'CUSTOMER#000000007' THEN '0000034088' ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer""")
def registrant_ids(m: Market):
    return FS.registrant_ids(m.table("customer"), "c_name", "c_custkey", {"CUSTOMER#000000007": "0000034088"})


def price_store(m: Market, px) -> ST.Store:
    s = ST.Store(m.spark, scratch_path(m.spark, "store"))
    s.upsert("fact_price_daily", px)
    return s


@query("keyed_upsert", """SELECT ticker, d, CASE WHEN d >= DATE '1999-07-01' THEN close * 2 ELSE close END AS close FROM price_daily
    WHERE d < DATE '2000-01-01' OR d >= DATE '1999-07-01'""", "d")
def keyed_upsert(m: Market):
    s = price_store(m, m.price_daily.filter(F.col("d") < "2000-01-01"))
    batch = m.price_daily.filter(F.col("d") >= "1999-07-01").withColumn("close", F.col("close") * 2)
    s.upsert("fact_price_daily", batch)
    return s.read("fact_price_daily").select("ticker", "d", "close")


@query("insert_ignore", """SELECT ticker, count(*) AS n FROM headlines GROUP BY 1""")
def insert_ignore(m: Market):
    s = ST.Store(m.spark, scratch_path(m.spark, "store"))
    h = N.with_hash(m.headlines)
    s.insert_ignore("fact_news", h.filter(F.dayofmonth("published_d") <= 20))
    s.insert_ignore("fact_news", h.filter(F.dayofmonth("published_d") >= 10).unionByName(h.filter(F.dayofmonth("published_d") == 25)))
    return s.read("fact_news").groupBy("ticker").agg(rows().alias("n"))


@query("coalesce_upsert", f"""o AS (SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'http://old/' || source_id END AS base_url, 1.0 AS credibility_score, 'd' || source_id AS descr
      FROM publishers WHERE source_id % 3 <> 0),
    n AS (SELECT source_id, 'http://new/' || source_id AS base_url, CAST({CRED_SQL} AS DOUBLE) AS credibility_score, CASE WHEN source_id % 5 = 0 THEN 'n' || source_id END AS descr
      FROM publishers WHERE source_id % 4 <> 0)
    SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.base_url, n.base_url) AS base_url,
      CASE WHEN n.source_id IS NOT NULL THEN n.credibility_score ELSE o.credibility_score END AS credibility_score, coalesce(n.descr, o.descr) AS descr
    FROM o FULL JOIN n ON n.source_id = o.source_id""")
def coalesce_upsert(m: Market):
    p, k = publishers(m), F.col("source_id")
    t = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    old = p.filter(k % 3 != 0).select(k, F.when(k % 2 == 0, t("http://old/")).alias("base_url"), F.lit(1.0).alias("credibility_score"), t("d").alias("descr"))
    new = p.filter(k % 4 != 0).select(k, t("http://new/").alias("base_url"), T.credibility("source_name").alias("credibility_score"), F.when(k % 5 == 0, t("n")).alias("descr"))
    return ST.coalesce_upsert(old, new, ["source_id"], keep_old=["base_url"], keep_when_null=["descr"])


@query("replace_by_source", """a AS (SELECT tag AS source FROM facts WHERE tag NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT '1-URGENT' FROM facts WHERE prio = 3),
    b AS (SELECT tag AS source, count(*) AS n_before FROM facts GROUP BY 1), c AS (SELECT source, count(*) AS n_after FROM a GROUP BY 1)
    SELECT coalesce(b.source, c.source) AS source, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after FROM b FULL JOIN c ON c.source = b.source""")
def replace_by_source(m: Market):
    before = m.facts.select("entity_id", "end_d", "val", F.col("tag").alias("source"))
    batch = m.facts.filter("prio = 3").select("entity_id", "end_d", "val", F.lit("1-URGENT").alias("source"))
    return ST.counts_by(before, ST.replace_by(before, batch, "source", ["1-URGENT", "2-HIGH"]), "source")


view("left_mentions", "SELECT * FROM mentions WHERE source_id % 7 <> 3")
view("touched_pairs", "SELECT DISTINCT asset_id, published_d AS d FROM mentions WHERE source_id % 7 = 3")
view("rebuilt_daily", """SELECT asset_id, published_d AS d, count(sentiment_score) AS news_count, avg(sentiment_score) AS m FROM left_mentions l
    WHERE EXISTS (SELECT 1 FROM touched_pairs t WHERE t.asset_id = l.asset_id AND t.d = l.published_d) GROUP BY 1, 2""")


def _purged(m: Market):
    bad = m.dim_source.filter(F.col("source_id") % 7 == 3)
    return ST.purge_sources(m.mentions, m.sentiment_daily, bad)


@query("purge_rebuild", """SELECT asset_id, d, news_count, round(sentiment_mean, 6) + 0.0 AS mean FROM sentiment_daily s
      WHERE NOT EXISTS (SELECT 1 FROM touched_pairs t WHERE t.asset_id = s.asset_id AND t.d = s.d)
    UNION ALL SELECT asset_id, d, news_count, round(m, 6) + 0.0 FROM rebuilt_daily""", "d")
def purge_rebuild(m: Market):
    return _purged(m).daily.select("asset_id", "d", "news_count", r("sentiment_mean").alias("mean"))


@query("purge_report", """SELECT (SELECT count(*) FROM mentions WHERE source_id % 7 = 3) AS deleted, (SELECT count(*) FROM touched_pairs) AS affected,
    (SELECT count(*) FROM rebuilt_daily) AS rebuilt, (SELECT count(*) FROM touched_pairs) - (SELECT count(*) FROM rebuilt_daily) AS zero""")
def purge_report(m: Market):
    return _purged(m).report


_TRUST_SQL = " OR ".join(f"contains(lower(source_name), '{t}')" for t in P.TRUSTED_PUBLISHERS)


@query("untrusted_sources", f"""SELECT source_id, source_name, n FROM (SELECT source_id, count(*) AS n FROM mentions GROUP BY 1) JOIN publishers USING (source_id)
    WHERE lower(source_name) <> 'news.google.com' AND NOT ({_TRUST_SQL}) ORDER BY n DESC, source_id""")
def untrusted_sources(m: Market):
    return N.untrusted_sources(m.mentions, publishers(m), P.TRUSTED_PUBLISHERS, P.PLACEHOLDER_PUBLISHERS)


@query("date_dimension", """SELECT CAST(u AS DATE) AS d, CAST(year(u) AS INTEGER) AS y, CAST(month(u) AS INTEGER) AS m, CAST(day(u) AS INTEGER) AS day,
    CAST(isodow(u) AS INTEGER) AS dow, isodow(u) >= 6 AS is_weekend FROM (SELECT unnest(generate_series((SELECT min(d) FROM price_daily), (SELECT max(d) FROM price_daily), INTERVAL 1 DAY)) AS u)""", "d")
def date_dimension(m: Market):
    return ST.date_dimension(m.price_daily)


@query("surrogate_keys", """o AS (SELECT min(s_suppkey) + 1 AS source_id, s_name FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_name)
    SELECT (SELECT max(source_id) FROM o) + row_number() OVER (ORDER BY s_name) AS source_id, s_name FROM (SELECT DISTINCT s_name FROM supplier WHERE s_name NOT IN (SELECT s_name FROM o))""")
def surrogate_keys(m: Market):
    s = m.table("supplier")
    old = s.filter(F.col("s_suppkey") % 3 == 0).select((F.col("s_suppkey") + 1).alias("source_id"), "s_name")
    return ST.assign_ids(old, s.select("s_name"), "source_id", "s_name")


@query("column_evolution", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 50 ELSE CAST(s_suppkey AS INTEGER) END AS score, count(*) AS n FROM supplier GROUP BY 1""")
def column_evolution(m: Market):
    path = scratch_path(m.spark, "evolving")
    s = m.table("supplier")
    s.filter("s_suppkey % 2 = 0").select("s_suppkey", "s_name").write.parquet(path + "/part=1")
    s.filter("s_suppkey % 2 = 1").select("s_suppkey", "s_name", F.col("s_suppkey").cast("int").alias("score")).write.parquet(path + "/part=2")
    df = m.spark.read.option("mergeSchema", "true").parquet(path)
    return ST.with_default(df, "score", 50).groupBy("score").agg(rows().alias("n"))


@query("return_repair", """SELECT ticker, count(*) AS n, min(d) AS first_d FROM (SELECT p.*, CASE WHEN day(d) = 15 THEN NULL WHEN day(d) = 16 THEN return_1d + 1 ELSE return_1d END AS stored FROM prices p)
    WHERE stored IS DISTINCT FROM return_1d GROUP BY 1""", "first_d")
def return_repair(m: Market):
    day = F.dayofmonth("d")
    stored = m.prices.withColumn("return_1d", F.when(day == 15, None).when(day == 16, F.col("return_1d") + 1).otherwise(F.col("return_1d")))
    return returns.changed_returns(stored).groupBy("ticker").agg(rows().alias("n"), F.min("d").alias("first_d"))


@query("statement_load", """SELECT a.ticker, min(fiscal_period_end) AS first_d, max(fiscal_period_end) AS last_d, count(f.ticker) AS n, count(f.ticker) = 0 AS skipped
    FROM assets a LEFT JOIN (SELECT * FROM fundamentals WHERE entity_id % 5 <> 0) f ON f.ticker = a.ticker GROUP BY 1""", "first_d last_d")
def statement_load(m: Market):
    from marketloom.catalog.filings import fundamentals
    return maintenance.statement_summary(fundamentals(m).filter(F.col("entity_id") % 5 != 0), m.assets)


@query("history_summary", """SELECT a.ticker, min(d) AS first_d, max(d) AS last_d, count(p.d) AS n, count(p.d) > 0 AS has_data
    FROM assets a LEFT JOIN (SELECT * FROM price_daily WHERE asset_id % 6 <> 1) p ON p.ticker = a.ticker GROUP BY 1""", "first_d last_d")
def history_summary(m: Market):
    return S.history_summary(m.price_daily.filter(F.col("asset_id") % 6 != 1), m.assets.select("ticker"))


@query("provider_union", "SELECT ticker, count(*) AS n, count(adj_close) AS n_adj FROM (SELECT ticker, close AS adj_close FROM price_daily UNION ALL SELECT ticker, NULL FROM price_daily WHERE asset_id < 5) GROUP BY 1")
def provider_union(m: Market):
    a = m.price_daily.select("ticker", F.col("close").alias("adj_close"))
    b = m.price_daily.filter("asset_id < 5").select("ticker")
    return a.unionByName(b, allowMissingColumns=True).groupBy("ticker").agg(rows().alias("n"), F.count("adj_close").alias("n_adj"))


@query("calendar_difference", "SELECT DISTINCT d FROM price_daily WHERE d NOT IN (SELECT DISTINCT published_d FROM mentions WHERE asset_id <= 4)", "d")
def calendar_difference(m: Market):
    news_days = m.mentions.filter("asset_id <= 4").select(F.col("published_d").alias("d"))
    return m.price_daily.select("d").subtract(news_days)


@query("distinct_pairs", "SELECT DISTINCT asset_id, published_d FROM mentions", "published_d")
def distinct_pairs(m: Market):
    return m.mentions.select("asset_id", "published_d").distinct()


@query("watchlist", """SELECT ticker, added_at FROM (SELECT ticker, min(ts) AS added_at FROM (SELECT user_id, ts, 'Brand#' || (user_id % 25 + 1) AS ticker FROM events WHERE event_type = 'signup') GROUP BY 1)
    WHERE ticker NOT IN (SELECT DISTINCT 'Brand#' || (user_id % 25 + 1) FROM events WHERE event_type = 'error' AND user_id % 25 < 5) ORDER BY added_at DESC, ticker""")
def watchlist(m: Market):
    e = m.table("events").withColumn("ticker", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")))
    added = e.filter("event_type = 'signup'").select("ticker", F.col("ts").alias("added_at"))
    removed = e.filter("event_type = 'error' AND user_id % 25 < 5").select("ticker").distinct()
    return signals.watchlist(added, removed)


view("daily_signal", """SELECT asset_id, ticker, d, CASE WHEN rsi_14 >= 50 THEN 'UP' ELSE 'DOWN' END AS signal FROM technicals WHERE rsi_14 IS NOT NULL""")


def daily_signal(m: Market):
    return m.technicals.filter(F.col("rsi_14").isNotNull()).select(
        "asset_id", "ticker", "d", F.when(F.col("rsi_14") >= 50, "UP").otherwise("DOWN").alias("signal"))


@query("signal_flips", """SELECT ticker, d, signal, previous_signal, previous_signal IS NOT NULL AS changed FROM (SELECT *, lag(signal) OVER (PARTITION BY asset_id ORDER BY d) AS previous_signal FROM daily_signal)
    WHERE previous_signal IS NULL OR previous_signal <> signal""", "d")
def signal_flips(m: Market):
    return signals.flips(daily_signal(m), "d").select("ticker", "d", "signal", "previous_signal", "changed")


@query("company_profile", r"""SELECT d.doc_id, 'Brand#' || (d.doc_id % 25 + 1) AS ticker, CAST(length(regexp_replace(text, '\s+', ' ', 'g')) AS INTEGER) AS business_chars,
    'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '&type=10-K&dateb=&owner=include&count=40' AS cik_url,
    0 AS n_filings FROM documents d""")
def company_profile(m: Market):
    docs = m.table("documents").select("doc_id", (F.col("doc_id") % 25 + 1).cast("int").alias("asset_id"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("cik"),
                                       F.regexp_replace("text", r"\s+", " ").alias("business_description"), F.lit("2020-01-31").cast("date").alias("latest_10k_filed"),
                                       F.lit(None).cast("array<struct<form:string,filed:string,accession:string,url:string>>").alias("recent_filings"))
    p = dashboard.company_profile(docs, m.assets)
    return p.select("doc_id", "ticker", "business_chars", "cik_url", F.size("recent_filings").alias("n_filings"))


def _news_store(m: Market) -> ST.Store:
    """News, sources and the index of the given headlines as stored tables."""
    from marketloom.operators import sentiment
    s = ST.Store(m.spark, scratch_path(m.spark, "store"))
    h = N.with_hash(m.headlines).withColumns({
        "source_id": (F.regexp_extract("source_name", r"(\d+)", 1)).cast("bigint"),
        "sentiment_label": T.label_from_compound("sentiment_score")})
    s.insert_ignore("fact_news", h)
    s.write("dim_source", h.select("source_id", "source_name", F.when(F.col("source_id") == 4, "synthetic").otherwise("rss").alias("source_type")).distinct())
    s.write("fact_sentiment_daily", sentiment.daily_index(s.read("fact_news")))
    return s


@query("stored_purge", """k AS (SELECT * FROM headlines WHERE source_name <> 'src4') SELECT asset_id, published_d AS d, count(*) AS news_count, round(avg(sentiment_score), 9) + 0.0 AS mean
    FROM k GROUP BY 1, 2""", "d")
def stored_purge(m: Market):
    s = _news_store(m)
    maintenance.purge_synthetic(s)
    return s.read("fact_sentiment_daily").select(F.col("asset_id").cast("int").alias("asset_id"), "d", "news_count", r("sentiment_mean", 9).alias("mean"))


@query("stored_repair", """SELECT ticker, count(*) AS n, count(return_1d) AS n_returns, round(sum(return_1d), 4) AS total FROM prices GROUP BY 1""")
def stored_repair(m: Market):
    s = price_store(m, dirty_prices(m).filter("close IS NOT NULL").select("asset_id", "ticker", "d").distinct().join(m.price_daily, ["asset_id", "ticker", "d"], "right"))
    maintenance.repair_returns(s)
    return s.read("fact_price_daily").groupBy("ticker").agg(rows().alias("n"), F.count("return_1d").alias("n_returns"), F.round(F.sum("return_1d"), 4).alias("total"))
