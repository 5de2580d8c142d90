"""Headlines, labels, text functions and sentiment scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.catalog.base import query, view
from marketloom.functions import params as P
from marketloom.functions import text as T
from marketloom.functions.numeric import r
from marketloom.operators import news, sentiment
from marketloom.sources.tables import Market

# Publisher and symbol names the intake tables lack, dealt out over their keys.
PUBLISHERS = ["Bloomberg", "Reuters", "CNBC", "Yahoo Finance", "Investing.com", "Seeking Alpha",
              "The Motley Fool", "Microsoft News", "news.google.com", "Local Daily"]
SYMBOLS = ["BTC-USD", "GC=F", "EURUSD=X", "SPY", "^GSPC", "AAPL", "THBUSD=X", "BRK.B", "NFLX", "KO"]


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


view("publishers", f"""SELECT s_suppkey AS source_id,
    {_list(PUBLISHERS)}[CAST(s_suppkey % 10 AS INTEGER) + 1] AS source_name FROM supplier""")
view("symbols", f"""SELECT DISTINCT asset_id, ticker,
    {_list(SYMBOLS)}[asset_id % 10 + 1] AS symbol FROM assets""")
view("news_day", "SELECT * FROM headlines WHERE published_d = (SELECT max(published_d) FROM headlines)")


def publishers(m: Market):
    names = F.array(*[F.lit(p) for p in PUBLISHERS])
    return m.table("supplier").select(
        F.col("s_suppkey").alias("source_id"),
        F.element_at(names, (F.col("s_suppkey") % 10 + 1).cast("int")).alias("source_name"))


def symbols(m: Market):
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    return m.assets.select("asset_id", "ticker",
                           F.element_at(names, F.col("asset_id") % 10 + 1).alias("symbol"))


def last_day(m: Market):
    """News of the last covered day."""
    return m.headlines.filter(F.col("published_d") == m.headlines.agg(F.max("published_d")).scalar())


SQL_TITLE = r"lower(trim(regexp_replace(title, '\s+', ' ', 'g')))"


@query("headline_hash", rf"""SELECT event_id, sha256(concat_ws('|', ticker,
    strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), {SQL_TITLE}, trim(url))) AS news_hash
    FROM headlines""")
def headline_hash(m: Market):
    return news.with_hash(m.headlines).select("event_id", "news_hash")


@query("headline_dedup", rf"""h AS (SELECT *, sha256(concat_ws('|', ticker,
    strftime(published_d, '%Y-%m-%dT%H:%M:%S+00:00'), {SQL_TITLE}, trim(url))) AS news_hash FROM headlines)
    SELECT min(event_id) AS event_id, news_hash, min_by(title, event_id) AS title FROM h GROUP BY news_hash""")
def headline_dedup(m: Market):
    hashed = news.with_hash(m.headlines.withColumn("day", F.col("published_d").cast("timestamp")), "day")
    return news.dedup(hashed).select("event_id", "news_hash", "title")


@query("trusted_headlines", """SELECT source_name, count(*) AS n FROM headlines
    WHERE contains(lower(source_name), 'src1') OR contains(lower(source_name), 'src7') GROUP BY 1""")
def trusted_headlines(m: Market):
    kept = m.headlines.filter(T.trusted("source_name", ["src1", "src7"]))
    return kept.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


@query("trust_filter_off", "SELECT count(*) AS n FROM headlines")
def trust_filter_off(m: Market):
    return m.headlines.filter(T.trusted("source_name", [])).agg(F.count(F.lit(1)).alias("n"))


@query("lookback_cutoff", """SELECT event_id, ticker, published_at, title FROM headlines
    WHERE published_at >= (SELECT max(published_at) FROM headlines) - INTERVAL 72 HOUR""")
def lookback_cutoff(m: Market):
    now = m.headlines.agg(F.max("published_at")).scalar()
    return news.since(m.headlines, now, 72).select("event_id", "ticker", "published_at", "title")


@query("rebuild_window", """SELECT asset_id, published_d, count(*) AS n FROM mentions
    WHERE published_d BETWEEN DATE '2000-06-30' - 90 AND DATE '2000-06-30' GROUP BY 1, 2""", "published_d")
def rebuild_window(m: Market):
    days = news.rebuild_window(m.mentions, F.lit(dt.date(2000, 6, 30)), 2160)
    return days.groupBy("asset_id", "published_d").agg(F.count(F.lit(1)).alias("n"))


LEXICON_SQL = ", ".join(f"('{w}', {v})" for w, v in P.LEXICON.items())
_FINANCE = {**P.LEXICON, **{k.lower(): v for k, v in P.FINANCE_OVERRIDES.items()}}
FINANCE_SQL = ", ".join(f"('{w}', {v})" for w, v in _FINANCE.items())
view("lexicon", f"SELECT * FROM (VALUES {LEXICON_SQL}) t(word, valence)")
view("finance_lexicon", f"SELECT * FROM (VALUES {FINANCE_SQL}) t(word, valence)")
LABEL_SQL = "CASE WHEN {s} >= 0.05 THEN 'pos' WHEN {s} <= -0.05 THEN 'neg' ELSE 'neu' END"


def lexicon_sql(table: str, key: str, text: str, lexicon: str) -> str:
    return f"""w AS (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+')) AS word
        FROM {table}), v AS (SELECT {key}, CAST(coalesce(sum(CAST(valence AS DECIMAL(18,4))), 0) AS DOUBLE) AS s
        FROM w LEFT JOIN {lexicon} USING (word) GROUP BY {key}),
        c AS (SELECT {key}, s / sqrt(s * s + 15.0) AS c FROM v)
        SELECT {key}, round(c, 6) + 0.0 AS sentiment_score, {LABEL_SQL.format(s='c')} AS sentiment_label FROM c"""


@query("lexicon_scores", lexicon_sql("documents", "doc_id", "text", "lexicon"))
def lexicon_scores(m: Market):
    s = sentiment.lexicon_scores(m.table("documents"), sentiment.lexicon())
    return s.select("doc_id", r("sentiment_score").alias("sentiment_score"), "sentiment_label")


@query("finance_lexicon_scores", lexicon_sql("documents", "doc_id", "text", "finance_lexicon"))
def finance_lexicon_scores(m: Market):
    s = sentiment.lexicon_scores(m.table("documents"), sentiment.lexicon(overrides=P.FINANCE_OVERRIDES))
    return s.select("doc_id", r("sentiment_score").alias("sentiment_score"), "sentiment_label")


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def spoken_sql(text: str) -> str:
    return f"""list_filter(list_transform(regexp_split_to_array(replace(coalesce({text}, ''), '’', ''''), '[^\\p{{L}}'']+'),
        lambda x: trim(x, '''')), lambda x: x <> '')"""


def rule_sql(table: str, key: str, text: str, lexicon: str) -> str:
    """The rules of `sentiment.rule_scores`, step by step over the three words before."""
    capital = lambda w: f"(mixed AND upper({w}) = {w} AND lower({w}) <> {w})"
    num = lambda v: f"CAST({v} AS DOUBLE)"
    step, flip = [], []
    for k, weight in enumerate(P.DEGREE_BY_DISTANCE, 1):
        free = f"(t{k} IS NOT NULL AND lower(t{k}) NOT IN (SELECT word FROM {lexicon}))"
        own = (f"CASE WHEN lower(t{k}) IN ({_listed(P.BOOSTERS)}) THEN {num(P.DEGREE_STEP)} "
               f"WHEN lower(t{k}) IN ({_listed(P.DAMPENERS)}) THEN {num(-P.DEGREE_STEP)} END")
        step.append(f"""coalesce(CASE WHEN {free} THEN ({own}
            + CASE WHEN {capital(f't{k}')} THEN {num(P.CAPITALS_STEP)} ELSE 0 END) * {num(weight)} END, 0) AS s{k}""")
        flip.append(f"""CASE WHEN {free} AND (lower(t{k}) IN ({_listed(P.NEGATIONS)}) OR lower(t{k}) LIKE '%n''t')
            THEN {num(P.NEGATION_FACTOR)} ELSE 1 END AS f{k}""")
    asked = "len(regexp_extract_all(body, '\\?'))"
    return f"""said AS (SELECT {key}, coalesce({text}, '') AS body, {spoken_sql(text)} AS l FROM {table}),
        spoken AS (SELECT {key}, l, len(list_filter(l, lambda x: upper(x) = x AND lower(x) <> x)) AS up,
            coalesce(list_position(list_transform(l, lambda x: lower(x)), 'but'), 0) AS but FROM said),
        told AS (SELECT {key}, but, up > 0 AND up < len(l) AS mixed, unnest(l) AS t0, unnest(range(1, len(l) + 1)) AS p FROM spoken),
        ctx AS (SELECT *, lag(t0, 1) OVER w AS t1, lag(t0, 2) OVER w AS t2, lag(t0, 3) OVER w AS t3
            FROM told WINDOW w AS (PARTITION BY {key} ORDER BY p)),
        hits AS (SELECT ctx.*, {num('valence')} AS v FROM ctx JOIN {lexicon} x ON x.word = lower(t0)),
        steps AS (SELECT {key}, p, but, v + sign(v) * CASE WHEN {capital('t0')} THEN {num(P.CAPITALS_STEP)} ELSE 0 END AS v0,
            {', '.join(step + flip)} FROM hits),
        v1 AS (SELECT *, (v0 + sign(v0) * s1) * f1 AS v1 FROM steps), v2 AS (SELECT *, (v1 + sign(v1) * s2) * f2 AS v2 FROM v1),
        v3 AS (SELECT *, (v2 + sign(v2) * s3) * f3 AS v3 FROM v2),
        sums AS (SELECT {key}, sum(CAST(round(v3 * CASE WHEN but = 0 THEN {num(1.0)} WHEN p < but THEN {num(P.BEFORE_BUT)} ELSE {num(P.AFTER_BUT)} END
            * {num(1000000.0)}) AS BIGINT)) / {num(1000000.0)} AS s FROM v3 GROUP BY 1),
        marks AS (SELECT {key}, coalesce(s, 0) AS s, least(len(regexp_extract_all(body, '!')), {P.EXCLAMATIONS}) * {num(P.EXCLAMATION_STEP)}
            + CASE WHEN {asked} > {P.QUESTIONS} THEN {num(P.MANY_QUESTIONS)} WHEN {asked} > 1 THEN {asked} * {num(P.QUESTION_STEP)} ELSE 0 END AS e
            FROM said LEFT JOIN sums USING ({key})),
        whole AS (SELECT {key}, s + sign(s) * e AS s FROM marks), c AS (SELECT {key}, s / sqrt(s * s + 15.0) AS c FROM whole)
        SELECT {key}, round(c, 6) + 0.0 AS sentiment_score, {LABEL_SQL.format(s='c')} AS sentiment_label FROM c"""


@query("rule_scores", rule_sql("documents", "doc_id", "text", "finance_lexicon"))
def rule_scores(m: Market):
    s = sentiment.rule_scores(m.table("documents"), sentiment.lexicon(overrides=P.FINANCE_OVERRIDES))
    return s.select("doc_id", (r("sentiment_score") + 0.0).alias("sentiment_score"), "sentiment_label")


@query("rule_scored_headlines", rule_sql("headlines", "event_id", "title", "lexicon"))
def rule_scored_headlines(m: Market):
    s = sentiment.rule_scores(m.headlines, sentiment.lexicon(), "event_id", "title")
    return s.select("event_id", (r("sentiment_score") + 0.0).alias("sentiment_score"), "sentiment_label")


view("learned_lexicon", f"""SELECT word, n_good, n_bad, valence FROM (SELECT word, n_good, n_bad, round(greatest(-4.0, least(4.0, odds)), 4) AS valence,
        round(abs(odds) / sqrt(CAST(1 AS DOUBLE) / (n_good + CAST(1 AS DOUBLE)) + CAST(1 AS DOUBLE) / (n_bad + CAST(1 AS DOUBLE))), 4) AS errors
    FROM (SELECT *, ln(((n_good + CAST(1 AS DOUBLE)) / (g + CAST(2 AS DOUBLE))) / ((n_bad + CAST(1 AS DOUBLE)) / (b + CAST(2 AS DOUBLE)))) AS odds
    FROM (SELECT word, count(*) FILTER (toxic = 0) AS n_good, count(*) FILTER (toxic = 1) AS n_bad
          FROM (SELECT doc_id, toxic, unnest(list_distinct(list_transform({spoken_sql('text')}, lambda x: lower(x)))) AS word FROM news_text
                WHERE toxic IS NOT NULL) GROUP BY 1),
         (SELECT count(*) FILTER (toxic = 0) AS g, count(*) FILTER (toxic = 1) AS b FROM news_text)
    WHERE n_good + n_bad >= 5 AND word NOT IN ({_listed(P.LEXICON)})))
    WHERE abs(valence) >= 1 AND errors >= 3 ORDER BY errors DESC, word LIMIT 300""")
view("wide_lexicon", "SELECT word, valence FROM learned_lexicon UNION ALL SELECT word, valence FROM lexicon")


def _learned(m: Market):
    return sentiment.learned_valences(m.news_text.withColumn("good", F.col("toxic") == 0), sentiment.lexicon())


@query("learned_valences", "SELECT word, n_good, n_bad, valence FROM learned_lexicon")
def learned_valences(m: Market):
    return _learned(m)


@query("learned_rule_scores", rule_sql("documents", "doc_id", "text", "wide_lexicon"))
def learned_rule_scores(m: Market):
    s = sentiment.rule_scores(m.table("documents"), sentiment.with_learned(sentiment.lexicon(), _learned(m)))
    return s.select("doc_id", (r("sentiment_score") + 0.0).alias("sentiment_score"), "sentiment_label")


@query("score_failure_policy", f"""{lexicon_sql('documents', 'doc_id', 'text', 'lexicon')
    .replace('SELECT doc_id, round(c, 6)', 'SELECT doc_id, round(CASE WHEN doc_id % 7 = 3 THEN 0 ELSE c END, 6)')
    .replace('CASE WHEN c >=', "CASE WHEN doc_id % 7 = 3 THEN 'neu' WHEN c >=")}""")
def score_failure_policy(m: Market):
    # a scorer that fails on one text in seven
    s = sentiment.lexicon_scores(m.table("documents"), sentiment.lexicon())
    failed = F.col("doc_id") % 7 == 3
    s = s.withColumns({c: F.when(~failed, F.col(c)) for c in ("sentiment_score", "sentiment_label")})
    return sentiment.failure_policy(s).select(
        "doc_id", r("sentiment_score").alias("sentiment_score"), "sentiment_label")


view("fresh", """SELECT event_id, title FROM headlines
    WHERE published_at >= (SELECT max(published_at) FROM headlines) - INTERVAL 120 HOUR
      AND published_at >= (SELECT max(published_at) FROM headlines) - INTERVAL 72 HOUR""")


@query("unseen_then_scored", lexicon_sql("fresh", "event_id", "title", "lexicon"))
def unseen_then_scored(m: Market):
    now = m.headlines.agg(F.max("published_at")).scalar()
    hashed = news.with_hash(m.headlines)
    stored = hashed.filter(F.col("published_at") < now - F.make_interval(hours=F.lit(72)))
    new = news.unseen(news.since(hashed, now, 120), stored)
    s = sentiment.lexicon_scores(new, sentiment.lexicon(), "event_id", "title")
    return s.select("event_id", r("sentiment_score").alias("sentiment_score"), "sentiment_label")


def _case(rules, test) -> str:
    return " ".join(f"WHEN {test(k)} THEN {v}" for v, k in rules)


CRED_SQL = "CASE " + _case(P.CREDIBILITY_RULES, lambda ks: " OR ".join(
    f"contains(lower(source_name), '{k}')" for k in ks)) + f" ELSE {P.CREDIBILITY_DEFAULT} END"
RECLASS_SQL = "CASE " + _case([(v, k) for k, v in P.RECLASSIFY_RULES],
                              lambda k: f"source_name ILIKE '{k}'") + f" ELSE {P.RECLASSIFY_DEFAULT} END"


@query("source_credibility", f"SELECT source_id, source_name, CAST({CRED_SQL} AS DOUBLE) AS credibility_score FROM publishers")
def source_credibility(m: Market):
    return publishers(m).withColumn("credibility_score", T.credibility("source_name"))


@query("source_reclassify", f"SELECT source_id, source_name, CAST({RECLASS_SQL} AS INTEGER) AS credibility_score FROM publishers")
def source_reclassify(m: Market):
    return publishers(m).withColumn("credibility_score", T.reclassify("source_name"))


@query("label_from_compound", f"""SELECT {LABEL_SQL.format(s='sentiment_score')} AS label, count(*) AS n
    FROM mentions GROUP BY 1""")
def label_from_compound(m: Market):
    return (m.mentions.groupBy(T.label_from_compound("sentiment_score").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("label_from_probabilities", """p AS (SELECT l_discount * 5 AS pp, l_tax * 5 AS pn,
    greatest(1 - l_discount * 5 - l_tax * 5, 0) AS pu FROM lineitem)
    SELECT CASE WHEN pp > pn AND pp > pu THEN 'pos' WHEN pn > pp AND pn > pu THEN 'neg' ELSE 'neu' END AS label,
    count(*) AS n, round(avg(pp - pn), 6) + 0.0 AS mean_score FROM p GROUP BY 1""")
def label_from_probabilities(m: Market):
    p = m.table("lineitem").select(
        (F.col("l_discount") * 5).alias("pp"), (F.col("l_tax") * 5).alias("pn"),
        F.greatest(1 - F.col("l_discount") * 5 - F.col("l_tax") * 5, F.lit(0.0)).alias("pu"))
    return (p.groupBy(T.label_from_probabilities("pp", "pn", "pu").alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("pp") - F.col("pn"))).alias("mean_score")))


@query("sentiment_daily", """SELECT asset_id, d, news_count, round(sentiment_mean, 6) + 0.0 AS sentiment_mean,
    round(sentiment_median, 6) + 0.0 AS sentiment_median, pos_count, neu_count, neg_count
    FROM sentiment_daily""", "d")
def sentiment_daily(m: Market):
    return m.sentiment_daily.withColumns({c: r(c) for c in ["sentiment_mean", "sentiment_median"]})


@query("label_distribution", """SELECT sentiment_label, count(*) AS cnt FROM mentions
    WHERE published_d BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND sentiment_label IS NOT NULL GROUP BY 1""")
def label_distribution(m: Market):
    return news.label_distribution(news.search(m.mentions, start=dt.date(1998, 1, 1), end=dt.date(2000, 12, 31)))


@query("source_ranking", f"""SELECT source_name, max(CAST({CRED_SQL} AS DOUBLE)) AS credibility_score
    FROM publishers WHERE source_id IN (SELECT source_id FROM mentions
      WHERE published_d BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def source_ranking(m: Market):
    rated = publishers(m).withColumn("credibility_score", T.credibility("source_name"))
    in_range = news.search(m.mentions, start=dt.date(2000, 1, 1), end=dt.date(2000, 12, 31))
    return news.source_ranking(in_range, rated)


@query("day_summary", """SELECT ticker, 'Stocks' AS asset_class, count(*) AS n,
    round(avg(coalesce(sentiment_score, 0)), 3) + 0.0 AS avg_score,
    count(*) FILTER (WHERE sentiment_score > 0.1) AS pos, count(*) FILTER (WHERE sentiment_score < -0.1) AS neg,
    count(*) - count(*) FILTER (WHERE sentiment_score > 0.1) - count(*) FILTER (WHERE sentiment_score < -0.1) AS neu,
    CASE WHEN avg(coalesce(sentiment_score, 0)) > 0.1 THEN 'POSITIVE'
         WHEN avg(coalesce(sentiment_score, 0)) < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label
    FROM news_day GROUP BY ticker""")
def day_summary(m: Market):
    return news.day_summary(last_day(m))


@query("day_headlines", """SELECT ticker, event_id, strftime(published_at, '%H:%M') AS time,
    coalesce(title, '') AS title, url, round(coalesce(sentiment_score, 0), 3) + 0.0 AS score FROM news_day""")
def day_headlines(m: Market):
    return news.day_headlines(last_day(m))


CLASS_SQL = f"""CASE WHEN {{s}} IN {tuple(P.CRYPTO_SYMBOLS)} THEN 'Crypto' WHEN {{s}} IN {tuple(P.FUTURES_SYMBOLS)} THEN 'Futures'
    WHEN contains({{s}}, '=X') OR {{s}} IN {tuple(P.FOREX_SYMBOLS)} THEN 'Forex' WHEN {{s}} IN {tuple(P.FUND_SYMBOLS)} THEN 'Funds'
    WHEN contains({{s}}, '^') THEN 'Indices' ELSE 'Stocks' END"""


@query("available_classes", f"""SELECT 'All' AS asset_class UNION ALL
    SELECT DISTINCT {CLASS_SQL.format(s='symbol')} FROM news_day JOIN symbols USING (asset_id)""")
def available_classes(m: Market):
    named = (last_day(m).select("asset_id").distinct().join(symbols(m), "asset_id")
             .select(F.col("symbol").alias("ticker")))
    return news.available_classes(named)


@query("asset_class", f"SELECT asset_id, symbol, {CLASS_SQL.format(s='symbol')} AS asset_class FROM symbols")
def asset_class(m: Market):
    return symbols(m).select("asset_id", "symbol", T.asset_class("symbol").alias("asset_class"))


@query("headline_page", """SELECT ticker, published_at, sentiment_score, title, url, event_id FROM headlines
    WHERE contains(lower(title), 'click') AND published_d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
    ORDER BY published_at DESC, event_id DESC LIMIT 15 OFFSET 15""")
def headline_page(m: Market):
    found = news.search(m.headlines, start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 25), text="Click")
    return news.page(found, 2).select("ticker", "published_at", "sentiment_score", "title", "url", "event_id")


@query("headline_page_count", """SELECT count(*) AS total, CAST(ceil(count(*) / 15.0) AS BIGINT) AS total_pages
    FROM headlines WHERE contains(lower(title), 'click')""")
def headline_page_count(m: Market):
    return news.page_count(news.search(m.headlines, text="CLICK"))


@query("title_search", "SELECT ticker, count(*) AS n FROM headlines WHERE title ILIKE '%PURCHASE%' GROUP BY 1")
def title_search(m: Market):
    return news.search(m.headlines, text="PURCHASE").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("home_feed", """SELECT h.ticker, published_at, title, url, s.source_name AS source
    FROM headlines h LEFT JOIN publishers s ON s.source_id = h.event_id % 150
    ORDER BY published_at DESC, event_id DESC LIMIT 13""")
def home_feed(m: Market):
    top = news.page(m.headlines, 1, 13)
    named = publishers(m).select("source_id", F.col("source_name").alias("source"))
    return top.withColumn("source_id", F.col("event_id") % 150).join(named, "source_id", "left").select("ticker", "published_at", "title", "url", "source")


NAMES_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.DISPLAY_NAMES.items())


@query("symbol_lookup", f"""n AS (SELECT asset_id, symbol, CASE symbol {NAMES_SQL} ELSE symbol END AS name FROM symbols)
    SELECT asset_id, symbol, name FROM n WHERE upper(symbol) = 'BITCOIN' OR upper(name) = 'BITCOIN'""")
def symbol_lookup(m: Market):
    named = symbols(m).select("asset_id", "symbol", T.display_name("symbol").alias("name"))
    q = F.upper(F.lit("bitcoin"))
    return named.filter((F.upper("symbol") == q) | (F.upper("name") == q))


@query("display_names", f"SELECT asset_id, CASE symbol {NAMES_SQL} ELSE symbol END AS display_name FROM symbols")
def display_names(m: Market):
    return symbols(m).select("asset_id", T.display_name("symbol").alias("display_name"))


@query("day_clamp", """q AS (SELECT unnest([DATE '1990-01-01', DATE '2024-01-15', DATE '2099-12-31']) AS requested),
    b AS (SELECT min(published_d) AS min_d, max(published_d) AS max_d FROM headlines)
    SELECT requested, min_d, max_d, CASE WHEN requested BETWEEN min_d AND max_d THEN requested ELSE max_d END AS d FROM q, b""",
       "requested min_d max_d d")
def day_clamp(m: Market):
    """Before, inside and after the covered days."""
    asked = [F.lit(dt.date(*d)) for d in ((1990, 1, 1), (2024, 1, 15), (2099, 12, 31))]
    days = news.covered_days(m.headlines)
    return days.select("*", F.explode(F.array(*asked)).alias("requested")).withColumn("d", news.clamp(F.col("requested")))


@query("symbol_mapping", """SELECT asset_id, symbol,
    CASE WHEN contains(symbol, '.') THEN symbol WHEN symbol = 'GC=F' THEN 'XAUUSD' WHEN symbol = 'BTC-USD' THEN 'BTCUSD'
      WHEN symbol = 'EURUSD=X' THEN 'EURUSD' ELSE symbol || '.US' END AS provider_symbol,
    CASE symbol WHEN 'GC=F' THEN 'xauusd' WHEN 'BTC-USD' THEN 'btcusd' WHEN 'EURUSD=X' THEN 'eurusd'
      WHEN 'THBUSD=X' THEN NULL ELSE CASE WHEN contains(symbol, '=X') THEN NULL ELSE lower(symbol) || '.us' END
      END AS gap_symbol FROM symbols""")
def symbol_mapping(m: Market):
    return symbols(m).select("asset_id", "symbol", T.provider_symbol("symbol").alias("provider_symbol"),
                             T.gap_provider_symbol("symbol").alias("gap_symbol"))


TERMS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**P.SEARCH_TERMS, "KO": "Coca-Cola & Co"}.items())


@query("search_urls", f"""t AS (SELECT asset_id, CASE symbol {TERMS_SQL} ELSE symbol END AS term FROM symbols)
    SELECT asset_id, term, 'https://news.google.com/rss/search?q=' || replace(url_encode(term || ' market'), '+', '%20')
      || '&hl=en-US&gl=US&ceid=US:en' AS url FROM t""")
def search_urls(m: Market):
    t = symbols(m).select("asset_id", T.search_term("symbol", {"KO": "Coca-Cola & Co"}).alias("term"))
    return t.withColumn("url", T.search_url("term"))


@query("display_formats", """SELECT ticker, d, CASE WHEN pct_change IS NULL THEN 'N/A' ELSE printf('%+.2f%%', pct_change) END AS pct,
    strftime(d, '%a %b %d') AS day FROM prices""", "d")
def display_formats(m: Market):
    return m.prices.select("ticker", "d", T.signed_pct("pct_change").alias("pct"), T.day_text("d").alias("day"))


@query("headline_clock", "SELECT event_id, lower(strftime(published_at, '%I:%M%p')) AS time FROM headlines")
def headline_clock(m: Market):
    return m.headlines.select("event_id", T.clock_text("published_at").alias("time"))


@query("paragraphs", r"""t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT doc_id, regexp_extract_all(t, '.+?(?:\.\s|$)') AS s FROM t),
    g AS (SELECT doc_id, list_transform(generate_series(1, len(s), 4),
      lambda i: trim(array_to_string(s[i:i+3], ''))) AS p FROM s)
    SELECT doc_id, CAST(len(p) AS INTEGER) AS n, array_to_string(p[1:3], chr(10)) AS preview,
      CAST(length(array_to_string(p[4:], chr(10))) AS INTEGER) AS rest_chars FROM g""")
def paragraphs(m: Market):
    t = m.table("documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    p = t.select("doc_id", T.paragraphs("t").alias("p"))
    rest = F.slice("p", F.lit(4), F.greatest(F.size("p") - 3, F.lit(0)))
    return p.select("doc_id", F.size("p").alias("n"),
                    F.array_join(F.slice("p", 1, 3), "\n").alias("preview"),
                    F.length(F.array_join(rest, "\n")).alias("rest_chars"))


@query("markup_text", r"""a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'),
      '<style\b.*?</style>', ' ', 'gis') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '&copy;', chr(169)), '&middot;', chr(183)),
      '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM b)
    SELECT page_id, trim(regexp_replace(replace(t, chr(160), ' '), '\s+', ' ', 'g')) AS text FROM c""")
def markup_text(m: Market):
    return m.table("pages").select("page_id", T.markup_to_text("html").alias("text"))


@query("section_extract", r"""t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents),
    p AS (SELECT doc_id, string_split_regex(t, '(?i) of ') AS p FROM t),
    s AS (SELECT doc_id, unnest(list_transform(p[1:len(p)-1], lambda x: regexp_extract(x, '(?is)the .*', 0))) AS s,
      generate_subscripts(p[1:len(p)-1], 1) AS i FROM p),
    l AS (SELECT doc_id, trim(arg_max(s, length(s) * 100000 - i)) AS s FROM s GROUP BY 1)
    SELECT d.doc_id, CASE WHEN length(s) BETWEEN 50 AND 2000 THEN s END AS section FROM documents d LEFT JOIN l USING (doc_id)""")
def section_extract(m: Market):
    t = m.table("documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    return t.select("doc_id", T.longest_section("t", "the ", " of ", 50, 2000).alias("section"))
