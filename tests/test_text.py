import hashlib
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from marketloom.functions import params as P
from marketloom.functions import text as T
from marketloom.operators import sentiment


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("term", ["S&P 500 stock market index", "EUR=X #1?", "plain", "a*b~c/d (e)", "Thai ฿"])
def test_search_url_encodes_the_whole_query(spark, term):
    url = apply(spark, [term], T.search_url)[0]
    assert url == f"https://news.google.com/rss/search?q={quote(term + ' market')}&hl=en-US&gl=US&ceid=US:en"


def test_news_hash_is_the_content_hash(spark):
    df = spark.sql("SELECT 'AAPL' t, timestamp'2024-05-01 10:00:00' p, '  Apple\tBEATS  again ' h, ' http://x ' u")
    got = df.select(T.news_hash("t", "p", "h", "u").alias("y")).first().y
    assert got == hashlib.sha256(b"AAPL|2024-05-01T10:00:00+00:00|apple beats again|http://x").hexdigest()


HEAD = ["Item 1. Business", "ITEM 1 BUSINESS", "Item 1 — Business", "Item 1.Business"]


@pytest.mark.parametrize("head", HEAD)
def test_section_is_found_behind_the_contents(spark, head):
    body = "We make things. " * 300
    doc = f"Contents {head} 3 Item 1A. Risk Factors 9 x {head} {body} Item 1A Risk Factors etc Item 1A. Risk Factors"
    got = apply(spark, [doc], T.business_section)[0]
    assert got == f"{head} {body}".strip()


def test_section_is_refused(spark):
    end = "Item 1A. Risk Factors"
    docs = [f"no heading {end}", "Item 1. Business " + "a " * 4000, f"Item 1. Business short {end}", f"Item 1. Business {'a ' * 80000} {end}", ""]
    assert apply(spark, docs, T.business_section) == [None] * 5


def python_section(text, lo, hi):
    starts = [m.start() for m in re.finditer("the ", text, re.I)]
    ends = [m.start() for m in re.finditer(" of ", text, re.I)]
    spans = [(s, min(e for e in ends if e > s)) for s in starts if any(e > s for e in ends)]
    if not spans:
        return None
    s, e = max(spans, key=lambda p: p[1] - p[0])
    out = text[s:e].strip()
    return out if lo <= len(out) <= hi else None


def test_section_against_offsets(spark):
    docs = ["The a b of c the dd ee of f", "of the x", "the a of the b of", "The one the two three of the four five six seven of", "THE Q OF the longer one here of z"]
    assert apply(spark, docs, lambda c: T.longest_section(c, "the ", " of ", 1, 100)) == [python_section(d, 1, 100) for d in docs]


def test_markup(spark):
    html = "<html><script>var a = '<b>';</script><STYLE>p{}</STYLE><p>Risk&nbsp;&amp; reward&mdash;now</p>\n<p>x &lt; y</p></html>"
    assert apply(spark, [html, None], T.markup_to_text) == ["Risk & reward—now x < y", None]


def test_credibility_keeps_the_ft_quirk(spark):
    names = ["Bloomberg.com", "CNBC", "The Globe and Mail", "Investing.com", "Seeking Alpha", "The Motley Fool", "Microsoft News", "Blog"]
    assert apply(spark, names, T.credibility) == [9.5, 8.5, 8.0, 7.0, 6.5, 6.0, 9.5, 5.0]


def test_labels(spark):
    assert apply(spark, [0.05, 0.0499, -0.05, 0.0], T.label_from_compound, "double") == ["pos", "neu", "neg", "neu"]
    df = spark.createDataFrame([(.5, .3, .2), (.2, .6, .2), (.4, .4, .2), (.1, .2, .7)], "a double, b double, c double")
    assert [r.y for r in df.select(T.label_from_probabilities("a", "b", "c").alias("y")).collect()] == ["pos", "neg", "neu", "neu"]


def test_symbols(spark):
    assert apply(spark, ["GC=F", " aapl ", "BRK.B", "EURUSD=X"], T.provider_symbol) == ["XAUUSD", "AAPL.US", "BRK.B", "EURUSD"]
    assert apply(spark, ["GC=F", "AAPL", "THBUSD=X", "JPY=X"], T.gap_provider_symbol) == ["xauusd", "aapl.us", None, None]
    assert apply(spark, ["BTC-USD", "ES=F", "JPY=X", "spy", "^GSPC", "KO"], T.asset_class) == ["Crypto", "Futures", "Forex", "Funds", "Indices", "Stocks"]
    assert apply(spark, ["GC=F", "ZZZ"], T.display_name) == ["Gold", "ZZZ"]
    assert apply(spark, ["KO", "NFLX"], lambda c: T.search_term(c, {"KO": "Coca-Cola"})) == ["Coca-Cola", "NFLX"]


def test_empty_trust_list_switches_the_filter_off(spark):
    assert apply(spark, ["Reuters UK", "Blog", None], T.trusted) == [True, False, False]
    assert apply(spark, ["Blog", None], lambda c: T.trusted(c, [])) == [True, True]


def test_paragraphs_keep_every_word(spark):
    body = "One. Two. Three. Four. Five is v1.2 here. Six"
    got = apply(spark, [body, ""], T.paragraphs)
    assert got == [["One. Two. Three. Four.", "Five is v1.2 here. Six"], []]


def test_lexicon_overrides_replace_words():
    base = {"record": 1.0, "debt": -2.0}
    table = sentiment.lexicon(base, {"Record": 2.0, "bullish": 2.5})
    assert table == {"record": 2.0, "debt": -2.0, "bullish": 2.5}


def test_lexicon_scores_whole_texts(spark):
    late = "word " * 5000 + "crash"
    df = spark.createDataFrame([(1, "Profits surge!"), (2, late), (3, ""), (4, None), (5, "neutral words")], "doc_id int, text string")
    got = {r.doc_id: r for r in sentiment.lexicon_scores(df, sentiment.lexicon()).collect()}
    s = P.LEXICON["profits"] + P.LEXICON["surge"]
    assert got[1].sentiment_score == pytest.approx(s / (s * s + 15) ** 0.5) and got[1].sentiment_label == "pos"
    assert got[2].sentiment_label == "neg"
    assert [got[i].sentiment_score for i in (3, 4, 5)] == [0.0, 0.0, 0.0]


def test_daily_index_median_and_nulls(spark):
    rows = [(1, 0.5, "pos"), (1, -0.1, "neg"), (1, 0.2, "pos"), (1, 0.2, "neu"), (1, None, "neu"), (2, None, None)]
    df = spark.createDataFrame([(a, s, lab) for a, s, lab in rows], "asset_id int, sentiment_score double, sentiment_label string").withColumn(
        "published_d", F.lit("2024-01-01").cast("date"))
    one, two = sentiment.daily_index(df).orderBy("asset_id").collect()
    assert (one.news_count, one.sentiment_mean, one.sentiment_median, one.pos_count, one.neu_count, one.neg_count) == (4, 0.2, 0.2, 2, 2, 1)
    assert (two.news_count, two.sentiment_mean, two.sentiment_median, two.pos_count) == (0, None, None, 0)
