"""Rule-based valence scores against a plain Python fold."""

import math
import re

import pytest
from pyspark.sql import functions as F

from marketloom.functions import params as P
from marketloom.operators import sentiment

SF = "/root/testdata/sf0.001"
WORDS = {"good": 1.9, "bad": -2.5, "great": 3.1, "loss": -1.9, "fine": 0.8}


def plain(text, words):
    text = text or ""
    said = [w for w in (t.strip("'") for t in re.findall(r"(?:[^\W\d_]|')+", text.replace("’", "'"))) if w]
    low = [w.lower() for w in said]
    capital = [w.upper() == w and w.lower() != w for w in said]
    mixed = any(capital) and not all(capital)
    but = low.index("but") if "but" in low else None
    total = 0
    for i, w in enumerate(low):
        if w not in words:
            continue
        v = words[w]
        sign = lambda: (v > 0) - (v < 0)
        v += sign() * (P.CAPITALS_STEP if mixed and capital[i] else 0.0)
        for k, weight in enumerate(P.DEGREE_BY_DISTANCE, 1):
            if i < k or low[i - k] in words:
                continue
            near, step = low[i - k], 0.0
            if near in P.BOOSTERS or near in P.DAMPENERS:
                step = ((P.DEGREE_STEP if near in P.BOOSTERS else -P.DEGREE_STEP) + (P.CAPITALS_STEP if mixed and capital[i - k] else 0.0)) * weight
            v = v + sign() * step
            if near in P.NEGATIONS or near.endswith("n't"):
                v *= P.NEGATION_FACTOR
        share = 1.0 if but is None else P.BEFORE_BUT if i < but else P.AFTER_BUT
        x = v * share * 1e6
        total += int(math.copysign(math.floor(abs(x) + 0.5), x))
    s, asked = total / 1e6, text.count("?")
    marks = min(text.count("!"), P.EXCLAMATIONS) * P.EXCLAMATION_STEP
    marks += P.MANY_QUESTIONS if asked > P.QUESTIONS else asked * P.QUESTION_STEP if asked > 1 else 0.0
    s += ((s > 0) - (s < 0)) * marks
    return s / math.sqrt(s * s + P.LEXICON_NORM)


def scores(spark, texts, words=WORDS):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.sentiment_score for r in sentiment.rule_scores(df, words).orderBy("doc_id").collect()]


TEXTS = ["good", "very good", "a so very good day", "slightly good", "not good", "don’t say good", "isn't it good", "GOOD news", "GOOD", "VERY good thing",
         "good but bad", "bad, but GREAT!!!", "good!", "good!!!!!!", "good?", "good??", "good?????", "no!!", "not very good", "very, very, very good",
         "never a loss", "good bad", "not bad good", "barely fine", "barely hardly scarcely fine", "", None, "'''", "good/bad", "without much of any loss",
         "Sehr gut, ÄRGER but good", "but good", "good but", "great " * 3_000 + "but bad", "x" * 50_000 + " good"]


def test_scores_equal_a_plain_fold(spark):
    got = scores(spark, TEXTS)
    for text, score in zip(TEXTS, got):
        assert score == pytest.approx(plain(text, WORDS), abs=1e-9), text


def test_rules_move_scores_as_they_should(spark):
    s = dict(zip(TEXTS, scores(spark, TEXTS)))
    assert s["very good"] > s["good"] > s["slightly good"] > 0 > s["not good"]
    assert s["GOOD news"] > s["GOOD"] == s["good"]
    assert s["good but bad"] < s["good bad"] and s["bad, but GREAT!!!"] > 0.5
    assert s["good!!!!!!"] > s["good!"] > s["good"] == s["good?"] and s["no!!"] == 0.0
    assert s["never a loss"] > 0 and s[""] == s[None] == 0.0


def test_documents_equal_a_plain_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = sentiment.lexicon(overrides=P.FINANCE_OVERRIDES)
    got = {r.doc_id: r.sentiment_score for r in sentiment.rule_scores(docs, words).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(plain(r.text, words), abs=1e-9)
    assert any(got.values())


def test_learned_words_set_texts_apart(spark):
    rows = [(f"alpha common {'x' * (i % 3 + 1)}", True) for i in range(30)] + [(f"beta common {'x' * (i % 3 + 1)}", False) for i in range(30)]
    rows += [("gamma", None)] * 9 + [("rare", True), (None, True), ("good alpha", True)]
    df = spark.createDataFrame(rows, "text string, good boolean")
    got = {r.word: r for r in sentiment.learned_valences(df, WORDS).collect()}
    assert set(got) == {"alpha", "beta"} and got["alpha"].valence > 3 and got["beta"].valence < -3
    assert (got["alpha"].n_good, got["alpha"].n_bad) == (31, 0)
    wide = sentiment.with_learned(WORDS, sentiment.learned_valences(df, WORDS, most=1))
    assert len(wide) == len(WORDS) + 1 and wide["good"] == WORDS["good"]
    assert sentiment.learned_valences(df.limit(0), WORDS).count() == 0


def test_learned_words_separate_texts_they_have_not_seen(spark):
    """Half of the labelled documents teach the words, the other half is scored."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    docs = docs.withColumn("good", F.col("toxic") == 0)
    held = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    words = sentiment.with_learned({}, sentiment.learned_valences(docs.filter(~held), {}))
    rows = sentiment.rule_scores(docs.filter(held), words).join(docs.select("doc_id", "good"), "doc_id").collect()
    good, bad = ([r.sentiment_score for r in rows if r.good == g] for g in (True, False))
    above = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert above > 0.7
