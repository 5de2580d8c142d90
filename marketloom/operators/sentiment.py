"""Sentiment scoring and the daily index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions import params as P
from marketloom.functions.text import label_from_compound
from marketloom.operators.rows import beside


def daily_index(news: DataFrame) -> DataFrame:
    """Mean, median and label counts per (asset, day).

    News is first counted per (asset, day, score, label) with map-side combine,
    so a day that holds a large share of all news shuffles as a few counted
    scores; the median is then taken over counts and stays exact.
    """
    counted = news.groupBy("asset_id", "published_d", "sentiment_score", "sentiment_label").agg(
        F.count(F.lit(1)).alias("n"))
    score, n = F.col("sentiment_score"), F.col("n")
    scored = F.sum(F.when(score.isNotNull(), n))
    label = lambda name: F.coalesce(F.sum(F.when(F.col("sentiment_label") == name, n)), F.lit(0))
    return counted.groupBy("asset_id", F.col("published_d").alias("d")).agg(
        F.coalesce(scored, F.lit(0)).alias("news_count"),
        # 12 decimals: what the order of summation leaves behind is not a sign
        (F.round(F.try_divide(F.sum(score * n), scored.cast("double")), 12) + 0.0)
        .alias("sentiment_mean"),
        F.percentile(score, 0.5, n).alias("sentiment_median"),
        label("pos").alias("pos_count"), label("neu").alias("neu_count"),
        label("neg").alias("neg_count"))


def lexicon(base: dict[str, float] | None = None, overrides: dict[str, float] | None = None) -> dict[str, float]:
    """Word valences; an override replaces the entry of the same lower-case word."""
    words = {k.lower(): float(v) for k, v in (base or P.LEXICON).items()}
    words.update({k.lower(): float(v) for k, v in (overrides or {}).items()})
    return words


def lexicon_scores(texts: DataFrame, words: dict[str, float], key: str = "doc_id",
                   text: str = "text", norm: float = P.LEXICON_NORM) -> DataFrame:
    """Compound score in [-1, 1] and label per text, one row per row.

    The lexicon is a small parameter, so a text is scored where it lies: its
    words, runs of letters of any script, are filtered by the lexicon and the
    few that are left are summed in whole ten-thousandths.
    """
    found = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: w.isin(list(words)))
    points = F.create_map(*[F.lit(x) for w, v in words.items() for x in (w, round(v * 10_000))])
    total = F.aggregate(found, F.lit(0).cast("bigint"), lambda s, w: s + F.element_at(points, w).cast("bigint"))
    valence = texts.select(key, (total / 10_000.0).alias("valence"))
    compound = F.col("valence") / F.sqrt(F.col("valence") * F.col("valence") + norm)
    return (valence.withColumn("sentiment_score", compound)
            .withColumn("sentiment_label", label_from_compound("sentiment_score"))
            .drop("valence"))


def spoken_words(text: str | Column) -> Column:
    """Words of a text: runs of letters of any script with apostrophes inside."""
    plain = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "’", "'")
    return F.filter(F.transform(F.split(plain, r"[^\p{L}']+"), lambda t: F.trim(t, F.lit("'"))), lambda t: t != "")


def rule_scores(texts: DataFrame, words: dict[str, float], key: str = "doc_id",
                text: str = "text", norm: float = P.LEXICON_NORM) -> DataFrame:
    """Compound score in [-1, 1] and label per text by the rules of valence
    scoring, one row per row; columns as `lexicon_scores`.

    A word of the lexicon is stronger in capitals where others are not; boosters
    and dampeners among the three words before it change it less with distance,
    negations there turn it round; what stands before the first "but" counts
    half and what follows half more; exclamation and repeated question marks
    strengthen the whole. Words of the lexicon in between do none of this. Only
    the places of lexicon words are looked at again, with a fold over the three
    words before each; the sum is taken in whole millionths, so that it does not
    depend on its order. Null and empty texts score 0."""
    capital = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    read = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), spoken_words(text).alias("_words"))
    read = read.withColumn("_low", F.transform("_words", F.lower))
    shouted = F.size(F.filter("_words", capital))
    read = read.withColumns({
        "_mixed": (shouted > 0) & (shouted < F.size("_words")), "_but": F.array_position("_low", "but"),
        "_places": F.array_compact(F.transform("_low", lambda w, i: F.when(w.isin(list(words)), i)))})
    points = F.create_map(*[F.lit(x) for w, v in words.items() for x in (w, float(v))])

    def emphasis(word: Column) -> Column:
        return F.when(F.col("_mixed") & capital(word), P.CAPITALS_STEP).otherwise(0.0)

    def before(at: Column, k: int, weight: float) -> Column:
        """What the k-th word before does: a step along the sign, and a factor."""
        word, low = F.get("_words", at - k), F.get("_low", at - k)
        free = low.isNotNull() & ~low.isin(list(words))
        step = F.when(low.isin(P.BOOSTERS), P.DEGREE_STEP).when(low.isin(P.DAMPENERS), -P.DEGREE_STEP)
        negates = low.isin(P.NEGATIONS) | low.endswith("n't")
        return F.struct(F.coalesce(F.when(free, (step + emphasis(word)) * weight), F.lit(0.0)).alias("step"),
                        F.when(free & negates, P.NEGATION_FACTOR).otherwise(1.0).alias("factor"))

    def strength(at: Column) -> Column:
        own = F.element_at(points, F.get("_low", at))
        own = own + F.signum(own) * emphasis(F.get("_words", at))
        around = F.array(*[before(at, k, w) for k, w in enumerate(P.DEGREE_BY_DISTANCE, 1)])
        found = F.aggregate(around, own, lambda v, c: (v + F.signum(v) * c["step"]) * c["factor"])
        share = F.when(F.col("_but") == 0, 1.0).when(at + 1 < F.col("_but"), P.BEFORE_BUT).otherwise(P.AFTER_BUT)
        return F.round(found * share * 1_000_000.0).cast("bigint")

    total = F.aggregate(F.transform("_places", strength), F.lit(0).cast("bigint"), lambda s, v: s + v) / 1_000_000.0
    bangs = F.least(F.regexp_count("_text", F.lit("!")), F.lit(P.EXCLAMATIONS)) * P.EXCLAMATION_STEP
    asked = F.regexp_count("_text", F.lit(r"\?"))
    marks = bangs + F.when(asked > P.QUESTIONS, P.MANY_QUESTIONS).when(asked > 1, asked * P.QUESTION_STEP).otherwise(0.0)
    summed = read.select(key, total.alias("_sum"), marks.alias("_marks"))
    summed = summed.select(key, (F.col("_sum") + F.signum("_sum") * F.col("_marks")).alias("_valence"))
    compound = F.col("_valence") / F.sqrt(F.col("_valence") * F.col("_valence") + norm)
    return summed.select(key, compound.alias("sentiment_score")).withColumn("sentiment_label", label_from_compound("sentiment_score"))


def learned_valences(labelled: DataFrame, known: dict[str, float], text: str = "text", good: str = "good",
                     min_texts: int = 5, least: float = 1.0, sure: float = 3.0, most: int = 300) -> DataFrame:
    """(word, n_good, n_bad, valence): words that set texts apart, at most
    `most`, beside those already `known`.

    `labelled` holds texts with a boolean `good`; rows without one do not count.
    A valence is the smoothed log odds of a word's texts, held to -4 .. 4, and at
    least `sure` standard errors from 0; the surest words come first, ties by
    code point. Words shuffle once, as counts."""
    rows = labelled.filter(F.col(good).isNotNull())
    totals = rows.agg(F.count_if(F.col(good)).alias("g"), F.count_if(~F.col(good)).alias("b"))
    words = rows.select(F.col(good).alias("_good"), F.explode(F.array_distinct(F.transform(spoken_words(text), F.lower))).alias("word"))
    counted = words.groupBy("word").agg(F.count_if("_good").alias("n_good"), F.count_if(~F.col("_good")).alias("n_bad"))
    counted = beside(counted.filter((F.col("n_good") + F.col("n_bad") >= min_texts) & ~F.col("word").isin(list(known))), totals)
    odds = F.ln(((F.col("n_good") + 1.0) / (F.col("g") + 2.0)) / ((F.col("n_bad") + 1.0) / (F.col("b") + 2.0)))
    counted = counted.select("word", "n_good", "n_bad", odds.alias("odds"))
    valence = F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("odds"))), 4)
    errors = F.round(F.abs("odds") / F.sqrt(1.0 / (F.col("n_good") + 1.0) + 1.0 / (F.col("n_bad") + 1.0)), 4)
    scored = counted.select("word", "n_good", "n_bad", valence.alias("valence"), errors.alias("errors"))
    scored = scored.filter((F.abs("valence") >= least) & (F.col("errors") >= sure))
    return scored.orderBy(F.col("errors").desc(), "word").limit(most).drop("errors")


def with_learned(known: dict[str, float], learned: DataFrame) -> dict[str, float]:
    """A lexicon with learned words, which their operator bounds, beside the known ones."""
    return {**{r["word"]: r["valence"] for r in learned.collect()}, **known}


def failure_policy(scored: DataFrame) -> DataFrame:
    """A text the scorer could not score counts as (0, neu)."""
    return scored.withColumns({
        "sentiment_score": F.coalesce("sentiment_score", F.lit(0.0)),
        "sentiment_label": F.coalesce("sentiment_label", F.lit("neu"))})
