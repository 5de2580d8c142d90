"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words that toxic rows use and clean rows do not is learned from
the labelled rows, and every text is turned into a few densities: lexicon words
as written and as found again under an obfuscation, their nearness to
second-person words, capitals, punctuation and obfuscated tokens. Labels,
language, source and id are never features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.llm.text import shingle_prints, small_batches
from marketloom.session import cut_lineage

#: Labelled rows a model is fitted on at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Words a lexicon holds at most.
LEXICON = 200
#: Lexicon entries need this log odds ratio between toxic and clean rows (stems the second), and so many toxic rows.
LOG_ODDS, STEM_ODDS, SUPPORT, SUPPORT_SHARE = 3.0, 2.0, 2, 0.02
#: Standard errors by which a log odds ratio must stay above FLOOR; rare words fall short of it.
SURE, FLOOR = 2.5, 0.5
#: Letters of a stem, which counts for a row where two distinct words begin with it.
STEMS = range(4, 8)
TREES, DEPTH = 20, 3
#: Characters around a lexicon word in which a second-person word counts as near.
NEAR = 40
REJECT = 0.3
#: Words that address a reader (fixed list, four languages).
SECOND_PERSON = ("you your yours yourself yourselves u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos "
                 "tú ti tus usted ustedes vosotros vuestro").split()
FEATURES = ["stem_rate", "stem_kinds", "plain_rate", "plain_kinds", "plain_weight", "hidden_rate", "hidden_kinds", "near_rate", "densest", "second_person_rate",
            "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "digit_rate", "masked_rate", "stretched_rate", "log_words"]

#: Characters written for letters (fixed values).
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_INNER = str.maketrans("", "", ".*_-+'#~^")
_WORD = re.compile(r"[^\W\d_]+")
#: Runs of characters that may stand inside an obfuscated word.
_INSIDE = re.compile(r"[0-9@$!|.*_+#~^-]+(?=[^\W_])")
_SINGLE = re.compile(r"[ .\-_*][^\W\d_][ .\-_*][^\W\d_][ .\-_*]")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_PUNCTUATION = np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)])


class Reader:
    """Features of texts under one lexicon (word to weight; `word*` is a stem)."""

    def __init__(self, entries: dict[str, float]) -> None:
        self.lexicon = lexicon = {w: odds for w, odds in entries.items() if w[-1] != "*"}
        self.stems = {w[:-1] for w in entries if w[-1] == "*"}
        self.find = ahocorasick.Automaton()
        for word in {*lexicon, *self.stems}:
            self.find.add_word(word, word)
        self.find.make_automaton()
        # a word with one inner letter masked out
        self.gapped = {w[:i] + w[i + 1:]: w for w in lexicon if len(w) > 3 for i in range(1, len(w) - 1)}
        self.address = set(SECOND_PERSON) - set(lexicon)

    def words(self, text: str) -> tuple[list[tuple[int, str]], set[int]]:
        """Lexicon words with their starts, and the starts of words with a stem."""
        hits, stems = [], set()
        for end, word in self.find.iter(text) if len(self.find) else ():
            start = end - len(word) + 1
            if start and text[start - 1].isalnum():
                continue
            if word in self.stems:
                stems.add(start)
            if word in self.lexicon and not text[end + 1:end + 2].isalnum():
                hits.append((start, word))
        return hits, stems

    def masked(self, text: str) -> list[str]:
        """Tokens with digits or signs between letters."""
        tokens, done = [], 0
        for m in _INSIDE.finditer(text):
            start, end = m.start(), m.end()
            if start < done or not start or not text[start - 1].isalpha():
                continue
            while start > done and not text[start - 1].isspace() and m.start() - start < 64:
                start -= 1
            while end < len(text) and not text[end].isspace() and end - m.end() < 64:
                end += 1
            tokens.append(text[start:end].strip(".,;:!?*#&%$\"'()"))
            done = end
        return tokens

    def hidden(self, text: str, masked: list[str], stretched: int) -> list[str]:
        """Lexicon words written with other characters, separators, gaps or stretched letters."""
        found = []
        for token in masked:
            bare = token.translate(_INNER)
            for form in (bare.translate(_LEET), token.translate(_LEET), bare):
                word = form if form in self.lexicon else self.gapped.get(form) if form != token else None
                if word and token not in self.lexicon:
                    found.append(word)
                    break
        if _SINGLE.search(text):
            for m in _SPELLED.finditer(text):
                form = re.sub(r"[ .\-_*]", "", m.group())
                found += [w for w in self.lexicon if w in form]
        for m in _STRETCHED.finditer(text) if stretched else ():
            start, end = m.start(), m.end()
            while start and text[start - 1].isalpha() and m.start() - start < 32:
                start -= 1
            while end < len(text) and text[end].isalpha() and end - m.end() < 32:
                end += 1
            token = text[start:end]
            if token not in self.lexicon:
                for form in (_STRETCHED.sub(r"\1", token), _STRETCHED.sub(r"\1\1", token)):
                    if form in self.lexicon:
                        found.append(form)
                        break
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        low, raw = text.lower(), np.frombuffer(text.encode("utf-8", "replace") or b" ", np.uint8)
        codes = np.bincount(raw, minlength=256)
        tokens = low.split()
        chars, words = max(1, len(text)), max(1, len(tokens))
        capital = (raw >= 65) & (raw <= 90)
        run = capital[:-2] & capital[1:-1] & capital[2:]
        shouted = int(run[:1].sum()) + int((run[1:] & ~run[:-1]).sum())
        alike = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:])
        stretched = int((alike & ((raw[2:] | 32) >= 97) & ((raw[2:] | 32) <= 122)).sum())
        masked = self.masked(low)
        hits, stems = self.words(low)
        hidden = self.hidden(low, masked, stretched)
        starts = np.array([s for s, _ in hits])
        near = sum(1 for s, w in hits if not self.address.isdisjoint(_WORD.findall(low[max(0, s - NEAR):s + len(w) + NEAR])))
        densest = int((np.searchsorted(starts, starts + 400, side="right") - np.arange(len(starts))).max()) if hits else 0
        return [100 * len(stems) / words, len({low[s:s + 10] for s in stems}), 100 * len(hits) / words, len({w for _, w in hits}),
                100 * sum(self.lexicon[w] for _, w in hits) / words, 100 * len(hidden) / words, len(set(hidden)),
                near / max(1, len(hits)), densest, 100 * sum(map(self.address.__contains__, tokens)) / words,
                float(codes[65:91].sum()) / chars, 100 * shouted / words, float(codes[_PUNCTUATION].sum()) / chars,
                float(codes[33] + codes[63]) / chars, float(codes[48:58].sum()) / chars,
                100 * len(masked) / words, 100 * stretched / words, math.log1p(words)]


def _featurise(lexicon: dict[str, float]):
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts in batches:
            yield texts.map(reader.features)

    return features


def _words(texts: pd.Series) -> pd.DataFrame:
    """Distinct lowered words and stems, and a min-hash that most copies of a text share."""
    sketches, words = [], []
    with np.errstate(over="ignore"):
        for text in texts:
            prints, _ = shingle_prints((text or "").encode("utf-8", "replace"), 3)
            sketches.append(int(prints.min().view(np.int64)) if len(prints) else 0)
            own = {w for w in _WORD.findall((text or "").lower()) if 2 < len(w) <= 24}
            begun = Counter(w[:k] for w in own for k in STEMS if len(w) > k)
            words.append(sorted([*own, *(f"{stem}*" for stem, n in begun.items() if n > 1)]))
    return pd.DataFrame({"sketch": sketches, "words": words})


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems of the labelled `rows` (text, label) that mark label 1, with
    their log odds, at most LEXICON. Copies count once, through a shared min-hash."""
    words = F.pandas_udf(_words, "struct<sketch: bigint, words: array<string>>")
    seen = (rows.select(words("text").alias("w"), "label").select("w.sketch", "w.words", "label")
            .groupBy("sketch").agg(F.max(F.struct("label", "words")).alias("one")).select("one.*"))
    seen = cut_lineage(seen, "words")
    n = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    least = max(SUPPORT, math.ceil(SUPPORT_SHARE * toxic))
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = (seen.select("label", F.explode("words").alias("word")).groupBy("word")
             .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("t") >= least)
             .select("word", "t", odds.alias("odds"), doubt.alias("doubt"))
             .where(F.col("odds") - SURE * F.col("doubt") >= FLOOR)
             .where(F.col("odds") >= F.when(F.col("word").endswith("*"), STEM_ODDS).otherwise(LOG_ODDS))
             .orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(LEXICON))
    return {r["word"]: r["odds"] for r in found.collect()}


class Model:
    """A lexicon, trees over its features, and their calibration. A constant
    score stands in where the labels hold one class only, or no row."""

    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, constant: float = 0.0) -> None:
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, rows: DataFrame, text: str | Column = "text") -> DataFrame:
        """`rows` with a column `score` from 0 to 1; every other column, whatever
        its name, stays as it is."""
        body = F.col(text) if isinstance(text, str) else text
        packed = small_batches(rows).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), body.cast("string").alias("text"))
        if self.trees is None:
            return packed.select("row.*", F.lit(self.constant).alias("score"))
        dense = packed.select("row", array_to_vector(_featurise(self.lexicon)("text")).alias("features"))
        raw = self.trees.transform(dense).select("row", vector_to_array("probability")[1].alias("raw"))
        return self.calibration.transform(raw).select("row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias("score"))


def fit(rows: DataFrame) -> Model:
    """A model from labelled `rows` (id, text, label 0 or 1), a bounded sample.
    A quarter of them, by a hash of the id, is kept for the calibration."""
    rows = cut_lineage(rows.select("id", "text", F.col("label").cast("int").alias("label")), "labelled")
    parts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not parts.get(0) or not parts.get(1):
        return Model({}, constant=1.0 if parts.get(1) else 0.0)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4))
    learn, keep = rows.where(part != 0), rows.where(part == 0)
    lexicon = learn_lexicon(learn)
    dense = cut_lineage(rows.select("id", _featurise(lexicon)("text").alias("values"), F.col("label").cast("double").alias("label")), "dense")
    dense = dense.select("id", "label", array_to_vector("values").alias("features"))
    fitted, held = dense.where(part != 0), dense.where(part == 0)
    if fitted.select("label").distinct().count() < 2 or held.select("label").distinct().count() < 2:
        fitted = held = dense
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=2, seed=7, checkpointInterval=-1).fit(fitted)
    raw = trees.transform(held).select(vector_to_array("probability")[1].alias("raw"), "label")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw)
    return Model(lexicon, trees, calibration)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels of `docs` outside the held-out quarter, at most
    FIT_ROWS of them. Null labels and ids are left out; an id that is labelled
    more than once takes its largest label; repeated rows of an id count as one."""
    marked = (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("label"))
              .where("id is not null and label in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label")))
    sample = cut_lineage(marked.orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(FIT_ROWS), "sample")
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(sample), "id").dropDuplicates(["id"]))  # FIT_ROWS bounds the broadcast
    return fit(rows)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted` (score >= 0.3), one row
    for each row. A null or blank text is scored by its features like any other."""
    scored = fit_on(docs, labels).score(docs)
    return scored.select("*", held_out(F.col("doc_id")).alias("held_out"), (F.col("score") >= REJECT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, in their own columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return fit_on(docs, labels).score(packed).where(F.col("score") < REJECT).select("row.*")
