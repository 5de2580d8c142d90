"""Cross-fitted text scores: nothing is scored by a model that has seen it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import learning

CLASSES = ["p0", "p1", "p2"]
SCHEMA = "doc_id int, text string, label int, fold string"


def corpus(n=240):
    rng, words = random.Random(1), [["profit", "record", "surge"], ["loss", "fraud", "slump"], ["meeting", "notice", "update"]]
    rows = []
    for i in range(n):
        label = i % 3
        text = " ".join([rng.choice(words[label])] + [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)] + [f"n{i}"])
        rows.append((i, text, label, "clash"))
    return rows


def test_held_out_scores(spark):
    rows = corpus()
    # a label that no word explains: only a model that saw the row can know it
    odd = [(1000 + i, f"alpha beta secret{chr(97 + i)}", i % 3, None) for i in range(12)]
    copies = [(2000, rows[0][1], None, None), (2001, rows[0][1], 2, None), (2002, None, None, None), (2003, "", None, None)]
    out = {r.doc_id: r for r in learning.cross_fitted_texts(spark.createDataFrame(rows + odd + copies, SCHEMA), CLASSES).collect()}
    assert len(out) == len(rows + odd + copies)
    assert all(math.isclose(r.p0 + r.p1 + r.p2, 1.0, abs_tol=1e-9) for r in out.values())
    assert out[0].fold == out[2000].fold == out[2001].fold and out[2002].fold == out[2003].fold
    assert [out[2000][c] for c in CLASSES] == [out[0][c] for c in CLASSES]
    assert len({r.temperature for r in out.values()}) == 1 and out[0].temperature in learning.TEMPERATURES
    loss = [-math.log(out[i][f"p{label}"]) for i, _, label, _ in rows]
    assert sum(loss) / len(loss) < 0.3 < math.log(3)
    right = sum(max(range(3), key=lambda k: out[i][f"p{k}"]) == label for i, _, label, _ in odd)
    assert right < len(odd)


def test_temperature_does_not_worsen_the_held_out_loss(spark):
    out = learning.cross_fitted_texts(spark.createDataFrame(corpus(), SCHEMA), CLASSES)
    t = out.first().temperature
    # undo the temperature to get the plain probabilities back
    plain = learning.tempered(CLASSES, F.lit(1 / t))
    loss = learning.class_log_loss
    row = out.agg(F.avg(loss([F.col(c) for c in CLASSES], F.col("label"))).alias("own"), F.avg(loss(plain, F.col("label"))).alias("plain")).first()
    assert row.own <= row.plain + 1e-9


def test_without_labels_probabilities_are_equal(spark):
    for rows in ([], [(1, "a b", None, None), (2, "c", None, None)], [(1, "a b", 1, None), (2, "c", 1, None)]):
        got = learning.cross_fitted_texts(spark.createDataFrame(rows, SCHEMA), CLASSES).collect()
        assert len(got) == len(rows)
        assert all(r[c] == pytest.approx(1 / 3) for r in got for c in CLASSES)


def test_log_loss_of_a_row_without_a_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5, 0.0), (None, 0.5, 0.5), (2, 0.5, 0.5), (0, 0.25, 0.75)], "label int, p0 double, p1 double")
    got = [r.x for r in df.select(learning.class_log_loss([F.col("p0"), F.col("p1")], F.col("label")).alias("x")).collect()]
    assert got == [pytest.approx(-math.log(1e-12)), None, None, pytest.approx(-math.log(0.25))]


def test_fits_read_hashed_counts(spark, monkeypatch):
    """No fit splits a text again: it reads the counts that were written once."""
    fit, read = learning.LogisticRegression.fit, []
    monkeypatch.setattr(learning.LogisticRegression, "fit", lambda self, rows, *a: read.append((rows.columns, rows.inputFiles())) or fit(self, rows, *a))
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    assert learning.cross_fitted_texts(docs, CLASSES).count() == 60
    model = learning.text_classifier(docs.withColumn("label", F.col("label").cast("double")))
    out = learning.text_probabilities(model, docs.select("doc_id", "text"), CLASSES)
    assert out.columns == ["doc_id", "text", *CLASSES] and out.count() == 60
    assert len(read) == 4
    assert all("words" not in columns and files and all("hashed-words" in f for f in files) for columns, files in read)


def mislabelled(n=120):
    """The corpus with every fourth label wrong, so that the best temperature is no extreme."""
    rng = random.Random(2)
    return [(i, text, rng.randrange(3) if i % 4 == 0 else label, fold) for i, text, label, fold in corpus(n)]


@pytest.mark.parametrize("folds", [2, 3])
def test_no_label_of_a_fold_has_a_part_in_its_nested_scores(spark, folds):
    def scores(rows):
        out = learning.cross_fitted_texts(spark.createDataFrame(rows, SCHEMA), CLASSES, folds=folds, features=256, nested=True)
        return {r.doc_id: r for r in out.collect()}

    rows = mislabelled()
    plain = scores(rows)
    changed = scores([(i, text, (label + 1) % 3 if plain[i].fold == 0 else label, c) for i, text, label, c in rows])
    assert {r.fold for r in plain.values()} == set(range(folds))
    for i, r in plain.items():
        same = [changed[i][c] == pytest.approx(r[c], abs=1e-9) for c in ("temperature", *CLASSES)]
        # the other folds' models were fitted on the changed labels
        assert all(same) if r.fold == 0 else not all(same)
    assert len({r.temperature for r in plain.values()}) == folds


def test_nested_temperature_has_the_least_loss(spark):
    rng = random.Random(3)
    rows = [(fold, rng.choice([label, label, rng.randrange(2)]), x := rng.uniform(0.5, 0.99 - fold / 9) if label == 0 else rng.uniform(0.01, 0.5), 1 - x)
            for fold in (0, 1) for label in (0, 1) for _ in range(150)]
    df = spark.createDataFrame([*rows, (0, None, 0.5, 0.5)], "fold int, label int, p0 double, p1 double")
    best = learning.least_loss(df, ["p0", "p1"], [learning.WIDE] * 3, zooms=3)

    def loss(fold, t):
        own = [(p0, p1)[label] for f, label, p0, p1 in rows if f == fold]
        return sum(math.log(1 + ((1 - p) / p) ** (1 / t)) for p in own) / len(own)

    assert best[2] == 1 and best[0] not in learning.WIDE
    assert all(loss(k, best[k]) <= min(loss(k, best[k] * s) for s in (0.99, 0.999, 1.001, 1.01)) + 1e-7 for k in (0, 1))


def test_text_fits_end_by_their_tolerance(spark):
    """Few rows of few words whose labels they do not explain take more than 50 steps."""
    rng = random.Random(4)
    words = ["w" + chr(97 + i) + chr(97 + j) for i in range(20) for j in range(20)]
    rows = [(" ".join(rng.choice(words[:1 + 4 * rng.randrange(1, 100)]) for _ in range(rng.randrange(5, 400))), float(rng.randrange(3))) for _ in range(300)]
    model = learning.text_classifier(spark.createDataFrame(rows, "text string, label double"), features=1024)
    assert 50 < model.stages[-1].summary.totalIterations < learning.TEXT_ITERATIONS


def test_texts_equal_to_a_model_share_a_fold(spark):
    rows = corpus(30) + [(100 + i, f"  {text.upper()}! 7", None, None) for i, text, _, _ in corpus(30)]
    out = {r.doc_id: r.fold for r in learning.cross_fitted_texts(spark.createDataFrame(rows, SCHEMA), CLASSES).collect()}
    assert all(out[i] == out[100 + i] for i in range(30)) and len(set(out.values())) == 3


def test_share_loss_counts_the_other_folds(spark):
    rows = corpus(60)
    out = learning.cross_fitted_texts(spark.createDataFrame(rows + [(100, "alpha", None, "x")], SCHEMA), CLASSES, features=256)
    out = {r.doc_id: r for r in out.collect()}
    assert out[100].share_loss is None
    for i, _, label, _ in rows:
        others = [l for j, _, l, _ in rows if out[j].fold != out[i].fold]
        assert out[i].share_loss == pytest.approx(-math.log(others.count(label) / len(others)))


def test_query_holds_the_columns_it_names(spark, tmp_path):
    """Blank texts are neutral as in `text_model_scores`, and the loss stands beside that of the class shares."""
    from __spark_entry__ import queries

    texts = [(i, text) for i, text, _, _ in corpus(30)] + [(100, " "), (101, ""), (102, None)]
    docs = spark.createDataFrame([(i, text, "en", "web") for i, text in texts], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 == 0), int(i % 3 == 1)) for i in range(27)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in queries()["text_model_held_out"](spark, str(tmp_path)).collect()}
    assert out.keys() == {i for i, _ in texts}
    assert all((out[i].sentiment_score, out[i].sentiment_label) == (0.0, "neu") for i in (100, 101, 102))
    assert all(out[i].sentiment_score == pytest.approx(out[i].p_pos - out[i].p_neg, abs=2e-6) for i in range(30))
    assert all((out[i].log_loss is None) == (out[i].share_log_loss is None) == (i >= 27) for i in out)
