"""Histogram boosting against a plain form, in one task and over many, and exact attribution."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import params as P
from marketloom.operators import boosting as B
from marketloom.operators import learning
from marketloom.plans import research
from test_models import panel

FEATURES = ["a", "b", "c", "d"]


def data(n=900, log=False, seed=1, models=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = np.round(x[:, 3])  # few values, many ties
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) * x[:, 1] + 0.4 * x[:, 3] + 0.2 * rng.normal(size=n)
    return rng.integers(0, models, n), x, (y > 0.2).astype(float) if log else y


def table(spark, model, x, y):
    return spark.createDataFrame([(int(m), float(v), list(map(float, row))) for m, v, row in zip(model, y, x)],
                                 "model int, label double, x array<double>").repartition(5)


def plain(x, y, log, rounds, depth, rate, edges):
    """Boosting as a recursion over rows: each node tries every edge of every feature."""
    n, up = len(y), y.sum()
    w = np.where(y == 1, n / (2 * max(up, 1)), n / (2 * max(n - up, 1))) if log else np.ones(n)
    f = np.zeros(n) if log else np.full(n, y.mean())
    trees = []

    def grow(rows, g, h, level):
        best, total = None, g[rows].sum() ** 2 / h[rows].sum()
        node = {"value": -rate * g[rows].sum() / h[rows].sum(), "n": len(rows)}
        for i, e in enumerate(edges if level < depth else []):
            for cut in e:
                left, right = rows[x[rows, i] <= cut], rows[x[rows, i] > cut]
                if min(len(left), len(right)) < B.MIN_LEAF:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - total
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9 * gain):
                    best = gain, i, cut, left, right
        if best:
            node |= {"feature": best[1], "cut": best[2], "left": grow(best[3], g, h, level + 1), "right": grow(best[4], g, h, level + 1)}
        return node

    def value(node, row):
        while "feature" in node:
            node = node["left" if row[node["feature"]] <= node["cut"] else "right"]
        return node["value"]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = ((p - y) * w, p * (1 - p) * w) if log else (f - y, np.ones(n))
        trees.append(grow(np.arange(n), g, h, 0))
        f = f + np.array([value(trees[-1], row) for row in x])
    return f, trees


@pytest.mark.parametrize("log", [False, True])
def test_boosting_equals_the_plain_form(spark, log, monkeypatch):
    model, x, y = data(log=log)
    plan = B.Plan(B.Loss(log), 4, 3, 0.1)
    monkeypatch.setattr(B, "BINS", 40)
    inside = B.fit_many(plan, table(spark, model, x, y), FEATURES)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    across = B.fit_many(plan, table(spark, model, x, y), FEATURES)
    for m in (0, 1):
        own = model == m
        want, _ = plain(x[own], y[own], log, 4, 3, 0.1, inside[m].edges)
        assert np.allclose(inside[m].margin(x[own]), want, atol=1e-6)
        assert (inside[m].margin(x) == across[m].margin(x)).all()  # the same trees, wherever the rows lie


def test_edges_of_both_paths_agree(spark):
    model, x, y = data()
    fitted = B.fit_many(B.Plan(B.Loss(False), 1, 1), table(spark, model, x, y), FEATURES)
    for m in (0, 1):
        assert all((a == b).all() for a, b in zip(fitted[m].edges, B.quantile_edges(x[model == m])))


def test_checkpoints_and_many_parts_change_nothing(spark, monkeypatch):
    model, x, y = data(600)
    plan = B.Plan(B.Loss(False), 7, 3, 0.1)
    want = B.fit_many(plan, table(spark, model, x, y), FEATURES)
    for name, value in (("BLOCK_ROWS", 50), ("DIRECT_PARTS", 3), ("CHECKPOINT_ROUNDS", 2)):
        monkeypatch.setattr(B, name, value)
    got = B.fit_many(plan, table(spark, model, x, y), FEATURES)
    assert all((want[m].margin(x) == got[m].margin(x)).all() for m in (0, 1))


def test_models_split_on_their_own_features_only(spark):
    model, x, y = data()
    got = B.fit_many(B.Plan(B.Loss(False), 10, 4), table(spark, model, x, y), FEATURES, {1: ["c", "d"]})
    used = {m: {int(f) for t in got[m].trees for f in t.feature if f >= 0} for m in (0, 1)}
    assert used[1] <= {2, 3} and 0 in used[0]
    narrow = B.narrowed(got[1], [2, 3])
    assert (narrow.margin(x[:, 2:]) == got[1].margin(x)).all()


def test_trees_keep_to_their_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9_000, 4))
    y = np.sin(3 * x).sum(1)
    tree = B.fit_here(B.Plan(B.Loss(False), 1, 6, 1.0), x, y).trees[0]
    assert (tree.feature >= 0).sum() == B.MAX_LEAVES - 1
    kept = tree.gain[tree.feature >= 0].min()
    # what was left out below a kept split is worth less than every kept split
    children = {c for i in np.flatnonzero(tree.feature >= 0) for c in (2 * i + 1, 2 * i + 2)}
    assert all(tree.gain[c] <= kept for c in children if tree.feature[c] < 0)


def test_odd_tables(spark):
    plan = B.Plan(B.Loss(True), 3, 2)
    empty = table(spark, *data(5)).limit(0)
    assert B.fit_many(plan, empty, FEATURES) == {}
    one = spark.createDataFrame([(0, 1.0, [1.0] * 4)] * 50 + [(1, float(i % 2), [0.0] * 4) for i in range(50)], "model int, label double, x array<double>")
    got = B.fit_many(plan, one, FEATURES)
    assert got[0].margin(np.ones((1, 4)))[0] == 30.0      # one class only
    assert got[1].margin(np.ones((1, 4)))[0] == 0.0       # nothing to split on
    assert learning.fit_boosted(plan, []) == []


def known_margin(model, row, known):
    """The margin when only the features `known` are known, by walking every tree."""
    def walk(t, node):
        f = int(t.feature[node])
        if f < 0:
            return t.value[node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return walk(t, left if row[f] <= t.bin[node] else right)
        return (t.cover[left] * walk(t, left) + t.cover[right] * walk(t, right)) / t.cover[node]

    return model.start + sum(walk(t, 0) for t in model.trees)


def test_attribution_equals_enumeration():
    _, x, y = data(800, seed=5)
    model = B.fit_here(B.Plan(B.Loss(False), 15, 5, 0.2), x, y)
    some = x[:12]
    got, codes = B.contributions(model, some), model.codes(some)
    for r, row in enumerate(codes):
        for i in range(4):
            want = 0.0
            for size in range(4):
                for others in itertools.combinations(set(range(4)) - {i}, size):
                    weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                    want += weight * (known_margin(model, row, {*others, i}) - known_margin(model, row, set(others)))
            assert got[r, i] == pytest.approx(want, abs=1e-10)
    assert B.expected(model) == pytest.approx(known_margin(model, codes[0], set()), abs=1e-10)


def test_attribution_adds_up_to_the_margin(spark):
    rows = panel(spark, "rsi_14")
    model = learning.fit_direction(rows, P.TECHNICAL_FEATURES, "target_dir_5d", "boosted", rounds=30)
    some = rows.limit(20)
    total = {(r.ticker, r.d): r.s for r in learning.tree_attribution(model, some, P.TECHNICAL_FEATURES, ["ticker", "d"])
             .groupBy("ticker", "d").agg(F.sum("contribution").alias("s")).collect()}
    base = B.expected(model.ensemble)
    for r in some.withColumn("m", B.margins({0: model.ensemble}, F.lit(0), learning.feature_array(P.TECHNICAL_FEATURES))).collect():
        assert total[r.ticker, r.d] + base == pytest.approx(r.m, abs=1e-9)


def test_every_ticker_has_the_report_of_its_own_model(spark):
    data = panel(spark, "rsi_14", days=200, tickers=3)
    data = data.filter((F.col("ticker") != "T2") | (F.col("d") < F.lit("2015-03-01")))  # too short for a report
    rows = {r.ticker: r.asDict() for r in research.predict_tickers(data, rounds=8).collect()}
    assert set(rows) == {"T0", "T1"}
    for t, row in rows.items():
        alone = research.predict_panel(data, t, rounds=8).first().asDict()
        assert set(row) == set(alone)
        for c, v in alone.items():
            assert row[c] == (pytest.approx(v) if isinstance(v, float) else v), c
