"""Near-duplicates, decontamination, components and vectors against brute force."""

import random

import numpy as np
import pytest

from brute import contamination, joined, near_duplicates, shingles
from marketloom.llm import decontaminate, embeddings, graph, minmax
from marketloom.llm.text import shingle_prints

DOCS = "doc_id long, text string, n long, key long, label string"


@pytest.fixture
def docs(spark):
    return lambda texts: spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], DOCS)


def prose(draw, n, words=400):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def edited(draw, text, edits):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10 ** 6)}"
    return " ".join(words)


def test_prints_tell_shingles_apart():
    for text in ["", " \t\n", "one", "A b\x0bc\x0cd e", "é È é è é", "a b a b a b", "x" * 5000, "a b c d e f"]:
        for width in (1, 3, 4):
            prints, words = shingle_prints(text.encode(), width)
            assert len(set(prints.tolist())) == len(shingles(text, width))
            assert len(prints) == (max(1, words - width + 1) if words else 0)
    same, _ = shingle_prints(b"q r s t zz Q  R\ns T", 4)
    assert same[0] == same[-1]


def test_near_duplicates_equal_brute_force(docs):
    draw = random.Random(4)
    base = [prose(draw, 90) for _ in range(12)]
    texts = base + [edited(draw, base[0], draw.randrange(1, 8)) for _ in range(60)]
    texts += [edited(draw, draw.choice(base), draw.randrange(0, 14)) for _ in range(60)] + [base[1].upper()] * 25
    texts += [None, "", "  \n", "one two", "ONE  two", "one two three", "a b c d", prose(draw, 6000)]
    sizes, component = near_duplicates(texts)
    rows = {r["id"]: r for r in minmax.near_duplicates(docs(texts)).collect()}
    assert len(rows) == len(texts)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == component
    assert all(rows[i]["kept"] == (component[i] == i) for i in rows)


def test_sets_that_only_meet_in_a_bucket_with_others_are_compared(spark):
    # a hub unlike the two others, which are alike: one bucket, forced by equal band keys
    sets = spark.createDataFrame([(0, list(range(10))), (1, list(range(5, 15))), (2, list(range(5, 16)))], "id long, prints array<long>")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "a long, b long")
    assert [tuple(r) for r in minmax._linked(pairs, sets, 80).collect()] == [(2, 1)]


def test_near_duplicates_of_odd_tables(spark, docs):
    assert minmax.near_duplicates(docs([]).limit(0)).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "A b c d e"), (None, None)], "doc_id long, text string")
    got = sorted((r["id"] or -1, r["component_id"] or -1, r["kept"]) for r in minmax.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert minmax.deduplicated(rows).count() == 4


def test_one_id_with_two_texts_keeps_both_sets_of_links(spark):
    draw = random.Random(12)
    a, b, c = prose(draw, 120), prose(draw, 120), prose(draw, 120)
    texts = [(1, a), (1, b), (2, edited(draw, a, 2)), (3, edited(draw, b, 2)), (None, c), (None, edited(draw, c, 1)), (None, prose(draw, 90)), (9, "alone here"), (9, a)]
    rows = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], "doc_id long, text string, n int, class string").repartition(4)
    got = sorted((r["id"] or 0, r["component_id"] or 0, r["kept"]) for r in minmax.near_duplicates(rows).collect())
    # 1 stands in the components of both of its texts; components without an id have none
    assert got == [(0, 0, True)] * 3 + [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (9, 1, False), (9, 9, True)]


def test_components_of_unnumbered_texts_take_the_id_of_a_relative(spark):
    draw = random.Random(13)
    a = prose(draw, 120)
    rows = spark.createDataFrame([(None, a), (None, edited(draw, a, 1)), (4, edited(draw, a, 2))], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["component_id"], r["kept"]) for r in minmax.near_duplicates(rows).collect()) == [(0, 4, False), (0, 4, False), (4, 4, True)]


def test_deduplicated_keeps_columns(docs):
    kept = minmax.deduplicated(docs(["a b c d e", "a b c d e", "z", None]))
    assert kept.columns == ["doc_id", "text", "n", "key", "label"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_components(spark):
    draw = random.Random(2)
    shapes = [[(i, i + 1) for i in range(40)], [(99, i) for i in range(50, 99)], [(200, 200)], [(300, 301), (301, 300), (302, 301)]]
    edges = [e for s in shapes for e in s] + [(400 + draw.randrange(80), 400 + draw.randrange(80)) for _ in range(60)]
    want = joined(500, edges)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(500))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(1, prose(random.Random(8), 40)), (2, "short item Of four"), (3, "two words"), (4, "one"), (10, prose(random.Random(9), 13)), (5, None), (6, " ,;"),
         (7, "the of and the of and the of and the of and the of and"), (8, "two words"), (None, "lost item without id")]


def test_contamination_equals_brute_force(spark):
    draw = random.Random(6)
    long, exact = ITEMS[0][1].split(), ITEMS[4][1]
    texts = [None, "", "...", "one", "ONE!", "two, words", "two other words", exact, exact.upper() + " and more", "x " + exact[:-1], " ".join(long[:12]),
             " ".join(long[5:30]), "pre " + " ".join(long[3:18]) + " mid " + " ".join(long[20:38]), "short item\nof  four short item of five", "the of and " * 20,
             "lost item without id", prose(draw, 3000) + " " + exact + " " + prose(draw, 3000), "é one È two words", prose(draw, 700, 30)]
    texts += [prose(draw, 50) + " " + " ".join(long[10:26])] * 3
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, window string, at int")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, n long")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.hits(docs, items).collect()}
    for i, text in enumerate(texts):
        assert got[i] == contamination(text, ITEMS), i
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(texts) if not contamination(t, ITEMS)[-1]]


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", -1)
    docs = spark.createDataFrame([(1, ITEMS[4][1]), (2, "one"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.hits(docs, items).collect()} == {
        i: contamination(t, ITEMS) for i, t in ((1, ITEMS[4][1]), (2, "one"), (3, "x"))}


def test_contamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "two words"), (1, "two words"), (1, "two words"), (1, "other")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontaminate.hits(docs, items).collect()) == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert decontaminate.hits(docs.limit(0), items).count() == 0
    none = decontaminate.hits(docs, items.limit(0)).collect()
    assert len(none) == 4 and not any(r["contaminated"] for r in none)


def vectors_brute(vectors):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / np.abs(v).max()
        return v / np.linalg.norm(v)
    units = [unit(v) for v in vectors]
    links = [(i, j) for i in range(len(units)) for j in range(len(units)) if i != j and units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    return [sum(a == i for a, _ in links) for i in range(len(units))], joined(len(units), links)


@pytest.mark.parametrize("block,piece", [(4096, 1024), (40, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, block, piece):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PIECE", piece)
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(6, 40))
    rows = [(centre[draw.integers(6)] + draw.normal(size=40) * draw.choice([0.05, 0.3, 0.36, 1.0])).tolist() for _ in range(150)]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[1]], [0.0] * 40, None, [], [1.0, None] * 20, [float("nan")] * 40, [float("inf")] + [1.0] * 39]
    rows += [[1.0, 0.0], [1e300, 1e298], [-1.0, 0.0], [1e-300, 0.0]]
    table = spark.createDataFrame([(i, v, 1, "t") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, tile string")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(table).collect()}
    links, component = vectors_brute(rows)
    assert [got[i]["n_links"] for i in range(len(rows))] == links
    assert [got[i]["component_id"] for i in range(len(rows))] == component
    assert all(got[i]["kept"] == (component[i] == i) for i in got)


def test_vectors_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embeddings.near_vectors(odd).collect()) == [(0, 0), (3, 1), (3, 1)]


@pytest.mark.parametrize("block", [4096, 2])
def test_one_id_with_two_vectors_counts_each_by_itself(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.1]), (4, [0.05, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 9, 8) for i, v in rows], "vec_id long, embedding array<double>, low int, id int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(table).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True)]


def test_rotation_puts_the_long_direction_first(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=8) * np.array([1, 1, 9, 1, 1, 1, 1, 1])).tolist()) for i in range(200)]
    turn = embeddings.rotation(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 8)
    assert abs(turn[2, 0]) > 0.9 and np.allclose(turn.T @ turn, np.eye(8))
