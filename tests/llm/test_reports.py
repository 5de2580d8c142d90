"""Filter audit, ranked search and line bitmaps against plain Python forms."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from brute import alnum_words, spaced_words
from marketloom.llm import audit, lines, ranked
from marketloom.llm.queries import op11_filter_audit, op12_ranked_search, op13_line_dedup  # noqa: F401 (registered names)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n int, good string, rank int, query int, mask int, pos int, doc long"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) beside columns whose names clash."""
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3, 4, 5, 6) for i, t, s in rows], DOCS).repartition(3)


def some_words(draw, n, spread=40):
    return " ".join(f"w{draw.randrange(spread)}" for _ in range(n))


def odd_rows(draw):
    long = some_words(draw, 60_000, 5_000)
    repeated = some_words(draw, 300, 400)
    rows = [(i, repeated, "hot") for i in range(5, 60)]                      # a group of copies
    rows += [(100 + i, some_words(draw, draw.randrange(1, 400), 600), draw.choice(["a", "hot", None, ""])) for i in range(60)]
    rows += [(200, "", "a"), (201, None, "a"), (202, None, None), (203, " \t\n\x0b\r ", "a"), (204, long, "a"), (205, long, "hot")]
    rows += [(300, "twice", "a"), (300, "twice", "a"), (300, "other text", "a"), (None, "twice", "a"), (None, "alone", "b"), (None, "alone", "b")]
    rows += [(310, "ONE TWO THREE", "a"), (311, "price is 5 $", "a"), (312, "é" * 300 + " A", "ü"), (313, "x" + " " + "y", "a")]
    return rows


def audited(rows, labels):
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        t, words = t or "", spaced_words(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(texts[t]) < i}
        parts[s or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part, own in parts.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in own) - len(gone),
                                                   sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("blocks", [1 << 16, 1])
def test_audit_equals_brute_force(spark, blocks):
    draw = random.Random(3)
    rows = odd_rows(draw)
    labels = [(i, draw.randrange(2), draw.randrange(2)) for i in range(0, 400, 3)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (9999, 1, 1)]
    counts = audit.combinations(docs_of(spark, rows), spark.createDataFrame(labels, LABELS), max_blocks=blocks)
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.orders(counts).collect()}
    assert got == audited(rows, labels)


def test_audit_of_a_full_sketch(spark, monkeypatch):
    """When every cell is raised by many texts nothing is cleared, and nothing changes."""
    monkeypatch.setattr(audit, "BLOCK_CELLS", 8)
    rows = odd_rows(random.Random(4))
    counts = audit.combinations(docs_of(spark, rows), spark.createDataFrame([], LABELS), max_blocks=1)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in audit.orders(counts).collect()} == audited(rows, [])


def test_sketch_clears_unique_texts_only(spark):
    texts = [f"text {i}" for i in range(3_000)] + [f"text {i}" for i in range(0, 300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) AS print")
    seen = audit.with_repeats(rows, audit.repeated_cells(rows, 2), 2).collect()
    again = {r["t"] for r in seen if r["repeat"]}
    assert {f"text {i}" for i in range(300)} <= again and len(again) < 300 + 3_000 * 0.02


def test_audit_of_an_empty_table(spark):
    docs, labels = docs_of(spark, [(1, "x", "a")]).limit(0), spark.createDataFrame([(1, 1, 1)], LABELS)
    assert audit.filter_audit(docs, labels).count() == 0


def ranking(rows, items, top=10):
    words = [(i, alnum_words(t)) for i, t, *_ in rows]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = collections.Counter(t for _, w in words for t in set(w))
    by = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            by[item] |= set(alnum_words(text))
    out = {}
    for item, terms in by.items():
        scored = []
        for i, w in words:
            tf, score = collections.Counter(w), 0
            for t in terms:
                if tf[t]:
                    m = 10 + 90 * len(w) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            out[item, rank] = (i, -score)
    return out


def searched(found):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("width, block_items", [(512, 2_000), (4, 3)])
def test_search_equals_brute_force(spark, width, block_items):
    draw = random.Random(5)
    rows = odd_rows(draw) + [(400, "w1 w2 É été W1-w2_w3", "a"), (None, "w1 w1", "a")]
    items = [(i, some_words(draw, draw.randrange(1, 12), 700)) for i in range(8)]
    items += [(8, "w1 W1 w2"), (8, "été"), (9, None), (10, "!!"), (11, "nowhere"), (None, "w1"), (12, "w1"), (12, "w1"), (13, "twice")]
    table = spark.createDataFrame([(i, t, 7, 8) for i, t in items], "item_id long, text string, doc_id int, score int")
    want = ranking(rows, items)
    assert searched(ranked.best_documents(docs_of(spark, rows), table, width=width, block_items=block_items)) == want
    assert any(r is None for r, _ in want.values()) and len({i for i, _ in want}) > 8


def test_search_of_ties_takes_the_smallest_ids(spark):
    """Far more equal documents than there are places, over several tasks and chunks."""
    rows = [(i, "same words here", "a") for i in range(3_000, 0, -1)] + [(10_000 + i, "other", "a") for i in range(6_000)]
    found = searched(ranked.best_documents(docs_of(spark, rows), spark.createDataFrame([(1, "words")], "item_id long, text string")))
    assert [found[1, r][0] for r in range(1, 11)] == list(range(1, 11))


def test_bounds_prune_and_never_cut(spark):
    """Rescored documents are few, and a bound is never below its score."""
    draw = random.Random(6)
    n, terms = 4_000, 400
    held = [np.unique(np.array([draw.randrange(terms) for _ in range(20)])) for _ in range(n)]
    counts = [np.array([draw.randrange(1, 4) for _ in h]) for h in held]
    lengths, sizes = np.array([int(c.sum()) + draw.randrange(200) for c in counts]), np.array([len(h) for h in held])
    queries = [np.unique(np.array([draw.randrange(terms) for _ in range(10)])) for _ in range(20)]
    scorer = ranked.Scorer(queries, np.array([draw.randrange(1, 8_000) for _ in range(terms)]), n, int(lengths.sum()))
    flat, tf = np.concatenate(held), np.concatenate(counts)
    rows = np.repeat(np.arange(n), sizes)
    impacts = scorer.impacts(lengths[rows], flat, tf)
    bounds = scorer.sketches(rows, n, flat, impacts).astype(float) @ scorer.lookup
    exact = np.stack([scorer.scores(q, np.arange(n), rows * terms + flat, impacts) for q in range(20)], axis=1)
    assert (bounds >= exact).all()
    best = ranked._Best(20, 10)
    scored = scorer.take(best, np.arange(n), lengths, sizes, flat, tf)
    assert scored < 0.05 * n * 20
    for q in range(20):
        order = np.lexsort((np.arange(n), -exact[:, q]))[:10]
        assert best.ids[q].tolist() == order.tolist() and best.scores[q].tolist() == exact[order, q].tolist()


def test_search_of_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "x", "a"), (2, None, "a")]), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert ranked.best_documents(docs.limit(0), items).count() == 0
    assert ranked.best_documents(docs, items.limit(0)).count() == 0
    assert ranked.best_documents(docs.where("text is null"), items).count() == 0


def line_rows():
    draw = random.Random(7)
    rows = [(i, "\n".join([f"only in {i}", "  Shared LINE\t", "", f"pair {i // 2}", "shared line"]), "a") for i in range(40)]
    rows += [(100 + i, "nine of these\n\n" * 3, "a") for i in range(9)]
    rows += [(200 + i, "É ten\nÉ TEN ", "a") for i in range(10)]
    rows += [(300, None, "a"), (301, "", "a"), (302, "\n", "a"), (303, "shared line", "a"), (304, "a\r\nshared line\r\n\x0bb", "a")]
    rows += [(400, "\n".join(draw.choice(["shared line", f"line {k}", ""]) for k in range(60_000)), "a")]
    rows += [(500, "shared line\nx", "a"), (500, "shared line\nx", "a"), (500, "y", "a"), (None, "shared line\nz", "b"), (None, "shared line\nz", "b"),
             (None, "shared line", "b")]
    return rows


def split_keys(text):
    own = (text or "").split("\n")
    return own, [s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for s in own]


def kept_lines(rows, min_docs=10, min_chars=1, keep_first=False):
    at = collections.defaultdict(set)
    for i, t, _ in rows:
        for p, k in enumerate(split_keys(t)[1]):
            at[k].add((i is not None, i or 0, t or "", p))
    shared = {k: min((x[:2], x[3]) for x in own) for k, own in at.items() if len(k) >= min_chars and len({x[:3] for x in own}) >= min_docs}
    out = []
    for i, t, _ in rows:
        own, keys = split_keys(t)
        stays = [k not in shared or (keep_first and shared[k] == ((i is not None, i or 0), p)) for p, k in enumerate(keys)]
        out.append((i, len(own), len(own) - sum(stays), "\n".join(s for s, x in zip(own, stays) if x)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", [{}, {"min_docs": 2}, {"min_docs": 2, "min_chars": 12}])
def test_lines_equal_brute_force(spark, rule):
    docs = docs_of(spark, line_rows())
    got = lines.kept_texts(docs, lines.keep_bitmaps(docs, **rule)).collect()
    assert sorted(map(tuple, got), key=str) == kept_lines(line_rows(), **rule)


def test_first_lines_stay(spark):
    rows = [r for r in line_rows() if r[0] is not None and r[0] != 500]
    docs = docs_of(spark, rows)
    got = lines.kept_texts(docs, lines.keep_bitmaps(docs, min_docs=2, keep_first=True)).collect()
    assert sorted(map(tuple, got), key=str) == kept_lines(rows, min_docs=2, keep_first=True)


def test_bitmaps_are_runs(spark):
    docs = docs_of(spark, [(i, f"a{i}\nb\nc{i}\nd{i}\nb", "a") for i in range(10)] + [(20, "b", "a"), (21, "z", "a")])
    keep = {r["doc"]: (r["n_lines"], r["n_dropped"], [tuple(x) for x in r["keep"]]) for r in lines.keep_bitmaps(docs).collect()}
    assert keep[0] == (5, 2, [(0, 1), (2, 4)]) and keep[20] == (1, 1, []) and keep[21] == (1, 0, [(0, 1)])


def test_lines_are_streamed_in_range_order(spark):
    """One shuffle by range holds lines together; the window asks for no other one."""
    docs = docs_of(spark, [(1, "x", "a")])
    plan = lines.shared_lines(lines.line_hashes(docs))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "rangepartitioning" in below and "hashpartitioning" not in below


def test_lines_of_an_empty_table(spark):
    docs = docs_of(spark, [(1, "x", "a")]).limit(0)
    assert lines.kept_texts(docs, lines.keep_bitmaps(docs)).count() == 0


def test_line_query_hashes_the_kept_text(spark):
    rows = {r["doc_id"]: r for r in entry.queries()["op13_line_dedup"](spark, SF).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    for i, n, gone, text in kept_lines(docs):
        assert (rows[i]["n_lines"], rows[i]["n_dropped"], rows[i]["kept_sha256"]) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_settings_hold_again(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    audit.combinations(docs_of(spark, [(1, "x", "a")]), spark.createDataFrame([], LABELS)).count()
    assert spark.conf.get(key, None) == before
