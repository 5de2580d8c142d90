"""Ranked lexical search over all documents, pruned by hashed max-sketches.

Queries are taken in blocks. One pass over the texts keeps, for each document,
its length and how often each term of the block occurs in it. From the counts of
all documents follow the impacts, the largest score that a term can give. A
document's impacts fold into WIDTH coordinates, the maximum of those that hash
to it, so the sum of the coordinates of a query's terms is an upper bound of its
score: one matrix product gives the bounds of many documents for all queries of
the block. A task scores documents exactly in descending order of their bounds
and stops at the first that cannot enter its best ones; those of the tasks are
merged. The bound never falls below the score, so nothing is lost."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketloom.llm.text import arrow_rows
from marketloom.session import cut_lineage

TOP = 10
#: Coordinates of a sketch; items of a block; documents whose bounds are computed at once; documents rescored between two looks at the threshold.
WIDTH, BLOCK_ITEMS, CHUNK, STEP = 512, 2_000, 1_024, 16
_LAST = np.iinfo(np.int64).max

# bytes to lowered letters, digits and all bytes of characters beyond ASCII; anything else separates
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Lowered terms of a UTF-8 text: runs of ASCII letters, digits and anything beyond ASCII."""
    return text.translate(_FOLD).split(b" ")


@dataclass
class Block:
    """Items as lists of term numbers. A term's coordinate is a hash of its number."""
    ids: list[int]
    queries: list[np.ndarray]
    terms: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        by: dict[int, set[bytes]] = {}
        for item, text in rows:
            by.setdefault(item, set()).update(t for t in terms_of((text or "").encode()) if t)
        ids, terms = sorted(by), {}
        for item in ids:
            for t in sorted(by[item]):
                terms.setdefault(t, len(terms))
        return cls(ids, [np.sort(np.array([terms[t] for t in by[i]], np.int64)) for i in ids], terms)


def coordinates(n: int, width: int) -> np.ndarray:
    mixed = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(width)).astype(np.int64)


def _counted(terms: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, held, counts, offsets = [], [], [], [0]
            for text in batch.column("text"):
                found = [t for t in terms_of(text.as_py() or b"") if t]
                lengths.append(len(found))
                numbers, n = np.unique(np.array([terms[t] for t in found if t in terms], np.int32), return_counts=True)
                held.append(numbers)
                counts.append(n.astype(np.int32))
                offsets.append(offsets[-1] + len(numbers))

            def lists(parts: list[np.ndarray]) -> pa.ListArray:
                flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(lengths, pa.int64()), lists(held), lists(counts)],
                                             ["doc", "n", "terms", "counts"])
    return run


def term_counts(docs: DataFrame, block: Block) -> DataFrame:
    """(doc, n, terms, counts) for each row of `docs`: its number of terms, and
    how often those of the block occur in it. Null is a text without terms."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("binary").alias("text"))
    with arrow_rows(docs.sparkSession):
        return cut_lineage(texts.mapInArrow(_counted(block.terms), "doc bigint, n bigint, terms array<int>, counts array<int>"), "counts")


class _Best:
    """The best documents of each query so far."""

    def __init__(self, queries: int, top: int) -> None:
        self.top = top
        self.ids = [np.empty(0, np.int64)] * queries
        self.scores = [np.empty(0, np.int64)] * queries

    def worst(self, q: int) -> tuple[int, int]:
        """Score and id that a document has to beat."""
        return (int(self.scores[q][-1]), int(self.ids[q][-1])) if len(self.ids[q]) == self.top else (0, -1)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids[scores > 0]]), np.concatenate([self.scores[q], scores[scores > 0]])
        order = np.lexsort((ids, -scores))[:self.top]
        self.ids[q], self.scores[q] = ids[order], scores[order]


@dataclass
class Scorer:
    """Scores documents given as (doc, n, terms, counts) for all queries of a
    block. `weights` by term; n_docs and n_terms of the whole table."""
    queries: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    top: int = TOP
    width: int = WIDTH
    chunk: int = CHUNK

    def impacts(self, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each occurring term, given the length of its document."""
        exact = lengths if len(lengths) == 0 or 90 * int(lengths.max()) * self.n_docs <= _LAST else lengths.astype(object)
        m = (10 + 90 * exact * self.n_docs // max(1, self.n_terms)).astype(np.int64)
        counts = counts.astype(np.int64)
        return self.weights[terms] * (1_000_000_000 * counts // (1_000 * counts + 8 * m))

    def sketches(self, rows: np.ndarray, n: int, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """n documents by WIDTH coordinates, each the maximum of the impacts that hash to it."""
        out = np.zeros(n * self.width, np.int64)
        np.maximum.at(out, rows * self.width + self.coordinate[terms], impacts)
        return out.reshape(n, self.width)

    def __post_init__(self) -> None:
        self.coordinate = coordinates(len(self.weights), self.width)
        self.lookup = np.zeros((self.width, len(self.queries)))
        for q, own in enumerate(self.queries):
            np.add.at(self.lookup[:, q], self.coordinate[own], 1.0)

    def scores(self, q: int, docs: np.ndarray, keys: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Exact scores of the rows `docs`; `keys` are row * terms + term in order."""
        wanted = docs[:, None] * len(self.weights) + self.queries[q][None, :]
        at = np.searchsorted(keys, wanted)
        found = keys[np.minimum(at, len(keys) - 1)] == wanted
        return np.where(found, impacts[np.minimum(at, len(keys) - 1)], 0).sum(axis=1)

    def take(self, best: _Best, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> int:
        """Enter a chunk of documents into `best`; returns how many were scored exactly.
        Sums stay below 2^53, so the bounds are exact in doubles."""
        if not len(terms) or not self.queries:
            return 0
        rows = np.repeat(np.arange(len(ids)), sizes)
        impacts = self.impacts(lengths[rows], terms, counts)
        bounds = self.sketches(rows, len(ids), terms, impacts).astype(np.float64) @ self.lookup
        keys, scored = rows * len(self.weights) + terms, 0
        for q in range(len(self.queries)):
            score, last = best.worst(q)
            bound = bounds[:, q]
            open_ = np.flatnonzero((bound > score) | ((bound == score) & (ids < last) & (score > 0)))
            if not len(open_):
                continue
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            for at in range(0, len(open_), STEP):
                some = open_[at:at + STEP]
                if bound[some[0]] < best.worst(q)[0]:
                    break
                scored += len(some)
                best.add(q, ids[some], self.scores(q, some, keys, impacts))
        return scored

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, scored, seen = _Best(len(self.queries), self.top), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, self.chunk):
                part = batch.slice(at, self.chunk)
                ids = part.column("doc").fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
                terms, counts = part.column("terms"), part.column("counts")
                scored += self.take(best, ids, part.column("n").to_numpy(), np.diff(terms.offsets.to_numpy()),
                                    terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy())
                seen += part.num_rows
        sizes = [len(i) for i in best.ids]
        ids = np.concatenate([*best.ids, np.empty(0, np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()), pa.array(ids, pa.int64(), mask=ids == _LAST),
             pa.array(np.concatenate([*best.scores, np.empty(0, np.int64)]).astype(np.int64), pa.int64())], ["query", "doc_id", "score"])


def _statistics(counted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the documents that hold each term of the block."""
    n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    held = np.zeros(terms, np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        held[term] = n
    return n_docs, n_terms or 0, held


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents with a score above 0
    for every item, best first, equal scores by ascending id, null last.

    Ids are integers. Rows of `docs` that repeat an id are ranked one by one;
    rows of `items` with one id are one item with the terms of all of them, and
    items without id or terms have no result. Null texts hold no terms. Each
    block of items costs one pass over the texts; the driver holds one block
    and the counts of its terms. Other columns are not read."""
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("bigint").alias("item"), F.col("text")).where("item is not null")
    blocks = max(1, math.ceil(own.select("item").distinct().count() / block_items))
    out = None
    for b in range(blocks):
        block = Block.of([tuple(r) for r in own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()])
        counted = term_counts(docs, block)
        n_docs, n_terms, held = _statistics(counted, len(block.terms))
        scorer = Scorer(block.queries, weights(n_docs, held), n_docs, n_terms, top, width)
        found = counted.where(F.size("terms") > 0).mapInArrow(scorer.run, "query bigint, doc_id bigint, score bigint")
        names = spark.createDataFrame(list(enumerate(block.ids)), "query bigint, item_id bigint")
        # the best of some tasks first, then the best of those
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
        found = found.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
