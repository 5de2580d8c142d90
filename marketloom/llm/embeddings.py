"""Near-duplicate vectors by a tiled comparison in principal-component order.

Unit vectors are rotated so that their leading dimensions carry most of their
length. Tiles of vectors accumulate the products of the leading dimensions
first; what the rest can add is at most the product of the two suffix norms,
and pairs that cannot reach the threshold any more are dropped. Pairs that stay
are decided by the whole product in double precision.

A tile returns one count for each vector and edges of a star for each of its
connected pieces, never its pairs, so a dense group costs time but no memory.
Equal vectors are one row with a count."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketloom.llm.graph import components
from marketloom.session import cut_lineage

THRESHOLD = 0.9
#: Vectors in one side of a tile, and of the pieces that it is worked through in.
BLOCK, PIECE = 4096, 1024
#: Dimensions accumulated between two bounds.
STEP = 16
#: Share of a piece's pairs under which the rest is finished pair by pair.
SPARSE = 0.002
_SLACK = 1e-9


def _units(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return _units(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64).reshape(-1, width))


def _moments(batches, width: int):
    total = np.zeros((width, width))
    for batch in batches:
        if batch.num_rows:
            units = _matrix(pa.chunked_array([batch.column("embedding")]), width)
            total += units.T @ units
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "value"])


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal directions of all unit vectors about the origin, the longest
    first. The driver holds width x width sums."""
    sums = (vectors.select("embedding").mapInArrow(lambda it: _moments(it, width), "at long, value double")
            .groupBy("at").agg(F.sum("value").alias("value")).collect())
    moments = np.zeros(width * width)
    for at, value in sums:
        moments[at] = value
    moments = moments.reshape(width, width)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


class _Side:
    def __init__(self, ids: np.ndarray, copies: np.ndarray, units: np.ndarray, turn: np.ndarray) -> None:
        self.ids, self.copies, self.units = ids, copies.astype(np.float64), units
        self.turned = units @ turn
        squares = np.cumsum((self.turned ** 2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(ids), 1))], axis=1))


def _piece(a: _Side, b: _Side, rows: slice, cols: slice, threshold: float) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a piece: a boolean matrix, or index arrays where few pairs survive the bounds."""
    x, y = a.turned[rows], b.turned[cols]
    width = x.shape[1]
    products = np.zeros((len(x), len(y)))
    for at in range(0, width, STEP):
        end = min(width, at + STEP)
        products += x[:, at:end] @ y[:, at:end].T
        alive = products + a.rest[rows, end][:, None] * b.rest[cols, end] >= threshold - _SLACK
        left = int(np.count_nonzero(alive))
        if left <= SPARSE * alive.size:
            i, j = np.nonzero(alive)
            exact = np.einsum("ij,ij->i", a.units[rows][i], b.units[cols][j]) >= threshold if left else np.empty(0, bool)
            return i[exact], j[exact]
    return a.units[rows] @ b.units[cols].T >= threshold


def _stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a boolean matrix, the smallest position (rows first, then columns)
    that each row and column can reach."""
    n, m = linked.shape
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        new_cols = np.minimum(cols, np.where(linked, rows[:, None], n + m).min(axis=0))
        new_rows = np.minimum(rows, np.where(linked, new_cols, n + m).min(axis=1))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def _tile(table: pa.Table, turn: np.ndarray, threshold: float) -> pa.Table:
    blocks = table.column("block").to_numpy()
    ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
    units = _matrix(table.column("embedding"), len(turn))
    names = np.unique(blocks)
    sides = [_Side(ids[pick], copies[pick], units[pick], turn) for pick in (np.flatnonzero(blocks == n) for n in names)]
    same = table.column("same")[0].as_py()
    if not same and len(sides) == 1:  # one of the two blocks is empty
        sides = []
    counts: dict[int, np.ndarray] = {i: np.zeros(len(s.ids)) for i, s in enumerate(sides)}
    edges: list[np.ndarray] = []
    if sides:
        a, b = sides[0], sides[-1]
        for r in range(0, len(a.ids), PIECE):
            for c in range(r if same else 0, len(b.ids), PIECE):
                rows, cols = slice(r, r + PIECE), slice(c, c + PIECE)
                found = _piece(a, b, rows, cols, threshold)
                own = same and r == c
                if isinstance(found, tuple):
                    i, j = found
                    if own:
                        i, j = i[i < j], j[i < j]
                    if len(i) > 4 * PIECE:
                        found = np.zeros((len(a.ids[rows]), len(b.ids[cols])), bool)
                        found[i, j] = True
                    else:
                        np.add.at(counts[0], r + i, b.copies[cols][j])
                        np.add.at(counts[len(sides) - 1], c + j, a.copies[rows][i])
                        edges.append(np.column_stack([a.ids[rows][i], b.ids[cols][j]]))
                        continue
                elif own:
                    found = np.triu(found, 1)
                counts[0][rows] += found @ b.copies[cols]
                counts[len(sides) - 1][cols] += a.copies[rows] @ found
                first, second = _stars(found)
                both = np.concatenate([a.ids[rows], b.ids[cols]])
                reach = np.concatenate([first, second])
                edges.append(np.column_stack([both, both[reach]])[reach != np.arange(len(both))])
    pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.empty((0, 2), np.int64)
    hit = [np.flatnonzero(counts[i]) for i in counts]
    out_ids = np.concatenate([*(s.ids[h] for s, h in zip(sides, hit)), pairs[:, 0]]) if sides else np.empty(0, np.int64)
    links = np.concatenate([*(counts[i][h] for i, h in zip(counts, hit)), np.zeros(len(pairs))]) if sides else np.empty(0)
    other = [None] * (len(out_ids) - len(pairs)) + pairs[:, 1].tolist()
    return pa.table({"id": pa.array(out_ids, pa.int64()), "links": pa.array(links.astype(np.int64), pa.int64()), "other": pa.array(other, pa.int64())})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of `vectors`.

    Vectors of one length are compared with each other. A vector that is null,
    empty or zero, or holds a null or a non-finite component, and a row without
    id, link with nothing. Rows that repeat an id count as vectors of their
    own. Only the two columns named are read."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & whole, F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("embedding").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    # a class goes by a key of its own, since one id may stand beside several vectors
    classes = cut_lineage(classes.withColumn("id", F.xxhash64("embedding", "low")), "classes")
    lengths = {r[0]: r[1] for r in classes.groupBy(F.size("embedding")).count().collect()}  # as many rows as there are lengths
    found = None
    for width, n in sorted(lengths.items()):
        own = classes.where(F.size("embedding") == width)
        out = _compared(own, rotation(own, width), math.ceil(n / BLOCK), threshold)
        found = out if found is None else found.union(out)
    if found is None:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found, "found")
    labels = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = classes.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    lowest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = (classes.join(lowest, "label")
               .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = rows.where("usable").join(classes, "embedding").select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _compared(classes: DataFrame, turn: np.ndarray, blocks: int, threshold: float) -> DataFrame:
    """Counts and edges of all tiles. A vector goes to one tile for each block."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = classes.select("id", "copies", "embedding", block.alias("block")).withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "partner"), F.greatest("block", "partner")
    tiled = dealt.select("id", "copies", "embedding", "block", (low * blocks + high).alias("tile"), (low == high).alias("same"))
    return tiled.groupBy("tile").applyInArrow(lambda table: _tile(table, turn, threshold), "id long, links long, other long")
