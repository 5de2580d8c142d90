"""Near-duplicate documents by min-max hashing.

Each permutation keeps both its smallest and its largest value, so 64 hash
evaluations a shingle give 128 unbiased signature values. Four values (the two
ends of two permutations) form a band; of 32 bands, documents with a Jaccard
similarity of 0.8 share none with probability (1 - 0.8^4)^32 = 5e-8.

The rest is exact. Documents with the same set are one class, which goes on
under a key of its own, also where one id stands beside several texts. In every bucket each member is compared with the
member of the smallest key, its hub. Two members of a hub that this leaves in different
components can only be alike if they share enough outside the hub: they share
at most the smaller of their shares with the hub, and what lies outside of it
in both. Only pairs that pass this bound are compared in full. So any two sets
that share a band are compared, ruled out, or known to be connected already.
All comparisons are on full sets of 64-bit shingle fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.llm.graph import components
from marketloom.llm.text import _mix, shingle_prints, small_batches
from marketloom.session import cut_lineage

PERMUTATIONS = 64
BANDS = PERMUTATIONS // 2
#: Ids up to this many (some 32 MB as a hash table) are broadcast; more are shuffled.
BROADCAST_IDS = 1_000_000
#: Shingles hashed at a time, which bounds the memory of a very long text.
_CHUNK = 1 << 12

_FACTORS = _mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = _mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))


def band_keys(prints: np.ndarray) -> np.ndarray:
    """The bands of a set of fingerprints, as 64-bit keys."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(prints), _CHUNK):
        values = _FACTORS[:, None] * prints[at:at + _CHUNK] + _SHIFTS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for values in (low[0::2], high[0::2], low[1::2], high[1::2]):
        key = _mix(key ^ values)
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield np.unique(shingle_prints(text.as_py() or b"", width)[0])


def _marks(prints: np.ndarray) -> tuple[int, int]:
    """Two sums over differently mixed members, which tell sets apart."""
    return int(_mix(prints).sum(dtype=np.uint64).view(np.int64)), int(_mix(prints ^ _SHIFTS[0]).sum(dtype=np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ones, twos, bands = [], [], [], []
        with np.errstate(over="ignore"):
            for prints in _sets(batch, width):
                sizes.append(len(prints))
                one, two = _marks(prints)
                ones.append(one)
                twos.append(two)
                bands.append(band_keys(prints) if len(prints) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "one", "two", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore"):
            sets = list(_sets(batch, width))
            marks = [_marks(prints) for prints in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(prints) for prints in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
             pa.array([prints.view(np.int64) for prints in sets], pa.list_(pa.int64()))], ["n", "one", "two", "prints"])


def among(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """`rows` whose `id` is among the distinct `ids`. The ids are broadcast
    only up to a counted bound; beyond it both sides are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The `pairs` (a, b) with both sets (pa, pb)."""
    left = sets.select(F.col("id").alias("a"), F.col("prints").alias("pa"))
    right = sets.select(F.col("id").alias("b"), F.col("prints").alias("pb"))
    return pairs.join(left, "a").join(right, "b")


def _linked(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The `pairs` (a, b) whose sets have a Jaccard similarity of `share` % or more."""
    both = _compared(pairs, sets).select("a", "b", F.size("pa").alias("na"), F.size("pb").alias("nb"), F.size(F.array_intersect("pa", "pb")).alias("shared"))
    return both.where(f"100 * shared >= {share} * (na + nb - shared)").select("a", "b")


def _left_open(spokes: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of members of one hub that lie in different components and
    may still be alike. `spokes` holds each member `a` of a hub `b`, its size,
    the size shared with the hub, and what it has outside of the hub. Within a
    hub all but the largest component look at the others."""
    here = spokes.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    parts = here.groupBy("b", "label").agg(F.count("*").alias("rows"))
    apart = (parts.groupBy("b").agg(F.count("*").alias("parts"), F.max(F.struct("rows", "label")).alias("main"))
             .where("parts > 1").select("b", F.col("main.label").alias("main")))
    here = cut_lineage(here.join(apart, "b"), "open")
    need = f"ceil({share} * (x.na + y.na) / {100 + share}.0) - least(x.shared, y.shared)"
    return (here.where("label <> main").alias("x").join(here.alias("y"), F.expr(
        f"x.b = y.b and x.label <> y.label and (y.label = y.main or x.a < y.a) "
        f"and 100 * least(x.na, y.na) >= {share} * greatest(x.na, y.na) and least(x.na - x.shared, y.na - y.shared) >= {need} "
        f"and ({need} <= 0 or size(array_intersect(x.outside, y.outside)) >= {need})"))
        .select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct())


def _keyed(classes: DataFrame) -> DataFrame:
    """`classes` with a key: their id where it is theirs alone, so that the hub
    of a bucket is its earliest document, and else a hash of the set."""
    shared = classes.where("id is not null").groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("id").alias("shared"))
    met = classes.join(shared, F.col("id") == F.col("shared"), "left")
    own = F.when(F.col("shared").isNull() & F.col("id").isNotNull(), F.col("id")).otherwise(F.xxhash64("one", "two", "n"))
    return met.select("one", "two", "n", "id", own.alias("class"))


def near_duplicates(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text",
                    width: int = 4, share: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`.

    Null and blank texts have an empty set, link with nothing and are kept. A
    text of fewer than `width` words is one shingle; texts of any length are
    read whole. Rows with the same set are one class, repeated rows with the
    same id among them, and all rows of the smallest id are kept. Rows that
    share an id with other texts take part with their own. A row without an id
    takes part through its text, and where no row of its component has an id,
    the component has none and all its rows are kept. An empty table has no
    rows. Columns beside the two named are not looked at."""
    ident, body = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    source = small_batches(docs).select(ident.cast("bigint").alias("id"), body.cast("binary").alias("text"))
    signed = cut_lineage(source.mapInArrow(lambda it: _signatures(it, width), "id long, n long, one long, two long, bands array<long>"), "signed")
    classes = cut_lineage(_keyed(signed.where("n > 0").groupBy("one", "two", "n").agg(F.min("id").alias("id"))), "classes")
    # one row a class: a signature of its smallest member, or of one without id where no member has one
    least = classes.select(F.col("one").alias("c1"), F.col("two").alias("c2"), F.col("n").alias("c3"), F.col("id").alias("low"), "class")
    mine = (F.col("one") == F.col("c1")) & (F.col("two") == F.col("c2")) & (F.col("n") == F.col("c3"))
    heads = signed.where("n > 0").join(least, mine & F.col("id").eqNullSafe(F.col("low"))).select("class", "bands").dropDuplicates(["class"])
    bands = cut_lineage(heads.select(F.col("class").alias("id"), F.explode("bands").alias("key")), "bands")
    hubs = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub")).where("members > 1").select("key", "hub")
    first = cut_lineage(bands.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    asked = first.select(F.col("a").alias("class")).union(first.select(F.col("b").alias("class"))).distinct()
    asked = cut_lineage(asked.join(classes, "class").select("class", "id", "one", "two", "n"), "asked")
    # texts are read by id; the rows of an id that have another set fall out again
    ids = asked.where("id is not null").select("id").distinct()
    texts = among(source, ids)
    if not asked.where("id is null").isEmpty():
        texts = texts.unionByName(source.where("id is null"))
    sets = texts.mapInArrow(lambda it: _full_sets(it, width), "n long, one long, two long, prints array<long>")
    known = asked.select("one", "two", "n", F.col("class").alias("id"))
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    sets = cut_lineage(sets.join(known, ["one", "two", "n"]).select("id", "prints").dropDuplicates(["id"]), "sets")
    spokes = _compared(first, sets).select("a", "b", F.size("pa").alias("na"), F.size("pb").alias("nb"), F.size(F.array_intersect("pa", "pb")).alias("shared"),
                                           F.array_except("pa", "pb").alias("outside"))
    spokes = cut_lineage(spokes, "spokes")
    links = spokes.where(f"100 * shared >= {share} * (na + nb - shared)").select("a", "b")
    labels = components(links)
    more = cut_lineage(_linked(_left_open(spokes, labels, share), sets, share), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    lowest = named.groupBy("label").agg(F.min("id").alias("class_component"))
    named = named.join(lowest, "label").select("one", "two", "n", "class_component")
    alone = F.coalesce(F.col("n") == 0, F.lit(True))
    return (signed.select("id", "one", "two", "n").join(named, ["one", "two", "n"], "left")
            .select("id", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("class_component")).alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, in their own columns: one document of
    each component. Rows that repeat an id go or stay together, and rows
    without an id stay."""
    gone = near_duplicates(docs).where("not kept and id is not null").select("id").distinct()
    gone = cut_lineage(gone, "gone")
    bound = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(bound, docs["doc_id"] == bound["id"], "left_anti")
