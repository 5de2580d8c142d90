"""Shards of nearly equal size by a minimax contiguous partition.

Documents with equal texts are one atomic group, and the groups are ordered by
a digest of their text. The smallest capacity with which a greedy pass fills no
more than the wanted number of shards is found by binary search, and the groups
are cut where that pass cuts them.

The ordered sizes are never gathered. The driver sees sums over ranges of
digests, some of them split further. A range taken as one block bounds the
capacity from above, a range taken as a fluid bounds it from below, and only
ranges in which a cut may still fall are split again, until those hold single
groups. The cuts are then exact."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.session import cut_lineage

SHARDS = 16
#: Bits of the digest that order groups, and bits that a split adds.
KEY_BITS, FIRST_BITS, SPLIT_BITS = 60, 12, 8
#: Buckets in which the rows of one shard are numbered.
NUMBERING = 256


def group_key(text: Column) -> Column:
    """The order of a group: the leading 60 bits of the SHA-256 of its text."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _greedy(ends: list[float], fluid: list[bool], capacity: float, shards: int) -> list[float]:
    """Positions, in bytes, where a greedy pass of `capacity` ends its shards.
    `ends` are running sums of ranges; a fluid range may be cut anywhere."""
    cuts, at = [], 0.0
    for _ in range(shards):
        stop = at + capacity
        i = bisect_right(ends, stop)
        if i == len(ends):
            at = ends[-1]
        else:
            at = stop if fluid[i] else (ends[i - 1] if i else 0)
        cuts.append(at)
    return cuts


def _capacity(sizes: list[int], fluid: list[bool], shards: int) -> int:
    """The smallest whole capacity with which the greedy pass gets through."""
    ends = list(accumulate(sizes))
    total = ends[-1]
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, fluid, mid, shards)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def cut_keys(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """First keys of all shards but the first, ascending; `groups` has (key, size)
    with any number of rows a key. The driver holds 2^FIRST_BITS ranges, and
    for each split a range is replaced by 2^SPLIT_BITS ranges at most."""
    def sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        prefix = F.shiftright("key", KEY_BITS - bits)
        return [tuple(r) for r in rows.groupBy(prefix.alias("p")).agg(F.sum("size"), F.min("key"), F.max("key")).collect()]

    # (first key, bytes, last key, bits of its prefix)
    ranges = sorted((low, size, high, FIRST_BITS) for _, size, low, high in sums(groups, FIRST_BITS))
    if not ranges:
        return []
    while True:
        sizes, whole = [r[1] for r in ranges], [r[0] == r[2] for r in ranges]
        ends, solid = list(accumulate(sizes)), [False] * len(ranges)
        high = _capacity(sizes, solid, shards)
        low = _capacity(sizes, [not w for w in whole], shards)
        first = _greedy(ends, solid, low, shards)  # never behind the true cuts
        last = _greedy(ends, [not w for w in whole], high, shards)  # never before them
        split = set()
        for a, b in zip(first, last):
            i = bisect_right(ends, a)
            while i < len(ranges) and (ends[i - 1] if i else 0) < b:
                if not whole[i]:
                    split.add(i)
                i += 1
            if i < len(ranges) and not whole[i]:  # the range in which the pass stops
                split.add(i)
        if not split:
            break
        finer = []
        for bits in sorted({ranges[i][3] for i in split}):
            own = [ranges[i][0] >> (KEY_BITS - bits) for i in split if ranges[i][3] == bits]
            rows = groups.where(F.shiftright("key", KEY_BITS - bits).isin(own))
            more = min(KEY_BITS, bits + SPLIT_BITS)
            finer += [(a, size, b, more) for _, size, a, b in sums(rows, more)]
        ranges = sorted([r for i, r in enumerate(ranges) if i not in split] + finer)
    cuts = _greedy(ends, solid, high, shards)
    # a shard begins with the first range that ends behind the cut; shards behind the last byte stay empty
    return [ranges[i][0] if (i := bisect_right(ends, c)) < len(ranges) else 1 << KEY_BITS for c in cuts[:-1]]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for
    each row of `docs`.

    The size of a row is that of its text in UTF-8 plus 1; a null text counts
    as an empty one and shares its group. Rows with equal texts share a shard,
    so a group larger than the rest fills one alone, and there may be fewer
    shards than wanted. Slots count the rows of a shard from 0. `grown_shard`
    is null, as the law is `bytes`. Only doc_id and text are read."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("crc"),
                       group_key(F.col("text")).alias("key"))
    rows = cut_lineage(rows, "sized")
    cuts = cut_keys(rows, shards)
    number = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    return numbered(rows.withColumn("shard", number), "shard", ["key", "doc"]).select(
        F.col("doc").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `slot`, which counts the rows of each `group` from 0. Rows
    are numbered within hash buckets of a group, behind the counts of the
    buckets before, so no task holds a whole group."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(NUMBERING)))
    run = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(run) - F.col("_n")).drop("_n")
    own = Window.partitionBy(group, "_bucket").orderBy(*order)
    placed = rows.withColumn("_rank", F.row_number().over(own)).join(F.broadcast(counts), [group, "_bucket"])
    return placed.withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_before", "_rank")
