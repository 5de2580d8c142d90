"""How document filters overlap: what each order of the filters removes at each step.

The duplicate filter needs the smallest id of every text. A counting Bloom
filter clears the texts that stand alone first: every text falls into one block
of cells and raises PROBES of them; tasks count their own texts and the counts
are merged. A cell that only one text raised proves that text unique. Only texts
all of whose cells were raised again are shuffled as whole texts, for the exact
smallest id. Flags then meet the labels on the document, and counts of filter
combinations, at most 32 for a part, answer every order without another look at
the documents."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.llm.text import arrow_rows
from marketloom.session import cut_lineage

FILTERS = "ABCDE"
#: Cells of a block, the size of Spark's bitmaps (4 KB); cells for each text; cells that a text raises.
BLOCK_CELLS, TEXT_CELLS, PROBES = 1 << 15, 16, 3
#: The sketch is broadcast with at most so many blocks (256 MB). Beyond 134 million texts its cells are shared by more
#: texts, so more texts are shuffled; the results stay the same.
MAX_BLOCKS = 1 << 16
_BLOCK_SHIFT, _CELL_BITS = 45, 15


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    upper, marks = bytes(range(65, 91)), b"#$%&*|"
    for batch in batches:
        bits = np.zeros(batch.num_rows, np.int32)
        for i, (text, points) in enumerate(zip(batch.column("text"), batch.column("points").to_numpy())):
            text = text.as_py()
            words = text.split()  # of bytes: at ASCII white space alone
            bits[i] = ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
                       | bool(100 * (len(text) - len(text.translate(None, upper))) > 2 * points) << 2 | (len(text.translate(None, marks)) < len(text)) << 3)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(bits), batch.column("print")], ["doc", "part", "bits", "print"])


def flagged(docs: DataFrame) -> DataFrame:
    """(doc, part, bits, print): the failed filters A to D of a text as bits 0 to
    3, and a hash of the text. A null text is empty, a null source ''. Whole
    texts go to Python; a batch of them bounds the memory."""
    read = docs.select(F.col("doc_id").alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), _text().alias("text"))
    read = read.select("doc", "part", F.col("text").cast("binary").alias("text"), F.char_length("text").alias("points"), F.xxhash64("text").alias("print"))
    return read.mapInArrow(_failed, f"doc {docs.schema['doc_id'].dataType.simpleString()}, part string, bits int, print bigint")


def _block(blocks: int) -> Column:
    return F.shiftrightunsigned("print", _BLOCK_SHIFT).bitwiseAND(F.lit(blocks - 1).cast("bigint"))


def _cells() -> list[Column]:
    return [F.shiftrightunsigned("print", _CELL_BITS * i).bitwiseAND(F.lit(BLOCK_CELLS - 1).cast("bigint")) for i in range(PROBES)]


def repeated_cells(prints: DataFrame, blocks: int) -> DataFrame:
    """(block, raised): a bitmap for each block of the cells that more than one
    row of `prints` raises. `blocks` is a power of two. Counts are merged from
    those of the tasks, so copies of one text cost one count each."""
    cells = prints.select(_block(blocks).alias("block"), F.explode(F.array_distinct(F.array(*_cells()))).alias("cell"))
    again = cells.groupBy("block", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return again.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("raised"))


def with_repeats(rows: DataFrame, sketch: DataFrame, blocks: int) -> DataFrame:
    """`rows`, which hold `print`, with `repeat`: false where the sketch proves
    that no other row has the text. The sketch has `blocks` rows of 4 KB at most."""
    held = sketch.withColumnRenamed("block", "of")
    met = rows.withColumn("block", _block(blocks)).join(F.broadcast(held), F.col("block") == F.col("of"), "left")

    def raised(cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("raised"), (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, cell.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1

    every = F.lit(True)
    for cell in _cells():
        every = every & raised(cell)
    return met.withColumn("repeat", F.coalesce(every, F.lit(False))).drop("block", "of", "raised")


def combinations(docs: DataFrame, labels: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(part, mask, n, good, toxic): rows of `docs` by source and by the set of
    filters they fail, bit 0 for A to bit 4 for E, with those labelled good
    (quality 1) and toxic among them.

    Every row counts, repeated rows too. A row without id is no copy of
    anything and nothing is a copy of it; rows that share id and text are not
    copies of each other, since neither id is smaller. An id counts as good or
    toxic if any of its labels says so. Other columns are not read."""
    with arrow_rows(docs.sparkSession):
        slim = cut_lineage(flagged(docs), "flags")
    blocks = 1
    while blocks < max_blocks and blocks * BLOCK_CELLS < TEXT_CELLS * slim.count():
        blocks *= 2
    sketch = cut_lineage(repeated_cells(slim, blocks), "sketch")

    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), _text().alias("text")).withColumn("print", F.xxhash64("text"))
    suspects = with_repeats(texts, sketch, blocks).where("repeat")
    first = (suspects.groupBy("text").agg(F.min("doc").alias("first"))
             .select("first", F.xxhash64("text").alias("first_print")).distinct())

    rows = with_repeats(slim, sketch, blocks)
    alone = rows.where("not repeat or doc is null").select("doc", "part", "bits")
    again = rows.where("repeat and doc is not null").join(first, (F.col("doc") == F.col("first")) & (F.col("print") == F.col("first_print")), "left")
    again = again.select("doc", "part", F.when(F.col("first").isNull(), F.col("bits") + (1 << 4)).otherwise(F.col("bits")).alias("bits"))
    masks = alone.unionByName(again)

    known = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    none = F.lit(0)
    # rows without id have no label and would all meet in one partition
    met = (masks.where("doc is not null").join(known, F.col("doc") == F.col("labelled"), "left")
           .select("part", "bits", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
           .unionByName(masks.where("doc is null").select("part", "bits", none.alias("good"), none.alias("toxic"))))
    return met.groupBy("part", F.col("bits").alias("mask")).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) for every part of `counts` (as from
    `combinations`), every order of the filters and every step, zeros included.

    A part has at most 32 rows, each of which meets the 600 steps. A document
    that fails k filters is removed by each of them in 120 / k orders, so
    `shapley`, a sum over all orders, needs no second pass."""
    names = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    every = (counts.select("*", F.explode(names).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")))

    def bits(letters: Column) -> Column:
        return sum((F.when(letters.contains(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    own = bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    before = bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1))
    every = every.select("*", F.col("mask").bitwiseAND(own).alias("fails"), F.col("mask").bitwiseAND(before).alias("failed"), own.alias("own"))
    fails, arrives = F.col("fails") > 0, F.col("failed") == 0

    def total(which: Column, what: str = "n") -> Column:
        return F.sum(F.when(which, F.col(what)).otherwise(0))

    return every.groupBy("part", "filter_order", "step").agg(
        total(arrives & ~fails).alias("kept"), total(arrives & fails).alias("removed"), total(~arrives & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(arrives & fails, "good").alias("good_lost"),
        total(arrives & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * (F.lit(120) / F.bit_count("mask")).cast("bigint")).otherwise(0)).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`orders` of `combinations`; no rows for an empty table."""
    return orders(cut_lineage(combinations(docs, labels), "masks"))
