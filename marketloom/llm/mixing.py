"""Mixing sources to target weights by Efraimidis-Spirakis sampling. Columns and joins only.

Every document gets the key -ln(u) / weight, with u drawn from a hash of its id
and weight its quality weight. A source takes every document once for each
complete epoch of its budget; what is left of the budget goes to the documents
with the smallest keys, by a running sum of sizes. The last of them gives only
the words that are still missing, so that every source meets its target.

No source is sorted in one task. Keys are cut into equal buckets; running sums
over the buckets of a source find the one bucket in which its budget ends, and
only the documents of that bucket are ordered."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.llm.text import SPACED_WORD
from marketloom.session import cut_lineage

#: Weights of the sources, in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Quality weights of documents: labelled good, not labelled, labelled bad.
QUALITY = (2.0, 1.0, 0.5)
EPOCHS = 3
#: Documents that a bucket of one source holds on average, at most.
BUCKET_ROWS = 5_000


def sizes(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def quality(labels: DataFrame) -> DataFrame:
    """(id, weight): QUALITY holds the weight of an id labelled good, of one
    without a label, and of one labelled bad. The best label of an id counts."""
    return (labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q is not null")
            .groupBy("id").agg(F.max("q").alias("q")).select("id", F.when(F.col("q") > 0, QUALITY[0]).otherwise(QUALITY[2]).alias("weight")))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """`sources` (name, source, source_size) with `target`: sources by code
    point, null last, share the sum of all sizes by WEIGHTS; none gets more
    than `epochs` times its size, and what is above is shared again by weight.

    Sources by size over weight fill up one after the other. The level that
    the next ones would share rises as long as the next one is filled and falls
    afterwards, so the level that holds is the largest. The table has one row
    for each source, which bounds these windows."""
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    weighed = sources.withColumn("share", share).withColumn("full", F.col("source_size") * float(epochs))
    filled = Window.orderBy(F.col("full") / F.col("share"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("full").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("share").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - before) / behind)
    stop = F.max("level").over(whole)
    return levels.withColumn("stop", stop).select("name", "source", "source_size", F.least("full", F.col("stop") * F.col("share")).alias("target"))


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, print, size, source_size, target, taken, copies), one
    row for each row of `docs`.

    `taken` is the number of words that the mix takes of a row, repeats
    counted: its size for each complete epoch, and the words of the fractional
    selection. `copies` rounds that to whole documents. A row without words
    gives none; a source without words has the target 0. Rows without id share
    one random number and are told apart by their text; equal rows follow each
    other in the running sum. Other columns are not read. `print` is a hash of
    the text."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("print"),
                       sizes(F.col("text")).alias("size"))
    weights = quality(labels)
    rows = rows.join(weights, rows["doc"] == weights["id"], "left").drop("id")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    key = -F.log((draw + 0.5) / float(1 << 52)) / F.coalesce("weight", F.lit(1.0))
    # the share of all documents with a smaller key, were the weights equally frequent
    place = sum((1 - F.exp(-F.col("key") * w) for w in QUALITY), F.lit(0.0)) / len(QUALITY)
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = cut_lineage(rows.withColumn("key", key).select("doc", "source", "print", "size", "key", place.alias("place"), name.alias("name")), "sized")

    sources = cut_lineage(rows.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    n = sources.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    bucket = F.least(F.lit(buckets - 1), F.floor(F.col("place") * buckets)).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    budgets = (targets(sources).withColumn("epochs", epochs)
               .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")))
    budgets = cut_lineage(budgets, "budgets")

    # the bucket of a source in which its budget ends, and the sum of those before it
    run = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("name", bucket.alias("bucket")).agg(F.sum("size").alias("sum")).withColumn("before", F.sum("sum").over(run) - F.col("sum"))
    ends = (budgets.join(sums, "name").where("before < rest and rest <= before + sum").select("name", F.col("bucket").alias("last"), "before"))
    plan = cut_lineage(budgets.join(ends, "name", "left").drop("source"), "plan")

    dealt = rows.join(plan, "name").withColumn("bucket", bucket)
    within = Window.partitionBy("name").orderBy("key", "doc", "print").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = dealt.where("bucket = last").withColumn("left", F.col("rest") - F.col("before") - (F.sum("size").over(within) - F.col("size")))
    split = split.withColumn("part", F.greatest(F.lit(0), F.least("size", "left"))).withColumn("chosen", F.col("left") > 0)
    inside = F.coalesce(F.col("bucket") < F.col("last"), F.lit(False))
    others = (dealt.where("last is null or bucket <> last").withColumn("left", F.lit(0).cast("bigint"))
              .withColumn("part", F.when(inside, F.col("size")).otherwise(0)).withColumn("chosen", inside))
    out = others.unionByName(split)
    return out.select(F.col("doc").alias("doc_id"), "source", "print", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
                      (F.col("epochs") + (F.col("chosen") & (2 * F.col("part") >= F.col("size"))).cast("bigint")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, in their own columns, as often as the mix takes them
    (whole documents). Of repeated rows each takes the least of their copies."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("print"))
    copies = (mix(docs, labels).groupBy(F.col("doc_id").alias("id"), F.col("print").alias("of"))
              .agg(F.min("copies").alias("copies")).where("copies > 0"))
    dealt = packed.join(copies, packed["doc"].eqNullSafe(copies["id"]) & (packed["print"] == copies["of"]))
    return dealt.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
