"""Benchmark passages in documents, by a prefix-filtered join. Columns and joins only.

A window is 13 consecutive words of an item, or a whole shorter item. Its
tokens are its shingles of three words. A document holds a window only if it
holds all of them, so the rarest one, counted over all documents, is a
sufficient prefix: only its occurrences become candidates, at the one start
that its offset allows. A candidate is confirmed when every shingle of the
window stands at its place. Shingles are compared as text, so that the
confirmation is exact without a second look at the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.llm.text import alnum_words
from marketloom.session import cut_lineage

WINDOW, SHINGLE = 13, 3
#: Benchmark shingles up to this many (some 100 MB as a hash table) are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_SHINGLES else rows


def _words_at(width: int) -> list[Column]:
    return [F.get("words", F.col("at") + i) for i in range(width)]


def _same_row(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on the document row, a null id included, and the columns `more`."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in ("doc", "print", *more)})
    on = F.col("doc").eqNullSafe(F.col("_doc"))
    for c in ("print", *more):
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(right, on, how).drop(*[f"_{c}" for c in ("doc", "print", *more)])


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window, item) pairs, and (window, length, width, offset, shingle) for
    every shingle of every distinct window. Items without id or words have none."""
    words = items.select(F.col(item_id).cast("string").alias("item"), alnum_words(F.col(text)).alias("words")).where("item is not null and size(words) > 0")
    length = F.least(F.lit(WINDOW), F.size("words"))
    starts = words.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start"))
    spans = starts.select("item", "length", F.slice("words", F.col("start") + 1, F.col("length")).alias("words"))
    spans = cut_lineage(spans.withColumn("window", F.array_join("words", " ")), "windows")
    distinct = spans.dropDuplicates(["window"])
    width = F.least(F.lit(SHINGLE), F.col("length"))
    parts = (distinct.select("window", "length", "words", width.alias("width"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width"))).alias("offset"))
             .select("window", "length", "width", "offset", F.array_join(F.slice("words", F.col("offset") + 1, F.col("width")), " ").alias("shingle")))
    return spans.select("window", "item").distinct(), parts


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row
    for each row of `docs`. A null or empty text has no words. Rows that repeat
    an id with another text are told apart by their text. Only the columns
    named are read, whatever else the tables hold."""
    return _marked(docs, items, doc_id, text, item_id).drop("print").withColumnRenamed("doc", "doc_id")


def _marked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    members, parts = windows(items, item_id, text)
    parts = cut_lineage(parts, "shingles")
    known = cut_lineage(parts.select("width", "shingle").distinct(), "known")
    widths = [r["width"] for r in known.select("width").distinct().orderBy("width").collect()]  # 1 to 3 values

    # every place of a known shingle, and one row at place -1 for every document
    source = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("print"), alnum_words(F.col(text)).alias("words"))
    placed = source.select("doc", "print", F.size("words").alias("n_words"), "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    forms = [F.struct(F.xxhash64(F.lit(w), *_words_at(w)).alias("key"), F.concat_ws(" ", *_words_at(w)).alias("shingle"),
                      F.lit(w == widths[0]).alias("first")) for w in widths]
    forms = forms or [F.struct(F.lit(0).cast("bigint").alias("key"), F.lit("").alias("shingle"), F.lit(True).alias("first"))]
    form = forms[0] if len(forms) == 1 else F.explode(F.array(*forms))
    spread = placed.select("doc", "print", "n_words", "at", form.alias("f")).where("at >= 0 or f.first")
    spread = spread.select("doc", "print", "n_words", "at", F.col("f.shingle").alias("shingle"),
                           F.when(F.col("at") >= 0, F.col("f.key")).otherwise(F.xxhash64("doc", "print")).alias("key"))
    index = known.select(F.xxhash64("width", *[F.get(F.split("shingle", " "), F.lit(i)) for i in range(SHINGLE)]).alias("key"),
                         F.col("shingle").alias("known"))
    found = spread.join(_bounded(index), (spread.key == index.key) & (spread.shingle == index.known) & (spread.at >= 0), "left")
    found = cut_lineage(found.where("at = -1 or known is not null").select("doc", "print", "n_words", "at", F.col("known").alias("shingle")), "places")
    places = cut_lineage(found.where("at >= 0").distinct(), "places")

    # the rarest shingle of every window of which no shingle is missing
    counts = cut_lineage(places.groupBy("shingle").agg(F.count("*").alias("n")), "counts")
    counted = parts.join(counts, "shingle", "left")
    prefix = (counted.groupBy("window", "length", "width")
              .agg(F.min(F.struct("n", "offset", "shingle")).alias("rarest"), F.count("n").alias("there"))
              .where("there = length - width + 1").select("window", "length", "there", "rarest.offset", "rarest.shingle"))
    prefix = cut_lineage(prefix, "prefix")
    candidates = (places.join(_bounded(prefix), "shingle").withColumn("start", F.col("at") - F.col("offset"))
                  .where("start >= 0 and start + length <= n_words").select("doc", "print", "window", "length", "there", "start"))
    wanted = (candidates.join(_bounded(parts.select("window", "offset", "shingle")), "window")
              .select("doc", "print", "window", "length", "there", "start", (F.col("start") + F.col("offset")).alias("at"), "shingle"))
    confirmed = (_same_row(wanted, places.select("doc", "print", "at", "shingle"), "at", "shingle")
                 .groupBy("doc", "print", "window", "length", "there", "start").agg(F.count("*").alias("n")).where("n = there"))
    confirmed = cut_lineage(confirmed.select("doc", "print", "window", "length", "start"), "confirmed")

    covered = (confirmed.select("doc", "print", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).distinct()
               .groupBy("doc", "print").agg(F.count("*").alias("n_hit")))
    held = confirmed.select("doc", "print", "window").distinct().join(_bounded(members), "window").select("doc", "print", "item").distinct()
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256)
    held = held.groupBy("doc", "print").agg(F.count("*").alias("n_items"), digest.alias("items_sha256"))
    marks = cut_lineage(_same_row(covered, held), "marks")
    out = _same_row(found.where("at = -1").select("doc", "print", "n_words"), marks, how="left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("doc", "print", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, in their own columns. Rows
    go by id and text: repeated rows go or stay together."""
    bad = cut_lineage(_marked(docs, items).where("contaminated").select("doc", "print").distinct(), "contaminated")
    return docs.join(_bounded(bad), docs["doc_id"].eqNullSafe(bad["doc"]) & (F.xxhash64(docs["text"]) == bad["print"]), "left_anti")
