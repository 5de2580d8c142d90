"""Lines that many documents share, and what each document keeps without them.
Columns and joins only.

Lines travel as two 64-bit hashes of their key, never as text. They are dealt by
ranges of (hash, document) and sorted by hash, document and position, so that a
line that stands in a third of all documents spans as many partitions as it
needs. A partition is read in order: the first occurrence in a document counts,
later ones do not. Its counts for a hash are added to those of the other
partitions. The lines that go are gathered by document as a run-length
compressed bitmap of the lines that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.llm.text import ascii_lower
from marketloom.session import cut_lineage

#: Documents that a line stands in from which on it is dropped; code points of its key that a line needs to be dropped.
MIN_DOCS, MIN_CHARS = 10, 1
_SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lowered."""
    return ascii_lower(F.trim(line, F.lit(_SPACE)))


def _whole(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text"), F.xxhash64(text).alias("print"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(one, two, doc, print, pos) for every line whose key has `min_chars` code points."""
    at = _whole(docs).select("doc", "print", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = at.select("doc", "print", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("one"), F.xxhash64(F.lit("line"), "key").alias("two"), "doc", "print", "pos")


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(one, two, n_docs, first) of the keys that stand in `min_docs` documents:
    `first` is the smallest (doc, print, pos). A document is a pair of id and
    text: repeated rows are one document, a null id is an id like others."""
    own = ["one", "two", "doc", "print"]
    dealt = lines.repartitionByRange(*own).sortWithinPartitions(*own, "pos")
    # the window needs the rows of (hash, document) together and by position, as they are
    opens = F.row_number().over(Window.partitionBy(*own).orderBy("pos")) == 1
    return (dealt.withColumn("opens", opens).where("opens").groupBy("one", "two")
            .agg(F.count("*").alias("n_docs"), F.min(F.struct("doc", "print", "pos")).alias("first")).where(F.col("n_docs") >= min_docs))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc, print, n_lines, n_dropped, keep), one row for each distinct pair of
    `doc_id` and text. `keep` is the bitmap of kept lines as runs (start, end)
    of line numbers, the end exclusive. Lines whose key stands in `min_docs`
    documents go, all of them or, with `keep_first`, all but the first by
    document and position.

    A null text is one empty line. Keys under `min_chars` code points always
    stay. Positions of one document meet in one row, which its text bounds.
    Other columns are not read."""
    lines = cut_lineage(line_hashes(docs, min_chars), "lines")
    # written, so that the join below shuffles both sides by itself and its hot keys can be split
    shared = cut_lineage(shared_lines(lines, min_docs), "shared").withColumnsRenamed({"one": "a", "two": "b"})
    gone = lines.join(shared, (F.col("one") == F.col("a")) & (F.col("two") == F.col("b")))
    if keep_first:
        gone = gone.where(~F.struct("doc", "print", "pos").eqNullSafe(F.col("first")))
    gone = (gone.groupBy(F.col("doc").alias("of"), F.col("print").alias("of_print"))
            .agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    whole = _whole(docs).select("doc", "print", F.size(_lines(F.col("text"))).alias("n")).distinct()
    met = whole.join(gone, F.col("doc").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left")
    met = met.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.struct(
        F.coalesce(F.get("gone", i - 1) + 1, F.lit(0)).alias("start"), F.coalesce(F.get("gone", i), F.col("n")).alias("end")))
    return met.select("doc", "print", F.col("n").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"),
                      F.filter(runs, lambda r: r["start"] < r["end"]).alias("keep"))


def kept_texts(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text), one row for each row of `docs`: the
    text with only the lines that its bitmap keeps."""
    held = bitmaps.withColumnsRenamed({"doc": "of", "print": "of_print"})
    met = _whole(docs).join(held, F.col("doc").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")))
    met = met.withColumn("lines", _lines(F.col("text")))
    parts = F.transform("keep", lambda r: F.array_join(F.slice("lines", r["start"] + 1, r["end"] - r["start"]), "\n"))
    kept = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(parts, "\n"))
    return met.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", kept.alias("text"))
