"""Shared text helpers: word rules as columns, and vectorised shingle fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words made of ASCII letters, digits and anything beyond ASCII.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word delimited by ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: Texts that go to a Python worker at a time, which bounds its memory.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(rows: DataFrame) -> DataFrame:
    """`rows`, in a session that hands whole texts to Python in small batches."""
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return rows


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs inside hands at most `rows` rows at a time to Python; the
    session's own setting holds again afterwards."""
    before = spark.conf.get(_BATCH_SETTING, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(_BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lowered and every other character kept."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Lowered words of `text`; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as texts need."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            step, back = pow(_BASE, k, 1 << 64), pow(_BASE, -k, 1 << 64)
            self.up = np.concatenate([self.up, self.up * np.uint64(step)])
            self.down = np.concatenate([self.down, self.down * np.uint64(back)])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_prints(text: bytes, width: int) -> tuple[np.ndarray, int]:
    """64-bit fingerprints, in order, of the shingles of `width` words of the
    UTF-8 `text`, and its number of words. Words are delimited by ASCII white
    space and A-Z are lowered. Fewer words than `width` form one shingle; a
    text without words has none. The fingerprint of a span is a difference of
    prefix sums of byte values times powers of an odd base, so a whole text
    takes a few array operations however long it is."""
    (prints,), words = shingle_prints_of(text, (width,))
    return prints, words


def shingle_prints_of(text: bytes, widths: tuple[int, ...]) -> tuple[list[np.ndarray], int]:
    """`shingle_prints` for each of the widths, over one set of prefix sums."""
    line = b" ".join(text.lower().split())
    if not line:
        return [np.empty(0, np.uint64) for _ in widths], 0
    codes = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    words = len(gaps) + 1
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(codes)]])
    up, down = _POWERS.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * up[:-1], out=sums[1:])

    def prints(width: int) -> np.ndarray:
        k = min(width, words)
        begin, end = starts[: words - k + 1], ends[k - 1:]
        return _mix((sums[end] - sums[begin]) * down[begin])

    return [prints(w) for w in widths], words
