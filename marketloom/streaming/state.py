"""Stateful signal-change detection."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = ("asset_id int, ticker string, checked_at timestamp, signal string, confidence double, "
           "previous_signal string, changed boolean")
LAST = "checked_at timestamp, signal string"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First sight and changes of one asset's signal, in check order. A check
    not later than the last one seen is late and left out."""
    rows = pd.concat(list(batches)).sort_values("checked_at")
    last_at, last = state.get if state.exists else (None, None)
    if last_at is not None:
        rows = rows[rows["checked_at"] > pd.Timestamp(last_at)]
    if rows.empty:
        return
    before = rows["signal"].shift(1)
    before.iloc[0] = last
    rows = rows.assign(previous_signal=before.astype(object).where(before.notna(), None))
    rows["changed"] = rows["previous_signal"].notna() & (rows["previous_signal"] != rows["signal"])
    state.update((rows["checked_at"].iloc[-1].to_pydatetime(), rows["signal"].iloc[-1]))
    out = rows[rows["previous_signal"].isna() | rows["changed"]]
    yield out[["asset_id", "ticker", "checked_at", "signal", "confidence", "previous_signal", "changed"]]


def signal_changes(signals: DataFrame) -> DataFrame:
    """Stream of (asset_id, ticker, checked_at, signal, confidence) to the rows
    to log: the first signal of an asset and every flip, the flips being the
    alerts. State is the last check per asset; an asset has one check per model
    run, so a micro-batch holds few rows of each."""
    return signals.groupBy("asset_id").applyInPandasWithState(
        _changes, CHANGES, LAST, "append", GroupStateTimeout.NoTimeout)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["asset_id", "ticker", "checked_at", "signal", "confidence", "previous_signal", "changed"]
CHECK = "checked_at timestamp, ticker string, signal string, confidence double"


@contextmanager
def typed_state(spark):
    """Streams started inside keep their state in RocksDB, which typed state and
    timers need. A running stream keeps its setting; the session gets its own back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _millis(at: pd.Series) -> list[int]:
    """Milliseconds of the epoch, rounded up, so no timer is before its check."""
    return [int(v) for v in -(-at.astype("datetime64[us]").astype("int64") // 1000)]


class OrderedChanges(StatefulProcessor):
    """Checks of one asset wait in a map by time until the watermark has passed
    them; their timers fire in time order. `idle_ms` after the last check the
    asset is forgotten."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", CHECK)
        self.last = handle.getValueState("last", "at long, signal string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == "":
            return  # rows of no asset only move the clock
        done = (self.last.get() or (None,))[0]
        for batch in rows:
            batch = batch.dropna(subset=["signal"])
            # of several rows of one check the greatest (signal, confidence) counts, whatever came first
            for at, check in zip(_millis(batch["checked_at"]), batch[["checked_at", "ticker", "signal", "confidence"]].itertuples(index=False)):
                if done is not None and at <= done:
                    continue
                value = (check[0].to_pydatetime(), *(None if pd.isna(v) else v for v in check[1:]))
                known = self.waiting.getValue((at,))
                if known is None:
                    self.handle.registerTimer(at)
                elif self._rank(known) >= self._rank(value):
                    continue
                self.waiting.updateValue((at,), value)
        yield from ()

    @staticmethod
    def _rank(check: tuple) -> tuple:
        return check[2], -1.0 if check[3] is None else check[3], check[1] or ""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        check = self.waiting.getValue((now,))
        seen, before = self.last.get() or (None, None)
        if check is None:
            if self.idle_ms is not None and seen is not None and seen + self.idle_ms <= now:
                self.last.clear()
            return
        at, ticker, signal, confidence = check
        self.waiting.removeKey((now,))
        self.last.update((now, signal))
        if self.idle_ms is not None:
            if seen is not None:
                self.handle.deleteTimer(seen + self.idle_ms)
            self.handle.registerTimer(now + self.idle_ms)
        if before != signal:
            row = (int(key[0]), ticker, pd.Timestamp(at), signal, float("nan") if confidence is None else confidence, before, before is not None)
            yield pd.DataFrame([row], columns=COLUMNS)

    def close(self) -> None:
        pass


def ordered_signal_changes(signals: DataFrame, delay: str = "3 days", idle_days: int | None = None) -> DataFrame:
    """As `signal_changes`, for checks that arrive in any order: a check is logged
    once the newest check of the whole stream is `delay` past it, so arrivals up to
    `delay` late change nothing in the result. Later ones are left out and counted
    by Spark as rows dropped by the watermark.

    Checks of an asset differ by a millisecond or more. Rows without signal or time
    are not checks; rows without asset only move the clock, which lets a producer
    flush the last checks. An asset without a check for `idle_days` is forgotten and
    its next signal is a first sight again. Start the stream within `typed_state`.
    """
    idle = None if idle_days is None else idle_days * 86_400_000
    # the key is text and never NULL: a NULL among numbers would turn the keys of its whole Arrow batch into floats
    asset = F.coalesce(F.col("asset_id").cast("int").cast("string"), F.lit("")).alias("asset")
    timed = signals.select(asset, "ticker", "checked_at", "signal", "confidence")
    return timed.filter(F.col("checked_at").isNotNull()).withWatermark("checked_at", delay).groupBy("asset").transformWithStateInPandas(
        statefulProcessor=OrderedChanges(idle), outputStructType=CHANGES, outputMode="append", timeMode="EventTime")
