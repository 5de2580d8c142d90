"""Admission of arriving rows by the clock, with nothing lost in silence.

Every arrival carries the time at which it came. A row is late when its own stamp
lies more than the lookback before its arrival, and undated without a stamp. A
stamp ahead of the clock is held back and judged again with the next batches, so a
wrong clock at one publisher moves nothing else: no watermark follows the rows'
stamps. Each batch writes its rows and counts under its number, so a replay
replaces its own files only, and at any time

    arrived = kept + late + undated + held after the newest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from marketloom.session import cut_lineage
from marketloom.streaming.intraday import EVERY, LOOKBACK

AHEAD = "5 minutes"
KEPT, LATE, UNDATED, HELD = "kept", "late", "undated", "held"
COUNTS = "batch long, clock timestamp, arrived long, kept long, late long, undated long, held long"


def with_arrival(files: DataFrame) -> DataFrame:
    """Adds `arrived_at`, the time at which a row's file was complete. Replays
    see the same time, which the wall clock would not give."""
    return files.withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def verdicts(rows: DataFrame, clock, lookback: str = LOOKBACK, ahead: str = AHEAD) -> DataFrame:
    """Adds `verdict`: 'undated', 'late' against the row's arrival, 'held' while
    its stamp is more than `ahead` after `clock`, else 'kept'. A row without an
    arrival is never late."""
    at, came = F.col("published_at"), F.col("arrived_at")
    is_late = F.coalesce(at < came - F.expr(f"interval {lookback}"), F.lit(False))
    is_early = F.coalesce(at > clock + F.expr(f"interval {ahead}"), F.lit(False))
    return rows.withColumn("verdict", F.when(at.isNull(), UNDATED).when(is_late, LATE).when(is_early, HELD).otherwise(KEPT))


class Admission:
    """The side tables of one stream below `folder`: `rows` by verdict and batch,
    and `counts`."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, lookback: str = LOOKBACK, ahead: str = AHEAD):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.lookback, self.ahead = lookback, ahead
        # both folders exist from the start, so that readers need not ask
        self._blank(COUNTS).write.mode("ignore").parquet(f"{self.folder}/counts/batch_no=-1")
        for verdict in (KEPT, LATE, UNDATED, HELD):
            self._blank(schema).write.mode("ignore").parquet(f"{self.folder}/{verdict}/batch_no=-1")

    def _blank(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """One row per batch. `arrived` counts the batch's own rows, the verdicts
        those and the rows that were held before it."""
        return self.spark.read.parquet(f"{self.folder}/counts").drop("batch_no")

    def rows(self, verdict: str) -> DataFrame:
        """All rows of a verdict; of 'held' those after the newest batch."""
        found = self.spark.read.schema(StructType([*self.schema.fields, StructField("batch_no", LongType())])).parquet(f"{self.folder}/{verdict}")
        if verdict == HELD:
            found = found.filter(F.col("batch_no") == F.coalesce(self.counts().agg(F.max("batch")).scalar(), F.lit(-1)))
        return found.drop("batch_no")

    def admit(self, batch: DataFrame, number: int, deliver: Callable[[DataFrame, int], None] | None = None) -> None:
        """Judge one batch and the rows held before it, write each verdict, hand
        the kept rows to `deliver`, and enter the counts last: a batch without
        counts has not been admitted and its replay writes the same again."""
        before = self.counts().filter(F.col("batch") < number).agg(F.max("batch").alias("batch"), F.max("clock").alias("clock")).first()
        waiting = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{HELD}/batch_no={-1 if before.batch is None else before.batch}")
        came = cut_lineage(batch.select(*self.schema.names), "arrivals")
        seen = came.agg(F.count(F.lit(1)).alias("n"), F.max("arrived_at").alias("clock")).first()
        # the clock never runs backwards; arrivals that come together are judged by their newest
        clock = max((c for c in (before.clock, seen.clock) if c is not None), default=None)
        judged = cut_lineage(verdicts(waiting.unionByName(came), F.lit(clock).cast("timestamp"), self.lookback, self.ahead), "judged")
        for verdict in (KEPT, LATE, UNDATED, HELD):
            part = judged.filter(F.col("verdict") == verdict).drop("verdict")
            part.write.mode("overwrite").parquet(f"{self.folder}/{verdict}/batch_no={number}")
        if deliver is not None:
            deliver(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{KEPT}/batch_no={number}"), number)
        sums = judged.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (KEPT, LATE, UNDATED, HELD)])
        line = sums.select(F.lit(number).cast("long").alias("batch"), F.lit(clock).cast("timestamp").alias("clock"),
                           F.lit(seen.n).cast("long").alias("arrived"), KEPT, LATE, UNDATED, HELD)
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/batch_no={number}")


def run_admitted_stream(arrivals: DataFrame, admission: Admission, checkpoint: str,
                        deliver: Callable[[DataFrame, int], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Poll every 30 minutes (or drain what is there); kept rows go to `deliver`,
    such as `lambda rows, _: store_batch(store, hashed(rows))`."""
    writer = (arrivals.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, number: admission.admit(batch, number, deliver)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=EVERY)
    return writer.start()
