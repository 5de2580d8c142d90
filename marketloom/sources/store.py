"""Star-schema tables on Parquet and their maintenance.

Rules (`upsert`, `insert_ignore`, ...) are plain DataFrame functions. `Store`
applies them to month-partitioned folders: it reads only the partitions a batch
touches, writes the merged rows to the shared scratch folder first, and then
overwrites just those partitions. A path is never overwritten by a plan that
still reads it.

Tables in `LEDGERS` carry a month ledger that the batch which changes a month
brings up to date. The months are marked stale before the table is written and
entered anew after it, so a job that fails in between leaves marks, and the next
reader counts the marked months again from their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from marketloom.operators import ledger as L, ranking
from marketloom.session import cut_lineage


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins on all columns; `batch` has one row per key."""
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `batch` whose key is new; first write wins."""
    return batch.join(target.select(*keys), keys, "left_anti")


def coalesce_upsert(target: DataFrame, batch: DataFrame, keys: list[str], keep_old: list[str] = (),
                    keep_when_null: list[str] = ()) -> DataFrame:
    """Batch values win, except: `keep_old` columns only fill a NULL, and
    `keep_when_null` columns keep the old value when the new one is NULL."""
    cols = [c for c in target.columns if c not in keys]
    new = batch.withColumnsRenamed({c: f"_new_{c}" for c in cols}).withColumn("_hit", F.lit(True))
    old = target.withColumnsRenamed({c: f"_old_{c}" for c in cols})
    hit = F.coalesce("_hit", F.lit(False))

    def value(c: str) -> Column:
        o, n = F.col(f"_old_{c}"), F.col(f"_new_{c}")
        if c in keep_old:
            return F.coalesce(o, n)
        return F.coalesce(n, o) if c in keep_when_null else F.when(hit, n).otherwise(o)

    return old.join(new, keys, "full_outer").select(*keys, *[value(c).alias(c) for c in cols])


def replace_by(target: DataFrame, batch: DataFrame, column: str, managed: list[str]) -> DataFrame:
    """Rows of managed provenance leave, the batch comes in; an empty batch is
    refused, since it would only delete."""
    if batch.isEmpty():
        raise ValueError("refusing to replace with an empty batch")
    return target.filter(~F.col(column).isin(managed) | F.col(column).isNull()).unionByName(batch)


def counts_by(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Row counts per provenance before and after: the dry-run report."""
    n = lambda df, name: df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    both = n(before, "n_before").join(n(after, "n_after"), column, "full_outer")
    return both.na.fill(0, ["n_before", "n_after"])


@dataclass(frozen=True)
class Purge:
    """Outcome of a purge. `daily` is the whole index afterwards, `rebuilt` the
    part that was aggregated anew."""
    removed: DataFrame
    pairs: DataFrame
    rebuilt: DataFrame
    daily: DataFrame
    report: DataFrame


def purge_sources(news: DataFrame, daily: DataFrame, bad: DataFrame) -> Purge:
    """Remove all news of the `bad` sources and rebuild the daily index for
    exactly the (asset, day) pairs they touched; pairs left without news get
    no row. Without a match everything stays as it is."""
    from marketloom.operators.sentiment import daily_index
    ids = bad.select("source_id").distinct()
    removed = news.join(ids, "source_id", "left_semi")
    pairs = removed.select("asset_id", F.col("published_d").alias("d")).distinct()
    left = news.join(ids, "source_id", "left_anti")
    touched = left.join(pairs.withColumnRenamed("d", "published_d"), ["asset_id", "published_d"], "left_semi")
    rebuilt = daily_index(touched)
    after = daily.join(pairs, ["asset_id", "d"], "left_anti").unionByName(rebuilt)
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    report = removed.agg(F.count(F.lit(1)).alias("deleted")).withColumns({
        "affected": n(pairs), "rebuilt": n(rebuilt)}).withColumn("zero", F.col("affected") - F.col("rebuilt"))
    return Purge(removed, pairs, rebuilt, after, report)


def assign_ids(target: DataFrame, names: DataFrame, id_col: str, key: str) -> DataFrame:
    """(id, key) for the keys not in `target`, numbered on from its largest id
    in key order. Positions come from distributed counts, not from one task."""
    new = names.select(key).distinct().join(target.select(key), key, "left_anti")
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    return ranking.value_ranks(new, [], key).select((top + F.col("below") + 1).cast("bigint").alias(id_col), key)


def date_dimension(days: DataFrame, day: str = "d") -> DataFrame:
    """Calendar rows for the span of `days`, ISO weekday (Monday 1)."""
    span = days.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    d = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return calendar_fields(d)


def calendar_fields(days: DataFrame) -> DataFrame:
    dow = F.weekday("d") + 1
    return days.select("d", F.year("d").alias("y"), F.month("d").alias("m"), F.dayofmonth("d").alias("day"),
                       dow.alias("dow"), (dow >= 6).alias("is_weekend"))


def with_default(df: DataFrame, column: str, default) -> DataFrame:
    """A column older files lack, with its default."""
    return df.withColumn(column, F.coalesce(F.col(column) if column in df.columns else F.lit(None), F.lit(default)))


@dataclass(frozen=True)
class Table:
    """Schema, key and the date column a table is partitioned on (by month)."""
    ddl: str
    keys: tuple[str, ...]
    day: str | None = None


TABLES = {
    "dim_asset": Table("asset_id bigint, ticker string, asset_name string, asset_class string, currency string, "
                       "exchange string", ("ticker",)),
    "dim_source": Table("source_id bigint, source_name string, source_type string, base_url string, "
                        "credibility_score double", ("source_name", "source_type")),
    "dim_date": Table("d date, y int, m int, day int, dow int, is_weekend boolean", ("d",)),
    "fact_price_daily": Table("asset_id bigint, ticker string, d date, open double, high double, low double, "
                              "close double, adj_close double, volume bigint, return_1d double, pct_change double",
                              ("asset_id", "d"), "d"),
    "fact_technical_daily": Table("asset_id bigint, ticker string, d date, sma_20 double, sma_50 double, sma_200 double, "
                                  "ema_12 double, ema_26 double, macd double, macd_signal double, macd_hist double, "
                                  "rsi_14 double, volatility_20 double, momentum_5 double, momentum_21 double, "
                                  "momentum_63 double", ("asset_id", "d"), "d"),
    "fact_news": Table("news_hash string, asset_id bigint, ticker string, source_id bigint, published_at timestamp, "
                       "published_d date, title string, url string, sentiment_score double, sentiment_label string",
                       ("news_hash",), "published_d"),
    "fact_sentiment_daily": Table("asset_id bigint, d date, news_count bigint, sentiment_mean double, "
                                  "sentiment_median double, pos_count bigint, neu_count bigint, neg_count bigint",
                                  ("asset_id", "d"), "d"),
    "fact_fundamentals_quarterly": Table("asset_id bigint, ticker string, fiscal_period_end date, announced_d date, "
                                         "revenue double, net_income double, eps_diluted double, gross_margin double, "
                                         "net_margin double, total_debt double, stockholders_equity double, "
                                         "free_cash_flow double, source string",
                                         ("asset_id", "fiscal_period_end"), "fiscal_period_end"),
    "dim_company_profile": Table("asset_id bigint, cik string, legal_name string, business_description string, "
                                 "latest_10k_filed date, latest_10k_accession string, latest_10k_url string, "
                                 "recent_filings array<struct<form:string,filed:string,accession:string,url:string>>",
                                 ("asset_id",)),
    "dim_watchlist": Table("asset_id bigint, ticker string, added_at timestamp", ("asset_id",)),
    "fact_watchlist_signal_log": Table("asset_id bigint, ticker string, signal string, confidence double, "
                                       "checked_at timestamp", ("asset_id", "checked_at")),
}
MONTH = L.MONTH
LEDGERS = {
    "fact_price_daily": lambda rows: L.ledger(rows, marks=L.price_marks()),
    "fact_news": lambda rows: L.ledger(rows, "published_d", "source_id", L.news_marks(), "news_hash"),
    "fact_sentiment_daily": L.ledger,
    "fact_technical_daily": L.ledger,
}
STALE = "stale"


class Store:
    """The tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def schema(self, name: str) -> StructType:
        ddl = TABLES[name].ddl + (f", {MONTH} string" if TABLES[name].day else "")
        return StructType.fromDDL(ddl)

    def exists(self, name: str, month: str | None = None) -> bool:
        path = self.path(name) + (f"/{MONTH}={month}" if month else "")
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.exists(jvm_path))

    def read(self, name: str) -> DataFrame:
        """The stored rows; an empty frame before the first write."""
        schema = self.schema(name)
        df = (self.spark.read.schema(schema).parquet(self.path(name)) if self.exists(name)
              else self.spark.createDataFrame([], schema))
        return df.drop(MONTH)

    def _with_month(self, name: str, df: DataFrame) -> DataFrame:
        day = TABLES[name].day
        return df.withColumn(MONTH, F.date_format(day, "yyyy-MM")) if day else df

    def conform(self, name: str, df: DataFrame) -> DataFrame:
        """Columns in table order with table types; absent ones are NULL."""
        fields = StructType.fromDDL(TABLES[name].ddl).fields
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                           .cast(f.dataType).alias(f.name) for f in fields])

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the whole table (dimensions, provenance replacement)."""
        staged = cut_lineage(self._with_month(name, self.conform(name, df)), name)
        self._save(name, staged, "static")

    def _save(self, name: str, staged: DataFrame, mode: str) -> None:
        writer = staged
        if TABLES[name].day:
            # range partitions split a month that holds most rows over many tasks
            writer = staged.repartitionByRange(MONTH, *TABLES[name].keys)
        if name in LEDGERS:
            self._enter(name, self._blank(staged, STALE), mode)
        w = writer.write.mode("overwrite").option("partitionOverwriteMode", mode)
        (w.partitionBy(MONTH) if TABLES[name].day else w).parquet(self.path(name))
        if name in LEDGERS:
            self._enter(name, LEDGERS[name](staged))

    def _ledger_path(self, name: str) -> str:
        return self.path(f"ledger_{name}")

    def _entries(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(L.SCHEMA)
        return (self.spark.read.schema(schema).parquet(self._ledger_path(name)) if self.exists(f"ledger_{name}")
                else self.spark.createDataFrame([], schema))

    def _enter(self, name: str, entries: DataFrame, mode: str = "dynamic") -> None:
        """Replace the entries of the months in `entries`, or all of them."""
        entries.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(
            MONTH).parquet(self._ledger_path(name))

    @staticmethod
    def _blank(rows: DataFrame, what: str) -> DataFrame:
        """One entry without counts for each month of `rows`."""
        return L.conform(rows.select(MONTH).distinct().withColumn("what", F.lit(what)))

    def ledger(self, name: str) -> DataFrame:
        """The month ledger of a stored table. Months that a failed write left
        marked, or that were stored before there was a ledger, are counted from
        their rows first; no other row is read."""
        if not self.exists(name):
            return self._entries(name).limit(0)
        stored = self.spark.read.schema(self.schema(name)).parquet(self.path(name))
        known = self._entries(name).groupBy(MONTH).agg(F.bool_or(F.col("what") == STALE).alias("stale"))
        todo = (stored.select(MONTH).distinct().join(known, MONTH, "full_outer")
                .filter(F.coalesce("stale", F.lit(True))).select(MONTH))
        months = [row[0] for row in todo.collect()]
        if months:
            self._recount(name, stored, months)
        return self._entries(name).filter(~F.col("what").isin("empty", STALE))

    def _recount(self, name: str, stored: DataFrame, months: list[str]) -> None:
        """Enter months from their rows; a month without rows is entered empty."""
        gone = self._blank(self.spark.createDataFrame([(m,) for m in months], f"{MONTH} string"), "empty")
        counted = LEDGERS[name](stored.filter(F.col(MONTH).isin(months)))
        self._enter(name, cut_lineage(gone.unionByName(counted), f"{name}-ledger"))

    def _touched(self, name: str, batch: DataFrame) -> DataFrame | None:
        """Stored rows of the months in `batch`, None if there are none: a list
        of months, a dozen a year, prunes the scan."""
        if not self.exists(name):
            return None
        current = self.spark.read.schema(self.schema(name)).parquet(self.path(name))
        if not TABLES[name].day:
            return current
        months = [row[0] for row in batch.select(MONTH).distinct().collect()]
        stored = [m for m in months if self.exists(name, m)]
        return current.filter(F.col(MONTH).isin(stored)) if stored else None

    def upsert(self, name: str, batch: DataFrame) -> None:
        """Last write wins per key. New months are written straight away; only
        months that hold rows are merged through the scratch folder."""
        table = TABLES[name]
        batch = cut_lineage(self._with_month(name, self.conform(name, batch)), f"{name}-batch")
        stored = self._touched(name, batch)
        merged = batch if stored is None else cut_lineage(upsert(stored, batch, list(table.keys)), name)
        self._save(name, merged, "dynamic" if table.day else "static")

    def near(self, name: str, batch: DataFrame) -> DataFrame:
        """Stored rows of the months the rows of `batch` lie in. For news this
        is where a headline can be stored, since its hash covers its date."""
        rows = self._touched(name, self._with_month(name, batch))
        return self.read(name).limit(0) if rows is None else rows.drop(MONTH)

    def insert_ignore(self, name: str, batch: DataFrame) -> tuple[int, int]:
        """Append the rows with new keys; returns (attempted, inserted). The
        key of a month-partitioned table determines the row's day."""
        table = TABLES[name]
        batch = self._with_month(name, self.conform(name, batch)).dropDuplicates(list(table.keys))
        batch = cut_lineage(batch, f"{name}-batch")
        stored = self._touched(name, batch)
        fresh = batch if stored is None else cut_lineage(insert_ignore(batch=batch, target=stored, keys=list(table.keys)), f"{name}-new")
        attempted, inserted = batch.count(), fresh.count()
        if inserted:
            entries = self._appended(name, fresh) if name in LEDGERS else None
            w = (fresh.repartitionByRange(MONTH, *table.keys) if table.day else fresh).write.mode("append")
            (w.partitionBy(MONTH) if table.day else w).parquet(self.path(name))
            if entries is not None:
                self._enter(name, entries)
        return attempted, inserted

    def _appended(self, name: str, fresh: DataFrame) -> DataFrame:
        """Mark the months of new rows; returns their ledger entries with the new
        rows added, without reading the rows that are stored."""
        months = fresh.select(MONTH).distinct()
        before = self.ledger(name).join(months, MONTH, "left_semi")
        entries = cut_lineage(L.merge(L.conform(before), LEDGERS[name](fresh)), f"{name}-ledger")
        self._enter(name, self._blank(fresh, STALE))
        return entries

    def delete(self, name: str, keys: DataFrame) -> None:
        """Drop the rows whose key is in `keys`, rewriting only months that hold one."""
        table, on = TABLES[name], keys.columns
        current = self.spark.read.schema(self.schema(name)).parquet(self.path(name))
        if not table.day:
            return self.write(name, current.join(keys, on, "left_anti"))
        months = [r[0] for r in current.join(keys, on, "left_semi").select(MONTH).distinct().collect()]
        rest = cut_lineage(current.filter(F.col(MONTH).isin(months)).join(keys, on, "left_anti"), name)
        left = {r[0] for r in rest.select(MONTH).distinct().collect()}
        gone = sorted(set(months) - left)
        if name in LEDGERS and gone:
            emptied = self.spark.createDataFrame([(m,) for m in gone], f"{MONTH} string")
            self._enter(name, self._blank(emptied, STALE))
        self._save(name, rest, "dynamic")
        for month in gone:
            self._drop_partition(name, month)

    def _drop_partition(self, name: str, month: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{MONTH}={month}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
