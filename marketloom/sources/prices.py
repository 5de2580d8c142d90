"""Price-bar intake from provider layouts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BARS = "ticker string, d date, open double, high double, low double, close double, adj_close double, volume bigint"
PROVIDER_LAYOUT = ("Ticker string, Date date, Open double, High double, Low double, Close double, "
                   "`Adj Close` double, Volume bigint")
PROVIDER_NAMES = {"Ticker": "ticker", "Date": "d", "Open": "open", "High": "high", "Low": "low",
                  "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
DAILY_LAYOUT = "Date date, Open double, High double, Low double, Close double, Volume bigint"
COLUMNS = list(PROVIDER_NAMES.values())


def normalise(raw: DataFrame) -> DataFrame:
    """Provider columns to bars; rows without a close are dropped."""
    return (raw.withColumnsRenamed(PROVIDER_NAMES).withColumn("d", F.to_date("d"))
            .dropna(subset=["close"]).select(*COLUMNS))


def read_provider(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.csv(path, header=True, schema=PROVIDER_LAYOUT))


def read_daily_files(spark: SparkSession, path: str, ticker: Column, start: dt.date,
                     end: dt.date, layout: str = DAILY_LAYOUT) -> DataFrame:
    """Daily-file provider: no adjusted close, volume may be missing (0), days
    outside [start, end] are left out. `ticker` comes from the file, usually its
    path (`input_file_name()`)."""
    raw = spark.read.csv(path, header=True, schema=layout)
    volume = F.coalesce("Volume", F.lit(0)) if "Volume" in raw.columns else F.lit(0)
    return raw.filter(F.col("Date").between(F.lit(start), F.lit(end))).select(
        F.upper(ticker).alias("ticker"), F.col("Date").alias("d"), F.col("Open").alias("open"),
        F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"),
        F.lit(None).cast("double").alias("adj_close"), volume.cast("bigint").alias("volume"))


def wide_to_long(wide: DataFrame, day: str, tickers: list[str], fields: list[str],
                 sep: str = "|") -> DataFrame:
    """One block of columns per ticker (`field|ticker`) to one row per ticker."""
    blocks = F.array(*[
        F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{f}{sep}{t}`").alias(f) for f in fields])
        for t in tickers])
    return wide.select(F.col(day), F.inline(blocks)).dropna(subset=["close"])


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Rows of the secondary provider for tickers the primary has nothing for;
    an empty primary is the case where that is every ticker."""
    have = primary.select("ticker").distinct()
    return primary.unionByName(secondary.join(have, "ticker", "left_anti"), allowMissingColumns=True)


def gap_fill(stored: DataFrame, fetched: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every missing business day per ticker with the fetched bar, if any: real
    rows only, nothing interpolated. `filled` tells the two apart."""
    days = F.sequence(F.lit(start), F.lit(end))
    tickers = stored.select("ticker").distinct()
    wanted = tickers.select("ticker", F.explode(days).alias("d")).filter(F.weekday("d") < 5)
    missing = wanted.join(stored.select("ticker", "d"), ["ticker", "d"], "left_anti")
    return (missing.join(fetched, ["ticker", "d"], "left")
            .withColumn("filled", F.col("close").isNotNull()))


def gap_fill_summary(filled: DataFrame) -> DataFrame:
    return filled.groupBy("ticker").agg(F.count_if("filled").alias("n_filled"),
                                        F.count_if(~F.col("filled")).alias("n_skipped"))


def history_summary(prices: DataFrame, requested: DataFrame) -> DataFrame:
    """Range and rows per requested ticker; tickers without data are listed."""
    got = prices.groupBy("ticker").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"),
                                       F.count(F.lit(1)).alias("n"))
    return (requested.join(got, "ticker", "left")
            .withColumns({"n": F.coalesce("n", F.lit(0)), "has_data": F.col("n").isNotNull()}))
