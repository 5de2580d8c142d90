"""Month ledgers: small aggregates of a daily table that can be merged, and the
data-quality reports that read them in place of the rows.

A ledger has one `rows` entry per (asset, reference, month): the number of rows,
the days that hold one and the days that hold several as bitmaps (bit 1 to 31),
the first and the last day. What is wrong with rows is counted per (asset,
reference, day) under the name of its check, so a ledger grows with assets,
months and findings, not with rows. The reference tells sources of news apart;
elsewhere it is NULL. Rows without a day are counted, but lie on no day.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions import params as P
from marketloom.operators import quality as Q

MONTH = "ym"
KEY = ["asset_id", "ref", "what", "d", MONTH]
SCHEMA = ("asset_id bigint, ref string, what string, d date, n bigint, days bigint, twice bigint, "
          f"first_d date, last_d date, {MONTH} string")


def price_marks() -> dict[str, Column]:
    close = F.col("close")
    return {"null_close": close.isNull(), "non_positive": close <= 0,
            "lost_return": close.isNotNull() & F.col("return_1d").isNull()}


def news_marks() -> dict[str, Column]:
    return {"out_of_range": (F.col("sentiment_score") < -1) | (F.col("sentiment_score") > 1)}


def day_bit(day: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.dayofmonth(day))


def month_of(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def ledger(rows: DataFrame, day: str = "d", ref: str | None = None, marks: dict[str, Column] | None = None,
           unique: str | None = None) -> DataFrame:
    """The ledger of `rows`. `unique` names a key: rows beyond the first of a key
    count as `repeat`; the key is expected to lie on one day of one asset. All
    counting is combined before rows are shuffled."""
    marks = dict(marks or {})
    day_key = ["asset_id", "ref", "d"]
    flagged = rows.select(F.col("asset_id").cast("bigint").alias("asset_id"),
                          (F.col(ref) if ref else F.lit(None)).cast("string").alias("ref"),
                          F.col(day).alias("d"), *([F.col(unique).alias("_key")] if unique else []),
                          *[F.coalesce(c, F.lit(False)).cast("bigint").alias(name) for name, c in marks.items()],
                          F.lit(1).cast("bigint").alias("n"))
    sums = lambda: [F.sum(c).alias(c) for c in ("n", *marks)]
    if unique:
        flagged = _with_repeats(flagged.groupBy(*day_key, "_key").agg(*sums()), ["n", *marks])
        marks["repeat"] = F.col("repeat")
    per_day = flagged.groupBy(*day_key).agg(*sums()).withColumn(MONTH, month_of("d"))
    bit = day_bit("d")
    long, date = (lambda c: c.cast("bigint")), (lambda c: c.cast("date"))
    # what is found in a month: at most one entry a check and day
    found = [F.collect_list(F.when(F.col(name) > 0, F.struct(F.lit(name).alias("what"), "d", F.col(name).alias("n"))))
             for name in marks]
    months = per_day.groupBy("asset_id", "ref", MONTH).agg(
        F.sum("n").alias("n"), F.bit_or(bit).alias("days"),
        F.bit_or(F.when(F.col("n") > 1, bit).otherwise(long(F.lit(0)))).alias("twice"),
        F.min("d").alias("first_d"), F.max("d").alias("last_d"),
        *([F.concat(*found).alias("found")] if found else []))
    none = F.lit(None)
    entry = F.array(F.struct(F.lit("rows").alias("what"), date(none).alias("d"), "n", "days", "twice", "first_d", "last_d"))
    if found:
        entry = F.concat(entry, F.transform("found", lambda x: F.struct(
            x.what.alias("what"), x.d.alias("d"), x.n.alias("n"), long(none).alias("days"),
            long(none).alias("twice"), date(none).alias("first_d"), date(none).alias("last_d"))))
    return conform(months.select("asset_id", "ref", MONTH, F.inline(entry)))


def _with_repeats(counted: DataFrame, cols: list[str]) -> DataFrame:
    """Counts per (asset, reference, day, key) with the rows beyond the first of
    the key; a key's references are sources, far fewer than its copies."""
    per_key = counted.groupBy("asset_id", "d", "_key").agg(
        F.sort_array(F.collect_list(F.struct("ref", *cols))).alias("refs"))
    first = lambda x, i: F.struct(x.ref.alias("ref"), *[x[c].alias(c) for c in cols],
                                  (x.n - F.when(i == 0, 1).otherwise(0)).alias("repeat"))
    return per_key.select("asset_id", "d", F.inline(F.transform("refs", first)))


def conform(entries: DataFrame) -> DataFrame:
    order = [field.strip().split(" ") for field in SCHEMA.split(",")]
    return entries.select(*[(F.col(c) if c in entries.columns else F.lit(None)).cast(t).alias(c) for c, t in order])


def merge(entries: DataFrame, more: DataFrame) -> DataFrame:
    """The ledger of both parts' rows together, of which neither is read again.
    Of two bitmaps, sum less union is what both hold: days that now hold several
    rows. Parts of a table with a unique key must not share keys."""
    union = F.bit_or("days")
    return conform(entries.unionByName(more).groupBy(*KEY).agg(
        F.sum("n").alias("n"), union.alias("days"),
        F.bit_or("twice").bitwiseOR(F.sum("days") - union).alias("twice"),
        F.min("first_d").alias("first_d"), F.max("last_d").alias("last_d")))


def rows_of(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("what") == "rows")


def month_days(entries: DataFrame, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Bitmap of the days that hold rows, per key and month."""
    return rows_of(entries).groupBy(*keys, MONTH).agg(F.bit_or("days").alias("days"))


def since(start: Column) -> Column:
    """Mask of the days of a month from `start` on."""
    first = F.when(F.col(MONTH) == month_of(start), F.dayofmonth(start)).when(F.col(MONTH) > month_of(start), 0)
    return F.coalesce(F.call_function("shiftleft", F.lit(-1).cast("bigint"), first), F.lit(0).cast("bigint"))


def scorecard(prices: DataFrame, news: DataFrame, sentiment: DataFrame, accepted: DataFrame,
              assets: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The eight checks of `quality.scorecard` from the ledgers of the three
    tables. `synthetic` lists the references (ref) of synthetic sources."""
    what, n = F.col("what"), F.col("n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    named = lambda name, value: F.struct(F.lit(name).alias("check"), value.alias("value"))
    marked = synthetic.select("ref").distinct().withColumn("_synthetic", F.lit(True))
    from_news = news.join(marked, "ref", "left").agg(F.array(
        named("news_duplicates", total(F.when(what == "repeat", n))),
        named("sentiment_out_of_range", total(F.when(what == "out_of_range", n))),
        named("synthetic_news_contamination", total(F.when((what == "rows") & F.col("_synthetic"), n)))).alias("c"))
    excused = (accepted.filter(F.col("check") == "non_positive_close_price")
               .join(assets.select("asset_id", "ticker"), "ticker").select("asset_id", "d").distinct()
               .withColumn("_excused", F.lit(True)))
    start = rows_of(prices).groupBy("asset_id").agg(F.min("first_d").alias("_start"))
    noted = prices.join(excused, ["asset_id", "d"], "left").join(start, "asset_id", "left")
    from_prices = noted.agg(F.array(
        named("price_null_close", total(F.when(what == "null_close", n))),
        named("duplicate_price_rows", total(F.bit_count("twice"))),
        named("non_positive_close_price", total(F.when((what == "non_positive") & F.col("_excused").isNull(), n))),
        named("price_null_return_with_close",
              total(F.when((what == "lost_return") & (F.col("d") != F.col("_start")), n)))).alias("c"))
    from_index = sentiment.agg(F.array(named("duplicate_sentiment_rows", total(F.bit_count("twice")))).alias("c"))
    card = reduce(DataFrame.unionByName, [p.select(F.inline("c")) for p in (from_news, from_prices, from_index)])
    return card.withColumn("status", F.when(F.col("value") == 0, "PASS").otherwise("FAIL"))


def technical_gaps(prices: DataFrame, technicals: DataFrame, assets: DataFrame, today: Column,
                   days: int = 30) -> DataFrame:
    """Price days of the last `days` without an indicator row, per ticker."""
    have = month_days(technicals).withColumnRenamed("days", "_have")
    both = month_days(prices).join(have, ["asset_id", MONTH], "left")
    lacking = F.col("days").bitwiseAND(F.bitwise_not(F.coalesce("_have", F.lit(0).cast("bigint"))))
    counted = both.withColumn("n", F.bit_count(lacking.bitwiseAND(since(F.date_sub(today, days))))).filter("n > 0")
    return (counted.join(assets.select("asset_id", "ticker"), "asset_id").groupBy("ticker")
            .agg(F.sum("n").alias("missing_technical_days")))


def coverage(prices: DataFrame, news: DataFrame, assets: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Trading days and days without news per ticker; a day counts once."""
    mask = since(F.date_sub(today, days))
    heard = month_days(news).withColumnRenamed("days", "_heard")
    both = month_days(prices).withColumn("days", F.col("days").bitwiseAND(mask)).filter("days <> 0").join(
        heard, ["asset_id", MONTH], "left")
    silent = F.col("days").bitwiseAND(F.bitwise_not(F.coalesce("_heard", F.lit(0).cast("bigint"))))
    per = both.join(assets.select("asset_id", "ticker"), "asset_id").groupBy("ticker").agg(
        F.sum(F.bit_count("days")).alias("trading_days"), F.sum(F.bit_count(silent)).alias("zero_news_days"))
    return per.withColumn("thin", F.col("zero_news_days") >= F.col("trading_days"))


def freshness(prices: DataFrame, news: DataFrame, sentiment: DataFrame, technicals: DataFrame,
              run_d: dt.date, limit: int = 4) -> DataFrame:
    """Newest day per table and whether prices are stale."""
    last = lambda entries: rows_of(entries).select(F.col("last_d").alias("d"), F.col("last_d").alias("published_d"))
    return Q.freshness(last(prices), last(news), last(sentiment), last(technicals), run_d, limit)


def calendar_gaps(prices: DataFrame, horizon: dt.date) -> DataFrame:
    """Days inside the stored range, from the horizon on, that no asset has."""
    held = month_days(prices, ())
    bounds = rows_of(prices).agg(F.greatest(F.min("first_d"), F.lit(horizon)).alias("lo"), F.max("last_d").alias("hi"))
    days = bounds.filter("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("d"))
    there = F.coalesce(F.col("days"), F.lit(0).cast("bigint")).bitwiseAND(day_bit("d")) != 0
    return days.withColumn(MONTH, month_of("d")).join(held, MONTH, "left").filter(~there).select("d")


def lookback(prices: DataFrame, assets: DataFrame, run_d: dt.date, expected_tickers: int,
             floor: int = P.LOOKBACK_FLOOR, ceiling: int = P.LOOKBACK_CEILING,
             margin: int = P.LOOKBACK_MARGIN) -> DataFrame:
    """How far back to fetch prices, as one row (lookback, reason)."""
    latest = (rows_of(prices).groupBy("asset_id").agg(F.max("last_d").alias("latest"))
              .join(assets.select("asset_id", "ticker"), "asset_id").select("ticker", "latest"))
    gap = calendar_gaps(prices, run_d - dt.timedelta(days=ceiling)).agg(F.min("d")).scalar()
    return Q.choose_lookback(latest, gap, run_d, expected_tickers, floor, ceiling, margin)
