"""Filing facts: first-known values, tag priorities, quarterly assembly.

A fact says that an entity reported `val` under `tag` and `unit` for the period
(`start_d`, `end_d`] in the filing of `filed_d`; `pos` is its payload position.
Many filings repeat a period; each step reduces them with an aggregate that
combines on the map side, so a much-repeated fact never fills a task. What is
left per entity is one row per measure and period end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketloom.functions import params as P
from marketloom.functions.numeric import ratio
from marketloom.session import cut_lineage

INSTANT, QUARTER, ANNUAL = "instant", "quarter", "annual"


def measure_table(spark: SparkSession) -> DataFrame:
    """(measure, tag, prio, unit, instant, latest, skip_zero, promote)."""
    rows = []
    for measure, tags in {**P.DURATION_TAGS, **P.EPS_TAGS, **P.INSTANT_TAGS}.items():
        eps, revenue = measure in P.EPS_TAGS, measure == "revenue"
        for prio, tag in enumerate(tags, 1):
            rows.append((measure, tag, prio, "USD/shares" if eps else "USD",
                         measure in P.INSTANT_TAGS, eps, revenue, revenue))
    return spark.createDataFrame(rows, "measure string, tag string, prio int, unit string, "
                                       "instant boolean, latest boolean, skip_zero boolean, promote boolean")


def span(start: str = "start_d", end: str = "end_d") -> Column:
    """'quarter' or 'annual' by length in days, NULL for anything else."""
    days = F.datediff(F.col(end), F.col(start))
    return F.when(days.between(*P.QUARTER_DAYS), QUARTER).when(days.between(*P.ANNUAL_SPAN_DAYS), ANNUAL)


def complete(facts: DataFrame) -> DataFrame:
    return facts.dropna(subset=["val", "end_d", "filed_d"])


def in_span(facts: DataFrame, kind: str) -> DataFrame:
    """Facts of one span; instants are not checked for a length."""
    rows = complete(facts)
    return rows.withColumn("start_d", F.lit(None).cast("date")) if kind == INSTANT else \
        rows.filter(span() == kind)


def known_values(rows: DataFrame, keys: list[str], latest: Column | bool = False) -> DataFrame:
    """One row per key: the value of the earliest filing (or of the latest, for
    per-share figures), the earliest filing date, and the first start given.
    Payload order decides between facts of the same filing date."""
    latest = F.lit(latest) if isinstance(latest, bool) else latest
    first, last = F.min_by("val", filing_order()), F.max_by("val", filing_order(-1))
    given = F.min_by("start_d", F.when(F.col("start_d").isNotNull(), F.col("pos")))
    return rows.groupBy(*keys).agg(
        F.when(F.max(latest), last).otherwise(first).alias("val"),
        F.min("filed_d").alias("filed_d"), given.alias("start_d"))


def filing_order(sign: int = 1) -> Column:
    """(filed_d, pos), or (filed_d, -pos), as one number. Unlike a struct it keeps
    the aggregation a hash aggregation: raw facts are combined without a sort.
    A position has at most 19 digits."""
    day = F.unix_date("filed_d").cast("decimal(18,0)") * F.lit(Decimal(10 ** 19))
    return (day + sign * F.col("pos").cast("decimal(19,0)")).cast("decimal(38,0)")


def priority_fold(known: DataFrame, keys: list[str], skip_zero: Column | bool = False,
                  promote: Column | bool = False, ratio_: float = P.SUBLINE_RATIO) -> DataFrame:
    """Per key, the highest-priority candidate's value. With `promote`, a lower
    candidate replaces the value chosen so far when it is `ratio_` times larger.
    `used` lists the tags that were chosen at some point. A key has at most one
    row per candidate tag, so the fold runs over a handful of values."""
    lit = lambda c: F.lit(c) if isinstance(c, bool) else c
    item = "struct<val:double,filed_d:date,start_d:date,tag:string>"
    rows = known.withColumn("_promote", lit(promote)).filter(
        ~(lit(skip_zero) & (F.col("val") == 0)))
    fact = F.struct("prio", "val", "filed_d", "start_d", "tag", "_promote")
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    pick = lambda f: F.struct(f["val"].alias("val"), f["filed_d"].alias("filed_d"),
                              f["start_d"].alias("start_d"), f["tag"].alias("tag"))

    def step(acc: Column, f: Column) -> Column:
        best = acc["best"]
        wins = best.isNull() | (f["_promote"] & (F.abs(f["val"]) > F.abs(best["val"]) * ratio_))
        return F.struct(F.when(wins, pick(f)).otherwise(best).alias("best"),
                        F.when(wins, F.concat(acc["used"], F.array(f["tag"])))
                        .otherwise(acc["used"]).alias("used"))

    zero = F.struct(F.lit(None).cast(item).alias("best"),
                    F.array().cast("array<string>").alias("used"))
    return (found.withColumn("out", F.aggregate("facts", zero, step))
            .select(*keys, "out.best.*", "out.used"))


def series(facts: DataFrame, measures: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, measure, span, end_d) -> chosen value, for all measures at once."""
    rows = complete(facts).join(measures, ["tag", "unit"])
    kind = F.when(F.col("instant"), INSTANT).otherwise(span())
    rows = (rows.withColumn("span", kind).filter(F.col("span").isNotNull())
            .withColumn("start_d", F.when(~F.col("instant"), F.col("start_d"))))
    flags = ["latest", "skip_zero", "promote"]
    known = known_values(rows, [entity, "measure", "span", "prio", "tag", "end_d", *flags], F.col("latest"))
    return priority_fold(known, [entity, "measure", "span", "end_d"], F.col("skip_zero"), F.col("promote"))


def used_tags(chosen: DataFrame, measures: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Tags that contributed per entity and measure, in priority order."""
    each = (chosen.filter(F.col("span") != ANNUAL)
            .select(entity, "measure", F.explode("used").alias("tag")).distinct())
    ranked = each.join(measures.select("measure", "tag", "prio"), ["measure", "tag"])
    ordered = F.array_sort(F.collect_list(F.struct("prio", "tag")))
    return ranked.groupBy(entity, "measure").agg(ordered["tag"].alias("tags"))


def containing_years(quarters: DataFrame, years: DataFrame, entity: str = "entity_id",
                     closed: bool = True) -> DataFrame:
    """Quarter ends inside (fy_start, fy_end], or strictly before fy_end.

    A year is spread over the (at most 14) months it touches and meets the
    quarters on (entity, month), an equi-join, before the exact test.
    """
    months = F.sequence(F.trunc("fy_start", "month"), F.trunc("fy_end", "month"), F.expr("interval 1 month"))
    spread = (years.filter(F.col("fy_start").isNotNull() & (F.col("fy_start") < F.col("fy_end")))
              .withColumn("_month", F.explode(months)))
    upper = F.col("end_d") <= F.col("fy_end") if closed else F.col("end_d") < F.col("fy_end")
    return (quarters.withColumn("_month", F.trunc("end_d", "month")).join(spread, [entity, "_month"])
            .filter((F.col("end_d") > F.col("fy_start")) & upper).drop("_month"))


def years_of(chosen: DataFrame, measure: str = "revenue", entity: str = "entity_id") -> DataFrame:
    return chosen.filter((F.col("measure") == measure) & (F.col("span") == ANNUAL)).select(
        entity, F.col("end_d").alias("fy_end"), F.col("start_d").alias("fy_start"),
        F.col("val").alias("fy_val"), F.col("filed_d").alias("fy_filed"))


def quarters_of(chosen: DataFrame, measure: str = "revenue", entity: str = "entity_id") -> DataFrame:
    return chosen.filter((F.col("measure") == measure) & (F.col("span") == QUARTER)).select(
        entity, "end_d", "val", "filed_d")


def mistagged(quarters: DataFrame, years: DataFrame, entity: str = "entity_id",
              tolerance: float = P.MISTAG_TOLERANCE) -> DataFrame:
    """Quarters whose value nearly equals that of a fiscal year around them."""
    inside = containing_years(quarters, years.filter(F.col("fy_val") != 0), entity)
    near = F.abs(F.abs(F.col("val")) / F.abs(F.col("fy_val")) - 1) <= tolerance
    return inside.filter(near).select(entity, "end_d").distinct()


def without_mistagged(quarters: DataFrame, years: DataFrame, entity: str = "entity_id") -> DataFrame:
    return quarters.join(mistagged(quarters, years, entity), [entity, "end_d"], "left_anti")


def total_debt(long_term: Column, short_term: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(long_term.isNotNull() | short_term.isNotNull(),
                  F.coalesce(long_term, zero) + F.coalesce(short_term, zero))


def measures_frame(spine: DataFrame, wide: DataFrame, entity: str, source: str) -> DataFrame:
    """Margins, debt and cash flow on the revenue spine."""
    df = spine.join(wide, [entity, "end_d"], "left")
    return df.select(
        entity, F.col("end_d").alias("fiscal_period_end"), F.col("filed_d").alias("announced_d"),
        "revenue", "net_income", "eps_diluted", ratio("gross_profit", "revenue").alias("gross_margin"),
        ratio("net_income", "revenue").alias("net_margin"),
        total_debt(F.col("long_term_debt"), F.col("short_term_debt")).alias("total_debt"),
        "stockholders_equity",
        (F.col("operating_cash_flow") - F.abs("capex")).alias("free_cash_flow"),
        F.lit(source).alias("source"))


def widen(chosen: DataFrame, names: list[str], entity: str) -> DataFrame:
    """One column per measure; periods are one row per (entity, end)."""
    return chosen.groupBy(entity, "end_d").agg(*[
        F.max(F.when(F.col("measure") == n, F.col("val"))).alias(n) for n in names])


OTHERS = ["net_income", "gross_profit", "operating_cash_flow", "capex", "eps_diluted"]
INSTANTS = list(P.INSTANT_TAGS)


def quarterly(facts: DataFrame, measures: DataFrame, derive_q4: bool = False,
              entity: str = "entity_id") -> DataFrame:
    """Quarterly statements per entity, anchored on revenue. The chosen values,
    a small fraction of the facts, are read several times and written once."""
    chosen = cut_lineage(series(facts, measures, entity), "chosen-facts")
    years = years_of(chosen, "revenue", entity)
    revenue = without_mistagged(quarters_of(chosen, "revenue", entity), years, entity)
    spine = revenue.select(entity, "end_d", "filed_d", F.col("val").alias("revenue"))
    wide = widen(chosen.filter(F.col("span") != ANNUAL), OTHERS + INSTANTS, entity)
    out = measures_frame(spine, wide, entity, "edgar")
    if derive_q4:
        out = out.unionByName(derived_quarters(facts, measures, chosen, revenue, entity))
    return collapse_near_ends(out, entity)


def q4_candidates(facts: DataFrame, measures: DataFrame, chosen: DataFrame, revenue: DataFrame,
                  entity: str = "entity_id") -> DataFrame:
    """Fiscal years with exactly three inner quarters and none at the year end,
    with both reconstructions of the missing quarter per measure."""
    years = years_of(chosen, "revenue", entity)
    at_end = revenue.select(entity, F.col("end_d").alias("fy_end"))
    open_years = years.join(at_end, [entity, "fy_end"], "left_anti")
    inner = containing_years(revenue, open_years, entity, closed=False)
    key = [entity, "fy_end"]
    three = (inner.groupBy(*key, "fy_filed", "fy_start").agg(F.collect_list("end_d").alias("ends"))
             .filter(F.size("ends") == 3))
    fields = measures.filter(F.col("measure").isin(list(P.DURATION_TAGS)))
    ends = three.select(*key, "fy_filed", F.explode("ends").alias("end_d"))

    # one tag in one filing: the filing of the annual figure
    raw = complete(facts).join(fields, ["tag", "unit"]).withColumn("span", span())
    one = raw.groupBy(entity, "measure", "prio", "filed_d", "end_d").agg(
        F.min_by("val", F.when(F.col("span") == QUARTER, F.col("pos"))).alias("q"),
        F.max_by("val", F.when(F.col("span") == ANNUAL, F.col("pos"))).alias("fy"))
    filing = cut_lineage(one.withColumnRenamed("filed_d", "fy_filed"), "filing-values")
    inner_sum = (ends.join(filing.filter("q IS NOT NULL"), [entity, "fy_filed", "end_d"])
                 .groupBy(*key, "measure", "prio").agg(F.count(F.lit(1)).alias("k"), F.sum("q").alias("qs"))
                 .filter("k = 3"))
    total = (three.select(*key, "fy_filed")
             .join(filing.filter("fy IS NOT NULL").withColumnRenamed("end_d", "fy_end"),
                   [entity, "fy_filed", "fy_end"]).select(*key, "measure", "prio", "fy"))
    same = (total.join(inner_sum, [*key, "measure", "prio"])
            .groupBy(*key, "measure").agg(F.min_by(F.col("fy") - F.col("qs"), "prio").alias("same_filing")))

    # the year minus the quarters as first filed
    quarters = chosen.filter(F.col("span") == QUARTER).select(entity, "measure", "end_d", "val")
    parts = (ends.join(quarters, [entity, "end_d"]).groupBy(*key, "measure")
             .agg(F.count(F.lit(1)).alias("k"), F.sum("val").alias("qs")).filter("k = 3"))
    annual = chosen.filter(F.col("span") == ANNUAL).select(
        entity, F.col("end_d").alias("fy_end"), "measure", F.col("val").alias("fy"))
    filed = parts.join(annual, [*key, "measure"]).select(
        *key, "measure", (F.col("fy") - F.col("qs")).alias("as_filed"))
    scale = F.greatest(F.abs("same_filing"), F.abs("as_filed"))
    agree = (scale == 0) | (F.abs(F.col("same_filing") - F.col("as_filed")) / scale <= P.RECONCILE_TOLERANCE)
    both = same.join(filed, [*key, "measure"], "full_outer")
    return (both.join(three.select(*key, "fy_filed"), key)
            .withColumn("agree", F.coalesce(F.when(scale == 0, True).otherwise(agree), F.lit(False))))


def derived_quarters(facts: DataFrame, measures: DataFrame, chosen: DataFrame, revenue: DataFrame,
                     entity: str = "entity_id") -> DataFrame:
    """Fourth quarters whose two reconstructions agree; EPS is never derived."""
    ok = (q4_candidates(facts, measures, chosen, revenue, entity).filter("agree")
          .select(entity, F.col("fy_end").alias("end_d"), "fy_filed", "measure",
                  F.col("same_filing").alias("val")))
    spine = ok.filter(F.col("measure") == "revenue").select(
        entity, "end_d", F.col("fy_filed").alias("filed_d"), F.col("val").alias("revenue"))
    flows = widen(ok, [n for n in OTHERS if n != "eps_diluted"], entity).withColumn(
        "eps_diluted", F.lit(None).cast("double"))
    instants = widen(chosen.filter(F.col("span") == INSTANT), INSTANTS, entity)
    wide = flows.join(instants, [entity, "end_d"], "full_outer")
    return measures_frame(spine, wide, entity, "edgar_derived")


def collapse_near_ends(rows: DataFrame, entity: str = "entity_id",
                       days: int = P.SAME_QUARTER_DAYS) -> DataFrame:
    """Period ends at most `days` after the last kept one are the same quarter;
    the row announced first stays, ties keep the earlier end.

    Ends are cut into runs of close neighbours; inside a run (a few rows) a fold
    keeps the exact rule. One row per entity and end reaches the window.
    """
    cols = rows.columns
    w = Window.partitionBy(entity).orderBy("fiscal_period_end", "announced_d")
    far = F.datediff("fiscal_period_end", F.lag("fiscal_period_end").over(w)) > days
    run = F.sum(F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).over(w)
    others = [F.col(c) for c in cols if c not in ("fiscal_period_end", "announced_d", entity)]
    row = F.struct("fiscal_period_end", "announced_d", *others)
    runs = rows.withColumn("_run", run).groupBy(entity, "_run").agg(
        F.sort_array(F.collect_list(row)).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        same = F.datediff(x["fiscal_period_end"], last["fiscal_period_end"]) <= days
        winner = F.when(x["announced_d"] < last["announced_d"], x).otherwise(last)
        return F.when(same, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(winner))).otherwise(
            F.concat(kept, F.array(x)))

    tail = F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
    kept = F.aggregate(tail, F.slice("rows", 1, 1), step)
    return runs.select(entity, F.inline(kept)).select(*cols)
