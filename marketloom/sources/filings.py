"""Filing payloads: nested facts, filing index, registrant profiles, statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marketloom.functions import params as P
from marketloom.functions.numeric import ratio

FACT = "struct<start: string, end: string, val: double, filed: string>"
PAYLOAD = f"map<string, struct<units: map<string, array<{FACT}>>>>"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def flatten_facts(payloads: DataFrame, entity: str, json: str) -> DataFrame:
    """tag -> unit -> facts to (entity, tag, unit, start, end, val, filed, pos);
    facts without a value, end or filing date are dropped."""
    tags = payloads.select(entity, F.explode(F.from_json(F.col(json), PAYLOAD)).alias("tag", "entry"))
    units = tags.select(entity, "tag", F.explode("entry.units").alias("unit", "facts"))
    facts = units.select(entity, "tag", "unit", F.posexplode("facts").alias("pos", "f"))
    return facts.select(
        entity, "tag", "unit", F.to_date("f.start").alias("start_d"), F.to_date("f.end").alias("end_d"),
        F.col("f.val").alias("val"), F.to_date("f.filed").alias("filed_d"), "pos"
    ).dropna(subset=["val", "end_d", "filed_d"])


def filing_index(index: DataFrame, cik: str = "cik", forms: list[str] = P.FILING_FORMS,
                 keep: int = 8) -> DataFrame:
    """Parallel arrays (form, accession, filed, document) to the first `keep`
    filings of the wanted forms and the first 10-K. Works inside the row, so
    nothing is shuffled."""
    zipped = F.arrays_zip("form", "accession", "filed", "document")
    cik_int = F.col(cik).cast("bigint").cast("string")

    def entry(e: Column) -> Column:
        plain = F.replace(e["accession"], F.lit("-"), F.lit(""))
        url = F.concat(F.lit(ARCHIVE), cik_int, F.lit("/"), plain, F.lit("/"), e["document"])
        return F.struct(e["form"].alias("form"), e["filed"].alias("filed"),
                        e["accession"].alias("accession"), url.alias("url"))

    wanted = F.transform(F.filter(zipped, lambda e: e["form"].isin(forms)), entry)
    rest = [c for c in index.columns if c not in ("form", "accession", "filed", "document")]
    rows = index.withColumn("_all", wanted).select(
        *rest, F.slice("_all", 1, keep).alias("recent_filings"),
        F.get(F.filter("_all", lambda e: e["form"] == "10-K"), F.lit(0)).alias("_k"))
    return rows.withColumns({
        "latest_10k_filed": F.to_date("_k.filed"), "latest_10k_accession": F.col("_k.accession"),
        "latest_10k_url": F.col("_k.url")}).drop("_k")


def blank_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def joined_list(values: str | Column) -> Column:
    """', '-joined list without blanks; NULL when nothing is left."""
    c = F.col(values) if isinstance(values, str) else values
    return F.nullif(F.array_join(F.filter(c, lambda v: F.length(v) > 0), ", "), F.lit(""))


def registrant_ids(listing: DataFrame, ticker: str, number: str,
                   overrides: dict[str, str] = P.REGISTRANT_OVERRIDES) -> DataFrame:
    """Upper-case ticker to the ten-digit registrant id, overrides applied."""
    t = F.upper(F.col(ticker))
    fixed = reduce(lambda acc, kv: acc.when(t == kv[0], kv[1]), list(overrides.items())[1:],
                   F.when(t == next(iter(overrides)), overrides[next(iter(overrides))])) if overrides \
        else F.lit(None).cast("string")
    return listing.select(t.alias("ticker"), F.coalesce(
        fixed, F.lpad(F.col(number).cast("string"), 10, "0")).alias("cik"))


ITEMS = {"Total Revenue": "revenue", "Net Income": "net_income", "Diluted EPS": "eps_diluted",
         "Gross Profit": "gross_profit", "Total Debt": "total_debt",
         "Stockholders Equity": "stockholders_equity", "Free Cash Flow": "free_cash_flow"}


def statement_rows(matrix: DataFrame, entity: str, item: str, periods: dict[str, str]) -> DataFrame:
    """Matrix (row = line item, one column per period) to one row per period;
    a period without revenue, net income and EPS is skipped. `periods` maps
    column names to period ends."""
    cells = F.array(*[F.struct(F.to_date(F.lit(end)).alias("fiscal_period_end"), F.col(c).alias("val"))
                      for c, end in periods.items()])
    rows = matrix.select(entity, item, F.inline(cells))
    wide = rows.groupBy(entity, "fiscal_period_end").agg(*[
        F.first(F.when(F.col(item) == name, F.col("val")), ignorenulls=True).alias(col)
        for name, col in ITEMS.items()])
    return (wide.filter(F.coalesce("revenue", "net_income", "eps_diluted").isNotNull())
            .withColumns({"gross_margin": ratio("gross_profit", "revenue"),
                          "net_margin": ratio("net_income", "revenue")}).drop("gross_profit"))
