"""Representative registered queries against their SQL form at the smallest scale.
`tools/check_oracle.py` runs all of them at any scale."""

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import TABLES, canon  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = ["price_bars", "technical_daily", "headline_hash", "headline_dedup", "lexicon_scores", "sentiment_daily", "daily_metrics", "dq_scorecard",
         "price_lookback", "ticker_correlations", "pooled_slope", "measure_series", "quarterly_fundamentals", "asof_next_day", "fundamentals_panel",
         "volatility_panel", "return_profile", "folds_direction", "winsor_bounds", "auc", "purge_rebuild", "keyed_upsert", "feed_intake", "filing_index",
         "paragraphs", "section_extract", "markup_text", "stream_unique_headlines"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canon(got), canon(want)
    assert len(a) == len(b) and a.equals(b)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_form_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
