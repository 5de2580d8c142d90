"""Pair-by-pair correlations against pandas, over gaps and edges."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import pairs

SCHEMA = "asset_id int, d date, x double"


def days(n):
    return [dt.date(2022, 11, 1) + dt.timedelta(days=i) for i in range(n)]


def test_pairs_use_their_own_complete_days(spark):
    """Gaps of different lengths, over a new year, ids in three blocks."""
    rng = np.random.default_rng(5)
    ids, common = [1, 2, 255, 256, 300, 900], rng.normal(size=150)
    wide = pd.DataFrame({i: 100.0 * i + common * (k % 3) + rng.normal(size=150) for k, i in enumerate(ids)}, index=days(150))
    wide = wide.mask(rng.random(wide.shape) < 0.4)
    wide.loc[wide.index[:70], 2] = np.nan
    rows = [(i, d, None if np.isnan(v) else float(v)) for i in ids for d, v in wide[i].items()]
    got = {(r.asset_a, r.asset_b): r for r in pairs.pair_correlations(spark.createDataFrame(rows, SCHEMA), "x").collect()}
    want = wide.corr()
    assert set(got) == {(a, b) for a in ids for b in ids if a < b}
    for (a, b), row in got.items():
        assert row.n == int((wide[a].notna() & wide[b].notna()).sum())
        assert row.r == pytest.approx(want.loc[a, b], abs=1e-10)
    pooled = pairs.pair_design_effect(spark.createDataFrame([tuple(r) for r in got.values()], "asset_a long, asset_b long, n long, r double"),
                                      F.lit(600)).first()
    mean = np.mean([want.loc[k] for k in got])
    assert pooled.mean_r == pytest.approx(mean) and (pooled.n_pairs, pooled.n_assets) == (15, 6)
    assert pooled.n_eff == pytest.approx(600 / (1 + 5 * mean))


def test_edges(spark):
    """Constant sides, single days, repeated and unusable rows, clashing names."""
    d = days(6)
    rows = [(1, x, float(i)) for i, x in enumerate(d)] + [(2, x, 0.1) for x in d] + [(3, d[0], 4.0)]
    rows += [(4, x, -2.0 * i) for i, x in enumerate(d)] + [(4, d[0], None), (4, d[1], -2.0), (None, d[0], 1.0), (5, None, 1.0)]
    rows += [(5, d[0], float("nan")), (5, d[1], float("inf"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("x"), "lower": F.lit(1), "year": F.lit(None)})
    got = {(r.asset_a, r.asset_b): (r.n, r.r) for r in pairs.pair_correlations(df, "x").collect()}
    assert got[1, 4] == (6, pytest.approx(-1.0))
    assert got[1, 2] == (6, None) and got[1, 3] == (1, None) and got[2, 4] == (6, None)
    assert not any(5 in k for k in got)


def test_empty_panel(spark):
    found = pairs.pair_correlations(spark.createDataFrame([], SCHEMA), "x")
    assert found.count() == 0
    row = pairs.pair_design_effect(found, F.lit(0)).first()
    assert (row.n_pairs, row.n_assets, row.mean_r, row.n_eff) == (0, 0, None, None)
