"""Correlations of every pair of assets, each over the days that both have.

Assets are cut into blocks of `BLOCK` neighbouring ids. A tile is two blocks and
one year: it lays the values and their presence out as day by asset matrices, and
six matrix products give the sums of all its pairs. Sums add up over the years,
so a task holds one tile, at most 366 days of 2 * `BLOCK` assets, and a row is
sent once per block, never once per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from marketloom.functions import numeric as X
from marketloom.operators.rows import beside
from marketloom.session import cut_lineage

BLOCK = 256
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
TILE_SUMS = "asset_a long, asset_b long, n long, sx double, sy double, sxx double, syy double, sxy double"


def _tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over common days of every pair (a, b), a < b, with `a` in the lower
    block of the tile and `b` in the higher one."""
    lower, higher, _ = key
    ids, column = np.unique(rows["asset"].to_numpy(), return_inverse=True)
    days, line = np.unique(rows["d"].to_numpy(), return_inverse=True)
    value, present = np.zeros((len(days), len(ids))), np.zeros((len(days), len(ids)))
    value[line, column] = rows["x"].to_numpy()
    present[line, column] = 1.0
    left, right = ids // BLOCK == lower, ids // BLOCK == higher
    x, y, mx, my = value[:, left], value[:, right], present[:, left], present[:, right]
    sums = [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
    a, b = np.meshgrid(ids[left], ids[right], indexing="ij")
    met = (a < b) & (sums[0] > 0)
    out = {"asset_a": a[met], "asset_b": b[met], **{c: s[met] for c, s in zip(SUMS, sums)}}
    return pd.DataFrame(out).astype({"n": "int64"})


def pair_correlations(panel: DataFrame, value: str, asset: str = "asset_id", day: str = "d") -> DataFrame:
    """(asset_a, asset_b, n, r) for every two assets with a common day, the lower
    id first. A pair uses its own complete days; `r` is NULL where a side is
    constant over them or one day is all there is.

    The panel has one row per asset and day; of repeated rows the largest value
    counts. Rows without asset, day or a finite value are left out, an empty
    panel gives no pairs, other columns are not read.
    """
    rows = panel.select(F.col(asset).cast("long").alias("asset"), F.col(day).cast("date").alias("day"), X.finite(value).alias("x"))
    rows = rows.dropna().groupBy("asset", "day").agg(F.max("x").alias("x"))
    # values around their asset's mean: r is the same and its sums keep their digits
    rows = rows.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("asset")))
    rows = cut_lineage(rows.withColumn("block", F.floor(F.col("asset") / BLOCK)), "pairs")
    blocks = rows.agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    own = F.col("block")
    tiles = beside(rows, blocks).withColumn("other", F.explode("blocks"))
    tiles = tiles.select("asset", "x", F.datediff("day", F.lit("1970-01-01").cast("date")).alias("d"),
                         F.least(own, "other").alias("lower"), F.greatest(own, "other").alias("higher"),
                         F.year("day").alias("year"))
    sums = tiles.groupBy("lower", "higher", "year").applyInPandas(_tile_sums, TILE_SUMS)
    whole = sums.groupBy("asset_a", "asset_b").agg(*[F.sum(c).alias(c) for c in SUMS])
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    # what is left of a constant side is rounding, a minute part of its sum of squares
    vx, vy = (F.when(spread(s, ss) > 1e-12 * F.col(ss), spread(s, ss)) for s, ss in (("sx", "sxx"), ("sy", "syy")))
    shared = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.try_divide(shared, F.sqrt(vx) * F.sqrt(vy))
    # least and greatest pass over NULL, so an undefined r is kept out of them
    bounded = F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return whole.select("asset_a", "asset_b", "n", bounded.alias("r"))


def pair_design_effect(pairs: DataFrame, n_rows, least: int = 2) -> DataFrame:
    """Effective sample size from the mean r over pairs of at least `least`
    common days, every pair counted once: (mean_r, n_pairs, n_assets, n,
    design_effect, n_eff). `n_rows` is the nominal sample size, a column."""
    known = pairs.filter((F.col("n") >= least) & F.col("r").isNotNull())
    mean = known.agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n_pairs"))
    sides = known.select(F.explode(F.array("asset_a", "asset_b")).alias("asset"))
    out = mean.withColumns({"n_assets": sides.agg(F.count_distinct("asset")).scalar(), "n": n_rows})
    deff = 1 + (F.col("n_assets") - 1) * F.col("mean_r")
    return out.withColumn("design_effect", deff).withColumn("n_eff", F.try_divide(F.col("n"), deff))
