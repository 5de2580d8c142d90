"""Single-row results next to other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of the one-row frame `one` to every row of `df`, as one
    scalar subquery: no join, and `one` is computed once."""
    packed = one.select(F.struct(*one.columns)).scalar()
    kept = [c for c in df.columns if c not in one.columns]
    return df.select(*kept, packed.alias("_one")).select(*kept, "_one.*")
