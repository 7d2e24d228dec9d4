"""Quality columns and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_coverage(n_valid: Column, total: Column) -> Column:
    """A band's valid share in percent, two decimals, at most 100."""
    return F.when(total > 0, F.least(F.rint(n_valid * 10000.0 / total) / 100, F.lit(100.0))).otherwise(0.0)


def coverage_summary(rows: DataFrame) -> DataFrame:
    """One row of ``rows`` (id, coverage_pct): how many have none, some or all of their pixels; null counts as none."""
    pct = F.coalesce("coverage_pct", F.lit(0.0))
    return rows.agg(
        F.count_if(pct == 0).alias("n_no_data"), F.count_if((pct > 0) & (pct < 100)).alias("n_partial"),
        F.count_if(pct >= 100).alias("n_full")
    )


def ids_without_data(rows: DataFrame) -> DataFrame:
    """The ids of rows without any coverage."""
    return rows.where(F.coalesce("coverage_pct", F.lit(0.0)) == 0).select("id")
