"""Streams of points joined with a static raster (beyond the batch API).

The raster's tiles are a static table; every micro-batch runs the same window
plan as a batch, so results agree and the sink's checkpoint gives recovery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terrasample.operators import window
from terrasample.sources.raster import Raster


def enrich_stream(
    points: DataFrame, raster: Raster, window_m: float, names: list[str], bands: list[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Append each micro-batch's points with their statistics to a Parquet table."""
    def batch(df: DataFrame, number: int) -> None:
        rows = window.keyed(df)
        found = window.window_stats(window.sites(rows), raster, window_m, names, bands)
        out = rows.join(found, window.ROW, "left").drop(window.ROW)
        out.toDF(*(c.replace(".", "_") for c in out.columns)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
