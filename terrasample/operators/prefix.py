"""Sums of large windows without their pixels: summed-area arrays by tile, and the tiles' totals.

A raster is summarised once: of every tile the running sums of count, value and square over
its rows and columns, and the three totals.  A window then takes four numbers of each tile at its
border and the totals of the tiles within, one small row each, whatever the number of pixels.  Values are
taken from the raster's mean (the pivot), so that squares of large, near values don't cancel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.operators import window
from terrasample.sources.raster import Raster
from terrasample.sources.shared import cut, shared_folder, ship

#: Reducers that are functions of count, sum and sum of squares.
SUMS = ("count", "sum", "mean", "std", "var")


@dataclass(frozen=True)
class Summed:
    """``areas`` has a tile's running sums (three arrays a band), ``totals`` its last ones; ``pivot`` what values are taken from."""

    raster: Raster
    bands: tuple[str, ...]
    areas: DataFrame
    totals: DataFrame
    pivot: dict[str, float]


def _valid(batch: pa.RecordBatch, bands: list[str], nodata: dict[str, float | None]) -> Iterator[np.ndarray]:
    """Of each tile its valid values (band x pixel, NaN where there is none); of several bands a pixel is valid in all or none."""
    columns = [batch.column(b) for b in bands]
    for k in range(len(batch)):
        x = np.stack([c[k].values.to_numpy(zero_copy_only=False).astype(float) for c in columns])
        good = np.isfinite(x)
        for n, b in enumerate(bands):
            if nodata[b] is not None:
                good[n] &= x[n] != nodata[b]
        yield np.where(good.all(0), x, np.nan)


def summed(raster: Raster, bands: list[str]) -> Summed:
    """The sums of a raster's tiles, written to the shared folder; read once for the pivot and once for the sums."""
    spark = raster.tiles.sparkSession
    ship(spark)
    size, keys = raster.size, raster.keys
    nodata = {b: n for b, n in zip(raster.header.bands, raster.header.nodata, strict=True) if b in bands}
    tiles = raster.tiles.select(*keys, *bands)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(bands))
        for batch in batches:
            for x in _valid(batch, bands, nodata):
                n, total = n + int((~np.isnan(x[0])).sum()), total + np.nansum(x, 1)
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([float(t)]) for t in total)], names=["n", *bands])

    got = tiles.mapInArrow(means, "n bigint, " + ", ".join(f"`{b}` double" for b in bands)).agg(F.sum("n").alias("n"), *(F.sum(b).alias(b) for b in bands)).first()
    pivot = {b: (got[b] / got["n"] if got["n"] else 0.0) for b in bands}

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in enumerate(_valid(batch, bands, nodata)):
                good = ~np.isnan(x[0]).reshape(size, size)
                out = [good.astype(np.int64).cumsum(0).cumsum(1)]
                for n, b in enumerate(bands):
                    d = np.where(good, x[n].reshape(size, size) - pivot[b], 0.0)
                    out += [d.cumsum(0).cumsum(1), (d * d).cumsum(0).cumsum(1)]
                lists = [pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(a.ravel())) for a in out]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in keys), *lists], names=[*keys, *_names(bands)])

    kinds = dict(raster.tiles.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "n array<bigint>", *(f"`{c}` array<double>" for c in _names(bands)[1:])])
    folder = shared_folder(spark)
    table = cut(tiles.mapInArrow(areas, schema), folder, "areas", 64)
    totals = cut(table.select(*keys, *(F.element_at(f"`{c}`", size * size).alias(c) for c in _names(bands))), folder, "totals")
    return Summed(raster, tuple(bands), table, totals, pivot)


def _names(bands: list[str] | tuple[str, ...]) -> list[str]:
    return ["n", *(f"{b}{suffix}" for b in bands for suffix in ("|s", "|q"))]


def window_sums(points: DataFrame, of: Summed, sides: list[float], names: list[str], coverage: str = "touched") -> DataFrame:
    """One row for each point: _row and for each of some windows a struct w0, w1, ... of the columns of window_stats, for reducers of SUMS.

    Equal to the pixels' statistics but for the rounding of sums.  Windows that are turned against the grid (a raster in another
    system than the point's zone) have no rectangle of pixels: these points go by their pixels.
    """
    if bad := [n for n in names if n.lower() not in SUMS]:
        raise ValueError(f"{bad} aren't functions of sums; use {', '.join(SUMS)}")
    raster, bands = of.raster, list(of.bands)
    if raster.header.crs is None:
        return _rectangles(points, of, sides, names, coverage)
    corner = window.index_ranges(window.corners(points, raster, sides[-1]), raster)
    straight = (F.col("pr")[0] == F.col("pr")[1]) & (F.col("pc")[1] == F.col("pc")[2])
    marked = corner.select(*points.columns, straight.alias("_straight"))
    plain = _rectangles(marked.where("_straight").drop("_straight"), of, sides, names, coverage)
    turned = window.nested_stats(marked.where("not coalesce(_straight, false)").drop("_straight"), raster, sides, names, bands, coverage)
    return plain.unionByName(turned)


def _rectangles(points: DataFrame, of: Summed, sides: list[float], names: list[str], coverage: str) -> DataFrame:
    raster, bands, columns = of.raster, list(of.bands), _names(of.bands)
    size, keys = raster.size, [k for k in raster.keys if k == "image_id"]
    ranges = [
        window.index_ranges(window.corners(points, raster, side), raster).select(window.ROW, *keys, F.lit(k).alias("w"), "r0", "r1", "c0", "c1", "total")
        for k, side in enumerate(sides)
    ]
    every = reduce(DataFrame.unionByName, ranges)
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    touched = every.where("r0 <= r1 and c0 <= c1").withColumn("tile_row", F.explode(F.sequence(tile("r0"), tile("r1")))).withColumn("tile_col", F.explode(F.sequence(tile("c0"), tile("c1"))))
    tr, tc = F.col("tile_row") * size, F.col("tile_col") * size
    touched = touched.withColumns({
        "q0": F.greatest("r0", tr) - tr, "q1": F.least(F.col("r1"), tr + size - 1) - tr, "k0": F.greatest("c0", tc) - tc, "k1": F.least(F.col("c1"), tc + size - 1) - tc,
    }).drop("r0", "r1", "c0", "c1", "total")
    whole = (F.col("q0") == 0) & (F.col("k0") == 0) & (F.col("q1") == size - 1) & (F.col("k1") == size - 1)
    on = [*keys, "tile_row", "tile_col"]
    inner = touched.where(whole).join(of.totals, on).select(window.ROW, "w", *(f"`{c}`" for c in columns))

    def area(c: str) -> Column:
        """The sum over the rectangle out of four running sums."""
        at = lambda q, k: F.when((q >= 0) & (k >= 0), F.get(F.col(f"`{c}`"), (q * size + k).cast("int"))).otherwise(0)
        q0, q1, k0, k1 = (F.col(x) for x in ("q0", "q1", "k0", "k1"))
        return at(q1, k1) - at(q0 - 1, k1) - at(q1, k0 - 1) + at(q0 - 1, k0 - 1)

    border = touched.where(~whole).join(of.areas, on).select(window.ROW, "w", *(area(c).alias(c) for c in columns))
    sums = inner.unionByName(border).groupBy(window.ROW, "w").agg(*(F.sum(f"`{c}`").alias(c) for c in columns))
    out = every.select(window.ROW, "w", "total").join(sums, [window.ROW, "w"], "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))

    def statistic(b: str, name: str) -> Column:
        s, q, pivot = F.col(f"`{b}|s`"), F.col(f"`{b}|q`"), F.lit(of.pivot[b])
        spread = F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)
        found = {"count": n, "sum": s + n * pivot, "mean": s / n + pivot, "var": F.when(n > 1, spread), "std": F.when(n > 1, F.sqrt(spread))}
        return F.when(n > 0, found[name.lower()])

    inside = F.coalesce(F.col("total") > 0, F.lit(False))
    area_cells = {k: max(1, round((side / abs(raster.header.a)) ** 2)) for k, side in enumerate(sides)}
    geometric = F.element_at(F.create_map(*(x for k, v in area_cells.items() for x in (F.lit(k), F.lit(v)))), F.col("w"))
    cells = F.col("total") if coverage == "touched" else F.when(inside, geometric).otherwise(0)
    pct = F.when(cells > 0, F.least(n * 100.0 / cells, F.lit(100.0))).otherwise(0.0)
    row = F.struct(
        F.col("total").alias("total"), n.alias("n_pixels"), *(n.alias(f"{b}.n_valid") for b in bands), *(statistic(b, m).alias(f"{b}.{m}") for b in bands for m in names),
        inside.alias("in_extent"), (inside & (n < cells)).alias("had_nodata"), pct.alias("coverage_pct"),
    )
    rows = out.select(window.ROW, "w", row.alias("v"))
    return rows.groupBy(window.ROW).agg(*(F.max(F.when(F.col("w") == k, F.col("v"))).alias(f"w{k}") for k in range(len(sides))))
