"""Rasters as tile tables, and the registry of raster sources.

A raster is a :class:`Header` and a table of tiles: tile_row, tile_col, one
array of ``size * size`` numbers for each band (row-major, null where there is
no value), and for a collection image_id.  Bands are columns, so a scan reads
only those asked for; tile ids are the join keys, so windows are equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions import reducers
from terrasample.functions.grid import Header

#: Tiles of a source that Spark may send through the driver to all executors, in bytes: more are joined by sort and merge.
SENT_BYTES = 8 << 20


@dataclass(frozen=True)
class Raster:
    """``images`` is the dimension of a collection: image_id, time_start, time_end (dates or null).

    ``fetch`` is a source's way to read only some tiles: a function of a table of
    distinct keys and of the bands.
    """

    header: Header
    tiles: DataFrame
    size: int = 256
    images: DataFrame | None = None
    meta: dict[str, Any] = field(default_factory=dict)
    fetch: Callable[[DataFrame, list[str]], DataFrame] | None = None

    def tiles_for(self, wanted: DataFrame, bands: list[str]) -> DataFrame:
        """The tiles with some bands that windows want (their keys, repeats and nulls included): all there are, or those that the source is asked for."""
        if self.fetch is None:
            return self.tiles.select(*self.keys, *bands)
        return self.fetched(wanted.select(*self.keys).where("tile_row is not null and tile_col is not null").distinct(), bands)

    def fetched(self, keys: DataFrame, bands: list[str]) -> DataFrame:
        """The tiles of distinct keys by the source, never broadcast where there could be many.

        Spark takes arrays that a Python step makes, or that files hold compressed, to be far smaller than they are.
        """
        found, h = self.fetch(keys, bands), self.header
        most = -(-h.height // self.size) * -(-h.width // self.size) * self.size**2 * 8 * len(bands)
        if "image_id" in self.keys and most <= SENT_BYTES:  # of unknown images there may be any number
            most *= SENT_BYTES if self.images is None else self.images.count()
        return found.hint("merge") if most > SENT_BYTES else found

    def select(self, bands: list[str]) -> Raster:
        """Only some bands, in the order given."""
        missing = [b for b in bands if b not in self.header.bands]
        if missing:
            raise ValueError(f"Unknown bands {missing}; the raster has {list(self.header.bands)}")
        nodata = tuple(self.header.nodata[self.header.bands.index(b)] for b in bands)
        return replace(self, header=replace(self.header, bands=tuple(bands), nodata=nodata), tiles=self.tiles.select(*self.keys, *bands))

    @property
    def keys(self) -> list[str]:
        return [*(["image_id"] if "image_id" in self.tiles.columns else []), "tile_row", "tile_col"]


def only(raster: Raster, wanted: DataFrame) -> Raster:
    """``raster`` with the tiles that ``wanted`` (tile_row, tile_col and, of a collection, image_id or not) names and no others."""
    on = [k for k in raster.keys if k in wanted.columns]
    keys = wanted.select(*on).where("tile_row is not null and tile_col is not null").distinct()
    bands = list(raster.header.bands)
    if raster.fetch is not None and on == raster.keys:
        return replace(raster, fetch=None, tiles=raster.fetched(keys, bands))
    return replace(raster, fetch=None, tiles=raster.tiles.join(keys, on, "left_semi"))


def tiles_of_pixels(pixels: DataFrame, header: Header, size: int = 256, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dense tiles from a table of pixels: r, c and a column for each band; missing pixels and nodata are null.

    One aggregation by tile; a tile's pixels (``size`` squared) are its group, which bounds it.
    """
    place = (F.col("r") % size) * size + F.col("c") % size
    values = [reducers.masked(F.col(b), n).alias(b) for b, n in zip(header.bands, header.nodata, strict=True)]
    rows = pixels.where(F.col("r").between(0, header.height - 1) & F.col("c").between(0, header.width - 1))
    packed = rows.select(
        *keys, F.floor(F.col("r") / size).cast("int").alias("tile_row"),
        F.floor(F.col("c") / size).cast("int").alias("tile_col"),
        F.struct(place.cast("int").alias("o"), *values).alias("p")
    )
    grouped = packed.groupBy(*keys, "tile_row", "tile_col").agg(F.collect_list("p").alias("ps"))
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    missing = F.array_except(places, F.transform("ps", lambda p: p["o"]))
    filled = F.concat("ps", F.transform(missing, lambda o: F.struct(o.alias("o"), *(F.lit(None).cast("double").alias(b) for b in header.bands))))
    grouped = grouped.withColumn("ps", F.array_sort(filled))

    def dense(b: str) -> Column:
        return F.transform("ps", lambda p: p[b])

    return grouped.select(*keys, "tile_row", "tile_col", *(dense(b).alias(b) for b in header.bands))


def pixels_of_tiles(raster: Raster) -> DataFrame:
    """r, c and the bands of every pixel inside the raster."""
    h, size = raster.header, raster.size
    rows = raster.tiles.select(*raster.keys, F.posexplode(F.arrays_zip(*h.bands)).alias("o", "z"))
    out = rows.select(
        *(k for k in raster.keys if k == "image_id"),
        (F.col("tile_row") * size + F.floor(F.col("o") / size)).cast("int").alias("r"),
        (F.col("tile_col") * size + F.col("o") % size).cast("int").alias("c"),
        *(F.col(f"z.{b}").alias(b) for b in h.bands)
    )
    return out.where((F.col("r") < h.height) & (F.col("c") < h.width))


Source = Callable[..., Raster]
_sources: dict[str, Source] = {}


def register_source(name: str, source: Source) -> None:
    """Add a kind of raster source: a function (spark, dataset spec) -> Raster."""
    _sources[name] = source


def open_raster(spark, spec: dict[str, Any]) -> Raster:
    """The raster of a catalog entry, by its data_source."""
    kind = spec.get("data_source")
    if kind not in _sources:
        raise ValueError(f"Unknown data_source {kind!r}; known: {', '.join(sorted(_sources))}")
    return _sources[kind](spark, spec)
