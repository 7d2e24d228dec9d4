"""Image collections as folders of GeoTIFF files, read through Spark data sources.

Two data sources read a folder (with all below it) in some store that Arrow knows:
``terrasample_images``, a row for each file from its header alone, and ``terrasample_tiles``,
the files' pixels as tiles.  Filters on image_id, time_start, utm_zone and tile
ids are pushed to them: files whose name, or then whose header, fails one aren't read.

A file says of itself when it was taken and where it belongs: its metadata items
``system:time_start`` and ``system:time_end`` (epoch milliseconds) and ``UTM_ZONE``,
else its date tag, else a date in its name (2020-01-31 or 20200131).

A catalog entry is a collection if its path, or for remote assets the copy below the mirror
root, is a folder of several files.  Its images may lie apart: they share one grid, that of
their common system and pixel size, and each has its own place on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from terrasample.functions import crs
from terrasample.functions.grid import Header
from terrasample.sources import geotiff
from terrasample.sources.raster import Raster, register_source
from terrasample.sources.shared import cut, shared_folder, ship, sized

#: The session setting that names the mirror's root.
ROOT = "spark.terrasample.mirror"
IMAGES = (
    "image_id string, path string, time_start timestamp, time_end timestamp, utm_zone string, epsg int, left double, top double, "
    "a double, e double, width int, height int, bands array<string>, dtype string, nodata double"
)
_TYPES = {
    "image_id": pa.string(), "path": pa.string(), "time_start": pa.timestamp("us", "UTC"), "time_end": pa.timestamp("us", "UTC"), "utm_zone": pa.string(), "epsg": pa.int32(),
    "left": pa.float64(), "top": pa.float64(), "a": pa.float64(), "e": pa.float64(), "width": pa.int32(), "height": pa.int32(), "bands": pa.list_(pa.string()),
    "dtype": pa.string(), "nodata": pa.float64(),
}
_SUFFIX = (".tif", ".tiff")
#: Files, or files times rows of tiles, of one task.
PER_TASK = 64


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def files_below(folder: str) -> list[tuple[str, str]]:
    """image_id (the path below the folder, without its ending) and path of every GeoTIFF file, in order."""
    from pyarrow import fs

    store, base = _store(folder)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    if info.type == fs.FileType.File:
        return [(base.rsplit("/", 1)[-1].rsplit(".", 1)[0], folder)]
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(_SUFFIX))
    scheme, rest = folder.split("://", 1) if "://" in folder else ("", folder)
    # the store's paths begin with a bucket or, after a host that they lack, with a slash
    prefix = f"{scheme}://{rest[: len(rest) - len(base)] if not rest.startswith(base) else ''}" if scheme else ""
    return [(p[len(base.rstrip("/")) + 1 :].rsplit(".", 1)[0], prefix + p) for p in found]


def date_in(name: str) -> datetime | None:
    """The first date in a name."""
    for m in re.finditer(r"(?<!\d)(\d{4})-?(\d{2})-?(\d{2})(?!\d)", name):
        try:
            return datetime(*map(int, m.groups()), tzinfo=timezone.utc)
        except ValueError:
            continue
    return None


def times_of(items: dict[str, str], name: str) -> tuple[datetime | None, datetime | None]:
    """Start and end of an image by its metadata, its date tag or its name."""
    def at(key: str) -> datetime | None:
        text = items.get(key, "").strip()
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(float(text))) if re.fullmatch(r"-?\d+(\.\d*)?(e\d+)?", text, re.I) else None

    start = at("system:time_start")
    if start is None and "datetime" in items:
        try:
            start = datetime.strptime(items["datetime"][:19], "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc)
        except ValueError:
            start = None
    return start or date_in(name), at("system:time_end")


def describe(image_id: str, path: str) -> dict[str, Any]:
    """A row of the images' table, from the header of a file."""
    h, items = geotiff.details(geotiff._ranged(path))
    if h.rotated:
        raise ValueError(f"{path} has a turned grid, which a collection can't have")
    start, end = times_of(items, image_id.rsplit("/", 1)[-1])
    zone = items.get("UTM_ZONE")
    if zone is None and h.crs and h.crs // 100 in (326, 327):
        zone = f"{h.crs % 100}{'N' if h.crs // 100 == 326 else 'S'}"
    return {
        "image_id": image_id, "path": path, "time_start": start, "time_end": end, "utm_zone": zone, "epsg": h.crs, "left": h.c, "top": h.f, "a": h.a, "e": h.e,
        "width": h.width, "height": h.height, "bands": list(h.bands), "dtype": h.dtype, "nodata": h.nodata[0],
    }


class Pushed:
    """Filters that a scan applies itself, by column."""

    _TEST = {
        EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
        LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    }

    def __init__(self, columns: Iterable[str]):
        self.columns, self.filters = set(columns), []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what can be applied and gives back the rest."""
        for f in filters:
            if (type(f) in self._TEST or isinstance(f, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.filters.append(f)
            else:
                yield f

    def keeps(self, **values: Any) -> bool:
        """Whether a row of these values (others aren't known yet) can pass; null passes no comparison."""
        for f in self.filters:
            if (name := f.attribute[0]) in values:
                v = values[name]
                if isinstance(f, IsNotNull):
                    if v is None:
                        return False
                    continue
                x = tuple(f.value) if isinstance(f, In) else f.value
                if isinstance(v, datetime):
                    x = tuple(map(_aware, x)) if isinstance(f, In) else _aware(x)
                if v is None or not self._TEST[type(f)](v, x):
                    return False
        return True


def _aware(x: datetime) -> datetime:
    return x if x.tzinfo else x.replace(tzinfo=timezone.utc)


class Files(InputPartition):
    """Some files of a task: image_id and path, and of each the tiles' rows to read (null: its header)."""

    def __init__(self, units: list[tuple]):
        self.units = units


class ImageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.pushed = folder, Pushed(("image_id", "time_start", "utm_zone"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.pushed.take(filters))

    def partitions(self) -> Sequence[InputPartition]:
        found = [(i, p) for i, p in files_below(self.folder) if self.pushed.keeps(image_id=i)]
        return [Files(found[i : i + PER_TASK]) for i in range(0, len(found), PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = [d for i, p in partition.units if self.pushed.keeps(**{k: (d := describe(i, p))[k] for k in ("image_id", "time_start", "utm_zone")})]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _TYPES.items()], names=list(_TYPES))


class ImageSource(DataSource):
    """``spark.read.format("terrasample_images").load(folder)``: the headers of a folder's files."""

    @classmethod
    def name(cls) -> str:
        return "terrasample_images"

    def schema(self) -> str:
        return IMAGES

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options["path"])


class TileReader(DataSourceReader):
    def __init__(self, folder: str, size: int, bands: list[str]):
        self.folder, self.size, self.bands = folder, size, bands
        self.pushed = Pushed(("image_id", "time_start", "utm_zone", "tile_row", "tile_col"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.pushed.take(filters))

    def partitions(self) -> Sequence[InputPartition]:
        found = [(i, p) for i, p in files_below(self.folder) if self.pushed.keeps(image_id=i)]
        return [Files([f]) for f in found] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for image_id, path in partition.units:
            about = describe(image_id, path)
            if not self.pushed.keeps(time_start=about["time_start"], utm_zone=about["utm_zone"]):
                continue
            blocks = geotiff.Blocks(geotiff._ranged(path))
            h, size = blocks.header, self.size
            picked = [about["bands"].index(b) for b in self.bands]
            for i in range(-(-h.height // size)):
                for j in range(-(-h.width // size)):
                    if self.pushed.keeps(tile_row=i, tile_col=j):
                        x = blocks.window(i * size, min(h.height, (i + 1) * size), j * size, min(h.width, (j + 1) * size), picked)
                        known = [
                            pa.array([image_id]), pa.array([about["time_start"]], _TYPES["time_start"]), pa.array([about["utm_zone"]], pa.string()),
                            pa.array([i], pa.int32()), pa.array([j], pa.int32())
                        ]
                        arrays = geotiff._tile_arrays(x, size, tuple(h.nodata[b] for b in picked))
                        yield pa.RecordBatch.from_arrays([*known, *arrays], names=["image_id", "time_start", "utm_zone", "tile_row", "tile_col", *self.bands])


class TileSource(DataSource):
    """``spark.read.format("terrasample_tiles").option("bands", "b1,b2").load(folder)``: each file's own tiles, of ``size`` pixels a side."""

    @classmethod
    def name(cls) -> str:
        return "terrasample_tiles"

    def _bands(self) -> list[str]:
        return self.options.get("bands", "b1").split(",")

    def schema(self) -> str:
        return ", ".join(
            ["image_id string, time_start timestamp, utm_zone string, tile_row int, tile_col int", *(f"`{b}` array<double>" for b in self._bands())]
        )

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("size", "256")), self._bands())


def register(spark: SparkSession) -> None:
    """Make both data sources known to a session, with filters pushed to them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ImageSource, TileSource):
        spark.dataSource.register(source)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """The images of a folder (see IMAGES) with their footprints in degrees: west, south, east, north."""
    register(spark)
    found = spark.read.format(ImageSource.name()).load(folder)
    right, bottom = F.col("left") + F.col("a") * F.col("width"), F.col("top") + F.col("e") * F.col("height")
    xs = F.array(*(F.col("left") + (right - F.col("left")) * s for s in (0.0, 0.5, 1.0)))
    ys = F.array(*(F.col("top") + (bottom - F.col("top")) * s for s in (0.0, 0.5, 1.0)))
    around = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    place = F.transform(around, lambda p: _degrees(p["x"], p["y"], F.col("epsg")))
    least = lambda c: F.array_min(F.transform("_at", lambda p: p[c]))
    most = lambda c: F.array_max(F.transform("_at", lambda p: p[c]))
    # longitudes run on beyond 180 degrees: brought back, a west beyond the east says that the antimeridian is crossed
    back = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
    whole = most("lon") - least("lon") >= 360
    return found.withColumn("_at", place).withColumns({
        "west": F.when(whole, -180.0).otherwise(back(least("lon"))), "south": least("lat"),
        "east": F.when(whole, 180.0).otherwise(back(most("lon"))), "north": most("lat"),
    }).drop("_at")


def _degrees(x: Column, y: Column, epsg: Column) -> Column:
    """lon and lat of a place in a system that differs from row to row; of a raster without a system its own numbers."""
    struct = lambda lat, lon: F.struct(lon.alias("lon"), lat.alias("lat"))
    mercator = struct(*crs.mercator_inverse(x, y))
    zone = struct(*crs.utm_inverse(x, y, epsg))
    return F.when(epsg == 3857, mercator).when(F.floor(epsg / 100).isin(326, 327), zone).otherwise(struct(y, x))


def grid_of(found: DataFrame, folder: str) -> Header:
    """The common grid of a collection's images: their system and pixel size, from the first image's corner on; ValueError where they have no common one."""
    first = lambda c: F.min(c).alias(c)
    right, bottom = F.col("left") + F.col("a") * F.col("width"), F.col("top") + F.col("e") * F.col("height")
    got = found.agg(
        F.count("*").alias("n"), F.count_distinct(F.struct(F.coalesce("epsg", F.lit(0)), F.round("a", 9), F.round("e", 9), "bands")).alias("grids"),
        first("epsg"), first("a"), first("e"), first("bands"), F.min("left").alias("x0"), F.max(right).alias("x1"),
        F.min(F.least("top", bottom)).alias("y0"), F.max(F.greatest("top", bottom)).alias("y1"), F.max("dtype").alias("dtype"), F.count_distinct("dtype").alias("types")
    ).first()
    if not got["n"]:
        raise FileNotFoundError(f"no raster file below {folder}")
    if got["grids"] > 1:
        raise ValueError(f"the images of {folder} have {got['grids']} systems, pixel sizes or lists of bands; a collection has one")
    top = got["y1"] if got["e"] < 0 else got["y0"]
    size = lambda span, step: max(1, round(span / abs(step)))
    bands = tuple(got["bands"])
    return Header(
        size(got["x1"] - got["x0"], got["a"]), size(got["y1"] - got["y0"], got["e"]), got["a"], got["e"], got["x0"], top, crs=got["epsg"],
        bands=bands, nodata=(None,) * len(bands), dtype=got["dtype"] if got["types"] == 1 else "float64"
    )


def open_collection(spark: SparkSession, folder: str, size: int = 256, errors: str = "raise") -> Raster:
    """A folder's images as one raster on their common grid; only the tiles that windows want are read, each from its image's file.

    An image whose corner isn't on the grid's corners is moved to the nearest one (less than
    half a pixel).  ``errors``: "skip" leaves out tiles that can't be read.
    """
    found = cut(images(spark, folder), shared_folder(spark), "images")  # so that each file's header is read once
    header = grid_of(found, folder)
    bands = list(header.bands)
    shift = lambda c, origin, step: F.round((F.col(c) - F.lit(origin)) / F.lit(step)).cast("int")
    placed = sized(found).select("image_id", "path", "width", "height", shift("left", header.c, header.a).alias("dc"), shift("top", header.f, header.e).alias("dr"))

    def tiles(units: DataFrame, chosen: list[str]) -> DataFrame:
        picked = [bands.index(b) for b in chosen]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            name, own = None, None
            for batch in batches:
                for u in batch.to_pylist():
                    try:
                        if u["path"] != name:
                            name, own = u["path"], None
                            own = geotiff.Blocks(geotiff._ranged(name))
                        if own is None:
                            raise ValueError(f"{name} can't be read")
                        # the part of the tile that the image has
                        top, left = u["tile_row"] * size - u["dr"], u["tile_col"] * size - u["dc"]
                        r0, r1, c0, c1 = max(0, top), min(own.header.height, top + size), max(0, left), min(own.header.width, left + size)
                        if r0 >= r1 or c0 >= c1:
                            continue
                        whole = np.full((len(picked), size, size), np.nan)
                        x = own.window(r0, r1, c0, c1, picked).astype(np.float64)
                        for k, b in enumerate(picked):
                            if (none := own.header.nodata[b]) is not None:
                                x[k][x[k] == none] = np.nan
                        whole[:, r0 - top : r1 - top, c0 - left : c1 - left] = x
                    except (OSError, ValueError, IndexError, KeyError, geotiff.struct.error, geotiff.zlib.error):
                        if errors != "skip":
                            raise
                        continue
                    arrays = geotiff._tile_arrays(whole, size, (None,) * len(picked))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([u["image_id"]]), pa.array([u["tile_row"]], pa.int32()), pa.array([u["tile_col"]], pa.int32()), *arrays],
                        names=["image_id", "tile_row", "tile_col", *chosen]
                    )

        schema = ", ".join(["image_id string, tile_row int, tile_col int", *(f"`{b}` array<double>" for b in chosen)])
        return geotiff._in_order(units).mapInArrow(run, schema)

    def fetch(needed: DataFrame, chosen: list[str]) -> DataFrame:
        return tiles(needed.join(placed, "image_id").select("path", "tile_row", "tile_col", "image_id", "dr", "dc"), chosen)

    first = lambda c: F.floor(F.col(c) / size).cast("int")
    last = lambda c, n: F.floor((F.col(c) + F.col(n) - 1) / size).cast("int")
    every = placed.select("path", "image_id", "dr", "dc", F.explode(F.sequence(first("dr"), last("dr", "height"))).alias("tile_row"), last("dc", "width").alias("_c"))
    every = every.withColumn("tile_col", F.explode(F.sequence(first("dc"), F.col("_c")))).drop("_c")
    nodata = found.agg(F.min("nodata").alias("n")).first()["n"]
    return Raster(
        header, tiles(every, bands), size, found.select("image_id", "time_start", "time_end", "utm_zone", "west", "south", "east", "north"),
        {"path": folder, "nodata": (nodata,), "dtype": header.dtype}, fetch
    )


def copy_of(spark: SparkSession, spec: dict[str, Any]) -> str:
    """Where a remote asset's copy lies: the entry's own ``mirror``, or its path below the mirror's root."""
    if own := spec.get("mirror"):
        return own
    root = spark.conf.get(ROOT, None)
    if not root:
        raise ValueError(f"{spec.get('path')} is a remote asset: name a folder of copies in the setting {ROOT}, or give the entry a mirror")
    return f"{root.rstrip('/')}/{spec['path']}"


def open_entry(spark: SparkSession, spec: dict[str, Any]) -> Raster:
    """The raster of a catalog entry: one file, or a collection where its folder has several."""
    folder = copy_of(spark, spec) if spec.get("data_source") == "earth_engine" else spec["path"]
    errors = spec.get("on_error", "raise")
    try:
        found = files_below(folder)
    except pa.ArrowInvalid:  # a store that only Spark knows
        return geotiff.read(spark, folder, errors=errors)
    except FileNotFoundError:
        found = files_below(folder + ".tif")
    if not found:
        raise FileNotFoundError(f"no raster file below {folder}")
    raster = open_collection(spark, folder, errors=errors) if len(found) > 1 else geotiff.read(spark, found[0][1], errors=errors)
    now = list(raster.header.bands)
    names = now if len(found) > 1 else geotiff_names(spark, found[0][1])
    wanted = spec.get("bands")
    if isinstance(wanted, list) and len(wanted) == len(now) and all(isinstance(b, str) for b in wanted) and not set(wanted) & set(names):
        names = wanted  # a copy without names has the entry's, in order
    return renamed(raster, names)


def renamed(raster: Raster, names: list[str]) -> Raster:
    """``raster`` with other names of its bands."""
    old = list(raster.header.bands)
    if names == old:
        return raster
    to, back, fetch = dict(zip(old, names, strict=True)), dict(zip(names, old, strict=True)), raster.fetch

    def fetched(needed: DataFrame, chosen: list[str]) -> DataFrame:
        return fetch(needed, [back[b] for b in chosen]).withColumnsRenamed(to)

    return replace(
        raster, header=replace(raster.header, bands=tuple(names)), tiles=raster.tiles.withColumnsRenamed(to), fetch=fetched if fetch else None
    )


def geotiff_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a file's bands, as it describes them; read by a task."""
    register(spark)
    return list(spark.read.format(ImageSource.name()).load(path).first()["bands"])


for _kind in ("local", "geotiff", "earth_engine"):
    register_source(_kind, open_entry)
