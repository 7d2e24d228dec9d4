"""Rasters written once as a Parquet table of tiles, laid out for reading few of them.

The tiles are partitioned by UTM zone and period (the year or month in which an image begins),
and within a partition they follow a space-filling curve, so that neighbouring tiles stand in the
same row groups.  Reading takes what the wanted windows tell, all of it as predicates of the scan:
their images' zones and periods choose the partitions, the span of their tiles' rows and columns the row
groups (by the statistics in the files), and an equi-join by image and tile the rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.functions.grid import Header
from terrasample.sources.raster import Raster, register_source

#: Formats of a period: what an image's start is cut to.
PERIODS = {"year": "yyyy", "month": "yyyy-MM"}
#: The zone and period of tiles that have none.
NONE = "none"
#: Literal partitions in a scan's predicate, at most; with more, the join alone chooses the rows.
LISTED = 5000


def curve(row: Column, col: Column) -> Column:
    """The place of a tile on the Z-order curve: the bits of its row and column in turn (31 bits each)."""
    def spread(x: Column) -> Column:
        x = x.cast("bigint")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(spread(row), 1).bitwiseOR(spread(col))


def _placed(images: DataFrame, period: str) -> DataFrame:
    """``images`` with the zone and period of their partition."""
    zone = F.col("utm_zone") if "utm_zone" in images.columns else F.lit(None).cast("string")
    start = F.date_format(F.col("time_start"), PERIODS[period])
    return images.withColumns({"zone": F.coalesce(zone, F.lit(NONE)), "period": F.coalesce(start, F.lit(NONE))})


def write_store(raster: Raster, folder: str, *, period: str = "year", file_bytes: int = 128 << 20, group_bytes: int = 8 << 20) -> str:
    """Write a raster's tiles, images and header below ``folder``, replacing what is there; the folder.

    Tiles without any value are left out (a missing tile is one without values).  Each file has about ``file_bytes`` of numbers,
    in row groups of ``group_bytes``.  A task writes a range of the curve, so an image of any size is spread over tasks.
    """
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}, not {period!r}")
    spark, h = raster.tiles.sparkSession, raster.header
    bands = list(h.bands)
    some = F.exists(F.array(*(F.exists(F.col(f"`{b}`"), lambda v: v.isNotNull()) for b in bands)), lambda x: x)
    tiles = raster.tiles.where(some).withColumn("z", curve(F.col("tile_row"), F.col("tile_col")))
    count = -(-h.height // raster.size) * -(-h.width // raster.size)
    if raster.images is not None:
        images = _placed(raster.images, period)
        images.coalesce(1).write.mode("overwrite").parquet(f"{folder}/images")
        images = spark.read.schema(images.schema).parquet(f"{folder}/images")
        count *= images.count()
        tiles = tiles.join(images.select("image_id", "zone", "period"), "image_id")
    else:
        tiles = tiles.withColumns({"zone": F.lit(NONE), "period": F.lit(NONE)})
    files = max(1, -(-count * raster.size**2 * 8 * len(bands) // file_bytes))
    ordered = tiles.repartitionByRange(int(files), "zone", "period", "z").sortWithinPartitions("zone", "period", "z", *(k for k in raster.keys if k == "image_id"))
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("zone", "period").parquet(f"{folder}/tiles")
    about = {"header": asdict(h), "size": raster.size, "meta": {k: v for k, v in raster.meta.items() if k != "spec"}, "images": raster.images is not None, "keys": tiles.schema.json()}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")
    return folder


def open_store(spark: SparkSession, folder: str) -> Raster:
    """The raster that :func:`write_store` wrote; its ``fetch`` reads the partitions and row groups of the wanted tiles only."""
    from pyspark.sql.types import StructType

    about = json.loads(spark.read.text(f"{folder}/header").first()[0])
    own = about["header"]
    header = Header(**{**own, "bands": tuple(own["bands"]), "nodata": tuple(own["nodata"])})
    schema = StructType.fromJson(json.loads(about["keys"]))
    tiles = spark.read.schema(schema).parquet(f"{folder}/tiles")
    placed = spark.read.parquet(f"{folder}/images") if about["images"] else None
    keys = [*(["image_id"] if about["images"] else []), "tile_row", "tile_col"]

    def fetch(needed: DataFrame, bands: list[str]) -> DataFrame:
        wanted = needed if placed is None else needed.join(placed.select("image_id", "zone", "period"), "image_id")
        span = wanted.agg(*(f(c).alias(f"{c}_{n}") for c in ("tile_row", "tile_col") for n, f in (("lo", F.min), ("hi", F.max)))).first()
        found = tiles
        if placed is not None:
            parts = wanted.select("zone", "period").distinct().limit(LISTED + 1).collect()
            if len(parts) <= LISTED:
                found = found.where(F.col("zone").isin(sorted({p["zone"] for p in parts})) & F.col("period").isin(sorted({p["period"] for p in parts})))
        if span["tile_row_lo"] is None:
            return found.select(*keys, *bands).where("false")
        for c in ("tile_row", "tile_col"):
            found = found.where(F.col(c).between(span[f"{c}_lo"], span[f"{c}_hi"]))
        on = keys if placed is None else [*keys, "zone", "period"]
        return found.select(*on, *(f"`{b}`" for b in bands)).join(wanted.select(*on).distinct(), on, "left_semi").select(*keys, *(f"`{b}`" for b in bands))

    meta = about["meta"]
    meta = {**meta, "nodata": tuple(meta["nodata"])} if isinstance(meta.get("nodata"), list) else meta
    images = None if placed is None else placed.drop("zone", "period")
    return Raster(header, tiles.select(*keys, *(f"`{b}`" for b in header.bands)), about["size"], images, meta, fetch)


def _source(spark: SparkSession, spec: dict[str, Any]) -> Raster:
    return open_store(spark, spec["path"])


register_source("store", _source)
