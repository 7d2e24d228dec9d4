"""Operators from raster to raster: mosaic, slope, aspect, and resampled tiles around points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions.grid import Header
from terrasample.sources.raster import Raster


#: A valid neighbour of less weight (a rounding error of the place) doesn't fill a gap.
MIN_WEIGHT = 1e-5


def mosaic(pixels: DataFrame, images: DataFrame, bands: list[str]) -> DataFrame:
    """Of every place (r, c) the most recent value that isn't null, per band; ``pixels`` has image_id."""
    dated = pixels.join(images.select("image_id", "time_start"), "image_id")
    latest = lambda b: F.max_by(b, F.when(F.col(b).isNotNull(), F.struct("time_start", "image_id"))).alias(b)
    return dated.groupBy("r", "c").agg(*(latest(b) for b in bands))


def gradients(pixels: DataFrame, band: str) -> DataFrame:
    """``pixels`` with dx and dy, the differences of the neighbours left/right and above/below (null at edges and gaps).

    Each value goes to its four neighbours' places and one aggregation by place
    brings them together, so rows of any length are spread over all tasks.
    """
    around = F.array(
        *(
            F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit(name).alias("from"), F.col(band).alias("v")) for dr,
            dc, name in ((0, 0, "own"), (0, 1, "left"), (0, -1, "right"), (1, 0, "above"), (-1, 0, "below"))
        )
    )
    spread = pixels.select(F.inline(around))
    got = lambda name: F.max(F.when(F.col("from") == name, F.col("v")))
    joined = spread.groupBy("r", "c").agg(
        F.count_if(F.col("from") == "own").alias("here"), got("own").alias(band),
        (got("right") - got("left")).alias("dx"), (got("below") - got("above")).alias("dy")
    )
    return joined.where("here > 0").drop("here")


def _slope(dx: Column, dy: Column, header: Header) -> Column:
    return F.degrees(F.atan(F.sqrt((dx / (2 * abs(header.a))) ** 2 + (dy / (2 * abs(header.e))) ** 2)))


def _aspect(dx: Column, dy: Column, header: Header) -> Column:
    turn = F.degrees(F.atan2(-dx / (2 * header.a), -dy / (2 * header.e)))
    return F.when((dx != 0) | (dy != 0), F.when(turn < 0, turn + 360).otherwise(turn))


def derived_tiles(raster: Raster, band: str, name: str) -> DataFrame:
    """The tiles of slope or aspect of a band: the raster's keys and an array of that name.

    A tile gets the four edges that touch it from its neighbours, one aggregation
    by tile; within it the neighbours are places of the array.  So little more
    than the tiles themselves is shuffled, and no pixel is a row.
    """
    size, h, v = raster.size, raster.header, F.col(band)
    line = F.sequence(F.lit(0), F.lit(size - 1))
    row, col = lambda i: F.slice(v, i * size + 1, size), lambda j: F.transform(line, lambda i: F.get(v, i * size + j))
    # the part of this tile that another one needs, and that one's place: my last row lies above the tile below
    parts = ((0, 0, "own", v), (1, 0, "above", row(size - 1)), (-1, 0, "below", row(0)), (0, 1, "left", col(size - 1)), (0, -1, "right", col(0)))
    others = [k for k in raster.keys if k == "image_id"]
    sent = raster.tiles.select(
        *others,
        F.inline(
            F.array(
                *(
                    F.struct(
                        (F.col("tile_row") + dr).alias("tile_row"), (F.col("tile_col") + dc).alias("tile_col"),
                        F.lit(kind).alias("kind"), part.alias("part")
                    ) for dr,
                    dc, kind, part in parts
                )
            )
        )
    )
    got = sent.groupBy(*raster.keys).agg(
        *(F.first(F.when(F.col("kind") == kind, F.col("part")), True).alias(kind) for *_, kind, _ in parts)
    ).where("own is not null")
    place = lambda kind, o: F.get(F.col(kind), o)

    def one(o: Column) -> Column:
        r, c = F.floor(o / size).cast("int"), (o % size).cast("int")
        left, right = F.when(c == 0, place("left", r)).otherwise(place("own", o - 1)), F.when(c == size - 1, place("right", r)).otherwise(place("own", o + 1))
        above, below = F.when(r == 0, place("above", c)).otherwise(place("own", o - size)), F.when(r == size - 1, place("below", c)).otherwise(place("own", o + size))
        return F.when(place("own", o).isNotNull(), {"slope": _slope, "aspect": _aspect}[name](right - left, below - above, h))

    return got.select(*raster.keys, F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), one).alias(name))


def slope(pixels: DataFrame, band: str, header: Header) -> DataFrame:
    """r, c and slope in degrees from the four neighbours; null at edges."""
    return gradients(pixels, band).select("r", "c", _slope(F.col("dx"), F.col("dy"), header).alias("slope"))


def aspect(pixels: DataFrame, band: str, header: Header) -> DataFrame:
    """r, c and aspect, the direction of descent in degrees clockwise from north; null at edges and on flat ground."""
    return gradients(pixels, band).select("r", "c", _aspect(F.col("dx"), F.col("dy"), header).alias("aspect"))


def sample_grid(points: DataFrame, n: int, step: float) -> DataFrame:
    """_row, i, j and the place gx, gy of an n x n grid around each point (x, y), cell centres, from the upper left."""
    half = n // 2
    ox, oy = F.rint(F.col("x") / step) * step - half * step, F.rint(F.col("y") / step) * step + half * step
    cells = points.select(
        "_row", ox.alias("ox"), oy.alias("oy"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    ).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.select(
        "_row", "i", "j", (F.col("ox") + (F.col("j") + 0.5) * step).alias("gx"),
        (F.col("oy") - (F.col("i") + 0.5) * step).alias("gy")
    )


def resample(grid: DataFrame, pixels: DataFrame, band: str, header: Header, method: str = "bilinear") -> DataFrame:
    """_row, i, j, value: the raster at the grid's places; bilinear weights only valid neighbours."""
    return resample_bands(grid, pixels, [band], header, method).withColumnRenamed(band, "value")


def resample_bands(
    grid: DataFrame, pixels: DataFrame, bands: list[str], header: Header, method: str = "bilinear",
    keys: tuple[str, ...] = ()
) -> DataFrame:
    """_row, i, j and the bands at the grid's places; each band's bilinear weights are those of its own valid neighbours.

    The neighbours are an equi-join on their row and column, and on ``keys``
    (the image of a collection), which both tables have.
    """
    row, col = header.index(F.col("gx"), F.col("gy"))
    on = [*keys, "r", "c"]
    values = pixels.select(*on, *(F.col(b).alias(f"v_{b}") for b in bands))
    if method == "nearest":
        near = grid.withColumns({"r": F.floor(row).cast("int"), "c": F.floor(col).cast("int")})
        return near.join(values, on, "left").select("_row", "i", "j", *(F.col(f"v_{b}").alias(b) for b in bands))
    if method != "bilinear":
        raise ValueError(f"Unknown resampling {method!r}: use bilinear or nearest")
    fr, fc = row - 0.5, col - 0.5
    r0, c0 = F.floor(fr), F.floor(fc)
    wr, wc = fr - r0, fc - c0
    corner = lambda dr, dc: F.struct(
        (r0 + dr).cast("int").alias("r"), (c0 + dc).cast("int").alias("c"),
        ((wr if dr else 1 - wr) * (wc if dc else 1 - wc)).alias("w")
    )
    four = grid.select("_row", *keys, "i", "j", F.inline(F.array(*(corner(dr, dc) for dr in (0, 1) for dc in (0, 1)))))
    joined = four.join(values, on, "left")

    def weighed(b: str):
        v = F.col(f"v_{b}")
        total = F.sum(F.when(v.isNotNull(), F.col("w")))
        return F.when(total > MIN_WEIGHT, F.sum(F.col("w") * v) / total).alias(b)

    return joined.groupBy("_row", "i", "j").agg(*(weighed(b) for b in bands))


def neighbour_tiles(grid: DataFrame, header: Header, size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The distinct tiles (keys, tile_row, tile_col) of the pixels that resampling at the grid's places reads."""
    row, col = header.index(F.col("gx"), F.col("gy"))
    tile = lambda c, d: F.floor((F.floor(c - 0.5) + d) / size).cast("int")
    return grid.select(
        *keys,
        F.inline(F.array(*(F.struct(tile(row, dr).alias("tile_row"), tile(col, dc).alias("tile_col")) for dr in (0, 1) for dc in (0, 1))))
    ).distinct()


def tiles(samples: DataFrame, n: int) -> DataFrame:
    """_row and the row-major array of an n x n tile's values; a tile's cells bound its group."""
    cell = F.struct((F.col("i") * n + F.col("j")).alias("o"), F.col("value").alias("v"))
    return samples.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda p: p["v"]).alias("values"))
