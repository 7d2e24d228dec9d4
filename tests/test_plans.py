"""CRS, dates, as-of rules, terrain, GeoTIFF, configuration, catalog, extract and streams."""

import datetime
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import terrasample
from terrasample.functions import crs, dates
from terrasample.functions.grid import Header, snap, snap_even
from terrasample.operators import asof, terrain
from terrasample.plans import catalog, config
from terrasample.sources import geotiff, points as point_source
from terrasample.sources.raster import Raster, pixels_of_tiles, tiles_of_pixels
from terrasample.streaming.enrich import enrich_stream


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()


def test_utm_of_a_known_place_and_back(spark):
    lat, lon = F.lit(43.642567), F.lit(-79.387139)
    e, n = crs.utm_forward(lat, lon)
    r = one(spark, e, n, crs.utm_epsg(lat, lon), *crs.utm_inverse(e, n, crs.utm_epsg(lat, lon)))
    assert (round(r[0]), round(r[1]), r[2]) == (630084, 4833439, 32617)
    assert r[3] == pytest.approx(43.642567, abs=1e-9) and r[4] == pytest.approx(-79.387139, abs=1e-9)
    south = one(spark, *crs.utm_inverse(*crs.utm_forward(F.lit(-33.9), F.lit(18.4)), F.lit(32734)))
    assert south[0] == pytest.approx(-33.9, abs=1e-9)


def test_zones_and_codes(spark):
    assert one(spark, crs.utm_zone(F.lit(180.0)), crs.utm_zone_label(F.lit(-1.0), F.lit(18.0)))[:] == (60, "34S")
    assert crs.normalize(" wgs84 ") == crs.normalize("") == crs.normalize("4326") == "EPSG:4326"
    with pytest.raises(ValueError):
        crs.code_of("EPSG:2154")
    assert one(spark, snap(F.lit(45.0), 30), snap_even(F.lit(45.0), 30))[:] == (60, 60)


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2021-06-15", "2021-06-15"), ("2021-06", "2021-06-01"), ("2021", "2021-01-01"),
        ("2020-01-02/2020-03-01", "2020-01-02"), ("2021-06-15T10:00:00Z", "2021-06-15"), ("20210615", "2021-06-15"),
        ("June 2021", "2021-06-01"), ("15 Jun 2021", "2021-06-15"), (" ", None), ("not a date", None), (None, None)
    ]
)
def test_dates(spark, text, day):
    assert one(spark, dates.day_text(dates.parse(F.lit(text).cast("string"))))[0] == day


def test_checked_points(spark):
    df = spark.createDataFrame(
        [(1, 60.0, 18.0, "2021"), (2, 60.0, 18.0, None), (3, 60.0, 18.0, "2020-01-01T01/2021")],
        "id long, lat double, lon double, date string"
    )
    c = point_source.check(df)
    assert c.points.count() == 2 and c.has_dates and len(c.warnings) == 4
    with pytest.raises(ValueError, match="can't be read"):
        point_source.check(df.withColumn("date", F.lit("nonsense")))
    for bad in (91.0, float("nan")):
        with pytest.raises(ValueError, match="out of range"):
            point_source.check(df.withColumn("lat", F.lit(bad)))
    moved = point_source.check(
        spark.createDataFrame([(1, 6985000.0, 350000.0)], "id long, lat double, lon double"), input_crs="EPSG:32634"
    ).points.first()
    assert moved["lat"] == pytest.approx(62.96, abs=0.01) and moved["lat_original"] == 6985000.0


@pytest.fixture(scope="module")
def images(spark):
    d = lambda m: datetime.date(2020, m, 1)
    return spark.createDataFrame([("a", d(1), None), ("b", d(3), None), ("c", d(5), None)], "image_id string, time_start date, time_end date")


@pytest.mark.parametrize(
    ("policy", "day", "expected"),
    [
        (
            "nearest", "2019-12-01", ("a", True, "clamped_to_nearest")
        ), (
            "nearest", "2020-01-01", ("a", False, "nearest_to_sample")
        ), (
            "nearest", "2020-01-31", ("b", False, "nearest_to_sample")
        ), ("nearest", "2020-05-01", ("c", False, "nearest_to_sample")), ("nearest", "2021-01-01", ("c", True, "clamped_to_nearest")),
        ("contains", "2019-12-01", ("a", True, "clamped_to_nearest")), ("contains", "2020-01-01", ("a", True, "clamped_to_nearest")), (
            "contains", "2020-02-29", ("a", False, "contains_sample_date")
        ), ("contains", "2020-05-01", ("c", True, "clamped_to_nearest")), ("nearest", None, ("c", False, "most_recent_no_date")),
    ],
)
def test_date_policies(spark, images, policy, day, expected):
    r = asof.match_images(spark.range(1).select(F.lit(day).cast("date").alias("date")), images, policy).first()
    assert (r["image_id"], r["date_clamped"], r["date_source"]) == expected
    if policy == "contains" and day == "2020-02-29":
        assert str(r["image_time_end"]) == "2020-03-01"


def test_collections_that_match_nothing_keep_the_rows(spark, images):
    rows = spark.createDataFrame([(1, datetime.date(2020, 2, 1)), (2, None)], "k int, date date")
    for im in (images.where("false"), images.withColumn("time_start", F.lit(None).cast("date"))):
        got = asof.match_images(rows, im).orderBy("k").collect()
        assert [(r["k"], r["image_id"], r["date_clamped"], r["date_source"]) for r in got] == [(1, None, False, None), (2, None, False, None)]
    assert asof.undated(images.where("false")) and not asof.undated(images)


def test_images_are_matched_within_their_zone(spark):
    d = datetime.date
    im = spark.createDataFrame(
        [("a", d(2020, 1, 1), None, "33N"), ("b", d(2020, 3, 1), None, "34N")],
        "image_id string, time_start date, time_end date, utm_zone string"
    )
    rows = spark.createDataFrame(
        [(1, d(2020, 3, 1), "33N"), (2, d(2020, 1, 1), "34N"), (3, d(2020, 1, 1), "35N")],
        "k int, date date, utm_zone string"
    )
    assert [r["image_id"] for r in asof.match_images(rows, im, keys=("utm_zone",)).orderBy("k").collect()] == ["a", "b", None]


def test_images_are_matched_where_they_cover_the_point(spark):
    d = datetime.date
    im = spark.createDataFrame(
        [
            ("a", d(2020, 1, 1), None, 10.5, 50.2, 12.5, 51.7), ("b", d(2020, 3, 1), None, 10.5, 50.2, 12.5, 51.7),
            ("c", d(2020, 2, 1), None, 12.0, 50.0, 14.0, 52.0)
        ],
        "image_id string, time_start date, time_end date, west double, south double, east double, north double",
    )
    rows = spark.createDataFrame(
        [
            (1, 51.0, 11.0, d(2020, 2, 2)), (2, 51.0, 12.2, d(2020, 2, 2)), (3, 51.0, 13.0, None),
            (4, 0.0, 0.0, d(2020, 1, 1)), (5, 51.0, 12.2, None), (6, 51.0, 12.2, d(2019, 1, 1))
        ],
        "_row int, lat double, lon double, date date"
    )
    for policy, want in (("nearest", ["b", "c", "c", None, "b", "a"]), ("contains", ["a", "c", "c", None, "b", "a"])):
        assert [r["image_id"] for r in asof.match_covering(rows, im, policy).orderBy("_row").collect()] == want


def plane(n=60, crs_code=4326, size=16, **more):
    """A raster in degrees whose value tells the pixel."""
    return Header(n, n, 0.01, -0.01, 18.0, 63.0, crs=crs_code, **more), size


def plane_raster(spark, n=60):
    h, size = plane(n)
    px = spark.range(n * n).select(
        (F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"),
        F.col("id").cast("double").alias("b1")
    )
    return Raster(h, tiles_of_pixels(px, h, size), size)


@pytest.mark.parametrize("kind", ["joined", "repartitioned", "wide", "repeated"])
def test_extract_of_shuffled_points(spark, tmp_path, kind):
    """Each point gets its own pixel, whatever lies below the points."""
    n, r = 3000, plane_raster(spark)
    k = F.col("id")
    df = spark.range(n).select(
        k.alias("occurrenceID"), (63.0 - 0.005 - 0.01 * ((k * 7) % 60)).alias("decimalLatitude"),
        (18.005 + 0.01 * ((k * 13) % 60)).alias("decimalLongitude")
    )
    if kind == "joined":
        df = df.hint("merge").join(spark.range(n).select(k.alias("occurrenceID"), (k % 5).alias("g")), "occurrenceID")
    elif kind == "repartitioned":
        df = df.repartition(7, "occurrenceID").withColumn("g", F.lit(1))
    elif kind == "wide":
        df = df.select("*", *(F.lit(c).alias(f"x{c}") for c in range(120))).groupBy(*df.columns).agg(
            *(F.max(f"x{c}").alias(f"x{c}") for c in range(120))
        )
    else:
        df = df.unionByName(df)
    out = terrasample.extract(
        df,
        {
            "datasets": ["p"],
            "settings": {"output_type": "tabular", "statistics": ["point", "max"], "window_size_m": 200, "output_file_format": "dataframe"}
        },
        rasters={"p": r}, quiet=True, write_metadata=False, output_dir=str(tmp_path)
    )
    rows = out.collect()
    assert len(rows) == n * (2 if kind == "repeated" else 1)
    assert all(x["p_point"] == ((x["occurrenceID"] * 7) % 60) * 60 + (x["occurrenceID"] * 13) % 60 for x in rows)
    if kind == "repeated":
        assert all(x["p_max_200m"] == x["p_point"] for x in rows)


def test_extract_passes_columns_named_as_its_own(spark, tmp_path):
    """A raster without a system lies in the coordinates' plane, whatever other columns are called."""
    px = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.col("id").cast("double").alias("b1"))
    h = Header(20, 20, 1.0, 1.0)
    df = spark.createDataFrame([("p", 3.5, 7.5, 0.0, 19.0, "u")], "occurrenceID string, decimalLatitude double, decimalLongitude double, x double, y double, id string")
    run = {"datasets": ["r"], "settings": {"output_type": "tabular", "statistics": ["point"], "output_file_format": "dataframe"}}
    out = terrasample.extract(df, run, rasters={"r": Raster(h, tiles_of_pixels(px, h, 8), 8)}, quiet=True, write_metadata=False, output_dir=str(tmp_path)).first()
    assert out["r_point"] == 67.0 and out["x"] == 0.0 and out["y"] == 19.0


def test_extract_of_an_undated_collection_takes_the_last_valid_value(spark, tmp_path):
    h = Header(20, 20, 0.01, -0.01, 18.0, 63.0, crs=4326)
    px = spark.range(2 * 400).select(
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") / 400).cast("int") + 1).alias("image_id"),
        ((F.col("id") % 400) / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c")
    )
    px = px.withColumn("b1", F.when((F.col("image_id") == "a") | (F.col("c") < 10), F.ascii("image_id").cast("double")))
    im = spark.createDataFrame([("a", None, None), ("b", None, None)], "image_id string, time_start date, time_end date")
    r = Raster(h, tiles_of_pixels(px, h, 16, ("image_id",)), 16, im)
    df = spark.createDataFrame([("p", 62.9, 18.05), ("q", 62.9, 18.15)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    out = terrasample.extract(
        df,
        {"datasets": ["ts"], "settings": {"output_type": "tabular", "statistics": ["point"], "output_file_format": "dataframe"}},
        rasters={"ts": r}, quiet=True, write_metadata=False, output_dir=str(tmp_path)
    )
    assert [x["ts_point"] for x in out.collect()] == [float(ord("b")), float(ord("a"))]


def test_remote_copies_without_a_projection_are_refused(spark):
    from terrasample.plans.extract import native_scale

    h = Header(10, 10, 1.0, -1.0, crs=4326)
    r = Raster(h, spark.createDataFrame([], "tile_row int, tile_col int, b1 array<double>"), 16)
    with pytest.raises(ValueError, match="native_scale_m"):
        native_scale({"data_source": "earth_engine", "path": "x"}, r)
    assert native_scale({"data_source": "earth_engine", "path": "x", "dataset_spec": {"native_scale_m": 30}}, r) == 30
    assert native_scale({"data_source": "local", "path": "x"}, r) > 111_000


@pytest.mark.parametrize(
    "spec",
    [
        {"data_source": "local", "supported_derived_bands": ["slope"]},
        {"data_source": "earth_engine", "derived_bands": "slope"},
        {"data_source": "earth_engine", "supported_derived_bands": ["aspect"], "derived_bands": ["slope"]}
    ]
)
def test_derived_bands_must_be_allowed(spec):
    with pytest.raises(ValueError):
        config.parse(GOOD | {"datasets": [{"dem": ["slope"]}] if spec["data_source"] == "local" else ["dem"]}, 0, {"dem": spec}, catalog.DEFAULTS)


def test_terrain_of_a_plane(spark):
    px = spark.range(100).select(
        (F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c")
    ).withColumn("v", F.col("c") * 10.0)
    h = Header(10, 10, 10.0, -10.0)
    s = terrain.slope(px, "v", h).where("r = 5 and c = 5").first()["slope"]
    assert s == pytest.approx(45.0)
    assert terrain.aspect(px, "v", h).where("r = 5 and c = 5").first()["aspect"] == pytest.approx(270.0)  # rises to the east, so it falls to the west
    assert terrain.slope(px, "v", h).where("r = 0").where("slope is not null").count() == 0


@pytest.mark.parametrize("name", ["slope", "aspect"])
def test_derived_tiles_equal_those_by_pixels(spark, name):
    n = 23
    px = spark.range(n * n).where("id % 37 <> 5").select(
        (F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"),
        F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("b1")
    )
    h = Header(n, n, 10.0, -10.0)
    r = Raster(h, tiles_of_pixels(px, h, 8), 8)
    tiled = Raster(Header(n, n, 10.0, -10.0, bands=(name,)), terrain.derived_tiles(r, "b1", name), 8)
    key = lambda df: {(x["r"], x["c"]): x[name] for x in df.collect() if x[name] is not None}
    want, got = key(getattr(terrain, name)(px, "b1", h)), key(pixels_of_tiles(tiled))
    assert want.keys() == got.keys() and len(want) > 300 and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_resampling(spark):
    px = spark.range(100).select(
        (F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c")
    ).withColumn("v", F.col("c") * 10.0 + 5)
    p = spark.createDataFrame([(0, 50.0, 50.0)], "_row long, x double, y double")
    grid = terrain.sample_grid(p, 4, 5.0)
    got = terrain.resample(grid, px, "v", Header(10, 10, 10.0, 10.0)).join(grid, ["_row", "i", "j"]).collect()
    assert len(got) == 16 and all(r["value"] == pytest.approx(r["gx"]) for r in got)
    near = terrain.resample(grid, px, "v", Header(10, 10, 10.0, 10.0), "nearest").where("j = 0").first()
    assert near["value"] == 45.0


@pytest.mark.parametrize("kind", ["uint8", "int16", "float32", "float64"])
def test_geotiff_round_trip(spark, tmp_path, kind):
    v = np.random.default_rng(3).integers(0, 100, (3, 70, 41)).astype(kind)
    h = Header(41, 70, 10.0, -10.0, 347020.0, 6988980.0, crs=32634, bands=("b1", "b2", "b3"), nodata=(7.0,) * 3, dtype=kind)
    data = geotiff.encode(v, h)
    assert (geotiff.decode(data) == v).all()
    back = geotiff.header_of(data)
    assert (
        back.width, back.height, back.a, back.e, back.c, back.f, back.crs, back.nodata[0], back.dtype
    ) == (41, 70, 10.0, -10.0, 347020.0, 6988980.0, 32634, 7.0, kind)
    (tmp_path / "x.tif").write_bytes(data)
    r = geotiff.read(spark, str(tmp_path / "x.tif"), size=32)
    n = r.tiles.select(F.explode("b2").alias("v")).where("v is not null").count()
    assert n == (v[1] != 7).sum()


def blocked(v, block, big=False, tiled=True, predictor=1):
    """A small TIFF file in blocks or strips, written by the specification: single bands after each other."""
    n, (h, w) = len(v), v[0].shape
    import struct
    import zlib

    rows = [(b, i, j) for b in range(n) for i in range(0, h, block) for j in (range(0, w, block) if tiled else [0])]
    parts = []
    for b, i, j in rows:
        x = np.zeros((block, block), v[b].dtype) if tiled else v[b][i : i + block].copy()
        if tiled:
            cut = v[b][i : i + block, j : j + block]
            x[: cut.shape[0], : cut.shape[1]] = cut
        if predictor == 2:
            x[:, 1:] = np.diff(x, axis=1)
        parts.append(zlib.compress(np.ascontiguousarray(x).tobytes()))
    kinds = [{"u": 1, "i": 2, "f": 3}[x.dtype.kind] for x in v]
    word, code = ("<Q", 16) if big else ("<I", 4)
    first = 16 if big else 8
    places = [first + sum(map(len, parts[:k])) for k in range(len(parts))]
    tags = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [x.itemsize * 8 for x in v]), (259, 3, [8]), (277, 3, [n]),
        (284, 3, [2]), (317, 3, [predictor]), (339, 3, kinds), (42113, 2, b"7\0")
    ]
    tags += [
        (322, 4, [block]), (323, 4, [block]), (324, code, places), (325, 4, [len(p) for p in parts])
    ] if tiled else [(278, 4, [block]), (273, code, places), (279, 4, [len(p) for p in parts])]
    body, at = b"".join(parts), first + sum(map(len, parts))
    entries, room = b"", 8 if big else 4
    for tag, t, values in sorted(tags, key=lambda x: x[0]):
        raw = values if t == 2 else struct.pack("<" + {3: "H", 4: "I", 16: "Q"}[t] * len(values), *values)
        entries += struct.pack("<HH", tag, t) + struct.pack(word, len(values))
        if len(raw) <= room:
            entries += raw.ljust(room, b"\0")
        else:
            entries += struct.pack(word, at)
            body, at = body + raw, at + len(raw)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    return head + body + struct.pack("<Q" if big else "<H", len(tags)) + entries + b"\0" * 8


@pytest.mark.parametrize("tiled", [True, False])
@pytest.mark.parametrize("big", [True, False])
def test_blocks_of_big_and_small_files(spark, tmp_path, big, tiled):
    v = np.random.default_rng(9).integers(0, 60_000, (2, 75, 90)).astype("uint16")
    data = blocked(v, 16, big, tiled, predictor=2)
    assert (geotiff.decode(data) == v).all()
    (tmp_path / "x.tif").write_bytes(data)
    read = []
    blocks = geotiff.Blocks(lambda at, size: (read.append(at), data[at : at + size])[1])
    read.clear()
    assert (blocks.window(20, 30, 40, 47, [1]) == v[1:, 20:30, 40:47]).all() and len(read) == (1 if tiled else 1)
    r = geotiff.read(spark, str(tmp_path / "x.tif"), size=32)
    assert r.tiles.count() == 9 and r.header.bands == ("b1", "b2") and r.meta["nodata"] == (7.0, 7.0)
    some = r.tiles_for(spark.createDataFrame([(1, 2), (1, 2), (9, 9), (None, None)], "tile_row int, tile_col int"), ["b2"]).collect()
    part = np.array([x if x is not None else np.nan for x in some[0]["b2"]]).reshape(32, 32)
    assert len(some) == 1 and (
        some[0]["tile_row"], some[0]["tile_col"]
    ) == (1, 2) and (part[:, :26] == v[1, 32:64, 64:]).all() and np.isnan(part[:, 26:]).all()


def test_bands_of_different_types_get_a_common_one(spark, tmp_path):
    r = np.random.default_rng(2)
    v = [r.integers(0, 200, (20, 30)).astype("uint8"), r.normal(size=(20, 30)).astype("float32"), r.integers(0, 60_000, (20, 30)).astype("uint16")]
    data = blocked(v, 16)
    assert geotiff.header_of(data).dtype == "float32" and all((a == b).all() for a, b in zip(geotiff.decode(data), v, strict=True))


def test_files_that_cannot_be_read(spark, tmp_path):
    v = np.arange(2 * 40 * 40).reshape(2, 40, 40).astype("float32")
    for k in "abc":
        (tmp_path / f"{k}.tif").write_bytes(geotiff.encode(v, Header(40, 40, 10.0, -10.0, bands=("b1", "b2"), nodata=(None, None), dtype="float32")))
    (tmp_path / "b.tif").write_bytes((tmp_path / "b.tif").read_bytes()[:300])
    assert {r["image_id"] for r in geotiff.read(spark, str(tmp_path), size=32, image_id="name", errors="skip").tiles.collect()} == {"a.tif", "c.tif"}
    with pytest.raises(Exception):
        geotiff.read(spark, str(tmp_path), size=32, image_id="name").tiles.collect()
    with pytest.raises(FileNotFoundError):
        geotiff.read(spark, f"{tmp_path}/*.none")


def test_requests_become_the_fewest_runs(spark, dem, tmp_path):
    from terrasample.plans.requests import Requests, metres, reducers_for

    assert metres("100; 500,20 ") == (20, 100, 500) and metres(5) == (5,) and metres([7, 3]) == (3, 7)
    for bad in ("", " ,", "0", "-5", "1.5", "x", 0, [1, True], [2.5], []):
        with pytest.raises(ValueError):
            metres(bad)
    assert "mean" not in reducers_for("categorical") and "mode" not in reducers_for("continuous") and {"mean", "mode"} <= set(reducers_for(None))
    terrasample.update_catalog({"datasets": {
        "dem": {"data_source": "local", "path": dem[0], "bands": 1, "data_type": "continuous"}, "dem2": {"data_source": "local", "path": dem[0], "bands": 2, "data_type": "continuous"},
        "land": {"data_source": "local", "path": dem[0], "bands": 1, "data_type": "categorical"},
    }})
    r = Requests("tabular", {"output_file_format": "csv"}).add("dem", "100").add("dem2", [100]).add("dem", 100).add("land", 100).add("dem", 50, ["max", "max"])
    one, two, three = r.configs()
    assert one["datasets"] == ["dem", "dem2"] and one["settings"]["statistics"] == ["mean", "std"] and one["settings"]["window_size_m"] == [100]
    assert two["datasets"] == ["land"] and two["settings"]["statistics"] == ["mode", "class_fraction"] and three["settings"]["statistics"] == ["max"]
    assert len({c["batch_id"] for c in (one, two, three)}) == 3
    raster = Requests("raster").add("dem", (5, 6)).configs()[0]["settings"]
    assert raster == {"output_type": "raster", "window_size_m": [5, 6], "resample_m": 10}
    for bad in (lambda: Requests("x"), lambda: Requests("raster").configs(), lambda: Requests("tabular").add("dem", 5, [])):
        with pytest.raises(ValueError):
            bad()
    own = Requests("tabular", {"output_file_format": "csv"}).add("dem", 100, ["max"])
    texts = sites(spark).withColumn("decimalLatitude", F.col("decimalLatitude").cast("string"))
    out = own.run(texts, str(tmp_path), "4326", quiet=True)
    assert spark.read.csv(out[own.configs()[0]["batch_id"]], header=True).columns[-1] == "dem_max_100m"
    for bad in (sites(spark).limit(0), sites(spark).withColumn("decimalLatitude", F.lit("north")), sites(spark).drop("decimalLongitude")):
        with pytest.raises(ValueError):
            own.run(bad, str(tmp_path))


def test_lzw_and_packbits():
    # the specification's example bytes, and a run-length example
    assert geotiff._unpackbits(
        bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    ).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert geotiff._unlzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


GOOD = {"datasets": ["dem"], "settings": {"output_type": "tabular", "statistics": ["mean"]}}


@pytest.mark.parametrize(
    "change",
    [
        {"datasets": []}, {"datasets": ["nope"]}, {"datasets": [{"dem": {"x": 1}}]}, {"datasets": [{"dem": []}]}, {"datasets": [{"dem": "b1"}]}, {"datasets": [{"dem": ["slope"]}]}, {"datasets": [3]}, {"settings": {}}, {"settings": {"output_type": "x"}},
        *(
            {"settings": GOOD["settings"] | s} for s in (
                {"statistics": []}, {"statistics": ["Mean"]}, {"statistics": {"odd": ["mean"]}},
                {"statistics": {"continuous": []}}, {"resample_m": 5}, {"output_file_format": "xls"},
                {"min_coverage_pct": 101}, {"window_size_m": 0}, {"window_size_m": True}, {"window_size_m": []},
                {"window_size_m": 1.5}
            )
        ),
        {"settings": {"output_type": "raster", "statistics": ["mean"]}}, {"settings": {"output_type": "raster", "resample_m": 0}},
    ],
)
def test_wrong_configurations(change):
    with pytest.raises(ValueError):
        config.parse(GOOD | change, 0, {"dem": {"data_source": "local", "path": "x"}}, catalog.DEFAULTS)


def test_configuration_defaults(tmp_path):
    run = config.parse(GOOD, 2, {"dem": {}}, catalog.DEFAULTS)
    assert (run.batch_id, run.windows, run.output_file_format, run.statistics_for("dem", "categorical")) == ("output3", [500], "csv", ["mean"])
    (tmp_path / "c.yml").write_text("datasets: [dem]\nsettings: {output_type: tabular, statistics: {continuous: [mean]}}")
    run = config.parse(config.configs(tmp_path / "c.yml")[0], 0, {"dem": {}}, catalog.DEFAULTS)
    with pytest.raises(ValueError):
        run.statistics_for("dem", "categorical")


def test_catalog(spark, tmp_path):
    assert len(terrasample.list_datasets()) == 26 and next(
        r for r in terrasample.list_datasets("full") if r["name"] == "aef_satellite_embeddings"
    )["dataset_spec"]["use_utm_zone"]
    info = terrasample.list_datasets("info")[0]
    assert set(info) == {
        "name", "data_source", "data_type", "description", "citation", "ee_source_url", "source_url"
    } and info["ee_source_url"].startswith("https://")
    terrasample.update_catalog({"datasets": {"mine": {"data_source": "local", "path": "/x.tif"}}})
    assert "mine" in terrasample.list_datasets() and terrasample.catalog_table(spark).count() == 27
    (tmp_path / "bad.yml").write_text("datasets: [")
    for bad in (
        {}, {"datasets": {}}, {"datasets": {"a": {"path": "x"}}},
        {"datasets": {"a": {"data_source": "earth_engine", "path": "x"}}}, tmp_path / "bad.yml"
    ):
        with pytest.raises(terrasample.CatalogError):
            terrasample.update_catalog(bad)
    with pytest.raises(terrasample.CatalogError):
        terrasample.update_catalog("/no/such.yml")
    terrasample.reset_catalog()
    assert "mine" not in terrasample.list_datasets()


@pytest.fixture(scope="module")
def dem(tmp_path_factory):
    v = np.random.default_rng(42).uniform(26, 286, (3, 500, 500)).astype("float32")
    path = tmp_path_factory.mktemp("dem") / "dem.tif"
    path.write_bytes(
        geotiff.encode(
            v,
            Header(500, 500, 10.0, -10.0, 347020.0, 6988980.0, crs=32634, bands=("b1", "b2", "b3"), nodata=(None,) * 3, dtype="float32")
        )
    )
    return str(path), v


SITES = [("T2", 62.976878, 18.026823, "2025-06-18", 5), ("T6", 62.981296, 18.030991, "2020-12-12", 6), ("OOB", 0.0, 0.0, "2025-01-01", 7)]


def sites(spark):
    return spark.createDataFrame(SITES, "occurrenceID string, decimalLatitude double, decimalLongitude double, eventDate string, n_otu int")


def test_extract_tables(spark, dem, tmp_path):
    path, v = dem
    terrasample.update_catalog(
        {"datasets": {"dem": {"data_source": "local", "path": path, "bands": 1}, "all": {"data_source": "local", "path": path, "bands": [1, 2]}}}
    )
    events = []
    out = terrasample.extract(
        sites(spark),
        {
            "batch_id": "b", "datasets": ["dem", "all"],
            "settings": {
                "output_type": "tabular", "statistics": ["mean", "count", "point"], "window_size_m": [100, 200],
                "output_file_format": "dataframe"
            }
        },
        output_dir=str(tmp_path), quiet=True, progress_callback=events.append
    )
    assert out.columns[:5] == ["occurrenceID", "decimalLatitude", "decimalLongitude", "eventDate", "n_otu"]
    assert {"dem_mean_100m", "dem_count_200m", "dem_point", "all_b1_mean_100m", "all_b2_point"} <= set(out.columns)
    rows = out.collect()
    assert [r["occurrenceID"] for r in rows] == ["T2", "T6", "OOB"]
    assert rows[0]["dem_count_100m"] == 100 and rows[0]["dem_mean_100m"] == rows[0]["all_b1_mean_100m"] == round(rows[0]["dem_mean_100m"], 5)
    assert rows[2]["dem_mean_100m"] is None and rows[2]["dem_count_100m"] is None and rows[2]["dem_point"] is None
    q = spark.read.csv(f"{tmp_path}/b_qc.csv", header=True, inferSchema=True)
    assert {"dem_in_extent_100m", "dem_n_pixels_100m", "dem_had_nodata_100m", "dem_coverage_pct_200m", "dem_region_crs_100m"} <= set(q.columns)
    side = json.loads((tmp_path / "b_metadata.json").read_text())
    assert side["run"]["n_points"] == 3 and side["datasets"]["dem"]["quality"]["n_no_data"] == 1
    per = {k: [e for e in events if (e.dataset, e.window_m) == k] for k in {(e.dataset, e.window_m) for e in events}}
    assert {("dem", 100), ("dem", 200), ("all", 100), ("all", 200)} == set(per)
    for own in per.values():  # from none to all, and all only when the result is written: after every start
        assert (own[0].done, own[-1].done, own[-1].share) == (0, 3, 1.0) and [e.done for e in own] == sorted(e.done for e in own)
    assert max(k for k, e in enumerate(events) if e.done == 0 and e.share == 0) < min(k for k, e in enumerate(events) if e.done == 3)


def test_extract_files_and_names(spark, dem, tmp_path):
    path, _ = dem
    terrasample.update_catalog({"datasets": {"dem": {"data_source": "local", "path": path, "bands": 1}}})
    df = sites(spark).withColumnsRenamed({"occurrenceID": "key", "decimalLatitude": "y", "decimalLongitude": "x"}).drop("eventDate")
    out = terrasample.extract(
        df,
        [
            {
                "batch_id": f, "datasets": [{"dem": [2]}],
                "settings": {"output_type": "tabular", "statistics": ["max"], "window_size_m": 50, "output_file_format": f}
            } for f in ("csv", "parquet")
        ],
        output_dir=str(tmp_path), id_column="key", latitude_column="y", longitude_column="x", quiet=True,
        write_metadata=False
    )
    assert set(out) == {"csv", "parquet"} and spark.read.parquet(out["parquet"]).columns == ["key", "y", "x", "n_otu", "dem_b2_max_50m"]
    with pytest.raises(ValueError, match="Missing columns"):
        terrasample.extract(df, GOOD, id_column="nope")


def test_extract_tiles(spark, dem, tmp_path):
    path, v = dem
    terrasample.update_catalog({"datasets": {"dem": {"data_source": "local", "path": path, "bands": 1}}})
    out = terrasample.extract(
        sites(spark).limit(2),
        {"batch_id": "t", "datasets": ["dem"], "settings": {"output_type": "raster", "window_size_m": 80}},
        output_dir=str(tmp_path), quiet=True
    )
    assert sorted(p.name for p in Path(out["t:dem"]).iterdir()) == ["T2-dem.tif", "T6-dem.tif"]
    data = (Path(out["t:dem"]) / "T2-dem.tif").read_bytes()
    h, x = geotiff.header_of(data), geotiff.decode(data)[0]
    side = json.loads((tmp_path / "t" / "t_metadata.json").read_text())["datasets"]["dem"]
    assert side["tiles_80m"] == {"n_exported": 2, "n_failed": 0, "total": 2} and side["crs"] == "EPSG:32634" and side["dtype"] == "float32"
    r0, c0 = round((6988980 - h.f) / 10), round((h.c - 347020) / 10)
    assert x.shape == (8, 8) and np.allclose(x, v[0, r0 : r0 + 8, c0 : c0 + 8], atol=1e-3)
    from terrasample.plans.extract import check_tile_size

    with pytest.raises(ValueError):
        check_tile_size(100_000, 10, 1)


def tiles_of(spark, df, raster, tmp_path, **settings):
    out = terrasample.extract(
        df, {"batch_id": "t", "datasets": ["ts"], "settings": {"output_type": "raster", **settings}},
        rasters={"ts": raster}, quiet=True, write_metadata=False, output_dir=str(tmp_path)
    )
    return {p.name: (geotiff.header_of(p.read_bytes()), geotiff.decode(p.read_bytes())) for p in Path(out["t:ts"]).iterdir()}


@pytest.mark.parametrize("step", [None, 10])
def test_tiles_have_all_bands_and_nodata(spark, tmp_path, step):
    v = np.arange(3 * 40 * 40).reshape(3, 40, 40) % 200
    v[0, 18:23, 18:23] = 250
    (tmp_path / "b.tif").write_bytes(
        geotiff.encode(
            v.astype("uint8"),
            Header(40, 40, 10.0, -10.0, 360020.0, 6988980.0, crs=32634, bands=("b1", "b2", "b3"), nodata=(250.0,) * 3, dtype="uint8")
        )
    )
    r = geotiff.read(spark, str(tmp_path / "b.tif"))
    lat, lon = one(spark, *crs.utm_inverse(F.lit(360220.0), F.lit(6988780.0), F.lit(32634)))
    df = spark.createDataFrame([("p", lat, lon), ("far", 0.0, 0.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    (h, x), = tiles_of(spark, df, r, tmp_path, window_size_m=80, **({"resample_m": step} if step else {})).values()
    assert x.shape == (3, 8, 8) and x.dtype == np.uint8 and h.nodata == (250.0,) * 3 and h.crs == 32634 and abs(h.c - 360180) < 1e-6 and abs(h.f - 6988820) < 1e-6
    assert (x == v[:, 16:24, 16:24]).all()


def test_tiles_without_nodata_take_the_type_s_own(spark, tmp_path):
    px = spark.range(400).select(
        (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"),
        F.when(F.col("id") != 0, F.col("id").cast("double")).alias("b1"), F.lit(7.0).alias("b2")
    )
    h = Header(20, 20, 10.0, 10.0, bands=("b1", "b2"), nodata=(None, None), dtype="int32")
    df = spark.createDataFrame([("p", 15.0, 15.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    (got, x), = tiles_of(spark, df, Raster(h, tiles_of_pixels(px, h, 16), 16), tmp_path, window_size_m=40).values()
    top = np.iinfo("int32").max
    assert x.shape == (2, 3, 3) and got.nodata == (float(top),) * 2 and x[0, 0, 0] == top and (x[1] == 7).all() and x[0, 1, 1] == 21


def test_tiles_of_a_raster_in_degrees_are_in_metres_and_of_the_point_s_image(spark, images, tmp_path):
    px = spark.range(3 * 10000).select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") / 10000).cast("int") + 1).alias("image_id"),
        ((F.col("id") % 10000) / 100).cast("int").alias("r"), (F.col("id") % 100).cast("int").alias("c")
    ).withColumns({"b1": F.ascii("image_id").cast("double"), "b2": F.col("c").cast("double")})
    h = Header(100, 100, 0.00025, -0.00025, 18.0, 63.0, crs=4326, bands=("b1", "b2"), nodata=(None, None))
    r = Raster(h, tiles_of_pixels(px, h, 16, ("image_id",)), 16, images)
    df = spark.createDataFrame(
        [("p", 62.9875, 18.0125, "2020-03-05"), ("q", 62.9875, 18.0125, "2019-01-01")],
        "occurrenceID string, decimalLatitude double, decimalLongitude double, eventDate string"
    )
    got = tiles_of(spark, df, r, tmp_path, window_size_m=100, resample_m=10)
    for name, image in (("p", "b"), ("q", "a")):
        t, x = got[f"{name}-ts.tif"]
        assert (x.shape, t.crs, t.a, t.e) == ((2, 10, 10), 32634, 10.0, -10.0) and t.c % 10 == 0 and np.allclose(x[0], ord(image))
        assert 40 < x[1].min() < 50 < x[1].max() < 60
    t, x = tiles_of(spark, df, r, tmp_path, window_size_m=100)["p-ts.tif"]
    assert t.crs == 4326 and t.a == 0.00025 and x.shape[0] == 2 and 3 <= x.shape[1] <= 5 and 7 <= x.shape[2] <= 10
    assert set(x[0][~np.isnan(x[0])]) == {float(ord("b"))} and np.nanmin(x[1]) == round((t.c - 18.0) / 0.00025)


def test_extract_derived_bands(spark, tmp_path):
    """A plane that rises 10 m a pixel to the east: slope 45 degrees, aspect west; in tables and in tiles."""
    n = 40
    px = spark.range(n * n).select(
        (F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c")
    ).withColumn("b1", F.col("c") * 10.0)
    h = Header(n, n, 10.0, -10.0, 347020.0, 6988980.0, crs=32634)
    r = Raster(h, tiles_of_pixels(px, h, 16), 16, meta={"spec": {"supported_derived_bands": ["slope", "aspect"]}})
    lat, lon = one(spark, *crs.utm_inverse(F.lit(347020.0 + 205), F.lit(6988980.0 - 205), F.lit(32634)))
    df = spark.createDataFrame([("p", lat, lon)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    run = {
        "batch_id": "d", "datasets": [{"dem": ["b1", "slope", "aspect"]}],
        "settings": {"output_type": "tabular", "statistics": ["min", "max", "point"], "window_size_m": 60, "output_file_format": "dataframe"}
    }
    row = terrasample.extract(df, run, rasters={"dem": r}, quiet=True, write_metadata=False, output_dir=str(tmp_path)).first()
    assert [row[f"dem_slope_{s}_60m"] for s in ("min", "max")] == [45.0, 45.0] and row["dem_aspect_point"] == 270.0 and row["dem_b1_point"] == 200.0
    run["settings"] = {"output_type": "raster", "window_size_m": 60}
    out = terrasample.extract(df, run, rasters={"dem": r}, quiet=True, write_metadata=False, output_dir=str(tmp_path))
    x = geotiff.decode((Path(out["d:dem"]) / "p-dem.tif").read_bytes())
    here = ~np.isnan(x[0])
    assert x.shape[0] == 3 and 30 < here.sum() < 43 and np.allclose(x[1][here], 45) and np.allclose(x[2][here], 270)


def test_extract_collection(spark, images):
    px = spark.range(3 * 400).select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") / 400).cast("int") + 1).alias("image_id"),
        ((F.col("id") % 400) / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c")
    ).withColumn("b1", F.ascii("image_id").cast("double"))
    h = Header(20, 20, 0.01, -0.01, 18.0, 63.0, crs=4326)
    r = Raster(h, tiles_of_pixels(px, h, 16, ("image_id",)), 16, images)
    df = spark.createDataFrame(
        [("p", 62.9, 18.1, "2020-03-05"), ("q", 62.9, 18.1, "2019-01-01")],
        "occurrenceID string, decimalLatitude double, decimalLongitude double, eventDate string"
    )
    out = terrasample.extract(
        df,
        {"datasets": ["ts"], "settings": {"output_type": "tabular", "statistics": ["point"], "output_file_format": "dataframe"}},
        rasters={"ts": r}, quiet=True, write_metadata=False, output_dir="/tmp/spark-extract-test"
    )
    assert [x["ts_point"] for x in out.collect()] == [float(ord("b")), float(ord("a"))]


def test_read_csv_finds_the_delimiter(spark, tmp_path):
    for k, sep in enumerate((",", ";", "\t", " ")):
        (tmp_path / f"{k}.csv").write_text(sep.join(["id", "lat", "lon"]) + "\n" + sep.join(["1", "2.5", "3.5"]) + "\n")
        assert point_source.read_csv(spark, str(tmp_path / f"{k}.csv")).first()["lon"] == 3.5


def test_stream_equals_batch(spark, tmp_path):
    px = spark.range(400).select(
        (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"),
        F.col("id").cast("double").alias("b1")
    )
    h = Header(20, 20, 10.0, 10.0)
    r = Raster(h, tiles_of_pixels(px, h, 16), 16)
    spark.range(10).select(F.col("id"), (F.col("id") * 20.0).alias("x"), F.lit(55.0).alias("y")).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id long, x double, y double").parquet(f"{tmp_path}/in")
    enrich_stream(s, r, 40, ["max"], ["b1"], f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("b1_max is not null").count() == 10


def test_remote_is_refused():
    with pytest.raises(RuntimeError):
        terrasample.init_remote()
