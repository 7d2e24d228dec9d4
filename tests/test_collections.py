"""As-of joins by time and place, mirrored collections and their data sources, tile export."""

import datetime
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import terrasample
from terrasample.functions import dates
from terrasample.functions.grid import Header
from terrasample.operators import asof, window
from terrasample.plans import progress
from terrasample.sources import geotiff, mirror, shared, sinks
from terrasample.sources.raster import Raster, tiles_of_pixels

D, T = datetime.date, datetime.datetime
UTC = datetime.timezone.utc


def plain_match(t, own, policy):
    """image, start, end, clamped, source of a time among images (id, start, end), by looking at all of them."""
    if not own:
        return None, None, None, False, None
    starts = sorted({s for _, s, _ in own})
    pick = lambda s, last: (max if last else min)((e is not None, e or 0, i) for i, x, e in own if x == s)
    if t is None:
        s, last, source, clamped = starts[-1], True, "most_recent_no_date", False
    elif policy == "nearest":
        s, last = min(starts, key=lambda x: (abs(x - t), -x)), False
        clamped = t < starts[0] or t > starts[-1]
        source = "clamped_to_nearest" if clamped else "nearest_to_sample"
    else:
        before = [x for x in starts if x <= t]
        s, last = (before[-1], True) if before else (starts[0], False)
        clamped = t <= starts[0] or t >= starts[-1]
        source = "clamped_to_nearest" if clamped else "contains_sample_date"
    _, end, i = pick(s, last)
    end = end or None
    if policy == "contains" and end is None:
        later = [x for x in starts if x > s]
        end = later[0] if later and t is not None else s + dates.DAY
    return i, s, end, clamped, source


def us(x):
    return None if x is None else int((x.replace(tzinfo=UTC) - T(1970, 1, 1, tzinfo=UTC)) / datetime.timedelta(microseconds=1))


@pytest.mark.parametrize("policy", ["nearest", "contains"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_times_are_matched_as_by_looking_at_all(spark, policy, partitions):
    random.seed(partitions)
    ms = [1_580_000_000_000 + random.randrange(20) * 3_600_000 * random.choice((1, 5, 50)) for _ in range(60)]
    images = [(f"i{k}", m, m + 7_200_000 if k % 3 == 0 else None, random.choice(("a", "b", None))) for k, m in enumerate(ms)] + [("none", None, None, "a")]
    asked = [(k, T(2020, 1, 20) + datetime.timedelta(minutes=random.randrange(100_000)) if k % 9 else None, random.choice(("a", "b", "c", None))) for k in range(300)]
    asked += [(1000 + k, T(1970, 1, 1) + datetime.timedelta(milliseconds=m), "a") for k, m in enumerate(ms)]
    im = spark.createDataFrame(images, "image_id string, time_start bigint, time_end bigint, zone string")
    rows = spark.createDataFrame(asked, "k int, at timestamp_ntz, zone string").withColumn("t", F.lit("own"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["k"]: r for r in asof.match_images(rows, im, policy, "at", ("zone",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(asked) and {r["t"] for r in got.values()} == {"own"}
    for k, t, zone in asked:
        own = [(i, s * 1000, e and e * 1000) for i, s, e, z in images if z == zone and s is not None]
        r = got[k]
        assert (r["image_id"], us(r["image_time_start"]), us(r["image_time_end"]), r["date_clamped"], r["date_source"]) == plain_match(us(t), own, policy)


@pytest.mark.parametrize("policy", ["nearest", "contains"])
def test_no_frame_of_times_shrinks_from_row_to_row(spark, policy):
    """Such a frame is read anew for each row: quadratic in a range's times."""
    im = spark.createDataFrame([("a", T(2020, 1, 1, 23), None)], "image_id string, time_start timestamp, time_end timestamp")
    plan = asof.match_images(spark.createDataFrame([(D(2020, 1, 2),)], "date date"), im, policy)._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame" in plan and "RowFrame, 1, unboundedfollowing" not in plan


@pytest.mark.parametrize("policy", ["nearest", "contains"])
def test_ranges_of_times_do_not_grow_with_the_rows(spark, monkeypatch, policy):
    """There were as many as shuffle partitions, and some of them met in one task."""
    day = lambda k: F.date_add(F.lit(D(2020, 1, 1)), k.cast("int")).alias
    im = spark.range(0, 400, 4).select(F.col("id").cast("string").alias("image_id"), day(F.col("id"))("time_start"), F.lit(None).cast("date").alias("time_end"))
    laid, cut = {}, asof.cut
    monkeypatch.setattr(asof, "cut", lambda df, folder, name, *rest: laid.setdefault(name, cut(df, folder, name, *rest)))
    monkeypatch.setattr(asof, "TIMES_A_RANGE", 20, raising=False)
    got = asof.match_images(spark.range(400).select("id", day(F.col("id"))("date")), im, policy).collect()
    assert laid["as-of"].groupBy("range").count().agg(F.max("count")).first()[0] <= 60
    near = {0: 0, 1: -1, 2: 2, 3: 1} if policy == "nearest" else {0: 0, 1: -1, 2: -2, 3: -3}
    assert sorted((r["id"], int(r["image_id"])) for r in got) == [(k, min(k + near[k % 4], 396)) for k in range(400)]


def test_a_collection_longer_than_the_globe_is_laid_out_smaller(spark, tmp_path):
    import __spark_entry__ as entry

    # 603 rows of pixels: at a quarter of a degree each they reach beyond the south pole
    part = [(k, 1 if k % 11 == 0 else 2, float(k)) for k in range(0, 603 * 50, 7)]
    spark.createDataFrame(part, "p_partkey bigint, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in (0, 1, 12, 91, 182, 7, 500, 603 * 9 + 1)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    rows = part[-1][0] // 50 + 1
    got = entry.queries()["extract_collection"](spark, str(tmp_path)).collect()
    assert len(got) == 8 and rows > 600
    cells = {k: v for k, size, v in part if size != 1}
    days = [D(2020, 1, 1), D(2020, 3, 1), D(2020, 6, 1)]
    for r in got:
        k = r["occurrenceID"]
        y, x, day = (k * 53) % rows, (k * 37) % 70, D(2019, 12, 20) + datetime.timedelta((k * 11) % 220)
        assert (r["decimalLatitude"], r["decimalLongitude"]) == (59.875 - 0.25 * y, 8.125 + 0.25 * x)
        held = [j for j in range(3) if 10 + 1.25 * j <= r["decimalLongitude"] <= 22.5 + 1.25 * j]
        j = min(held, key=lambda j: (abs((days[j] - day).days), -j), default=None)
        value = None if j is None else cells.get(y * 50 + int((r["decimalLongitude"] - 10 - 1.25 * j) / 0.25))
        assert r["part_copy_point"] == (None if value is None else value + 1000 * j)


def test_the_hour_decides_among_images_of_neighbouring_days(spark):
    im = spark.createDataFrame([("a", T(2020, 1, 1, 23), None), ("b", T(2020, 1, 3, 5), None)], "image_id string, time_start timestamp, time_end timestamp")
    rows = spark.createDataFrame([(D(2020, 1, 2),)], "date date")
    assert asof.match_images(rows, im).first()["image_id"] == "a"


def test_clamping_is_that_of_all_images_that_cover_the_place(spark):
    im = spark.createDataFrame(
        [("a", D(2019, 1, 1), None, 10.0, 50.0, 12.0, 52.0), ("b", D(2021, 1, 1), None, 10.0, 50.0, 13.0, 53.0)],
        "image_id string, time_start date, time_end date, west double, south double, east double, north double"
    )
    rows = spark.createDataFrame([(1, 51.0, 11.0, D(2020, 9, 1))], "_row int, lat double, lon double, date date")
    near = asof.match_covering(rows, im).first()
    assert (near["image_id"], near["date_clamped"], near["date_source"]) == ("b", False, "nearest_to_sample")
    held = asof.match_covering(rows, im, "contains").first()
    assert (held["image_id"], held["date_clamped"], held["image_time_end"]) == ("a", False, D(2021, 1, 1))


@pytest.mark.parametrize("policy", ["nearest", "contains"])
def test_footprints_of_all_sizes_are_matched_as_by_looking_at_all(spark, policy):
    random.seed(4)
    feet = [(-180.0, -90.0, 180.0, 90.0), (170.0, -10.0, -170.0, 10.0), (179.5, 0.0, -179.5, 1.0), (-180.0, -5.0, -175.0, 5.0)]
    feet += [(w := random.uniform(-180, 170), s := random.uniform(-90, 80), w + random.choice((0.0, 0.001, 1, 9)), s + random.choice((0.0, 0.01, 2, 9))) for _ in range(60)]
    images = [(f"i{k}", D(2020, 1, 1) + datetime.timedelta(random.randrange(400)), None, random.choice(("x", "y")), *f) for k, f in enumerate(feet * 2)]
    places = [(random.uniform(-90, 90), random.choice((random.uniform(-180, 180), random.uniform(178, 180), -180.0, 180.0, 179.0))) for _ in range(200)]
    places += [(s, w) for w, s, *_ in feet]
    rows = [(k, lat, lon, D(2020, 1, 1) + datetime.timedelta(random.randrange(-30, 430)) if k % 7 else None, random.choice(("x", "y"))) for k, (lat, lon) in enumerate(places)]
    im = spark.createDataFrame(images, "image_id string, time_start date, time_end date, zone string, west double, south double, east double, north double")
    got = asof.match_covering(spark.createDataFrame(rows, "_row int, lat double, lon double, date date, zone string"), im, policy, keys=("zone",)).collect()
    assert len(got) == len(rows)
    day = lambda d: None if d is None else (d - D(1970, 1, 1)).days * dates.DAY
    for r in got:
        _, lat, lon, d, zone = rows[r["_row"]]
        own = [
            (i, day(s), None) for i, s, _, z, w, south, e, north in images
            if z == zone and south <= lat <= north and (w <= lon <= e if w <= e else lon >= w or lon <= e)
        ]
        assert (r["image_id"], day(r["image_time_start"]), day(r["image_time_end"]), r["date_clamped"], r["date_source"]) == plain_match(day(d), own, policy)


def test_rows_in_the_same_footprints_at_one_time_are_matched_once(spark, monkeypatch):
    """A row for each pair of a row and a footprint was sorted by task."""
    im = spark.createDataFrame(
        [("a", D(2019, 1, 1), None, 10.0, 50.0, 12.0, 52.0), ("b", D(2021, 1, 1), None, 10.0, 50.0, 13.0, 53.0), ("c", D(2020, 1, 1), None, 11.5, 50.0, 14.0, 53.0)],
        "image_id string, time_start date, time_end date, west double, south double, east double, north double"
    )
    k = F.col("id")
    rows = spark.range(400).select(
        k.cast("int").alias("_row"), (51 + k % 7 * 0.01).alias("lat"), F.when(k % 40 == 0, 99.0).otherwise(11.0 + k % 2).alias("lon"), F.date_add(F.lit(D(2020, 3, 1)), (k % 3).cast("int")).alias("date")
    )
    seen, decided = [], asof._decided
    monkeypatch.setattr(asof, "_decided", lambda near, *rest: (seen.append(near), decided(near, *rest))[1])
    monkeypatch.setattr(asof, "PAIRS_A_TASK", 1, raising=False)
    got = asof.match_covering(rows, im, "contains").collect()
    assert sorted((r["_row"], r["image_id"]) for r in got) == [(n, None if n % 40 == 0 else "c" if n % 2 else "a") for n in range(400)]
    assert seen[0].count() == 2 * 3


def test_no_cell_has_all_footprints(spark):
    feet = spark.range(3000).select(
        (F.col("id") % 60 * 5.9 - 179).alias("west"), (F.floor(F.col("id") / 60) * 3.0 - 80).alias("south")
    ).withColumns({"east": F.col("west") + 0.3, "north": F.col("south") + 0.3})
    cells = asof.footprint_cells(feet.unionByName(spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0)], "west double, south double, east double, north double")))
    assert cells.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 4
    assert cells.groupBy("west", "south").count().agg(F.max("count")).first()[0] <= 4


def write(folder: Path, name: str, left: float, top: float, value, *, crs=32634, n=20, items=None, bands=("b1",), nodata=None):
    folder.mkdir(parents=True, exist_ok=True)
    h = Header(n, n, 10.0, -10.0, left, top, crs=crs, bands=bands, nodata=(nodata,) * len(bands), dtype="float32")
    v = np.broadcast_to(np.asarray(value, np.float32), (len(bands), n, n)) if np.ndim(value) < 3 else np.asarray(value, np.float32)
    (folder / f"{name}.tif").write_bytes(geotiff.encode(np.ascontiguousarray(v), h, items))


@pytest.fixture
def folder(tmp_path):
    """Four images of two places, one of them hours apart on one day, told by items, by a date tag's stand-in and by name."""
    ms = lambda *t: str(int(T(*t, tzinfo=UTC).timestamp() * 1000))
    at = tmp_path / "mirror" / "PUB" / "SCENES"
    write(at, "s1", 360000, 6989000, 1.0, items={"system:time_start": ms(2020, 1, 1, 6), "system:time_end": ms(2020, 1, 1, 7)})
    write(at, "s2", 360000, 6989000, 2.0, items={"system:time_start": ms(2020, 1, 1, 18), "UTM_ZONE": "34N"})
    write(at / "more", "s3_20200301", 360100, 6989050, 3.0, nodata=-1.0)
    write(at / "more", "s4_2020-06-01", 361000, 6989000, np.full((1, 20, 20), -1.0), nodata=-1.0)
    (at / "readme.txt").write_text("no image")
    return at


def test_images_of_a_folder(spark, folder):
    got = {r["image_id"]: r for r in mirror.images(spark, str(folder)).collect()}
    assert sorted(got) == ["more/s3_20200301", "more/s4_2020-06-01", "s1", "s2"]
    assert got["s1"]["time_start"] == T(2020, 1, 1, 6) and got["s1"]["time_end"] == T(2020, 1, 1, 7) and got["s2"]["time_end"] is None
    assert got["more/s3_20200301"]["time_start"] == T(2020, 3, 1) and {r["utm_zone"] for r in got.values()} == {"34N"}
    r = got["s1"]
    assert r["west"] < r["east"] < r["west"] + 0.01 and r["south"] < r["north"] < r["south"] + 0.01 and 18 < r["west"] < 19 and 62.9 < r["south"] < 63.1
    with pytest.raises(Exception, match="nothing-here"):
        mirror.images(spark, str(folder / "nothing-here")).collect()


def test_filters_reach_the_data_sources(spark, folder, capfd):
    found = mirror.images(spark, str(folder)).where("time_start >= timestamp'2020-02-01' and utm_zone = '34N' and image_id in ('s1', 'more/s3_20200301')")
    found.explain("formatted")
    plan = capfd.readouterr().out
    pushed = plan.split("PushedFilters: [", 1)[1].split("]\n")[0]
    assert all(f in pushed for f in ("GreaterThanOrEqual(time_start", "EqualTo(utm_zone", "In(image_id")) and "Filter (" not in plan  # nothing is left to Spark
    assert [r["image_id"] for r in found.collect()] == ["more/s3_20200301"]
    # only the named image's header is read: the others may be anything
    (folder / "broken.tif").write_bytes(b"not an image")
    assert mirror.images(spark, str(folder)).where("image_id = 's1'").count() == 1
    tiles = spark.read.format("terrasample_tiles").option("size", 8).load(str(folder)).where("image_id = 's2' and tile_row = 1 and tile_col >= 1")
    assert sorted((r["tile_row"], r["tile_col"], r["b1"][0], len(r["b1"])) for r in tiles.collect()) == [(1, 1, 2.0, 64), (1, 2, 2.0, 64)]
    reader = mirror.TileReader(str(folder), 8, ["b1"])
    rest = reader.pushFilters([mirror.EqualTo(("image_id",), "s2"), mirror.EqualTo(("b1", "x"), 1)])
    assert len(list(rest)) == 1 and [u for p in reader.partitions() for u in p.units] == [("s2", str(folder / "s2.tif"))]


def points_at(spark, rows):
    """Occurrences at places of zone 34N."""
    from terrasample.functions import crs

    df = spark.createDataFrame(rows, "occurrenceID string, e double, n double, eventDate string")
    lat, lon = crs.utm_inverse(F.col("e"), F.col("n"), F.lit(32634))
    return df.select("occurrenceID", lat.alias("decimalLatitude"), lon.alias("decimalLongitude"), "eventDate")


def test_a_catalog_entry_opens_its_mirrored_collection(spark, folder, tmp_path):
    spark.conf.set(mirror.ROOT, str(tmp_path / "mirror"))
    try:
        terrasample.update_catalog({"datasets": {"scenes": {
            "data_source": "earth_engine", "path": "PUB/SCENES", "data_type": "continuous", "dataset_spec": {"use_utm_zone": True, "collection_date_policy": "nearest"},
        }}})
        df = points_at(spark, [
            ("a", 360055.0, 6988945.0, "2020-01-01"), ("b", 360055.0, 6988945.0, "2020-01-02"), ("c", 360155.0, 6988995.0, "2020-04-01"),
            ("d", 361055.0, 6988945.0, "2020-04-01"), ("e", 390000.0, 6988945.0, "2020-04-01"), ("f", 360055.0, 6988945.0, None),
        ])
        run = {"batch_id": "r", "datasets": ["scenes"], "settings": {"output_type": "tabular", "statistics": ["mean", "count", "point"], "window_size_m": 40, "output_file_format": "dataframe"}}
        out = {r["occurrenceID"]: r for r in terrasample.extract(df, run, output_dir=str(tmp_path / "o"), quiet=True).collect()}
        assert [(out[k]["scenes_mean_40m"], out[k]["scenes_point"]) for k in "abcde"] == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (None, None), (None, None)]
        assert out["a"]["scenes_count_40m"] == 16 and "f" not in out  # rows without a date go, where there are dates
        q = {r["occurrenceID"]: r for r in spark.read.csv(str(tmp_path / "o" / "r_qc.csv"), header=True, inferSchema=True).collect()}
        assert str(q["c"]["scenes_image_time_start_40m"])[:10] == "2020-03-01" and q["a"]["scenes_date_clamped_40m"] is True and q["e"]["scenes_date_source_40m"] is None
        # tiles are those of the same images
        run = {"batch_id": "t", "datasets": ["scenes"], "settings": {"output_type": "raster", "window_size_m": 40}}
        at = Path(terrasample.extract(df, run, output_dir=str(tmp_path / "o"), quiet=True)["t:scenes"])
        assert {p.name: float(np.nanmax(geotiff.decode(p.read_bytes()))) for p in at.iterdir() if p.name[0] in "abc"} == {"a-scenes.tif": 1.0, "b-scenes.tif": 2.0, "c-scenes.tif": 3.0}
    finally:
        spark.conf.unset(mirror.ROOT)
    with pytest.raises(ValueError, match=mirror.ROOT):
        mirror.open_entry(spark, {"data_source": "earth_engine", "path": "PUB/SCENES"})


def test_single_files_and_odd_collections(spark, tmp_path):
    write(tmp_path / "one", "x", 0, 100, np.stack([np.full((20, 20), 5.0), np.full((20, 20), 6.0)]), items={}, bands=("red", "near"))
    r = mirror.open_entry(spark, {"data_source": "local", "path": str(tmp_path / "one")})
    assert r.images is None and r.header.bands == ("red", "near") and r.select(["near"]).tiles.first()["near"][0] == 6.0
    write(tmp_path / "plain", "x", 0, 100, 5.0)
    assert mirror.open_entry(spark, {"data_source": "local", "path": str(tmp_path / "plain" / "x"), "bands": ["elevation"]}).header.bands == ("elevation",)
    write(tmp_path / "two", "x", 0, 100, 5.0)
    write(tmp_path / "two", "y", 0, 100, 5.0, crs=32635)
    with pytest.raises(ValueError, match="2 systems"):
        mirror.open_entry(spark, {"data_source": "local", "path": str(tmp_path / "two")})
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        mirror.open_entry(spark, {"data_source": "local", "path": str(tmp_path / "empty")})


def test_an_image_that_crosses_the_antimeridian_has_a_footprint_there(spark, tmp_path):
    h = Header(20, 20, 10_000.0, -10_000.0, 700_000.0, 200_000.0, crs=32660, nodata=(None,), dtype="float32")
    (tmp_path / "z.tif").write_bytes(geotiff.encode(np.zeros((1, 20, 20), np.float32), h))
    r = mirror.images(spark, str(tmp_path)).first()
    assert 178 < r["west"] < 180 and -180 < r["east"] < -179


def stored_collection(spark, folder, n=128):
    """Six images of four years in two zones, n x n pixels each, in tiles of 8: a pixel tells its image and place."""
    px = spark.range(6 * n * n).select(
        F.concat(F.lit("i"), F.floor(F.col("id") / (n * n)).cast("string")).alias("image_id"), (F.floor(F.col("id") / n) % n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c")
    ).withColumn("b1", F.col("r") * 1000.0 + F.col("c") + F.substring("image_id", 2, 1).cast("int") * 1e6).withColumn("b2", F.lit(1.0))
    h = Header(n, n, 10.0, 10.0, bands=("b1", "b2"), nodata=(None, None))
    images = spark.createDataFrame(
        [(f"i{k}", D(2018 + k // 2 + (k == 5), 1, 1), None, "33N" if k % 2 else "34N") for k in range(5)] + [("i5", None, None, None)],
        "image_id string, time_start date, time_end date, utm_zone string"
    )
    return Raster(h, tiles_of_pixels(px, h, 8, ("image_id",)), 8, images, {"nodata": (None, None), "dtype": "float64"})


def broadcast(df):
    """The lines of a collected table's plan that lie below a broadcast."""
    found, at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        at = None if at is not None and depth <= at else at
        if at is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            at = depth
    return found


def test_many_tiles_of_a_source_are_not_sent_through_the_driver(spark, tmp_path):
    """Spark takes the array of a tile that a Python step makes for a single number."""
    for k in range(20):  # each image in tiles of its own
        write(tmp_path, f"i{k}_2020-01-01", 400000 + k * 2560.0, 6900000, k)
    raster = mirror.open_entry(spark, {"path": str(tmp_path)})
    assert raster.header.width > 19 * 256
    lat, lon = mirror.crs.utm_inverse(F.lit(400005.0) + F.col("id") * 2560, F.lit(6899995.0), F.lit(32634))
    points = spark.range(20).select(F.col("id").alias("_row"), F.concat(F.lit("i"), "id", F.lit("_2020-01-01")).alias("image_id"), lat.alias("lat"), lon.alias("lon"))
    sample = window.point_sample(points, raster, ["b1"])
    assert sorted((r["_row"], r["b1.point"]) for r in sample.collect()) == [(k, float(k)) for k in range(20)]
    assert not [x for x in broadcast(sample) if "MapInArrow" in x]
    stats = window.window_values(points, raster, [20.0], ["b1"])
    assert {r["_row"]: set(r["v0"]["b1"]) for r in stats.collect()} == {k: {float(k)} for k in range(20)}
    assert not [x for x in broadcast(stats) if "MapInArrow" in x]


def test_long_tables_of_a_match_are_not_sent_through_the_driver(spark, monkeypatch):
    """Spark takes them to be as large as their compressed files."""
    monkeypatch.setattr(shared, "SENT_ROWS", 50, raising=False)
    image = [(f"i{k}", D(2020, 1, 1 + k % 28), None, float(k), 0.0, k + 1.5, 9.0) for k in range(60)]
    im = spark.createDataFrame(image, "image_id string, time_start date, time_end date, west double, south double, east double, north double")
    row = [(k, 1.0 + k / 100, k % 60 + 0.25, D(2020, 1, 1 + k % 28)) for k in range(200)]
    near = asof.match_covering(spark.createDataFrame(row, "_row int, lat double, lon double, date date"), im)
    got = {r["_row"]: r["image_id"] for r in near.collect()}
    for k, _, lon, day in row:
        own = [(i, us(T(s.year, s.month, s.day)), None) for i, s, _, west, _, east, _ in image if west <= lon <= east]
        assert got[k] == plain_match(us(T(day.year, day.month, day.day)), own, "nearest")[0]
    # the places, as read back
    assert not [x for x in broadcast(near) if "FileScan" in x and "_at#" in x]


def test_a_store_of_tiles_reads_what_windows_want(spark, tmp_path, capfd):
    from terrasample.sources import store

    r = stored_collection(spark, tmp_path)
    back = store.open_store(spark, store.write_store(r, str(tmp_path / "s"), file_bytes=1 << 18, group_bytes=1 << 14))
    key = lambda t: {(x["image_id"], x["tile_row"], x["tile_col"]): (x["b1"], x["b2"]) for x in t.collect()}
    assert key(back.tiles) == key(r.tiles) and back.header == r.header and sorted(back.images.columns) == sorted(r.images.columns)
    wanted = spark.createDataFrame([("i2", 3, 4), ("i2", 3, 5), ("i2", None, 5), ("i2", 99, 99), ("i9", 3, 4)], "image_id string, tile_row int, tile_col int").where("tile_row < 50 or tile_row is null")
    got = back.tiles_for(wanted, ["b1"])
    assert {k: v[0] for k, v in ((((x["image_id"], x["tile_row"], x["tile_col"])), (x["b1"],)) for x in got.collect())} == {k: v[0] for k, v in key(r.tiles).items() if k in {("i2", 3, 4), ("i2", 3, 5)}}
    got.explain("formatted")
    plan = capfd.readouterr().out
    scan = plan.split("Scan parquet")[-1] if "/tiles" in plan.split("Scan parquet")[-1] else next(p for p in plan.split("Scan parquet") if "/tiles" in p)
    assert "zone" in scan.split("PartitionFilters")[1].split("\n")[0] and "period" in scan.split("PartitionFilters")[1].split("\n")[0]
    assert "GreaterThanOrEqual(tile_row,3)" in scan and "LessThanOrEqual(tile_col,5)" in scan and "b2" not in scan.split("ReadSchema")[1].split("\n")[0]
    # of the files of the one partition only those with the span of tiles are more than opened: few of the rows
    files = {f.split("/tiles/")[1].split("/part")[0] for f in back.tiles.inputFiles()}
    assert len(files) == 6 and "zone=34N/period=2019" in files
    near = spark.read.parquet(str(tmp_path / "s" / "tiles" / "zone=34N" / "period=2019"))
    assert near.select("z").rdd.getNumPartitions() >= 1 and near.count() == 256
    none = back.tiles_for(wanted.where("false"), ["b1", "b2"])
    assert none.count() == 0 and none.columns == ["image_id", "tile_row", "tile_col", "b1", "b2"]


def test_the_curve_keeps_neighbours_together(spark):
    from terrasample.sources import store

    got = {(r["a"], r["b"]): r["z"] for r in spark.range(64).select((F.col("id") % 8).cast("int").alias("a"), F.floor(F.col("id") / 8).cast("int").alias("b")).withColumn("z", store.curve(F.col("a"), F.col("b"))).collect()}
    plain = lambda a, b: sum(((a >> k & 1) << 2 * k + 1) | ((b >> k & 1) << 2 * k) for k in range(31))
    assert got == {(a, b): plain(a, b) for a in range(8) for b in range(8)}
    big = spark.range(1).select(store.curve(F.lit(2**31 - 1), F.lit(2**30 + 5)).alias("z")).first()["z"]
    assert big == plain(2**31 - 1, 2**30 + 5)


def test_stores_of_single_rasters_and_empty_tiles(spark, tmp_path):
    from terrasample.sources import store
    from terrasample.sources.raster import open_raster

    r = small_raster(spark)
    holes = Raster(r.header, r.tiles.withColumn("b1", F.when(F.col("tile_col") == 0, F.col("b1")).otherwise(F.transform("b1", lambda v: F.lit(None).cast("double")))), r.size)
    terrasample.update_catalog({"datasets": {"kept": {"data_source": "store", "path": store.write_store(holes, str(tmp_path / "s")), "data_type": "continuous"}}})
    back = open_raster(spark, {"data_source": "store", "path": str(tmp_path / "s")})
    assert back.images is None and {x["tile_col"] for x in back.tiles.collect()} == {0}
    df = spark.createDataFrame([("a", 15.0, 15.0), ("b", 15.0, 185.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    run = {"datasets": ["kept"], "settings": {"output_type": "tabular", "statistics": ["max"], "window_size_m": 20, "output_file_format": "dataframe"}}
    out = {x["occurrenceID"]: x["kept_max_20m"] for x in terrasample.extract(df.where("occurrenceID = 'a'"), run, output_dir=str(tmp_path / "o"), quiet=True).collect()}
    assert out == {"a": 21.0}
    with pytest.raises(ValueError, match="period"):
        store.write_store(r, str(tmp_path / "x"), period="week")


def tiles(spark, df, raster, folder, **settings):
    run = {"batch_id": "t", "datasets": ["ts"], "settings": {"output_type": "raster", **settings}}
    return Path(terrasample.extract(df, run, rasters={"ts": raster}, quiet=True, output_dir=str(folder))["t:ts"])


def small_raster(spark, dtype="float64"):
    px = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.col("id").cast("double").alias("b1"))
    h = Header(20, 20, 10.0, 10.0, nodata=(None,), dtype=dtype)
    return Raster(h, tiles_of_pixels(px, h, 16), 16)


def test_tile_names_of_any_ids(spark, tmp_path):
    ids = [("a", 15.0), ("a", 45.0), ("a", 45.0), ("urn:cat/1", 15.0), ("../../up", 15.0), ("..", 15.0), ("", 15.0), (None, 15.0), ("x" * 400, 15.0), (".hidden", 15.0), ("ü ber", 15.0), ("u_ber", 15.0)]
    df = spark.createDataFrame([(i, v, v) for i, v in ids], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    at = tiles(spark, df, small_raster(spark), tmp_path / "out", window_size_m=20)
    found = sorted(p.name for p in at.iterdir())
    assert len(found) == 11 and sum(n.startswith("a-") for n in found) == 2 and "u_ber-ts.tif" in found and all(len(n) < 255 and n[0] != "." for n in found)
    assert [p for p in (tmp_path / "out").rglob("*.tif") if p.parent != at] == [] and not list(tmp_path.glob("*.tif"))
    import json

    side = json.loads((tmp_path / "out" / "t" / "t_metadata.json").read_text())["datasets"]["ts"]["tiles_20m"]
    assert side == {"n_exported": 11, "n_failed": 0, "total": 12, "n_repeated": 1}


def test_one_bad_tile_leaves_the_others(spark, tmp_path):
    """A folder stands where one tile should be, and one row can't be encoded: a table says so, the other tiles are there."""
    df = spark.createDataFrame([("a", 15.0, 15.0), ("b", 45.0, 45.0), ("c", 85.0, 85.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    blocked = tmp_path / "out" / "t" / "ts" / "tiles" / "b-ts.tif"
    blocked.mkdir(parents=True)
    (blocked / "inside").write_text("x")
    at = tiles(spark, df, small_raster(spark), tmp_path / "out", window_size_m=20)
    assert sorted(p.name for p in at.iterdir() if p.is_file() and p.suffix == ".tif") == ["a-ts.tif", "c-ts.tif"]
    bad = spark.read.parquet(str(tmp_path / "out" / "t" / "ts" / "failed.parquet")).collect()
    assert [r["name"] for r in bad] == ["b-ts.tif"] and bad[0]["error"]
    rows = spark.createDataFrame(
        [("ok", 1, 1), ("bad", -1, 1)], "name string, height int, width int"
    ).select("name", F.lit(None).cast("int").alias("epsg"), *(F.lit(0.0).alias(c) for c in ("left", "top")), F.lit(1.0).alias("a"), F.lit(-1.0).alias("e"), F.lit(False).alias("turned"),
             "height", "width", F.array(F.lit(0)).alias("o"), F.array(F.array(F.lit(1.0))).alias("values"))
    made = {r["name"]: r for r in geotiff.write_tiles(rows, Header(1, 1, 1.0, -1.0, nodata=(None,), dtype="float32")).collect()}
    assert made["ok"]["content"] and made["ok"]["error"] is None and made["bad"]["content"] is None and "ValueError" in made["bad"]["error"]
    names = spark.createDataFrame([("../up.tif", b"x"), ("fine.tif", b"x"), (None, b"x")], "name string, content binary")
    done = {r["name"]: (r["written"], r["error"]) for r in sinks.write_files(names, str(tmp_path / "f")).collect()}
    assert done["fine.tif"] == (True, None) and not done["../up.tif"][0] and not done[None][0] and not (tmp_path / "up.tif").exists()


def test_executors_get_the_package_from_the_session(tmp_path):
    """Raster export from another folder, in workers that have no path to the package."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.executor.memory", "1g").getOrCreate()
from terrasample.sources import sinks
print("WRITTEN", [r["written"] for r in sinks.write_files(s.createDataFrame([("x.bin", b"abc")], "name string, content binary"), {str(tmp_path / "files")!r}).collect()])
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "WRITTEN [True]" in done.stdout, done.stderr[-2000:]


def test_progress_rises_with_the_tasks(spark):
    told = []
    with progress.watched(spark, told.append, every=0.05):
        spark.range(0, 40_000_000, 1, 40).select(F.sum(F.sha2(F.col("id").cast("string"), 256).substr(1, 2).try_cast("int"))).collect()
    assert told and told == sorted(told) and 0 < told[0] < 1 and max(told) <= 0.99
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with progress.watched(spark, None):
        assert spark.range(1).count() == 1


def test_intermediate_tables_go_with_the_run(spark, tmp_path):
    """Files leave nothing below the shared folder; a DataFrame only the table that it reads."""
    import os

    from terrasample.sources import shared

    base = spark.conf.get("spark.checkpoint.dir")
    r = stored_collection(spark, tmp_path, 64)
    df = spark.createDataFrame([("a", 15.0, 15.0, "2019-02-01")], "occurrenceID string, decimalLatitude double, decimalLongitude double, eventDate string")
    run = lambda form: terrasample.extract(
        df, {"datasets": ["r"], "settings": {"output_type": "tabular", "statistics": ["max", "class_count"], "window_size_m": [20, 40], "output_file_format": form}},
        rasters={"r": r.select(["b2"])}, output_dir=str(tmp_path / "o"), quiet=True
    )
    before = set(os.listdir(base))
    run("csv")
    assert set(os.listdir(base)) == before
    out = run("dataframe")
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and os.listdir(f"{base}/{left.pop()}") == ["extracted-0"] and out.first()["r_max_20m"] == 1.0
    with pytest.raises(ZeroDivisionError), shared.scratch(spark) as folder:
        shared.cut(spark.range(3), shared.shared_folder(spark), "t")
        assert os.path.isdir(folder)
        raise ZeroDivisionError
    assert not os.path.isdir(folder)
