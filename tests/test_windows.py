"""Window statistics, classes, samples and quality against numpy; every reducer and band rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasample.functions import crs, grid, reducers
from terrasample.operators import prefix, qc, window
from terrasample.sources.raster import Raster, pixels_of_tiles, tiles_of_pixels


def make(spark, values, *, size=16, **header):
    """A raster from an array bands x rows x columns."""
    n, h, w = values.shape
    rows = [(i, j, *(None if np.isnan(v) else float(v) for v in values[:, i, j])) for i in range(h) for j in range(w)]
    bands = tuple(f"b{k + 1}" for k in range(n))
    px = spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{b} double" for b in bands))
    head = grid.Header(w, h, **({"a": 10.0, "e": 10.0} | header), bands=bands, nodata=(None,) * n)
    return Raster(head, tiles_of_pixels(px, head, size), size)


@pytest.fixture(scope="module")
def values():
    v = np.random.default_rng(1).integers(0, 9, (2, 45, 50)).astype(float)
    v[0, 5:9, 7:20] = np.nan
    return v


@pytest.fixture(scope="module")
def raster(spark, values):
    return make(spark, values)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [(0, 100.0, 80.0), (1, 255.0, 161.0), (2, 3.0, 447.0), (3, 2000.0, 80.0), (4, 120.0, 70.0)],
        "_row long, x double, y double"
    )


def inside(values, x, y, w):
    h = w / 2
    rows, cols = (np.arange(n) * 10 + 5 for n in values.shape[1:])
    return values[:, (rows >= y - h) & (rows < y + h)][:, :, (cols >= x - h) & (cols < x + h)]


NUMPY = {
    "mean": np.mean, "median": np.median, "min": np.min, "max": np.max, "sum": np.sum, "count": len,
    "std": lambda v: np.std(v, ddof=1), "var": lambda v: np.var(v, ddof=1), "mode": lambda v: min(np.unique(v), key=lambda k: (-(v == k).sum(), k)),
    **{n: (lambda q: lambda v: np.quantile(v, q))(q) for n, q in reducers.QUANTILES.items()},
}


@pytest.mark.parametrize("w", [40, 100, 370])
def test_every_reducer_equals_numpy(raster, points, values, w):
    got = {r["_row"]: r for r in window.window_stats(points, raster, w, list(NUMPY), ["b1"]).collect()}
    for p in points.collect():
        v = inside(values, p["x"], p["y"], w)[0].ravel()
        v = v[~np.isnan(v)]
        for name, f in NUMPY.items():
            value = got[p["_row"]][f"b1.{name}"]
            if not len(v):
                assert value is None
            else:
                assert value == pytest.approx(f(v), nan_ok=True), (name, p)


def test_several_bands_are_valid_together(raster, points, values):
    got = {r["_row"]: r for r in window.window_stats(points, raster, 100, ["sum", "count"], ["b1", "b2"]).collect()}
    for p in points.collect():
        v = inside(values, p["x"], p["y"], 100).reshape(2, -1)
        v = v[:, ~np.isnan(v).any(0)]
        r = got[p["_row"]]
        assert r["n_pixels"] == v.shape[1]
        assert r["b2.sum"] == (v[1].sum() if v.size else None) and r["b1.count"] == (v.shape[1] or None)


def test_quality_flags(raster, points):
    got = {r["_row"]: r for r in window.window_stats(points, raster, 100, ["count"], ["b1"]).collect()}
    assert got[3]["in_extent"] is False and got[3]["n_pixels"] == 0 and got[3]["coverage_pct"] == 0 and not got[3]["had_nodata"]
    # a 100 m window off the grid touches 11 x 11 cells and holds 10 x 10 centres
    assert got[1]["total"] == 121 and got[1]["n_pixels"] == 100 and got[1]["had_nodata"] and got[1]["coverage_pct"] == pytest.approx(100 * 100 / 121)
    exact = window.window_stats(points, raster, 100, ["count"], ["b1"], coverage="geometric").where("_row = 1").first()
    assert exact["coverage_pct"] == 100
    assert qc.coverage_summary(window.window_stats(points, raster, 100, ["count"], ["b1"])).first()["n_no_data"] >= 1


def test_constant_raster_and_nodata(spark, points):
    v = np.full((1, 45, 50), 50.0)
    r = window.window_stats(points.where("_row < 2"), make(spark, v), 100, ["mean", "min", "max", "std"], ["b1"]).collect()
    assert {(x["b1.mean"], x["b1.min"], x["b1.max"], x["b1.std"]) for x in r} == {(50.0, 50.0, 50.0, 0.0)}
    marked = make(spark, v)
    marked = Raster(grid.Header(50, 45, 10.0, 10.0, bands=("b1",), nodata=(50.0,)), marked.tiles, marked.size)
    assert window.window_stats(points, marked, 100, ["mean"], ["b1"]).where("n_pixels > 0").count() == 0


def test_classes_add_up(spark, points):
    v = np.zeros((1, 40, 40))
    v[0, :20, :20], v[0, :20, 20:], v[0, 20:, :20], v[0, 20:, 20:] = 10, 20, 30, 40
    p = spark.createDataFrame([(0, 200.0, 200.0), (1, 50.0, 50.0)], "_row long, x double, y double")
    got = {r["_row"]: r.asDict() for r in window.window_classes(p, make(spark, v), 100, ["class_count", "class_fraction"], ["b1"]).collect()}
    assert [got[0][f"b1.class_{k}_count"] for k in (10, 20, 30, 40)] == [25] * 4
    assert [got[1][f"b1.class_{k}_fraction"] for k in (10, 20, 30, 40)] == [1.0, 0.0, 0.0, 0.0]
    assert all(sum(v for k, v in r.items() if k.endswith("fraction")) == 1 for r in got.values())


def test_point_sample(raster, points, values):
    got = {r["_row"]: r["b1.point"] for r in window.point_sample(points, raster, ["b1"]).collect()}
    assert got[3] is None and got[4] is None  # outside; nodata
    assert got[1] == values[0, 16, 25] and got[2] == values[0, 44, 0]


def test_tiles_and_pixels_agree(raster, values):
    back = {(r["r"], r["c"]): r["b1"] for r in pixels_of_tiles(raster).collect()}
    assert len(back) == 45 * 50
    assert all((back[i, j] is None) if np.isnan(values[0, i, j]) else back[i, j] == values[0, i, j] for i in range(45) for j in range(50))


@pytest.mark.parametrize("code", [32634, 4326, 32633])
def test_windows_in_any_system(spark, code):
    """A raster of its own column numbers: the mean over a window is the centre's column."""
    lat, lon = 62.9768, 18.0268
    e, n = (spark.range(1).select(*(c.alias(k) for c, k in zip(crs.from_wgs84(F.lit(lat), F.lit(lon), code), "en", strict=True))).first())
    step = 10.0 if code != 4326 else 0.0002
    v = np.tile(np.arange(80.0), (1, 80, 1))
    r = make(spark, v, a=step, e=-step, c=e - 40 * step, f=n + 40 * step, crs=code)
    p = spark.createDataFrame([(0, lat, lon)], "_row long, lat double, lon double")
    row = window.window_stats(p, r, 200, ["mean", "count"], ["b1"]).first()
    assert row["b1.mean"] == pytest.approx(39.5, abs=0.6)
    area = 400 if code != 4326 else 200 * 200 / (step * 111400 * step * 111400 * np.cos(np.radians(lat)))
    assert row["b1.count"] == pytest.approx(area, rel=0.08)


def test_plan_has_no_cross_product(raster, points):
    plan = window.window_stats(points, raster, 100, ["mean"], ["b1"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_registry():
    assert "point" not in reducers.list_reducers() and len(reducers.list_reducers()) == 18
    assert reducers.get("MEAN") is reducers.get("mean")
    with pytest.raises(ValueError):
        reducers.get("point")
    with pytest.raises(ValueError):
        reducers.quantile(1.5)
    assert reducers.type_warnings(["mean", "count"], "categorical") and not reducers.type_warnings(["mean"], "continuous")


def test_subpixel_and_cells():
    assert grid.effective_window(5, 30) == 60 and grid.effective_window(100, 30) == 100
    assert grid.geometric_cells(100, 10) == 100 and grid.geometric_cells(5, 30) == 1


NAMES = ["mean", "median", "q90", "max", "count", "mode", "std"]


@pytest.mark.parametrize("bands", [["b1"], ["b1", "b2"]])
def test_nested_windows_equal_single_ones(raster, points, bands):
    sides = [20, 40, 45, 200, 900]
    got = {r["_row"]: r for r in window.nested_stats(points, raster, sides, NAMES, bands).collect()}
    classes = {r["_row"]: r for r in window.nested_classes(points, raster, sides, ["class_count", "class_fraction"], bands).collect()}
    for k, side in enumerate(sides):
        for r in window.window_stats(points, raster, side, NAMES, bands).collect():
            assert r.asDict() == {"_row": r["_row"], **got[r["_row"]][f"w{k}"].asDict()}
        own = {r["_row"]: r.asDict() for r in window.window_classes(points, raster, side, ["class_count", "class_fraction"], bands).collect()}
        for row, r in classes.items():
            if r[f"w{k}"] is None:
                assert row not in own
            else:
                found = r[f"w{k}"].asDict()  # has the classes of the largest window: zero where a smaller one lacks them
                assert {c: v for c, v in found.items() if c in own[row]} == {c: v for c, v in own[row].items() if c != "_row"}
                assert not any(v for c, v in found.items() if c not in own[row])


def test_nested_windows_of_a_turned_grid(spark, values):
    """Windows in the points' UTM zone are quadrilaterals in a raster in degrees."""
    r = make(spark, values, a=0.0002, e=-0.0001, c=18.0, f=63.0, crs=4326)
    at = spark.createDataFrame([(0, 62.998, 18.004), (1, 62.9961, 18.0081), (2, 62.9999, 18.0001), (3, 10.0, 10.0)], "_row long, lat double, lon double")
    sides = [15, 60, 130]
    got = {x["_row"]: x for x in window.nested_stats(at, r, sides, NAMES, ["b1"]).collect()}
    assert got[0]["w0"]["n_pixels"] < got[0]["w1"]["n_pixels"] < got[0]["w2"]["n_pixels"] and not got[3]["w2"]["in_extent"]
    for k, side in enumerate(sides):
        for x in window.window_stats(at, r, side, NAMES, ["b1"]).collect():
            assert x.asDict() == {"_row": x["_row"], **got[x["_row"]][f"w{k}"].asDict()}


def test_all_windows_come_from_one_reading_of_the_tiles(spark, raster, points, tmp_path, capfd):
    from dataclasses import replace

    raster.tiles.write.parquet(str(tmp_path / "tiles"))
    stored = replace(raster, tiles=spark.read.parquet(str(tmp_path / "tiles")))
    window.nested_stats(points, stored, [20, 50, 100, 200, 500], NAMES, ["b1"]).explain()
    plan = capfd.readouterr().out
    assert plan.count("FileScan parquet") == 1 and "b2" not in plan.split("ReadSchema")[1].split("\n")[0]
    with pytest.raises(ValueError, match="rise"):
        window.nested_stats(points, stored, [50, 20], NAMES, ["b1"])


@pytest.fixture
def own_reducers():
    from terrasample import queries

    kept = dict(reducers._arrow)
    reducers.register_arrow_reducer("entropy", queries.ENTROPY)
    # the range, from states of two numbers
    reducers.register_arrow_reducer("span", reducers.ArrowReducer(lambda v: np.array([v.min(), v.max()]), lambda a, b: np.array([min(a[0], b[0]), max(a[1], b[1])]), lambda s: s[1] - s[0]))
    yield
    reducers._arrow.clear()
    reducers._arrow.update(kept)


def plain_entropy(v):
    share = np.unique(v, return_counts=True)[1] / len(v)
    return -(share * np.log(share)).sum()


def test_reducers_in_parts_equal_numpy(spark, raster, points, values, own_reducers):
    sides = [40, 370]
    got = {r["_row"]: r for r in window.nested_arrow(points, raster, sides, ["entropy", "span"], ["b1"], spread=3).collect()}
    for p in points.collect():
        for k, side in enumerate(sides):
            v = inside(values, p["x"], p["y"], side)[0].ravel()
            v = v[~np.isnan(v)]
            if not len(v):
                assert p["_row"] not in got or got[p["_row"]][f"w{k}"]["b1.span"] is None
                continue
            assert got[p["_row"]][f"w{k}"]["b1.span"] == v.max() - v.min() and got[p["_row"]][f"w{k}"]["b1.entropy"] == pytest.approx(plain_entropy(v), abs=1e-9)


def test_reducers_in_parts_see_the_pixels_that_others_see(spark, values, own_reducers):
    """On a grid that the windows are turned against, and with bands valid together only."""
    r = make(spark, values, a=0.0002, e=-0.0001, c=18.0, f=63.0, crs=4326)
    at = spark.createDataFrame([(0, 62.998, 18.004), (1, 62.9961, 18.0081), (3, 10.0, 10.0)], "_row long, lat double, lon double")
    for bands in (["b1"], ["b1", "b2"]):
        want = {x["_row"]: x for x in window.nested_stats(at, r, [60, 130], ["min", "max"], bands).collect()}
        got = {x["_row"]: x for x in window.nested_arrow(at, r, [60, 130], ["span"], bands).collect()}
        assert set(got) == {0, 1}
        for row, x in got.items():
            for w in ("w0", "w1"):
                assert all(x[w][f"{b}.span"] == want[row][w][f"{b}.max"] - want[row][w][f"{b}.min"] for b in bands)


def test_reducers_in_parts_go_by_name_through_extract(spark, raster, own_reducers, tmp_path):
    import terrasample

    df = spark.createDataFrame([("a", 85.0, 25.0), ("b", 15.0, 60.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    run = {"datasets": ["r"], "settings": {"output_type": "tabular", "statistics": ["span", "max", "min"], "window_size_m": [40, 100], "output_file_format": "dataframe"}}
    out = terrasample.extract(df, run, rasters={"r": raster.select(["b1"])}, output_dir=str(tmp_path), quiet=True).collect()
    assert len(out) == 2 and all(x[f"r_span_{w}m"] == x[f"r_max_{w}m"] - x[f"r_min_{w}m"] for x in out for w in (40, 100))
    assert "span" in terrasample.list_reducers()
    with pytest.raises(ValueError):
        reducers.register_arrow_reducer("mean", reducers.arrow_reducer("span"))


def test_quantiles_and_reducers_in_parts_make_no_row_of_a_pixel(spark, raster, points, own_reducers):
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    stats = plan(window.nested_stats(points.coalesce(1), raster, [20, 100], ["max", "median", "q90"], ["b1"]))
    assert "posexplode" not in stats and "percentile" not in stats and "RepartitionByExpression [_row" in stats
    parts = plan(window.nested_arrow(points.coalesce(1), raster, [100], ["span"], ["b1"]))
    assert "FlatMapGroupsInArrow" not in parts and "RepartitionByExpression [_row" in parts


def test_reducers_in_parts_work_where_the_windows_are(spark, raster, points, own_reducers):
    """Windows are never the broadcast side of their join with the tiles."""
    plan = window.nested_arrow(points, raster, [60], ["span"], ["b1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Join Inner" not in plan


def test_tallies_equal_numpy():
    from terrasample import queries

    r = np.random.default_rng(7)
    for top in (1, 2, 40):
        v, w = (r.integers(-top, top, r.integers(1, 300)).astype(float) for _ in range(2))
        plain = lambda x: np.stack(np.unique(x, return_counts=True), 1).ravel().tolist()
        assert queries._tallied(v).tolist() == plain(v)
        assert queries._added(queries._tallied(v), queries._tallied(w)).tolist() == plain(np.concatenate((v, w)))


def test_approximate_quantiles_are_within_their_error(spark, capfd):
    """Ranks of what is found against those wanted, on windows of some ten thousand values; few values give one of them."""
    v = np.random.default_rng(5).gamma(2.0, 50.0, (1, 200, 200))
    v[0, :50, :50] = np.nan
    r = make(spark, v, size=32)
    at = spark.createDataFrame([(0, 1000.0, 1000.0), (1, 1500.0, 700.0), (2, 250.0, 250.0), (3, 525.0, 525.0)], "_row long, x double, y double")
    names = ["median", "q05", "q90", "mean"]
    wide = window.nested_stats(at, r, [40, 1900], names, ["b1"], approximate=True)
    got, exact = ({x["_row"]: x for x in d.collect()} for d in (wide, window.nested_stats(at, r, [40, 1900], names, ["b1"])))
    for row, x, y in ((0, 1000.0, 1000.0), (1, 1500.0, 700.0), (3, 525.0, 525.0)):
        for w, side in (("w0", 40), ("w1", 1900)):
            own = np.sort(inside(v, x, y, side)[0].ravel())
            own = own[~np.isnan(own)]
            for n, q in (("median", 0.5), ("q05", 0.05), ("q90", 0.9)):
                found = got[row][w][f"b1.{n}"]
                assert found in own and abs(np.searchsorted(own, found) / len(own) - q) <= 0.005 + 1 / len(own)
            assert got[row][w]["b1.mean"] == pytest.approx(exact[row][w]["b1.mean"]) and got[row][w]["n_pixels"] == exact[row][w]["n_pixels"]
    assert got[2]["w0"]["b1.median"] is None and got[2]["w1"]["b1.median"] is not None
    wide.explain()
    plan = capfd.readouterr().out
    before = plan.split("Exchange")[1]  # below the shuffle: sketches are made where the pixels are
    assert "partial_kll_sketch_agg_double" in before and "percentile" not in plan


def test_quantiles_are_exact_unless_asked(spark, raster, tmp_path):
    import terrasample

    df = spark.createDataFrame([("a", 85.0, 25.0)], "occurrenceID string, decimalLatitude double, decimalLongitude double")
    run = lambda **more: terrasample.extract(
        df, {"datasets": ["r"], "settings": {"output_type": "tabular", "statistics": ["median"], "window_size_m": 45, "output_file_format": "dataframe", **more}},
        rasters={"r": raster.select(["b1"])}, output_dir=str(tmp_path), quiet=True
    ).first()["r_median_45m"]
    assert run() == run(quantiles="exact") and run(quantiles="approximate") is not None
    with pytest.raises(ValueError, match="quantiles"):
        run(quantiles="fast")


@pytest.mark.parametrize("bands", [["b1"], ["b1", "b2"]])
@pytest.mark.parametrize("coverage", ["touched", "geometric"])
def test_sums_of_windows_equal_their_pixels(spark, values, points, bands, coverage):
    """Large, near values (squares would cancel), windows of less than a tile up to more than the raster."""
    r = make(spark, values + 1e6, size=8).select(bands)
    sides, names = [20, 45, 200, 370, 2000], list(prefix.SUMS)
    got = {x["_row"]: x for x in prefix.window_sums(points, prefix.summed(r, bands), sides, names, coverage).collect()}
    want = {x["_row"]: x for x in window.nested_stats(points, r, sides, names, bands, coverage).collect()}
    assert got.keys() == want.keys()
    for row, x in want.items():
        for w in (f"w{k}" for k in range(len(sides))):
            a, b = got[row][w].asDict(), x[w].asDict()
            assert a.keys() == b.keys()
            assert all(a[c] == pytest.approx(b[c], rel=1e-12, abs=1e-7) if isinstance(b[c], float) else a[c] == b[c] for c in b), (row, w)


def test_turned_windows_go_by_their_pixels_and_straight_ones_by_sums(spark, values):
    at = spark.createDataFrame([(0, 62.998, 18.004), (1, 62.9961, 18.0081), (2, 10.0, 10.0)], "_row long, lat double, lon double")
    for r in (make(spark, values, a=0.0002, e=-0.0001, c=18.0, f=63.0, crs=4326), make(spark, values, c=348000.0, f=6990000.0, e=-10.0, crs=32634)):
        sides, names = [60, 130], ["mean", "count"]
        got = {x["_row"]: x for x in prefix.window_sums(at, prefix.summed(r, ["b1"]), sides, names).collect()}
        for x in window.nested_stats(at, r, sides, names, ["b1"]).collect():
            for w in ("w0", "w1"):
                assert all(v == pytest.approx(got[x["_row"]][w][c], nan_ok=True) if v is not None else got[x["_row"]][w][c] is None for c, v in x[w].asDict().items())
    with pytest.raises(ValueError, match="median"):
        prefix.window_sums(at, prefix.summed(r, ["b1"]), [60], ["median"])


def test_a_large_window_reads_arrays_at_its_border_only(spark):
    v = np.random.default_rng(9).random((1, 240, 240))
    r = make(spark, v, size=8)
    s = prefix.summed(r, ["b1"])
    at = spark.createDataFrame([(0, 1200.0, 1203.0)], "_row long, x double, y double")
    got = prefix.window_sums(at, s, [2000], ["sum", "count"]).first()["w0"]
    own = inside(v, 1200.0, 1203.0, 2000)[0]
    assert got["b1.count"] == own.size and got["b1.sum"] == pytest.approx(own.sum(), rel=1e-12)
    # 26 x 26 tiles are touched; those within give a row of totals each, only the border's arrays are joined
    assert s.totals.count() == s.areas.count() == 900 and set(s.totals.dtypes) == {("tile_row", "int"), ("tile_col", "int"), ("n", "bigint"), ("b1|s", "double"), ("b1|q", "double")}
