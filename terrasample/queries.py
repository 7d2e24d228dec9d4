"""Queries over the given tables, each with SQL that DuckDB can run on the same tables.

The tables hold no rasters; ``part`` is read as one (50 columns of 10 m pixels by
key, nodata where p_size is 1) and ``customer`` as points on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.functions import crs, dates, grid, reducers
from terrasample.operators import asof, prefix, qc, terrain, window
from terrasample.plans import catalog
from terrasample.sources import geotiff, sinks, store
from terrasample.sources import points as point_source
from terrasample.sources.raster import Raster, pixels_of_tiles, tiles_of_pixels
from terrasample.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
COLUMNS = 50
TILE = 32


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_pixels(spark: SparkSession, d: str) -> DataFrame:
    """r, c, b1 (price, null where size is 1), b2 (size), b3 (key modulo 7)."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / COLUMNS).cast("int").alias("r"), (k % COLUMNS).cast("int").alias("c"),
        F.when(F.col("p_size") != 1, F.col("p_retailprice")).alias("b1"), F.col("p_size").cast("double").alias("b2"),
        (k % 7).cast("double").alias("b3")
    )


def part_raster(spark: SparkSession, d: str, bands: tuple[str, ...] = ("b1",), crs_code: int | None = None) -> Raster:
    n = table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    header = grid.Header(COLUMNS, -(-n // COLUMNS), 10.0, 10.0, bands=bands, nodata=(None,) * len(bands), crs=crs_code)
    return Raster(header, tiles_of_pixels(part_pixels(spark, d).select("r", "c", *bands), header, TILE), TILE)


def customer_points(spark: SparkSession, d: str, raster: Raster) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("_row"), ((k * 37) % (10 * COLUMNS)).cast("double").alias("x"),
        ((k * 53) % (10 * raster.header.height)).cast("double").alias("y")
    )


# SQL pieces: the raster, the points, and the pixels of each point's window (half-open in pixel centres).
_PX = """px as (select cast(floor(p_partkey / 50) as int) as r, cast(p_partkey % 50 as int) as c,
  case when p_size <> 1 then p_retailprice end as b1, p_size::double as b2, (p_partkey % 7)::double as b3 from part),
hd as (select cast(ceil((max(p_partkey) + 1) / 50.0) as bigint) as rows from part),
pe as (select c_custkey as id, ((c_custkey * 37) % 180)::double as x, ((c_custkey * 53) % 90)::double as y, n_name as name from customer join nation on n_nationkey = c_nationkey),
pt as (select c_custkey as id, ((c_custkey * 37) % 500)::double as x, ((c_custkey * 53) % (10 * (select rows from hd)))::double as y from customer)"""


def _win(w: int, cond: str = "true", size: int = 10, points: str = "pt") -> str:
    h = w / 2
    touched = lambda c, n: f"greatest(least(ceil(({c} + {h}) / {size}) - 1, {n}) - greatest(floor(({c} - {h}) / {size}), 0) + 1, 0)"
    rows = "(select rows from hd) - 1"
    return f"""with {_PX},
rng as (select id, x, y,
  greatest(ceil((y - {h}) / {size} - 0.5), 0) as r0, least(ceil((y + {h}) / {size} - 0.5) - 1, {rows}) as r1,
  greatest(ceil((x - {h}) / {size} - 0.5), 0) as c0, least(ceil((x + {h}) / {size} - 0.5) - 1, 49) as c1,
  {touched("y", rows)} * {touched("x", "49")} as total from {points}),
ids as (select id, total, unnest(range(r0::bigint, r1::bigint + 1)) as r, c0, c1 from rng),
idc as (select id, total, r, unnest(range(c0::bigint, c1::bigint + 1)) as c from ids),
w as (select idc.id, total, b1, b2, b3 from idc join px on px.r = idc.r and px.c = idc.c where {cond})
"""


def _stats(spark: SparkSession, d: str, names: list[str], w: int = 100, bands: tuple[str, ...] = ("b1",)) -> DataFrame:
    raster = part_raster(spark, d, bands)
    return window.window_stats(customer_points(spark, d, raster), raster, w, names, list(bands)).withColumnRenamed("_row", "id")


def _exact(c: str) -> str:
    return f"rint(`{c}` * 1e5) / 1e5"


def _grouped(select: str, w: int = 100) -> str:
    return _win(w) + f"select pt.id, {select} from pt left join w on w.id = pt.id group by pt.id"


@query(_grouped("count(b2) as n_pixels, round_even(avg(b2) * 1e5, 0) / 1e5 as mean"))
def window_mean(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["mean"], bands=("b2",)).select("id", "n_pixels", F.expr(_exact("b2.mean")).alias("mean"))


@query(_grouped("median(b1) as median"))
def window_median(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["median"]).select("id", F.col("`b1.median`").alias("median"))


@query(_grouped("min(b1) as min_value, max(b1) as max_value"))
def window_min_max(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["min", "max"]).select("id", F.col("`b1.min`").alias("min_value"), F.col("`b1.max`").alias("max_value"))


@query(_grouped("sum(b2) as total_size"))
def window_sum(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["sum"], bands=("b2",)).select("id", F.col("`b2.sum`").alias("total_size"))


@query(_grouped("round_even(stddev_samp(b2) * 1e5, 0) / 1e5 as std, round_even(var_samp(b2) * 1e5, 0) / 1e5 as var"))
def window_std_var(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["std", "var"], bands=("b2",)).select("id", F.expr(_exact("b2.std")).alias("std"), F.expr(_exact("b2.var")).alias("var"))


@query(_grouped("nullif(count(b1), 0) as n"))
def window_count(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["count"]).select("id", F.col("`b1.count`").alias("n"))


@query(
    _win(100) + "select id, arg_max(b2, struct_pack(n := n, v := -b2)) as mode from (select id, b2, count(*) as n from w group by id, b2) group by id"
)
def window_mode(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["mode"], bands=("b2",)).select("id", F.col("`b2.mode`").alias("mode"))


@query(_grouped(", ".join(f"round_even(quantile_cont(b2, {q}) * 1e5, 0) / 1e5 as {n}" for n, q in reducers.QUANTILES.items())))
def window_quantiles(spark: SparkSession, d: str) -> DataFrame:
    names = list(reducers.QUANTILES)
    return _stats(spark, d, names, bands=("b2",)).select("id", *(F.expr(_exact(f"b2.{n}")).alias(n) for n in names))


def _classes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    raster = part_raster(spark, d, ("b3",))
    out = window.window_classes(customer_points(spark, d, raster), raster, 100, [kind], ["b3"])
    return out.toDF("id", *(c.split(".", 1)[1] for c in out.columns[1:]))


@query(_win(100) + "select id, " + ", ".join(f"count(*) filter (where b3 = {k}) as class_{k}_count" for k in range(7)) + " from w group by id")
def class_count(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d, "class_count")


@query(
    _win(100) + "select id, " + ", ".join(
        f"count(*) filter (where b3 = {k}) / count(b3) as class_{k}_fraction" for k in range(7)
    ) + " from w group by id"
)
def class_fraction(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d, "class_fraction")


_POINT = f"with {_PX} select pt.id, b1 as point_b1, b2 as point_b2, coalesce(b1 is not null or b2 is not null, false) as in_extent from pt left join px on px.r = floor(y / 10) and px.c = floor(x / 10)"


@query(f"with {_PX} select pt.id, b1 as point from pt left join px on px.r = floor(y / 10) and px.c = floor(x / 10)")
def point_sample(spark: SparkSession, d: str) -> DataFrame:
    raster = part_raster(spark, d)
    return window.point_sample(customer_points(spark, d, raster), raster, ["b1"]).select(
        F.col("_row").alias("id"), F.col("`b1.point`").alias("point")
    )


@query(_POINT)
def point_multiband(spark: SparkSession, d: str) -> DataFrame:
    raster = part_raster(spark, d, ("b1", "b2"))
    return window.point_sample(customer_points(spark, d, raster), raster, ["b1", "b2"]).select(
        F.col("_row").alias("id"), F.col("`b1.point`").alias("point_b1"), F.col("`b2.point`").alias("point_b2"),
        "in_extent"
    )


@query(
    _win(
        100, "b1 is not null and b2 is not null and b3 is not null"
    ) + "select pt.id, count(b1) as n_pixels, max(b1) as b1_max, min(b2) as b2_min, sum(b3) as b3_sum from pt left join w on w.id = pt.id group by pt.id"
)
def multiband_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d, ["max", "min", "sum"], bands=("b1", "b2", "b3"))
    return s.select("id", "n_pixels", F.col("`b1.max`").alias("b1_max"), F.col("`b2.min`").alias("b2_min"), F.col("`b3.sum`").alias("b3_sum"))


_SIDES = (20, 50, 100, 200, 300)
_NESTED = " union all ".join(
    f"select * from (" + _win(w) + f"select pt.id, {w} as window_m, count(b1) as n_pixels, max(b1) as max_value, median(b1) as median, round_even(quantile_cont(b1, 0.9) * 1e5, 0) / 1e5 as q90 from pt left join w on w.id = pt.id group by pt.id)" for w in _SIDES
)


@query(_NESTED)
def multi_window(spark: SparkSession, d: str) -> DataFrame:
    """Five windows around each point out of one reading of the tiles."""
    raster = part_raster(spark, d)
    wide = window.nested_stats(customer_points(spark, d, raster), raster, list(_SIDES), ["max", "median", "q90"], ["b1"])
    each = F.array(*(
        F.struct(F.lit(w).alias("window_m"), *(F.col(f"w{k}.`{c}`").alias(n) for c, n in (("n_pixels", "n_pixels"), ("b1.max", "max_value"), ("b1.median", "median"), ("b1.q90", "q90"))))
        for k, w in enumerate(_SIDES)
    ))
    return wide.select(F.col("_row").alias("id"), F.inline(each)).withColumn("q90", F.expr(_exact("q90")))


_SUMMED = " union all ".join(
    "select * from (" + _win(w) + f"select pt.id, {w} as window_m, count(b2) as n_pixels, sum(b2) as total_size, round_even(avg(b2) * 1e5, 0) / 1e5 as mean, round_even(var_samp(b2) * 1e5, 0) / 1e5 as var from pt left join w on w.id = pt.id group by pt.id)"
    for w in (50, 300)
)


@query(_SUMMED)
def window_sums(spark: SparkSession, d: str) -> DataFrame:
    """Windows out of running sums at their border and whole tiles' totals."""
    n = table(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1
    header = grid.Header(COLUMNS, -(-n // COLUMNS), 10.0, 10.0, bands=("b2",), nodata=(None,))
    raster = Raster(header, tiles_of_pixels(part_pixels(spark, d).select("r", "c", "b2"), header, 8), 8)
    wide = prefix.window_sums(customer_points(spark, d, raster), prefix.summed(raster, ["b2"]), [50, 300], ["sum", "mean", "var"])
    each = F.array(*(
        F.struct(F.lit(w).alias("window_m"), *(F.col(f"w{k}.`{c}`").alias(m) for c, m in (("n_pixels", "n_pixels"), ("b2.sum", "total_size"), ("b2.mean", "mean"), ("b2.var", "var"))))
        for k, w in enumerate((50, 300))
    ))
    out = wide.select(F.col("_row").alias("id"), F.inline(each))
    return out.select("id", "window_m", "n_pixels", F.rint("total_size").alias("total_size"), F.expr(_exact("mean")).alias("mean"), F.expr(_exact("var")).alias("var"))


def _tallied(v):
    import numpy as np

    v = np.sort(v)
    new = np.ones(v.size, bool)
    np.not_equal(v[1:], v[:-1], out=new[:-1])
    last = new.nonzero()[0]
    state = np.empty((last.size, 2))
    state[:, 0] = v[last]
    state[0, 1] = last[0] + 1
    np.subtract(last[1:], last[:-1], out=state[1:, 1])
    return state.ravel()


def _added(a, b):
    import numpy as np

    pairs = np.concatenate((a, b)).reshape(-1, 2)
    pairs = pairs.take(pairs[:, 0].argsort(), 0)
    new = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:, 0], pairs[:-1, 0], out=new[1:])
    first = new.nonzero()[0]
    state = pairs.take(first, 0)
    np.add.reduceat(pairs[:, 1], first, out=state[:, 1])
    return state.ravel()


def _entropy(state):
    import numpy as np

    share = state[1::2] / state[1::2].sum()
    return -(share * np.log(share)).sum()


#: Shannon's entropy of a window's classes, from tallies of its values.
ENTROPY = reducers.ArrowReducer(_tallied, _added, _entropy)


@query(_win(200) + ", t as (select id, b2, count(*) as n from w where b2 is not null group by id, b2), p as (select id, n / sum(n) over (partition by id) as p from t) select id, round(-sum(p * ln(p)), 6) + 0.0 as entropy from p group by id")
def window_entropy(spark: SparkSession, d: str) -> DataFrame:
    """A reducer of the caller's own, in parts: tallies by tile, merged by window."""
    if not reducers.arrow_reducer("entropy"):
        reducers.register_arrow_reducer("entropy", ENTROPY)
    raster = part_raster(spark, d, ("b2",))
    found = window.nested_arrow(customer_points(spark, d, raster), raster, [200], ["entropy"], ["b2"])
    return found.select(F.col("_row").alias("id"), (F.round(F.col("w0.`b2.entropy`"), 6) + 0.0).alias("entropy"))


_QC = _win(100) + """select rng.id, rng.total::bigint as total, count(b1) as n_pixels, rng.total > 0 as in_extent, rng.total > 0 and count(b1) < rng.total as had_nodata,
  case when rng.total > 0 then least(count(b1) * 100.0::double / rng.total, 100) else 0 end as coverage_pct from rng left join w on w.id = rng.id group by rng.id, rng.total"""


@query(_QC)
def qc_flags(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d, ["count"]).select("id", "total", "n_pixels", "in_extent", "had_nodata", "coverage_pct")


@query(
    _win(
        100, "b1 is not null and b2 is not null"
    ) + "select rng.id, round_even(count(b1) * 10000.0::double / rng.total, 0) / 100 as b1_pct, round_even(count(b2) * 10000.0::double / rng.total, 0) / 100 as b2_pct from rng left join w on w.id = rng.id group by rng.id, rng.total"
)
def qc_band_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d, ["count"], bands=("b1", "b2"))
    return s.select("id", *(qc.band_coverage(F.col(f"`{b}.n_valid`"), F.col("total")).alias(f"{b}_pct") for b in ("b1", "b2")))


@query(
    f"with q as ({_QC}) select count(*) filter (where coverage_pct = 0) as n_no_data, count(*) filter (where coverage_pct > 0 and coverage_pct < 100) as n_partial, count(*) filter (where coverage_pct >= 100) as n_full from q"
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return qc.coverage_summary(qc_flags(spark, d))


# Coordinates from events: lat 55 to 67.87, lon 12 to 23.9.
_LL = "ll as (select event_id as id, 55 + (user_id % 100) * 0.13::double as lat, 12 + (event_id % 120) * 0.1::double as lon from events)"


def event_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), (55 + (F.col("user_id") % 100) * F.lit(0.13)).alias("lat"),
        (12 + (F.col("event_id") % 120) * F.lit(0.1)).alias("lon")
    )


def _utm_sql() -> str:
    s = lambda terms: " + ".join(terms)
    east = s(f"({a!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    north = s(f"({a!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    return f"""{_LL},
z as (select *, least(cast(floor((lon + 180) / 6) as int) + 1, 60) as zone from ll),
t0 as (select *, sin(radians(lat)) as sp, radians(lon - (zone * 6 - 183)) as dl from z),
t1 as (select *, sinh(atanh(sp) - {crs.ECC!r} * atanh({crs.ECC!r} * sp)) as t from t0),
t2 as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t1),
utm as (select id, lat, lon, zone, 500000 + {crs.K0 * crs.RADIUS!r} * (eta + {east}) as e, {crs.K0 * crs.RADIUS!r} * (xi + {north}) as n from t2)"""


@query(f"with {_utm_sql()} select id, 32600 + zone as epsg, round(e, 2) as east, round(n, 2) as north from utm")
def utm_forward(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    e, n = crs.utm_forward(F.col("lat"), F.col("lon"))
    return p.select("id", crs.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"), F.round(e, 2).alias("east"), F.round(n, 2).alias("north"))


@query(f"with {_LL} select id, round(lat, 6) as lat, round(lon, 6) as lon from ll")
def utm_inverse(spark: SparkSession, d: str) -> DataFrame:
    """There and back again gives the coordinates."""
    p = event_points(spark, d)
    code = crs.utm_epsg(F.col("lat"), F.col("lon"))
    e, n = crs.utm_forward(F.col("lat"), F.col("lon"))
    lat, lon = crs.utm_inverse(e, n, code)
    return p.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(
    f"with {_LL} select id, cast(least(floor((lon + 180) / 6) + 1, 60) as int)::varchar || case when lat >= 0 then 'N' else 'S' end as zone from ll"
)
def utm_zone_label(spark: SparkSession, d: str) -> DataFrame:
    return event_points(spark, d).select("id", crs.utm_zone_label(F.col("lat"), F.col("lon")).alias("zone"))


@query(f"with {_LL} select distinct 32600 + cast(least(floor((lon + 180) / 6) + 1, 60) as int) as epsg from ll")
def tile_zones(spark: SparkSession, d: str) -> DataFrame:
    return crs.zones(event_points(spark, d))


@query(
    f"with {_utm_sql()} select id, round(degrees(2 * atan(exp(y / 6378137)) - pi() / 2), 6) as lat, round(degrees(x / 6378137), 6) as lon, round(x, 2) as x, round(y, 2) as y from (select id, radians(lon) * 6378137 as x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 as y from ll)"
)
def crs_reproject(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    x, y = crs.mercator_forward(F.col("lat"), F.col("lon"))
    lat, lon = crs.mercator_inverse(x, y)
    return p.select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query(f"with {_LL} select count(*) as n, count(*) filter (where abs(lat * 1.4) > 90 or abs(lon * 8) > 180) as n_bad from ll")
def coordinate_validate(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d).withColumns({"lat": F.col("lat") * 1.4, "lon": F.col("lon") * 8})
    return p.agg(F.count("*").alias("n"), F.count_if(point_source.out_of_range()).alias("n_bad"))


# Image collection: the months of the orders; sample dates: ship dates moved back and forth.
_IM = "im as (select distinct date_trunc('month', o_orderdate)::date as s from orders), dt as (select l_orderkey, l_linenumber, (l_shipdate::date - (l_linenumber * 60)::int) as d from lineitem)"


def month_images(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("time_start")).distinct()
    return m.select(F.date_format("time_start", "yyyyMM").alias("image_id"), "time_start", F.lit(None).cast("date").alias("time_end"))


def ship_dates(spark: SparkSession, d: str, *extra: Column) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *extra,
        F.date_sub(F.to_date("l_shipdate"), (F.col("l_linenumber") * 60).cast("int")).alias("date")
    )


def _asof_out(m: DataFrame) -> DataFrame:
    return m.select(
        "l_orderkey", "l_linenumber", "image_id", F.date_format("image_time_start", "yyyy-MM-dd").alias("start_day"),
        "date_clamped", "date_source"
    )


_NEAR = f"with {_IM}, b as (select min(s) as lo, max(s) as hi from im), u as (select distinct d from dt), pick as (select d, arg_min(s, struct_pack(gap := abs(d - s), late := -(s - date '1970-01-01'))) as s from u, im group by d) "


@query(
    _NEAR + "select l_orderkey, l_linenumber, strftime(p.s, '%Y%m') as image_id, strftime(p.s, '%Y-%m-%d') as start_day, dt.d < lo or dt.d > hi as date_clamped, case when dt.d < lo or dt.d > hi then 'clamped_to_nearest' else 'nearest_to_sample' end as date_source from dt join pick p on p.d = dt.d, b"
)
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _asof_out(asof.match_images(ship_dates(spark, d), month_images(spark, d), "nearest"))


@query(
    f"with {_IM}, b as (select min(s) as lo, max(s) as hi from im), u as (select distinct d from dt), pick as (select d, coalesce(max(s) filter (where s <= d), min(s)) as s from u, im group by d) select l_orderkey, l_linenumber, strftime(p.s, '%Y%m') as image_id, strftime(p.s, '%Y-%m-%d') as start_day, dt.d <= lo or dt.d >= hi as date_clamped, case when dt.d <= lo or dt.d >= hi then 'clamped_to_nearest' else 'contains_sample_date' end as date_source from dt join pick p on p.d = dt.d, b"
)
def asof_contains(spark: SparkSession, d: str) -> DataFrame:
    return _asof_out(asof.match_images(ship_dates(spark, d), month_images(spark, d), "contains"))


@query(
    f"with {_IM} select l_orderkey, l_linenumber, strftime((select max(s) from im), '%Y%m') as image_id, 'most_recent_no_date' as date_source from dt"
)
def asof_no_date(spark: SparkSession, d: str) -> DataFrame:
    return asof.match_images(
        ship_dates(spark, d).withColumn("date", F.lit(None).cast("date")), month_images(spark, d)
    ).select("l_orderkey", "l_linenumber", "image_id", "date_source")


@query(
    "select l_orderkey, l_linenumber, cast(null as varchar) as image_id, false as date_clamped, cast(null as varchar) as date_source from lineitem"
)
def asof_undated(spark: SparkSession, d: str) -> DataFrame:
    """A collection without start times matches nothing, and all rows stay."""
    images = month_images(spark, d).withColumn("time_start", F.lit(None).cast("date"))
    return asof.match_images(ship_dates(spark, d), images).select("l_orderkey", "l_linenumber", "image_id", "date_clamped", "date_source")


@query("""with im as (select distinct date_trunc('month', o_orderdate)::date as s, o_orderstatus as k from orders),
 dt as (select l_orderkey, l_linenumber, l_linestatus as k, (l_shipdate::date - (l_linenumber * 60)::int) as d from lineitem), u as (select distinct k, d from dt),
 pick as (select u.k, d, coalesce(max(s) filter (where s <= d), min(s)) as s from u join im on im.k = u.k group by all)
select l_orderkey, l_linenumber, strftime(p.s, '%Y-%m-%d') as start_day from dt left join pick p on p.d = dt.d and p.k = dt.k""")
def asof_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows matched within their own key, as tiles of a collection by their zone."""
    images = table(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), F.trunc("o_orderdate", "month").alias("time_start")).distinct()
    images = images.select("k", F.date_format("time_start", "yyyyMM").alias("image_id"), "time_start", F.lit(None).cast("date").alias("time_end"))
    rows = ship_dates(spark, d, F.col("l_linestatus").alias("k"))
    m = asof.match_images(rows, images, "contains", keys=("k",))
    return m.select("l_orderkey", "l_linenumber", F.date_format("image_time_start", "yyyy-MM-dd").alias("start_day"))


@query(
    _NEAR + "select count(*) filter (where not (dt.d < lo or dt.d > hi)) as n_nearest_to_sample, count(*) filter (where dt.d < lo or dt.d > hi) as n_clamped_to_nearest, count(distinct p.s) as n_ranges from dt join pick p on p.d = dt.d, b"
)
def date_info_summary(spark: SparkSession, d: str) -> DataFrame:
    m = asof.match_images(ship_dates(spark, d), month_images(spark, d), "nearest")
    return asof.date_info(m).select("n_nearest_to_sample", "n_clamped_to_nearest", F.size("image_date_ranges_used").cast("bigint").alias("n_ranges"))


# Images with footprints: suppliers; every fourth is wide, every ninth crosses the antimeridian.
_FEET = f"""with {_LL}, raw as (select s_suppkey::varchar as i, s_suppkey as k, date '2024-01-01' + ((s_suppkey * 17) % 400)::int as s, 12 + s_suppkey % 10 + 0.05::double as w, 55 + s_suppkey % 12 + 0.05::double as south from supplier),
 im as (select i, s, south, case when k % 9 = 0 then 150 + w else w end as west, case when k % 9 = 0 then w - 170 when k % 4 = 0 then w + 30 else w + 2.5 end as east, case when k % 4 = 0 then 85 else south + 1.5 end as north from raw),
 pt as (select ll.id, lat, case when ll.id % 5 = 0 then case when lon < 18 then lon + 160 else lon - 198 end else lon end as lon, ts::date as d from ll join events on event_id = ll.id),
 held as (select pt.id, d, i, s from pt join im on lat between south and north and (case when west <= east then lon between west and east else lon >= west or lon <= east end)),
 span as (select id, d, min(s) as lo, max(s) as hi from held group by id, d)"""


def supplier_images(spark: SparkSession, d: str) -> DataFrame:
    """A collection with footprints, narrow, wide and across the antimeridian."""
    k = F.col("s_suppkey")
    images = table(spark, d, "supplier").select(
        k.alias("k"), k.cast("string").alias("image_id"), F.date_add(F.lit("2024-01-01").cast("date"), ((k * 17) % 400).cast("int")).alias("time_start"),
        F.lit(None).cast("date").alias("time_end"), (12 + k % 10 + F.lit(0.05)).alias("w"), (55 + k % 12 + F.lit(0.05)).alias("south"),
    )
    far, wide, w = F.col("k") % 9 == 0, F.col("k") % 4 == 0, F.col("w")
    images = images.withColumns({"west": F.when(far, w + 150).otherwise(w), "east": F.when(far, w - 170).when(wide, w + 30).otherwise(w + 2.5)})
    return images.withColumn("north", F.when(wide, F.lit(85.0)).otherwise(F.col("south") + 1.5)).drop("k", "w")


def dated_points(spark: SparkSession, d: str) -> DataFrame:
    dated = table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("date"))
    lon = F.when(F.col("id") % 5 == 0, F.when(F.col("lon") < 18, F.col("lon") + 160).otherwise(F.col("lon") - 198)).otherwise(F.col("lon"))
    return event_points(spark, d).join(dated, "id").withColumn("lon", lon).withColumnRenamed("id", "_row")


def _covering_out(m: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(f"image_time_{c}", "yyyy-MM-dd").alias(f"{c}_day")
    return m.select(F.col("_row").alias("id"), "image_id", day("start"), day("end"), "date_clamped", "date_source")


@query(_FEET + """, pick as (select id, arg_min(i, struct_pack(gap := abs(d - s), late := -(s - date '1970-01-01'), i := i)) as i, arg_min(s, struct_pack(gap := abs(d - s), late := -(s - date '1970-01-01'), i := i)) as s from held group by id)
select pt.id, p.i as image_id, strftime(p.s, '%Y-%m-%d') as start_day, null::varchar as end_day, coalesce(pt.d < lo or pt.d > hi, false) as date_clamped,
 case when lo is null then null when pt.d < lo or pt.d > hi then 'clamped_to_nearest' else 'nearest_to_sample' end as date_source from pt left join span on span.id = pt.id left join pick p on p.id = pt.id""")
def asof_covering(spark: SparkSession, d: str) -> DataFrame:
    """Points matched among the images whose footprint holds them, with what is known of the match."""
    return _covering_out(asof.match_covering(dated_points(spark, d), supplier_images(spark, d)))


@query(_FEET + """, upto as (select held.id, held.d, lo, coalesce(max(s) filter (where s <= held.d), lo) as s from held join span on span.id = held.id group by held.id, held.d, lo),
 pick as (select u.id, u.s, max(i) filter (where held.s = u.s) as i, min(held.s) filter (where held.s > u.s) as after from upto u join held on held.id = u.id group by u.id, u.s)
select pt.id, p.i as image_id, strftime(p.s, '%Y-%m-%d') as start_day, strftime(coalesce(after, p.s + 1), '%Y-%m-%d') as end_day, coalesce(pt.d <= lo or pt.d >= hi, false) as date_clamped,
 case when lo is null then null when pt.d <= lo or pt.d >= hi then 'clamped_to_nearest' else 'contains_sample_date' end as date_source from pt left join span on span.id = pt.id left join pick p on p.id = pt.id""")
def asof_covering_contains(spark: SparkSession, d: str) -> DataFrame:
    return _covering_out(asof.match_covering(dated_points(spark, d), supplier_images(spark, d), "contains"))


# Many images a day: the events of one kind, in epoch milliseconds; asked are the times of all events, eleven minutes on.
_TIMES = """with im as (select distinct epoch_us(ts) // 1000 as ms from events where event_type = 'purchase'),
 q as (select event_id, ts + interval 11 minute as t, epoch_us(ts + interval 11 minute) as us from events), b as (select min(ms) * 1000 as lo, max(ms) * 1000 as hi from im)"""


def purchase_images(spark: SparkSession, d: str) -> DataFrame:
    ms = F.floor(F.unix_micros("ts") / 1000)
    found = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("event_type = 'purchase'").select(ms.alias("time_start")).distinct()
    return found.select(F.col("time_start").cast("string").alias("image_id"), "time_start", F.lit(None).cast("bigint").alias("time_end"))


def _timed(spark: SparkSession, d: str, policy: str) -> DataFrame:
    asked = table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp") + F.expr("interval 11 minutes")).alias("t"))
    m = asof.match_images(asked, purchase_images(spark, d), policy, "t")
    return m.select("event_id", "image_id", F.unix_micros("image_time_start").alias("start_us"), F.unix_micros("image_time_end").alias("end_us"), "date_clamped", "date_source")


@query(_TIMES + """, prev as (select event_id, us, ms * 1000 as p from q asof left join im on q.us >= im.ms * 1000),
 near as (select prev.event_id, prev.us, p, ms * 1000 as n from prev asof left join im on prev.us < im.ms * 1000), pick as (select *, case when p is null or n - us <= us - p then coalesce(n, p) else p end as s from near)
select event_id, (s // 1000)::varchar as image_id, s as start_us, null::bigint as end_us, us < lo or us > hi as date_clamped, case when us < lo or us > hi then 'clamped_to_nearest' else 'nearest_to_sample' end as date_source from pick, b""")
def asof_timestamp(spark: SparkSession, d: str) -> DataFrame:
    """The nearest image by time of day."""
    return _timed(spark, d, "nearest")


@query(_TIMES + """, prev as (select event_id, us, ms * 1000 as p from q asof left join im on q.us >= im.ms * 1000),
 pick as (select event_id, us, coalesce(p, lo) as s from prev, b), near as (select pick.*, ms * 1000 as n from pick asof left join im on pick.s < im.ms * 1000)
select event_id, (s // 1000)::varchar as image_id, s as start_us, coalesce(n, s + 86400000000) as end_us, us <= lo or us >= hi as date_clamped, case when us <= lo or us >= hi then 'clamped_to_nearest' else 'contains_sample_date' end as date_source from near, b""")
def asof_timestamp_contains(spark: SparkSession, d: str) -> DataFrame:
    """The last image that began by a time, to its end."""
    return _timed(spark, d, "contains")


_MESSY = "case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m') when 2 then strftime(ts, '%Y') when 3 then strftime(ts, '%Y-%m-%d') || '/' || strftime(ts + interval 3 day, '%Y-%m-%d') else strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' end"


@query(
    "select event_id, case event_id % 5 when 1 then strftime(date_trunc('month', ts), '%Y-%m-%d') when 2 then strftime(date_trunc('year', ts), '%Y-%m-%d') else strftime(ts, '%Y-%m-%d') end as day, event_id % 5 in (1, 2) as incomplete, event_id % 5 = 3 as is_interval, event_id % 5 = 4 as has_time from events"
)
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    ts, k = F.col("ts"), F.col("event_id") % 5
    day = F.date_format(ts, "yyyy-MM-dd")
    messy = F.when(k == 0, day).when(k == 1, F.date_format(ts, "yyyy-MM")).when(k == 2, F.date_format(ts, "yyyy")).when(
        k == 3, F.concat(day, F.lit("/"), F.date_format(F.date_add(ts.cast("date"), 3), "yyyy-MM-dd"))
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    e = table(spark, d, "events").select("event_id", messy.alias("t"))
    t = F.col("t")
    return e.select(
        "event_id", dates.day_text(dates.parse(t)).alias("day"), dates.incomplete(t).alias("incomplete"),
        dates.is_interval(t).alias("is_interval"), dates.has_time(t).alias("has_time")
    )


_ODD = "case event_id % 4 when 0 then 'NaN'::double when 1 then 'Infinity'::double else value end"


@query(
    f"select event_type, count(*) filter (where event_id % 4 > 1) as n_finite, max(value) filter (where event_id % 4 > 1) as top from events group by event_type"
)
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    v = reducers.finite(F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("value")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(v).alias("n_finite"), F.max(v).alias("top"))


@query("select p_brand, count(*) filter (where p_size <> 7) as n_valid, count(*) filter (where p_size = 7) as n_masked from part group by p_brand")
def nodata_mask(spark: SparkSession, d: str) -> DataFrame:
    v = reducers.masked(F.col("p_size"), 7)
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_masked"))


@query("""with im as (select cast(floor(p_partkey / 50) as int) as r, cast(p_partkey % 50 as int) as c, i, case when (p_partkey + i) % 3 <> 0 then p_retailprice + i end as v from part, range(0, 4) t(i))
select r, c, arg_max(v, i) filter (where v is not null) as v from im group by r, c""")
def mosaic(spark: SparkSession, d: str) -> DataFrame:
    px = part_pixels(spark, d).withColumn("k", F.col("r") * COLUMNS + F.col("c")).join(
        table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_retailprice"), "k"
    )
    many = px.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    many = many.select(
        "r", "c", F.col("i").alias("image_id"),
        F.when((F.col("k") + F.col("i")) % 3 != 0, F.col("p_retailprice") + F.col("i")).alias("v")
    )
    images = many.select("image_id").distinct().withColumn("time_start", F.date_add(F.lit("2000-01-01").cast("date"), F.col("image_id")))
    return terrain.mosaic(many, images, ["v"])


_NB = f"""with {_PX}, g as (select px.r, px.c, a.b2 - b.b2 as dx, e.b2 - f.b2 as dy from px left join px a on a.r = px.r and a.c = px.c + 1 left join px b on b.r = px.r and b.c = px.c - 1
 left join px e on e.c = px.c and e.r = px.r + 1 left join px f on f.c = px.c and f.r = px.r - 1) """


@query(_NB + "select r, c, round(degrees(atan(sqrt(pow(dx / 20.0::double, 2) + pow(dy / 20.0::double, 2)))), 6) as slope from g")
def slope(spark: SparkSession, d: str) -> DataFrame:
    header = grid.Header(COLUMNS, 1, 10.0, -10.0)
    return terrain.slope(part_pixels(spark, d), "b2", header).select("r", "c", F.round("slope", 6).alias("slope"))


@query(
    _NB + "select r, c, case when dx <> 0 or dy <> 0 then round(case when t < 0 then t + 360 else t end, 6) + 0.0::double end as aspect from (select *, degrees(atan2(-dx, dy)) as t from g)"
)
def aspect(spark: SparkSession, d: str) -> DataFrame:
    header = grid.Header(COLUMNS, 1, 10.0, -10.0)
    return terrain.aspect(part_pixels(spark, d), "b2", header).select("r", "c", (F.round("aspect", 6) + F.lit(0.0)).alias("aspect"))


def _grid_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("_row"), (100 + (k * 7) % 300).cast("double").alias("x"),
        (30 + (k * 3) % 20).cast("double").alias("y")
    )


_GRID = """gp as (select s_suppkey as id, (100 + (s_suppkey * 7) % 300)::double as x, (30 + (s_suppkey * 3) % 20)::double as y from supplier),
gr as (select id, i, j, round_even(x / 5.0, 0) * 5 - 10 + (j + 0.5) * 5 as gx, round_even(y / 5.0, 0) * 5 + 10 - (i + 0.5) * 5 as gy from gp, range(0, 4) a(i), range(0, 4) b(j))"""


@query(f"with {_GRID} select id, i::int as i, j::int as j, gx::double as gx, gy::double as gy from gr")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return terrain.sample_grid(_grid_points(spark, d), 4, 5.0).withColumnRenamed("_row", "id")


@query(f"""with {_PX}, {_GRID}, f as (select id, i, j, floor(gy / 10 - 0.5) as r0, floor(gx / 10 - 0.5) as c0, gy / 10 - 0.5 - floor(gy / 10 - 0.5) as wr, gx / 10 - 0.5 - floor(gx / 10 - 0.5) as wc from gr),
n as (select id, i, j, r0 + dr as r, c0 + dc as c, (case dr when 1 then wr else 1 - wr end) * (case dc when 1 then wc else 1 - wc end) as w from f, range(0, 2) a(dr), range(0, 2) b(dc))
select id, i::int as i, j::int as j, round(sum(case when b2 is not null then w * b2 end) / nullif(sum(case when b2 is not null then w end), 0), 6) as value from n left join px on px.r = n.r and px.c = n.c group by all""")
def tile_resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    header = grid.Header(COLUMNS, 1, 10.0, 10.0)
    out = terrain.resample(terrain.sample_grid(_grid_points(spark, d), 4, 5.0), part_pixels(spark, d), "b2", header)
    return out.select(F.col("_row").alias("id"), "i", "j", F.round("value", 6).alias("value"))


@query(_win(80).split("w as (")[0].rstrip().rstrip(",") + """
select idc.id, (idc.r - rng.r0)::int as i, (idc.c - rng.c0)::int as j, b1, b2, b3 from idc join rng on rng.id = idc.id join px on px.r = idc.r and px.c = idc.c""")
def tile_multiband(spark: SparkSession, d: str) -> DataFrame:
    """The cells of native tiles with three bands, each with its own missing values."""
    from terrasample.plans.extract import tile_values

    raster = part_raster(spark, d, ("b1", "b2", "b3"))
    z = F.arrays_zip("o", *(F.col("values")[k].alias(f"b{k + 1}") for k in range(3)))
    cells = tile_values(customer_points(spark, d, raster), raster, 80).select(F.col("_row").alias("id"), "width", F.explode(z).alias("z"))
    return cells.select(
        "id", F.floor(F.col("z.o") / F.col("width")).cast("int").alias("i"),
        (F.col("z.o") % F.col("width")).cast("int").alias("j"), "z.b1", "z.b2", "z.b3"
    ).where("b2 is not null")


@query(_win(80).split("ids as (")[0].rstrip().rstrip(",") + """
select id, (c0::int * 10)::double as left_x, (r0::int * 10)::double as top_y, (r1 - r0 + 1)::int as height, (c1 - c0 + 1)::int as width from rng""")
def tile_native_crop(spark: SparkSession, d: str) -> DataFrame:
    """Place and size of each point's block of native pixels."""
    from terrasample.plans.extract import tile_values

    raster = part_raster(spark, d)
    return tile_values(customer_points(spark, d, raster), raster, 80).select(
        F.col("_row").alias("id"), F.col("left").alias("left_x"), F.col("top").alias("top_y"), "height", "width"
    )


@query(_win(80).split("w as (")[0].rstrip().rstrip(",") + """
select idc.id, 2147483647::double as nodata, count(*) - count(b1) as n_missing, sum(floor(b1 + 0.5))::bigint as total from idc left join px on px.r = idc.r and px.c = idc.c group by idc.id""")
def tile_nodata(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of whole numbers written as files and read back: missing cells hold the type's own nodata value."""
    from terrasample.plans.extract import tile_values

    raster = part_raster(spark, d)
    tiles = tile_values(customer_points(spark, d, raster), raster, 80)
    files = geotiff.write_tiles(tiles.withColumn("name", F.col("_row").cast("string")), replace(raster.header, dtype="int32"))
    return geotiff.summary(files).select(
        F.col("name").cast("bigint").alias("id"), "nodata", "n_missing", F.col("total").cast("bigint").alias("total")
    )


@query(
    "select l_orderkey, l_linenumber, floor(l_extendedprice / 30 + 0.5) * 30 as half_up, round_even(l_extendedprice / 30, 0) * 30 as half_even from lineitem"
)
def snap_to_grid(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", grid.snap(x, 30).cast("double").alias("half_up"),
        grid.snap_even(x, 30).alias("half_even")
    )


@query("select l_orderkey, l_linenumber, round_even((l_extendedprice * l_discount / 7) * 1e5, 0) / 1e5 as v from lineitem")
def round_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        reducers.round_half_even(F.col("l_extendedprice") * F.col("l_discount") / 7, 5).alias("v")
    )


@query(f"with {_PX} select r, c, b3 as v from px")
def band_select(spark: SparkSession, d: str) -> DataFrame:
    return pixels_of_tiles(part_raster(spark, d, ("b1", "b2", "b3")).select(["b3"])).select("r", "c", F.col("b3").alias("v")).where("v is not null")


@query("select label, count(*) as n, round(avg(e), 6) as mean_first from (select label, embedding[1]::double as e from embeddings) group by label")
def embedding_band_mean(spark: SparkSession, d: str) -> DataFrame:
    """A band of a many-band table by class."""
    return table(spark, d, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("mean_first")
    )


_EX = _win(100) + """select rng.id as "occurrenceID", rng.y / 1000 as "decimalLatitude", rng.x / 1000 as "decimalLongitude", max(b1) as part_max_100m, median(b1) as part_median_100m, nullif(count(b1), 0) as part_count_100m
from rng left join w on w.id = rng.id group by rng.id, rng.x, rng.y"""


@query(_EX)
def extract_tabular(spark: SparkSession, d: str) -> DataFrame:
    """The window statistics with the naming and rounding of extract(), in the raster's own plane."""
    from terrasample.plans.extract import dataset_columns

    raster = part_raster(spark, d)
    points = customer_points(spark, d, raster)
    cols, stats, _ = dataset_columns(points, raster, "part", ["max", "median", "count"], ["b1"], False, 100)
    return points.join(cols, "_row", "left").select(
        F.col("_row").alias("occurrenceID"), (F.col("y") / 1000).alias("decimalLatitude"),
        (F.col("x") / 1000).alias("decimalLongitude"), *stats
    )


_END = _win(12, size=3, points="pe") + """select pe.id as "occurrenceID", pe.y as "decimalLatitude", pe.x as "decimalLongitude", pe.name as place, round_even(max(w.b1) * 1e5, 0) / 1e5 as part_max_12m, round_even(median(w.b1) * 1e5, 0) / 1e5 as part_median_12m, nullif(count(w.b1), 0)::double as part_count_12m, round_even(max(a.b1) * 1e5, 0) / 1e5 as part_point
from pe left join w on w.id = pe.id left join px a on a.r = floor(pe.y / 3) and a.c = floor(pe.x / 3) group by pe.id, pe.y, pe.x, pe.name"""


@query(_END)
def extract_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """extract() itself, on points that come out of a join."""
    from terrasample.plans.extract import extract

    raster = part_raster(spark, d)
    raster = replace(raster, header=replace(raster.header, a=3.0, e=3.0))
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(
        k.alias("occurrenceID"), ((k * 53) % 90).cast("double").alias("decimalLatitude"),
        ((k * 37) % 180).cast("double").alias("decimalLongitude"), "c_nationkey"
    )
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    settings = {"output_type": "tabular", "statistics": ["max", "median", "count", "point"], "window_size_m": 12, "output_file_format": "dataframe"}
    out = extract(
        points.hint("shuffle_hash").join(nations, "c_nationkey").drop("c_nationkey"),
        {"datasets": ["part"], "settings": settings}, output_dir=shared_folder(spark), rasters={"part": raster},
        write_metadata=False, quiet=True
    )
    return out.withColumn("part_count_12m", F.col("part_count_12m").cast("double"))


_DAYS = ("2020-01-01", "2020-03-01", "2020-06-01")


def collection_scale(rows: int) -> float:
    """What degrees are multiplied by so that blocks of so many rows of 0.25 degrees, from 60 degrees north down, stay on the globe: 1 or a power of two, so that nothing is rounded."""
    scale = 1.0
    while -(-rows // 40) * 10 * scale > 150:
        scale /= 2
    return scale


def write_part_collection(spark: SparkSession, d: str, folder: str, scale: float = 1.0) -> None:
    """``part`` as a collection of GeoTIFF files in degrees: blocks of 40 rows, three days, each day's files further east and their values by 1000 higher.

    ``scale``: see :func:`collection_scale`; longitudes shrink towards 0, latitudes towards 60.
    """
    px = part_pixels(spark, d).select(F.floor(F.col("r") / 40).cast("int").alias("block"), (F.col("r") % 40).alias("r"), "c", "b1")
    each = px.withColumn("j", F.explode(F.array(*(F.lit(j) for j in range(len(_DAYS))))))
    # a file's pixels, 2000 at most
    image = each.groupBy("block", "j").agg(F.array_sort(F.collect_list(F.struct((F.col("r") * COLUMNS + F.col("c")).cast("int").alias("o"), (F.col("b1") + F.col("j") * 1000).alias("v")))).alias("p"))
    days = F.array(*(F.lit(x) for x in _DAYS))
    rows = image.select(
        F.concat(F.lit("block"), F.col("block").cast("string"), F.lit("_"), days[F.col("j")], F.lit(".tif")).alias("name"), F.lit(4326).alias("epsg"),
        ((10.0 + F.col("j") * 1.25) * scale).alias("left"), (60.0 - F.col("block") * 10.0 * scale).alias("top"), F.lit(0.25 * scale).alias("a"), F.lit(-0.25 * scale).alias("e"),
        F.lit(False).alias("turned"),
        F.lit(40).alias("height"), F.lit(COLUMNS).alias("width"), F.col("p.o").alias("o"), F.array(F.col("p.v")).alias("values"),
    )
    header = grid.Header(COLUMNS, 40, 0.25 * scale, -0.25 * scale, crs=4326, nodata=(None,))
    sinks.write_files(geotiff.write_tiles(rows, header), folder).write.format("noop").mode("overwrite").save()


@query("""with px as (select p_partkey // 50 // 40 as block, p_partkey // 50 % 40 as r, p_partkey % 50 as c, case when p_size <> 1 then p_retailprice end as b1 from part),
 im as (select block, j, 'block' || block || '_' || d as image_id, d::date as s, 10 + j * 1.25::double as west, 10 + j * 1.25::double + 12.5 as east, 60 - block * 10.0::double as north from (select distinct block from px), (values (0, '2020-01-01'), (1, '2020-03-01'), (2, '2020-06-01')) t(j, d)),
 pt as (select c_custkey as id, 59.875 - 0.25 * ((c_custkey * 53) % (select ceil((max(p_partkey) + 1) / 50.0)::bigint from part)) as lat, 8.125 + 0.25 * ((c_custkey * 37) % 70) as lon, date '2019-12-20' + ((c_custkey * 11) % 220)::int as d from customer),
 held as (select pt.*, im.* exclude (j), im.j from pt join im on lon between west and east and lat between north - 10 and north),
 span as (select id, min(s) as lo, max(s) as hi from held group by id),
 pick as (select id, arg_min(struct_pack(i := image_id, s := s, block := block, j := j, west := west, north := north), struct_pack(gap := abs(d - s), late := -(s - date '1970-01-01'))) as p from held group by id)
select pt.id as "occurrenceID", pt.lat as "decimalLatitude", pt.lon as "decimalLongitude", strftime(pt.d, '%Y-%m-%d') as "eventDate", px.b1 + 1000 * p.j as part_copy_point
from pt left join pick on pick.id = pt.id left join px on px.block = p.block and px.r = floor((p.north - pt.lat) / 0.25) and px.c = floor((pt.lon - p.west) / 0.25)""")
def extract_collection(spark: SparkSession, d: str) -> DataFrame:
    """extract() of a collection by its catalog entry: the files of a mirrored folder, each point's image by footprint and date.

    The rows of a large ``part`` reach beyond the south pole: files and points are then laid out smaller, and the coordinates brought back.
    """
    from terrasample.plans.extract import extract

    folder = shared_folder(spark)
    rows = table(spark, d, "part").agg(F.max("p_partkey")).first()[0] // COLUMNS + 1
    scale = collection_scale(rows)
    write_part_collection(spark, d, folder, scale)
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(
        k.alias("occurrenceID"), (60.0 - (0.125 + 0.25 * ((k * 53) % rows)) * scale).alias("decimalLatitude"), ((8.125 + 0.25 * ((k * 37) % 70)) * scale).alias("decimalLongitude"),
        F.date_add(F.lit("2019-12-20").cast("date"), ((k * 11) % 220).cast("int")).cast("string").alias("eventDate"),
    )
    catalog.update_catalog({"datasets": {"part_copy": {"data_source": "local", "path": folder, "data_type": "continuous"}}})
    settings = {"output_type": "tabular", "statistics": ["point"], "output_file_format": "dataframe"}
    out = extract(points, {"datasets": ["part_copy"], "settings": settings}, output_dir=shared_folder(spark), write_metadata=False, quiet=True)
    return out.withColumns({"decimalLatitude": 60.0 - (60.0 - F.col("decimalLatitude")) / scale, "decimalLongitude": F.col("decimalLongitude") / scale})


_STORED = """with px as (select p_partkey // 50 as r, p_partkey % 50 as c, case when p_size <> 1 then p_retailprice end as b1 from part),
 im as (select j, d::date as s from (values (0, '2020-01-01'), (1, '2021-03-01'), (2, '2022-06-01')) t(j, d)),
 pt as (select c_custkey as id, ((c_custkey * 37) % 500)::double as x, ((c_custkey * 53) % (10 * (select ceil((max(p_partkey) + 1) / 50.0)::bigint from part)))::double as y, date '2020-12-20' + ((c_custkey * 11) % 220)::int as d from customer),
 pick as (select id, arg_min(j, struct_pack(gap := abs(d - s), late := -(s - date '1970-01-01'))) as j from pt, im group by id)
select pt.id, j, px.b1 + 1000 * j as value from pt join pick on pick.id = pt.id left join px on px.r = floor(pt.y / 10) and px.c = floor(pt.x / 10)"""


@query(_STORED)
def tile_store(spark: SparkSession, d: str) -> DataFrame:
    """Samples out of a collection written as a store of tiles: only the partitions and row groups of the points' images are read."""
    single = part_raster(spark, d)
    days = F.array(*(F.lit(x).cast("date") for x in ("2020-01-01", "2021-03-01", "2022-06-01")))
    each = single.tiles.withColumn("j", F.explode(F.array(*(F.lit(j) for j in range(3)))))
    tiles = each.select(F.col("j").cast("string").alias("image_id"), "tile_row", "tile_col", F.transform("b1", lambda v: v + F.col("j") * 1000).alias("b1"))
    images = spark.range(3).select(
        F.col("id").cast("string").alias("image_id"), days[F.col("id").cast("int")].alias("time_start"), F.lit(None).cast("date").alias("time_end"), F.lit("33N").alias("utm_zone")
    )
    stored = store.open_store(spark, store.write_store(Raster(single.header, tiles, TILE, images), shared_folder(spark)))
    points = customer_points(spark, d, single).withColumn("date", F.date_add(F.lit("2020-12-20").cast("date"), ((F.col("_row") * 11) % 220).cast("int")))
    found = asof.match_images(points, stored.images).select("_row", "x", "y", "image_id")
    sample = window.point_sample(found, stored, ["b1"])
    return found.join(sample, "_row").select(F.col("_row").alias("id"), F.col("image_id").cast("int").alias("j"), F.col("`b1.point`").alias("value"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
