"""extract(): points in, statistics or tiles out; a configuration's statistics are one plan, written once."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import replace
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasample.functions import crs, reducers
from terrasample.functions.grid import effective_window, touched_between
from terrasample.operators import asof, qc, terrain, window
from terrasample.plans import catalog as catalogs
from terrasample.plans import config as configs
from terrasample.plans import progress
from terrasample.sources import geotiff, mirror, points as point_source, sinks, store  # noqa: F401 (mirror, store: sources of catalog entries)
from terrasample.sources.raster import Raster, only, open_raster, pixels_of_tiles, tiles_of_pixels
from terrasample.sources.shared import cut, discard, scratch, shared_folder

MAX_TILE_BYTES = 32 * 2**20
#: A number that keeps the rows' order; made once, in the branch that the result is joined to.
ORDER = "_order"
DATE_SOURCES = ("nearest_to_sample", "clamped_to_nearest", "most_recent_no_date", "contains_sample_date")
#: Metres of a degree at the equator, the scale of assets without their own projection.
DEFAULT_DEGREE = 111_319.49
#: Of latitude, for the size of a tile of a raster in degrees.
METRES_PER_DEGREE = 111_320


def check_tile_size(window_m: float, scale: float, bands: int, bytes_per_pixel: int = 4) -> None:
    """ValueError for a tile of more than 32 MiB."""
    if (size := max(1, round(window_m / scale)) ** 2 * bands * bytes_per_pixel) > MAX_TILE_BYTES:
        raise ValueError(f"a tile of {window_m} m at {scale} m has {size} bytes; at most {MAX_TILE_BYTES}")


def _bands(spec: dict[str, Any], chosen: configs.Selection, raster: Raster) -> tuple[list[str], bool]:
    """The bands' names, and whether columns carry them.

    Numbered bands: any list does, a single number doesn't, no choice does if there are several.  Named bands do if there are several.
    """
    wanted = chosen.bands if chosen.bands is not None else spec.get("bands")
    if wanted is None:
        return list(raster.header.bands), len(raster.header.bands) > 1
    listed = wanted if isinstance(wanted, list) else [wanted]
    names = [f"b{b}" if isinstance(b, int) else b for b in listed]
    numbered = all(isinstance(b, int) for b in listed)
    return names, isinstance(wanted, list) if numbered else len(names) > 1


def dataset_columns(
    points: DataFrame, raster: Raster, name: str, names: list[str], bands: list[str], multi: bool, window_m: int | list[int], *,
    policy: str = "nearest", coverage: str = "touched", expand_subpixel: bool = False,
    classes: list[int] | None = None, scale: float | None = None, by_zone: bool = False, approximate: bool = False
) -> tuple[DataFrame, list[str], list[str]]:
    """_row with the named statistics and quality columns of one dataset and its windows; their two lists of names.

    All windows come from one reading of the tiles, and all class counts from another.
    """
    raster = raster.select(bands)
    points, raster, extra = _matched(_located(points, raster), raster, policy, by_zone)
    windows = window_m if isinstance(window_m, list) else [window_m]
    windowed = [n for n in names if n != reducers.POINT]
    windows = windows if windowed else windows[:1]  # a sample has no window
    side = {w: effective_window(w, scale or abs(raster.header.a)) if expand_subpixel else w for w in windows}
    sides = sorted(set(side.values()))
    label = {b: f"{name}_{b}_" if multi else f"{name}_" for b in bands}
    out = points.select(window.ROW, *extra)
    scalar = [n for n in windowed if reducers.is_scalar(n)]
    kinds = [n for n in windowed if n in reducers.CLASS_REDUCERS]
    if windowed:
        quality = window.nested_stats(points, raster, sides, windowed, bands, coverage, approximate)
        out = out.join(quality.withColumnsRenamed({f"w{k}": f"_s{k}" for k in range(len(sides))}), window.ROW, "left")
    custom = [n for n in windowed if reducers.arrow_reducer(n)]
    if custom:
        found = window.nested_arrow(points, raster, sides, custom, bands)
        out = out.join(found.withColumnsRenamed({f"w{k}": f"_a{k}" for k in range(len(sides))}), window.ROW, "left")
    counted: list[str] = []
    if kinds:
        found = window.nested_classes(points, raster, sides, kinds, bands, classes)
        counted = [c for c in found.schema["w0"].dataType.names if c != "none"]
        out = out.join(found.withColumnsRenamed({f"w{k}": f"_c{k}" for k in range(len(sides))}), window.ROW, "left")
    sampled: dict[str, Column] = {}
    if reducers.POINT in names:
        sample = window.point_sample(points, raster, bands)
        keep = [] if windowed else ["in_extent", "n_pixels", "had_nodata", "coverage_pct"]
        out = out.join(sample.select(window.ROW, *keep, *(f"`{b}.point`" for b in bands)), window.ROW, "left")
        sampled = {f"{label[b]}point": F.col(f"`{b}.point`") for b in bands}
    stats, flags = {}, {}
    for w in windows:
        k = sides.index(side[w])
        of = (lambda c, k=k: F.col(f"_s{k}.`{c}`")) if windowed else (lambda c: F.col(f"`{c}`"))
        stats |= {f"{label[b]}{n}_{w}m": of(f"{b}.{n}") for b in bands for n in scalar}
        stats |= {f"{label[b]}{n}_{w}m": F.col(f"_a{k}.`{b}.{n}`") for b in bands for n in custom}
        for c in counted:
            b, key = c.split(".", 1)
            zero = F.lit(0).cast("bigint") if key.endswith("count") else F.lit(0.0)
            stats[f"{label[b]}{key}_{w}m"] = F.coalesce(F.col(f"_c{k}.`{c}`"), zero)
        if w == windows[0]:
            stats |= sampled
        suffix = f"{w}m" if windowed else "point"
        flags |= {f"{name}_{c}_{suffix}": of(c) for c in ("in_extent", "n_pixels", "had_nodata", "coverage_pct")}
        flags |= {f"{name}_{c}_{suffix}": F.date_format(c, "yyyy-MM-dd") if c.startswith("image_time") else F.col(c) for c in extra}
        if raster.header.crs is not None:
            flags[f"{name}_region_crs_{suffix}"] = F.lit(f"EPSG:{raster.header.crs}")
        if multi and windowed:
            flags |= {f"{name}_{b}_coverage_pct_{suffix}": qc.band_coverage(of(f"{b}.n_valid"), of("total")) for b in bands}
    return out.select(window.ROW, *(c.alias(k) for k, c in (stats | flags).items())), list(stats), list(flags)


def _matched(points: DataFrame, raster: Raster, policy: str, by_zone: bool) -> tuple[DataFrame, Raster, list[str]]:
    """Each point with its image of a collection (by date, footprint and, with ``by_zone``, UTM zone), the raster to read and the columns that say how.

    A raster without images, or of images without any date (as one image of the last valid values), is the same for all points.
    """
    if raster.images is not None and asof.undated(raster.images):
        raster = _flattened(raster)
    if raster.images is None:
        return points, raster, []
    if "date" not in points.columns:
        points = points.withColumn("date", F.lit(None).cast("date"))
    keys = ("utm_zone",) if by_zone and "utm_zone" in raster.images.columns else ()
    points = points.withColumn("utm_zone", crs.utm_zone_label(F.col("lat"), F.col("lon"))) if keys else points
    images = raster.images
    if keys:  # the images of other zones aren't read; there are 120 zones at most
        images = images.where(F.col("utm_zone").isin([r[0] for r in points.select("utm_zone").distinct().collect()]))
    if set(asof.FOOTPRINT) <= set(images.columns):
        points = asof.match_covering(points, images, policy, window.ROW, keys=keys)
    else:
        points = asof.match_images(points, images, policy, keys=keys)
    return points, raster, ["date_clamped", "date_source", "image_time_start", "image_time_end"]


def _located(points: DataFrame, raster: Raster) -> DataFrame:
    """``points`` with x and y for a raster without a system, whose plane is that of the coordinates."""
    return points.withColumns({"x": F.col("lon"), "y": F.col("lat")}) if raster.header.crs is None and "x" not in points.columns else points


def native_scale(spec: dict[str, Any], raster: Raster) -> float:
    """Metres of a pixel: the catalog's native_scale_m, else the raster's own.

    A remote asset's copy whose pixels are the default degree has lost its
    projection; its true scale must be stated.
    """
    own, h = spec.get("dataset_spec") or {}, raster.header
    if own.get("native_scale_m"):
        return float(own["native_scale_m"])
    scale = abs(h.a) * (DEFAULT_DEGREE if h.crs == 4326 else 1)
    if spec.get("data_source") == "earth_engine" and h.crs == 4326 and abs(scale - DEFAULT_DEGREE) < 1:
        raise ValueError(
            f"{spec.get('path')}: pixels of one degree are the default of an asset without its own projection; state native_scale_m in dataset_spec"
        )
    return scale


def _flattened(raster: Raster) -> Raster:
    """A collection without dates as one image: of every pixel the last valid value by image_id."""
    bands = list(raster.header.bands)
    flat = terrain.mosaic(pixels_of_tiles(raster), raster.images.select("image_id", F.lit(None).cast("date").alias("time_start")), bands)
    return replace(raster, images=None, fetch=None, tiles=tiles_of_pixels(flat, raster.header, raster.size))


def extract(
    df: DataFrame,
    config: dict | list | str | Path,
    output_dir: str = "outputs",
    input_crs: str | None = None,
    id_column: str = "occurrenceID",
    latitude_column: str = "decimalLatitude",
    longitude_column: str = "decimalLongitude",
    date_column: str = "eventDate",
    write_metadata: bool = True,
    quiet: bool = False,
    progress_callback: progress.Callback | None = None,
    rasters: Mapping[str, Raster] | None = None,
) -> Any:
    """Statistics columns (or tiles) of the configured datasets for every point.

    Returns, for "dataframe" output, a DataFrame over the written result for a single configuration
    (else by batch_id); for files and tiles the paths by batch_id, tiles by
    batch_id:dataset[:window].  ``rasters`` gives datasets' rasters directly;
    others are opened through their catalog entries.
    """
    spark, many = df.sparkSession, isinstance(config, list)
    point_source.require_columns(df, [id_column, latitude_column, longitude_column])
    names = {id_column: "id", latitude_column: "lat", longitude_column: "lon"} | ({date_column: "date"} if date_column in df.columns else {})
    clash = [c for c in ("id", "lat", "lon", "date") if c in df.columns and c not in names]
    points = df.drop(*clash).withColumnsRenamed(names)
    checked = point_source.check(points.withColumn(ORDER, F.monotonically_increasing_id()), input_crs=input_crs)
    catalog = {
        **catalogs.datasets(),
        **{
            k: {"data_source": "given", "path": k, "data_type": r.meta.get("data_type", "continuous"), **r.meta.get("spec", {})} for k,
            r in (rasters or {}).items() if k not in catalogs.datasets()
        }
    }
    folder = shared_folder(spark)
    with scratch(spark):  # what opening, matching and counting write is needed until the results are
        results = _results(
            df, checked, names, catalog, dict(rasters or {}), config, output_dir, write_metadata, quiet, progress_callback, folder
        )
    if not any(isinstance(r, DataFrame) for r in results.values()):
        discard(spark, folder)
    if not many and len(results) == 1 and isinstance(next(iter(results.values())), DataFrame):
        return next(iter(results.values()))
    return results


def _results(
    df: DataFrame, checked: point_source.Checked, names: dict[str, str], catalog: dict[str, dict[str, Any]], opened: dict[str, Raster], config: Any,
    output_dir: str, write_metadata: bool, quiet: bool, progress_callback: progress.Callback | None, folder: str
) -> dict[str, Any]:
    """The results of all configurations; their statistics are tables below ``folder``."""
    spark = df.sparkSession
    results: dict[str, Any] = {}
    for index, raw in enumerate(configs.configs(config)):
        run = configs.parse(raw, index, catalog, catalogs.DEFAULTS)
        notes: dict[str, Any] = {"points": checked.warnings} if checked.warnings else {}
        info: dict[str, Any] = {}
        base = window.keyed(checked.points, ("lat", "lon", "date"))  # a caller's own x and y are none of it
        places = window.sites(base)
        total = base.count() if progress_callback or not quiet else 0
        wide, stats, flags, work = base, [], [], []
        for chosen in run.datasets:
            spec = catalog[chosen.name]
            if chosen.name not in opened:
                opened[chosen.name] = open_raster(spark, spec)
            raster = opened[chosen.name]
            bands, multi = _bands(spec, chosen, raster)
            for derived in chosen.derived:
                raster = _with_derived(raster, derived, bands[0], places, max(run.windows) * 2)
            if chosen.derived:
                bands = [*(bands if chosen.keeps_source else []), *chosen.derived]
                multi = len(bands) > 1
            kind = spec.get("data_type", "continuous")
            own = spec.get("dataset_spec") or {}
            remote, scale = spec.get("data_source") == "earth_engine", native_scale(spec, raster)
            if run.output_type == "raster":
                for w in run.windows:
                    key = f"{run.batch_id}:{chosen.name}" + (f":{w}m" if len(run.windows) > 1 else "")
                    results[key], summary = _tiles(
                        base, raster.select(bands), w, run.resample_m, chosen.name,
                        f"{output_dir}/{run.batch_id}/{chosen.name}", len(run.windows) > 1,
                        own.get("collection_date_policy", "nearest"), scale, bool(own.get("use_utm_zone"))
                    )
                    info.setdefault(chosen.name, _described(spec, raster, bands, scale))[f"tiles_{w}m"] = summary
                    total = summary["total"]
                continue
            wanted = run.statistics_for(chosen.name, kind)
            if found := reducers.type_warnings(wanted, kind):
                notes[chosen.name] = found
            for w in run.windows[:1] if set(wanted) == {reducers.POINT} else run.windows:
                work.append(progress.ProgressEvent(run.batch_id, chosen.name, w, 0, total))
                progress.emit(progress_callback, work[-1], quiet)
            cols, s, f = dataset_columns(
                places, raster, chosen.name, wanted, bands, multi, run.windows,
                policy=own.get("collection_date_policy", "nearest"),
                coverage=own.get("coverage", "geometric" if remote else "touched"),
                expand_subpixel=own.get("expand_subpixel", remote), classes=own.get("classes"),
                scale=scale, by_zone=bool(own.get("use_utm_zone")), approximate=run.approximate
            )
            wide = wide.join(cols.drop(*(c for c in cols.columns if c in wide.columns and c != window.ROW)), window.ROW, "left")
            stats, flags = [*stats, *(c for c in s if c not in stats)], [*flags, *(c for c in f if c not in flags)]
            info[chosen.name] = _described(spec, raster, bands, scale) | {"data_type": kind}
        if run.output_type == "raster":
            if write_metadata:
                sinks.write_sidecar(
                    spark, sinks.sidecar(run.batch_id, n_points=total, config=raw, datasets=info, warnings=notes),
                    f"{output_dir}/{run.batch_id}", run.batch_id
                )
            continue
        # written once: the table, the quality table and the summaries below read it from the shared folder
        def tell(share: float, work: list[progress.ProgressEvent] = work) -> None:
            for e in work:
                progress.emit(progress_callback, replace(e, done=min(int(e.total * share), e.total - 1), share=share), quiet)

        with progress.watched(spark, tell if progress_callback and total else None):
            wide = cut(wide.drop(window.ROW), folder, f"extracted-{index}")
        for e in work:
            progress.emit(progress_callback, replace(e, done=total, share=1.0), quiet)
        table, quality = _assembled(wide, df, names, stats, flags)
        if run.output_file_format == "dataframe":
            results[run.batch_id] = table
        else:
            results[run.batch_id] = sinks.write_table(table, output_dir, run.batch_id, run.output_file_format)
        sinks.write_table(quality, output_dir, f"{run.batch_id}_qc", "csv" if run.output_file_format == "dataframe" else run.output_file_format)
        if write_metadata:
            total, found = _summaries(wide, [chosen.name for chosen in run.datasets], flags, run.min_coverage_pct)
            for name, quality_of in found.items():
                low = {w: q.pop("n_low") for w, q in quality_of["windows"].items()}
                for w, n in low.items():
                    if n:
                        notes.setdefault(name, []).append(f"{n} points below {run.min_coverage_pct} % coverage ({w})")
                info[name] |= quality_of
            sinks.write_sidecar(
                spark, sinks.sidecar(run.batch_id, n_points=total, config=raw, datasets=info, warnings=notes),
                output_dir, run.batch_id
            )
    return results


def _described(spec: dict[str, Any], raster: Raster, bands: list[str], scale: float) -> dict[str, Any]:
    """A dataset's entry in the sidecar: where it comes from, its system, extent, type and missing value."""
    h = raster.header
    corner = lambda r, c: (h.a * c + h.b * r + h.c, h.d * c + h.e * r + h.f)
    xs, ys = zip(*(corner(r, c) for r in (0, h.height) for c in (0, h.width)), strict=True)
    nodata = h.nodata[0] if h.nodata[0] is not None else (raster.meta.get("nodata") or (None,))[0]
    return {
        "path": spec.get("path"), "crs": f"EPSG:{h.crs}" if h.crs else None, "resolution": abs(h.a), "native_scale_m": scale, "width": h.width, "height": h.height,
        "extent": [min(xs), min(ys), max(xs), max(ys)], "dtype": raster.meta.get("dtype", h.dtype), "nodata": nodata, "bands": bands,
    }


def _summaries(wide: DataFrame, names: list[str], flags: list[str], least: float, shown: int = 50) -> tuple[int, dict[str, Any]]:
    """How many points there are, and for each dataset and window its coverage: points without, with some and with all pixels, ids without data, per-band figures and dates.

    One aggregation over the written table; of the ids without data the first ``shown`` by id are listed, the count is of all.
    """
    aggs: dict[str, Any] = {"n": F.count("*")}
    kinds: dict[str, dict[str, str]] = {}
    for name in names:
        for c in flags:
            prefix = f"{name}_coverage_pct_"
            if c.startswith(prefix):
                w = c.removeprefix(prefix)
                kinds.setdefault(name, {})[w] = c
                pct = F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
                aggs |= {
                    f"{c}|no": F.count_if(pct == 0), f"{c}|some": F.count_if((pct > 0) & (pct < 100)),
                    f"{c}|all": F.count_if(pct >= 100), f"{c}|low": F.count_if(pct < least)
                }
                for b in (f for f in flags if f.startswith(f"{name}_") and f.endswith(f"_coverage_pct_{w}") and f != c):
                    aggs |= {f"{b}|min": F.min(F.col(f"`{b}`")), f"{b}|mean": F.avg(F.col(f"`{b}`")), f"{b}|max": F.max(F.col(f"`{b}`"))}
                source = f"{name}_date_source_{w}"
                if source in flags:
                    used = F.struct(
                        F.col(f"`{name}_image_time_start_{w}`").alias("s"),
                        F.coalesce(F.col(f"`{name}_image_time_end_{w}`"), F.col(f"`{name}_image_time_start_{w}`")).alias("e")
                    )
                    aggs |= {f"{source}|{s}": F.count_if(F.col(f"`{source}`") == s) for s in DATE_SOURCES}
                    aggs[f"{source}|used"] = F.array_sort(F.collect_set(F.when(F.col(f"`{name}_image_time_start_{w}`").isNotNull(), used)))
    got = wide.agg(*(v.alias(k) for k, v in aggs.items())).first()
    out: dict[str, Any] = {}
    for name, windows in kinds.items():
        own: dict[str, Any] = {"windows": {}}
        for w, c in windows.items():
            q: dict[str, Any] = {"n_no_data": got[f"{c}|no"], "n_partial": got[f"{c}|some"], "n_full": got[f"{c}|all"], "n_low": got[f"{c}|low"]}
            if q["n_no_data"]:
                q["ids_no_data"] = [
                    r["id"] for r in qc.ids_without_data(
                        wide.select("id", F.col(f"`{c}`").alias("coverage_pct"))
                    ).orderBy("id").limit(shown).collect()
                ]
            bands = sorted(k.split("|")[0] for k in aggs if k.endswith("|mean") and k.startswith(f"{name}_") and k.split("|")[0].endswith(f"_{w}"))
            figures = {b: {k: round(v, 2) if (v := got[f"{b}|{k}"]) is not None else None for k in ("min", "mean", "max")} for b in bands}
            if len({json.dumps(f) for f in figures.values()}) > 1:  # the same for all bands says nothing more
                q["band_coverage"] = figures
            source = f"{name}_date_source_{w}"
            if f"{source}|used" in aggs:
                q["date_info"] = {f"n_{s}": got[f"{source}|{s}"] for s in DATE_SOURCES} | {
                    "image_date_ranges_used": [list(r) for r in got[f"{source}|used"]]
                }
            own["windows"][w] = q
        first = next(iter(own["windows"].values()))
        own["quality"] = {k: v for k, v in first.items() if k not in ("n_low", "date_info")}
        if "date_info" in first:
            own["date_info"] = first["date_info"]
        out[name] = own
    return got["n"], out


def _assembled(wide: DataFrame, given: DataFrame, names: dict[str, str], stats: list[str], flags: list[str]) -> tuple[DataFrame, DataFrame]:
    """The statistics table with the caller's columns and names, and the quality table; both in input order."""
    reverse = {v: k for k, v in names.items()}
    moved = "lat_original" in wide.columns

    def value(c: str) -> Column:
        if moved and c in ("lat", "lon"):
            return F.col(f"{c}_original")
        return F.date_format(c, "yyyy-MM-dd") if c == "date" else F.col(c)

    core = [value(c).alias(reverse[c]) for c in ("id", "lat", "lon", "date") if c in reverse]
    if moved:
        core += [F.col(c).alias(f"{reverse[c]}_wgs84") for c in ("lat", "lon")]
    passed = [F.col(f"`{c}`") for c in given.columns if c not in names and c in wide.columns]
    doubles = {c for c, t in wide.dtypes if t in ("double", "float")}
    decimals = catalogs.DEFAULTS["stats_output_decimals"]
    rounded = [reducers.round_half_even(F.col(f"`{c}`"), decimals).alias(c) if c in doubles else F.col(f"`{c}`") for c in stats]
    rows = wide.orderBy(ORDER)
    return rows.select(*core, *passed, *rounded), rows.select(*core, *(F.col(f"`{c}`") for c in flags))


def _with_derived(raster: Raster, name: str, band: str, points: DataFrame, window_m: float) -> Raster:
    """``raster`` with slope or aspect of a band as another band, in the tiles that the points' windows touch."""
    near = only(raster, window.touched_tiles(_located(points, raster), raster, window_m, margin=3))
    extra = terrain.derived_tiles(near, band, name)
    # tiles have one type for all bands: one that holds fractions
    kind = str(np.result_type(np.dtype(raster.header.dtype), np.float32))
    header = replace(raster.header, bands=(*raster.header.bands, name), nodata=(*raster.header.nodata, None), dtype=kind)
    return replace(near, header=header, meta={**raster.meta, "nodata": None}, tiles=near.tiles.join(extra, raster.keys, "left"))


def tile_values(points: DataFrame, raster: Raster, window_m: float, step: float | None = None) -> DataFrame:
    """One row for each point in the raster's extent: _row, epsg, left, top, a, e, turned, height, width, o, values.

    ``points`` have _row and lat, lon (x, y for a raster without a system), and
    image_id for a collection.  Without ``step`` the window's block of pixels,
    those outside the window left out; with it a grid of that many metres in the
    point's UTM zone (in the raster's plane, without a system).  ``values`` has an
    array for each band, of the numbers at the row-major places ``o``.
    """
    h, bands, code = raster.header, list(raster.header.bands), raster.header.crs
    keys = tuple(k for k in raster.keys if k == "image_id")
    at = window.index_ranges(window.corners(points, raster, window_m), raster).where("in_extent")
    if step is None:
        # a window without a pixel centre has the pixels that it touches as its block, all of them nodata
        touched = {}
        for p, k, n in (("pr", "r", h.height), ("pc", "c", h.width)):
            lo, hi = touched_between(F.array_min(p), F.array_max(p))
            touched |= {f"{k}0": F.greatest(lo, F.lit(0)), f"{k}1": F.least(hi, F.lit(n - 1))}
        empty = (F.col("r0") > F.col("r1")) | (F.col("c0") > F.col("c1"))
        block = at.select(window.ROW, *(F.when(empty, v).otherwise(F.col(k)).alias(k) for k, v in touched.items()))
        r0, c0, width = F.col("r0"), F.col("c0"), F.col("c1") - F.col("c0") + 1
        frame = block.select(
            window.ROW, F.lit(code).cast("int").alias("epsg"), (h.a * c0 + h.b * r0 + h.c).alias("left"), (h.d * c0 + h.e * r0 + h.f).alias("top"), F.lit(h.a).alias("a"), F.lit(h.e).alias("e"),
            F.lit(h.rotated).alias("turned"), (F.col("r1") - r0 + 1).cast("int").alias("height"), width.cast("int").alias("width"), "r0", "c0",
        )
        px = window.window_pixels(points, raster, window_m, bands, together=False).join(frame.select(window.ROW, "r0", "c0", "width"), window.ROW)
        cells = px.select(window.ROW, ((F.col("r") - r0) * F.col("width") + F.col("c") - c0).cast("int").alias("o"), *bands)
    else:
        n = max(1, round(window_m / step))
        zone = crs.utm_epsg(F.col("lat"), F.col("lon")) if code else F.lit(None).cast("int")
        x, y = crs.utm_forward(F.col("lat"), F.col("lon")) if code else (F.col("x"), F.col("y"))
        placed = at.select(window.ROW, *keys, zone.alias("epsg"), x.alias("x"), y.alias("y"))
        corner = lambda c, sign: F.rint(F.col(c) / step) * step + sign * (n // 2) * step
        frame = placed.select(
            window.ROW, "epsg", corner("x", -1).alias("left"), corner("y", 1).alias("top"),
            F.lit(float(step)).alias("a"), F.lit(-float(step)).alias("e"), F.lit(False).alias("turned"),
            F.lit(n).alias("height"), F.lit(n).alias("width")
        )
        grid = terrain.sample_grid(placed, n, step).join(placed.select(window.ROW, *keys, "epsg"), window.ROW)
        if code:
            moved = crs.let(F.struct("gx", "gy", "epsg"), lambda g: crs.moved(g["gx"], g["gy"], g["epsg"], code))
            grid = grid.withColumn("g", moved).withColumns({"gx": F.col("g.x"), "gy": F.col("g.y")}).drop("g")
        near = only(raster, terrain.neighbour_tiles(grid, h, raster.size, keys))
        cells = terrain.resample_bands(grid, pixels_of_tiles(near), bands, h, keys=keys).select(
            window.ROW, (F.col("i") * n + F.col("j")).cast("int").alias("o"), *bands
        )
    # a tile's cells bound its group
    packed = cells.groupBy(window.ROW).agg(
        F.array_sort(F.collect_list(F.struct("o", *(F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands))))).alias("ps")
    )
    values = F.array(*(F.col(f"ps.v{k}") for k in range(len(bands))))
    return frame.drop("r0", "c0").join(packed.select(window.ROW, F.col("ps.o").alias("o"), values.alias("values")), window.ROW, "left")


def _tiles(
    points: DataFrame, raster: Raster, window_m: int, step: float | None, name: str, folder: str, suffixed: bool,
    policy: str = "nearest", scale: float | None = None, by_zone: bool = False
) -> tuple[str, dict[str, Any]]:
    """Write a GeoTIFF file of each point's window, with all bands; the folder, and how many were written and not.

    Of a collection each point's image is taken, as for statistics.  Points outside the raster, and
    tiles that can't be encoded or written, have no file and count as failed; the errors are a table beside the tiles.
    """
    h = raster.header
    check_tile_size(window_m, step or scale or abs(h.a) * (METRES_PER_DEGREE if h.crs == 4326 else 1), len(h.bands))
    places, raster, _ = _matched(_located(window.sites(points), raster), raster, policy, by_zone)
    # a name of the point's id; where places share one, with a hash of the place and date as well, so no file takes another's
    own = points.select(window.ROW, sinks.file_name(F.col("id")).alias("own")).distinct()
    shared = own.groupBy("own").count().where("count > 1").select("own", F.lit("-").alias("mark"))
    label = F.concat(
        "own", F.when(F.col("mark").isNull(), "").otherwise(F.concat(F.lit("-"), F.lower(F.hex(F.xxhash64(window.ROW))))),
        F.lit(f"-{name}" + (f"-{window_m}m" if suffixed else "") + ".tif")
    )
    named = own.join(shared, "own", "left").select(window.ROW, label.alias("name"))
    rows = named.join(tile_values(places, raster, window_m, step), window.ROW).drop(window.ROW)
    path = f"{folder}/tiles" + (f"-{window_m}m" if suffixed else "")
    given = h.nodata[0] if h.nodata[0] is not None else (raster.meta.get("nodata") or (None,))[0]
    spark = points.sparkSession
    at = shared_folder(spark)
    files = cut(sinks.write_files(geotiff.write_tiles(rows, replace(h, nodata=(given,) * len(h.bands))), path), at, "tiles")
    found = files.agg(F.count_if("written").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
    total, wanted = points.count(), own.count()
    summary: dict[str, Any] = {"n_exported": found["n"], "n_failed": wanted - found["n"], "total": total}
    if total > wanted:
        summary["n_repeated"] = total - wanted  # rows of one id, place and date share a file
    if found["errors"]:  # those that could not be encoded or written: whole in a table, the first ones here
        bad = files.where("error is not null").select("name", "error")
        summary["failures"] = sinks.write_table(bad, folder, f"failed-{window_m}m" if suffixed else "failed", "parquet")
        summary["errors"] = [r.asDict() for r in bad.orderBy("name").limit(50).collect()]
    if step and h.crs:
        summary["zones"] = [r["epsg"] for r in crs.zones(points).orderBy("epsg").collect()]
    discard(spark, at)
    return path, summary
