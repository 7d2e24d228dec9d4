"""Point tables: reading, checking and bringing into WGS84."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasample.functions import crs, dates


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file whose delimiter (comma, semicolon, tab or space) its first line tells."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    sep = max((",", ";", "\t", " "), key=lambda s: (line.count(s), s != " ")) if line else ","
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def require_columns(points: DataFrame, needed: list[str]) -> None:
    if missing := [c for c in needed if c not in points.columns]:
        raise ValueError(f"Missing columns {missing}; expected {needed}, found {points.columns}")


def out_of_range() -> Column:
    """Whether lat, lon isn't a place on the globe: outside of its ranges, NaN or null."""
    return ~F.coalesce(~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False))


@dataclass
class Checked:
    """Points with id, lat, lon (WGS84), date (or null) and what the checks have to say."""

    points: DataFrame
    has_dates: bool
    warnings: list[str] = field(default_factory=list)


def check(points: DataFrame, *, input_crs: str | None = None, date_col: str = "date", shown: int = 5) -> Checked:
    """Parse dates, drop rows without one (where there is a date column), reproject, and check the ranges.

    Fails on a date that can't be read and on coordinates outside of the globe;
    null or NaN coordinates fail as well.
    """
    warnings: list[str] = []
    has_dates = date_col in points.columns
    out = points
    if has_dates:
        raw = F.col(date_col)
        out = out.withColumns({"_raw": raw.cast("string"), date_col: dates.parse(raw)})
        s = out.agg(
            F.count_if(
                dates.start_text(F.col("_raw")).isNull()
            ).alias("none"), F.count_if(dates.is_interval(F.col("_raw"))).alias("interval"), F.count_if(dates.has_time(F.col("_raw"))).alias("time"), F.count_if(dates.incomplete(F.col("_raw"))).alias("short"),
            F.count_if(dates.start_text(F.col("_raw")).isNotNull() & F.col(date_col).isNull()).alias("bad"),
        ).first()
        if s["bad"]:
            rows = [r["_raw"] for r in out.where(dates.start_text(F.col("_raw")).isNotNull() & F.col(date_col).isNull()).limit(shown).collect()]
            raise ValueError(f"{s['bad']} dates can't be read, such as {rows}")
        for n, what in (
            (s["interval"], "date intervals were cut to their start"), (s["time"], "times of day were dropped"),
            (s["short"], "incomplete dates were set to their first day"),
            (s["none"], "rows without a date were dropped")
        ):
            if n:
                warnings.append(f"{n} {what}")
        out = out.where(F.col(date_col).isNotNull()).drop("_raw")
    else:
        warnings.append("no date column: collections use their most recent image")
    code = crs.code_of(input_crs)
    if code != 4326:
        lat, lon = crs.to_wgs84(F.col("lon"), F.col("lat"), code)
        out = out.withColumns({"lat_original": F.col("lat"), "lon_original": F.col("lon"), "lat": lat, "lon": lon})
    if rows := out.where(out_of_range()).select("id", "lat", "lon").limit(shown).collect():
        raise ValueError(f"coordinates out of range, such as {[tuple(r) for r in rows]}")
    return Checked(out, has_dates, warnings)
