"""Coordinate reference systems as column expressions: WGS84, UTM and Web Mercator.

UTM uses the Krueger series to the fourth order in the third flattening
(published coefficients), so a whole table is projected inside one stage of
generated code, and points of many zones need no per-zone branches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84, the UTM scale and offsets, and the series' coefficients.
A_AXIS = 6378137.0
FLAT = 1 / 298.257223563
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10_000_000.0
N = FLAT / (2 - FLAT)
RADIUS = A_AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECC = (FLAT * (2 - FLAT)) ** 0.5
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630
)


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; the date line at 180 degrees is zone 60."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_zone_label(lat: Column, lon: Column) -> Column:
    """Such as 33N or 34S."""
    return F.concat(utm_zone(lon).cast("string"), F.when(lat >= 0, "N").otherwise("S"))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value as a variable: the series use it many times, and its expression isn't copied."""
    return F.transform(F.array(value), f)[0]


def _meridian(epsg: Column) -> Column:
    return (epsg % 100 - 1) * 6 - 177


def _offset(epsg: Column) -> Column:
    return F.when(epsg >= 32700, FALSE_NORTH).otherwise(0.0)


def _forward(lat: Column, lon: Column, epsg: Column) -> Column:
    def series(q: Column) -> Column:
        xi, eta, east, north = q["xi"], q["eta"], q["eta"], q["xi"]
        for j, a in enumerate(ALPHA, 1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((FALSE_EAST + K0 * RADIUS * east).alias("x"), (q["fn"] + K0 * RADIUS * north).alias("y"))

    def angles(p: Column) -> Column:
        t = let(F.sin(p["phi"]), lambda s: F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s)))
        return let(
            t,
            lambda t: F.struct(F.atan2(t, F.cos(p["dl"])).alias("xi"), F.atanh(F.sin(p["dl"]) / F.sqrt(1 + t * t)).alias("eta"), p["fn"].alias("fn"))
        )

    start = F.struct(F.radians(lat).alias("phi"), F.radians(lon - _meridian(epsg)).alias("dl"), _offset(epsg).alias("fn"))
    return let(let(start, angles), series)


def _inverse(east: Column, north: Column, epsg: Column) -> Column:
    def series(q: Column) -> Column:
        xi, eta, xp, ep = q["xi"], q["eta"], q["xi"], q["eta"]
        for j, b in enumerate(BETA, 1):
            xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return F.struct(xp.alias("xp"), ep.alias("ep"), q["m"].alias("m"))

    def angles(q: Column) -> Column:
        def latitude(chi: Column) -> Column:
            lat = chi
            for j, d in enumerate(DELTA, 1):
                lat = lat + d * F.sin(2 * j * chi)
            return F.degrees(lat)

        return F.struct(
            (F.degrees(F.atan2(F.sinh(q["ep"]), F.cos(q["xp"]))) + q["m"]).alias("x"),
            let(F.asin(F.sin(q["xp"]) / F.cosh(q["ep"])), latitude).alias("y")
        )

    start = F.struct(
        ((north - _offset(epsg)) / (K0 * RADIUS)).alias("xi"), ((east - FALSE_EAST) / (K0 * RADIUS)).alias("eta"),
        _meridian(epsg).alias("m")
    )
    return let(let(start, series), angles)


def utm_forward(lat: Column, lon: Column, epsg: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in metres, in the zone of the point itself or of a given code."""
    s = _forward(lat, lon, utm_epsg(lat, lon) if epsg is None else epsg)
    return s["x"], s["y"]


def utm_inverse(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    s = _inverse(east, north, epsg)
    return s["y"], s["x"]


def moved(east: Column, north: Column, epsg: Column, code: int) -> Column:
    """A place in a UTM zone as a struct (x, y) in the system ``code``; in its own zone it stays as it is."""
    def placed(g: Column) -> Column:
        x, y = from_wgs84(g["y"], g["x"], code)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(epsg == code, F.struct(east.alias("x"), north.alias("y"))).otherwise(let(_inverse(east, north, epsg), placed))


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(2 * F.atan(F.exp(y / A_AXIS)) - F.lit(3.141592653589793) / 2), F.degrees(x / A_AXIS)


def mercator_forward(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A_AXIS, F.log(F.tan(F.lit(3.141592653589793) / 4 + F.radians(lat) / 2)) * A_AXIS


def normalize(text: str | int | None) -> str:
    """``EPSG:n`` for an empty text (4326), a number, WGS84 or an EPSG text of any case."""
    t = str(text or "").strip().upper()
    if t in ("", "WGS84"):
        return "EPSG:4326"
    return f"EPSG:{t}" if t.isdigit() else t


def code_of(text: str | int | None) -> int:
    """The EPSG number of a supported system; ValueError for any other."""
    m = re.fullmatch(r"EPSG:(\d+)", normalize(text))
    code = int(m[1]) if m else -1
    if code in (4326, 3857) or code // 100 in (326, 327) and 1 <= code % 100 <= 60:
        return code
    raise ValueError(f"Unsupported CRS {text!r}: use EPSG:4326, EPSG:3857, EPSG:326zz or EPSG:327zz")


def from_wgs84(lat: Column, lon: Column, code: int) -> tuple[Column, Column]:
    """x and y in the system ``code``."""
    if code == 4326:
        return lon, lat
    return mercator_forward(lat, lon) if code == 3857 else utm_forward(lat, lon, F.lit(code))


def to_wgs84(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    """Latitude and longitude of x and y in the system ``code``."""
    if code == 4326:
        return y, x
    return mercator_inverse(x, y) if code == 3857 else utm_inverse(x, y, F.lit(code))


def zones(points: DataFrame) -> DataFrame:
    """The distinct UTM zones of points (lat, lon) as their codes (epsg); 120 at most."""
    return points.select(utm_epsg(F.col("lat"), F.col("lon")).alias("epsg")).distinct()
