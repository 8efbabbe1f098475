"""Great-circle geometry and grid keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.19492664455873  # EARTH_KM * pi / 180


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def to_cartesian(lat, lon) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return (EARTH_KM * F.cos(lat) * F.cos(lon), EARTH_KM * F.cos(lat) * F.sin(lon), EARTH_KM * F.sin(lat))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def grid_index(coord, size) -> Column:
    """Integer grid line below a coordinate for a cell edge of ``size`` degrees."""
    return F.floor(_col(coord) / _col(size)).cast("int")


def box_half_degrees(lat, km) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of a box that holds every point within ``km``."""
    lat, km = _col(lat), _col(km)
    half_lat = km / KM_PER_DEGREE
    ratio = F.sin(F.least(km / EARTH_KM, F.lit(1.5707963))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    over_pole = (F.abs(lat) + half_lat >= 90.0) | (ratio >= 1.0)
    half_lon = F.when(over_pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))))
    # a hair wider than exact, so rounding can never lose a border point
    return half_lat * 1.000001 + 1e-9, half_lon * 1.000001 + 1e-9


def covering_cells(lat, lon, km, size) -> Column:
    """Array of ``struct(gx, gy)`` grid cells that together cover a circle.

    A box that reaches over the 180th meridian goes on from the other side: its range is taken as it is and moved by
    a full turn either way, cut to the map, each cell once.
    """
    lat, lon, size = _col(lat), _col(lon), _col(size)
    half_lat, half_lon = box_half_degrees(lat, km)
    xs = F.sequence(grid_index(lat - half_lat, size), grid_index(lat + half_lat, size))

    def turn(by: float) -> Column:
        low, high = F.greatest(lon - half_lon + by, F.lit(-180.0)), F.least(lon + half_lon + by, F.lit(180.0))
        return F.when(low <= high, F.sequence(grid_index(low, size), grid_index(high, size))).otherwise(F.array().cast("array<int>"))

    ys = F.array_distinct(F.concat(turn(0.0), turn(360.0), turn(-360.0)))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("gx"), y.alias("gy")))))
