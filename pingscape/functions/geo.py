"""Distances and planar helpers as column expressions (no Python per row)."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ARC_RADIUS_M, CHORD_RADIUS_M


def half_chord_sq(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine term h for two points in degrees; null when a coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s_lat = F.sin((p2 - p1) / 2)
    s_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return s_lat * s_lat + F.cos(p1) * F.cos(p2) * s_lon * s_lon


def chord_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line (chord) distance in metres; the panel distance."""
    return 2 * CHORD_RADIUS_M * F.sqrt(half_chord_sq(lat1, lon1, lat2, lon2))


def arc_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = ARC_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    return 2 * radius * F.asin(F.sqrt(half_chord_sq(lat1, lon1, lat2, lon2)))


def unit_vector(lat: Column, lon: Column) -> Column:
    """Point on the unit sphere as a struct (u, v, w)."""
    p, t = F.radians(lat), F.radians(lon)
    return F.struct(
        (F.cos(p) * F.cos(t)).alias("u"), (F.cos(p) * F.sin(t)).alias("v"), F.sin(p).alias("w")
    )


def within_arc(a: Column, b: Column, metres: float, radius: float = ARC_RADIUS_M) -> Column:
    """Whether two unit vectors are at most `metres` apart along the great circle.

    Compares squared chords, so testing a pair needs no trigonometry.
    """
    du, dv, dw = a["u"] - b["u"], a["v"] - b["v"], a["w"] - b["w"]
    limit = 4 * math.sin(min(metres / (2 * radius), math.pi / 2)) ** 2
    return du * du + dv * dv + dw * dw <= limit


def speed_kmh(distance_m: Column, seconds: Column) -> Column:
    """Speed in km/h; null when the time difference is zero or missing."""
    return F.try_divide(3.6 * distance_m, seconds)


def x_km(lon: Column, lat0: float, radius_km: float = ARC_RADIUS_M / 1000) -> Column:
    """East coordinate in km on the plane that touches latitude lat0."""
    return F.radians(lon) * F.cos(F.radians(F.lit(lat0))) * radius_km


def y_km(lat: Column, radius_km: float = ARC_RADIUS_M / 1000) -> Column:
    """North coordinate in km."""
    return F.radians(lat) * radius_km


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def grid_cell(value: Column, size: float) -> Column:
    """Index of the grid cell a coordinate lies in."""
    return F.floor(value / F.lit(float(size)))
