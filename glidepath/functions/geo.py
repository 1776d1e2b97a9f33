"""Spherical geometry as Column expressions. Distances in nautical miles, angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from glidepath.constants import EARTH_RADIUS_NM


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance. The root is clamped so that rounding cannot leave asin's domain."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.least(F.sqrt(chord), F.lit(1.0))) * (2 * EARTH_RADIUS_NM)


def initial_bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Course at the first point towards the second, 0..360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    from_lat, to_lat, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(to_lat)
    north = F.cos(from_lat) * F.sin(to_lat) - F.sin(from_lat) * F.cos(to_lat) * F.cos(turn)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def angular_diff_deg(a, b) -> Column:
    """Smallest angle between two courses, 0..180."""
    gap = F.abs((_c(a) - _c(b)) % 360)
    return F.least(gap, 360 - gap)


def circular_spread(mean_cos, mean_sin) -> Column:
    """Circular variance from the mean cosine and sine: 0 on one heading, 1 over all headings."""
    return 1 - F.sqrt(F.pow(_c(mean_cos), 2) + F.pow(_c(mean_sin), 2))


#: Bits of a cell number for each of its two places on a face.
_PLACE_BITS = 30


def _on_cube(x: Column, y: Column, z: Column, level: int) -> Column:
    """The cell that a direction falls in: a face of the cube, and its row and column there.

    Places are spaced evenly by angle seen from the centre, so that cells differ in area by no more than the square root of two.
    """
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), ay >= az
    major = F.when(on_x, x).when(on_y, y).otherwise(z)
    face = F.when(on_x, 0).when(on_y, 1).otherwise(2) + F.when(major < 0, 3).otherwise(0)
    n = 1 << level

    def place(side: Column) -> Column:
        even = F.atan(side / F.abs(major)) * (4 / math.pi)
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((even + 1) / 2 * n))).cast("bigint")

    u = F.when(on_x, y).otherwise(x)
    v = F.when(on_x | on_y, z).otherwise(y)
    return (face.cast("bigint") * (1 << 2 * _PLACE_BITS)) + place(u) * (1 << _PLACE_BITS) + place(v)


def sphere_cell(lat, lon, level: int = 6) -> Column:
    """Number of the cell of a point in a grid of 6 x 4^level cells over the whole sphere (level 6: about 21,000 square km each).

    Six faces of a cube around the sphere, each halved `level` times both ways; no cell narrows towards a pole or breaks at a date line.
    """
    if not 0 <= level < _PLACE_BITS:
        raise ValueError(f"level is 0 to {_PLACE_BITS - 1}")
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return _on_cube(F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la), level)


def _cell_places(cell: Column) -> tuple[Column, Column, Column]:
    """Face, row and column of a cell number."""
    low = (1 << _PLACE_BITS) - 1
    return F.shiftright(cell, 2 * _PLACE_BITS), F.shiftright(cell, _PLACE_BITS).bitwiseAND(low), cell.bitwiseAND(low)


def cell_parent(cell, up: int = 1) -> Column:
    """The cell `up` levels above, which holds this one whole."""
    face, i, j = _cell_places(_c(cell))
    return face * (1 << 2 * _PLACE_BITS) + F.shiftright(i, up) * (1 << _PLACE_BITS) + F.shiftright(j, up)


def _direction(cell: Column, level: int, di: float, dj: float) -> tuple[Column, Column, Column]:
    """The direction of a place in or beside a cell, in cells from its lower corner."""
    face, i, j = _cell_places(cell)
    u, v = (F.tan(((k + d) * (2.0 / (1 << level)) - 1) * (math.pi / 4)) for k, d in ((i, di), (j, dj)))
    axis, sign = face % 3, F.when(face >= 3, -1.0).otherwise(1.0)
    return (F.when(axis == 0, sign).otherwise(u), F.when(axis == 0, u).when(axis == 1, sign).otherwise(v), F.when(axis == 2, sign).otherwise(v))


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def cell_centre(cell, level: int = 6) -> Column:
    """Latitude and longitude of a cell's centre, as a struct (lat, lon)."""
    return _let(F.struct(*[d.alias(n) for d, n in zip(_direction(_c(cell), level, 0.5, 0.5), "xyz")]), lambda d: F.struct(
        F.degrees(F.atan2(d["z"], F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]))).alias("lat"), F.degrees(F.atan2(d["y"], d["x"])).alias("lon")))


def cell_neighbours(cell, level: int = 6) -> Column:
    """The four cells that share an edge with a cell, on its own face or the next one."""
    beside = [(-0.5, 0.5), (1.5, 0.5), (0.5, -0.5), (0.5, 1.5)]
    places = F.array(*[F.struct(*[d.alias(n) for d, n in zip(_direction(_c(cell), level, di, dj), "xyz")]) for di, dj in beside])
    return F.transform(places, lambda d: _on_cube(d["x"], d["y"], d["z"], level))
