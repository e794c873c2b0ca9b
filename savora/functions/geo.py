"""Great-circle distance and a pointy-top hexagon grid in plain column arithmetic.

Cells are axial coordinates (q, r) of a grid laid over metres east and north of (0, 0), with one
reference latitude per job. The side shrinks by sqrt(7) per resolution step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
REFERENCE_LAT = 37.5
METRES_PER_DEGREE_LAT = 110540.0
METRES_PER_DEGREE_LON = 111320.0
SIDE_RES_10 = 66.0


def side(res: int) -> float:
    return SIDE_RES_10 * math.sqrt(7.0) ** (10 - res)


def metres_per_lon(lat0: float = REFERENCE_LAT) -> float:
    return METRES_PER_DEGREE_LON * math.cos(math.radians(lat0))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance in km between two points given in degrees; null without coordinates."""
    a1, o1, a2, o2 = (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (lat1, lon1, lat2, lon2))
    dlat = F.radians(a2 - a1) / 2.0
    dlon = F.radians(o2 - o1) / 2.0
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))  # least() would pass over a null


def flat_radian_km(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance of (lat, lon) in radians times the earth radius; ignores cos(lat)."""
    a1, o1, a2, o2 = (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(a2 - a1), F.radians(o2 - o1)
    return F.lit(EARTH_RADIUS_KM) * F.sqrt(dlat * dlat + dlon * dlon)


def axial(lat: Column, lon: Column, res: int, lat0: float = REFERENCE_LAT) -> tuple[Column, Column]:
    """Cell coordinates (q, r) of a point, by cube rounding."""
    return axial_by_side(lat, lon, side(res), lat0)


def axial_by_side(lat: Column, lon: Column, s: float, lat0: float = REFERENCE_LAT) -> tuple[Column, Column]:
    x, y = lon * F.lit(metres_per_lon(lat0)), lat * F.lit(METRES_PER_DEGREE_LAT)
    q = (F.lit(math.sqrt(3.0) / 3.0) * x - y / F.lit(3.0)) / F.lit(s)
    r = (F.lit(2.0) * y / F.lit(3.0)) / F.lit(s)
    z = -q - r
    rq, rr, rz = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(z + 0.5)
    dq, dr, dz = F.abs(rq - q), F.abs(rr - r), F.abs(rz - z)
    out_q = F.when((dq > dr) & (dq > dz), -rr - rz).otherwise(rq)
    out_r = F.when((dq > dr) & (dq > dz), rr).when(dr > dz, -rq - rz).otherwise(rr)
    return out_q.cast("long"), out_r.cast("long")


def cell_id(q: Column, r: Column, res: int) -> Column:
    return F.concat(F.lit(f"{res}_"), q.cast("string"), F.lit("_"), r.cast("string"))


def cell_q(cell: Column) -> Column:
    return F.split_part(cell, F.lit("_"), F.lit(2)).cast("long")


def cell_r(cell: Column) -> Column:
    return F.split_part(cell, F.lit("_"), F.lit(3)).cast("long")


def centre(q: Column, r: Column, res: int, lat0: float = REFERENCE_LAT) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre."""
    s = side(res)
    x = F.lit(s * math.sqrt(3.0)) * (q + r / F.lit(2.0))
    y = F.lit(s * 1.5) * r
    return y / F.lit(METRES_PER_DEGREE_LAT), x / F.lit(metres_per_lon(lat0))


def corners(q: Column, r: Column, res: int, lat0: float = REFERENCE_LAT) -> Column:
    """Six corner points as structs (lat, lon), counter-clockwise from the east-north one."""
    lat, lon = centre(q, r, res, lat0)
    s = side(res)
    pts = []
    for i in range(6):
        a = math.radians(60.0 * i + 30.0)
        pts.append(
            F.struct(
                (lat + F.lit(s * math.sin(a) / METRES_PER_DEGREE_LAT)).alias("lat"),
                (lon + F.lit(s * math.cos(a) / metres_per_lon(lat0))).alias("lon"),
            )
        )
    return F.array(*pts)


def disk_offsets(k: int, ring_only: bool = False) -> list[tuple[int, int, int]]:
    """(dq, dr, ring) of all cells within k steps of a cell."""
    out = []
    for dq in range(-k, k + 1):
        for dr in range(-k, k + 1):
            ring = max(abs(dq), abs(dr), abs(dq + dr))
            if ring == k or (ring < k and not ring_only):
                out.append((dq, dr, ring))
    return out


def disk(q: Column, r: Column, k: int, ring_only: bool = False) -> Column:
    """Array of structs (q, r, ring) around a cell; its length is fixed by k."""
    return F.array(
        *[F.struct((q + dq).alias("q"), (r + dr).alias("r"), F.lit(ring).alias("ring")) for dq, dr, ring in disk_offsets(k, ring_only)]
    )
