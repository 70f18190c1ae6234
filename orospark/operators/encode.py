"""Bodies of quantised-mesh tiles, after the public description of the format."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Axes of the WGS84 ellipsoid, and the greatest quantised coordinate.
AXES = np.array([6378137.0, 6378137.0, 6356752.314245179])
MOST = 32767


def ecef(lon: np.ndarray, lat: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Earth-centred metres (n, 3) of degrees and heights."""
    lon, lat = np.radians(lon), np.radians(lat)
    normal = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)
    k = AXES**2 * normal
    return k / np.sqrt((normal * k).sum(-1, keepdims=True)) + normal * np.asarray(height)[..., None]


def _occlusion(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The point on the line to centre from which, once below the horizon, no vertex can be seen; in scaled space."""
    way = centre / AXES
    way = way / np.linalg.norm(way)
    p = points / AXES
    size = np.maximum(np.linalg.norm(p, axis=1), 1.0)
    unit = p / size[:, None]
    cos_a, sin_a = unit @ way, np.linalg.norm(np.cross(unit, way), axis=1)
    cos_b, sin_b = 1 / size, np.sqrt(size**2 - 1) / size
    under = cos_a * cos_b - sin_a * sin_b
    return way * (1 / under[under > 1e-9]).max(initial=1.0)


def _zigzag(values: np.ndarray) -> bytes:
    d = np.diff(values.astype(np.int32), prepend=np.int32(0))
    return ((d << 1) ^ (d >> 31)).astype("<u2").tobytes()


def _normals(points: np.ndarray, triangles: np.ndarray) -> bytes:
    """Unit normals of the vertices, from the triangles around each by area, in two bytes: the octahedron's faces unfolded."""
    t = triangles.reshape(-1, 3)
    flat = np.cross(points[t[:, 1]] - points[t[:, 0]], points[t[:, 2]] - points[t[:, 0]])
    n = np.zeros_like(points)
    for k in range(3):
        np.add.at(n, t[:, k], flat)
    n /= np.maximum(np.abs(n).sum(1, keepdims=True), 1e-30)
    sign = np.where(n[:, :2] < 0, -1.0, 1.0)
    xy = np.where(n[:, 2:] < 0, (1 - np.abs(n[:, 1::-1])) * sign, n[:, :2])
    return np.floor((np.clip(xy, -1, 1) * 0.5 + 0.5) * 255 + 0.5).astype(np.uint8).tobytes()


def quantised_mesh(heights: np.ndarray, west: float, south: float, east: float, north: float, step: int = 1, normals: bool = False, mercator: bool = False) -> bytes:
    """A regular mesh over a square grid of heights, rows from the north, every step-th row and column and the last.

    With normals, the extension of that kind follows the edges. With mercator, south and north are in Mercator's y."""
    n = heights.shape[0]
    keep = np.unique(np.append(np.arange(0, n, step), n - 1))
    if len(keep) ** 2 > 1 << 16:
        raise ValueError("more vertices than 16-bit indices reach")
    m, h = len(keep), heights[np.ix_(keep, keep)].astype(float).ravel()
    col, row = np.meshgrid(keep, keep)
    u, v = (col.ravel() * MOST) // (n - 1), ((n - 1 - row.ravel()) * MOST) // (n - 1)
    low, high = float(h.min()), float(h.max())
    q = np.floor((h - low) * MOST / (high - low)).astype(int) if high > low else np.zeros(m * m, int)
    a = (np.arange(m - 1)[:, None] * m + np.arange(m - 1)).ravel()
    triangles = np.stack([a, a + m, a + 1, a + 1, a + m, a + m + 1], axis=1).ravel()
    # vertices in the order of their first use, so indices are coded as how far they lie below the highest so far
    first = np.unique(triangles, return_index=True)[1]
    order = triangles[np.sort(first)]
    place = np.empty(m * m, int)
    place[order] = np.arange(m * m)
    triangles, u, v, q, h = place[triangles], u[order], v[order], q[order], h[order]
    seen = np.maximum.accumulate(np.concatenate([[-1], triangles[:-1]])) + 1
    lat = south + (north - south) * v / MOST
    if mercator:
        lat = np.degrees(2 * np.arctan(np.exp(lat))) - 90
    points = ecef(west + (east - west) * u / MOST, lat, h)
    centre = (points.min(0) + points.max(0)) / 2
    radius = float(np.linalg.norm(points - centre, axis=1).max())
    body = struct.pack("<3d2f4d3d", *centre, low, high, *centre, radius, *_occlusion(points, centre))
    body += struct.pack("<I", m * m) + _zigzag(u) + _zigzag(v) + _zigzag(q)
    body += struct.pack("<I", len(triangles) // 3) + (seen - triangles).astype("<u2").tobytes()
    for edge, by in ((u == 0, v), (v == 0, u), (u == MOST, v), (v == MOST, u)):
        at = np.flatnonzero(edge)
        at = at[np.argsort(by[at], kind="stable")]
        body += struct.pack("<I", len(at)) + at.astype("<u2").tobytes()
    if normals:
        body += struct.pack("<BI", 1, 2 * m * m) + _normals(points, triangles)
    return body


def mesh_bytes(tiles: DataFrame, samples: str = "samples", step: int = 1, name: str = "body", normals: bool = False, profile: str = "geodetic") -> DataFrame:
    """Tiles (z, x, y, samples as in heightmaps) with the body of a quantized-mesh-1.0 file."""
    mercator = profile == "mercator"

    def pack(batches):
        for b in batches:
            get = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            lists, body = get(samples), []
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for z, x, y, p, q in zip(get("z").to_pylist(), get("x").to_pylist(), get("y").to_pylist(), ends[:-1], ends[1:], strict=True):
                n = math.isqrt(q - p)
                wide, high = (360.0 / (1 << z), 2 * math.pi / (1 << z)) if mercator else (180.0 / (1 << z), 180.0 / (1 << z))
                foot = y * high - (math.pi if mercator else 90)
                grid = data[p:q].reshape(n, n) / 5.0 - 1000
                body.append(quantised_mesh(grid, x * wide - 180, foot, (x + 1) * wide - 180, foot + high, step, normals, mercator))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(body, pa.binary())], names=[*b.schema.names, name])

    return tiles.mapInArrow(pack, T.StructType([*tiles.schema.fields, T.StructField(name, T.BinaryType())]))
