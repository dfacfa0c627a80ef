"""Map boxes: clamping, tile boxes, quadrant covers and code ranges.

A cover is worked out on the driver, level by level as arrays.  Its size
follows the box's outline at the refinement level, never the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from geotiles.functions import mercator, morton
from geotiles.functions.mercator import DEPTH

# The bounds that boxes are clamped to.
MAX_LAT, MAX_LON = 85.0511, 179.9
#: Refinement level of covers.
REF_LEVEL = 8
#: Ranges that a filter lists; more are merged across the smallest gaps.
MAX_RANGES = 64


@dataclass(frozen=True)
class Quadrant:
    code: int
    z: int
    full: bool

    @property
    def low(self) -> int:
        return self.code << 2 * (DEPTH - self.z)

    @property
    def high(self) -> int:
        return ((self.code + 1) << 2 * (DEPTH - self.z)) - 1


@dataclass(frozen=True)
class TileBox:
    """Inclusive tile bounds at the deepest level."""

    x0: int
    y0: int
    x1: int
    y1: int

    @classmethod
    def of_tiles(cls, z: int, x0: int, y0: int, x1: int, y1: int, edge: str = "inclusive") -> TileBox:
        """A box given by corner tiles of level ``z``.

        inclusive: the corner tiles belong to the box as a whole; legacy: of the
        last column and row only their first tiles at the deepest level do.
        """
        up = DEPTH - z
        if edge == "legacy":
            return cls(x0 << up, y0 << up, x1 << up, y1 << up)
        if edge != "inclusive":
            raise ValueError(f"edge is inclusive or legacy, not {edge!r}")
        return cls(x0 << up, y0 << up, ((x1 + 1) << up) - 1, ((y1 + 1) << up) - 1)

    @property
    def empty(self) -> bool:
        return self.x0 > self.x1 or self.y0 > self.y1

    @cached_property
    def parent(self) -> Quadrant:
        """The smallest quadrant that holds both corners."""
        a, b = morton.scalar_encode(self.x0, self.y0), morton.scalar_encode(self.x1, self.y1)
        up = -(-(a ^ b).bit_length() // 2)
        return Quadrant(a >> 2 * up, DEPTH - up, False)

    def cover(self, ref_level: int = REF_LEVEL) -> list[Quadrant]:
        """Disjoint quadrants that hold the box, in Z-order; those not ``full`` need the residual filter."""
        if self.empty:
            return []
        out: list[Quadrant] = []
        z = self.parent.z
        x, y = (np.array([v], np.int64) for v in morton.scalar_decode(self.parent.code))
        while len(x):
            up = DEPTH - z
            left, top = x << up, y << up
            right, bottom = left + (1 << up) - 1, top + (1 << up) - 1
            meets = (left <= self.x1) & (right >= self.x0) & (top <= self.y1) & (bottom >= self.y0)
            full = (left >= self.x0) & (right <= self.x1) & (top >= self.y0) & (bottom <= self.y1)
            done = meets & (full | (z >= ref_level))
            out += [Quadrant(morton.scalar_encode(a, b), z, f) for a, b, f in zip(x[done].tolist(), y[done].tolist(), full[done].tolist(), strict=True)]
            split = meets & ~done
            x, y = ((v[split][:, None] * 2 + np.array(step)).ravel() for v, step in ((x, (0, 1, 0, 1)), (y, (0, 0, 1, 1))))
            z += 1
        return sorted(out, key=lambda q: q.low)

    def ranges(self, ref_level: int = REF_LEVEL, most: int = MAX_RANGES) -> list[tuple[int, int]]:
        """The cover as key ranges, adjacent ones merged, and the nearest ones down to ``most``."""
        merged: list[list[int]] = []
        for q in self.cover(ref_level):
            if merged and merged[-1][1] + 1 == q.low:
                merged[-1][1] = q.high
            else:
                merged.append([q.low, q.high])
        if len(merged) > most:
            gaps = np.array([b[0] - a[1] for a, b in zip(merged[:-1], merged[1:], strict=True)])
            cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
            edges = [-1, *cuts.tolist(), len(merged) - 1]
            merged = [[merged[a + 1][0], merged[b][1]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [(a, b) for a, b in merged]

    def contains(self, x: Column | None = None, y: Column | None = None) -> Column:
        """The residual filter: tile bounds, inclusive."""
        x, y = F.col("x") if x is None else x, F.col("y") if y is None else y
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)

    def prefilter(self, code: Column | None = None, ref_level: int = REF_LEVEL) -> Column:
        """Key ranges as a filter that is pushed to the scan."""
        code = F.col("code") if code is None else code
        out = F.lit(False)
        for low, high in self.ranges(ref_level):
            out = out | code.between(low, high)
        return out


@dataclass(frozen=True)
class Region:
    """A box by its north-west and south-east corners, in degrees.

    Corners are 32-bit floats and clamped, unless ``clamp`` is off.  Swapped
    corners give an empty box; nothing wraps around the antimeridian.
    """

    lat0: float
    lon0: float
    lat1: float
    lon1: float
    clamp: bool = True

    def corners(self) -> tuple[float, float, float, float]:
        values = [float(np.float32(v)) for v in (self.lat0, self.lon0, self.lat1, self.lon1)]
        if self.clamp:
            most = [float(np.float32(v)) for v in (MAX_LAT, MAX_LON)] * 2
            values = [max(-m, min(m, v)) for v, m in zip(values, most, strict=True)]
        return tuple(values)

    @cached_property
    def box(self) -> TileBox:
        lat0, lon0, lat1, lon1 = self.corners()
        return TileBox(mercator.scalar_x(lon0), mercator.scalar_y(lat0), mercator.scalar_x(lon1), mercator.scalar_y(lat1))

    def contains_exactly(self, lat: Column | None = None, lon: Column | None = None) -> Column:
        """The other predicate: the plain box over 32-bit coordinates, inclusive."""
        lat, lon = F.col("lat") if lat is None else lat, F.col("lon") if lon is None else lon
        lat0, lon0, lat1, lon1 = (F.lit(v).cast("float") for v in (self.lat0, self.lon0, self.lat1, self.lon1))
        return lat.between(lat1, lat0) & lon.between(lon0, lon1)


def viewport(north: float, west: float, south: float, east: float, zoom: int, mode: str = "floor") -> tuple[int, int, int, int, int]:
    """A map window as (z, x0, y0, x1, y1), as a client asks for it.

    Latitudes are held within 85 degrees, longitudes beyond 179 become 179.9,
    zoom is 24 at most.  mode: ``floor`` or ``ceil`` of the south-east corner.
    """
    z = min(zoom, 24)
    lon = [179.9 if v > 179 else max(v, -180.0) for v in (west, east)]
    lat = [max(-85.0, min(85.0, v)) for v in (north, south)]
    gx = [(v + 180.0) / 360.0 * 2**z for v in lon]
    gy = [(1.0 - np.log(np.tan(np.radians(v)) + 1.0 / np.cos(np.radians(v))) / np.pi) / 2.0 * 2**z for v in lat]
    last = {"floor": np.floor, "ceil": np.ceil}[mode]
    return z, int(np.floor(gx[0])), int(np.floor(gy[0])), int(last(gx[1])), int(last(gy[1]))
