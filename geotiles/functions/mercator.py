"""Web-Mercator tiles as column expressions, with scalar twins for the driver.

Tiles are those of a power-of-two grid; y grows to the south.  All columns stay
inside generated code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The deepest level; keys are made at it.
DEPTH = 25


def _grid_x(lon: Column, z: int) -> Column:
    return (lon.cast("double") + 180.0) / 360.0 * float(1 << z)


def _grid_y(lat: Column, z: int) -> Column:
    radians = lat.cast("double") * F.lit(math.pi / 180.0)
    return (1.0 - F.ln(F.tan(radians) + 1.0 / F.cos(radians)) / F.lit(math.pi)) / 2.0 * float(1 << z)


def _kept(grid: Column, z: int, out_of_range: str) -> Column:
    """drop: null outside the grid; clamp: the nearest tile; wrap: modulo the grid's width."""
    whole = F.floor(grid) if out_of_range == "clamp" else grid.cast("long")
    if out_of_range == "wrap":
        return whole.bitwiseAND(F.lit((1 << z) - 1).cast("long"))
    if out_of_range == "clamp":
        return F.least(F.greatest(whole, F.lit(0)), F.lit((1 << z) - 1)).cast("long")
    if out_of_range == "drop":
        return F.when((grid >= 0) & (grid < float(1 << z)), whole)
    raise ValueError(f"out_of_range is drop, clamp or wrap, not {out_of_range!r}")


def tile_x(lon: Column, z: int = DEPTH, out_of_range: str = "wrap") -> Column:
    return _kept(_grid_x(lon, z), z, out_of_range)


def tile_y(lat: Column, z: int = DEPTH, out_of_range: str = "wrap") -> Column:
    return _kept(_grid_y(lat, z), z, out_of_range)


def tile_lon(x: Column, z: Column | int) -> Column:
    """Longitude of a tile coordinate; add 0.5 for a tile's centre."""
    width = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    return (x / width * 360.0 - 180.0).cast("float")


def tile_lat(y: Column, z: Column | int) -> Column:
    width = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    n = F.lit(math.pi) - F.lit(2.0 * math.pi) * y / width
    return (F.lit(180.0 / math.pi) * F.atan((F.exp(n) - F.exp(-n)) * 0.5)).cast("float")


def scalar_x(lon: float, z: int = DEPTH) -> int:
    return int((float(np.float32(lon)) + 180.0) / 360.0 * (1 << z)) & ((1 << z) - 1)


def scalar_y(lat: float, z: int = DEPTH) -> int:
    radians = float(np.float32(lat)) * (math.pi / 180.0)
    return int((1.0 - math.log(math.tan(radians) + 1.0 / math.cos(radians)) / math.pi) / 2.0 * (1 << z)) & ((1 << z) - 1)
