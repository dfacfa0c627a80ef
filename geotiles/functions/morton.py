"""Z-order codes: x in the even bits, y in the odd ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotiles.functions.mercator import DEPTH

#: Bits that stay after each doubling of the gaps between a 32-bit number's bits.
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(x: Column) -> Column:
    for shift, mask in _MASKS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(_MASKS[-1][1]).cast("long"))
    for (shift, _), (_, mask) in zip(reversed(_MASKS), [*reversed(_MASKS[:-1]), (32, 0xFFFFFFFF)], strict=True):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def encode(x: Column, y: Column) -> Column:
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def decode_x(code: Column) -> Column:
    return _gather(code)


def decode_y(code: Column) -> Column:
    return _gather(F.shiftright(code, 1))


def ancestor(code: Column, z: int) -> Column:
    """Code of the quadrant at level ``z`` that holds a key."""
    return F.shiftright(code, 2 * (DEPTH - z))


def quadrant_range(code: Column, z: int) -> tuple[Column, Column]:
    """Least and greatest key of a quadrant."""
    low = F.shiftleft(code, 2 * (DEPTH - z)) if z else F.lit(0).cast("long")
    return low, low.bitwiseOR(F.lit((1 << 2 * (DEPTH - z)) - 1).cast("long"))


def scalar_encode(x: int, y: int) -> int:
    return int(format(y, "b").translate({48: "00", 49: "10"}) or "0", 2) | int(format(x, "b").translate({48: "00", 49: "01"}) or "0", 2)


def scalar_decode(code: int) -> tuple[int, int]:
    bits = format(code, "b")
    bits = "0" * (len(bits) % 2) + bits
    return int(bits[1::2] or "0", 2), int(bits[0::2] or "0", 2)
