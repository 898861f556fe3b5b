"""Exact integer functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_sq(a: Column, b: Column) -> Column:
    """a² + b²; under ANSI mode an overflow raises."""
    return a * a + b * b


def floor_isqrt(n: Column) -> Column:
    """floor of the square root of a long, exact: the double's root is corrected by whole comparisons.

    Squares are compared as quotients, so nothing overflows.  Negative values give null.
    """
    r = F.floor(F.sqrt(n.cast("double"))).cast("long")
    over = (r > 0) & (F.call_function("div", n, F.greatest(r, F.lit(1).cast("long"))) < r)
    under = F.call_function("div", n, r + 1) >= r + 1
    return F.when(n >= 0, r - over.cast("long") + under.cast("long"))


def ceil_isqrt(n: Column) -> Column:
    """smallest whole root whose square is not below ``n``; 0 for n <= 0."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(floor_isqrt(n - 1) + 1)


def squared_distance(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """The left side of the step test."""
    return (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2)


def euclidean_mod(x: Column, m: Column | int) -> Column:
    """the remainder in 0..m-1, for negative ``x`` too."""
    return F.pmod(x, F.lit(m) if isinstance(m, int) else m)


def packed_position(row: Column, col: Column, side: int) -> Column:
    """F8: place of a point in a row-major square."""
    return (row * side + col).cast("int")


def unpacked_position(pos: Column, side: int) -> tuple[Column, Column]:
    """F8: row and column of a packed place."""
    return F.call_function("div", pos.cast("long"), F.lit(side).cast("long")).cast("int"), F.pmod(pos, F.lit(side)).cast("int")


def face_coordinates(face: Column, a: Column, b: Column, a_lo: Column, b_lo: Column, side: int) -> tuple[Column, Column]:
    """a point's place along a tile's face and its signed distance across it."""
    across_rows = face.isin("I", "O")
    h = F.when(across_rows, a - a_lo).otherwise(b - b_lo)
    perp = F.when(across_rows, b - b_lo).otherwise(a - a_lo) - F.when(face.isin("O", "R"), side).otherwise(0)
    return h, perp


def pair_key(hi: Column, lo: Column) -> Column:
    """two unsigned 32-bit numbers in one long."""
    return F.shiftleft(hi.cast("long"), 32).bitwiseOR(lo.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
