"""Boundary bands of an annulus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions.integers import floor_isqrt
from latticeflow.params import INNER, OUTER, Annulus, ceil_isqrt


def in_octant(a: Column, b: Column) -> Column:
    """P1."""
    return (a >= 0) & (b >= a)


def in_annulus(norm: Column, q: Annulus) -> Column:
    """Closed at both ends."""
    return norm.between(q.inner_sq, q.outer_sq)


def _within(norm: Column, r: int, k: int) -> Column:
    """(norm - r² - k)² <= 4 r² k: a cheap test in longs first, then the exact one in 38 digits."""
    eps = norm - F.lit(r * r + k)
    wide = eps.cast("decimal(19,0)")
    return (F.abs(eps) <= 2 * r * ceil_isqrt(k) + 1) & (wide * wide <= F.lit(str(4 * r * r * k)).cast("decimal(38,0)"))


def inner_band(norm: Column, q: Annulus) -> Column:
    """At most sqrt(k) outside the inner circle."""
    return (norm >= q.inner_sq) & _within(norm, q.r_inner, q.k)


def outer_band(norm: Column, q: Annulus) -> Column:
    """At most sqrt(k) inside the outer circle."""
    return (norm <= q.outer_sq) & _within(norm, q.r_outer, q.k)


def reach(norm: Column, q: Annulus) -> Column:
    """Bit 1: inner band, bit 2: outer band."""
    return F.when(inner_band(norm, q), INNER).otherwise(0).bitwiseOR(F.when(outer_band(norm, q), OUTER).otherwise(0))


def band_edges(q: Annulus) -> dict[str, int]:
    """The bands as whole norms, ends included."""
    from math import isqrt

    def half_width(r: int) -> int:
        return isqrt(4 * r * r * q.k)

    return {"inner_lo": q.inner_sq, "inner_hi": q.inner_sq + q.k + half_width(q.r_inner), "outer_lo": q.outer_sq + q.k - half_width(q.r_outer), "outer_hi": q.outer_sq}


def bad_zone_ranges(k: int, r: int) -> dict[str, tuple[int, int]]:
    """Whole norms that only rounding of the radius puts in or out of a band: first and last, per side.

    Inner side: above (sqrt(r²-1) + sqrt(k))², up to (r + sqrt(k))²; outer side: from (r - sqrt(k))², below
    (sqrt(r²+1) - sqrt(k))².  Squaring twice makes both exact for every ``k``; a range may be empty.
    """
    from math import isqrt

    def root(x: int) -> int:
        return isqrt(4 * k * x)

    n = r * r
    return {"inner": (n - 1 + k + root(n - 1) + 1, n + k + root(n)), "outer": (n + k - root(n), n + k - root(n + 1))}


def band_edges_of(annuli: DataFrame) -> DataFrame:
    """(k, r_inner, r_outer, inner_lo, inner_hi, outer_lo, outer_hi) of annuli (k, r_inner, r_outer), as :func:`band_edges`."""
    k, lo, hi = (F.col(c).cast("long") for c in ("k", "r_inner", "r_outer"))
    half_width = lambda r: floor_isqrt(4 * r * r * k)
    return annuli.select("k", "r_inner", "r_outer", (lo * lo).alias("inner_lo"), (lo * lo + k + half_width(lo)).alias("inner_hi"), (hi * hi + k - half_width(hi)).alias("outer_lo"), (hi * hi).alias("outer_hi"))


def bad_zones(annuli: DataFrame) -> DataFrame:
    """(k, r_inner, r_outer, inner_candidates, outer_candidates, bad_norms, clean) of annuli (k, r_inner, r_outer):
    candidates, as :func:`bad_zone_ranges` tells them, that are Gaussian norms are bad."""
    from latticeflow.functions.primes import gaussian_norm

    k = F.col("k").cast("long")
    root = lambda x: floor_isqrt(4 * k * x)
    side = lambda name, lo, hi: F.struct(F.lit(name).alias("side"), lo.alias("lo"), hi.alias("hi"))
    n, m = (F.col(c).cast("long") * F.col(c).cast("long") for c in ("r_inner", "r_outer"))
    ranges = annuli.select("k", "r_inner", "r_outer", F.inline(F.array(side("inner", n - 1 + k + root(n - 1) + 1, n + k + root(n)), side("outer", m + k - root(m), m + k - root(m + 1)))))
    n = F.explode_outer(F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi"))).alias("n")
    marked = ranges.select("k", "r_inner", "r_outer", "side", n).withColumn("bad", F.coalesce(gaussian_norm(F.coalesce("n", F.lit(1).cast("long"))), F.lit(False)))
    count = lambda s: F.count_if((F.col("side") == s) & F.col("n").isNotNull())
    told = marked.groupBy("k", "r_inner", "r_outer").agg(count("inner").alias("inner_candidates"), count("outer").alias("outer_candidates"), F.count_if(F.col("bad")).alias("bad_norms"))
    return told.withColumn("clean", F.col("bad_norms") == 0)


def bad_zone(spark, queries: list[Annulus]) -> DataFrame:
    """P12 for annuli that are given one by one."""
    return bad_zones(spark.createDataFrame([(q.k, q.r_inner, q.r_outer) for q in queries], "k long, r_inner long, r_outer long"))
