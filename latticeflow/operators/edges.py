"""Neighbour joins (J1-J4, J9): pairs of lattice points within a step bound, as equi-joins.

``near`` joins on coarse cells: a point meets the points of its own cell and of four neighbours, so each
pair of cells is compared once and a row is sent five times, whatever the step bound.  ``by_offsets`` is the
literal form, one probe per offset of the half palette; it sends more rows and serves as a check.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.params import palette

#: The half of a cell's neighbourhood that is probed (itself included).
_PROBES = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def near(points: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Edges (a1, b1, a2, b2) with squared distance in 1..k, the lexicographically smaller end first.

    ``keep`` columns of both ends come along with suffix 1 and 2.
    """
    side = isqrt(k) + 1
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    p = points.select("a", "b", *keep, cell("a").alias("ca"), cell("b").alias("cb"))
    x = p.select(*[F.col(c).alias(f"{c}1") for c in ("a", "b", *keep)], "ca", "cb")
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _PROBES])).alias("probe")
    y = p.select(*[F.col(c).alias(f"{c}2") for c in ("a", "b", *keep)], "ca", "cb", probes).select("*", (F.col("ca") - F.col("probe.i")).alias("xa"), (F.col("cb") - F.col("probe.j")).alias("xb")).drop("ca", "cb", "probe")
    d = (F.col("a1") - F.col("a2")) * (F.col("a1") - F.col("a2")) + (F.col("b1") - F.col("b2")) * (F.col("b1") - F.col("b2"))
    same_cell = (F.floor(F.col("a2") / F.lit(side)) == F.col("ca")) & (F.floor(F.col("b2") / F.lit(side)) == F.col("cb"))
    first = (F.col("a1") < F.col("a2")) | ((F.col("a1") == F.col("a2")) & (F.col("b1") < F.col("b2")))
    met = x.join(y, (F.col("ca") == F.col("xa")) & (F.col("cb") == F.col("xb"))).where((d > 0) & (d <= k) & (~same_cell | first))
    swap = ~first
    ends = [F.when(swap, F.col(f"{c}{3 - n}")).otherwise(F.col(f"{c}{n}")).alias(f"{c}{n}") for n in (1, 2) for c in ("a", "b", *keep)]
    return met.select(*ends)


def by_offsets(points: DataFrame, k: int, odd_sums: bool = False) -> DataFrame:
    """J2 as written: each point probes the half palette's offsets.  ``odd_sums``: see :func:`palette`."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("da"), F.lit(j).cast("long").alias("db")) for i, j in palette(k, True, odd_sums)])).alias("o")
    x = points.select(F.col("a").alias("a1"), F.col("b").alias("b1"), offsets).select("a1", "b1", (F.col("a1") + F.col("o.da")).alias("a2"), (F.col("b1") + F.col("o.db")).alias("b2"))
    y = points.select(F.col("a").alias("a2"), F.col("b").alias("b2"))
    return x.join(y, ["a2", "b2"]).select("a1", "b1", "a2", "b2")


def point_id(a: str, b: str) -> Column:
    """One long for a point of the octant (both coordinates below 2**32), in lexicographic order."""
    return F.shiftleft(F.col(a), 32).bitwiseOR(F.col(b))


def within_strip(edges: DataFrame, perp1: str, perp2: str, collar: int) -> DataFrame:
    """The edges whose ends both lie in a face strip."""
    return edges.where((F.abs(perp1) <= collar) & (F.abs(perp2) <= collar))


def bridges(edges: DataFrame, left: str, right: str) -> DataFrame:
    """The first edge, by its ends, between each pair of labels."""
    pair = F.struct("a1", "b1", "a2", "b2")
    return edges.where(F.col(left) != F.col(right)).groupBy(F.least(left, right).alias("label1"), F.greatest(left, right).alias("label2")).agg(F.min(pair).alias("bridge")).select("label1", "label2", "bridge.*")
