"""The flat plan: generate, join neighbours, label components, decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions.bands import in_annulus, in_octant, reach
from latticeflow.functions.integers import norm_sq
from latticeflow.functions.primes import octant_prime
from latticeflow.lineage import cut
from latticeflow.operators import edges as E
from latticeflow.operators import verdict as V
from latticeflow.operators.components import label_vertices
from latticeflow.params import Annulus
from latticeflow.sources import lattice


@dataclass(frozen=True)
class FlatGraph:
    """vertices (id, a, b, norm, reach, component) and edges (a, b) by vertex id."""

    query: Annulus
    vertices: DataFrame
    edges: DataFrame

    def summary(self) -> DataFrame:
        return V.summary(self.vertices, self.edges)

    def components(self) -> DataFrame:
        return V.component_reach(self.vertices)

    def verdict(self) -> DataFrame:
        return V.verdict(self.components())


def among(points: DataFrame, q: Annulus) -> DataFrame:
    """(a, b, norm): the annulus' primes among the given points, each once."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    placed = points.select(a.alias("a"), b.alias("b")).where(in_octant(F.col("a"), F.col("b"))).distinct().withColumn("norm", norm_sq(F.col("a"), F.col("b")))
    return placed.where(in_annulus(F.col("norm"), q)).where(octant_prime(F.col("a"), F.col("b")))


def vertices(spark: SparkSession, q: Annulus, points: DataFrame | None = None, known: bool = False) -> DataFrame:
    """(id, a, b, norm, reach): the annulus' primes, or those of them that are among the given ``points`` (a, b).

    ``known``: the points come from :func:`among` for the same radii and aren't tested again.
    """
    found = lattice.primes(spark, q) if points is None else points if known else among(points, q)
    return found.select(E.point_id("a", "b").alias("id"), "a", "b", "norm", reach(F.col("norm"), q).alias("reach"))


def edge_ids(points: DataFrame, k: int) -> DataFrame:
    return E.near(points, k).select(E.point_id("a1", "b1").alias("a"), E.point_id("a2", "b2").alias("b"))


def solve(spark: SparkSession, q: Annulus, points: DataFrame | None = None, known: bool = False) -> FlatGraph:
    """The graph is generated once and written, as several jobs read it; over given ``points`` it is that of their primes."""
    v = cut(vertices(spark, q, points, known))
    e = cut(edge_ids(v, q.k))
    return FlatGraph(q, label_vertices(v, e), e)
