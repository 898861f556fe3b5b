"""Reach, verdict and census of labelled vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.params import BOTH, INNER, OUTER


def component_reach(vertices: DataFrame) -> DataFrame:
    """(component, size, reach) from vertices (component, reach)."""
    return vertices.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bit_or("reach").alias("reach"))


def verdict(components: DataFrame, overflow: DataFrame | None = None) -> DataFrame:
    """One row (verdict): SPANNING if a component reaches both bands or a tile overflowed, MOAT if none
    does, UNKNOWN without components."""
    rows = components.select((F.col("reach") == BOTH).alias("spans"))
    if overflow is not None:
        rows = rows.union(overflow.select(F.lit(True)))
    told = rows.agg(F.bool_or("spans").alias("spans"))
    return told.select(F.when(F.col("spans").isNull(), "UNKNOWN").when(F.col("spans"), "SPANNING").otherwise("MOAT").alias("verdict"))


def crosscheck(vertices: DataFrame) -> DataFrame:
    """The components that both bands touch, as a set intersection."""
    touching = lambda bit: vertices.where(F.col("reach").bitwiseAND(F.lit(bit)) != 0).select("component")
    return touching(INNER).intersect(touching(OUTER))


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and the verdict of a flat plan."""
    comps = component_reach(vertices)
    counts = comps.agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("primes"),
        F.count(F.lit(1)).alias("components"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
        F.count_if(F.col("reach") == BOTH).alias("spanning_components"),
    )
    bands = vertices.agg(F.count_if(F.col("reach").bitwiseAND(F.lit(INNER)) != 0).alias("inner_primes"), F.count_if(F.col("reach").bitwiseAND(F.lit(OUTER)) != 0).alias("outer_primes"))
    one = lambda df: df.withColumn("one", F.lit(1))
    joined = one(counts).join(one(bands), "one").join(one(edges.agg(F.count(F.lit(1)).alias("edges"))), "one").drop("one")
    return joined.withColumn("verdict", F.when(F.col("components") == 0, "UNKNOWN").when(F.col("spanning_components") > 0, "SPANNING").otherwise("MOAT"))


CLASSES = {0: "interior", INNER: "inner_only", OUTER: "outer_only", BOTH: "spanning"}


def census(components: DataFrame) -> DataFrame:
    """(class, components, vertices, largest) by reach class."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.col("reach"))
    return components.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("vertices"), F.max("size").alias("largest"))


def largest(components: DataFrame, n: int = 8, touching: bool = False) -> DataFrame:
    """The ``n`` largest components, ties by label; ``touching``: of those that reach a band."""
    if touching:
        components = components.where("reach <> 0")
    return components.orderBy(F.desc("size"), "component").limit(n)
