"""The annulus as a generated source.

The octant and annulus bounds become the ends of one range per lattice column, computed in the plan, so no
point outside is ever made; a batch of columns is sieved in an Arrow worker and only primes come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions.integers import ceil_isqrt, floor_isqrt
from latticeflow.functions.primes import gaussian_mask
from latticeflow.params import Annulus

#: Lattice points that a task should sieve, about a second of work.
POINTS_PER_TASK = 4_000_000


def columns(spark: SparkSession, q: Annulus) -> DataFrame:
    """(a, b_lo, b_hi): the lattice columns of the octant annulus."""
    last = isqrt(q.outer_sq // 2)
    points = q.outer_sq - q.inner_sq
    parts = max(1, min(last + 1, points // POINTS_PER_TASK + 1, 100_000))
    a = F.col("id")
    lo = F.greatest(a, ceil_isqrt(F.lit(q.inner_sq) - a * a))
    hi = floor_isqrt(F.lit(q.outer_sq) - a * a)
    return spark.range(0, last + 1, 1, int(parts)).select(a.alias("a"), lo.alias("b_lo"), hi.alias("b_hi")).where("b_lo <= b_hi")


#: Lattice points sieved at once in a worker.
_AT_ONCE = 500_000


def expanded(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of the ranges lo..hi of each a, in order."""
    n = hi - lo + 1
    return np.repeat(a, n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, lo, hi = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        group = np.cumsum(hi - lo + 1) // _AT_ONCE
        for g in np.unique(group):
            at = group == g
            x, y = expanded(a[at], lo[at], hi[at])
            keep = gaussian_mask(x, y)
            x, y = x[keep], y[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(x * x + y * y)], ["a", "b", "norm"])


def primes(spark: SparkSession, q: Annulus) -> DataFrame:
    """(a, b, norm): the Gaussian primes of the octant annulus, in no order."""
    return columns(spark, q).mapInArrow(_sieved, "a long, b long, norm long")


def points(spark: SparkSession, q: Annulus) -> DataFrame:
    """(a, b, norm): every lattice point, for small annuli and other vertex predicates."""
    b = F.explode(F.sequence("b_lo", "b_hi")).alias("b")
    return columns(spark, q).select("a", b).withColumn("norm", F.col("a") * F.col("a") + F.col("b") * F.col("b"))
