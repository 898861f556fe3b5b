"""Primes beyond the reach of the queries' SQL, which divides by primes up to 40,000 or 3,000 only."""

import math

from pyspark.sql import functions as F

from latticeflow.functions import primes as P


def plain(n):
    return n > 1 and all(n % p for p in range(2, math.isqrt(n) + 1))


def test_norms_of_two_large_factors_are_composite(spark):
    rows = [(a, b) for a in range(5, 30) for b in range(200_001, 200_201, 5)]
    got = spark.createDataFrame(rows, "a long, b long").where(P.gaussian_prime(F.col("a"), F.col("b"))).collect()
    assert {tuple(r) for r in got} == {(a, b) for a, b in rows if plain(a * a + b * b)}
    numbers = [3001 * 3011, 7001 * 7013, 53_999_993, 9_000_011]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").where(P.prime(F.col("n"))).collect()
    assert {r.n for r in got} == {n for n in numbers if plain(n)}
