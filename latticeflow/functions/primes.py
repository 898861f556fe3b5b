"""Primality of longs and of Gaussian integers.

Numpy versions work on whole arrays inside Arrow batches; column versions wrap them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bases whose strong pseudoprime tests decide primality below a bound.
DECIDED = (
    (4_759_123_141, (2, 7, 61)),
    (1_122_004_669_633, (2, 13, 23, 1662803)),
    (2**63, (2, 325, 9375, 28178, 450775, 9780504, 1795265022)),
)
SMALL = 1000


@lru_cache(maxsize=8)
def primes_to(n: int) -> np.ndarray:
    """Primes up to ``n``."""
    flags = np.ones(max(n + 1, 2), bool)
    flags[:2] = False
    for p in range(2, int(n**0.5) + 1):
        if flags[p]:
            flags[p * p :: p] = False
    return np.flatnonzero(flags)


def _mulmod(a: np.ndarray, b: np.ndarray, n: np.ndarray, wide: bool) -> np.ndarray:
    """a * b mod n for unsigned 64-bit arrays: the quotient from doubles (``wide``: extended ones, for n up to
    2**62; else n below 2**50), the rest exact in wrapping arithmetic and at most one n off."""
    kind = np.longdouble if wide else np.float64
    q = (a.astype(kind) * b.astype(kind) / n.astype(kind)).astype(np.uint64)
    r = (a * b - q * n).view(np.int64)
    m = n.view(np.int64)
    r = np.where(r < 0, r + m, r)
    return np.where(r >= m, r - m, r).view(np.uint64)


def is_prime(values: np.ndarray) -> np.ndarray:
    """Exact primality of non-negative longs below 2**62 (F3: strong pseudoprime rounds on what division leaves)."""
    n = np.asarray(values, np.int64)
    out = n > 1
    for p in primes_to(SMALL):
        out &= (n % p != 0) | (n == p)
    rest = np.flatnonzero(out & (n > SMALL * SMALL))
    out[rest] = _strong(n[rest])
    return out


def _strong(n: np.ndarray) -> np.ndarray:
    """Strong pseudoprime rounds over odd numbers, with as few bases as decide primality below a bound."""
    out = np.ones(len(n), bool)
    lo = 0
    for hi, bases in DECIDED:
        left = np.flatnonzero((n >= lo) & (n < hi))
        for base in bases:
            if len(left):
                good = _round(n[left].view(np.uint64), base)
                out[left[~good]] = False
                left = left[good]
        lo = hi
    return out


def _round(m: np.ndarray, base: int) -> np.ndarray:
    one = np.uint64(1)
    top = int(m.max())
    times = (lambda a, b: a * b % m) if top < 2**32 else (lambda a, b: _mulmod(a, b, m, top >= 2**50))
    d, s = m - one, np.zeros(len(m), np.int64)
    while (even := (d & one) == 0).any():
        d = np.where(even, d >> one, d)
        s += even
    b = np.uint64(base) % m
    trivial = b == 0
    x = np.ones(len(m), np.uint64)
    for bit in range(int(d.max()).bit_length() - 1, -1, -1):
        x = times(x, x)
        x = np.where((d >> np.uint64(bit)) & one == 1, times(x, b), x)
    strong = (x == 1) | (x == m - one)
    for r in range(1, int(s.max())):
        x = times(x, x)
        strong |= (x == m - one) & (r < s)
    return strong | trivial


def gaussian_mask(a: np.ndarray, b: np.ndarray, limit: int = 600) -> np.ndarray:
    """Which points (0 <= a <= b) are Gaussian primes (F6, P4): many points at once, cheap tests first.

    Off the axis the norm must be prime (or 2): norms divisible by a split prime go first, each test on what
    the ones before left, then coordinates with a common factor; what small primes can't decide is tested.
    """
    out = np.zeros(len(a), bool)
    axis = np.flatnonzero(a == 0)
    out[axis] = (b[axis] % 4 == 3) & is_prime(b[axis])
    left = np.flatnonzero((a > 0) & ((a + b) & 1 == 1))
    n = a[left] * a[left] + b[left] * b[left]
    top = int(n.max(initial=0))
    exact = top < 2**52  # doubles hold the norms and the rests
    f = n.astype(np.float64) if exact else n
    for p in primes_to(limit).tolist():
        if p * p > top:
            break
        if p % 4 == 1:
            if exact:
                r = f - np.floor(f * (1.0 / p)) * p
                good = ((r != 0) & (r != p) & (r != -p)) | (f == p)
            else:
                good = (f % p != 0) | (f == p)
            left, f = left[good], f[good]
    n = f.astype(np.int64)
    good = np.gcd(a[left], b[left]) == 1
    unsure = np.flatnonzero(good & (n > limit * limit))
    good[unsure] = _strong(n[unsure])
    out[left[good]] = True
    out[(a == 1) & (b == 1)] = True
    return out


@F.pandas_udf(T.BooleanType())
def _is_prime(n: pd.Series) -> pd.Series:
    got = n.fillna(0).to_numpy(np.int64)
    return pd.Series(is_prime(got)).where(n.notna().to_numpy(), None).astype("boolean")


def prime(n: Column) -> Column:
    """Is a long prime (null: null).  An Arrow UDF; small factors are ruled out in the JVM before it."""
    return _is_prime(n.cast("long"))


def divides_small(n: Column) -> Column:
    """A JVM-side test that rules most composites out: divisible by a prime up to 37 and not that prime."""
    found = F.lit(False)
    for p in primes_to(37).tolist():
        found = found | ((n % p == 0) & (n != p))
    return found


def gaussian_prime(a: Column, b: Column) -> Column:
    """A + bi, 0 <= a <= b, is a Gaussian prime."""
    n = a * a + b * b
    on_axis = (a == 0) & (F.pmod(b, F.lit(4)) == 3)
    asked = F.when(a == 0, b).otherwise(n)
    return (on_axis | (a != 0)) & prime(asked)


@F.pandas_udf(T.BooleanType())
def _octant_prime(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(gaussian_mask(a.to_numpy(np.int64), b.to_numpy(np.int64)))


def octant_prime(a: Column, b: Column) -> Column:
    """P4 for longs that are known to satisfy 0 <= a <= b and aren't null; even norms are ruled out in the JVM."""
    return (((a + b) % 2 == 1) | (b == 1)) & _octant_prime(a, b)


def gaussian_norm(n: Column) -> Column:
    """P5: the norm of a Gaussian prime: 2, a prime 1 mod 4, or the square of a prime 3 mod 4."""
    from latticeflow.functions.integers import floor_isqrt

    root = floor_isqrt(n)
    square = (root * root == n) & (root % 4 == 3)
    return (n == 2) | ((n % 4 == 1) & ~square & prime(n)) | (square & prime(root))
