"""Parameters of an annulus query and the gates they must pass."""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

#: Fixed values of the packed tile record and its capacities.
SIDE = 256
MAX_GROUPS = 128
MAX_PORTS = 192
MAX_FACE_PORTS = 255
#: Norms are signed 64-bit here, so the radius ends where its square does.
LARGEST_RADIUS = 3_037_000_499
FACES = ("I", "O", "L", "R")
EMPTY_BIT, OVERFLOW_BIT = 1, 2
INNER, OUTER, BOTH = 1, 2, 3


def ceil_isqrt(n: int) -> int:
    return isqrt(n - 1) + 1 if n > 0 else 0


@dataclass(frozen=True)
class Annulus:
    """Step bound ``k`` (squared), radii, and the tile side of the two-level plan.

    Raises if the adjacent-octants condition ``r_inner > floor(sqrt(2k))`` or a range fails.  The thickness
    condition, on which a tiled verdict rests, is :meth:`thick_enough`; plans that need it call :meth:`strict`.
    """

    k: int
    r_inner: int
    r_outer: int
    side: int = SIDE

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if not 0 < self.r_inner < self.r_outer:
            raise ValueError("radii must satisfy 0 < r_inner < r_outer")
        if self.r_outer > LARGEST_RADIUS:
            raise ValueError(f"r_outer must be at most {LARGEST_RADIUS}")
        if self.r_inner <= isqrt(2 * self.k):
            raise ValueError(f"r_inner must exceed floor(sqrt(2k)) = {isqrt(2 * self.k)}")
        if 2 * self.collar >= self.side:
            raise ValueError("the tile side must exceed twice the collar")

    @property
    def collar(self) -> int:
        return isqrt(self.k)

    @property
    def inner_sq(self) -> int:
        return self.r_inner**2

    @property
    def outer_sq(self) -> int:
        return self.r_outer**2

    def thick_enough(self) -> bool:
        delta = self.r_outer - self.r_inner
        return delta * delta > 2 * self.side**2 + 4 * self.side * ceil_isqrt(2 * self.k) + 4 * self.k

    def strict(self) -> Annulus:
        if not self.thick_enough():
            raise ValueError("the annulus is too thin for a tiled verdict")
        return self

    def canonical(self) -> str:
        """the parameter string that identifies a run."""
        return f"K={self.k};R_inner={self.r_inner};R_outer={self.r_outer};S={self.side}"


def palette(k: int, half: bool = True, odd_sums: bool = False) -> list[tuple[int, int]]:
    """Offsets (da, db) with 0 < da² + db² <= k; ``half``: one of each opposite pair.

    ``odd_sums``: for vertex sets whose a + b is always odd (Gaussian primes other than 1+i), only offsets of
    even sum can join two of them.
    """
    c = isqrt(k)
    found = [(a, b) for a in range(-c, c + 1) for b in range(-c, c + 1) if 0 < a * a + b * b <= k]
    if half:
        found = [(a, b) for a, b in found if a > 0 or (a == 0 and b > 0)]
    return [(a, b) for a, b in found if (a + b) % 2 == 0] if odd_sums else found
