"""Tile grids (S3, S5, S14, W1, W6, P9, F9): towers of active tiles per column, in column order.

A tile (i, j) covers the closed square of side ``S`` at (S i, S j).  It is active if the square holds a lattice
point of the octant annulus.  Active tiles of a column are consecutive, so a column is a tower (j_low, j_high);
both ends come from a few whole roots per lattice column of the tile column, not from scans of tiles.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticeflow.functions.integers import ceil_isqrt, floor_isqrt
from latticeflow.params import Annulus


def towers(spark: SparkSession, q: Annulus) -> DataFrame:
    """(i, j_low, j_high, tower_offset): active tiles of each column and the number of tiles before it.

    In lattice column x the annulus spans y from max(x, lower arc) to the upper arc.  Over a tile column the
    lower arc falls and the diagonal rises, so the lowest point lies where they cross or at an end; the upper
    arc falls, so the highest point lies at the left end.  Tiles share their edges: a point on one counts for
    both neighbours.
    """
    s = q.side
    last = isqrt(q.outer_sq // 2)
    x0, x1 = F.col("id") * s, F.least(F.col("id") * s + s, F.lit(last))
    cross = F.lit(isqrt(q.inner_sq // 2))
    low = lambda x: F.greatest(x, ceil_isqrt(F.lit(q.inner_sq) - x * x))
    candidates = [x0, x1, F.greatest(x0, F.least(cross, x1)), F.greatest(x0, F.least(cross + 1, x1))]
    y_low = F.least(*[low(x) for x in candidates])
    y_high = floor_isqrt(F.lit(q.outer_sq) - x0 * x0)
    div = lambda y: F.call_function("div", y, F.lit(s).cast("long"))
    lowest = F.greatest(F.lit(0).cast("long"), div(y_low + s - 1) - 1)
    cols = spark.range(0, last // s + 1, 1, max(1, last // s // 200_000 + 1)).select(F.col("id").alias("i"), lowest.alias("j_low"), div(y_high).alias("j_high"))
    return with_offsets(cols)


def with_offsets(cols: DataFrame, block: int = 4096) -> DataFrame:
    """Adds ``tower_offset``, the exclusive running sum of the towers' heights.

    Sums go by blocks of columns first; only one row per block passes through the single running sum.
    """
    h = F.col("j_high") - F.col("j_low") + 1
    blocked = cols.withColumn("block", F.call_function("div", F.col("i").cast("long"), F.lit(block).cast("long")))
    sums = blocked.groupBy("block").agg(F.sum(h).alias("n"))
    before = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum(h).over(Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.join(before, "block").select("i", "j_low", "j_high", (F.col("base") + inside).cast("long").alias("tower_offset"))


def tiles(cols: DataFrame, q: Annulus) -> DataFrame:
    """(i, j, a_lo, b_lo, idx) of every tile of the towers; ``idx`` is its place in column order."""
    j = F.explode(F.sequence("j_low", "j_high")).alias("j")
    return cols.select("i", "j_low", "tower_offset", j).select("i", "j", (F.col("i") * q.side).alias("a_lo"), (F.col("j") * q.side).alias("b_lo"), (F.col("tower_offset") + F.col("j") - F.col("j_low")).alias("idx"))


def tile_at(cols: DataFrame, places: DataFrame) -> DataFrame:
    """F9 inverse: (idx, i, j) for rows (idx).  A place is matched to its column through buckets of places, so
    the range condition only filters within equal buckets."""
    width = 1024
    h = F.col("j_high") - F.col("j_low") + 1
    div = lambda x: F.call_function("div", x, F.lit(width).cast("long"))
    spread = cols.withColumn("bucket", F.explode(F.sequence(div(F.col("tower_offset")), div(F.col("tower_offset") + h - 1))))
    asked = places.select(F.col("idx").cast("long").alias("idx")).withColumn("bucket", div(F.col("idx")))
    hit = (F.col("idx") >= F.col("tower_offset")) & (F.col("idx") < F.col("tower_offset") + h)
    return asked.join(spread, "bucket").where(hit).select("idx", "i", (F.col("j_low") + F.col("idx") - F.col("tower_offset")).alias("j"))


def first_tiles(all_tiles: DataFrame, n: int) -> DataFrame:
    """The first ``n`` tiles in column order."""
    return all_tiles.where(F.col("idx") < n)


def selected(all_tiles: DataFrame, every: int = 1, start: int = 0, limit: int | None = None) -> DataFrame:
    """Every n-th tile from a start, at most ``limit`` of them."""
    place = F.col("idx") - start
    rows = all_tiles.where((place >= 0) & (place % every == 0))
    return rows if limit is None else rows.where(place < every * limit)


def is_active(i: Column, j: Column, q: Annulus) -> Column:
    """P9 point by point, for tiles from elsewhere: some lattice column of the square meets the annulus."""
    s = q.side
    xs = F.sequence(i * s, i * s + s)

    def meets(x: Column) -> Column:
        top = F.lit(q.outer_sq) - x * x
        lo = F.greatest(j * s, x, ceil_isqrt(F.lit(q.inner_sq) - x * x))
        hi = F.least(j * s + s, floor_isqrt(top))
        return (x >= 0) & (top >= 0) & (lo <= hi)

    return (i >= 0) & (j >= 0) & F.exists(xs, meets)


def invariant_violations(cols: DataFrame, block: int = 4096) -> DataFrame:
    """(i, rule) where neighbouring towers break the grid's invariants.

    ``gap``: columns aren't consecutive; ``empty``: a tower without tiles; ``shift``: an end moves by more than
    one; ``orphan``: neighbouring towers don't overlap.  Columns are compared within blocks, whose first column
    takes what the last block before it with any column has handed on, one row a block; no task orders all columns.
    """
    blocked = cols.select("i", "j_low", "j_high", F.call_function("div", F.col("i").cast("long"), F.lit(block).cast("long")).alias("block"))
    ends = blocked.groupBy("block").agg(F.max(F.struct("i", "j_low", "j_high")).alias("last"))
    carried = ends.select("block", F.lag("last").over(Window.orderBy("block")).alias("carry"))
    before = F.coalesce(F.lag(F.struct("i", "j_low", "j_high")).over(Window.partitionBy("block").orderBy("i")), F.col("carry"))
    seen = blocked.join(carried, "block").withColumn("before", before).select("i", "j_low", "j_high", F.col("before.i").alias("pi"), F.col("before.j_low").alias("pl"), F.col("before.j_high").alias("ph"))
    rules = {
        "gap": F.col("i") != F.col("pi") + 1,
        "empty": F.col("j_high") < F.col("j_low"),
        "shift": (F.abs(F.col("j_low") - F.col("pl")) > 1) | (F.col("j_high") - F.col("ph") > 0) | (F.col("ph") - F.col("j_high") > F.col("i") + 2),
        "orphan": (F.col("j_low") > F.col("ph")) | (F.col("j_high") < F.col("pl")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return seen.select("i", F.explode(found).alias("rule"))


def towers_of(tiles_: DataFrame) -> DataFrame:
    """Towers from a list of tiles (i, j): runs of consecutive j per column."""
    w = Window.partitionBy("i").orderBy("j")
    runs = tiles_.select("i", "j").distinct().withColumn("run", F.col("j") - F.row_number().over(w))
    return runs.groupBy("i", "run").agg(F.min("j").alias("j_low"), F.max("j").alias("j_high")).select("i", "j_low", "j_high")
