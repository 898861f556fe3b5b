"""Window-like operators over ordered rows (W1-W10), each within a partition key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from latticeflow.lineage import cut


#: Rows of a key that one task orders; keys with more are ordered in blocks.
BLOCK_ROWS = 1_000_000


def _has_hot_key(df: DataFrame, by: list[str], limit: int | None) -> bool:
    limit = BLOCK_ROWS if limit is None else limit
    return not df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).isEmpty()


def running(df: DataFrame, by: list[str], order: list[str], local: Callable[[WindowSpec], Column], total: Column, name: str, limit: int | None = None) -> DataFrame:
    """Adds ``name``: a running value per key, ``local`` over a window plus the ``total`` of all that comes before it.

    With more than ``limit`` rows in a key, rows are split into ranges of (key, order), so that a hot key falls
    into many blocks: each block is summed, the sums of a key's earlier blocks are added to the block's own
    running values.  Rows that are equal in order stay in one block.
    """
    if not _has_hot_key(df, by, limit):
        return df.withColumn(name, local(Window.partitionBy(*by).orderBy(*order)))
    spread = cut(df.repartitionByRange(*by, *order).withColumn("block_", F.spark_partition_id()))
    sums = spread.groupBy(*by, "block_").agg(total.alias("of_block_"))
    earlier = Window.partitionBy(*by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"{c}_of_") for c in by], F.col("block_").alias("at_block_"), F.coalesce(F.sum("of_block_").over(earlier), F.lit(0)).alias("before_"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in by], F.col("block_") == F.col("at_block_"))
    valued = spread.withColumn(name, local(Window.partitionBy(*by, "block_").orderBy(*order)))
    return valued.join(before, same).select(*df.columns, (F.col(name) + F.col("before_")).alias(name))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, limit: int | None = None) -> DataFrame:
    """Adds places from 1 within each key."""
    return running(df, by, order, lambda w: F.row_number().over(w), F.count(F.lit(1)), name, limit)


def prefix_sums(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds the exclusive running sum of ``value``."""
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return running(df, by, order, before, F.coalesce(F.sum(value), F.lit(0)), name)


def compacted(df: DataFrame, by: list[str], order: list[str], keep: Column, name: str = "slot") -> DataFrame:
    """Rows that pass ``keep``, numbered from 0 within their key."""
    return numbered(df.where(keep), by, order, name).withColumn(name, F.col(name) - 1)


def first_appearance(df: DataFrame, by: list[str], key: str, order: list[str], name: str = "label") -> DataFrame:
    """Labels 1.. for the keys of each partition in the order in which they appear first.

    The first appearance of a key is its least row, so labels are dense ranks of a grouped minimum; the
    serial numbering pass becomes an aggregation and a window over distinct keys.
    """
    least = df.groupBy(*by, key).agg(F.min(F.struct(*order)).alias("least"))
    return running(least, by, ["least"], lambda w: F.dense_rank().over(w), F.count_distinct("least"), name).drop("least")


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Places from 1 within each key."""
    return numbered(df, by, order, name)


def reversals(df: DataFrame, by: list[str], order: str, state: str, before: str, after: str) -> DataFrame:
    """Rows in state ``after`` that come behind the first row in state ``before``; adds that row's ``order``.

    With state MOAT before SPANNING at a larger width this is the monotonicity finding.  The key's earliest
    ``before`` row is an aggregate, so no rows have to be sorted; rows without an order value come last.
    """
    first = df.where(F.col(state) == before).groupBy(*by).agg(F.min(order).alias("narrower"), F.count(F.lit(1)).alias("seen"))
    null_safe = None
    for c in by:
        test = df[c].eqNullSafe(first[c])
        null_safe = test if null_safe is None else null_safe & test
    joined = df.where(F.col(state) == after).join(first, null_safe).select(df["*"], "narrower")
    later = F.col("narrower").isNotNull() & (F.col(order).isNull() | (F.col(order) > F.col("narrower")))
    return joined.where(later)


def islands(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers per key: (first, last, size)."""
    runs = numbered(df.select(*by, value).distinct(), by, [value], "run").withColumn("run", F.col(value) - F.col("run"))
    return runs.groupBy(*by, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("size")).drop("run")


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds the ``columns`` of the row before in its key as ``prev_*``, and ``first_``, true for a key's first row; blocks aren't used."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns], (F.row_number().over(w) == 1).alias("first_"))


def with_previous_in_blocks(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """As :func:`with_previous`, and ``block_``, for keys of any size.

    Rows are split into ranges of (key, order).  Each block hands on its last row, one per block and key; a block's
    first row takes what the block before it in its key has handed on.
    """
    spread = cut(df.repartitionByRange(*by, *order).withColumn("block_", F.spark_partition_id()))
    seen = with_previous(spread, [*by, "block_"], order, columns)
    handed = spread.groupBy(*by, "block_").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last_"))
    carried = handed.select(*[F.col(c).alias(f"{c}_of_") for c in by], F.col("block_").alias("at_block_"), F.lag("last_").over(Window.partitionBy(*by).orderBy("block_")).alias("carry_"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in by], F.col("block_") == F.col("at_block_"))
    joined = seen.join(carried, same)
    before = lambda c: F.when(F.col("first_"), F.col(f"carry_.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}")
    return joined.select(*df.columns, "block_", *[before(c) for c in columns], (F.col("first_") & F.col("carry_").isNull()).alias("first_"))


def gap_clusters(df: DataFrame, by: list[str], order: list[str], apart: Column, name: str = "cluster", limit: int | None = None) -> DataFrame:
    """Adds cluster numbers from 1; a row for which ``apart`` (an expression over its own columns and
    those of the row before as ``prev_*``) holds begins a new one.  Sessions are the case of a time gap.

    With more than ``limit`` rows in a key, blocks hand on their last row and their number of new clusters.
    """
    others = [c for c in df.columns if c not in by]
    new = (F.col("first_") | F.coalesce(apart, F.lit(False))).cast("long")
    if not _has_hot_key(df, by, limit):
        seen = with_previous(df, by, order, others).withColumn("new_", new)
        w = Window.partitionBy(*by).orderBy(*order)
        return seen.withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*df.columns, name)
    order = [*order, "tie_"]  # rows that are equal in order stand in one order throughout
    seen = cut(with_previous_in_blocks(cut(df.withColumn("tie_", F.monotonically_increasing_id())), by, order, others).withColumn("new_", new))
    sums = seen.groupBy(*by, "block_").agg(F.sum("new_").alias("of_block_"))
    earlier = Window.partitionBy(*by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"{c}_of_") for c in by], F.col("block_").alias("at_block_"), F.coalesce(F.sum("of_block_").over(earlier), F.lit(0)).alias("before_"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_of_")) for c in by], F.col("block_") == F.col("at_block_"))
    local = F.sum("new_").over(Window.partitionBy(*by, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn(name, local).join(before, same).select(*df.columns, (F.col(name) + F.col("before_")).alias(name))


def broken_steps(df: DataFrame, by: list[str], order: str, a: str, b: str, k: int, limit: int | None = None) -> DataFrame:
    """Rows of a path whose squared step from the row before exceeds ``k``; paths of more than ``limit`` rows go by blocks."""
    placed = (with_previous_in_blocks if _has_hot_key(df, by, limit) else with_previous)(df, by, [order], [a, b])
    da, db = F.col(a) - F.col(f"prev_{a}"), F.col(b) - F.col(f"prev_{b}")
    return placed.withColumn("step_sq", da * da + db * db).where(F.col("step_sq") > k).select(*df.columns, "step_sq")


def interval_slowdown(df: DataFrame, by: list[str], order: str, every: int, amount: str, seconds: str) -> DataFrame:
    """(by, interval, amount, seconds, rate, slowdown): progress in intervals of ``every`` steps of ``order``.

    ``slowdown`` is the time of one unit against that of the key's first interval; null where no time passed or
    nothing was done.  Intervals are sums by key and number; only their rows are ordered.
    """
    number = F.call_function("div", F.col(order).cast("long"), F.lit(every).cast("long"))
    sums = df.groupBy(*by, number.alias("interval")).agg(F.sum(amount).alias("amount"), F.sum(seconds).alias("seconds"))
    each = sums.withColumn("rate", F.try_divide(F.col("amount").cast("double"), F.col("seconds").cast("double")))
    first = F.first("rate").over(Window.partitionBy(*by).orderBy("interval"))
    return each.withColumn("slowdown", F.try_divide(first, F.col("rate")))
