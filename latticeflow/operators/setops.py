"""Set operations and record comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_distinct(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows, one per key."""
    return reduce(DataFrame.unionByName, frames).dropDuplicates(keys)


def intersection(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of both, each once."""
    return x.intersect(y)


def missing(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required rows that aren't present, each once."""
    return required.subtract(present)


def unknown_fields(fields: Column, allowed_names: list[str]) -> Column:
    """U4: keys of a map that aren't allowed."""
    return F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in allowed_names]))


def allowed(value: Column, names: list[str]) -> Column:
    """Membership; null is not allowed."""
    return F.coalesce(value.isin(names), F.lit(False))


def label_union(x: Column, y: Column) -> Column:
    """The distinct labels of two arrays."""
    return F.array_union(x, y)


def zipped(left: DataFrame, right: DataFrame, place: list[str]) -> DataFrame:
    """Rows of equal place side by side as structs ``left`` and ``right``; a side without a partner is null."""
    x = left.select(*place, F.struct(*left.columns).alias("left"))
    y = right.select(*place, F.struct(*right.columns).alias("right"))
    return x.join(y, place, "full").select(*place, "left", "right")


def differences(x: DataFrame, y: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): names of the fields in which rows of equal key differ, nulls compared as values."""
    both = x.alias("x").join(y.alias("y"), key)
    names = F.filter(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in fields]), lambda v: v.isNotNull())
    return both.select(key, names.alias("fields")).where(F.size("fields") > 0)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, change): rows ``added``, ``removed`` or ``changed``."""
    x = old.select(*keys, F.col(payload).alias("old_payload"), F.lit(True).alias("in_old"))
    y = new.select(*keys, F.col(payload).alias("new_payload"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_payload").eqNullSafe(F.col("new_payload")), "changed")
    return x.join(y, keys, "full").select(*keys, change.alias("change")).where("change is not null")
