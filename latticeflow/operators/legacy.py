"""Operators of the older tile format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pruned(ports: DataFrame) -> DataFrame:
    """Ports (i, j, face, ordinal, label) without dead ends, groups seen once on one face; labels are made
    dense again in their old order."""
    by = Window.partitionBy("i", "j", "label")
    alive = ports.withColumn("seen", F.count(F.lit(1)).over(by)).where("seen > 1").drop("seen")
    return alive.withColumn("label", F.dense_rank().over(Window.partitionBy("i", "j").orderBy("label")))
