"""Regions of tiles (S4, P14): JSON documents naming the full octant, column boxes or a tile list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "full_octant boolean, i_lo long, i_hi long, columns array<struct<i:long,j_lo:long,j_hi:long>>, tiles array<struct<i:long,j:long>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Region documents with ``errors``; unknown or malformed fields fail the read."""
    return validated(spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path))


def validated(regions: DataFrame) -> DataFrame:
    """Adds ``errors``: why a region is refused (empty if it is fine)."""
    box = F.col("columns").isNotNull() | F.col("i_lo").isNotNull() | F.col("i_hi").isNotNull()
    listed = F.col("tiles").isNotNull()
    forms = F.coalesce(F.col("full_octant"), F.lit(False)).cast("int") + box.cast("int") + listed.cast("int")
    keys = F.transform("columns", lambda c: c["i"])
    want = F.when(F.col("i_lo") <= F.col("i_hi"), F.sequence("i_lo", "i_hi"))
    places = F.transform("tiles", lambda t: F.struct(t["i"], t["j"]))
    rules = {
        "no form of region is given": forms >= 1,
        "more than one form of region is given": forms <= 1,
        "a box needs i_lo, i_hi and columns": ~box | (F.col("i_lo").isNotNull() & F.col("i_hi").isNotNull() & F.col("columns").isNotNull()),
        "i_lo exceeds i_hi": ~box | F.coalesce(F.col("i_lo") <= F.col("i_hi"), F.lit(True)),
        "a column is inverted": ~box | F.coalesce(F.forall("columns", lambda c: c["j_lo"] <= c["j_hi"]), F.lit(True)),
        "a column is given twice": ~box | F.coalesce(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(True)),
        "columns leave a gap or pass the box": ~box | F.coalesce(F.array_sort(F.array_distinct(keys)) == want, F.lit(True)),
        "the tile list is empty": ~listed | (F.size("tiles") > 0),
        "a tile is given twice": ~listed | (F.size(F.array_distinct(places)) == F.size(places)),
    }
    return regions.withColumn("errors", F.filter(F.array(*[F.when(~ok, F.lit(m)) for m, ok in rules.items()]), lambda x: x.isNotNull()))


def tiles_of(regions: DataFrame, grid: DataFrame) -> DataFrame:
    """The grid's tiles (i, j, ...) that valid regions ask for; raises if a region has errors."""
    if bad := regions.where(F.size("errors") > 0).select("errors").take(1):
        raise ValueError("; ".join(bad[0].errors))
    boxes = regions.where("columns is not null").select(F.explode("columns").alias("c")).select("c.*")
    lists = regions.where("tiles is not null").select(F.explode("tiles").alias("t")).select("t.*")
    ranges = boxes.select("i", F.explode(F.sequence("j_lo", "j_hi")).alias("j")).union(lists).distinct()
    everything = regions.where("full_octant").limit(1)
    whole = grid.join(F.broadcast(everything.select(F.lit(True).alias("whole"))), F.lit(True), "left_semi")
    return grid.join(ranges, ["i", "j"], "left_semi").union(whole).distinct()


def clipped(towers: DataFrame, boxes: DataFrame) -> DataFrame:
    """(i, j_low, j_high) of towers within boxes (i, j_lo, j_hi); columns that miss their box go."""
    both = towers.join(boxes, "i").select("i", F.greatest("j_low", "j_lo").alias("j_low"), F.least("j_high", "j_hi").alias("j_high"))
    return both.where("j_low <= j_high")
