"""Stitching tiles (J5, J6, J8, F10): ports of shared faces meet by ordinal, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.params import OVERFLOW_BIT

#: Face of the lower tile, face of the upper tile, step in i, step in j, name of the event.
SHARED = (("O", "I", 0, 1, "match_io"), ("R", "L", 1, 0, "match_lr"))


def group_id(i: Column, j: Column, label: Column) -> Column:
    """one long per (tile, label), in (i, j, label) order: 24 bits for each coordinate, 15 for the label.

    Values outside these ranges raise an error, so that no two groups share a number.
    """
    fits = i.between(0, (1 << 24) - 1) & j.between(0, (1 << 24) - 1) & label.between(0, (1 << 15) - 1)
    made = F.shiftleft(i.cast("long"), 39).bitwiseOR(F.shiftleft(j.cast("long"), 15)).bitwiseOR(label.cast("long"))
    return F.when(fits, made).when(i.isNull() | j.isNull() | label.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("a tile or label is out of range for a group's number")).cast("long"))


def stitch_edges(ports: DataFrame) -> DataFrame:
    """(i, j, label, i2, j2, label2, event, ordinal): equal ordinals of the two sides of each shared face."""
    out = None
    for low, high, di, dj, event in SHARED:
        x = ports.where(F.col("face") == low).select("i", "j", "ordinal", "label")
        y = ports.where(F.col("face") == high).select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), "ordinal", F.col("label").alias("label2"))
        met = x.join(y, ["i", "j", "ordinal"]).select("i", "j", "label", (F.col("i") + di).alias("i2"), (F.col("j") + dj).alias("j2"), "label2", F.lit(event).alias("event"), "ordinal")
        out = met if out is None else out.union(met)
    return out


def mismatches(summaries: DataFrame) -> DataFrame:
    """Faces shared by two tiles that don't have equal port counts; overflow tiles take no part."""
    whole = summaries.where(F.col("tile_flags").bitwiseAND(F.lit(OVERFLOW_BIT)) == 0)
    out = None
    for low, high, di, dj, event in SHARED:
        place = {"I": 0, "O": 1, "L": 2, "R": 3}
        x = whole.select("i", "j", F.col("n")[place[low]].alias("n1"))
        y = whole.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("n")[place[high]].alias("n2"))
        bad = x.join(y, ["i", "j"]).where("n1 <> n2").select("i", "j", F.lit(event).alias("event"), "n1", "n2")
        out = bad if out is None else out.union(bad)
    return out


def offset_matches(ports: DataFrame, shift: int, side: int) -> DataFrame:
    """left/right matches of grids whose neighbour columns are shifted by ``shift``: h_left = h_right + shift,
    or, against the next tile, h_left + side - shift = h_right.  Both are equalities of computed places."""
    left = ports.where("face = 'R'").select("i", "j", "label", F.col("h").alias("place"))
    right = ports.where("face = 'L'").select((F.col("i") - 1).alias("i"), F.col("j").alias("j2"), F.col("label").alias("label2"), F.col("h"))
    same = left.join(right.select("i", F.col("j2").alias("j"), "label2", (F.col("h") + shift).alias("place")), ["i", "j", "place"]).select("i", "j", "label", F.col("j").alias("j2"), "label2")
    above = left.join(right.select("i", (F.col("j2") - 1).alias("j"), "label2", (F.col("h") - side + shift).alias("place")), ["i", "j", "place"]).select("i", "j", "label", (F.col("j") + 1).alias("j2"), "label2")
    return same.union(above)
