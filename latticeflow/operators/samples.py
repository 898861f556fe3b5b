"""Audit of tile samples (J13, A9, U5): each sampled tile is summarised again and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.operators import tiles as T
from latticeflow.operators.aggregates import messages
from latticeflow.operators.sampling import CLASSES
from latticeflow.params import Annulus
from latticeflow.sources.tiles import is_active


def _labels(flags):
    numbers = F.sequence(F.lit(1), 8 * F.size(flags))
    return F.filter(numbers, lambda x: F.getbit(F.element_at(flags, F.floor((x - 1) / 8).cast("int") + 1), F.pmod(x - 1, F.lit(8))) == 1)


def audited(samples: DataFrame, q: Annulus) -> DataFrame:
    """(i, j, sample_class, errors) of samples of one run; see ``documents.SAMPLES``.

    A sample must belong to the run, stand at its tile's place, be active, be given once, and equal the tile's
    fresh summary: port counts, flags, and labels up to renumbering.
    """
    s = samples.select("*", "tile.*").withColumn("times", F.count(F.lit(1)).over(_by_tile()))
    total = F.aggregate("tileop.n", F.lit(0), lambda a, x: a + x)
    told = F.transform(F.slice("tileop.face_groups", F.lit(1), F.greatest(total, F.lit(0))), lambda x: x)
    given = T.signature(told, _labels(F.col("tileop.inner_flags")), _labels(F.col("tileop.outer_flags")))
    fresh = T.summaries(s.where((F.col("i") >= 0) & (F.col("j") >= 0)).select("i", "j").distinct(), q, caps=True).select("i", "j", F.col("n").alias("true_n"), F.col("tile_flags").alias("true_flags"), T.signature(F.col("face_groups"), F.col("inner"), F.col("outer")).alias("true_signature"))
    rules = {
        "sample belongs to another run": (F.col("k_sq") == q.k) & (F.col("r_inner") == q.r_inner) & (F.col("r_outer") == q.r_outer) & (F.col("width") == q.r_outer - q.r_inner) & (F.col("region") == "full-octant"),
        "unknown sample class": F.col("sample_class").isin(list(CLASSES)),
        "tile is not at its place": (F.col("a_lo") == F.col("i") * q.side) & (F.col("b_lo") == F.col("j") * q.side),
        "tile is outside the active grid": is_active(F.col("i"), F.col("j"), q),
        "tile is sampled twice": F.col("times") == 1,
        "port counts differ": F.col("tileop.n") == F.col("true_n"),
        "labels differ": given == F.col("true_signature"),
        "flags differ": F.col("tileop.tile_flags") == F.col("true_flags"),
    }
    return s.join(fresh, ["i", "j"], "left").select("i", "j", "sample_class", messages(rules).alias("errors"))


def _by_tile():
    from pyspark.sql import Window

    return Window.partitionBy("i", "j")
