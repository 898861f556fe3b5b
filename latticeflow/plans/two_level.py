"""The two-level plan: summarise tiles, stitch their ports, label the small graph, decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.lineage import cut
from latticeflow.operators import stitch, tiles as T
from latticeflow.operators import verdict as V
from latticeflow.operators.components import label_vertices
from latticeflow.params import OVERFLOW_BIT, Annulus
from latticeflow.plans import flat
from latticeflow.sources.tiles import tiles, towers


#: Tiles that a task summarises, about a second of work.
TILES_PER_TASK = 48


@dataclass(frozen=True)
class TiledGraph:
    query: Annulus
    grid: DataFrame
    summaries: DataFrame
    groups: DataFrame
    edges: DataFrame

    def components(self) -> DataFrame:
        return V.component_reach(self.groups)

    def verdict(self) -> DataFrame:
        """SPANNING also if a tile overflowed (only with capacities on)."""
        return V.verdict(self.components(), self.summaries.where(F.col("tile_flags").bitwiseAND(F.lit(OVERFLOW_BIT)) != 0))


def solve(spark: SparkSession, q: Annulus, caps: bool = False, region: DataFrame | None = None, parts: int | None = None, points: DataFrame | None = None, known: bool = False) -> TiledGraph:
    """Solve over the whole octant, a ``region`` of tiles (i, j), or the primes among given ``points`` (a, b; ``known`` as
    in :func:`flat.vertices`).

    Ports of a face shared by two tiles must agree in number; a region that breaks this raises rather than
    guessing.  Components are only labelled over visible groups, far fewer than the primes.
    """
    if points is not None:
        rows = cut(T.summaries_of(flat.vertices(spark, q.strict(), points, known), q, caps))
        grid = rows.select("i", "j")
    else:
        grid = cut(tiles(towers(spark, q.strict() if region is None else q), q))
        if region is not None:
            grid = grid.join(region.select("i", "j").distinct(), ["i", "j"], "left_semi")
        rows = cut(T.summaries(grid, q, caps, parts or grid.count() // TILES_PER_TASK + 1))
    if bad := stitch.mismatches(rows).take(1):
        raise ValueError(f"port counts differ across a shared face: {bad[0]}")
    gid = stitch.group_id
    vertices = T.groups(rows).select(gid(F.col("i"), F.col("j"), F.col("label")).alias("id"), "i", "j", "label", "reach")
    edges = stitch.stitch_edges(T.ports(rows)).withColumn("a", gid(F.col("i"), F.col("j"), F.col("label"))).withColumn("b", gid(F.col("i2"), F.col("j2"), F.col("label2")))
    return TiledGraph(q, grid, rows, label_vertices(vertices, edges.select("a", "b")), edges)
