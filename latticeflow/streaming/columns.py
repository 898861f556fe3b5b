"""The streaming verdict (ST1-ST9, J7, T9): whole columns arrive in order; state is the right-hand frontier only.

A batch holds one or more whole columns.  Its groups, its stitches and the frontier of the column before
are one small graph; after labelling it, components without a port on the new right face are dropped (their
reach can't change any more).  Ids grow with the column, so the smallest id of a component is stable.

Late columns are errors, never dropped (ST6).  A missing column clears the frontier: nothing is stitched
across a gap (ST3).  State is written per batch to the shared folder, so a batch that is run again after a
failure begins from the state before it and has the same effect once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.lineage import cut, shared_folder
from latticeflow.operators import stitch
from latticeflow.operators import tiles as T
from latticeflow.operators.aggregates import run_totals
from latticeflow.operators.components import components
from latticeflow.params import BOTH, OVERFLOW_BIT, Annulus


class OrderError(ValueError):
    """A column came late, twice, or not whole."""


@dataclass
class Progress:
    """What a stream has seen besides its frontier."""

    last_column: int | None = None
    batches: int = 0
    tiles: int = 0
    spanning: bool = False
    first_spanning_batch: int | None = None
    totals: dict[str, int] = field(default_factory=dict)


class ColumnStream:
    """Ingests batches of summaries; ``towers`` (optional) tell how many tiles a whole column has."""

    def __init__(self, spark: SparkSession, towers: DataFrame | None = None, name: str = "columns"):
        self.spark, self.name = spark, name
        self.heights = None if towers is None else cut(towers.select("i", (F.col("j_high") - F.col("j_low") + 1).alias("height")))
        self.frontier: DataFrame | None = None
        self.progress = Progress()

    def _check_order(self, rows: DataFrame) -> tuple[int, int]:
        ends = rows.agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("i", "j").alias("d")).first()
        last = self.progress.last_column
        if last is not None and ends.lo <= last:
            raise OrderError(f"column {ends.lo} came after column {last}")
        if ends.n != ends.d:
            raise OrderError("a tile came twice")
        if self.heights is not None:
            seen = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
            bad = seen.join(self.heights, "i", "left").where(~F.col("n").eqNullSafe(F.col("height"))).take(1)
            if bad:
                raise OrderError(f"column {bad[0].i} has {bad[0].n} tiles of {bad[0].height}")
        return ends.lo, ends.hi

    def ingest(self, rows: DataFrame) -> bool:
        """ST1, ST2, J7: takes a batch of whole columns; returns whether a component spans by now."""
        rows = cut(rows.select(*[c.strip().split(" ")[0] for c in T.SCHEMA.split(", ")]))
        p = self.progress
        if not rows.take(1):
            return p.spanning
        lo, hi = self._check_order(rows)
        if bad := stitch.mismatches(rows).take(1):
            raise ValueError(f"port counts differ across a shared face: {bad[0]}")
        gid = lambda label: stitch.group_id(F.col("i"), F.col("j"), F.col(label))
        ports = cut(T.ports(rows))
        nodes = T.groups(rows).select(gid("label").alias("id"), "reach")
        inside = stitch.stitch_edges(ports).select(gid("label").alias("a"), stitch.group_id(F.col("i2"), F.col("j2"), F.col("label2")).alias("b"))
        before = self.frontier if p.last_column == lo - 1 else None
        if before is not None:
            left = ports.where((F.col("face") == "L") & (F.col("i") == lo)).select("j", "ordinal", gid("label").alias("b"))
            inside = inside.union(before.join(left, ["j", "ordinal"]).select(F.col("component").alias("a"), "b"))
            nodes = nodes.union(before.select(F.col("component").alias("id"), "reach").distinct())
        labels = components(inside)
        owned = cut(nodes.join(labels, nodes["id"] == labels["node"], "left").select("id", "reach", F.coalesce("component", "id").alias("component")))
        reached = owned.groupBy("component").agg(F.bit_or("reach").alias("reach"))
        overflow = rows.where(F.col("tile_flags").bitwiseAND(F.lit(OVERFLOW_BIT)) != 0)
        spans = bool(reached.where(F.col("reach") == BOTH).take(1)) or bool(overflow.take(1))
        right = ports.where((F.col("face") == "R") & (F.col("i") == hi)).select("j", "ordinal", gid("label").alias("id"))
        self.frontier = cut(right.join(owned.select("id", "component"), "id").join(reached, "component").select("j", "ordinal", "component", "reach"))
        p.last_column, p.batches, p.tiles = hi, p.batches + 1, p.tiles + rows.count()
        totals = run_totals(rows).first().asDict()
        p.totals = {k: p.totals.get(k, 0) + v for k, v in totals.items()}
        if spans and not p.spanning:
            p.spanning, p.first_spanning_batch = True, p.batches - 1
        return p.spanning

    def projected(self) -> DataFrame:
        """ST4: the frontier with components numbered from 1 by first appearance."""
        from latticeflow.operators.windows import first_appearance

        one = self.frontier.withColumn("one", F.lit(1))
        seen = first_appearance(one, ["one"], "component", ["j", "ordinal"], "number").drop("one")
        return self.frontier.join(seen, "component").select("j", "ordinal", "number", "reach")

    def verdict(self, total_tiles: int | None = None) -> str:
        """ST5: SPANNING at any time; MOAT only when every tile has been ingested."""
        if self.progress.spanning:
            return "SPANNING"
        if total_tiles is None and self.heights is not None:
            total_tiles = self.heights.agg(F.sum("height")).first()[0] or 0
        return "MOAT" if total_tiles is not None and self.progress.tiles == total_tiles else "UNKNOWN"

    # state on shared storage

    def save(self, folder: str, batch: int) -> None:
        at = f"{folder}/{batch}"
        state = self.frontier if self.frontier is not None else self.spark.createDataFrame([], "j long, ordinal int, component long, reach int")
        state.write.mode("overwrite").parquet(f"{at}/frontier")
        self.spark.createDataFrame([(json.dumps(asdict(self.progress)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/progress")

    def load(self, folder: str, batch: int) -> None:
        at = f"{folder}/{batch}"
        self.frontier = self.spark.read.parquet(f"{at}/frontier")
        self.progress = Progress(**json.loads(self.spark.read.text(f"{at}/progress").first().value))


def batches_of_columns(towers: DataFrame, target_tiles: int) -> DataFrame:
    """ST7: (i, batch, height): columns grouped so that batches begin at multiples of the target."""
    h = F.col("j_high") - F.col("j_low") + 1
    return towers.select("i", F.floor(F.col("tower_offset") / target_tiles).alias("batch"), h.alias("height"))


def run_batches(stream: ColumnStream, summarise: Callable[[DataFrame], DataFrame], tiles: DataFrame, plan: DataFrame, early_exit: bool = True) -> ColumnStream:
    """T9, ST9: summarises and ingests batch after batch, and stops once a component spans."""
    for b in [r.batch for r in plan.select("batch").distinct().orderBy("batch").collect()]:
        cols = plan.where(F.col("batch") == b).select("i")
        if stream.ingest(summarise(tiles.join(F.broadcast(cols), "i", "left_semi"))) and early_exit:
            break
    return stream


def run_stream(spark: SparkSession, source: str, towers: DataFrame | None = None, name: str = "columns", early_exit: bool = True, state: str | None = None) -> ColumnStream:
    """The same as a Structured Streaming query over a folder of Parquet files, one file of whole columns each.

    Files are taken in order of their modification time, one a trigger; the query ends when all are read, or
    early when a component spans.
    """
    stream = ColumnStream(spark, towers, name)
    state = state or f"{shared_folder(spark)}/stream-{name}"

    def take(batch: DataFrame, number: int) -> None:
        if number > 0:
            stream.load(state, number - 1)
        if not (early_exit and stream.progress.spanning):
            stream.ingest(batch)
        stream.save(state, number)

    query = (
        spark.readStream.schema(T.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        .writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream


def solve(spark: SparkSession, q: Annulus, target_tiles: int = 256, early_exit: bool = True) -> ColumnStream:
    """The streaming plan of an annulus: grid, batches of columns, summaries, frontier."""
    from latticeflow.sources.tiles import tiles, towers

    cols = cut(towers(spark, q.strict()))
    stream = ColumnStream(spark, cols)
    return run_batches(stream, lambda t: T.summaries(t, q, parts=max(1, target_tiles // 48)), tiles(cols, q), batches_of_columns(cols, target_tiles), early_exit)
