"""Evidence for a span (G6-G11): the event that first joined the bands, a checkable path, and its checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticeflow.functions.bands import in_octant, inner_band, outer_band
from latticeflow.functions.primes import gaussian_prime
from latticeflow.lineage import cut
from latticeflow.operators import aggregates, edges
from latticeflow.operators import stitch
from latticeflow.operators import tiles as T
from latticeflow.operators.components import components
from latticeflow.params import BOTH, INNER, OUTER, Annulus
from latticeflow.plans import flat, two_level

#: Events that one task folds in order; longer histories are first narrowed to one column.
FOLD_LIMIT = 1_000_000
SOURCES = ((INNER, "inner_source"), (OUTER, "outer_source"))


def _no_sources() -> list[Column]:
    return [F.lit(None).cast("long").alias(name) for _, name in SOURCES]


def events(graph: two_level.TiledGraph) -> DataFrame:
    """The history of a column-ordered ingest: (i, phase, j, ordinal, event, a, b, bits, inner_source, outer_source),
    ordered by the first four.

    Phase 0 are a column's tiles in order (their flags, then their join with the tile below), phase 1 its
    joins with the column to the left.  A mark's group is the source of its bits.
    """
    g = graph.groups
    marks = g.where("reach > 0").select("i", F.lit(0).alias("phase"), F.col("j"), (F.col("label") - 1_000_000).cast("int").alias("ordinal"), F.lit("mark").alias("event"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("reach").alias("bits"), *[F.when(F.col("reach").bitwiseAND(F.lit(bit)) != 0, F.col("id")).alias(name) for bit, name in SOURCES])
    joins = graph.edges.select(F.col("i2").alias("i"), F.when(F.col("event") == "match_lr", 1).otherwise(0).alias("phase"), F.col("j2").alias("j"), F.col("ordinal").cast("int").alias("ordinal"), "event", "a", "b", F.lit(0).alias("bits"), *_no_sources())
    return marks.unionByName(joins)


_FIRST = "i long, phase int, j long, ordinal int, event string, a long, b long, before_a int, before_b int, inner_source long, outer_source long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays sorted events with union-find until a component has both bits.

    A component carries the first source of each bit.  Marks come in the order of their groups' numbers, so the
    first of two is the smaller one.
    """
    parent: dict[int, int] = {}
    reach: dict[int, int] = {}
    first: dict[int, list[int]] = {}
    none = (1 << 63) - 1

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    done = False
    for batch in batches:
        if done:
            continue
        for i, phase, j, ordinal, event, a, b, bits, *marked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = find(a), find(b)
            p, q = reach.get(x, 0), reach.get(y, 0) | (bits or 0)
            lo, hi = min(x, y), max(x, y)
            if lo != hi:
                parent[hi] = lo
            reach[lo] = p | q
            told = [first[r] for r in {x, y} if r in first] + ([[none if s is None else s for s in marked]] if bits else [])
            if told:
                first[lo] = [min(s) for s in zip(*told, strict=True)]
            if reach[lo] == BOTH and p != BOTH:
                yield pa.RecordBatch.from_pydict({"i": [i], "phase": pa.array([phase], pa.int32()), "j": [j], "ordinal": pa.array([ordinal], pa.int32()), "event": [event], "a": [a], "b": [b], "before_a": pa.array([p], pa.int32()), "before_b": pa.array([reach.get(y, 0) if event != "mark" else p], pa.int32()), "inner_source": [first[lo][0]], "outer_source": [first[lo][1]]})
                done = True
                break


def first_event(graph: two_level.TiledGraph, limit: int = FOLD_LIMIT) -> DataFrame:
    """The first event after which a component touches both bands (no row for a moat), with the group that first
    brought each band into it.

    Histories up to ``limit`` events are replayed in one task.  Longer ones are bisected by column with
    distributed components of each prefix; the columns before the deciding one enter the replay as their
    components only.
    """
    history = cut(events(graph))
    if history.count() > limit:
        history = _narrowed(graph, history)
    ordered = history.repartition(1).sortWithinPartitions("i", "phase", "j", "ordinal")
    return ordered.mapInArrow(_fold, _FIRST)


def _narrowed(graph: two_level.TiledGraph, history: DataFrame) -> DataFrame:
    ends = history.agg(F.min("i"), F.max("i")).first()
    lo, hi = ends[0], ends[1]

    def prefix(column: int) -> DataFrame:
        labels = components(history.where((F.col("i") <= column) & (F.col("event") != "mark")).select("a", "b"))
        marks = history.where((F.col("i") <= column) & (F.col("event") == "mark")).select(F.col("a").alias("node"), "bits", *[name for _, name in SOURCES])
        return marks.join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("a")).agg(F.bit_or("bits").alias("bits"), *[F.min(name).alias(name) for _, name in SOURCES])

    while lo < hi:
        middle = (lo + hi) // 2
        if prefix(middle).where(F.col("bits") == BOTH).take(1):
            hi = middle
        else:
            lo = middle + 1
    known = prefix(lo - 1).select(F.lit(lo).alias("i"), F.lit(-2).alias("phase"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("ordinal"), F.lit("mark").alias("event"), "a", F.col("a").alias("b"), "bits", *[name for _, name in SOURCES])
    labels = components(history.where((F.col("i") < lo) & (F.col("event") != "mark")).select("a", "b"))
    now = history.where(F.col("i") == lo)
    used = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    links = labels.join(used, "node", "left_semi").select(F.lit(lo).alias("i"), F.lit(-1).alias("phase"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("ordinal"), F.lit("earlier").alias("event"), F.col("node").alias("a"), F.col("component").alias("b"), F.lit(0).alias("bits"), *_no_sources())
    return cut(known.unionByName(links).unionByName(now))


#: Points whose links are found by sending the points to all tasks; more are met by a shuffle of the links.
SENT = 250_000


def shortest_path(links: DataFrame, sources: DataFrame, targets: DataFrame, limit: int | None = None, stored: bool = False) -> DataFrame:
    """(pos, id): a path with fewest links from a source to a target; no row if there is none.

    Of several it is the one that ends in the smallest target and comes to each point from the smallest point
    one level nearer to the sources.  Graphs of up to ``limit`` links (counted first) are searched by one task,
    larger ones level by level as joins.  ``stored``: the links are a stored table's columns, which each level reads
    again instead of a copy; such a graph isn't counted, and always searched level by level.
    """
    limit = FOLD_LIMIT if limit is None else limit
    if stored:
        return _path_by_levels(links.select("a", "b").where("a <> b"), sources, targets)
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    if both.count() > 2 * limit:
        return _path_by_levels(both.where("a < b"), sources, targets)
    rows = both.select(F.lit(0).alias("kind"), "a", "b").union(sources.select(F.lit(1), "id", "id")).union(targets.select(F.lit(2), "id", "id"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        kind, a, b = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in range(3))
        goals = np.unique(b[kind == 2])
        x, y = a[kind == 0], b[kind == 0]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        level = np.unique(a[kind == 1])
        before = dict.fromkeys(level.tolist())
        while len(level):
            if len(met := np.intersect1d(level, goals)):
                path = [int(met[0])]
                while before[path[-1]] is not None:
                    path.append(before[path[-1]])
                path.reverse()
                yield pa.RecordBatch.from_pydict({"pos": pa.array(range(len(path)), pa.int64()), "id": pa.array(path, pa.int64())})
                return
            further = []
            for u in level.tolist():  # in ascending order, so the smallest comes first
                for v in y[np.searchsorted(x, u) : np.searchsorted(x, u, side="right")].tolist():
                    if v not in before:
                        before[v] = u
                        further.append(v)
            level = np.array(sorted(further), np.int64)

    return rows.repartition(1).mapInArrow(search, "pos long, id long")


def _beyond(links: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(before, id): the links of ``n`` points, from the point to the other end, of links (a, b) that are held once.

    Few points are sent to where the links are, so that a level moves what it finds and not the graph.
    """
    at = ids.select(F.col("id").alias("before"))
    at = F.broadcast(at) if n <= SENT else at
    ways = [links.join(at, F.col(x) == F.col("before")).select("before", F.col(y).alias("id")) for x, y in ("ab", "ba")]
    return ways[0].union(ways[1])


def _path_by_levels(links: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The same by joins, from both ends: the smaller frontier grows until the two meet.

    Of the points where they meet only what lies on a shortest path goes on, through the targets' levels, so that
    the smallest target is found among all of that distance.  A level leaves out the two before.  Only the path's
    own points, one per level, come to the driver.
    """
    empty = links.sparkSession.createDataFrame([], "pos long, id long")
    near, far = ([cut(ends.select("id").where("id IS NOT NULL").distinct())] for ends in (sources, targets))
    sizes = [near[0].count(), far[0].count()]
    while all(sizes):
        ahead = [cut(near[-1].join(far[-1], "id", "left_semi"))]
        if not ahead[0].isEmpty():
            break
        side = 0 if sizes[0] <= sizes[1] else 1
        grown = (near, far)[side]
        reached = _beyond(links, grown[-1], sizes[side]).select("id").distinct()
        for seen in grown[-2:]:
            reached = reached.join(seen, "id", "left_anti")
        grown.append(cut(reached))
        sizes[side] = grown[-1].count()
    else:
        return empty
    for level in reversed(far[:-1]):
        step = _beyond(links, ahead[-1], ahead[-1].count()).groupBy("id").agg(F.min("before").alias("before"))
        ahead.append(cut(step.join(level, "id", "left_semi")))
    path = [ahead[-1].agg(F.min("id")).first()[0]]
    for level in reversed(ahead[1:]):
        path.append(level.where(F.col("id") == path[-1]).first().before)
    for level in reversed(near[:-1]):
        back = links.where(F.col("b") == path[-1]).select(F.col("a").alias("id")).union(links.where(F.col("a") == path[-1]).select(F.col("b").alias("id")))
        path.append(back.join(level, "id", "left_semi").agg(F.min("id")).first()[0])
    return links.sparkSession.createDataFrame([(len(path) - 1 - k, x) for k, x in enumerate(path)], "pos long, id long")


def span_chain(graph: two_level.TiledGraph, limit: int | None = None) -> DataFrame:
    """(pos, side, id): the groups from the first inner source to the first outer one, over the link that joined them.

    Each half is a shortest path over the links that came before that one, which is itself excluded; ``side`` tells
    the halves apart, and the link leads from the last ``inner`` to the first ``outer`` group.  No row for a moat,
    nor if a mark, not a link, was the first to span.
    """
    spark = graph.edges.sparkSession
    found = first_event(graph, FOLD_LIMIT if limit is None else limit).first()
    if found is None or found.event == "mark":
        return spark.createDataFrame([], "pos long, side string, id long")
    order = F.struct("i", "phase", "j", "ordinal")
    last = F.struct(F.lit(found.i).alias("i"), F.lit(found.phase).alias("phase"), F.lit(found.j).alias("j"), F.lit(found.ordinal).alias("ordinal"))
    links = cut(events(graph).where((F.col("event") != "mark") & (order < last)).select("a", "b"))
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    inner, outer = (found.a, found.b) if found.before_a & INNER else (found.b, found.a)
    head = cut(shortest_path(links, one(found.inner_source), one(inner), limit).select("pos", F.lit("inner").alias("side"), "id"))
    tail = shortest_path(links, one(outer), one(found.outer_source), limit)
    return head.unionByName(tail.select((F.col("pos") + head.count()).alias("pos"), F.lit("outer").alias("side"), "id"))


def tube(graph: two_level.TiledGraph) -> DataFrame:
    """The tiles (i, j) of a shortest stitch path from an inner to an outer group."""
    ends = lambda bit: graph.groups.where(F.col("reach").bitwiseAND(F.lit(bit)) != 0).select("id")
    path = shortest_path(graph.edges.select("a", "b"), ends(INNER), ends(OUTER))
    return path.join(graph.groups.select("id", "i", "j"), "id").select("i", "j").distinct()


def tube_primes(spark: SparkSession, tiles: DataFrame, q: Annulus) -> DataFrame:
    """The primes of the tiles' widened squares, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = T.halo_primes(i * q.side, j * q.side, q)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiles.select("i", "j").mapInArrow(run, "a long, b long").dropDuplicates(["a", "b"])


def span_path(spark: SparkSession, q: Annulus) -> DataFrame:
    """(pos, a, b): a path of primes from the inner to the outer band; no row for a moat.

    First a tube of tiles on the port graph, then a search among the primes of that tube alone.
    """
    graph = two_level.solve(spark, q)
    found = cut(tube(graph))
    norm = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    v = cut(tube_primes(spark, found, q).withColumn("id", edges.point_id("a", "b")).withColumn("norm", norm))
    links = flat.edge_ids(v, q.k)
    path = shortest_path(links, v.where(inner_band(F.col("norm"), q)).select("id"), v.where(outer_band(F.col("norm"), q)).select("id"))
    return path.join(v, "id").select("pos", "a", "b")


def check_path(path: DataFrame, q: Annulus) -> DataFrame:
    """One row (ok, errors) for one path (pos, a, b)."""
    rows = path.select(F.lit("path").alias("claim_id"), "pos", "a", "b", F.lit(q.k).alias("k_sq"), F.lit(q.r_inner).alias("r_inner"), F.lit(q.r_outer).alias("r_outer"))
    return check_points(rows).select("ok", F.array_join("errors", "; ").alias("errors"))


def check_points(points: DataFrame) -> DataFrame:
    """(claim_id, points, ok, errors) for paths (claim_id, pos, a, b, k_sq, r_inner, r_outer).

    A path has at least two points, all primes of the octant annulus; steps are at most sqrt(k) and not zero;
    it begins in the inner and ends in the outer band.
    """
    w = Window.partitionBy("claim_id").orderBy("pos")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    norm = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    wide = lambda x: x.cast("decimal(19,0)")
    eps = lambda r: norm - F.col(r) * F.col(r) - F.col("k_sq")
    band = lambda r: wide(eps(r)) * wide(eps(r)) <= (wide(4 * F.col("k_sq")) * wide(F.col(r) * F.col(r))).cast("decimal(38,0)")
    seen = points.withColumn("step_sq", d("a") * d("a") + d("b") * d("b")).withColumn("place", F.row_number().over(w)).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy("claim_id")))
    flags = seen.select(
        "claim_id", "place", "last",
        in_octant(F.col("a"), F.col("b")).alias("octant"),
        norm.between(F.col("r_inner") * F.col("r_inner"), F.col("r_outer") * F.col("r_outer")).alias("annulus"),
        gaussian_prime(F.col("a"), F.col("b")).alias("prime"),
        (F.col("step_sq").isNull() | F.col("step_sq").between(1, F.col("k_sq"))).alias("step"),
        ((F.col("place") > 1) | band("r_inner")).alias("start"),
        ((F.col("place") < F.col("last")) | band("r_outer")).alias("stop"),
    )
    told = flags.groupBy("claim_id").agg(F.count(F.lit(1)).alias("points"), *[F.bool_and(c).alias(c) for c in ("octant", "annulus", "prime", "step", "start", "stop")])
    errors = aggregates.messages(
        {
            "path has fewer than two points": F.col("points") >= 2,
            "point outside the octant": F.col("octant"),
            "point outside the annulus": F.col("annulus"),
            "point is not a Gaussian prime": F.col("prime"),
            "step is zero or too long": F.col("step"),
            "first point is not in the inner band": F.col("start"),
            "last point is not in the outer band": F.col("stop"),
        }
    )
    return told.select("claim_id", "points", (F.size(errors) == 0).alias("ok"), errors.alias("errors"))


def check_stitch_path(steps: DataFrame) -> DataFrame:
    """(claim_id, ok, errors) for stitch paths (claim_id, pos, i, j, label, face, ordinal, i2, j2, label2, face2,
    ordinal2, event): a step begins at the group where the one before ended, joins equal ordinals, and its
    faces and tiles are those of its event."""
    w = Window.partitionBy("claim_id").orderBy("pos")
    back = lambda c: F.lag(c).over(w)
    joined = back("i2").isNull() | ((F.col("i") == back("i2")) & (F.col("j") == back("j2")) & (F.col("label") == back("label2")))
    shapes = [(F.col("event") == e) & (F.col("face") == x) & (F.col("face2") == y) & (F.col("i2") - F.col("i") == s * di) & (F.col("j2") - F.col("j") == s * dj) for low, high, di, dj, e in stitch.SHARED for x, y, s in ((low, high, 1), (high, low, -1))]
    shape = shapes[0] | shapes[1] | shapes[2] | shapes[3]
    flags = steps.select("claim_id", joined.alias("joined"), (F.col("ordinal") == F.col("ordinal2")).alias("equal"), shape.alias("shape"))
    told = flags.groupBy("claim_id").agg(*[F.bool_and(c).alias(c) for c in ("joined", "equal", "shape")])
    errors = aggregates.messages({"steps do not follow each other": F.col("joined"), "ordinals differ": F.col("equal"), "faces do not fit the event": F.col("shape")})
    return told.select("claim_id", (F.size(errors) == 0).alias("ok"), errors.alias("errors"))
