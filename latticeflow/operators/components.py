"""G1: connected components of an edge list, distributed, with checkpoints between rounds.

Each round joins what a partition knows (union-find over the edges that hash to it by their larger end, one
edge per node left), then jumps every edge to its target's own smallest target.  No node's neighbours are
gathered: after the first step a node has one edge per partition at most, and hub nodes only occur as
targets, which the jump joins from written data on both sides, so that Spark can split a hub's partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.lineage import cut


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b that aren't the smallest of their component, and that smallest node."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = where.reshape(-1)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _join_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 2_000_000:
            a, b = roots(a, b)
    if len(a):
        a, b = roots(a, b)
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])


#: A graph of so many edges at most is labelled by one task, which saves the rounds' jobs; its size is counted first.
SMALL = 200_000


def components(edges: DataFrame, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long) that isn't its component's smallest node.

    Nodes that are smallest, and isolated ones, are left out: their component is themselves.  Null ends and
    self-links are ignored; repeated and reversed edges do no harm.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if small:
        e = cut(e)
        if e.count() <= small:
            return cut(e.repartition(1).mapInArrow(_join_locally, "a long, b long").toDF("node", "component"))
    parts = lambda df: df.repartition(F.col("a")).mapInArrow(_join_locally, "a long, b long")
    for _ in range(most_rounds):
        e = cut(parts(e))
        least = cut(e.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")))
        up = least.select(F.col("a").alias("b"), F.col("b").alias("c"))
        moved = cut(e.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("jumped")))
        more = least.where("n > 1").limit(1).union(moved.where("jumped").select("a", "b", F.lit(1).cast("long")).limit(1))
        if not more.take(1):
            return least.select(F.col("a").alias("node"), F.col("b").alias("component"))
        e = moved.select("a", "b")
    raise RuntimeError("the components didn't settle")


def label_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Every vertex ``id`` with ``component``, the smallest id it reaches; isolated vertices are their own."""
    found = components(edges)
    return vertices.join(found, vertices["id"] == found["node"], "left").select(vertices["*"], F.coalesce("component", "id").alias("component"))
