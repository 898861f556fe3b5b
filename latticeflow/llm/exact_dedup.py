"""Exact duplicates with a heavy-hitter split.

Texts are equal when their SHA-256 digests are (of the text after ``normalise``, by default unchanged).  Each task
keeps a Misra-Gries summary of the digests that it sees, ``COUNTERS`` at most; together the summaries hold every
digest of more than 1 / (COUNTERS + 1) of all rows.  The most frequent candidates are counted exactly; those that
do repeat, with the row that stays, are a table of at most ``COUNTERS`` rows that is broadcast, so that their copies
are settled where they are read.  All other digests, none of which is frequent, meet in an ordinary shuffle.

Defined cases: a null text equals the empty text; of rows with one text and one id, one stays; null ids are the
smallest (a group of null ids alone keeps one of them, ``keep_id`` null); an empty table gives no rows; extra
columns are ignored by :func:`mark` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import cut, shelved

#: Counters of a summary, and the most rows of the table that is broadcast.
COUNTERS = 1024


def digest(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    """SHA-256 of a text in UTF-8, 32 bytes; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2((normalise(whole) if normalise else whole).cast("binary"), 256))


def summary(counts: dict[bytes, int], more: tuple[list[bytes], list[int]], counters: int) -> dict[bytes, int]:
    """A Misra-Gries summary with further counted values: what is beyond the ``counters`` largest is taken off all."""
    for d, n in zip(*more, strict=True):
        counts[d] = counts.get(d, 0) + n
    if len(counts) <= counters:
        return counts
    least = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - counters - 1)[len(counts) - counters - 1])
    return {d: n - least for d, n in counts.items() if n > least}


def candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest): at most ``counters`` digests, among them all of more than 1 / (counters + 1) of the rows.

    A digest left out has at most the (counters + 1)-th largest sum, and its tasks took off at most what all sums
    lack of the rows, divided by counters + 1; so its rows are no more than that share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            counts = summary(counts, (found.field(0).to_pylist(), found.field(1).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    summed = digests.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def winners(rows: DataFrame, order: Column, counters: int = COUNTERS) -> DataFrame:
    """(digest, winner, group_size): the candidates that do repeat, counted exactly; ``winner`` is the largest ``order``."""
    found = rows.join(F.broadcast(cut(candidates(rows, counters))), "digest", "left_semi")
    return cut(found.groupBy("digest").agg(F.max(order).alias("winner"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))


def mark(docs: DataFrame, text: str = "text", key: str = "doc_id", normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row; the row with the largest key of its text is kept."""
    rows = cut(docs.select(F.col(f"`{key}`").alias("id"), digest(F.col(f"`{text}`"), normalise).alias("digest"), F.monotonically_increasing_id().alias("row")))
    order = F.struct("id", "row")
    heavy = F.broadcast(winners(rows, order, counters))
    settled = rows.join(heavy, "digest")
    by_text = Window.partitionBy("digest")
    others = rows.join(heavy.select("digest"), "digest", "left_anti")
    others = others.withColumns({"winner": F.max(order).over(by_text), "group_size": F.count(F.lit(1)).over(by_text)})
    return settled.unionByName(others).select(
        F.col("id").alias(key),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies of frequent texts leave where they are read; the rest is shuffled by digest, one row a text and task.  Of rows
    that share text and key, the one whose columns hash highest stays.
    """
    plain, back = shelved(docs, text, key)
    rows = plain.withColumn("digest", digest(F.col(f"`{text}`"), normalise))
    slim = rows.select("digest", F.col(f"`{key}`").alias("id"))
    heavy = winners(slim, F.col("id"), counters).select("digest", "winner")
    left = rows.join(F.broadcast(heavy), "digest", "left").where(F.col("winner").isNull() | (F.col("winner") == F.col(f"`{key}`")))
    order = F.struct(F.col(f"`{key}`"), F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in plain.dtypes]))
    best = left.groupBy("digest").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in plain.columns]), order).alias("row"))
    return back(best.select("row.*"))
