"""Helpers shared by the text operators: words, labelled samples, lineage cuts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from latticeflow.lineage import cut, shared_folder  # noqa: F401

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = "\x20\x09-\x0D"


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; ``bytes.split`` breaks at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shelved(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that an operator doesn't use under names that can't clash with its own, and the way back."""
    names = {c: c if c in used else f"shelved_{i}_" for i, c in enumerate(docs.columns)}
    back = lambda df: df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores appended until no column has it (Spark's names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def map_arrow(
    df: DataFrame,
    columns: list[str],
    schema: str,
    fn: Callable[[dict[str, list]], Iterator[dict[str, list]]],
    rows: int = 500,
) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that memory doesn't follow the batch size.

    ``fn`` gets a dict of Python lists by column and yields dicts of lists that fit ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = df.select(*[F.col(f"`{c}`") for c in columns])
    out = to_arrow_schema(session(df).createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = {c: part.column(i).to_pylist() for i, c in enumerate(columns)}
                for cols in fn(got):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return slim.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[list]]:
    """The columns of at most ``rows`` rows at a time, as Python lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield [c.to_pylist() for c in batch.slice(at, rows).columns]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from (null ids: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents (doc_id, text, y) outside the held-out fifth.

    The sample is drawn from the slim label table by hash order, so it is the same on every run; its ids,
    ``limit`` at most, are the side of the join that may be broadcast.  Ids with contradicting labels count
    once, with the smaller label; null labels and ids are ignored.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")


class Replayed:
    """Rows of a sample in a fixed order, to go through as often as wanted; the driver holds one of ``PARTS`` parts at a time.

    Parts go by a hash of ``key``, rows within one by ``order``, so the order doesn't depend on the input's partitions.
    """

    PARTS = 16

    def __init__(self, sample: DataFrame, key: str, order: list[str | Column], row: Callable[[Row], tuple]):
        self.rows, self.row = cut(sample.repartition(self.PARTS, key).sortWithinPartitions(*order)), row

    def __iter__(self) -> Iterator[tuple]:
        return map(self.row, self.rows.toLocalIterator())
