"""Interaction of corpus filters: what each removes in every order of application.

Rows are range-sorted by (fingerprint of the text, text, doc_id).  One pass over a sorted part works out each row's
failure mask: bits of the filters that look at one text, and the bit of repeated texts from the row before.  Only
the first rows of a text can depend on another part, and only in the first and the last fingerprint of a part; these
few rows carry their text, meet by it, and the smallest id among them decides.  Masks are summed into counters of
32 cells a part of the corpus, from which the numbers of all orders follow by three matrix products.

Range bounds are of (fingerprint, doc_id), so texts aren't sampled to the driver, and a group of copies of any
size is spread over as many parts as its rows need.

Defined cases: a null text is empty; null, missing and repeated labels: a document is good or toxic if any label
row of its id says so; a null doc_id is no smaller id, and its row is no copy of one; rows with one id and one text
aren't copies of each other; a null ``part`` is the empty string; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import cut, slices

FILTERS = "ABCDE"
#: Fixed values of the conditions.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
CAPITALS, SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
COPY = 1 << FILTERS.index("E")
SWEPT = "doc_id long, part string, mask int, n long, edge string"


def own_mask(text: str) -> int:
    """Bits A to D: what a text fails by itself."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITALS_PERCENT * len(text),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


class Sweep:
    """One pass over rows (fingerprint, text, doc_id, part) in this order; rows out are (doc_id, part, mask, n, edge).

    ``edge`` is the text of rows whose copy bit is still open.  What is held is the first rows of the texts of one
    fingerprint; rows of one id, text and part are one row with its number ``n``.
    """

    def __init__(self) -> None:
        self.fingerprint: int | None = None
        self.inner = False  # a fingerprint has ended: the present one isn't the part's first
        self.text: str | None = None
        self.mask = 0
        self.least: int | None = None
        self.open: list[tuple[int, str, int, Counter]] = []

    def close(self, last: bool) -> Iterator[tuple]:
        edge = last or not self.inner
        for doc_id, text, mask, parts in self.open:
            for part, n in parts.items():
                yield doc_id, part, mask, n, text if edge else None
        self.open = []

    def row(self, fingerprint: int, text: str, doc_id: int | None, part: str) -> Iterator[tuple]:
        if fingerprint != self.fingerprint:
            if self.fingerprint is not None:
                yield from self.close(last=False)
                self.inner = True
            self.fingerprint, self.text = fingerprint, None
        if text != self.text:
            self.text, self.least, self.mask = text, None, own_mask(text)
        if doc_id is None:
            yield None, part, self.mask, 1, None
        elif self.least is None:
            self.least = doc_id
            self.open.append((doc_id, text, self.mask, Counter([part])))
        elif doc_id == self.least:
            self.open[-1][3][part] += 1
        else:
            yield doc_id, part, self.mask | COPY, 1, None


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): the failure mask of every document."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(whole).alias("fingerprint"), whole.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    ranged = rows.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, names, types = Sweep(), ["doc_id", "part", "mask", "n", "edge"], [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
        for cols in slices(batches, 500):
            if found := [x for row in zip(*cols, strict=True) for x in sweep.row(*row)]:
                yield made(found)
        if found := list(sweep.close(last=True)):
            yield made(found)

    swept = cut(ranged.mapInArrow(run, SWEPT))
    first = F.min("doc_id").over(Window.partitionBy("edge"))
    edges = swept.where("edge IS NOT NULL").select("doc_id", "part", F.when(F.col("doc_id") > first, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"), "n")
    return swept.where("edge IS NULL").select("doc_id", "part", "mask", "n").unionByName(edges)


def counters(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part, (mask, n, good, toxic) of the masks that occur, 32 at most."""
    flag = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).cast("long")).alias(c)
    told = labels.where("quality = 1 OR toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = marked.where("doc_id IS NOT NULL").join(told, "doc_id", "left")
    nameless = marked.where("doc_id IS NULL").withColumns({"quality": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    cells = known.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def orders(filters: str = FILTERS) -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(order, step, bit of its filter) of every order and step, and by mask whether a document is then kept, removed by the step, or fails it after its removal."""
    keys, kept, removed, redundant = [], [], [], []
    mask = np.arange(1 << len(filters))
    for order in permutations(range(len(filters))):
        before = 0
        for step, bit in enumerate(order, 1):
            keys.append(("".join(filters[b] for b in order), step, bit))
            alive, fails = (mask & before) == 0, (mask >> bit & 1) == 1
            removed.append(alive & fails)
            redundant.append(~alive & fails)
            before |= 1 << bit
            kept.append((mask & before) == 0)
    return keys, *(np.array(x, np.int64) for x in (kept, removed, redundant))


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with the numbers of documents that the step touches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, kept, removed, redundant = orders()
        bits = np.array([b for *_, b in keys])
        for frame in frames:
            for name, cells in zip(frame["part"], frame["cells"], strict=True):
                sums = np.zeros((1 << len(FILTERS), 3), np.int64)
                for cell in cells:
                    sums[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                lost = removed @ sums
                of_filter = np.array([lost[bits == b, 0].sum() for b in range(len(FILTERS))])
                yield pd.DataFrame({
                    "part": name, "filter_order": [k[0] for k in keys], "step": np.array([k[1] for k in keys], np.int32), "kept": kept @ sums[:, 0], "removed": lost[:, 0],
                    "redundant": redundant @ sums[:, 0], "unique_fails": sums[1 << bits, 0], "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": of_filter[bits],
                })

    return counters(masks(docs, part), labels).mapInPandas(run, AUDIT)


#: The same by whole texts and documents, for DuckDB.
SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), masks AS (
  SELECT t.doc_id, part,
    (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN t.doc_id > first_id THEN 16 ELSE 0 END) AS mask,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM texts t LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l ON t.doc_id = l.doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS bit
), orders AS (
  SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT array_to_string(list_transform(bits, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order, step, bits[step] AS bit,
    coalesce(list_sum(list_transform(bits[1:step - 1], lambda x: (1::BIGINT << x))), 0)::BIGINT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), told AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
    coalesce(sum(n) FILTER (mask & (before | (1::BIGINT << bit)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask >> bit & 1 = 1), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask >> bit & 1 = 1), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = 1::BIGINT << bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask >> bit & 1 = 1), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask >> bit & 1 = 1), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told
"""
