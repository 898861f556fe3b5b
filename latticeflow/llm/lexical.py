"""Ranked lexical search as a blocked sparse matrix product.

The items are the rows of a sparse matrix, item by term, whose values are multiplicities; the documents are the
columns of another, term by document, of whole-number impacts.  Items go in blocks of a bounded number of entries,
by hash; a block's matrix is broadcast.  A first pass over the documents counts what its weights need; a second
makes the impacts of some documents at a time, sorted by term, and merges for each item the rows of its terms into
one row of scores (Gustavson).  Each task keeps an item's best documents over all its blocks of documents; these
meet in two steps, by item and a share of the tasks, then by item.

Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are
lower-cased.  All but a term's weight is 64-bit whole numbers.

Defined cases: null and empty texts have no terms; documents without any don't count; very long texts are cut into
pieces between terms; rows of items with one id are one item (a null id too); repeated documents each have a rank,
ties go by ascending doc_id, null ids last; without documents or terms there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from latticeflow.llm.common import cut, map_arrow, session, slices

#: Entries (item, term) of a block of items, and (term, document) of a block of documents.
ITEM_ENTRIES, DOC_ENTRIES = 200_000, 2_000_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Shares of the tasks whose best rows meet before all do.
SHARES = 32
NO_ID = 2**63 - 1
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(text: str | None) -> tuple[int, Counter[bytes]]:
    """The number of a text's terms, repeats included, and how often each occurs."""
    n, times = 0, Counter()
    for found in pieces(text):
        n += len(found)
        times.update(found)
    return n, times


@dataclass
class Items:
    """A block of items: row r has terms ``terms[start[r]:start[r + 1]]`` with multiplicities ``times``; terms are numbered by ``number``."""

    ids: list = field(default_factory=list)
    start: list[int] = field(default_factory=lambda: [0])
    terms: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)

    def add(self, item_id: object, term: bytes, times: int) -> None:
        if not self.ids or self.ids[-1] != item_id:
            self.ids.append(item_id)
            self.start.append(len(self.terms))
        self.terms.append(self.number.setdefault(term, len(self.number)))
        self.times.append(times)
        self.start[-1] = len(self.terms)


def item_terms(items: DataFrame, once: bool) -> DataFrame:
    """(item_id, term, times): the terms of each item, ``times`` 1 if they count once."""

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        found = [(i, t, 1 if once else n) for i, text in zip(cols["item_id"], cols["text"], strict=True) for t, n in counted(text)[1].items()]
        yield {"item_id": [x[0] for x in found], "term": [x[1] for x in found], "times": [x[2] for x in found]}

    told = map_arrow(items.select("item_id", F.col("text").cast("string").alias("text")), ["item_id", "text"], f"item_id {dict(items.dtypes)['item_id']}, term binary, times long", run)
    return told.groupBy("item_id", "term").agg((F.max if once else F.sum)("times").alias("times"))


def item_blocks(items: DataFrame, once: bool, entries: int) -> Iterator[Items]:
    """The items in blocks of about ``entries`` entries at most (one item's more, if it has more)."""
    told = cut(item_terms(items, once))
    blocks = max(1, math.ceil(told.count() / (0.8 * entries)))
    for b in range(blocks):
        block = Items()
        for r in told.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").collect():
            block.add(r.item_id, bytes(r.term), r.times)
        if block.ids:
            yield block


def statistics(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and the documents that hold each numbered term."""
    sent = session(docs).sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        holders, n_docs, n_terms = np.zeros(len(known), np.int64), 0, 0
        for (texts,) in slices(batches, 500):
            for text in texts:
                n, times = counted(text)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                holders[[known[t] for t in times.keys() & known.keys()]] += 1
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, held], pa.int64()), pa.array(np.r_[n_docs, n_terms, holders[held]], pa.int64())], ["term", "n"])

    found = {r.term: r.n for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(len(number))], np.int64)


def weights(n_docs: int, holders: np.ndarray) -> np.ndarray:
    """Whole thousandths of a term's logarithmic rarity."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holders], np.int64)


class Best:
    """An item's ``k`` best documents so far: scores downwards, ids upwards."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[-1] if len(self.scores) == self.k else 1
        at = np.flatnonzero(scores >= least)
        if len(at) > self.k:
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
        if len(at):
            scores, ids = np.r_[self.scores, scores[at]], np.r_[self.ids, ids[at]]
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class DocBlock:
    """Documents that wait to be multiplied: their ids, lengths and (term, document, occurrences) entries."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[int] = []
        self.docs: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, n: int, found: list[tuple[int, int]]) -> None:
        for term, tf in found:
            self.terms.append(term)
            self.docs.append(len(self.ids))
            self.tf.append(tf)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(n)

    def rows(self, w: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's matrix, term by document: where each term's row begins, documents, impacts."""
        m = np.array([100 - 50 + (50 * n * n_docs) // n_terms for n in self.lengths], np.int64)
        terms, docs, tf = (np.array(x, np.int64) for x in (self.terms, self.docs, self.tf))
        order = np.argsort(terms, kind="stable")
        terms, docs, tf = terms[order], docs[order], tf[order]
        impacts = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
        return np.searchsorted(terms, np.arange(len(w) + 1)), docs, impacts

    def multiply(self, items: Items, w: np.ndarray, n_docs: int, n_terms: int, best: list[Best]) -> None:
        """Each item's row of scores over the block's documents goes to its best."""
        begin, docs, impacts = self.rows(w, n_docs, n_terms)
        ids = np.array(self.ids, np.int64)
        for r, mine in enumerate(best):
            scores = np.zeros(len(ids), np.int64)
            for e in range(items.start[r], items.start[r + 1]):
                a, b = begin[items.terms[e]], begin[items.terms[e] + 1]
                scores[docs[a:b]] += items.times[e] * impacts[a:b]
            mine.take(scores, ids)


def _product(docs: DataFrame, items: Items, k: int, id_type: str) -> DataFrame:
    n_docs, n_terms, holders = statistics(docs, items.number)
    sent = session(docs).sparkContext.broadcast((items, weights(n_docs, holders)))
    arrow = to_arrow_type(docs.sparkSession.createDataFrame([], f"x {id_type}").schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = sent.value
        best, block = [Best(k) for _ in items.ids], DocBlock()
        for ids, texts in slices(batches, 500):
            for doc_id, text in zip(ids, texts, strict=True):
                n, times = counted(text)
                if found := [(items.number[t], times[t]) for t in times.keys() & items.number.keys()]:
                    block.add(doc_id, n, found)
                if len(block.tf) >= DOC_ENTRIES:
                    block.multiply(items, w, n_docs, n_terms, best)
                    block = DocBlock()
        if block.ids:
            block.multiply(items, w, n_docs, n_terms, best)
        for item_id, mine in zip(items.ids, best, strict=True):
            if len(mine.ids):
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(mine.ids), arrow), pa.array(mine.ids, mask=mine.ids == NO_ID), pa.array(mine.scores)], ["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"item_id {id_type}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, once: bool = True, entries: int = ITEM_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of a score above 0.

    ``once``: an item's terms count once each; else as often as the item has them.
    """
    id_type = dict(items.dtypes)["item_id"]
    found = [_product(docs, block, k, id_type) for block in item_blocks(items, once, entries)]
    if not found:
        return session(docs).createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    ranked = reduce(DataFrame.unionByName, found).withColumn("share", F.spark_partition_id() % SHARES)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for group in (["item_id", "share"], ["item_id"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same by a join of terms, for DuckDB.
SQL = """
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term
), weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
