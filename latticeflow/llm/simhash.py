"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the text's word
shingles.  Two fingerprints within two bits differ by at most one bit in one of their two halves: every
fingerprint is indexed under the variants of each half with one bit wild, equal variants meet, and pairs
are verified.  Only distinct fingerprints are indexed.

Within a variant the fingerprints of a bucket can still be many (a large group of near copies).  A bucket
above ``LARGE`` is indexed again by variants of the rest, which leaves at most 2**18 values to a bucket;
inside a bucket, links are found by flipping bits and looking the values up, so the work follows the size
and not its square, and only a spanning forest of a bucket's links is emitted.

Defined cases: null and empty texts have the fingerprint zero, which links like any other; fewer words than
a shingle make one shingle of all words; repeated rows and equal texts share a fingerprint and so a
component; rows that repeat an id with different texts are different documents, each with its own links;
null ids keep their fingerprint and count as no id (their component is the smallest id reachable, null if
there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import cut, free_name, map_arrow, session
from latticeflow.operators.components import components, roots

SEED = 42
SHINGLE = 3
LARGE = 4096


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())), dtype=np.uint64, count=len(words) - width + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint's 64 bits as a long."""
    types = dict(docs.dtypes)
    columns = list(dict.fromkeys([*keep, text]))

    def run(cols: dict[str, list]) -> Iterator[dict[str, list]]:
        found = np.array([fingerprint(t) for t in cols[text]], dtype=np.uint64)
        yield {c: cols[c] for c in keep} | {"fp": found.view(np.int64).tolist()}

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp long"])
    return map_arrow(docs.withColumn(text, F.col(text).cast("string")), columns, schema, run)


def _flips(bits: list[int]) -> np.ndarray:
    one = [1 << b for b in bits]
    return np.array([*one, *(x | y for i, x in enumerate(one) for y in one[:i])], dtype=np.uint64)


_ALL = _flips(list(range(64)))


def links(values: np.ndarray, free: np.ndarray = _ALL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct values that differ by at most two bits, each once; ``free``: the flips to try."""
    n = len(values)
    if n < 2:
        return values[:0], values[:0]
    if n <= 2 * len(free):
        a, b = [], []
        step = max(1, 2_000_000 // n)
        for at in range(0, n, step):
            x = values[at : at + step, None] ^ values[None, :]
            i, j = np.nonzero(np.bitwise_count(x) <= 2)
            up = j > i + at
            a.append(values[i[up] + at])
            b.append(values[j[up]])
        return np.concatenate(a), np.concatenate(b)
    values = np.sort(values)
    a, b = [], []
    for flip in free:
        other = values ^ flip
        at = np.searchsorted(values, other)
        at[at == n] = 0
        hit = (values[at] == other) & (other > values)
        a.append(values[hit])
        b.append(other[hit])
    return np.concatenate(a), np.concatenate(b)


def _bucket_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) come sorted by key; emits a spanning forest of each bucket's links.

    Rows are read as a stream; the last bucket of a batch waits for the next one.
    """
    key, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def forest(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        a, b = [], []
        two = starts[sizes == 2]  # most buckets with company
        x, y = value[two], value[two + 1]
        close = (np.bitwise_count(x ^ y) <= 2) & (x != y)
        a.append(x[close])
        b.append(y[close])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            p, q = links(np.unique(value[s : s + n]))
            if len(p):
                p, q = roots(p.view(np.int64), q.view(np.int64))
                a.append(p.view(np.uint64))
                b.append(q.view(np.uint64))
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        value = np.concatenate([value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(key) and key[0] != key[-1]:
            last = int(np.searchsorted(key, key[-1]))
            yield from forest(key[:last], value[:last])
            key, value = key[last:], value[last:]
    if len(key):
        yield from forest(key, value)


def _variants(fps: DataFrame) -> DataFrame:
    """(key, half, fp): both halves with each bit wild.  A key is the half's other bits, with the wild bit's number
    and the half's number, hashed together; what hashing brings together by chance is verified away."""
    half = F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("half", "bits")
    wild = fps.select("fp", half).select("fp", "half", "bits", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("wild"))
    left = F.col("bits").bitwiseAND(F.expr("~shiftleft(1L, wild)"))
    return wild.select(F.xxhash64(left, "half", "wild").alias("key"), "half", "fp")


def _second_variants(rows: DataFrame) -> DataFrame:
    """The same within a large bucket (key, half, fp): both quarters of the half that the key doesn't fix, each
    with one bit wild.  Half 0 is the upper one, so its rows are cut by the two lower quarters.  Two fingerprints
    of a bucket differ by at most two bits there, so one of the quarters differs by at most one."""
    part = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    quarter = F.posexplode(F.array(F.when(F.col("half") == 0, part(0)).otherwise(part(2)), F.when(F.col("half") == 0, part(1)).otherwise(part(3)))).alias("quarter", "bits")
    wild = rows.select("key", "fp", quarter).select("key", "fp", "quarter", "bits", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("wild"))
    left = F.col("bits").bitwiseAND(F.expr("~shiftleft(1L, wild)"))
    return wild.select(F.xxhash64("key", left, "quarter", "wild").alias("key"), "fp")


def fingerprint_links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    forest = lambda rows: rows.select("key", "fp").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_bucket_forest, "a long, b long")
    # the variants are many times the fingerprints, so these are dealt out before
    spread = fps.repartition(max(1, int(session(fps).conf.get("spark.sql.shuffle.partitions"))))
    rows = _variants(spread)
    counts = rows.groupBy("key").count().where(F.col("count") > large).select("key")
    big = cut(counts)
    if not big.take(1):
        return forest(rows)
    hot = rows.join(big, "key", "left_semi")
    return forest(rows.join(big, "key", "left_anti")).union(forest(_second_variants(hot)))


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of each fingerprint: its component's smallest fingerprint and smallest document id."""
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    joined = components(fingerprint_links(classes.select("fp")), small=0)
    rooted = cut(classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return cut(rooted.join(least, "root").select("fp", "root", "component_id"))


def group(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document: its fingerprint, and the smallest id that links reach."""
    marked = cut(fingerprints(docs.select("doc_id", text), text=text))
    return marked.join(_classes(marked), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, of several with that id one by a hash of the text.

    All columns stay.  Rows without an id come last, so one of them stays only where its group has no id.  Of
    rows that repeat both id and text any one stays.
    """
    key, tag = (free_name(docs.columns, x) for x in ("simhash_id", "simhash_tag"))
    tagged = docs.select(F.col("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text).cast("string")).alias("tag"))
    marked = cut(fingerprints(tagged, keep=("doc_id", "tag")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"))).alias("first")
    firsts = cut(marked.join(_classes(marked).select("fp", "root"), "fp").groupBy("root").agg(first).select(F.col("first.id").alias(key), F.col("first.tag").alias(tag)))
    again = marked.groupBy("doc_id", "tag").count().where("count > 1")
    if not again.isEmpty():  # repeated rows go before the join, each task keeping one of them
        docs = docs.withColumn(tag, F.xxhash64(F.col(text).cast("string"))).dropDuplicates(["doc_id", tag]).drop(tag)
    return docs.join(firsts, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text).cast("string")) == F.col(tag)), "left_semi")
