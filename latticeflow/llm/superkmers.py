"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words.  Its minimiser is the smallest hash of its ``seed`` -word pieces;
consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket.  There
windows are sorted (by a 64-bit hash, then compared word by word, so that counts are exact) and each learns
the smallest document it starts in.  Every word that a window of a larger document covers is removed.

Before the shuffle, equal strings of a slice of documents are packed once, with the documents they stand in.
A string with more than ``FEW`` of them in a slice sends only the smallest along; its documents wait in
rows of their own, which join the bucket's answer by the string's 128-bit digest, so a passage that a third
of all documents share meets no task as a whole (the join can be split).  A slice's strings travel as one
compressed row per bucket.

The number of buckets follows the bytes of text.  A bucket above ``HOT_WORDS`` words (a minimiser met in very
many contexts) isn't held: its windows leave it one slice's row at a time, as rows of their own with their
words, and meet in an aggregation and a join by these words, which may spill and be split.

Defined cases: null texts have no words; a null id is neither smaller nor larger than others and loses no
words; rows that repeat an id belong to one document, each with its own words; shorter texts than a window
lose none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import cut, session, slices

WIDTH = 13
SEED_WORDS = 3
#: Characters of text whose strings are packed together.
SLICE = 8_000_000
FEW = 16
#: Bytes of text per bucket; a bucket then holds about 2.6 million words of strings.
BUCKET_BYTES = 6_000_000
#: Words of strings that a task holds of one bucket.
HOT_WORDS = 6_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class _Numbers(dict):
    """Word -> a number, given as words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words and the hash of each number."""
    known = _Numbers()
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    return ids, np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def _range_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values, whatever their place."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h), _M), dtype=np.uint64)])
    x = (total[width:] - total[:-width]) * _powers(n, _M_INVERSE)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    got, out = 1, x
    while got < width:
        step = min(got, width - got)
        out = np.minimum(out[:-step], out[step:])
        got += step
    return out


def super_kmers(words: list[bytes], lengths: np.ndarray, width: int = WIDTH, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: each super-k-mer's document, first word, number of words, minimiser."""
    none = np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    if not len(words) or len(words) < width:
        return none, none, none, np.zeros(0, np.uint64)
    ids, hashes = _numbered(words)
    least = _sliding_min(_range_hashes(hashes[ids], seed), width - seed + 1)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(least))
    whole = at + width <= ends[doc[at]]
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (doc[at[1:]] == doc[at[:-1]]) & (least[1:] == least[:-1]))
    starts = np.flatnonzero(first)
    windows = np.add.reduceat(whole, starts) if len(starts) else none
    return doc[starts], starts, windows + width - 1, least[starts]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum([8 * n, *np.frombuffer(raw[: 8 * n], "<i8")])
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _packed_slice(ids: list[int], tags: list[int], texts: list[str], buckets: int, width: int) -> Iterator[tuple[str, int, bytes, bytes, int]]:
    """Rows (kind, bucket, digest, blob, number of words): 'strings' of a bucket, or the 'places' of a frequent string."""
    words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.encode("utf-8", "surrogatepass").split()
        lengths[i] = len(found)
        words += found
    doc, start, n, least = super_kmers(words, lengths, width)
    if not len(doc):
        return
    doc_ids, doc_tags = np.array(ids, np.int64), np.array(tags, np.int64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    word_end = np.cumsum(sizes) - 1
    word_start = word_end - sizes + 1
    lo, hi = word_start[start].tolist(), word_end[start + n - 1].tolist()
    strings = [line[a:b] for a, b in zip(lo, hi, strict=True)]
    del words
    place = start - (np.cumsum(lengths) - lengths)[doc]
    known = _Numbers()
    number = np.fromiter(map(known.__getitem__, strings), dtype=np.int64, count=len(strings))
    distinct = list(known)
    order = np.lexsort((place, doc_ids[doc], number))
    doc, place, number = doc[order], place[order], number[order]
    began = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])  # number k's places begin at began[k]
    count = np.diff(np.r_[began, len(number)])
    n_words, bucket = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    n_words[number] = n[order]
    bucket[number] = (least[order] % np.uint64(buckets)).astype(np.int64)
    smallest = doc_ids[doc[began]]
    many = count > FEW
    for k in np.flatnonzero(many).tolist():
        at = slice(began[k], began[k] + count[k])
        digest = xxhash.xxh3_128_digest(distinct[k])
        yield "places", int.from_bytes(digest[:6], "little") % buckets, digest, _pack(doc_ids[doc[at]], doc_tags[doc[at]], place[at].astype("<i4")), 0
    by = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(by)], strict=True):
        ks = by[a:b]
        kept = np.where(many[ks], 0, count[ks])
        at = np.repeat(began[ks] - np.cumsum(kept) + kept, kept) + np.arange(kept.sum())
        yield "strings", int(bucket[ks[0]]), b"", _pack(b" ".join([distinct[k] for k in ks.tolist()]), n_words[ks].astype("<i4"), kept.astype("<i4"), smallest[ks[kept == 0]], np.diff(doc_ids[doc[at]], prepend=0), doc_tags[doc[at]], place[at].astype("<i4")), int(n_words[ks].sum())


def _windows_to_rows(doc_id: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """One row (doc_id, tag, starts as binary int32) per document."""
    order = np.lexsort((start, tag, doc_id))
    doc_id, tag, start = doc_id[order], tag[order], start[order]
    first = np.flatnonzero(np.r_[True, (doc_id[1:] != doc_id[:-1]) | (tag[1:] != tag[:-1])]) if len(doc_id) else np.zeros(0, np.int64)
    offsets = (4 * np.r_[first, len(doc_id)]).astype("<i4")
    starts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(start.astype("<i4").tobytes())])
    return pa.array(doc_id[first]), pa.array(tag[first]), starts


def _exact_groups(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that brings equal ones together, and where each group of equals begins in it."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    a, b = at[order[:-1]][same], at[order[1:]][same]
    equal = np.ones(len(a), bool)
    for k in range(width):
        equal &= ids[a + k] == ids[b + k]
    if equal.all():
        return order, np.flatnonzero(np.r_[True, ~same])
    order = np.lexsort([ids[at + k] for k in range(width)])  # two texts with one hash: sort by the words
    differ = np.zeros(len(order) - 1, bool)
    for k in range(width):
        x = ids[at[order] + k]
        differ |= x[1:] != x[:-1]
    return order, np.flatnonzero(np.r_[True, differ])


def _strings(blob: bytes) -> tuple[bytes, list[bytes], list[np.ndarray]]:
    """The text of one 'strings' row, its words, and (n_words, kept, alone, doc_id, tag, place)."""
    text, *arrays = _unpack(blob, 7)
    n, kept, alone, doc_id, tag, place = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(arrays, ("<i4", "<i4", "<i8", "<i8", "<i8", "<i4"), strict=True))
    return text, text.split(), [n, kept, alone, np.cumsum(doc_id), tag, place]


def _digests(words: list[bytes], n: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Digests of the strings whose places wait elsewhere."""
    ends = np.cumsum(n)
    return [xxhash.xxh3_128_digest(b" ".join(words[ends[k] - n[k] : ends[k]])) for k in np.flatnonzero(kept == 0).tolist()]


def _split(blob: bytes, width: int) -> Iterator[pa.RecordBatch]:
    """Rows ('window', smallest document, null, words, owners), one per distinct window of a 'strings' row."""
    text, words, (n, kept, alone, doc_id, tag, place) = _strings(blob)
    digests = np.frombuffer(b"".join(_digests(words, n, kept)), "V16")
    word_end = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    word_start = np.r_[0, word_end[:-1] + 1]
    windows = n - width + 1
    first_window = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(n)), windows)
    offset = np.arange(len(owner)) - first_window[owner]
    at = (np.cumsum(n) - n)[owner] + offset
    known = _Numbers()
    number = np.fromiter((known[text[a:b]] for a, b in zip(word_start[at].tolist(), word_end[at + width - 1].tolist(), strict=True)), dtype=np.int64, count=len(at))
    # the places that came along, and the strings whose places wait elsewhere, both by window
    string = np.repeat(np.arange(len(n)), kept)
    of = np.repeat(np.arange(len(string)), windows[string])
    inner = np.arange(len(of)) - np.repeat(np.cumsum(windows[string]) - windows[string], windows[string])
    direct = number[first_window[string[of]] + inner]
    order = np.argsort(direct, kind="stable")
    direct, doc_id, tag, start = direct[order], doc_id[of][order], tag[of][order], (place[of] + inner)[order].astype("<i4")
    late = np.flatnonzero(kept[owner] == 0)
    late = late[np.argsort(number[late], kind="stable")]
    which = (np.cumsum(kept == 0) - 1)[owner[late]]
    smallest = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(smallest, direct, doc_id)
    np.minimum.at(smallest, number[late], alone[which])
    a, b = np.searchsorted(direct, np.arange(len(known) + 1)).tolist(), np.searchsorted(number[late], np.arange(len(known) + 1)).tolist()
    digests, offset = digests[which], offset[late].astype("<i4")
    texts = list(known)
    for lo in range(0, len(texts), 10_000):
        ks = range(lo, min(lo + 10_000, len(texts)))
        owners = [b"".join(x.tobytes() for x in (np.array([a[k + 1] - a[k]], "<i8"), doc_id[a[k] : a[k + 1]], tag[a[k] : a[k + 1]], start[a[k] : a[k + 1]], digests[b[k] : b[k + 1]], offset[b[k] : b[k + 1]])) for k in ks]
        yield pa.RecordBatch.from_arrays([pa.array(["window"] * len(ks)), pa.array(smallest[lo : ks.stop]), pa.nulls(len(ks), pa.int64()), pa.array(texts[lo : ks.stop], pa.binary()), pa.array(owners, pa.binary())], _OUT)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (owners of a window, its smallest document): rows of the kinds of :func:`_bucket`."""
    for batch in batches:
        gone: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        digests: list[bytes] = []
        answers: list[bytes] = []
        for blob, least in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = int.from_bytes(blob[:8], "little")
            doc_id = np.frombuffer(blob, "<i8", n, 8)
            larger = least < doc_id
            if larger.any():
                for x, y in zip(gone, (doc_id, np.frombuffer(blob, "<i8", n, 8 + 8 * n), np.frombuffer(blob, "<i4", n, 8 + 16 * n)), strict=True):
                    x.append(y[larger].astype(np.int64))
            at = 8 + 20 * n
            late = (len(blob) - at) // 20
            for k in range(late):
                digests.append(blob[at + 16 * k : at + 16 * k + 16])
                answers.append(np.array([int.from_bytes(blob[at + 16 * late + 4 * k : at + 16 * late + 4 * k + 4], "little"), least], np.int64).tobytes())
        d, t, s = _windows_to_rows(*map(np.concatenate, gone))
        yield pa.RecordBatch.from_arrays([pa.array(["windows"] * len(d), pa.string()), d, t, pa.nulls(len(d), pa.binary()), s], _OUT)
        yield pa.RecordBatch.from_arrays([pa.array(["answer"] * len(digests), pa.string()), pa.nulls(len(digests), pa.int64()), pa.nulls(len(digests), pa.int64()), pa.array(digests, pa.binary()), pa.array(answers, pa.binary())], _OUT)


def _bucket(blobs: list[bytes], width: int) -> Iterator[pa.RecordBatch]:
    """Rows ('windows', doc_id, tag, null, starts) to remove, and ('answer', null, null, digest, a first window and the smallest documents from it on)."""
    known = _Numbers()
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    digests: list[bytes] = []
    for blob in blobs:  # one slice's words at a time; what stays of them are numbers
        _, words, arrays = _strings(blob)
        columns[0].append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        for k, x in enumerate(arrays, 1):
            columns[k].append(x)
        digests += _digests(words, *arrays[:2])
        del words
    ids, n, kept, alone, doc_id, tag, place = (np.concatenate(c) for c in columns)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
    del known, columns
    smallest = np.zeros(len(n), np.int64)
    smallest[kept == 0] = alone
    smallest[kept > 0] = doc_id[(np.cumsum(kept) - kept)[kept > 0]]  # places come by document
    h = _range_hashes(hashes[ids], width)
    offset = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n - width + 1)
    first_window = np.cumsum(n - width + 1) - (n - width + 1)
    at = offset[owner] + np.arange(len(owner)) - first_window[owner]
    order, begins = _exact_groups(ids, at, h[at], width)
    least = np.zeros(len(owner), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(smallest[owner[order]], begins), np.diff(np.r_[begins, len(order)]))
    # the places that came along
    string = np.repeat(np.arange(len(n)), kept)
    windows = (n - width + 1)[string]
    of = np.repeat(np.arange(len(string)), windows)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = least[first_window[string[of]] + inner] < doc_id[of]
    of, inner = of[gone], inner[gone]
    if len(of):
        d, t, s = _windows_to_rows(doc_id[of], tag[of], place[of] + inner)
        yield pa.RecordBatch.from_arrays([pa.array(["windows"] * len(d)), d, t, pa.nulls(len(d), pa.binary()), s], _OUT)
    # answers for strings whose places wait elsewhere
    if (many := np.flatnonzero(kept == 0)).size:
        answers: dict[bytes, bytes] = {}
        for digest, k in zip(digests, many.tolist(), strict=True):
            if digest not in answers:
                answers[digest] = np.r_[0, least[first_window[k] : first_window[k] + int(n[k]) - width + 1]].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(["answer"] * len(answers)), pa.nulls(len(answers), pa.int64()), pa.nulls(len(answers), pa.int64()), pa.array(list(answers), pa.binary()), pa.array(list(answers.values()), pa.binary())], _OUT)


_OUT = ["kind", "doc_id", "tag", "digest", "blob"]


def _tag(text: Column, repeats: bool) -> Column:
    """Tells rows of one id with different texts apart, where ids repeat at all: the text's hash of 64 bits."""
    return F.xxhash64(text.cast("string")) if repeats else F.lit(0).cast("long")


def ids_repeat(docs: DataFrame) -> bool:
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def bucket_count(text_bytes: int, partitions: int) -> int:
    return max(64, 2 * partitions, -(-text_bytes // BUCKET_BYTES))


def repeated_windows(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, hot: int | None = None, repeats: bool = True) -> DataFrame:
    """(doc_id, tag, starts): binary int32 arrays of the windows to remove, several rows per document.

    ``repeats`` False: no id is in two rows.
    """
    spark = session(docs)
    hot = HOT_WORDS if hot is None else hot
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), _tag(F.col("text"), repeats).alias("tag"), F.col("text").cast("string"))
    if buckets is None:
        buckets = bucket_count(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, texts, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(_packed_slice(ids, tags, texts, buckets, width))
            for a in range(0, len(rows), 100):
                kind, bucket, digest, blob, words = zip(*rows[a : a + 100], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket, pa.int64()), pa.array(digest, pa.binary()), pa.array(blob, pa.binary()), pa.array(words, pa.int64())], ["kind", "bucket", "digest", "blob", "words"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for i, g, t in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    ids.append(i)
                    tags.append(g)
                    texts.append(t)
                    size += len(t)
                    if size >= SLICE:
                        yield from out()
                        ids, tags, texts, size = [], [], [], 0
        if ids:
            yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs, size = None, [], 0
        for part in slices(batches, 16):  # rows hold whole compressed slices
            for kind, bucket, digest, blob, words in zip(*part, strict=True):
                if kind == "places":
                    yield pa.RecordBatch.from_arrays([pa.array(["places"]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([digest], pa.binary()), pa.array([blob], pa.binary())], _OUT)
                    continue
                if bucket != held:
                    if blobs:
                        yield from _bucket(blobs, width)
                    held, blobs, size = bucket, [], 0
                blobs.append(blob)
                size += words
                if size > hot:  # this bucket's rows go one at a time from here on
                    for x in blobs:
                        yield from _split(x, width)
                    blobs = []
        if blobs:
            yield from _bucket(blobs, width)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_id, tag, place = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(_unpack(blob, 3), ("<i8", "<i8", "<i4"), strict=True))
                from_, least = int(np.frombuffer(answer, np.int64, 1)[0]), np.frombuffer(answer, np.int64, offset=8)
                of, inner = np.nonzero(least[None, :] < doc_id[:, None])
                if len(of):
                    yield pa.RecordBatch.from_arrays(list(_windows_to_rows(doc_id[of], tag[of], place[of] + from_ + inner)), ["doc_id", "tag", "starts"])

    packed = rows.mapInArrow(pack, "kind string, bucket long, digest binary, blob binary, words long")
    counted = packed.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(count, "kind string, doc_id long, tag long, digest binary, blob binary")
    found = cut(counted)
    waiting = found.where("kind = 'places'").select("digest", "blob")
    answers = found.where("kind = 'answer'").select("digest", F.col("blob").alias("answer"))
    done = found.where("kind = 'windows'")
    hot_windows = found.where("kind = 'window'").select(F.col("doc_id").alias("smallest"), F.col("digest").alias("window"), "blob")
    if not hot_windows.isEmpty():
        least = hot_windows.groupBy("window").agg(F.min("smallest").alias("least"))
        settled = cut(hot_windows.join(least, "window").select("blob", "least").mapInArrow(_settled, "kind string, doc_id long, tag long, digest binary, blob binary"))
        done = done.union(settled.where("kind = 'windows'"))
        answers = answers.union(settled.where("kind = 'answer'").select("digest", F.col("blob").alias("answer")).distinct())
    late = waiting.join(answers, "digest").select("blob", "answer").mapInArrow(places, "doc_id long, tag long, starts binary")
    return done.select("doc_id", "tag", F.col("blob").alias("starts")).union(late)


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``n_removed`` and ``kept_text`` (the words left, joined by a space)."""
    types = dict(docs.dtypes)
    columns = list(dict.fromkeys(["doc_id", *keep]))
    repeats = ids_repeat(docs)
    marks = repeated_windows(docs, width, repeats=repeats).groupBy(F.col("doc_id").alias("its_id"), F.col("tag").alias("its_tag")).agg(F.collect_list("starts").alias("its_starts"))
    tagged = docs.select(*columns, F.col("text").cast("string").alias("its_text"), _tag(F.col("text"), repeats).alias("row_tag"))
    joined = tagged.join(marks, (F.col("doc_id") == F.col("its_id")) & (F.col("row_tag") == F.col("its_tag")), "left").select(*keep, "its_text", "its_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n_words, n_removed, kept = [], [], []
                for text, starts in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n_words.append(len(words))
                    if starts:
                        at = np.frombuffer(b"".join(starts), "<i4")
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + width, -1)
                        stay = np.cumsum(edge)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*keep, "n_words", "n_removed", "kept_text"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_words long, n_removed long, kept_text string"])
    return joined.mapInArrow(run, schema)
