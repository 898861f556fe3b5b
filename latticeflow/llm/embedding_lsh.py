"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Vectors of one label that are equal bit by bit form a class, known by a 128-bit digest.  A class is hashed
``k`` times in each of several tables: three rounds of sign flips and fast Hadamard transforms, then the axis
nearest to the rotated vector.  It stands in its table's bucket and, as a probe, in the buckets where one of
its axes is the second nearest.  Pairs that meet are verified by cosine in double precision.

Vectors travel late.  First only bucket keys and digests meet, each key once per batch of vectors, and tell
which entries share a bucket with another class; most entries of unrelated vectors end there.  Only classes
with company are gathered with their vectors, and only to the buckets where they have it.

A pair counts in one bucket only: in the first table where it meets, and of two buckets there in that of the
class with the smaller number.  A bucket emits one number of links per class and a spanning forest of its
links, never its pairs.  Buckets above ``LARGE`` rows are cut into blocks, and pairs of blocks are compared in
different tasks.

The hashes to a table follow the number of vectors, so that an entry shares its bucket with ``COMPANY``
unrelated ones on average at most.  Recall at the threshold 0.98 in 64 dimensions: a hash agrees with a rate
of 0.73, within one probe of 0.94; the number of tables follows from this so that a pair at the threshold is
missed with a rate of ``MISS``.

Defined cases: null, empty or zero vectors, vectors with null, infinite or NaN components and null labels
have no links, even to equal ones; vectors of different length don't link; a vector id on several rows
makes several vectors, each with its own links; a vector with a null id links like any other, counts as a
link and is never kept, and a component is named by the smallest id in it that isn't null (null if there is
none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.llm.common import cut
from latticeflow.operators.components import components, roots

THRESHOLD = 0.98
MISS = 1e-3
COMPANY = 0.1
LARGE = 4096
#: Rates at which one hash of two vectors at the threshold agrees: nearest axes, and one's nearest with the other's second.
AGREE, PROBED = 0.73, 0.21
#: What an entry tells when keys meet: it is alone in its batch, it stands for several, it is known to have company.
ALONE, SEVERAL, SURE = 0, 1, 2


def hashes_for(n: int, dimension: int = 64) -> int:
    """Hashes to a table, so that an entry meets ``COMPANY`` unrelated entries at most."""
    size = 1 << max(1, (dimension - 1).bit_length())
    k = 1
    while n * (1 + k) > COMPANY * (2 * size) ** k:
        k += 1
    return k


def tables_for(k: int, miss: float = MISS) -> int:
    met = AGREE**k + k * AGREE ** (k - 1) * PROBED
    return math.ceil(math.log(miss) / math.log(1 - met))


def _transform(x: np.ndarray) -> np.ndarray:
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def axes(x: np.ndarray, k: int, tables: int, seed: int = 11) -> np.ndarray:
    """(rows, tables, k, 2): the nearest and the second nearest signed axis of each rotation of unit vectors."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    signs = np.random.default_rng([seed, size]).choice([-1.0, 1.0], size=(tables, k, 3, size))
    near = np.zeros((n, tables, k, 2), np.uint32)
    for t in range(tables):
        for j in range(k):
            y = padded
            for r in range(3):
                y = _transform(y * signs[t, j, r])
            a = np.abs(y)
            first = a.argmax(1)
            a[np.arange(n), first] = -1
            both = np.stack([first, a.argmax(1)], 1)
            near[:, t, j] = 2 * both + (np.take_along_axis(y, both, 1) > 0)
    return near


def bucket_keys(near: np.ndarray, dimension: int) -> np.ndarray:
    """(rows, tables, 1 + k) bucket keys: the bucket, then the probes."""
    n, tables, k, _ = near.shape
    out = np.zeros((n, tables, 1 + k), np.uint64)
    for t in range(tables):
        for p in range(1 + k):
            key = np.full(n, xxhash.xxh64_intdigest(f"{t}/{dimension}"), np.uint64)
            for j in range(k):
                key = (key ^ near[:, t, j, int(p == j + 1)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t, p] = key
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _able(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length, of a batch (vec_id, embedding, label): rows that can link, their vectors, digests (two longs), label hashes."""
    vectors, labels = batch.column(1), batch.column(2).to_pylist()
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    flat = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    labelled = np.array([x is not None for x in labels], bool)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero((sizes == size) & labelled)
        x = flat[begin[at][:, None] + np.arange(size)] + flat.dtype.type(0)
        fine = np.isfinite(x).all(1) & x.any(1)
        at, x = at[fine], x[fine]
        if len(at):
            marks = [str(labels[i]).encode("utf-8", "surrogatepass") for i in at.tolist()]
            digests = b"".join(xxhash.xxh3_128_digest(x[i].tobytes() + m) for i, m in enumerate(marks))
            yield at, x, np.frombuffer(digests, "<i8").reshape(-1, 2), np.array([xxhash.xxh64_intdigest(m) for m in marks], np.uint64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, d1, d2) of every row; d2 is null for vectors that can't link, whose d1 only spreads them."""
    for batch in batches:
        found, has = np.zeros((batch.num_rows, 2), np.int64), np.zeros(batch.num_rows, bool)
        found[:, 0] = np.arange(batch.num_rows)
        for at, _, digest, _ in _able(batch):
            found[at], has[at] = digest, True
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1], mask=~has)], ["vec_id", "d1", "d2"])


def _distinct(digest: np.ndarray) -> np.ndarray:
    """Places of the first of each digest."""
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    new = np.r_[True, (digest[order][1:] != digest[order][:-1]).any(1)]
    return order[new]


def _entries(k: int, tables: int):
    """(deal, key, d1, head) of a batch's entries, at most one ``ALONE`` or ``SEVERAL`` per key, and ``SURE`` ones dealt anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x, digest, label in _able(batch):
                once = _distinct(digest)
                for lo in range(0, len(once), 2000):
                    some = once[lo : lo + 2000]
                    key = (bucket_keys(axes(_unit(x[some]), k, tables), x.shape[1]) ^ label[some][:, None, None]).reshape(-1)
                    pos = np.tile(np.arange(tables * (1 + k)), len(some))
                    d1 = np.repeat(digest[some, 0], tables * (1 + k))
                    order = np.argsort(key, kind="stable")
                    key, pos, d1 = key[order], pos[order], d1[order]
                    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    count = np.diff(np.r_[begins, len(key)])
                    many = np.repeat(count > 1, count)
                    kind = np.where(count > 1, SEVERAL, ALONE)
                    scattered = (key[many] ^ d1[many].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    out = [
                        np.r_[key[begins], scattered].view(np.int64), np.r_[key[begins], key[many]].view(np.int64),
                        np.r_[d1[begins], d1[many]], np.r_[pos[begins] * 3 + kind, pos[many] * 3 + SURE].astype(np.int32),
                    ]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), ["deal", "key", "d1", "head"])

    return run


def _with_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, d1, pos) of the entries whose bucket has another class; rows come sorted by ``deal``, one waits for the next batch."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    for batch in batches:
        key, d1, head = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        sure = head % 3 == SURE
        out = [[key[sure]], [d1[sure]], [head[sure] // 3]]
        key, d1, head = (np.concatenate([h, c[~sure]]) for h, c in zip(held, (key, d1, head), strict=True))
        if len(key):
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[begins, len(key)])
            met = (np.minimum.reduceat(d1, begins) != np.maximum.reduceat(d1, begins)) | np.logical_or.reduceat(head % 3 == SEVERAL, begins)
            shown = np.repeat(met, count) & (head % 3 == ALONE)
            for x, y in zip(out, (key, d1, head // 3), strict=True):
                x.append(y[shown])
            last = begins[-1]  # the last bucket may go on: if it has company, this is all that must be known of it
            held = [key[last : last + 1], d1[last : last + 1], np.array([head[last] // 3 * 3 + (SEVERAL if met[-1] else ALONE)], np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["key", "d1", "pos"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, label, vector) of each class of a batch."""
    for batch in batches:
        for _, x, digest, label in _able(batch):
            once = _distinct(digest)
            yield pa.RecordBatch.from_arrays([pa.array(digest[once, 0]), pa.array(digest[once, 1]), pa.array(label[once].view(np.int64)), pa.array([x[i].tobytes() for i in once.tolist()], pa.binary())], ["d1", "d2", "label", "vector"])


def _marked(k: int, tables: int, dtype: str):
    """Adds the axes of each class (unsigned 8, 16 or 32-bit) to (d1, d2, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3).to_pylist()
            near: list[bytes] = [b""] * len(raw)
            for size in {len(v) for v in raw}:
                at = [i for i, v in enumerate(raw) if len(v) == size]
                x = np.stack([np.frombuffer(raw[i], dtype) for i in at])
                small = _axis_type(x.shape[1])
                for i, found in zip(at, axes(_unit(x), k, tables), strict=True):
                    near[i] = found.astype(small).tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(near, pa.binary())], ["d1", "d2", "label", "vector", "near"])

    return run


def _axis_type(dimension: int) -> str:
    size = 2 << max(1, (dimension - 1).bit_length())
    return "u1" if size <= 256 else "<u2" if size <= 65536 else "<u4"


def _compare(k: int, tables: int, threshold: float, dtype: str):
    """Compares the classes of each bucket; rows come sorted by group (group, pos, across, block, class_id, weight, label, vector, near)."""

    def bucket(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        pos = rows.column("pos").to_numpy(zero_copy_only=False)
        main = pos % (1 + k) == 0
        if rows.num_rows < 2 or not main.any():
            return none, none, none
        raw = rows.column("vector").to_pylist()
        size, table = len(raw[0]), int(pos[0]) // (1 + k)
        alike = np.array([len(v) == size for v in raw]) & (pos // (1 + k) == table)
        if not alike.all():  # keys of different lengths or tables meet by chance
            parts = [bucket(rows.filter(pa.array(x))) for x in (alike, ~alike)]
            return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        n = rows.num_rows
        across = rows.column("across")[0].as_py()
        ids, weight, block, label = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("class_id", "weight", "block", "label"))
        x = _unit(np.frombuffer(b"".join(raw), dtype).reshape(n, -1))
        near = np.frombuffer(b"".join(rows.column("near").to_pylist()), _axis_type(x.shape[1])).reshape(n, tables, k, 2)[:, : table + 1]
        count, a, b = np.zeros(n, np.int64), [], []
        step = max(1, 4_000_000 // n)
        for at in range(0, n, step):
            i, j = np.nonzero(x[at : at + step] @ x.T >= threshold)
            i += at
            ok = (i < j) & (main[i] | main[j]) & (label[i] == label[j]) & (ids[i] != ids[j])
            if across:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            for lo in range(0, len(i), 100_000):
                p, q = i[lo : lo + 100_000], j[lo : lo + 100_000]
                u, v = near[p], near[q]
                other = u[..., 0] != v[..., 0]
                far = other.sum(2)
                uv = (far == 0) | ((far == 1) & (other & (v[..., 1] == u[..., 0])).any(2))  # the first's bucket is the second's or a probe of it
                vu = (far == 0) | ((far == 1) & (other & (u[..., 1] == v[..., 0])).any(2))
                first = ~(uv | vu)[:, :table].any(1)
                here = np.where(main[p] & main[q], far[:, table] == 0, np.where(main[p], uv[:, table] & (~vu[:, table] | (ids[p] < ids[q])), vu[:, table] & (~uv[:, table] | (ids[q] < ids[p]))))
                p, q = p[first & here], q[first & here]
                count += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
                if len(p):
                    r, s = roots(ids[p], ids[q])
                    a.append(r)
                    b.append(s)
        linked = np.flatnonzero(count)
        a, b = (np.concatenate(y) if y else none for y in (a, b))
        if len(a):
            a, b = roots(a, b)
        return np.concatenate([ids[linked], a]), np.concatenate([ids[linked], b]), np.concatenate([count[linked], np.zeros(len(a), np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = table.combine_chunks().to_batches()[0]
            group = rows.column("group").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            found = [bucket(rows.slice(s, e - s)) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True) if e - s > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            group = held.column("group").to_numpy()
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from done(held)

    return run


def links(classes: DataFrame, company: DataFrame, k: int, tables: int, dtype: str, threshold: float = THRESHOLD, large: int = LARGE) -> DataFrame:
    """(a, b, n): ``n`` > 0 links of the class a = b, or an edge a-b with n = 0 of a spanning forest.

    ``classes``: (class_id, d1, weight, label, vector, near); ``company``: the entries (key, d1, pos) to compare.
    """
    heavy = cut(company.groupBy("key").count().where(F.col("count") > large).select("key", F.ceil(F.col("count") / large).cast("int").alias("blocks")))
    rows = company.join(classes, "d1").select("key", "pos", "class_id", "weight", "label", "vector", "near")
    compare = lambda df: (
        df.select("group", "pos", "across", "block", "class_id", "weight", "label", "vector", "near").repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(_compare(k, tables, threshold, dtype), "a long, b long, n long")
    )
    plain = rows
    if heavy.take(1):
        plain = rows.join(heavy.select("key"), "key", "left_anti")
    found = compare(plain.withColumn("group", F.col("key")).withColumn("across", F.lit(False)).withColumn("block", F.lit(0)))
    if heavy.take(1):
        cut_up = rows.join(heavy, "key").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
        other = cut_up.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        x, y = F.least("block", "other"), F.greatest("block", "other")
        found = found.union(compare(other.withColumn("group", F.xxhash64("key", x, y)).withColumn("across", x != y)))
    return found


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, large: int = LARGE, k: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    single = dict(rows.dtypes)["embedding"] == "array<float>"
    kind, dtype = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    if k is None:
        n, dimension = slim.agg(F.count(F.lit(1)), F.min(F.nullif(F.size("embedding"), F.lit(0)))).first()
        k = hashes_for(n, max(dimension or 1, 1))
    tables = tables_for(k)
    entries = slim.mapInArrow(_entries(k, tables), "deal long, key long, d1 long, head int")
    met = entries.repartition(F.col("deal")).sortWithinPartitions("deal").mapInArrow(_with_company, "key long, d1 long, pos int")
    company = cut(met)
    wanted = company.select("d1").distinct()
    vectors = slim.mapInArrow(_vectors, "d1 long, d2 long, label long, vector binary").repartition(F.col("d1"))
    once = vectors.join(wanted, "d1", "left_semi").dropDuplicates(["d1", "d2"]).select("d1", "d2", "label", "vector")
    marked = once.mapInArrow(_marked(k, tables, dtype), "d1 long, d2 long, label long, vector binary, near binary")
    members = cut(slim.mapInArrow(_digests, "vec_id long, d1 long, d2 long"))
    sizes = members.where("d2 is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    # numbers are given in the stage that is written, so a lost executor can't give one twice
    classes = cut(marked.join(sizes, ["d1", "d2"]).withColumn("class_id", F.monotonically_increasing_id()))
    found = cut(links(classes, company.dropDuplicates(["d1", "pos"]), k, tables, dtype, threshold, large))
    counted = found.where("n > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    rooted = components(found.where("n = 0").select("a", "b"), small=0)
    linked = cut(
        classes.select("class_id", "d1", "d2", "first_id").join(counted, "class_id").join(rooted.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("d1", "d2", "first_id", "others", F.coalesce("component", "class_id").alias("root"))
    )
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    told = linked.join(least, "root").select("d1", "d2", "others", "least_id")
    whole = sizes.join(told, ["d1", "d2"], "left").select("d1", "d2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).cast("long").alias("links"), F.coalesce("least_id", "first_id").alias("least_id"))
    joined = members.join(whole, ["d1", "d2"], "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
