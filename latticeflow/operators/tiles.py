"""The tile summary (S2, J3, J4, A1-A4, W2, W3, W5, P8, P10): one Arrow batch of tiles in, one row per tile out.

A tile's vertices are the primes of its square widened by the collar.  A row keeps what its neighbours and
the verdict can see: the components that touch a band or a face strip, numbered by first appearance in (a, b)
order, and per face the strip's own components as ports, ordered by their least (h, perp).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions.primes import gaussian_mask
from latticeflow.lineage import dealt
from latticeflow.sources.lattice import expanded
from latticeflow.params import EMPTY_BIT, FACES, INNER, MAX_FACE_PORTS, MAX_GROUPS, MAX_PORTS, OUTER, OVERFLOW_BIT, Annulus, ceil_isqrt, palette

SCHEMA = "i long, j long, n array<int>, face_groups array<int>, port_h array<int>, port_perp array<int>, inner array<int>, outer array<int>, tile_flags int, primes int, groups int"
ARROW = pa.schema([("i", pa.int64()), ("j", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("n", "face_groups", "port_h", "port_perp", "inner", "outer")), ("tile_flags", pa.int32()), ("primes", pa.int32()), ("groups", pa.int32())])


def halo_primes(a_lo: int, b_lo: int, q: Annulus) -> tuple[np.ndarray, np.ndarray]:
    """The primes of a tile's widened square within the octant annulus, sorted by (a, b)."""
    c, s = q.collar, q.side
    cols = [(a, max(b_lo - c, a, ceil_isqrt(q.inner_sq - a * a)), min(b_lo + s + c, isqrt(q.outer_sq - a * a))) for a in range(max(0, a_lo - c), min(a_lo + s + c, q.r_outer) + 1)]
    cols = [x for x in cols if x[1] <= x[2]]
    if not cols:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = expanded(*np.array(cols, np.int64).T)
    keep = gaussian_mask(a, b)
    return a[keep], b[keep]


def joined(a: np.ndarray, b: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Component of each point as the smallest index in it; points sorted by (a, b).

    A point has one neighbour ahead and one behind per offset at most, so an offset's pairs can be lowered to
    their smaller label at once, first ends and then second ends; sweeps over the offsets alternate with pointer jumps until nothing changes.
    """
    n = len(a)
    label = np.arange(n)
    if n < 2:
        return label
    pad = max(abs(y) for _, y in offsets)
    row = int(b.max() - b.min()) + 1 + 2 * pad
    key = (a - a.min()) * row + (b - b.min()) + pad
    place = np.full(int(key[-1]) + 1 + (pad + 1) * (row + 1), -1, np.int64)
    place[key] = label
    pairs = []
    for da, db in offsets:
        y = place[key + da * row + db]
        x = np.flatnonzero(y >= 0)
        if len(x):
            pairs.append((x, y[x]))
    while True:
        before = label.copy()
        for x, y in pairs:
            low = np.minimum(label[x], label[y])
            label[x] = np.minimum(label[x], low)
            label[y] = np.minimum(label[y], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def summarise(i: int, j: int, q: Annulus, caps: bool) -> dict:
    """One tile's row; ``caps``: capacities of the packed record, beyond which a tile counts as spanning."""
    return _summarised(i, j, q, caps)[0]


def _summarised(i: int, j: int, q: Annulus, caps: bool) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tile's row, its primes' coordinates, their bands' bits and their labels (0: not visible)."""
    a, b = halo_primes(i * q.side, j * q.side, q)
    if not len(a):
        return {"i": i, "j": j, "n": [0] * 4, **{c: [] for c in _LISTS}, "tile_flags": EMPTY_BIT, "primes": 0, "groups": 0}, a, b, a, a
    rows, reach, label = _summarised_tiles(np.array([i]), np.array([j]), np.zeros(len(a), np.int64), a, b, q, caps)
    return rows.to_pylist()[0], a, b, reach, label


_LISTS = ("face_groups", "port_h", "port_perp", "inner", "outer")


def _lists(tile: np.ndarray, values: np.ndarray, tiles: int) -> pa.Array:
    """Each tile's values as an array, for rows sorted by tile."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(tile, np.arange(tiles + 1)), pa.int32()), pa.array(values, pa.int32()))


def _summarised_tiles(i: np.ndarray, j: np.ndarray, tile: np.ndarray, a: np.ndarray, b: np.ndarray, q: Annulus, caps: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows of tiles (i, j) that hold primes, and each prime's bits of bands and label (0: not visible).

    The primes are sorted by (tile, a, b), ``tile`` being their tile's place among the given ones.  All tiles are worked
    on at once: they lie on a strip, one behind the other, too far apart for a step to join two of them.
    """
    s, c, tiles = q.side, q.collar, len(i)
    offsets = palette(q.k, True, odd_sums=q.r_inner > 1)
    x, y = a - i[tile] * s, b - j[tile] * s
    strip = tile * (s + 3 * c + 1) + x
    comp = joined(strip, y, offsets)
    norm = a * a + b * b
    inner = norm <= q.inner_sq + q.k + isqrt(4 * q.inner_sq * q.k)
    outer = norm >= q.outer_sq + q.k - isqrt(4 * q.outer_sq * q.k)
    perps = {"I": y, "O": y - s, "L": x, "R": x - s}
    along = {"I": x, "O": x, "L": y, "R": y}
    strips = {f: np.abs(perps[f]) <= c for f in FACES}
    visible = np.unique(comp[inner | outer | strips["I"] | strips["O"] | strips["L"] | strips["R"]])
    groups = np.bincount(tile[visible], minlength=tiles)
    label = np.zeros(len(a), np.int64)
    label[visible] = np.arange(1, len(visible) + 1) - (np.cumsum(groups) - groups)[tile[visible]]  # smallest index first: first appearance
    label = label[comp]
    n, found = np.zeros((tiles, len(FACES)), np.int64), []
    for f, face in enumerate(FACES):
        at = np.flatnonzero(strips[face])
        sub = joined(strip[at], y[at], offsets)
        h, perp = along[face][at], perps[face][at]
        order = np.lexsort((perp, h, sub))
        first = order[np.flatnonzero(np.r_[True, sub[order][1:] != sub[order][:-1]])] if len(at) else order
        n[:, f] = np.bincount(tile[at[first]], minlength=tiles)
        found.append(np.stack([tile[at[first]], np.full(len(first), f), h[first], perp[first], label[at[first]]]))
    port = np.concatenate(found, axis=1)
    port = port[:, np.lexsort((port[4], port[3], port[2], port[1], port[0]))]
    over = (groups > MAX_GROUPS) | (n > MAX_FACE_PORTS).any(axis=1) | (n.sum(axis=1) > MAX_PORTS) if caps else np.zeros(tiles, bool)
    port = port[:, ~over[port[0]]]

    def flagged(band: np.ndarray) -> pa.Array:
        marked = np.unique(comp[band & ~over[tile]])
        return _lists(tile[marked], label[marked], tiles)

    n[over] = 0
    kept = [_lists(port[0], port[at], tiles) for at in (4, 2, 3)]
    whole = pa.ListArray.from_arrays(pa.array(np.arange(tiles + 1) * len(FACES), pa.int32()), pa.array(n.reshape(-1), pa.int32()))
    numbers = [pa.array(v, pa.int32()) for v in (np.where(over, OVERFLOW_BIT, 0), np.bincount(tile, minlength=tiles), np.where(over, 0, groups))]
    rows = pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), whole, *kept, flagged(inner), flagged(outer), *numbers], schema=ARROW)
    return rows, INNER * inner + OUTER * outer, label


def halos(points: DataFrame, q: Annulus) -> DataFrame:
    """S2 for given primes: (i, j, a, b), each prime with every tile whose widened square holds it, four at most if the side exceeds twice the collar."""
    div = lambda x: F.call_function("div", x.cast("long"), F.lit(q.side).cast("long"))
    of = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), div(F.col(c) - q.collar + q.side - 1) - 1), div(F.col(c) + q.collar))
    return points.select("a", "b", F.explode(of("a")).alias("i")).select("i", F.explode(of("b")).alias("j"), "a", "b")


#: Cells of widened squares, about, that are worked on at once.
CELLS = 2_000_000


def _whole_tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, tile, a, b) of at most ``most`` tiles at a time, each whole, from rows (i, j, a, b) sorted by all four;
    ``tile`` is a row's place among the tiles (i, j)."""
    held = np.zeros((4, 0), np.int64)
    for batch in chain(batches, [None]):
        if batch is not None:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        begin = np.flatnonzero(np.r_[True, (held[:2, 1:] != held[:2, :-1]).any(axis=0)]) if held.shape[1] else np.zeros(0, np.int64)
        whole = len(begin) - (batch is not None)  # the last tile may go on
        ends = np.r_[begin, held.shape[1]]
        at = 0
        while whole - at >= most or (batch is None and at < whole):
            upto = min(at + most, whole)
            part = held[:, ends[at] : ends[upto]]
            yield held[0, begin[at:upto]], held[1, begin[at:upto]], np.repeat(np.arange(upto - at), np.diff(ends[at : upto + 1])), part[2], part[3]
            at = upto
        held = held[:, ends[at] :]


def _each_halo(points: DataFrame, q: Annulus, fn: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What ``fn`` makes of several tiles and their sorted primes; a tile's are bounded by its widened square."""
    most = max(1, CELLS // ((q.side + 3 * q.collar + 1) * (q.side + 4 * q.collar + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _whole_tiles(batches, most):
            yield fn(*found)

    return dealt(halos(points, q), "i", "j").sortWithinPartitions("i", "j", "a", "b").mapInArrow(run, schema)


def summaries_of(points: DataFrame, q: Annulus, caps: bool = False) -> DataFrame:
    """The summaries of the tiles that given primes (a, b), each once, lie in or near; other tiles have no row."""
    return _each_halo(points, q, lambda *found: _summarised_tiles(*found, q, caps)[0], SCHEMA)


def layers_of(points: DataFrame, q: Annulus, caps: bool = False) -> DataFrame:
    """As :func:`layers`, for given primes."""

    def told(i: np.ndarray, j: np.ndarray, tile: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        rows, reach, label = _summarised_tiles(i, j, tile, a, b, q, caps)
        ends = np.searchsorted(tile, np.arange(len(i) + 1))
        return pa.RecordBatch.from_pylist([x for n, row in enumerate(rows.to_pylist()) for x in _layers(row["i"], row["j"], row, *(c[ends[n] : ends[n + 1]] for c in (a, b, reach, label)))])

    return _each_halo(points, q, told, LAYER_SCHEMA)


#: What a tile's answer is made of, from the first step to the last.
LAYERS = ("primes", "bands", "labels", "record")


LAYER_SCHEMA = "i long, j long, layer string, digest string"


def _layers(i: int, j: int, row: dict, a: np.ndarray, b: np.ndarray, reach: np.ndarray, label: np.ndarray) -> list[dict]:
    joined_text = lambda xs, by: by.join(map(str, xs))
    record = "|".join([*(joined_text(row[c], ".") for c in ("n", "face_groups", "inner", "outer")), str(row["tile_flags"])])
    texts = (" ".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist(), strict=True)), joined_text(reach.tolist(), ""), joined_text(label.tolist(), " "), record)
    return [{"i": i, "j": j, "layer": name, "digest": hashlib.sha256(t.encode()).hexdigest()} for name, t in zip(LAYERS, texts, strict=True)]


def layers(tiles: DataFrame, q: Annulus, caps: bool = False) -> DataFrame:
    """(i, j, layer, digest): sha256 of each layer of each tile as a text, in the order of ``LAYERS``.

    Texts are ``a:b`` of each prime, the digit of its bands, its label (0: not visible), and the record's parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(_layers(i, j, *_summarised(i, j, q, caps)))

    return tiles.select("i", "j").mapInArrow(run, LAYER_SCHEMA)


def layer_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, layer, left_digest, right_digest) where two runs' layers differ, or only one has the tile."""
    x = left.withColumnRenamed("digest", "left_digest")
    y = right.withColumnRenamed("digest", "right_digest")
    return x.join(y, ["i", "j", "layer"], "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def first_differing_layers(differences: DataFrame) -> DataFrame:
    """(i, j, layer): of each tile that differs the first layer that does, where the cause is to be sought."""
    place = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    return differences.groupBy("i", "j").agg(F.min_by("layer", place).alias("layer"))


def summaries(tiles: DataFrame, q: Annulus, caps: bool = False, parts: int | None = None) -> DataFrame:
    """One row per tile (see ``SCHEMA``); tiles are spread over ``parts`` tasks if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [summarise(i, j, q, caps) for i, j in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    slim = tiles.select("i", "j")
    return (slim.repartition(parts, "i", "j") if parts else slim).mapInArrow(run, SCHEMA)


def ports(rows: DataFrame) -> DataFrame:
    """(i, j, face, ordinal, label, h, perp): the relational form of the summaries; ordinals begin at 1."""
    spread = rows.select("i", "j", "n", F.posexplode(F.arrays_zip("face_groups", "port_h", "port_perp")).alias("pos", "p"))
    ends = [sum([F.col("n")[k] for k in range(f)], F.lit(0)) for f in range(5)]
    face = F.lit(3)
    for f in (2, 1, 0):
        face = F.when(F.col("pos") < ends[f + 1], f).otherwise(face)
    begin = F.element_at(F.array(*ends[:4]), face + 1)
    name = F.element_at(F.array(*[F.lit(x) for x in FACES]), face + 1)
    return spread.select("i", "j", name.alias("face"), (F.col("pos") - begin + 1).alias("ordinal"), F.col("p.face_groups").alias("label"), F.col("p.port_h").alias("h"), F.col("p.port_perp").alias("perp"))


def groups(rows: DataFrame) -> DataFrame:
    """(i, j, label, reach) of every visible component."""
    numbers = F.when(F.col("groups") > 0, F.sequence(F.lit(1), F.col("groups"))).otherwise(F.array().cast("array<int>"))
    bit = lambda c, v: F.when(F.array_contains(c, F.col("label")), v).otherwise(0)
    return rows.select("i", "j", "inner", "outer", F.explode(numbers).alias("label")).select("i", "j", "label", bit("inner", 1).bitwiseOR(bit("outer", 2)).alias("reach"))


def pressure(row_n: Column, face_groups: Column, flags: Column, inner: Column, outer: Column) -> Column:
    """F16: ports, used label bytes and used flag bytes, and a million for an overflow."""
    used = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: F.floor((x - 1) / 8))))
    ports_ = F.aggregate(row_n, F.lit(0), lambda a, x: a + x)
    return (ports_ + F.size(F.filter(face_groups, lambda x: x > 0)) + used(inner) + used(outer) + F.when(flags.bitwiseAND(F.lit(OVERFLOW_BIT)) != 0, 1_000_000).otherwise(0)).cast("long")


def group_count(face_groups: Column, inner: Column, outer: Column) -> Column:
    """Distinct labels of ports and flags."""
    return F.size(F.filter(F.array_union(F.array_union(face_groups, inner), outer), lambda x: x > 0))


def signature(face_groups: Column, inner: Column, outer: Column) -> Column:
    """what each label carries, sorted, so that renumbered labels compare equal."""
    numbers = F.array_distinct(F.concat(face_groups, inner, outer))
    at = F.transform(face_groups, lambda x, k: F.struct(x.alias("x"), k.alias("k")))

    def told(label: Column) -> Column:
        places = F.array_join(F.transform(F.filter(at, lambda p: p["x"] == label), lambda p: F.concat(F.lit("p"), p["k"].cast("string"), F.lit(";"))), "")
        return F.concat(places, F.when(F.array_contains(inner, label), "I;").otherwise(""), F.when(F.array_contains(outer, label), "O;").otherwise(""))

    return F.array_sort(F.transform(F.filter(numbers, lambda x: x > 0), told))
