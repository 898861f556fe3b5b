"""Top-k, bottom-k by hash and stratified sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.lineage import cut

#: Fixed values of the hashes: the 64-bit golden ratio, the start of a text's hash, and the prime 2**40 + 435 as shifts.
GOLDEN = 0x9E3779B97F4A7C15 - 2**64
TEXT_BASIS = 1_469_598_103_934_665_603
PRIME_SHIFTS = (40, 8, 7, 5, 4, 1, 0)
#: Classes in the order in which they take their samples.
CLASSES = ("geo_I", "geo_O", "axis", "diagonal", "high_pressure", "deterministic_random")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows by a total order; every task keeps ``k`` rows before they meet."""
    return df.orderBy(*order).limit(k)


def high_pressure(tiles: DataFrame, k: int = 32) -> DataFrame:
    """Tiles (i, j, score, ports, groups, max_face) of highest pressure; a score of 0 doesn't count."""
    d = F.desc
    return top(tiles.where("score > 0"), [d("score"), d("ports"), d("groups"), d("max_face"), F.asc("i"), F.asc("j")], k)


def mixed(*parts: Column | int) -> Column:
    """the golden-ratio mix of whole numbers, 64 bits of a long; see :func:`hexadecimal` for their unsigned order."""
    return mixed_into(F.lit(GOLDEN).cast("long"), *parts)


def mixed_into(h: Column, *parts: Column | int) -> Column:
    """``h`` mixed with further numbers, each added with shifted copies of what there is and a constant."""
    values = F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts])
    return F.aggregate(values, h, lambda h, v: h.bitwiseXOR(_sum64(v, F.lit(GOLDEN).cast("long"), F.shiftleft(h, 6), F.shiftrightunsigned(h, 2))))


def text_hash(text: Column) -> Column:
    """the byte-wise hash of a text, xor and multiplication by a prime in 64 bits."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text)
    numbers = F.transform(F.sequence(F.lit(1), size), lambda k: F.conv(F.substr(hexes, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        x = F.transform(F.array(h.bitwiseXOR(byte)), lambda x: _sum64(*[F.shiftleft(x, s) for s in PRIME_SHIFTS]))
        return F.element_at(x, 1)

    return F.when(size > 0, F.aggregate(numbers, F.lit(TEXT_BASIS).cast("long"), step)).otherwise(F.when(text.isNotNull(), F.lit(TEXT_BASIS).cast("long")))


def run_seed(k_sq: Column, r_inner: Column, r_outer: Column, region: Column, side: int = 256) -> Column:
    """the seed of a run's samples where none is given; the tiles' grid has no offset."""
    return mixed_into(text_hash(region), k_sq, r_inner, r_outer, side, 0, 0)


def sample_hash(i: Column, j: Column, r_inner: Column, r_outer: Column, seed: Column, sample_class: int) -> Column:
    """a tile's hash for a class of samples, given by its number in ``CLASSES``."""
    return mixed(seed, sample_class, i, j, r_inner, r_outer)


def hexadecimal(h: Column) -> Column:
    """16 digits, whose order is that of the 64 bits as an unsigned number."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def _sum64(*xs: Column) -> Column:
    """A sum modulo 2**64, in halves so that nothing overflows."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    low = reduce(Column.__add__, [x.bitwiseAND(mask) for x in xs])
    high = reduce(Column.__add__, [F.shiftrightunsigned(x, 32) for x in xs]) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def bottom_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """T4: the first ``k`` rows of each key.  The rank filter is pushed below the shuffle by Spark's window
    group limit, so a hot key sends ``k`` rows a task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def quotas(target: int, classes: tuple[str, ...] = CLASSES) -> dict[str, int]:
    """T5: equal shares; the rest goes to the last class."""
    share = target // len(classes)
    return {c: share for c in classes[:-1]} | {classes[-1]: target - share * (len(classes) - 1)}


def stratified(df: DataFrame, id_columns: list[str], members: dict[str, Column], order: dict[str, list[Column]], target: int) -> DataFrame:
    """T5: (ids, sample_class, rank), each id once; earlier classes choose first.

    ``members``: which rows belong to a class; ``order``: expressions by which it prefers rows, ascending.
    Each class keeps its best ``target`` candidates, which is enough whatever earlier classes take.  One pass over
    the data deals each row to its classes and ranks it; the rank's limit holds below the shuffle, so each task
    sends ``target`` rows a class.  Then classes choose in turn, and if some fall short the last class fills up.
    """
    names = tuple(members)
    quota = quotas(target, names)
    last = names[-1]
    dealt = df.withColumn("sample_class", F.explode(F.array_compact(F.array(*[F.when(members[n], F.lit(n)) for n in names]))))
    keys = {f"key_{i}_{k}": F.when(F.col("sample_class") == n, c) for i, n in enumerate(names) for k, c in enumerate(order[n])}
    keyed = dealt.select(*id_columns, "sample_class", *[c.alias(k) for k, c in keys.items()])
    pool = cut(bottom_k(keyed, ["sample_class"], [F.col(c) for c in (*keys, *id_columns)], target).select(*id_columns, "sample_class", F.col("place").alias("rank")))
    taken = None
    for n in names:
        rows = pool.where(F.col("sample_class") == n)
        if taken is not None:
            rows = rows.join(taken.select(*id_columns), id_columns, "left_anti")
        chosen = rows.orderBy("rank").limit(quota[n])
        taken = cut(chosen if taken is None else taken.unionByName(chosen))
    fill = rows.join(taken.select(*id_columns), id_columns, "left_anti").orderBy("rank").limit(max(0, target - taken.count()))
    return taken.unionByName(fill)


def evenly(df: DataFrame, place: str, every: int) -> DataFrame:
    """Each n-th row by a place column."""
    return df.where(F.col(place) % every == 0)


def nulls_last(*names: str) -> list[Column]:
    """A sort by several keys with nulls last."""
    return [F.asc_nulls_last(n) for n in names]


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
