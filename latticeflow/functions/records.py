"""The packed 256-byte tile record, and the older 128-byte one, as column expressions.

Layout of the 256 bytes (fixed values): port counts of the four faces at 0, up to 192 group labels at 4, bit
sets of inner and outer labels at 196 and 212, flags at 228, zeros from 229.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = 256
LABELS = 192
FLAG_BYTES = 16


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2, "0")


def _bits(labels: Column) -> Column:
    """Sixteen bytes of hex; label L is bit (L - 1) % 8 of byte (L - 1) / 8."""
    on = lambda k: F.aggregate(F.filter(labels, lambda x: F.floor((x - 1) / 8) == k), F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.pmod(x - 1, F.lit(8)).cast("int"))))
    return F.concat(*[_byte(on(k)) for k in range(FLAG_BYTES)])


def flag_bytes(labels: Column) -> Column:
    """the sixteen bytes of a bit set as numbers."""
    hexed = _bits(labels)
    return F.transform(F.sequence(F.lit(0), F.lit(FLAG_BYTES - 1)), lambda k: F.conv(F.substr(hexed, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))


def packed(n: Column, face_groups: Column, inner: Column, outer: Column, flags: Column) -> Column:
    """The 256 bytes of a tile."""
    head = F.array_join(F.transform(n, _byte), "")
    body = F.rpad(F.array_join(F.transform(face_groups, _byte), ""), 2 * LABELS, "0")
    return F.unhex(F.rpad(F.concat(head, body, _bits(inner), _bits(outer), _byte(flags)), 2 * RECORD, "0"))


def _number(text: Column, at: Column | int, size: int = 1) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(text, 2 * at + 1, F.lit(2 * size)), 16, 10).cast("int")


def _labels(text: Column, at: int) -> Column:
    numbers = F.sequence(F.lit(1), F.lit(8 * FLAG_BYTES))
    return F.filter(numbers, lambda x: F.getbit(_number(text, at + F.floor((x - 1) / 8).cast("int")), F.pmod(x - 1, F.lit(8))) == 1)


def unpacked(record: Column) -> Column:
    """A struct (n, face_groups, inner, outer, tile_flags) of a 256-byte record; labels behind the ports are dropped."""
    return _bound(F.hex(record), _parts)


def _parts(text: Column) -> Column:
    n = F.array(*[_number(text, k) for k in range(4)])
    total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
    groups = F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), lambda k: _number(text, 4 + k))).otherwise(F.array().cast("array<int>"))
    return F.struct(n.alias("n"), groups.alias("face_groups"), _labels(text, 4 + LABELS).alias("inner"), _labels(text, 4 + LABELS + FLAG_BYTES).alias("outer"), _number(text, 228).alias("tile_flags"))


def old_unpacked(record: Column) -> Column:
    """A struct (status, O, I, L, R, L_h, R_h) of an older 128-byte record.

    Three offsets, then group bytes of the faces O, I, L, R and height bytes of L and R.  A group byte's low
    seven bits are the group, its high bit is the ninth bit of the height.  Status: ok, empty, overflow (first
    byte 255) or invalid (offsets out of order or past the end).
    """
    return _bound(F.hex(record), _old_parts)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, and not again for each entry of the lists that are made of it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _old_parts(text: Column) -> Column:
    off_i, off_l, off_r = (_number(text, k) for k in range(3))
    count_l = off_r - off_l
    rest = 128 - off_r - count_l
    orderly = (off_i >= 3) & (off_i <= off_l) & (off_l <= off_r) & (off_r <= 128) & (rest >= 0)
    blank = (off_i == 3) & (off_l == 3) & (off_r == 3) & (_number(text, 3) == 0)
    status = F.when(off_i == 255, "overflow").when(~orderly, "invalid").when(blank, "empty").otherwise("ok")
    places = F.struct(status.alias("status"), off_i.alias("i"), off_l.alias("l"), off_r.alias("r"), count_l.alias("count_l"), F.floor(rest / 2).cast("int").alias("count_r"))
    return _bound(places, lambda p: _old_faces(text, p))


def _old_faces(text: Column, p: Column) -> Column:
    none = F.array().cast("array<int>")
    take = lambda at, n: F.when((p["status"] == "ok") & (n > 0), F.transform(F.sequence(at, at + n - 1), lambda k: _number(text, k))).otherwise(none)
    group = lambda c: F.transform(c, lambda x: x.bitwiseAND(F.lit(0x7F)))
    tall = lambda g, h: F.zip_with(g, h, lambda x, y: F.shiftright(x, 7) * 256 + y)
    heights = p["r"] + p["count_r"]
    read = F.struct(take(p["l"], p["count_l"]).alias("left"), take(p["r"], p["count_r"]).alias("right"))
    return _bound(read, lambda x: F.struct(
        p["status"].alias("status"), group(take(F.lit(3), p["i"] - 3)).alias("face_o"), group(take(p["i"], p["l"] - p["i"])).alias("face_i"), group(x["left"]).alias("face_l"), group(x["right"]).alias("face_r"),
        tall(x["left"], take(heights, p["count_l"])).alias("height_l"), tall(x["right"], take(heights + p["count_l"], p["count_r"])).alias("height_r"),
    ))


def old_packed(face_o: Column, face_i: Column, face_l: Column, face_r: Column, height_l: Column, height_r: Column) -> Column:
    """the older 128 bytes from groups by face and heights of L and R; all bytes 255 where they don't fit.

    A record holds groups from 1 to 127, heights up to 511 and 125 bytes of ports: one for each of O and I, two for
    each of L and R.  Group 0 doesn't fit, as a reader takes it for an empty record's.  What is free lies between R's groups and the heights, and behind these.
    """
    hexed = lambda xs: F.array_join(F.transform(xs, _byte), "")
    tall = lambda g, h: F.zip_with(g, h, lambda x, y: x + F.shiftright(y, 8) * 128)
    ends = [F.lit(3) + F.size(face_o)]
    for face in (face_i, face_l):
        ends.append(ends[-1] + F.size(face))
    used = ends[-1] + 2 * F.size(face_r) + F.size(face_l)
    least = lambda *xs: F.coalesce(F.array_max(F.concat(*xs)), F.lit(0))
    fits = (used <= 128) & F.forall(F.concat(face_o, face_i, face_l, face_r), lambda g: g.between(1, 127)) & (least(height_l, height_r) <= 511)
    low = lambda h: F.transform(h, lambda y: F.pmod(y, F.lit(256)))
    groups = F.concat(*[_byte(e) for e in ends], hexed(face_o), hexed(face_i), hexed(tall(face_l, height_l)), hexed(tall(face_r, height_r)))
    heights = ends[-1] + F.floor((128 - ends[-1] - F.size(face_l)) / 2).cast("int")  # where a reader, who isn't told R's size, looks for them
    text = F.concat(F.rpad(groups, 2 * heights, F.lit("0")), hexed(low(height_l)), hexed(low(height_r)))
    return F.unhex(F.when(fits, F.rpad(text, 256, "0")).otherwise(F.repeat(F.lit("FF"), F.lit(128))))


def largest_group(old: Column) -> Column:
    """the largest group of an unpacked older record, 0 for none."""
    return F.coalesce(F.array_max(F.concat(old["face_o"], old["face_i"], old["face_l"], old["face_r"])), F.lit(0))
