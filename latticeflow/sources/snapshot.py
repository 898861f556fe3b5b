"""Snapshots (S6, S7, K1, K2): 120 bytes of header, then one 256-byte record per tile in (i, j) order.

The usual form of a run is Parquet by column; the binary form is for exchange.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions.records import packed, unpacked
from latticeflow.params import Annulus
from latticeflow.sources import record_files

MAGIC = b"CMV2"
HEADER = 120
RECORD = 256


def header(q: Annulus, grid_text: str, tiles: int) -> bytes:
    """The header: magic, version 1, three sha256 (grid, parameters, prime test), tile count, record size, padding."""
    digest = lambda s: hashlib.sha256(s.encode()).digest()
    return MAGIC + (1).to_bytes(4, "little") + digest(grid_text) + digest(q.canonical()) + digest("strong pseudoprimes") + tiles.to_bytes(8, "little") + RECORD.to_bytes(4, "little") + bytes(4)


def grid_text(towers: DataFrame) -> str:
    """the towers as text, from one row per column."""
    rows = towers.orderBy("i").select(F.concat_ws(":", *[F.col(c).cast("string") for c in ("i", "j_low", "j_high")]).alias("t"))
    return ";".join(r.t for r in rows.toLocalIterator())


def write(summaries: DataFrame, towers: DataFrame, q: Annulus, path: str, generated_at: str | None = None) -> dict:
    """K1, K2: writes the snapshot and its manifest beside it; returns the manifest.

    All tasks write their records at the tiles' places in the grid; a summary with more labels or ports than a
    record holds must carry the overflow flag (capacities on).
    """
    fits = (F.aggregate("n", F.lit(0), lambda a, x: a + x) <= 192) & (F.size("inner") <= 128) & (F.coalesce(F.array_max("face_groups"), F.lit(0)) <= 128)
    if summaries.where(~fits).take(1):
        raise ValueError("a tile doesn't fit its record; summarise with capacities on")
    text = grid_text(towers)
    count = summaries.count()
    expected = towers.agg(F.sum(F.col("j_high") - F.col("j_low") + 1)).first()[0] or 0
    if count != expected:
        raise ValueError(f"{count} tiles for a grid of {expected}")
    placed = summaries.join(towers.select("i", "j_low", "tower_offset"), "i").withColumn("idx", F.col("tower_offset") + F.col("j") - F.col("j_low"))
    head = header(q, text, count)
    record_files.write(placed.select("idx", packed(F.col("n"), F.col("face_groups"), F.col("inner"), F.col("outer"), F.col("tile_flags")).alias("record")), path, RECORD, head)
    manifest = {
        "schema_version": 1, "grid_params_hash": head[8:40].hex(), "constants_hash": head[40:72].hex(), "prime_test_hash": head[72:104].hex(), "tile_count": count, "bytes_per_tile": RECORD,
        "k_sq": q.k, "r_inner": q.r_inner, "r_outer": q.r_outer, "generated_at_utc": generated_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
    }
    Path(f"{record_files.mounted(path)}.manifest.json").write_text(json.dumps(manifest, sort_keys=True))
    return manifest


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: fields of the header and ``errors``."""
    files = spark.createDataFrame(record_files.sizes(path), "path string, length long")
    heads = record_files.read(spark, path, HEADER, end=1, partial=True).select("path", "record")
    text = F.hex("record")
    part = lambda at, n: F.substring(text, F.lit(2 * at + 1), F.lit(2 * n))
    number = lambda at, n: F.conv(F.concat(*[part(at + k, 1) for k in reversed(range(n))]), 16, 10).cast("long")
    told = files.join(heads, "path", "left").select("path", "length", part(0, 4).alias("magic"), number(4, 4).alias("version"), F.lower(part(8, 32)).alias("grid_hash"), F.lower(part(40, 32)).alias("constants_hash"), F.lower(part(72, 32)).alias("prime_hash"), number(104, 8).alias("tile_count"), number(112, 4).alias("bytes_per_tile"), number(116, 4).alias("padding"))
    rules = {
        "magic": F.col("magic") == MAGIC.hex().upper(),
        "version": F.col("version") == 1,
        "bytes_per_tile": F.col("bytes_per_tile") == RECORD,
        "padding": F.col("padding") == 0,
        "length": F.col("length") == HEADER + RECORD * F.col("tile_count"),
    }
    return told.withColumn("errors", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]), lambda x: x.isNotNull()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, n, face_groups, inner, outer, tile_flags): the records of snapshot files."""
    raw = record_files.read(spark, path, RECORD, HEADER, partial=True)
    return raw.select("path", "idx", unpacked(F.col("record")).alias("t")).select("path", "idx", "t.*")
