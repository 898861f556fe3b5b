"""Sinks (K3-K11): documents, samples, reports, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.functions.records import flag_bytes
from latticeflow.operators.aggregates import digest
from latticeflow.operators.sampling import quotas
from latticeflow.params import Annulus
from latticeflow.sources import record_files


def write_tiles(summaries: DataFrame, path: str, columns_per_file: int = 256) -> None:
    """K1: a run's tiles as Parquet, in ranges of columns and sorted, so that readers of a column range skip files."""
    summaries.withColumn("columns", F.floor(F.col("i") / columns_per_file)).repartitionByRange("i").sortWithinPartitions("i", "j").write.partitionBy("columns").mode("overwrite").parquet(path)


def profile(totals: DataFrame, census: DataFrame, pressure: DataFrame, distributions: DataFrame | None = None, run: dict | None = None, trace: DataFrame | None = None) -> DataFrame:
    """K3: one row (document): a run's profile as a nested JSON text.

    Totals, component census and pressure tiles; exact distributions from (name, value, count); the event that
    first spanned, null for a moat; and ``run``, what identifies the run, as given.
    """
    one = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).withColumn("one", F.lit(1))
    doc = totals.select(F.struct(*totals.columns).alias("tiles"), F.lit(1).alias("one")).join(one(census, "component_census"), "one").join(one(pressure, "high_pressure_tiles"), "one")
    stats = ["component_census", "high_pressure_tiles"]
    if distributions is not None:
        by_name = distributions.groupBy("name").agg(F.struct(F.sum("count").alias("count"), F.sort_array(F.collect_list(F.struct("value", "count"))).alias("buckets")).alias("d"))
        doc = doc.join(by_name.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "d")))).alias("distributions")).withColumn("one", F.lit(1)), "one")
        stats.append("distributions")
    parts = [F.lit(2).alias("schema_version"), *[F.lit(v).alias(k) for k, v in (run or {}).items()], F.col("tiles"), F.struct(*stats).alias("stats_v2")]
    if trace is not None:
        doc = doc.join(one(trace, "events"), "one")
        parts.append(F.get("events", F.lit(0)).alias("span_trace"))
    return doc.select(F.to_json(F.struct(*parts)).alias("document"))


def tile_distributions(summaries: DataFrame) -> DataFrame:
    """K3: (name, value, count) of the tiles' primes, groups, ports and largest faces."""
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    values = {"gaussian_prime_counts": F.col("primes"), "group_counts": F.col("groups"), "total_port_counts": total, "max_face_port_counts": F.array_max("n")}
    spread = summaries.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("long") for v in values.values()]))).alias("name", "value"))
    return spread.groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))


def sample_lines(samples: DataFrame, summaries: DataFrame, q: Annulus, claim_id: str, region: str = "full-octant") -> DataFrame:
    """K4: (value): one JSON line per chosen sample (i, j, sample_class), with its tile's record; what S8 reads."""
    chosen = samples.select("i", "j", "sample_class").join(summaries, ["i", "j"])
    number = lambda x: F.lit(x).cast("long")
    line = F.struct(
        F.lit(1).alias("schema_version"), F.lit(claim_id).alias("claim_id"), number(q.k).alias("k_sq"), number(q.r_inner).alias("r_inner"), number(q.r_outer).alias("r_outer"), number(q.r_outer - q.r_inner).alias("width"), F.lit(region).alias("region"), "sample_class",
        F.struct("i", "j", (F.col("i") * q.side).alias("a_lo"), (F.col("j") * q.side).alias("b_lo")).alias("tile"),
        F.struct("n", "face_groups", flag_bytes(F.col("inner")).alias("inner_flags"), flag_bytes(F.col("outer")).alias("outer_flags"), "tile_flags").alias("tileop"),
    )
    return chosen.select(F.to_json(line).alias("value"))


def sample_manifest(samples: DataFrame, target: int, population: DataFrame | None = None) -> DataFrame:
    """K4: one row (document): counts by class of chosen samples, quotas, and which classes were exhausted.

    ``population``: (sample_class, population), how many tiles a class has; a class is exhausted if it gave all.
    """
    counts = samples.groupBy("sample_class").agg(F.count(F.lit(1)).alias("observed"))
    if population is None:
        told = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_class", "observed")))).alias("class_counts"), F.sum("observed").alias("sample_count"))
        return told.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(target).alias("target_tile_samples"), "sample_count", "class_counts")).alias("document"))
    wanted = quotas(target)
    spark = samples.sparkSession
    every = spark.createDataFrame([(c, n) for c, n in wanted.items()], "sample_class string, quota long").join(counts, "sample_class", "left").join(population, "sample_class", "left")
    every = every.select("sample_class", "quota", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), F.coalesce("population", F.lit(0)).cast("long").alias("population"))
    told = F.struct("quota", "observed", "population", (F.col("observed") >= F.col("population")).alias("population_exhausted")).alias("told")
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample_class", c))))
    one = every.select("sample_class", "quota", "observed", told).agg(entry("observed").alias("class_counts"), entry("quota").alias("quotas"), entry("told").alias("population_exhaustion"), F.sum("observed").alias("sample_count"))
    return one.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(target).alias("target_tile_samples"), "sample_count", "quotas", "class_counts", "population_exhaustion")).alias("document"))


def certificate(path: DataFrame, k: int, r_inner: int, r_outer: int) -> DataFrame:
    """K5: one row (document) from a path (pos, a, b); no row for an empty path."""
    points = path.agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("p")).where(F.size("p") > 0)
    return points.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(k).alias("k_sq"), F.lit(r_inner).alias("r_inner"), F.lit(r_outer).alias("r_outer"), F.lit("full-octant").alias("region"), F.transform("p", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("path"))).alias("document"))


def sweep_lines(rows: DataFrame) -> DataFrame:
    """K6: (value): rows as compact JSON with sorted keys."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def report_lines(rows: DataFrame, columns: list[str], sep: str = " ") -> DataFrame:
    """K7: (value): rows as text, missing values as ``None``."""
    return rows.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]).alias("value"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """K7: (value): rows of a Markdown table."""
    return report_lines(rows, columns, " | ").select(F.concat(F.lit("| "), "value", F.lit(" |")).alias("value"))


def postflight_reports(checked: DataFrame, id_column: str = "bundle_id") -> DataFrame:
    """K8: (id, document): the reports of checked bundles."""
    return checked.select(id_column, F.to_json(F.struct(F.lit(1).alias("schema_version"), "status", "errors", F.struct("span_proof", "sample_audit").alias("detail"))).alias("document"))


def ledger(spark: SparkSession, path: str, block: int = record_files.SPLIT) -> DataFrame:
    """K9: (path, sha256, size_bytes, blocks, tree_sha256) of files of any size.

    A whole file's digest is a chain that one task follows; the tree's leaves, blocks of ``block`` bytes, are
    hashed by as many tasks as there are.  A block's rest at the end of a file is a shorter leaf.
    """
    return record_files.file_digests(spark, path).join(record_files.tree_digests(record_files.blocks(spark, path, block)), "path", "left")


def overflow_tiles(summaries: DataFrame) -> DataFrame:
    """The tiles that overflowed, for a CSV."""
    return summaries.where(F.col("tile_flags").bitwiseAND(F.lit(2)) != 0).select("i", "j", "primes", "groups")


def golden(summaries: DataFrame, batch: int = 64) -> DataFrame:
    """(batch, rows, digest) of tiles in order, by ranges of columns."""
    text = F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"), F.array_join("n", "."), F.array_join("face_groups", "."), F.array_join("inner", "."), F.array_join("outer", "."), F.col("tile_flags").cast("string"))
    return digest(summaries.withColumn("batch", F.floor(F.col("i") / batch)), ["batch"], ["i", "j"], text)


def golden_layers(layers: DataFrame, batch: int = 64) -> DataFrame:
    """(batch, layer, rows, digest) of the tiles' layers in order, by ranges of columns."""
    text = F.concat_ws(",", F.col("i").cast("string"), F.col("j").cast("string"), "digest")
    return digest(layers.withColumn("batch", F.floor(F.col("i") / batch)), ["batch", "layer"], ["i", "j"], text)
