"""Document sources (S8-S12): JSON, JSON lines with line numbers, TSV run indexes, key-value logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILEOP = "struct<n:array<int>,face_groups:array<int>,inner_flags:array<int>,outer_flags:array<int>,tile_flags:int>"
SAMPLES = f"schema_version int, claim_id string, k_sq long, r_inner long, r_outer long, width long, region string, sample_class string, tile struct<i:long,j:long,a_lo:long,b_lo:long>, tileop {TILEOP}"
CERTIFICATES = "schema_version int, claim_id string, k_sq long, r_inner long, r_outer long, region string, source string, path array<struct<a:long,b:long>>"
MANIFESTS = "schema_version int, claim_id string, k_sq long, r_inner long, r_outer long, width long, region string, row_class string, seed long, target_tile_samples long, sample_count long, class_counts map<string,long>, selection array<struct<class:string,description:string,target_count:long,population_exhausted:boolean>>, population_exhaustion map<string,boolean>"
CERTIFICATE_FIELDS = ["schema_version", "claim_id", "k_sq", "r_inner", "r_outer", "region", "source", "path"]


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Tile samples, one JSON object a line; a malformed line fails the read."""
    return spark.read.schema(SAMPLES).option("mode", "FAILFAST").json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, document): whole JSON documents as text, for documents of many shapes."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("document"))


def certificates(docs: DataFrame, column: str = "document") -> DataFrame:
    """Certificates of JSON texts with ``unknown``, the fields they must not have."""
    names = F.json_object_keys(column)
    return docs.withColumn("unknown", F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in CERTIFICATE_FIELDS]))).withColumn("c", F.from_json(column, CERTIFICATES)).select("*", "c.*").drop("c")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, row, error) of JSON-lines files; blank lines are skipped, bad ones have an error.

    Files are read in blocks.  A block's lines are numbered where they are read, and the lines of the file's
    earlier blocks are added, from one row per block.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks.select("file", "block", "begin", earlier.alias("earlier")), ["file", "block"]).where("trim(row) <> ''")
    number = F.col("at") - F.col("begin") + F.col("earlier") + 1
    kind = F.when(F.try_parse_json("row").isNull(), "not JSON").when(~F.trim("row").startswith("{"), "not an object")
    return placed.select("file", number.alias("line_number"), "row", F.when(kind.isNotNull(), F.concat("file", F.lit(":"), number.cast("string"), F.lit(": "), kind)).alias("error"))


def run_index(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A TSV with a header; raises if required columns are missing."""
    df = spark.read.csv(path, sep="\t", header=True)
    if gone := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def log_fields(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, field, value, count) from log lines (path, value): what each pattern's first group matched.

    A field must be given once; ``count`` above 1 tells repeats.
    """
    found = F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in patterns]), F.array(*[F.regexp_extract("value", p, 1) for p in patterns.values()]))).alias("field", "text")
    return lines.select("path", found).where("text <> ''").groupBy("path", "field").agg(F.min("text").alias("value"), F.count(F.lit(1)).alias("count"))


def log_rows(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row per log, its fields as columns."""
    return fields.groupBy("path").pivot("field", names).agg(F.first("value"))
