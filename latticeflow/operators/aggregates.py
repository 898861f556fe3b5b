"""Aggregates (A1-A15): representatives, flags, exact histograms and percentiles, quotas, digests, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.operators.windows import numbered


def representatives(df: DataFrame, by: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """A1: per key the least row by ``order``, with the ``carry`` columns."""
    return df.groupBy(*by).agg(F.min(F.struct(*order, *carry)).alias("least")).select(*by, "least.*")


def joined_flags(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """A2: the OR of bit flags per key."""
    return df.groupBy(*by).agg(F.bit_or(flag).alias(flag))


def face_counts(ports: DataFrame) -> DataFrame:
    """A3: (i, j, ports_i, ports_o, ports_l, ports_r, total) port counts per tile."""
    on = lambda f: F.count_if(F.col("face") == f).alias(f"ports_{f.lower()}")
    return ports.groupBy("i", "j").agg(*[on(f) for f in "IOLR"], F.count(F.lit(1)).alias("total"))


def popcount(bits: Column) -> Column:
    """A4: set bits of a word."""
    return F.bit_count(bits)


def histogram(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A5: (value, count) exactly."""
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def distribution(df: DataFrame, value: str, by: list[str], percentiles: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """A5: count, sum, min, max and nearest-rank percentiles per key.

    Percentiles come from the histogram (the value at which the running count reaches ceil(p * n)), so what
    is sorted are distinct values and not rows.
    """
    h = histogram(df, value, by)
    w = Window.partitionBy(*by).orderBy("value")
    run = h.withColumn("upto", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy(*by)))
    rank = lambda p: F.call_function("div", F.col("n") * p + 99, F.lit(100).cast("long"))
    at = [F.min(F.when(F.col("upto") >= rank(p), F.col("value"))).alias(f"p{p}") for p in percentiles]
    return run.groupBy(*by).agg(F.max("n").alias("count"), F.sum(F.col("value") * F.col("count")).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), *at)


def run_totals(summaries: DataFrame) -> DataFrame:
    """One row of tile, port and overflow totals.

    The ``geo`` port totals count the ports of the inner and outer faces of tiles with such flags, the
    definition in use, and not ports of band components.
    """
    has = lambda c: F.size(c) > 0
    return summaries.agg(
        F.count(F.lit(1)).alias("tiles"),
        F.count_if(has("inner")).alias("geo_i_tiles"),
        F.count_if(has("outer")).alias("geo_o_tiles"),
        F.coalesce(F.sum(F.col("n")[0]), F.lit(0)).cast("long").alias("geo_i_ports"),
        F.coalesce(F.sum(F.col("n")[1]), F.lit(0)).cast("long").alias("geo_o_ports"),
        F.coalesce(F.sum(F.aggregate("n", F.lit(0), lambda a, x: a + x)), F.lit(0)).cast("long").alias("ports"),
        F.count_if(F.col("tile_flags").bitwiseAND(F.lit(2)) != 0).alias("overflow_tiles"),
        F.count_if(F.col("tile_flags").bitwiseAND(F.lit(1)) != 0).alias("empty_tiles"),
    )


def overshoot(batches: DataFrame, target: str, actual: str) -> DataFrame:
    """Totals and the largest excess of a batch over its target."""
    return batches.agg(F.count(F.lit(1)).alias("batches"), F.sum(actual).alias("total"), F.max(F.greatest(F.col(actual) - F.col(target), F.lit(0))).alias("most_over"))


def quota_status(samples: DataFrame, quotas: DataFrame, key: str = "sample_class") -> DataFrame:
    """(class, target, observed, exhausted, met) for quotas (class, target, exhausted)."""
    seen = samples.groupBy(key).agg(F.count(F.lit(1)).alias("observed"))
    joined = quotas.join(seen, key, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return joined.withColumn("met", (F.col("observed") >= F.col("target")) | F.coalesce("exhausted", F.lit(False)))


def duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    """A10: keys that occur more than once, with their count."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def summed_map(values: Column) -> Column:
    """The sum of a map's whole numbers, null for none."""
    xs = F.filter(F.map_values(values), lambda x: x.isNotNull())
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x))


def messages(rules: dict[str, Column]) -> Column:
    """The messages whose rule fails (null counts as failing), in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]), lambda x: x.isNotNull())


def digest(df: DataFrame, by: list[str], order: list[str], row: Column, chunk: int = 4096) -> DataFrame:
    """(by, rows, digest): sha256 over the rows' texts in order.

    Rows are digested in chunks of places and the chunks' digests again, so no key's rows meet in one value.
    """
    rows = df.select(*by, *[F.col(c).alias(f"order_{k}") for k, c in enumerate(order)], row.cast("string").alias("row_text"))
    placed = numbered(rows, by, [f"order_{k}" for k in range(len(order))], "place").select(*by, "row_text", (F.col("place") - 1).alias("place"))
    parts = placed.groupBy(*by, F.floor(F.col("place") / chunk).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("place", "row_text"))).alias("rows"))
    hashed = parts.select(*by, "part", "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["row_text"]), "\n"), 256).alias("h"))
    return hashed.groupBy(*by).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda r: r["h"]), "\n"), 256).alias("digest"))


def rate(amount: Column, seconds: Column) -> Column:
    """Amount per second; null when no time passed."""
    return F.try_divide(amount.cast("double"), seconds.cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many digits as C's ``round`` gives it: of the scaled double, half away from zero."""
    return F.round(x * 10.0**digits) / 10.0**digits


def _hundredths(x: Column) -> Column:
    """A double's value in hundredths as a whole number, by its exact binary value; ties go to the even one.

    ``format_string`` rounds the shortest decimal form instead, half up, which is another number's rounding: 0.125 is
    0.12 here.  The fraction is a whole multiple of 2**-56, below 1/16 of 2**-60, or else below half a hundredth.
    """
    w = F.floor(x).cast("long")
    bits = F.when(x < 1 / 16, F.lit(60)).otherwise(F.lit(56))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    scaled = F.floor((x - w.cast("double")) * one.cast("double")).cast("long") * 100
    k, rest = F.call_function("shiftright", scaled, bits), scaled.bitwiseAND(one - 1)
    half = F.call_function("div", one, F.lit(2).cast("long"))
    return w * 100 + k + F.when((rest > half) | ((rest == half) & (k % 2 == 1)), 1).otherwise(0)


def percent(part: Column, whole: Column) -> Column:
    """a text like 12.50%, or n/a."""
    x = F.try_divide(100.0 * part.cast("double"), whole.cast("double"))
    h = _hundredths(F.abs(x))
    div = F.call_function("div", h, F.lit(100).cast("long")).cast("string")
    text = F.concat(F.when(x < 0, "-").otherwise(""), div, F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit("%"))
    return F.when(F.coalesce(whole == 0, F.lit(True)) | part.isNull(), "n/a").otherwise(text)
