"""Mixing sources to target weights, in DataFrame functions only.

Weights are the sources' token shares to the power of an exponent, normalised.  The exponent is 1 if the
natural mix meets the target entropy (a share of the highest possible); else it is bisected down until the
entropy meets the target, but not below the exponent at which some source would repeat more often than the
limit.  A source's quota of the token budget is realised as whole passes over its documents and part of one
more: its documents fall into 4,096 blocks of 4,096 smaller blocks by a seeded hash, the blocks are permuted
by a seeded hash, and blocks are taken while the quota lasts, then smaller blocks of the next block, then
documents of the next smaller block.  So a hot source is summed by block, and only one smaller block of a
source is looked at document by document.

Defined cases: null sources are one source, the empty string; null texts have no tokens, and a source
without tokens gets no weight and no copies; rows that repeat an id and source stand or fall together; with
an empty table the result is empty; extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import cut, free_name, shelved

#: Share of the highest possible entropy that the mix must have, passes over a source at most, seed.
ENTROPY = 0.92
REPEATS = 4.0
SEED = "mix-1"
STEPS = 40
#: The per-source decisions are broadcast up to so many sources (about 100 bytes each), joined plainly beyond.
BROADCAST_SOURCES = 50_000


def tokens(text: Column) -> Column:
    """Words of a text; the measure of a source's size."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keys(df: DataFrame, seed: str) -> DataFrame:
    """Adds the source's name and the places of a document in its source's permutation."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}|"), source, F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    df = df.withColumn("mix_source", source).withColumn("mix_h", h)
    block = F.substring("mix_h", 1, 3)
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}|"), F.col("mix_source"), F.lit("#"), block).cast("binary")), block)
    return df.withColumn("mix_block", order).withColumn("mix_sub", F.substring("mix_h", 4, 3)).withColumn("mix_doc", F.substring("mix_h", 7, 26)).drop("mix_h")


def weights(totals: DataFrame, budget: int | None, entropy: float, repeats: float) -> DataFrame:
    """(mix_source, total, exponent, weight, quota) from (mix_source, total > 0).

    Only the distinct totals, with the number of sources that have each, are gathered in one row.  ``d`` of them
    add up to ``d * (d + 1) / 2`` tokens at least, so there are at most the root of twice the corpus' tokens.
    Each step of a bisection passes over them once.
    """
    equal = totals.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    one = equal.agg(F.sort_array(F.collect_list(F.struct("total", "n"))).alias("rows"))
    one = one.withColumn("all", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["total"] * r["n"]))
    one = one.withColumn("budget", F.lit(budget).cast("long") if budget is not None else F.col("all"))
    told = lambda r: F.struct(F.ln(r["total"].cast("double") / F.col("all")).alias("ln"), r["n"].cast("double").alias("n"), (F.col("budget") / r["total"]).alias("passes"))
    one = one.withColumn("told", F.transform("rows", told))
    zero = F.lit(0.0).cast("double")

    def sums(exponent: Column) -> Column:
        """Of the shares to the power: their sum, the sum of each by its logarithm, the highest number of passes."""
        raised = F.transform("told", lambda r: F.struct(F.exp(exponent * r["ln"]).alias("x"), r["ln"].alias("ln"), r["n"].alias("n"), r["passes"].alias("passes")))
        add = lambda a, r: F.struct((a["z"] + r["n"] * r["x"]).alias("z"), (a["s"] + r["n"] * r["x"] * r["ln"]).alias("s"), F.greatest(a["m"], r["x"] * r["passes"]).alias("m"))
        return F.aggregate(raised, F.struct(zero.alias("z"), zero.alias("s"), zero.alias("m")), add)

    def bound(values: Column, then) -> Column:
        """``then(values)`` with ``values`` worked out once."""
        return F.element_at(F.transform(F.array(values), then), 1)

    spread = lambda e: bound(sums(e), lambda v: F.ln(v["z"]) - F.try_divide(e * v["s"], v["z"]))
    most = lambda e: bound(sums(e), lambda v: F.try_divide(v["m"], v["z"]))

    def bisected(fits) -> Column:
        """The largest exponent in 0..1 that ``fits`` (a test that holds below some exponent)."""
        ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            middle = (s["lo"] + s["hi"]) / 2
            return bound(fits(middle), lambda ok: F.struct(F.when(ok, middle).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(middle).alias("hi")))

        return F.when(fits(F.lit(1.0)), 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), ends, step)["lo"])

    sources = F.aggregate("told", zero, lambda a, r: a + r["n"])
    one = one.withColumn("target", F.lit(entropy) * F.ln(sources) - 1e-12)
    one = one.withColumn("flat", bisected(lambda e: spread(e) >= F.col("target")))
    # repeats fall as the exponent rises: below this exponent some source repeats too often
    one = one.withColumn("steep", F.when(most(F.lit(0.0)) > repeats, bisected(lambda e: most(e) > F.lit(repeats))).otherwise(0.0))
    one = one.withColumn("exponent", F.round(F.greatest("flat", "steep"), 9))
    one = one.withColumn("z", sums(F.col("exponent"))["z"])
    by_total = one.select("exponent", "budget", "z", F.explode(F.zip_with("rows", "told", lambda r, t: F.struct(r["total"].alias("total"), t["ln"].alias("ln")))).alias("r"))
    by_total = by_total.select(F.col("r.total").alias("total"), "exponent", (F.exp(F.col("exponent") * F.col("r.ln")) / F.col("z")).alias("weight"), "budget")
    rows = totals.join(cut(by_total), "total").select("mix_source", "total", "exponent", "weight", F.floor(F.col("weight") * F.col("budget") + 1e-6).cast("long").alias("quota"))
    return rows


def decisions(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: str = SEED, text: str = "text") -> DataFrame:
    """One row per source: exponent, weight, whole passes, and where the last pass ends."""
    slim = cut(_keys(docs.select("doc_id", "source", tokens(F.col(text)).alias("n_tokens")), seed).select("mix_source", "mix_block", "mix_sub", "mix_doc", "n_tokens").where("n_tokens > 0"))
    blocks = cut(slim.groupBy("mix_source", "mix_block").agg(F.sum("n_tokens").alias("n")))
    quotas = weights(blocks.groupBy("mix_source").agg(F.sum("n").alias("total")), budget, entropy, repeats)
    quotas = cut(quotas.withColumn("passes", F.floor(F.col("quota") / F.col("total")).cast("long")).withColumn("left_over", F.col("quota") - F.floor(F.col("quota") / F.col("total")).cast("long") * F.col("total")))

    def boundary(parts: DataFrame, key: str, by: list[str], left: str) -> DataFrame:
        """The first part by ``key`` that the rest of the quota doesn't cover, and what is left when it begins."""
        w = Window.partitionBy(*by).orderBy(key)
        summed = parts.withColumn("upto", F.sum("n").over(w))
        return summed.where(F.col("upto") > F.col(left)).groupBy(*by).agg(F.min(F.struct(F.col(key), (F.col(left) - F.col("upto") + F.col("n")).alias("rest"))).alias("first")).select(*by, F.col(f"first.{key}").alias(f"cut{key[3:]}"), F.col("first.rest").alias("rest"))

    few = quotas.count() <= BROADCAST_SOURCES
    small = lambda df: F.broadcast(df) if few else df
    held = lambda df: cut(df.coalesce(1) if few else df)
    first = held(boundary(blocks.join(small(quotas.select("mix_source", "left_over")), "mix_source"), "mix_block", ["mix_source"], "left_over"))
    inside = slim.join(small(first), "mix_source").where("mix_block = cut_block")
    subs = cut(inside.groupBy("mix_source", "rest", "mix_sub").agg(F.sum("n_tokens").alias("n")))
    second = held(boundary(subs, "mix_sub", ["mix_source", "rest"], "rest").toDF("mix_source", "outer_rest", "cut_sub", "rest"))
    within = inside.drop("rest").join(small(second), "mix_source").where("mix_sub = cut_sub").groupBy("mix_source", "rest", "mix_doc").agg(F.sum("n_tokens").alias("n"))
    taken = within.withColumn("upto", F.sum("n").over(Window.partitionBy("mix_source", "rest").orderBy("mix_doc"))).where("upto <= rest").groupBy("mix_source").agg(F.max("mix_doc").alias("cut_doc"))
    return held(
        quotas.join(first.select("mix_source", "cut_block"), "mix_source", "left").join(second.select("mix_source", "cut_sub"), "mix_source", "left").join(taken, "mix_source", "left")
        .select("mix_source", "exponent", "weight", "passes", "cut_block", "cut_sub", "cut_doc")
    )


ADDED = ("exponent", "weight", "copies")


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: str = SEED, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``exponent``, ``weight`` of the source, ``copies`` of the document (0: left out).

    Where ``docs`` has a column with one of these names, the added one gets an underscore more.
    """
    slim = docs.select("doc_id", "source", F.col(text).alias("text"))
    told = decisions(slim, budget, entropy, repeats, seed)
    side = F.broadcast(told) if told.count() <= BROADCAST_SOURCES else told
    before = lambda a, b, more: (F.col(a) < F.col(b)) | ((F.col(a) == F.col(b)) & more)
    last = before("mix_block", "cut_block", before("mix_sub", "cut_sub", F.coalesce(F.col("mix_doc") <= F.col("cut_doc"), F.lit(False))))
    copies = F.coalesce(F.col("passes"), F.lit(0)) + F.coalesce(last, F.lit(False)).cast("long")
    # every column of the documents under a name of its own while they are joined
    own = {c: f"own_{i}_" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col(text).alias("text"))
    joined = _keys(plain, seed).join(side, "mix_source", "left").withColumn("copies", F.when(tokens(F.col("text")) > 0, copies).otherwise(0).cast("long"))
    names, taken = [], list(docs.columns)
    for c in ADDED:
        names.append(free_name(taken, c))
        taken.append(names[-1])
    values = (F.coalesce("exponent", F.lit(1.0)), F.coalesce("weight", F.lit(0.0)), F.col("copies"))
    return joined.select(*[F.col(n).alias(c) for c, n in own.items()], *[v.alias(n) for v, n in zip(values, names, strict=True)])


def realised(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is copied, with the columns of ``docs``."""
    plain, back = shelved(docs, "doc_id", "source", options.get("text", "text"))
    mixed = mix(plain, **options)
    return back(mixed.where(F.col(mixed.columns[-1]) > 0).withColumn("shelved_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(mixed.columns[-1])))))


#: DuckDB SQL of :func:`mix` over ``documents`` with the default options.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n,
    md5('{SEED}|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), k AS (
  SELECT *, md5('{SEED}|' || source || '#' || h[1:3]) || h[1:3] AS block, h[4:6] AS sub, h[7:32] AS tail FROM d
), totals AS (
  SELECT source, sum(n)::BIGINT AS total FROM k WHERE n > 0 GROUP BY source
), shares AS (
  SELECT source, total, total::DOUBLE / sum(total) OVER () AS p, (sum(total) OVER ())::BIGINT AS budget, {ENTROPY} * ln((count(*) OVER ())::DOUBLE) - 1e-12 AS target FROM totals
), flat AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) >= max(target) FROM shares) AS ok FROM flat WHERE i < {STEPS})
), steep AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT max(pow(p, (lo + hi) / 2) * budget / total) / sum(pow(p, (lo + hi) / 2)) > {REPEATS} FROM shares) AS ok FROM steep WHERE i < {STEPS})
), chosen AS (
  SELECT round(greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) >= max(target) FROM shares) THEN 1.0 ELSE (SELECT lo FROM flat WHERE i = {STEPS}) END,
    CASE WHEN (SELECT max(budget / total::DOUBLE) / count(*) > {REPEATS} FROM shares) THEN CASE WHEN (SELECT max(p * budget / total) > {REPEATS} FROM shares) THEN 1.0 ELSE (SELECT lo FROM steep WHERE i = {STEPS}) END ELSE 0.0 END), 9) AS exponent
), quotas AS (
  SELECT source, total, exponent, pow(p, exponent) / sum(pow(p, exponent)) OVER () AS weight, floor(pow(p, exponent) / sum(pow(p, exponent)) OVER () * budget + 1e-6)::BIGINT AS quota
  FROM shares, chosen
), passes AS (
  SELECT *, quota // total AS passes, quota - quota // total * total AS left_over FROM quotas
), placed AS (
  SELECT k.doc_id, k.source, k.block, k.sub, k.tail, k.n, passes, left_over, exponent, weight,
    sum(k.n) OVER (PARTITION BY k.source ORDER BY k.block, k.sub, k.tail RANGE UNBOUNDED PRECEDING) AS upto
  FROM k JOIN passes USING (source) WHERE k.n > 0
)
SELECT d.doc_id, d.source, d.n AS n_tokens, round(coalesce(exponent, 1.0), 6) AS exponent, round(coalesce(weight, 0.0), 6) AS weight,
  coalesce(passes + CASE WHEN upto <= left_over THEN 1 ELSE 0 END, 0)::BIGINT AS copies
FROM d LEFT JOIN (SELECT DISTINCT doc_id, source, passes, left_over, exponent, weight, upto FROM placed) p ON d.doc_id = p.doc_id AND d.source = p.source
"""
