"""Queries over generated lattices; they ignore the tables.  The SQL builds the same annulus from ranges."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import functions as F

from latticeflow.functions import bands, integers
from latticeflow.functions import primes as P
from latticeflow.lineage import cut
from latticeflow.operators import aggregates, edges, sampling, stitch, trace
from latticeflow.operators import tiles as T
from latticeflow.operators import verdict as V
from latticeflow.params import Annulus
from latticeflow.plans import flat, two_level
from latticeflow.queries import Query
from latticeflow.sources import lattice, regions
from latticeflow.sources import tiles as G

SMALL = Annulus(8, 40, 120, 16)
WIDE = Annulus(36, 100, 300)
GRID = Annulus(10, 1000, 2000)
WIDE_GRID = Annulus(8, 400, 1200, 64)


def _primes_sql(q: Annulus) -> str:
    n = q.outer_sq
    return f"""
prime_numbers AS MATERIALIZED (
  SELECT n FROM range(2, {n + 1}) t(n)
  EXCEPT SELECT p * k FROM range(2, {isqrt(n) + 1}) s(p), range(2, {n // 2 + 1}) r(k) WHERE k >= p AND p * k <= {n}
), primes AS MATERIALIZED (
  SELECT a, b, a * a + b * b AS norm FROM range(0, {isqrt(n // 2) + 1}) x(a), range(0, {q.r_outer + 1}) y(b)
  WHERE b >= a AND a * a + b * b BETWEEN {q.inner_sq} AND {n}
    AND ((a = 0 AND b % 4 = 3 AND b IN (SELECT n FROM prime_numbers)) OR (a > 0 AND a * a + b * b IN (SELECT n FROM prime_numbers)))
), vertices AS MATERIALIZED (
  SELECT *, (a << 32) | b AS id,
    CASE WHEN norm >= {q.inner_sq} AND (norm - {q.inner_sq + q.k})::HUGEINT * (norm - {q.inner_sq + q.k}) <= {4 * q.inner_sq * q.k} THEN 1 ELSE 0 END
    + CASE WHEN norm <= {q.outer_sq} AND (norm - {q.outer_sq + q.k})::HUGEINT * (norm - {q.outer_sq + q.k}) <= {4 * q.outer_sq * q.k} THEN 2 ELSE 0 END AS reach
  FROM primes
), offsets AS (
  SELECT da, db FROM range({-q.collar}, {q.collar + 1}) x(da), range({-q.collar}, {q.collar + 1}) y(db)
  WHERE da * da + db * db BETWEEN 1 AND {q.k} AND (da > 0 OR (da = 0 AND db > 0))
), edges AS MATERIALIZED (
  SELECT v.a AS a1, v.b AS b1, w.a AS a2, w.b AS b2, v.id AS id1, w.id AS id2
  FROM (SELECT a, b, id, a + da AS xa, b + db AS xb FROM vertices, offsets) v JOIN vertices w ON w.a = v.xa AND w.b = v.xb
)"""


_COMPONENTS_SQL = """
linked AS MATERIALIZED (SELECT id1 AS x, id2 AS y FROM edges UNION ALL SELECT id2, id1 FROM edges),
labelled(id, component) USING KEY (id) AS (
  SELECT id, id FROM vertices
  UNION
  SELECT e.x, min(l.component) FROM labelled l JOIN linked e ON e.y = l.id JOIN recurring.labelled r ON r.id = e.x
  WHERE l.component < r.component GROUP BY e.x
), comps AS (
  SELECT l.component, count(*) AS size, bit_or(v.reach) AS reach FROM labelled l JOIN vertices v USING (id) GROUP BY l.component
)"""


def _with(q: Annulus, body: str, components: bool = False) -> str:
    return f"WITH RECURSIVE {_primes_sql(q)}{',' + _COMPONENTS_SQL if components else ''}\n{body}"


def s1_annulus_primes(spark, sf_dir):
    return lattice.primes(spark, WIDE)


def p1_p2_annulus_points(spark, sf_dir):
    pts = spark.range(0, 121).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(120).cast("long"))).alias("b"))
    norm = integers.norm_sq(F.col("a"), F.col("b"))
    return pts.where(bands.in_octant(F.col("a"), F.col("b")) & bands.in_annulus(norm, SMALL)).select("a", "b", norm.alias("norm"))


def p3_rational_primes(spark, sf_dir):
    n = spark.range(0, 20_000).select(F.col("id").alias("n"))
    return n.where(~P.divides_small(F.col("n"))).where(P.prime(F.col("n")))


def p4_gaussian_points(spark, sf_dir):
    return lattice.points(spark, SMALL).where(P.gaussian_prime(F.col("a"), F.col("b"))).select("a", "b")


def p5_gaussian_norms(spark, sf_dir):
    n = spark.range(2, 5000).select(F.col("id").alias("n"))
    return n.where(P.gaussian_norm(F.col("n")))


def p6_bands(spark, sf_dir):
    v = flat.vertices(spark, WIDE)
    return v.where("reach > 0").select("a", "b", "norm", "reach")


def p6_wide_integers(spark, sf_dir):
    """The band test far above 2**32, where squares pass 64 bits."""
    q = Annulus(40, 1_000_000_000, 1_000_000_500)
    eps = F.col("id") - 40_000
    norm = F.lit(q.inner_sq) + eps * 2_000_000
    return spark.range(0, 80_000).select(eps.alias("step"), norm.alias("norm"), bands.inner_band(norm, q).alias("inner")).where("norm > 0")


def p6_band_edges(spark, sf_dir):
    rows = [(q.k, q.r_inner, q.r_outer, *bands.band_edges(q).values()) for q in (SMALL, WIDE, GRID, Annulus(36, 100, 500))]
    return spark.createDataFrame(rows, "k long, r_inner long, r_outer long, inner_lo long, inner_hi long, outer_lo long, outer_hi long")


_ZONES = [Annulus(k, r, r + 400) for k in (8, 10, 36) for r in range(50, 250)]


def p12_bad_zones(spark, sf_dir):
    return bands.bad_zone(spark, _ZONES)


_ZONES_SQL = """WITH q AS (SELECT k, r AS r_inner, r + 400 AS r_outer FROM (VALUES (8::BIGINT), (10), (36)) a(k), range(50, 250) b(r)),
pn AS MATERIALIZED (SELECT n FROM range(2, 433000) t(n) EXCEPT SELECT p * m FROM range(2, 659) s(p), range(2, 216500) u(m) WHERE m >= p AND p * m < 433000),
norms AS MATERIALIZED (SELECT n FROM pn WHERE n = 2 OR n % 4 = 1 UNION SELECT n * n FROM pn WHERE n % 4 = 3 AND n < 659),
i AS (SELECT q.*, r_inner * r_inner + k + d AS n FROM q, range(0, 4000) t(d) WHERE d * d <= 4 * k * r_inner * r_inner AND (d + 1) * (d + 1) > 4 * k * (r_inner * r_inner - 1)),
o AS (SELECT q.*, r_outer * r_outer + k - d AS n FROM q, range(0, 9000) t(d) WHERE d * d <= 4 * k * r_outer * r_outer AND (d + 1) * (d + 1) > 4 * k * (r_outer * r_outer + 1))
SELECT k, r_inner, r_outer, coalesce(a, 0) AS inner_candidates, coalesce(b, 0) AS outer_candidates, coalesce(x, 0) + coalesce(y, 0) AS bad_norms, coalesce(x, 0) + coalesce(y, 0) = 0 AS clean FROM q
LEFT JOIN (SELECT k, r_inner, count(*) AS a, count(*) FILTER (n IN (SELECT n FROM norms)) AS x FROM i GROUP BY 1, 2) USING (k, r_inner) LEFT JOIN (SELECT k, r_inner, count(*) AS b, count(*) FILTER (n IN (SELECT n FROM norms)) AS y FROM o GROUP BY 1, 2) USING (k, r_inner)"""


CROWDED = Annulus(2, 300, 600)


def p11_overflows(spark, sf_dir):
    """Tiles and whether they pass the capacities of a record."""
    rows = T.summaries(G.tiles(G.towers(spark, CROWDED), CROWDED), CROWDED, caps=True, parts=6)
    return rows.select("i", "j", (F.col("tile_flags").bitwiseAND(F.lit(2)) != 0).alias("overflow"))


def f16_pressure(spark, sf_dir):
    """Totals of the tiles' pressure scores by number of groups."""
    rows = T.summaries(G.tiles(G.towers(spark, SMALL), SMALL), SMALL)
    score = T.pressure(F.col("n"), F.col("face_groups"), F.col("tile_flags"), F.col("inner"), F.col("outer"))
    return rows.groupBy(F.col("groups").cast("long").alias("groups")).agg(F.sum(score).cast("long").alias("score"), F.count(F.lit(1)).alias("tiles"))


def u1_tube_primes(spark, sf_dir):
    """The primes of all tiles' widened squares, each once: the annulus again."""
    return trace.tube_primes(spark, G.tiles(G.towers(spark, SMALL), SMALL), SMALL)


def f2_integer_roots(spark, sf_dir):
    big = 3_037_000_499
    n = spark.range(0, 2000).select(F.explode(F.array(F.col("id"), F.col("id") * F.col("id") * 1_000_003, F.lit(big * big) - F.col("id"), (F.lit(big) - F.col("id")) * (F.lit(big) - F.col("id")))).alias("n")).distinct()
    return n.select("n", integers.floor_isqrt(F.col("n")).alias("floor_root"), integers.ceil_isqrt(F.col("n")).alias("ceil_root"))


def f5_f8_f12_packing(spark, sf_dir):
    n = spark.range(0, 3000).select((F.col("id") - 1500).alias("x"), F.col("id").alias("id"))
    row, col = integers.unpacked_position(F.col("id").cast("int"), 269)
    return n.select("x", integers.euclidean_mod(F.col("x"), 97).alias("rest"), row.cast("long").alias("row"), col.cast("long").alias("col"), integers.packed_position(row, col, 269).cast("long").alias("pos"), integers.pair_key(F.col("id"), F.pmod(F.col("id") * 7919, F.lit(4_294_967_296))).alias("key"))


def f7_face_coordinates(spark, sf_dir):
    v = lattice.primes(spark, SMALL)
    q = SMALL
    i, j = F.floor(F.col("a") / q.side), F.floor(F.col("b") / q.side)
    faces = F.explode(F.array(*[F.lit(f) for f in "IOLR"])).alias("face")
    h, perp = integers.face_coordinates(F.col("face"), F.col("a"), F.col("b"), i * q.side, j * q.side, q.side)
    return v.select("a", "b", faces).select("a", "b", "face", h.alias("h"), perp.alias("perp")).where(F.abs("perp") <= q.collar)


def j2_neighbour_edges(spark, sf_dir):
    return edges.near(lattice.primes(spark, WIDE), WIDE.k)


def j2_palette_edges(spark, sf_dir):
    return edges.by_offsets(lattice.primes(spark, SMALL), SMALL.k, odd_sums=True)


def j4_strip_edges(spark, sf_dir):
    v = lattice.primes(spark, SMALL).withColumn("perp", F.pmod(F.col("b"), F.lit(16)))
    return edges.within_strip(edges.near(v, SMALL.k, ("perp",)), "perp1", "perp2", SMALL.collar).select("a1", "b1", "a2", "b2")


def g1_components(spark, sf_dir):
    return flat.solve(spark, SMALL).vertices.select("a", "b", "component")


def g2_reach(spark, sf_dir):
    return flat.solve(spark, SMALL).components().select("component", "size", F.col("reach").cast("long").alias("reach"))


def g3_verdicts(spark, sf_dir):
    out = None
    for k in (2, 8, 10):
        row = flat.solve(spark, Annulus(k, 40, 120, 16)).verdict().select(F.lit(k).cast("long").alias("k"), "verdict")
        out = row if out is None else out.union(row)
    return out


def g3_two_level_verdicts(spark, sf_dir):
    out = None
    for k in (2, 8, 10):
        row = two_level.solve(spark, Annulus(k, 40, 120, 16)).verdict().select(F.lit(k).cast("long").alias("k"), "verdict")
        out = row if out is None else out.union(row)
    return out


def g4_summary(spark, sf_dir):
    return flat.solve(spark, SMALL).summary().select(*[F.col(c).cast("long").alias(c) for c in ("primes", "components", "largest", "spanning_components", "inner_primes", "outer_primes", "edges")], "verdict")


def g5_census(spark, sf_dir):
    return V.census(flat.solve(spark, SMALL).components())


def g5_largest(spark, sf_dir):
    return V.largest(flat.solve(spark, SMALL).components()).select("component", "size")


def g5_largest_touching(spark, sf_dir):
    return V.largest(flat.solve(spark, SMALL).components(), touching=True).select("component", "size")


def j9_bridges(spark, sf_dir):
    """First edge between vertices of different residue classes of the norm."""
    v = lattice.primes(spark, SMALL).withColumn("label", F.pmod(F.col("norm"), F.lit(5)))
    return edges.bridges(edges.near(v, SMALL.k, ("label",)), "label1", "label2")


def u2_crosscheck(spark, sf_dir):
    return V.crosscheck(flat.solve(spark, SMALL).vertices)


def s3_tiles(spark, sf_dir):
    return G.tiles(G.towers(spark, GRID), GRID).select("i", "j", "idx")


def w1_tower_offsets(spark, sf_dir):
    return G.towers(spark, GRID)


def p9_active_tiles(spark, sf_dir):
    q = SMALL
    pairs = spark.range(0, 9).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("j"))
    return pairs.select("i", "j", G.is_active(F.col("i"), F.col("j"), q).alias("active"))


def w6_grid_invariants(spark, sf_dir):
    """The rules that a spoilt grid breaks: a tower moved, one emptied, one gone, one out of its neighbours' reach."""
    i = F.col("i")
    moved = F.when(i == 2, 2).when(i == 6, 40).otherwise(0)
    spoilt = G.towers(spark, WIDE_GRID).where("i <> 4").select("i", (F.col("j_low") + moved).alias("j_low"), F.when(i == 1, F.col("j_low") - 1).otherwise(F.col("j_high") + F.when(i == 6, 40).otherwise(0)).alias("j_high"))
    return G.invariant_violations(spoilt, block=3)


def f9_tile_places(spark, sf_dir):
    cols = cut(G.towers(spark, GRID))
    return G.tile_at(cols, spark.range(0, 100).select(F.col("id").alias("idx")))


def s5_first_tiles(spark, sf_dir):
    return G.first_tiles(G.tiles(G.towers(spark, GRID), GRID), 10).select("i", "j")


def t7_every_third_tile(spark, sf_dir):
    return G.selected(G.tiles(G.towers(spark, GRID), GRID), every=3, start=2, limit=5).select("i", "j", "idx")


def p14_region_clip(spark, sf_dir):
    cols = G.towers(spark, GRID)
    boxes = spark.createDataFrame([(0, 2, 5), (1, 0, 6), (2, 6, 7), (9, 0, 1)], "i long, j_lo long, j_hi long")
    return regions.clipped(cols, boxes)


def s14_towers_of_tiles(spark, sf_dir):
    return G.towers_of(G.tiles(G.towers(spark, GRID), GRID))


def s2_halo_counts(spark, sf_dir):
    q = SMALL
    return T.summaries(G.tiles(G.towers(spark, q), q), q).select("i", "j", F.col("primes").cast("long").alias("primes"))


def a3_face_ports(spark, sf_dir):
    rows = T.summaries(G.tiles(G.towers(spark, SMALL), SMALL), SMALL)
    return aggregates.face_counts(T.ports(rows))


def j5_j6_stitches(spark, sf_dir):
    rows = cut(T.summaries(G.tiles(G.towers(spark, SMALL), SMALL), SMALL))
    return stitch.stitch_edges(T.ports(rows)).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def a6_run_totals(spark, sf_dir):
    return aggregates.run_totals(T.summaries(G.tiles(G.towers(spark, SMALL), SMALL), SMALL))


def t3_high_pressure(spark, sf_dir):
    rows = T.summaries(G.tiles(G.towers(spark, SMALL), SMALL), SMALL)
    n = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    score = T.pressure(F.col("n"), F.col("face_groups"), F.col("tile_flags"), F.col("inner"), F.col("outer"))
    return sampling.high_pressure(rows.select("i", "j", score.alias("score"), n.alias("ports"), "groups", F.array_max("n").alias("max_face")))


def f17_f21_signatures(spark, sf_dir):
    rows = T.summaries(G.tiles(G.towers(spark, SMALL), SMALL), SMALL)
    return rows.select("i", "j", T.group_count(F.col("face_groups"), F.col("inner"), F.col("outer")).alias("groups"), F.array_join(T.signature(F.col("face_groups"), F.col("inner"), F.col("outer")), "/").alias("signature"))


def two_level_components(spark, sf_dir):
    """Components of visible groups by reach class: what the two-level plan sees of the flat graph."""
    return V.census(two_level.solve(spark, SMALL).components()).where("class = 'spanning'").select("class", "components")


OTHER = Annulus(5, 40, 120, 16)


def j14_layer_differences(spark, sf_dir):
    """Layers in which the tiles of two step bounds differ."""
    grid = cut(G.tiles(G.towers(spark, SMALL), SMALL))
    return T.layer_differences(T.layers(grid, SMALL), T.layers(grid, OTHER))


def j14_first_differences(spark, sf_dir):
    return T.first_differing_layers(j14_layer_differences(spark, sf_dir))


def g7_g9_span_path(spark, sf_dir):
    """A path from the inner to the outer band, as points in order."""
    return trace.span_path(spark, Annulus(10, 40, 120, 16))


def g10_path_check(spark, sf_dir):
    """Neighbours as paths of two points in annuli of their own; some are moved, some annuli too wide."""
    e = edges.near(lattice.primes(spark, SMALL), SMALL.k)
    norm = lambda p: F.col(f"a{p}") * F.col(f"a{p}") + F.col(f"b{p}") * F.col(f"b{p}")
    moved = F.when((F.col("a1") + F.col("b2")) % 5 == 0, F.col("a2") + 1).otherwise(F.col("a2"))
    claims = e.select(
        F.concat_ws(",", *[F.col(c).cast("string") for c in ("a1", "b1", "a2", "b2")]).alias("claim_id"),
        integers.floor_isqrt(F.least(norm(1), norm(2))).alias("r_inner"), (integers.floor_isqrt(F.greatest(norm(1), norm(2))) + 1 + F.when(F.col("b1") % 7 == 0, 40).otherwise(0)).alias("r_outer"),
        F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("a1").alias("a"), F.col("b1").alias("b")), F.struct(F.lit(1).cast("long").alias("pos"), moved.alias("a"), F.col("b2").alias("b"))).alias("points"),
    )
    rows = claims.select("claim_id", F.lit(SMALL.k).cast("long").alias("k_sq"), "r_inner", "r_outer", F.inline("points"))
    return trace.check_points(rows).select("claim_id", "points", "ok", F.array_join("errors", "; ").alias("errors"))


def g9_shortest_path(spark, sf_dir):
    """Points of a path with fewest steps between the bands, among all primes of the annulus."""
    q = Annulus(10, 40, 120, 16)
    v = cut(flat.vertices(spark, q))
    ends = lambda bit: v.where(F.col("reach").bitwiseAND(F.lit(bit)) != 0).select("id")
    path = trace.shortest_path(flat.edge_ids(v, q.k), ends(1), ends(2))
    return path.join(v, "id").select("pos", "a", "b")


def g6_span_event(spark, sf_dir):
    return trace.first_event(two_level.solve(spark, Annulus(10, 40, 120, 16)))



def _verdict_sql() -> str:
    parts = []
    for k in (2, 8, 10):
        q = Annulus(k, 40, 120, 16)
        parts.append(f"SELECT {k}::BIGINT AS k, v.verdict FROM ({_with(q, VERDICT, True)}) v")
    return " UNION ALL ".join(parts)


VERDICT = "SELECT CASE WHEN bool_or(reach = 3) THEN 'SPANNING' ELSE 'MOAT' END AS verdict FROM comps"


def _towers_sql(q: Annulus) -> str:
    """Active tiles by the definition: tiles that hold a lattice point of the octant annulus."""
    s = q.side
    return f"""pts AS MATERIALIZED (
  SELECT a, b FROM range(0, {isqrt(q.outer_sq // 2) + 1}) x(a), range(0, {q.r_outer + 1}) y(b) WHERE b >= a AND a * a + b * b BETWEEN {q.inner_sq} AND {q.outer_sq}
), tiles AS MATERIALIZED (
  SELECT DISTINCT i, j FROM (SELECT unnest(CASE WHEN a % {s} = 0 AND a > 0 THEN [a // {s}, a // {s} - 1] ELSE [a // {s}] END) AS i, b FROM pts) p,
    LATERAL (SELECT unnest(CASE WHEN p.b % {s} = 0 AND p.b > 0 THEN [p.b // {s}, p.b // {s} - 1] ELSE [p.b // {s}] END) AS j) t
), towers AS (
  SELECT i, min(j) AS j_low, max(j) AS j_high, (coalesce(sum(count(*)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS tower_offset FROM tiles GROUP BY i
), placed AS (
  SELECT t.i, t.j, w.tower_offset + t.j - w.j_low AS idx FROM tiles t JOIN towers w USING (i)
)"""


def _halo_sql(q: Annulus) -> str:
    s, c = q.side, q.collar
    return f"""WITH RECURSIVE {_primes_sql(q)}, {_towers_sql(q)}
SELECT t.i, t.j, count(p.a) AS primes FROM tiles t LEFT JOIN primes p
  ON p.a BETWEEN t.i * {s} - {c} AND t.i * {s} + {s + c} AND p.b BETWEEN t.j * {s} - {c} AND t.j * {s} + {s + c}
GROUP BY t.i, t.j"""


def _tile_sql(q: Annulus, body: str) -> str:
    """Tile summaries by the definition: components of each tile and of each of its face strips."""
    s, c = q.side, q.collar
    return f"WITH RECURSIVE {_primes_sql(q)}, {_towers_sql(q)},\n{_tile_bodies(s, c)}\n{body}"


def _tile_bodies(s: int, c: int) -> str:
    """Halos, labels, ports and flags of the tiles, for a side and a collar."""
    return f"""halo AS MATERIALIZED (
  SELECT t.i, t.j, v.id, v.a, v.b, v.reach, t.i * 1000 + t.j AS tile, (t.i * 1000 + t.j)::VARCHAR || ':' || v.id AS node FROM tiles t JOIN vertices v
  ON v.a BETWEEN t.i * {s} - {c} AND t.i * {s} + {s + c} AND v.b BETWEEN t.j * {s} - {c} AND t.j * {s} + {s + c}
), tile_links AS MATERIALIZED (
  SELECT x.node AS x, y.node AS y FROM halo x JOIN halo y ON x.tile = y.tile JOIN (SELECT id1, id2 FROM edges UNION ALL SELECT id2, id1 FROM edges) e ON e.id1 = x.id AND e.id2 = y.id
), tile_labelled(node, least) USING KEY (node) AS (
  SELECT node, id FROM halo
  UNION
  SELECT e.x, min(l.least) FROM tile_labelled l JOIN tile_links e ON e.y = l.node JOIN recurring.tile_labelled r ON r.node = e.x WHERE l.least < r.least GROUP BY e.x
), strip AS MATERIALIZED (
  SELECT *, f::VARCHAR || '/' || node AS spot FROM (
    SELECT h.*, f, CASE WHEN f < 2 THEN a - i * {s} ELSE b - j * {s} END AS h, CASE WHEN f < 2 THEN b - j * {s} ELSE a - i * {s} END - CASE WHEN f % 2 = 1 THEN {s} ELSE 0 END AS perp
    FROM halo h, range(0, 4) u(f)) WHERE abs(perp) <= {c}
), strip_links AS MATERIALIZED (
  SELECT x.spot AS x, y.spot AS y FROM strip x JOIN strip y ON x.tile = y.tile AND x.f = y.f JOIN (SELECT id1, id2 FROM edges UNION ALL SELECT id2, id1 FROM edges) e ON e.id1 = x.id AND e.id2 = y.id
), strip_labelled(spot, least) USING KEY (spot) AS (
  SELECT spot, id FROM strip
  UNION
  SELECT e.x, min(l.least) FROM strip_labelled l JOIN strip_links e ON e.y = l.spot JOIN recurring.strip_labelled r ON r.spot = e.x WHERE l.least < r.least GROUP BY e.x
), visible AS (
  SELECT tile, least, bit_or(reach) AS reach, dense_rank() OVER (PARTITION BY tile ORDER BY least) AS label
  FROM halo JOIN tile_labelled USING (node) WHERE reach > 0 OR node IN (SELECT node FROM strip) GROUP BY tile, least
), reps AS (
  SELECT * FROM (SELECT s.*, k.least AS part, row_number() OVER (PARTITION BY tile, f, k.least ORDER BY h, perp) AS place FROM strip s JOIN strip_labelled k USING (spot)) WHERE place = 1
), ports AS MATERIALIZED (
  SELECT r.tile, r.i, r.j, r.f, v.label, row_number() OVER (PARTITION BY r.tile ORDER BY r.f, h, perp, v.label) - 1 AS pos
  FROM reps r JOIN tile_labelled l USING (node) JOIN visible v ON v.tile = r.tile AND v.least = l.least
), face_counts AS MATERIALIZED (
  SELECT tile, i, j, count(*) FILTER (f = 0) AS ports_i, count(*) FILTER (f = 1) AS ports_o, count(*) FILTER (f = 2) AS ports_l, count(*) FILTER (f = 3) AS ports_r, count(*) AS total FROM ports GROUP BY tile, i, j
), flags AS (
  SELECT tile, count(*) AS groups, count(DISTINCT CASE WHEN reach & 1 > 0 THEN (label - 1) // 8 END) AS inner_bytes, count(DISTINCT CASE WHEN reach & 2 > 0 THEN (label - 1) // 8 END) AS outer_bytes,
    coalesce(bool_or(reach & 1 > 0), false) AS touches_inner, coalesce(bool_or(reach & 2 > 0), false) AS touches_outer FROM visible GROUP BY tile
)"""


#: The parts of the tiles' records as texts.
RECORDS_SQL = """SELECT t.i, t.j, coalesce(c.ports_i, 0) || '.' || coalesce(c.ports_o, 0) || '.' || coalesce(c.ports_l, 0) || '.' || coalesce(c.ports_r, 0) AS n, coalesce(p.told, '') AS face_groups, coalesce(v.inner_told, '') AS "inner", coalesce(v.outer_told, '') AS "outer",
  CASE WHEN t.i * 1000 + t.j IN (SELECT tile FROM halo) THEN 0 ELSE 1 END::BIGINT AS tile_flags
FROM tiles t LEFT JOIN face_counts c ON c.tile = t.i * 1000 + t.j LEFT JOIN (SELECT tile, string_agg(label::VARCHAR, '.' ORDER BY pos) AS told FROM ports GROUP BY tile) p ON p.tile = t.i * 1000 + t.j
LEFT JOIN (SELECT tile, string_agg(label::VARCHAR, '.' ORDER BY label) FILTER (reach & 1 > 0) AS inner_told, string_agg(label::VARCHAR, '.' ORDER BY label) FILTER (reach & 2 > 0) AS outer_told FROM visible GROUP BY tile) v ON v.tile = t.i * 1000 + t.j"""
#: Digests of the tiles' layers.
LAYERS_SQL = f"""SELECT i, j, unnest(['primes', 'bands', 'labels', 'record']) AS layer, unnest([sha256(x), sha256(y), sha256(z), sha256(record)]) AS digest FROM (
  SELECT r.i, r.j, coalesce(x, '') AS x, coalesce(y, '') AS y, coalesce(z, '') AS z, n || '|' || face_groups || '|' || "inner" || '|' || "outer" || '|' || tile_flags AS record FROM ({RECORDS_SQL}) r LEFT JOIN (
    SELECT h.i, h.j, string_agg(h.a || ':' || h.b, ' ' ORDER BY h.a, h.b) AS x, string_agg(h.reach::VARCHAR, '' ORDER BY h.a, h.b) AS y, string_agg(coalesce(v.label, 0)::VARCHAR, ' ' ORDER BY h.a, h.b) AS z
    FROM halo h JOIN tile_labelled l USING (node) LEFT JOIN visible v ON v.tile = h.tile AND v.least = l.least GROUP BY h.i, h.j) t ON t.i = r.i AND t.j = r.j)"""


def _differences_sql() -> str:
    return f"""SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, coalesce(x.layer, y.layer) AS layer, x.digest AS left_digest, y.digest AS right_digest
FROM ({_tile_sql(SMALL, LAYERS_SQL)}) x FULL JOIN ({_tile_sql(OTHER, LAYERS_SQL)}) y ON x.i = y.i AND x.j = y.j AND x.layer = y.layer WHERE x.digest IS DISTINCT FROM y.digest"""


def _spoilt_sql() -> str:
    return f"""WITH {_towers_sql(WIDE_GRID)}, g AS (SELECT i, j_low + CASE i WHEN 2 THEN 2 WHEN 6 THEN 40 ELSE 0 END AS lo, CASE i WHEN 1 THEN j_low - 1 WHEN 6 THEN j_high + 40 ELSE j_high END AS hi FROM towers WHERE i <> 4),
b AS (SELECT *, lag(i) OVER w AS pi, lag(lo) OVER w AS pl, lag(hi) OVER w AS ph FROM g WINDOW w AS (ORDER BY i))
SELECT i, unnest(list_filter([CASE WHEN i <> pi + 1 THEN 'gap' END, CASE WHEN hi < lo THEN 'empty' END, CASE WHEN abs(lo - pl) > 1 OR hi > ph OR ph - hi > i + 2 THEN 'shift' END, CASE WHEN lo > ph OR hi < pl THEN 'orphan' END], lambda x: x IS NOT NULL)) AS rule FROM b"""


_PATH_CHECKS = """, whole AS MATERIALIZED (SELECT n FROM range(2, 20001) t(n) EXCEPT SELECT p * m FROM range(2, 142) s(p), range(2, 10001) r(m) WHERE m >= p AND p * m <= 20000),
c AS (SELECT *, a1 * a1 + b1 * b1 AS n1, a2 * a2 + b2 * b2 AS n2, a2 + CASE WHEN (a1 + b2) % 5 = 0 THEN 1 ELSE 0 END AS a3 FROM edges),
d AS (SELECT *, a3 * a3 + b2 * b2 AS n3, floor(sqrt(least(n1, n2)))::BIGINT AS lo, floor(sqrt(greatest(n1, n2)))::BIGINT + 1 + CASE WHEN b1 % 7 = 0 THEN 40 ELSE 0 END AS hi FROM c),
f AS (SELECT *, a1 >= 0 AND b1 >= a1 AND a3 >= 0 AND b2 >= a3 AS octant, n1 BETWEEN lo * lo AND hi * hi AND n3 BETWEEN lo * lo AND hi * hi AS annulus,
  CASE WHEN a3 = 0 THEN b2 % 4 = 3 AND b2 IN (SELECT n FROM whole) WHEN b2 = 0 THEN a3 % 4 = 3 AND a3 IN (SELECT n FROM whole) ELSE n3 IN (SELECT n FROM whole) END AS prime, (a3 - a1) * (a3 - a1) + (b2 - b1) * (b2 - b1) BETWEEN 1 AND 8 AS step,
  (n1 - lo * lo - 8) * (n1 - lo * lo - 8) <= 32 * lo * lo AS start, (n3 - hi * hi - 8) * (n3 - hi * hi - 8) <= 32 * hi * hi AS stop FROM d)
SELECT a1 || ',' || b1 || ',' || a2 || ',' || b2 AS claim_id, 2::BIGINT AS points, octant AND annulus AND prime AND step AND start AND stop AS ok, array_to_string(list_filter([CASE WHEN NOT octant THEN 'point outside the octant' END, CASE WHEN NOT annulus THEN 'point outside the annulus' END,
  CASE WHEN NOT prime THEN 'point is not a Gaussian prime' END, CASE WHEN NOT step THEN 'step is zero or too long' END, CASE WHEN NOT start THEN 'first point is not in the inner band' END, CASE WHEN NOT stop THEN 'last point is not in the outer band' END], lambda x: x IS NOT NULL), '; ') AS errors FROM f"""

#: Distances from the inner band, and back from the smallest of the nearest outer points by the smallest neighbour nearer to it.
_SHORTEST = """, linked AS MATERIALIZED (SELECT id1 AS x, id2 AS y FROM edges UNION ALL SELECT id2, id1 FROM edges),
walked(id, far) USING KEY (id) AS (
  SELECT id, 0 FROM vertices WHERE reach & 1 > 0
  UNION
  SELECT e.y, min(w.far) + 1 FROM walked w JOIN linked e ON e.x = w.id LEFT JOIN recurring.walked r ON r.id = e.y WHERE r.id IS NULL GROUP BY e.y
), far AS MATERIALIZED (SELECT id, far FROM walked),
goal AS (SELECT id, far FROM far JOIN vertices USING (id) WHERE reach & 2 > 0 ORDER BY far, id LIMIT 1),
nearer AS MATERIALIZED (SELECT f.id, min(g.id) AS before FROM far f JOIN linked e ON e.x = f.id JOIN far g ON g.id = e.y AND g.far = f.far - 1 GROUP BY f.id),
path(id, pos) AS (SELECT id, far FROM goal UNION ALL SELECT n.before, pos - 1 FROM path p JOIN nearer n ON n.id = p.id)
SELECT pos::BIGINT AS pos, a, b FROM path JOIN vertices USING (id)"""


QUERIES: dict[str, Query] = {
    "s1_annulus_primes": Query(s1_annulus_primes, _with(WIDE, "SELECT a, b, norm FROM primes")),
    "p1_p2_annulus_points": Query(p1_p2_annulus_points, f"SELECT a, b, a * a + b * b AS norm FROM range(0, 121) x(a), range(0, 121) y(b) WHERE b >= a AND a * a + b * b BETWEEN {SMALL.inner_sq} AND {SMALL.outer_sq}"),
    "p3_rational_primes": Query(p3_rational_primes, "SELECT n FROM range(2, 20000) t(n) EXCEPT SELECT p * k FROM range(2, 142) s(p), range(2, 10000) r(k) WHERE p * k < 20000"),
    "p4_gaussian_points": Query(p4_gaussian_points, _with(SMALL, "SELECT a, b FROM primes")),
    "p5_gaussian_norms": Query(p5_gaussian_norms, "WITH pn AS (SELECT n FROM range(2, 5000) t(n) EXCEPT SELECT p * k FROM range(2, 71) s(p), range(2, 2500) r(k) WHERE p * k < 5000) SELECT n FROM pn WHERE n = 2 OR n % 4 = 1 UNION SELECT n * n FROM pn WHERE n % 4 = 3 AND n * n < 5000"),
    "p6_bands": Query(p6_bands, _with(WIDE, "SELECT a, b, norm, reach FROM vertices WHERE reach > 0")),
    "p6_wide_integers": Query(p6_wide_integers, "SELECT step, norm, norm >= 1000000000000000000 AND (norm - 1000000000000000040)::HUGEINT * (norm - 1000000000000000040)::HUGEINT <= 160000000000000000000::HUGEINT AS inner FROM (SELECT n - 40000 AS step, 1000000000000000000 + (n - 40000) * 2000000 AS norm FROM range(0, 80000) t(n))".replace(" AS inner", ' AS "inner"')),
    "p6_band_edges": Query(
        p6_band_edges,
        """WITH q(k, r_inner, r_outer) AS (VALUES (8::BIGINT, 40::BIGINT, 120::BIGINT), (36, 100, 300), (10, 1000, 2000), (36, 100, 500))
SELECT k, r_inner, r_outer, r_inner * r_inner AS inner_lo,
  (SELECT max(n) FROM range(1, 4100000) t(n) WHERE n >= r_inner * r_inner AND n <= r_inner * r_inner + 20 * r_inner AND (n - r_inner * r_inner - k) * (n - r_inner * r_inner - k) <= 4 * r_inner * r_inner * k) AS inner_hi,
  (SELECT min(n) FROM range(1, 4100000) t(n) WHERE n <= r_outer * r_outer AND n >= r_outer * r_outer - 20 * r_outer AND (n - r_outer * r_outer - k) * (n - r_outer * r_outer - k) <= 4 * r_outer * r_outer * k) AS outer_lo,
  r_outer * r_outer AS outer_hi FROM q""",
    ),
    "p12_bad_zones": Query(p12_bad_zones, _ZONES_SQL),
    "p11_overflows": Query(
        p11_overflows,
        _tile_sql(CROWDED, "SELECT t.i, t.j, coalesce(f.groups, 0) > 128 OR coalesce(total, 0) > 192 OR greatest(coalesce(ports_i, 0), coalesce(ports_o, 0), coalesce(ports_l, 0), coalesce(ports_r, 0)) > 255 AS overflow FROM tiles t LEFT JOIN flags f ON f.tile = t.i * 1000 + t.j LEFT JOIN face_counts c ON c.tile = t.i * 1000 + t.j"),
    ),
    "f16_pressure": Query(f16_pressure, _tile_sql(SMALL, "SELECT coalesce(f.groups, 0) AS groups, coalesce(sum(2 * total + inner_bytes + outer_bytes), 0)::BIGINT AS score, count(*) AS tiles FROM tiles t LEFT JOIN flags f ON f.tile = t.i * 1000 + t.j LEFT JOIN face_counts c ON c.tile = f.tile GROUP BY 1")),
    "u1_tube_primes": Query(u1_tube_primes, _with(SMALL, "SELECT a, b FROM primes")),
    "f2_integer_roots": Query(
        f2_integer_roots,
        """WITH ns AS (SELECT DISTINCT unnest([i, i * i * 1000003, 3037000499::BIGINT * 3037000499 - i, (3037000499 - i) * (3037000499 - i)]) AS n FROM range(0, 2000) t(i)),
rooted AS (SELECT n, (floor(sqrt(n::DOUBLE)))::HUGEINT AS r FROM ns),
exact AS (SELECT n, CASE WHEN (r + 1) * (r + 1) <= n THEN r + 1 WHEN r * r > n THEN r - 1 ELSE r END AS f FROM rooted)
SELECT n, f::BIGINT AS floor_root, (CASE WHEN f * f = n THEN f ELSE f + 1 END)::BIGINT AS ceil_root FROM exact""",
    ),
    "f5_f8_f12_packing": Query(f5_f8_f12_packing, "SELECT i - 1500 AS x, ((i - 1500) % 97 + 97) % 97 AS rest, i // 269 AS row, i % 269 AS col, i AS pos, (i << 32) | ((i * 7919) % 4294967296) AS key FROM range(0, 3000) t(i)".replace(" AS row", ' AS "row"')),
    "f7_face_coordinates": Query(
        f7_face_coordinates,
        _with(SMALL, """SELECT * FROM (
  SELECT a, b, face, CASE WHEN face IN ('I', 'O') THEN a % 16 ELSE b % 16 END AS h, CASE WHEN face IN ('I', 'O') THEN b % 16 ELSE a % 16 END - CASE WHEN face IN ('O', 'R') THEN 16 ELSE 0 END AS perp
  FROM primes, (VALUES ('I'), ('O'), ('L'), ('R')) f(face)) WHERE abs(perp) <= 2"""),
    ),
    "j2_neighbour_edges": Query(j2_neighbour_edges, _with(WIDE, "SELECT a1, b1, a2, b2 FROM edges")),
    "j2_palette_edges": Query(j2_palette_edges, _with(SMALL, "SELECT a1, b1, a2, b2 FROM edges")),
    "j4_strip_edges": Query(j4_strip_edges, _with(SMALL, "SELECT a1, b1, a2, b2 FROM edges WHERE b1 % 16 <= 2 AND b2 % 16 <= 2")),
    "g1_components": Query(g1_components, _with(SMALL, "SELECT v.a, v.b, l.component FROM vertices v JOIN labelled l USING (id)", True)),
    "g2_reach": Query(g2_reach, _with(SMALL, "SELECT component, size, reach::BIGINT AS reach FROM comps", True)),
    "g3_verdicts": Query(g3_verdicts, _verdict_sql()),
    "g3_two_level_verdicts": Query(g3_two_level_verdicts, _verdict_sql()),
    "g4_summary": Query(
        g4_summary,
        _with(SMALL, """SELECT (SELECT count(*) FROM vertices) AS primes, (SELECT count(*) FROM comps) AS components, (SELECT max(size) FROM comps) AS largest, (SELECT count(*) FROM comps WHERE reach = 3) AS spanning_components,
  (SELECT count(*) FROM vertices WHERE reach & 1 <> 0) AS inner_primes, (SELECT count(*) FROM vertices WHERE reach & 2 <> 0) AS outer_primes, (SELECT count(*) FROM edges) AS edges,
  (SELECT CASE WHEN bool_or(reach = 3) THEN 'SPANNING' ELSE 'MOAT' END FROM comps) AS verdict""", True),
    ),
    "g5_census": Query(g5_census, _with(SMALL, "SELECT CASE reach WHEN 0 THEN 'interior' WHEN 1 THEN 'inner_only' WHEN 2 THEN 'outer_only' ELSE 'spanning' END AS class, count(*) AS components, sum(size)::BIGINT AS vertices, max(size) AS largest FROM comps GROUP BY 1", True)),
    "g5_largest": Query(g5_largest, _with(SMALL, "SELECT component, size FROM comps ORDER BY size DESC, component LIMIT 8", True)),
    "j9_bridges": Query(j9_bridges, _with(SMALL, """SELECT label1, label2, a1, b1, a2, b2 FROM (
  SELECT *, least(x, y) AS label1, greatest(x, y) AS label2, row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY a1, b1, a2, b2) AS place
  FROM (SELECT *, (a1 * a1 + b1 * b1) % 5 AS x, (a2 * a2 + b2 * b2) % 5 AS y FROM edges) WHERE x <> y) WHERE place = 1""")),
    "u2_crosscheck": Query(u2_crosscheck, _with(SMALL, "SELECT component FROM comps WHERE reach = 3", True)),
    "s3_tiles": Query(s3_tiles, f"WITH {_towers_sql(GRID)} SELECT i, j, idx FROM placed"),
    "w1_tower_offsets": Query(w1_tower_offsets, f"WITH {_towers_sql(GRID)} SELECT i, j_low, j_high, tower_offset FROM towers"),
    "p9_active_tiles": Query(p9_active_tiles, f"WITH {_towers_sql(SMALL)} SELECT i, j, (i, j) IN (SELECT (i, j) FROM tiles) AS active FROM range(0, 9) x(i), range(0, 9) y(j)"),
    "w6_grid_invariants": Query(w6_grid_invariants, _spoilt_sql()),
    "f9_tile_places": Query(f9_tile_places, f"WITH {_towers_sql(GRID)} SELECT idx, i, j FROM placed WHERE idx < 100"),
    "s5_first_tiles": Query(s5_first_tiles, f"WITH {_towers_sql(GRID)} SELECT i, j FROM tiles ORDER BY i, j LIMIT 10"),
    "t7_every_third_tile": Query(t7_every_third_tile, f"WITH {_towers_sql(GRID)} SELECT i, j, idx FROM placed WHERE idx >= 2 AND (idx - 2) % 3 = 0 ORDER BY idx LIMIT 5"),
    "p14_region_clip": Query(p14_region_clip, f"WITH {_towers_sql(GRID)}, box(i, j_lo, j_hi) AS (VALUES (0::BIGINT, 2::BIGINT, 5::BIGINT), (1, 0, 6), (2, 6, 7), (9, 0, 1)) SELECT t.i, greatest(j_low, j_lo) AS j_low, least(j_high, j_hi) AS j_high FROM towers t JOIN box USING (i) WHERE greatest(j_low, j_lo) <= least(j_high, j_hi)"),
    "s14_towers_of_tiles": Query(s14_towers_of_tiles, f"WITH {_towers_sql(GRID)} SELECT i, j_low, j_high FROM towers"),
    "s2_halo_counts": Query(s2_halo_counts, _halo_sql(SMALL)),
    "a3_face_ports": Query(a3_face_ports, _tile_sql(SMALL, 'SELECT i, j, ports_i, ports_o, ports_l, ports_r, total FROM face_counts')),
    "j5_j6_stitches": Query(j5_j6_stitches, _tile_sql(SMALL, "SELECT CASE f WHEN 1 THEN 'match_io' ELSE 'match_lr' END AS event, count(*) AS n FROM ports WHERE (f = 1 AND tile + 1 IN (SELECT tile FROM halo)) OR (f = 3 AND tile + 1000 IN (SELECT tile FROM halo)) GROUP BY 1")),
    "a6_run_totals": Query(
        a6_run_totals,
        _tile_sql(SMALL, """SELECT (SELECT count(*) FROM tiles) AS tiles, (SELECT count(*) FROM flags WHERE touches_inner) AS geo_i_tiles, (SELECT count(*) FROM flags WHERE touches_outer) AS geo_o_tiles,
  (SELECT sum(ports_i)::BIGINT FROM face_counts) AS geo_i_ports, (SELECT sum(ports_o)::BIGINT FROM face_counts) AS geo_o_ports, (SELECT count(*) FROM ports) AS ports, 0::BIGINT AS overflow_tiles, (SELECT count(*) FROM tiles t WHERE t.i * 1000 + t.j NOT IN (SELECT tile FROM halo)) AS empty_tiles"""),
    ),
    "t3_high_pressure": Query(
        t3_high_pressure,
        _tile_sql(SMALL, """SELECT c.i, c.j, (2 * total + inner_bytes + outer_bytes)::BIGINT AS score, total::INTEGER AS ports, groups::INTEGER AS groups, greatest(ports_i, ports_o, ports_l, ports_r)::INTEGER AS max_face
FROM face_counts c JOIN flags USING (tile) ORDER BY score DESC, ports DESC, groups DESC, max_face DESC, i, j LIMIT 32"""),
    ),
    "f17_f21_signatures": Query(
        f17_f21_signatures,
        _tile_sql(SMALL, """SELECT t.i, t.j, coalesce(s.groups, 0)::INTEGER AS groups, coalesce(s.signature, '') AS signature FROM tiles t LEFT JOIN (
  SELECT tile, count(*) AS groups, string_agg(told, '/' ORDER BY told) AS signature FROM (
    SELECT v.tile, v.label, coalesce(string_agg('p' || p.pos || ';', '' ORDER BY p.pos), '') || CASE WHEN v.reach & 1 > 0 THEN 'I;' ELSE '' END || CASE WHEN v.reach & 2 > 0 THEN 'O;' ELSE '' END AS told
    FROM visible v LEFT JOIN ports p ON p.tile = v.tile AND p.label = v.label GROUP BY v.tile, v.label, v.reach) WHERE told <> '' GROUP BY tile) s ON s.tile = t.i * 1000 + t.j"""),
    ),
    "two_level_components": Query(two_level_components, _with(SMALL, "SELECT 'spanning' AS class, count(*) AS components FROM comps WHERE reach = 3 HAVING count(*) > 0", True)),
    "j14_layer_differences": Query(j14_layer_differences, _differences_sql()),
    "j14_first_differences": Query(j14_first_differences, f"SELECT i, j, min_by(layer, list_position(['primes', 'bands', 'labels', 'record'], layer)) AS layer FROM ({_differences_sql()}) GROUP BY 1, 2"),
    "g6_span_event": Query(g6_span_event),
    "g7_g9_span_path": Query(g7_g9_span_path),
    "g10_path_check": Query(g10_path_check, _with(SMALL, "SELECT 1").replace("\nSELECT 1", _PATH_CHECKS)),
    "g9_shortest_path": Query(g9_shortest_path, _with(Annulus(10, 40, 120, 16), "SELECT 1").replace("\nSELECT 1", _SHORTEST)),
    "g5_largest_touching": Query(g5_largest_touching, _with(SMALL, "SELECT component, size FROM comps WHERE reach > 0 ORDER BY size DESC, component LIMIT 8", True)),
}
