"""Lattice operators over given tables: line items are sites, and the primes among them the graph.

A line item's site is a = 5 l_linenumber + l_quantity mod 5, b = 100 + l_orderkey div 4; the annulus ends behind the
last order, so the graph grows with the table.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import bands, integers
from latticeflow.functions import primes as P
from latticeflow.functions.records import packed, unpacked
from latticeflow.lineage import cut
from latticeflow.operators import aggregates, edges, sampling, stitch, trace
from latticeflow.operators import tiles as T
from latticeflow.operators import verdict as V
from latticeflow.params import Annulus
from latticeflow.plans import flat, two_level
from latticeflow.queries import Query, table
from latticeflow.queries.lattice import _COMPONENTS_SQL, _ZONES_SQL, LAYERS_SQL, RECORDS_SQL, SMALL, VERDICT, _tile_bodies
from latticeflow.queries.lattice import _with as _lattice_with
from latticeflow.sources import lattice, regions, sinks
from latticeflow.sources import tiles as G
from latticeflow.streaming.columns import batches_of_columns

K, INNER, SIDE, COLLAR = 40, 100, 32, 6


def annulus(spark, sf, k=K) -> Annulus:
    last = table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return Annulus(k, INNER, last // 4 + 101, SIDE)


def sites(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_linenumber") * 5 + F.col("l_quantity").cast("long") % 5).cast("long").alias("a"), (F.call_function("div", F.col("l_orderkey").cast("long"), F.lit(4).cast("long")) + 100).alias("b")).distinct()


_SITES = f"""prime_numbers AS MATERIALIZED (
  SELECT n FROM range(2, 40001) t(n) EXCEPT SELECT p * k FROM range(2, 201) s(p), range(2, 20001) r(k) WHERE k >= p AND p * k <= 40000
), q AS MATERIALIZED (SELECT ({INNER} * {INNER})::HUGEINT AS lo, ((max(l_orderkey) // 4 + 101) * (max(l_orderkey) // 4 + 101))::HUGEINT AS hi FROM lineitem
), sites AS MATERIALIZED (
  SELECT DISTINCT (l_linenumber * 5 + l_quantity::BIGINT % 5)::BIGINT AS a, l_orderkey // 4 + 100 AS b FROM lineitem
), primes AS MATERIALIZED (
  SELECT a, b, a * a + b * b AS norm FROM (SELECT a, b FROM sites, q WHERE b >= a AND a * a + b * b BETWEEN lo AND hi) s
  ANTI JOIN prime_numbers p ON p.n * p.n <= s.a * s.a + s.b * s.b AND (s.a * s.a + s.b * s.b) % p.n = 0
), vertices AS MATERIALIZED (
  SELECT p.*, (a << 32) | b AS id, CASE WHEN norm >= lo AND (norm - lo - :k) * (norm - lo - :k) <= 4 * lo * :k THEN 1 ELSE 0 END
    + CASE WHEN norm <= hi AND (norm - hi - :k) * (norm - hi - :k) <= 4 * hi * :k THEN 2 ELSE 0 END AS reach
  FROM primes p, q
), offsets AS (
  SELECT da, db FROM range(-6, 7) x(da), range(-6, 7) y(db) WHERE da * da + db * db BETWEEN 1 AND :k AND (da > 0 OR (da = 0 AND db > 0))
), edges AS MATERIALIZED (
  SELECT v.a AS a1, v.b AS b1, w.a AS a2, w.b AS b2, v.id AS id1, w.id AS id2
  FROM (SELECT a, b, id, a + da AS xa, b + db AS xb FROM vertices, offsets) v JOIN vertices w ON w.a = v.xa AND w.b = v.xb
)"""


def _with(body: str, components: bool = False, k: int = K) -> str:
    return f"WITH RECURSIVE {_SITES.replace(':k', str(k))}{',' + _COMPONENTS_SQL if components else ''}\n{body}"


def _tiled(body: str, k: int = K) -> str:
    """Tile summaries by the definition, for the tiles that the primes lie in or near."""
    s, c = SIDE, COLLAR
    tiles = f"""tiles AS MATERIALIZED (
  SELECT DISTINCT i, j FROM vertices v, range(0, 3) x(i), LATERAL (SELECT unnest(range(greatest(0, (v.b - {s + c}) // {s}), (v.b + {c}) // {s} + 1)) AS j) y
  WHERE v.a BETWEEN i * {s} - {c} AND i * {s} + {s + c} AND v.b BETWEEN j * {s} - {c} AND j * {s} + {s + c}
)"""
    return f"WITH RECURSIVE {_SITES.replace(':k', str(k))}, {tiles},\n{_tile_bodies(s, c)}\n{body}"


def vertices(spark, sf, k=K) -> DataFrame:
    return flat.vertices(spark, annulus(spark, sf, k), sites(spark, sf))


def solved(spark, sf, k=K) -> flat.FlatGraph:
    return flat.solve(spark, annulus(spark, sf, k), sites(spark, sf))


def summaries(spark, sf, caps=False) -> DataFrame:
    return T.summaries_of(vertices(spark, sf), annulus(spark, sf), caps)


# points


def s1_annulus_primes(spark, sf):
    """All primes of an annulus that is as wide as the table is long."""
    n = table(spark, sf, "supplier").count()
    return lattice.primes(spark, Annulus(36, 100, 150 + n))


def p1_p2_annulus_points(spark, sf):
    q = annulus(spark, sf)
    pts = sites(spark, sf).select((F.col("a") - 7).alias("a"), (F.col("b") - 90).alias("b"))
    norm = integers.norm_sq(F.col("a"), F.col("b"))
    return pts.where(bands.in_octant(F.col("a"), F.col("b")) & bands.in_annulus(norm, q)).select("a", "b", norm.alias("norm"))


def p3_rational_primes(spark, sf):
    n = table(spark, sf, "orders").select((F.col("o_orderkey") * 6 + 1).alias("n"))
    return n.where(~P.divides_small(F.col("n"))).where(P.prime(F.col("n")))


def p4_gaussian_points(spark, sf):
    return sites(spark, sf).where(P.gaussian_prime(F.col("a"), F.col("b")))


def p5_gaussian_norms(spark, sf):
    n = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n")).where("n > 1")
    return n.where(P.gaussian_norm(F.col("n")))


def p6_bands(spark, sf):
    return vertices(spark, sf).where("reach > 0").select("a", "b", "norm", "reach")


def p6_wide_integers(spark, sf):
    """The band test far above 2**32, where squares pass 64 bits, around the inner circle."""
    q = Annulus(40, 1_000_000_000, 1_000_000_500)
    eps = F.col("o_orderkey") - 1000
    norm = F.lit(q.inner_sq) + eps * 20_000_000
    return table(spark, sf, "orders").select(eps.alias("step"), norm.alias("norm"), bands.inner_band(norm, q).alias("inner"))


def f2_integer_roots(spark, sf):
    big = 3_037_000_499
    k = F.col("c_custkey")
    n = table(spark, sf, "customer").select(F.explode(F.array(k, k * k * 1_000_003, F.lit(big * big) - k, (F.lit(big) - k) * (F.lit(big) - k))).alias("n")).distinct()
    return n.select("n", integers.floor_isqrt(F.col("n")).alias("floor_root"), integers.ceil_isqrt(F.col("n")).alias("ceil_root"))


def f5_f8_f12_packing(spark, sf):
    x = F.col("p_partkey").cast("long")
    n = table(spark, sf, "part").select((x - 1500).alias("x"), x.alias("id"))
    row, col = integers.unpacked_position(F.col("id").cast("int"), 269)
    return n.select("x", integers.euclidean_mod(F.col("x"), 97).alias("rest"), row.cast("long").alias("row"), col.cast("long").alias("col"), integers.packed_position(row, col, 269).cast("long").alias("pos"), integers.pair_key(F.col("id"), F.pmod(F.col("id") * 7919, F.lit(4_294_967_296))).alias("key"))


def f7_face_coordinates(spark, sf):
    i, j = F.floor(F.col("a") / SIDE), F.floor(F.col("b") / SIDE)
    faces = F.explode(F.array(*[F.lit(f) for f in "IOLR"])).alias("face")
    h, perp = integers.face_coordinates(F.col("face"), F.col("a"), F.col("b"), i * SIDE, j * SIDE, SIDE)
    return vertices(spark, sf).select("a", "b", faces).select("a", "b", "face", h.alias("h"), perp.alias("perp")).where(F.abs("perp") <= COLLAR)


# edges and components


def j2_neighbour_edges(spark, sf):
    return edges.near(vertices(spark, sf), K)


def j2_palette_edges(spark, sf):
    return edges.by_offsets(vertices(spark, sf), K, odd_sums=True)


def j4_strip_edges(spark, sf):
    v = vertices(spark, sf).withColumn("perp", F.pmod(F.col("b"), F.lit(SIDE)))
    return edges.within_strip(edges.near(v, K, ("perp",)), "perp1", "perp2", COLLAR).select("a1", "b1", "a2", "b2")


def j9_bridges(spark, sf):
    """First edge between vertices of different residue classes of the norm."""
    v = vertices(spark, sf).withColumn("label", F.pmod(F.col("norm"), F.lit(5)))
    return edges.bridges(edges.near(v, K, ("label",)), "label1", "label2")


def g1_components(spark, sf):
    return solved(spark, sf).vertices.select("a", "b", "component")


def g2_reach(spark, sf):
    return solved(spark, sf).components().select("component", "size", F.col("reach").cast("long").alias("reach"))


STEPS = (8, 20, 40)


def _verdicts(spark, sf, solve) -> DataFrame:
    """The primes are the same for every step bound and found once."""
    q = annulus(spark, sf)
    primes = cut(flat.among(sites(spark, sf), q))
    rows = [solve(spark, replace(q, k=k), points=primes, known=True).verdict().select(F.lit(k).cast("long").alias("k"), "verdict") for k in STEPS]
    return reduce(DataFrame.union, rows)


def g3_verdicts(spark, sf):
    return _verdicts(spark, sf, flat.solve)


def g3_two_level_verdicts(spark, sf):
    return _verdicts(spark, sf, two_level.solve)


def g4_summary(spark, sf):
    return solved(spark, sf).summary().select(*[F.col(c).cast("long").alias(c) for c in ("primes", "components", "largest", "spanning_components", "inner_primes", "outer_primes", "edges")], "verdict")


def g5_census(spark, sf):
    return V.census(solved(spark, sf).components())


def g5_largest(spark, sf):
    return V.largest(solved(spark, sf).components()).select("component", "size")


def g5_largest_touching(spark, sf):
    return V.largest(solved(spark, sf).components(), touching=True).select("component", "size")


def u2_crosscheck(spark, sf):
    """Components that both of two parts of the table reach, as a set intersection: sites of open and of other lines."""
    g = solved(spark, sf)
    side = g.vertices.withColumn("reach", F.when(F.col("a") < 20, 1).otherwise(2))
    return V.crosscheck(side)


def g9_shortest_path(spark, sf):
    """Points of a path with fewest steps between the sites of least and of largest a, in the largest component."""
    g = solved(spark, sf)
    top = V.largest(g.components(), 1).select("component")
    v = cut(g.vertices.join(F.broadcast(top), "component"))
    ends = v.agg(F.min("a").alias("lo"), F.max("a").alias("hi")).first()
    path = trace.shortest_path(g.edges, v.where(F.col("a") == ends.lo).select("id"), v.where(F.col("a") == ends.hi).select("id"))
    return path.join(v, "id").agg(F.count(F.lit(1)).alias("points"), F.sum(F.when(F.col("pos") == 0, F.col("a"))).alias("from_a"), F.max(F.struct("pos", "a"))["a"].alias("to_a"))


# tiles


def s2_halo_counts(spark, sf):
    return summaries(spark, sf).select("i", "j", F.col("primes").cast("long").alias("primes"))


def a3_face_ports(spark, sf):
    return aggregates.face_counts(T.ports(summaries(spark, sf)))


def j5_j6_stitches(spark, sf):
    return stitch.stitch_edges(T.ports(cut(summaries(spark, sf)))).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def a6_run_totals(spark, sf):
    return aggregates.run_totals(summaries(spark, sf))


def _score():
    return T.pressure(F.col("n"), F.col("face_groups"), F.col("tile_flags"), F.col("inner"), F.col("outer"))


def t3_high_pressure(spark, sf):
    n = F.aggregate("n", F.lit(0), lambda a, x: a + x)
    return sampling.high_pressure(summaries(spark, sf).select("i", "j", _score().alias("score"), n.alias("ports"), "groups", F.array_max("n").alias("max_face")))


def f16_pressure(spark, sf):
    """Totals of the tiles' pressure scores by number of groups."""
    return summaries(spark, sf).groupBy(F.col("groups").cast("long").alias("groups")).agg(F.sum(_score()).cast("long").alias("score"), F.count(F.lit(1)).alias("tiles"))


def f17_f21_signatures(spark, sf):
    return summaries(spark, sf).select("i", "j", T.group_count(F.col("face_groups"), F.col("inner"), F.col("outer")).alias("groups"), F.array_join(T.signature(F.col("face_groups"), F.col("inner"), F.col("outer")), "/").alias("signature"))


def f11_records(spark, sf):
    """Tile records packed into bytes and read back, as texts of their parts."""
    rows = summaries(spark, sf, caps=True)
    back = rows.select("i", "j", unpacked(packed(F.col("n"), F.col("face_groups"), F.col("inner"), F.col("outer"), F.col("tile_flags"))).alias("t"))
    dots = lambda c: F.array_join(F.col(f"t.{c}"), ".").alias(c)
    return back.select("i", "j", *[dots(c) for c in ("n", "face_groups", "inner", "outer")], F.col("t.tile_flags").cast("long").alias("tile_flags"))


def k11_golden(spark, sf):
    """Digests of the tiles' records in order, by two columns."""
    return sinks.golden(summaries(spark, sf), batch=2)


def k11_layers(spark, sf):
    """Digests of each layer of the tiles' answers, by two columns."""
    return sinks.golden_layers(T.layers_of(vertices(spark, sf), annulus(spark, sf)), batch=2)


def two_level_components(spark, sf):
    """Components of visible groups that reach a band: what the two-level plan sees of the flat graph."""
    return two_level.solve(spark, annulus(spark, sf), points=sites(spark, sf)).components().groupBy("reach").agg(F.count(F.lit(1)).alias("components")).where("reach > 0").select(F.col("reach").cast("long").alias("reach"), "components")


# grids


def towers(spark, sf) -> DataFrame:
    """A tower of tiles per supplier: the line numbers and quantities that its line items span."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_linenumber").cast("long").alias("j_low"), (F.max("l_quantity").cast("long") + F.min("l_linenumber")).alias("j_high"))
    return li.select(F.col("l_suppkey").cast("long").alias("i"), "j_low", "j_high")


_TOWERS = """WITH towers AS (SELECT *, (coalesce(sum(j_high - j_low + 1) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS tower_offset FROM (
  SELECT l_suppkey AS i, min(l_linenumber)::BIGINT AS j_low, max(l_quantity)::BIGINT + min(l_linenumber)::BIGINT AS j_high FROM lineitem GROUP BY 1)
), placed AS (SELECT i, j_low + k AS j, tower_offset + k AS idx FROM towers, LATERAL (SELECT unnest(range(0, j_high - j_low + 1)) AS k))
"""
_GRID = Annulus(10, 1000, 2000)


def w1_tower_offsets(spark, sf):
    return G.with_offsets(towers(spark, sf))


def s3_tiles(spark, sf):
    return G.tiles(G.with_offsets(towers(spark, sf)), _GRID).select("i", "j", "idx")


def s5_first_tiles(spark, sf):
    return G.first_tiles(s3_tiles(spark, sf), 10).select("i", "j")


def t7_every_third_tile(spark, sf):
    return G.selected(s3_tiles(spark, sf), every=3, start=2)


def f9_tile_places(spark, sf):
    """The tile of each order's number in column order."""
    return G.tile_at(cut(G.with_offsets(towers(spark, sf))), table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx")))


def p14_region_clip(spark, sf):
    """Towers within boxes that parts ask for, one per supplier's number."""
    boxes = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("i"), (F.col("p_size") % 7).cast("long").alias("j_lo"), (F.col("p_size") % 30).cast("long").alias("j_hi"))
    return regions.clipped(towers(spark, sf), boxes)


def s14_towers_of_tiles(spark, sf):
    """Runs of line numbers and quantities per order, as towers."""
    return G.towers_of(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_linenumber") + F.col("l_quantity").cast("long") % 3).cast("long").alias("j")))


def w6_grid_invariants(spark, sf):
    return G.invariant_violations(towers(spark, sf).where("i % 7 <> 3").withColumn("j_high", F.when(F.col("i") % 5 == 0, F.col("j_low") - 1).otherwise(F.col("j_high"))), block=3)


def p9_active_tiles(spark, sf):
    """Tiles that line items name: which of them the annulus 40..120 reaches."""
    q = Annulus(8, 40, 120, 16)
    pairs = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_quantity").cast("long") % 9).alias("j"))
    return pairs.withColumn("active", G.is_active(F.col("i"), F.col("j"), q)).groupBy("i", "j", "active").agg(F.count(F.lit(1)).alias("lines"))


def p12_bad_zones(spark, sf):
    """The rounding zones of three annuli per supplier."""
    return bands.bad_zones(_annuli(spark, sf))


def _annuli(spark, sf):
    n = F.col("s_suppkey").cast("long")
    return table(spark, sf, "supplier").select(F.explode(F.array(*[F.lit(k).cast("long") for k in (8, 10, 36)])).alias("k"), (n + 49).alias("r_inner"), (n + 449).alias("r_outer"))


def p6_band_edges(spark, sf):
    return bands.band_edges_of(_annuli(spark, sf))


def u1_tube_primes(spark, sf):
    """The primes of the widened squares of the tiles that line items name, each once."""
    named = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_quantity").cast("long") % 9).alias("j")).where("i < 4 AND (i + j) % 3 <> 1").distinct()
    return trace.tube_primes(spark, named, SMALL)


def j14_layer_differences(spark, sf):
    """Layers in which the tiles of the sites' primes differ between two step bounds."""
    layers = lambda k: T.layers_of(vertices(spark, sf, k), annulus(spark, sf, k))
    return T.layer_differences(layers(40), layers(36))


def j14_first_differences(spark, sf):
    return T.first_differing_layers(j14_layer_differences(spark, sf))


def st7_batches(spark, sf):
    return batches_of_columns(w1_tower_offsets(spark, sf), 200)


_SPOILT = """, g AS (SELECT i, j_low AS lo, CASE WHEN i % 5 = 0 THEN j_low - 1 ELSE j_high END AS hi FROM towers WHERE i % 7 <> 3),
b AS (SELECT *, lag(i) OVER w AS pi, lag(lo) OVER w AS pl, lag(hi) OVER w AS ph FROM g WINDOW w AS (ORDER BY i))
SELECT i, unnest(list_filter([CASE WHEN i <> pi + 1 THEN 'gap' END, CASE WHEN hi < lo THEN 'empty' END, CASE WHEN abs(lo - pl) > 1 OR hi > ph OR ph - hi > i + 2 THEN 'shift' END, CASE WHEN lo > ph OR hi < pl THEN 'orphan' END], lambda x: x IS NOT NULL)) AS rule FROM b"""
#: Fewest steps from the sites of least to those of largest a in the largest component.
_SHORTEST = """, top AS MATERIALIZED (SELECT component FROM comps ORDER BY size DESC, component LIMIT 1),
own AS MATERIALIZED (SELECT v.* FROM vertices v JOIN labelled l USING (id) JOIN top t ON t.component = l.component),
walked(id, far) USING KEY (id) AS (
  SELECT id, 0 FROM own WHERE a = (SELECT min(a) FROM own)
  UNION
  SELECT e.y, min(w.far) + 1 FROM walked w JOIN linked e ON e.x = w.id LEFT JOIN recurring.walked r ON r.id = e.y WHERE r.id IS NULL GROUP BY e.y
)
SELECT (SELECT min(far) + 1 FROM walked JOIN own USING (id) WHERE a = (SELECT max(a) FROM own))::BIGINT AS points, (SELECT min(a) FROM own) AS from_a, (SELECT max(a) FROM own) AS to_a"""
_OVER_TILES = "tiles t LEFT JOIN flags f ON f.tile = t.i * 1000 + t.j LEFT JOIN face_counts c ON c.tile = t.i * 1000 + t.j"
_NAIVE_ROOTS = """WITH ns AS (SELECT DISTINCT unnest([c_custkey, c_custkey * c_custkey * 1000003, 3037000499::BIGINT * 3037000499 - c_custkey, (3037000499 - c_custkey) * (3037000499 - c_custkey)]) AS n FROM customer),
rooted AS (SELECT n, (floor(sqrt(n::DOUBLE)))::HUGEINT AS r FROM ns),
exact AS (SELECT n, CASE WHEN (r + 1) * (r + 1) <= n THEN r + 1 WHEN r * r > n THEN r - 1 ELSE r END AS f FROM rooted)
SELECT n, f::BIGINT AS floor_root, (CASE WHEN f * f = n THEN f ELSE f + 1 END)::BIGINT AS ceil_root FROM exact"""
_SMALL_PRIMES = "WITH pn AS MATERIALIZED (SELECT n FROM range(2, 3001) t(n) EXCEPT SELECT p * k FROM range(2, 55) s(p), range(2, 1501) r(k) WHERE k >= p AND p * k <= 3000)"

_DIFFERENCES = f"""SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, coalesce(x.layer, y.layer) AS layer, x.digest AS left_digest, y.digest AS right_digest
FROM ({_tiled(LAYERS_SQL, 40)}) x FULL JOIN ({_tiled(LAYERS_SQL, 36)}) y ON x.i = y.i AND x.j = y.j AND x.layer = y.layer WHERE x.digest IS DISTINCT FROM y.digest"""
_ANNULI = "q AS (SELECT k, s_suppkey::BIGINT + 49 AS r_inner, s_suppkey::BIGINT + 449 AS r_outer FROM supplier, (VALUES (8::BIGINT), (10), (36)) a(k))"

QUERIES: dict[str, Query] = {
    "p12_bad_zones": Query(p12_bad_zones, _ZONES_SQL.replace("q AS (SELECT k, r AS r_inner, r + 400 AS r_outer FROM (VALUES (8::BIGINT), (10), (36)) a(k), range(50, 250) b(r))", _ANNULI)),
    "p6_band_edges": Query(p6_band_edges, f"WITH {_ANNULI} SELECT *, r_inner * r_inner AS inner_lo, r_inner * r_inner + k + floor(sqrt(4 * r_inner * r_inner * k))::BIGINT AS inner_hi, r_outer * r_outer + k - floor(sqrt(4 * r_outer * r_outer * k))::BIGINT AS outer_lo, r_outer * r_outer AS outer_hi FROM q"),
    "u1_tube_primes": Query(u1_tube_primes, _lattice_with(SMALL, """SELECT DISTINCT a, b FROM primes JOIN (SELECT DISTINCT l_linenumber - 1 AS i, l_quantity::BIGINT % 9 AS j FROM lineitem) t ON a BETWEEN i * 16 - 2 AND i * 16 + 18 AND b BETWEEN j * 16 - 2 AND j * 16 + 18 WHERE i < 4 AND (i + j) % 3 <> 1""")),
    "j14_layer_differences": Query(j14_layer_differences, _DIFFERENCES),
    "j14_first_differences": Query(j14_first_differences, f"SELECT i, j, min_by(layer, list_position(['primes', 'bands', 'labels', 'record'], layer)) AS layer FROM ({_DIFFERENCES}) GROUP BY 1, 2"),
    "st7_batches": Query(st7_batches, _TOWERS + "SELECT i, (tower_offset // 200)::BIGINT AS batch, j_high - j_low + 1 AS height FROM towers"),
    "s1_annulus_primes": Query(s1_annulus_primes, f"""{_SMALL_PRIMES}, q AS (SELECT 150 + count(*) AS r FROM supplier), c AS (
  SELECT a, b, a * a + b * b AS norm FROM q, LATERAL (SELECT unnest(range(0, r + 1)) AS a), LATERAL (SELECT unnest(range(a, r + 1)) AS b) WHERE a * a + b * b BETWEEN 10000 AND r * r)
SELECT * FROM (SELECT * FROM c WHERE a > 0) s ANTI JOIN pn ON pn.n * pn.n <= s.norm AND s.norm % pn.n = 0 UNION ALL SELECT * FROM (SELECT * FROM c WHERE a = 0 AND b % 4 = 3) s ANTI JOIN pn ON pn.n * pn.n <= s.b AND s.b % pn.n = 0"""),
    "p1_p2_annulus_points": Query(p1_p2_annulus_points, _with("SELECT a, b, a * a + b * b AS norm FROM (SELECT a - 7 AS a, b - 90 AS b FROM sites), q WHERE a >= 0 AND b >= a AND a * a + b * b BETWEEN lo AND hi")),
    "p3_rational_primes": Query(p3_rational_primes, f"{_SMALL_PRIMES} SELECT n FROM (SELECT o_orderkey * 6 + 1 AS n FROM orders WHERE o_orderkey > 0) o ANTI JOIN pn ON pn.n * pn.n <= o.n AND o.n % pn.n = 0"),
    "p4_gaussian_points": Query(p4_gaussian_points, f"{_SMALL_PRIMES.replace('3001', '40001').replace('55', '201').replace('1501', '20001').replace('<= 3000', '<= 40000')} SELECT a, b FROM (SELECT DISTINCT (l_linenumber * 5 + l_quantity::BIGINT % 5)::BIGINT AS a, l_orderkey // 4 + 100 AS b FROM lineitem) s ANTI JOIN pn ON pn.n * pn.n <= s.a * s.a + s.b * s.b AND (s.a * s.a + s.b * s.b) % pn.n = 0"),
    "p5_gaussian_norms": Query(p5_gaussian_norms, f"{_SMALL_PRIMES}, o AS (SELECT o_orderkey AS n FROM orders WHERE o_orderkey > 1), w AS (SELECT n FROM o ANTI JOIN pn ON pn.n * pn.n <= o.n AND o.n % pn.n = 0) SELECT n FROM w WHERE n = 2 OR n % 4 = 1 UNION ALL SELECT n FROM o WHERE n IN (SELECT n * n FROM pn WHERE n % 4 = 3)"),
    "p6_bands": Query(p6_bands, _with("SELECT a, b, norm, reach FROM vertices WHERE reach > 0")),
    "p6_wide_integers": Query(p6_wide_integers, "SELECT step, norm, norm >= 1000000000000000000 AND (norm - 1000000000000000040)::HUGEINT * (norm - 1000000000000000040)::HUGEINT <= 160000000000000000000::HUGEINT AS inner FROM (SELECT o_orderkey - 1000 AS step, 1000000000000000000 + (o_orderkey - 1000) * 20000000 AS norm FROM orders)"),
    "f2_integer_roots": Query(f2_integer_roots, _NAIVE_ROOTS),
    "f5_f8_f12_packing": Query(f5_f8_f12_packing, 'SELECT i - 1500 AS x, ((i - 1500) % 97 + 97) % 97 AS rest, i // 269 AS "row", i % 269 AS col, i AS pos, (i << 32) | ((i * 7919) % 4294967296) AS key FROM (SELECT p_partkey::BIGINT AS i FROM part)'),
    "f7_face_coordinates": Query(f7_face_coordinates, _with(f"""SELECT * FROM (
  SELECT a, b, face, CASE WHEN face IN ('I', 'O') THEN a % {SIDE} ELSE b % {SIDE} END AS h, CASE WHEN face IN ('I', 'O') THEN b % {SIDE} ELSE a % {SIDE} END - CASE WHEN face IN ('O', 'R') THEN {SIDE} ELSE 0 END AS perp
  FROM primes, (VALUES ('I'), ('O'), ('L'), ('R')) f(face)) WHERE abs(perp) <= {COLLAR}""")),
    "j2_neighbour_edges": Query(j2_neighbour_edges, _with("SELECT a1, b1, a2, b2 FROM edges")),
    "j2_palette_edges": Query(j2_palette_edges, _with("SELECT a1, b1, a2, b2 FROM edges")),
    "j4_strip_edges": Query(j4_strip_edges, _with(f"SELECT a1, b1, a2, b2 FROM edges WHERE b1 % {SIDE} <= {COLLAR} AND b2 % {SIDE} <= {COLLAR}")),
    "j9_bridges": Query(j9_bridges, _with("""SELECT label1, label2, a1, b1, a2, b2 FROM (
  SELECT *, least(x, y) AS label1, greatest(x, y) AS label2, row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY a1, b1, a2, b2) AS place
  FROM (SELECT *, (a1 * a1 + b1 * b1) % 5 AS x, (a2 * a2 + b2 * b2) % 5 AS y FROM edges) WHERE x <> y) WHERE place = 1""")),
    "g1_components": Query(g1_components, _with("SELECT v.a, v.b, l.component FROM vertices v JOIN labelled l USING (id)", True)),
    "g2_reach": Query(g2_reach, _with("SELECT component, size, reach::BIGINT AS reach FROM comps", True)),
    "g3_verdicts": Query(g3_verdicts, " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, v.verdict FROM ({_with(VERDICT, True, k)}) v" for k in STEPS)),
    "g3_two_level_verdicts": Query(g3_two_level_verdicts, " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, v.verdict FROM ({_with(VERDICT, True, k)}) v" for k in STEPS)),
    "g4_summary": Query(g4_summary, _with("""SELECT (SELECT count(*) FROM vertices) AS primes, (SELECT count(*) FROM comps) AS components, (SELECT max(size) FROM comps) AS largest, (SELECT count(*) FROM comps WHERE reach = 3) AS spanning_components,
  (SELECT count(*) FROM vertices WHERE reach & 1 <> 0) AS inner_primes, (SELECT count(*) FROM vertices WHERE reach & 2 <> 0) AS outer_primes, (SELECT count(*) FROM edges) AS edges,
  (SELECT CASE WHEN bool_or(reach = 3) THEN 'SPANNING' ELSE 'MOAT' END FROM comps) AS verdict""", True)),
    "g5_census": Query(g5_census, _with("SELECT CASE reach WHEN 0 THEN 'interior' WHEN 1 THEN 'inner_only' WHEN 2 THEN 'outer_only' ELSE 'spanning' END AS class, count(*) AS components, sum(size)::BIGINT AS vertices, max(size) AS largest FROM comps GROUP BY 1", True)),
    "g5_largest": Query(g5_largest, _with("SELECT component, size FROM comps ORDER BY size DESC, component LIMIT 8", True)),
    "g5_largest_touching": Query(g5_largest_touching, _with("SELECT component, size FROM comps WHERE reach > 0 ORDER BY size DESC, component LIMIT 8", True)),
    "u2_crosscheck": Query(u2_crosscheck, _with("SELECT l.component FROM labelled l JOIN vertices v USING (id) GROUP BY 1 HAVING min(v.a) < 20 AND max(v.a) >= 20", True)),
    "g9_shortest_path": Query(g9_shortest_path, _with("SELECT 1", True).replace("\nSELECT 1", _SHORTEST)),
    "s2_halo_counts": Query(s2_halo_counts, _tiled("SELECT i, j, count(*) AS primes FROM halo GROUP BY i, j")),
    "a3_face_ports": Query(a3_face_ports, _tiled("SELECT i, j, ports_i, ports_o, ports_l, ports_r, total FROM face_counts")),
    "j5_j6_stitches": Query(j5_j6_stitches, _tiled("SELECT CASE f WHEN 1 THEN 'match_io' ELSE 'match_lr' END AS event, count(*) AS n FROM ports WHERE (f = 1 AND tile + 1 IN (SELECT tile FROM halo)) OR (f = 3 AND tile + 1000 IN (SELECT tile FROM halo)) GROUP BY 1")),
    "a6_run_totals": Query(a6_run_totals, _tiled("""SELECT (SELECT count(*) FROM tiles) AS tiles, (SELECT count(*) FROM flags WHERE touches_inner) AS geo_i_tiles, (SELECT count(*) FROM flags WHERE touches_outer) AS geo_o_tiles,
  (SELECT sum(ports_i)::BIGINT FROM face_counts) AS geo_i_ports, (SELECT sum(ports_o)::BIGINT FROM face_counts) AS geo_o_ports, (SELECT count(*) FROM ports) AS ports, 0::BIGINT AS overflow_tiles, 0::BIGINT AS empty_tiles""")),
    "t3_high_pressure": Query(t3_high_pressure, _tiled("""SELECT c.i, c.j, (2 * total + inner_bytes + outer_bytes)::BIGINT AS score, total::INTEGER AS ports, groups::INTEGER AS groups, greatest(ports_i, ports_o, ports_l, ports_r)::INTEGER AS max_face
FROM face_counts c JOIN flags USING (tile) ORDER BY score DESC, ports DESC, groups DESC, max_face DESC, i, j LIMIT 32""")),
    "f16_pressure": Query(f16_pressure, _tiled(f"SELECT coalesce(f.groups, 0) AS groups, coalesce(sum(2 * coalesce(total, 0) + inner_bytes + outer_bytes), 0)::BIGINT AS score, count(*) AS tiles FROM {_OVER_TILES} GROUP BY 1")),
    "f17_f21_signatures": Query(f17_f21_signatures, _tiled("""SELECT t.i, t.j, coalesce(s.groups, 0)::INTEGER AS groups, coalesce(s.signature, '') AS signature FROM tiles t LEFT JOIN (
  SELECT tile, count(*) AS groups, string_agg(told, '/' ORDER BY told) AS signature FROM (
    SELECT v.tile, v.label, coalesce(string_agg('p' || p.pos || ';', '' ORDER BY p.pos), '') || CASE WHEN v.reach & 1 > 0 THEN 'I;' ELSE '' END || CASE WHEN v.reach & 2 > 0 THEN 'O;' ELSE '' END AS told
    FROM visible v LEFT JOIN ports p ON p.tile = v.tile AND p.label = v.label GROUP BY v.tile, v.label, v.reach) WHERE told <> '' GROUP BY tile) s ON s.tile = t.i * 1000 + t.j""")),
    "f11_records": Query(f11_records, _tiled(RECORDS_SQL)),
    "k11_golden": Query(k11_golden, _tiled(f"""SELECT i // 2 AS batch, count(*) AS "rows", sha256(sha256(string_agg(i || ',' || j || ',' || n || ',' || face_groups || ',' || "inner" || ',' || "outer" || ',' || tile_flags, chr(10) ORDER BY i, j))) AS digest FROM ({RECORDS_SQL}) GROUP BY 1""")),
    "k11_layers": Query(k11_layers, _tiled(f"""SELECT i // 2 AS batch, layer, count(*) AS "rows", sha256(sha256(string_agg(i || ',' || j || ',' || digest, chr(10) ORDER BY i, j))) AS digest FROM ({LAYERS_SQL}) GROUP BY 1, 2""")),
    "two_level_components": Query(two_level_components, _with("SELECT reach::BIGINT AS reach, count(*) AS components FROM comps WHERE reach > 0 GROUP BY 1", True)),
    "w1_tower_offsets": Query(w1_tower_offsets, _TOWERS + "SELECT i, j_low, j_high, tower_offset FROM towers"),
    "s3_tiles": Query(s3_tiles, _TOWERS + "SELECT i, j, idx FROM placed"),
    "s5_first_tiles": Query(s5_first_tiles, _TOWERS + "SELECT i, j FROM placed ORDER BY i, j LIMIT 10"),
    "t7_every_third_tile": Query(t7_every_third_tile, _TOWERS + "SELECT i, j, idx FROM placed WHERE idx >= 2 AND (idx - 2) % 3 = 0"),
    "f9_tile_places": Query(f9_tile_places, _TOWERS + "SELECT idx, i, j FROM placed JOIN orders ON o_orderkey = idx"),
    "p14_region_clip": Query(p14_region_clip, _TOWERS + "SELECT i, greatest(j_low, p_size % 7) AS j_low, least(j_high, p_size % 30) AS j_high FROM towers JOIN part ON p_partkey = i WHERE greatest(j_low, p_size % 7) <= least(j_high, p_size % 30)"),
    "s14_towers_of_tiles": Query(s14_towers_of_tiles, "WITH t AS (SELECT DISTINCT l_orderkey AS i, l_linenumber + l_quantity::BIGINT % 3 AS j FROM lineitem) SELECT i, min(j)::BIGINT AS j_low, max(j)::BIGINT AS j_high FROM (SELECT *, j - row_number() OVER (PARTITION BY i ORDER BY j) AS run FROM t) GROUP BY i, run"),
    "w6_grid_invariants": Query(w6_grid_invariants, _TOWERS + _SPOILT),
    "p9_active_tiles": Query(p9_active_tiles, """WITH pts AS MATERIALIZED (SELECT a, b FROM range(0, 85) x(a), range(0, 121) y(b) WHERE b >= a AND a * a + b * b BETWEEN 1600 AND 14400)
SELECT i, j, EXISTS (SELECT 1 FROM pts WHERE a BETWEEN i * 16 AND i * 16 + 16 AND b BETWEEN j * 16 AND j * 16 + 16) AS active, lines FROM (SELECT (l_linenumber - 1)::BIGINT AS i, l_quantity::BIGINT % 9 AS j, count(*) AS lines FROM lineitem GROUP BY 1, 2)"""),
}
