import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeflow.functions import bands, integers
from latticeflow.functions import primes as P
from latticeflow.operators import edges, stitch, trace
from latticeflow.operators import tiles as T
from latticeflow.operators.components import components, roots
from latticeflow.params import Annulus, palette
from latticeflow.plans import flat, two_level
from latticeflow.sources import lattice
from latticeflow.sources import tiles as G

#: (k, r_inner, r_outer): primes, edges, components, inner, outer, verdict
ANCHORS = {
    (36, 100, 500): (10424, 64262, 1, 62, 253, "SPANNING"),
    (10, 100, 500): (10424, 21668, 89, 34, 133, "SPANNING"),
    (8, 500, 1500): (72047, 66362, 18974, 111, 277, "MOAT"),
    (10, 1000, 2000): (102395, 169113, 5126, 248, 405, "MOAT"),
    (4, 100, 500): (10424, 7658, 3815, 21, 86, "MOAT"),
    (1, 10, 100): (609, 0, 609, 4, 9, "MOAT"),
}
#: tiles, ports, most ports and groups of a tile
TILED = {(36, 100, 500): (4, 11, 4, 1), (10, 100, 500): (4, 119, 65, 29), (8, 500, 1500): (21, 2504, 215, 202), (10, 1000, 2000): (29, 2342, 149, 105)}


@pytest.mark.parametrize("key", list(ANCHORS))
def test_flat_plan(spark, key):
    r = flat.solve(spark, Annulus(*key)).summary().first()
    assert (r.primes, r.edges, r.components, r.inner_primes, r.outer_primes, r.verdict) == ANCHORS[key]


@pytest.mark.parametrize("key", list(TILED))
def test_two_level_plan(spark, key):
    g = two_level.solve(spark, Annulus(*key))
    ports = T.ports(g.summaries).groupBy("i", "j").count().agg(F.sum("count"), F.max("count")).first()
    assert (g.grid.count(), *ports, g.summaries.agg(F.max("groups")).first()[0]) == TILED[key]
    assert g.verdict().first().verdict == ANCHORS[key][-1]
    assert stitch.mismatches(g.summaries).count() == 0


@pytest.mark.parametrize("k, side", [(2, 16), (8, 16), (10, 32), (5, 16)])
def test_plans_agree_on_small_tiles(spark, k, side):
    q = Annulus(k, 60, 200, side)
    assert flat.solve(spark, q).verdict().first() == two_level.solve(spark, q).verdict().first()


def test_capacities_turn_overflow_into_a_span(spark):
    g = two_level.solve(spark, Annulus(8, 500, 1500), caps=True)
    assert g.verdict().first().verdict == "SPANNING"
    assert g.summaries.where("tile_flags = 2").count() > 0


def test_known_tile_records(spark):
    rows = {(r.i, r.j): r for r in two_level.solve(spark, Annulus(36, 100, 500)).summaries.collect()}
    want = {(0, 0): ([0, 1, 1, 1], [1], [], 3655), (0, 1): ([1, 0, 2, 1], [], [1], 6367), (1, 0): ([0, 1, 1, 0], [], [], 10), (1, 1): ([1, 0, 1, 0], [], [1], 1011)}
    assert {t: (r.n, r.inner, r.outer, r.primes) for t, r in rows.items()} == want


def test_parameters_are_checked():
    for bad in ((0, 10, 20), (8, 4, 20), (8, 20, 20), (8, 20, 4_000_000_000), (100, 30, 300, 16)):
        with pytest.raises(ValueError):
            Annulus(*bad)
    with pytest.raises(ValueError):
        Annulus(36, 100, 200).strict()
    assert [Annulus(k, 100, 900).collar for k in (34, 36, 38, 40)] == [5, 6, 6, 6]
    assert [len(palette(k)) for k in (34, 36, 38, 40)] == [54, 56, 60, 64]


def test_bands_and_small_primes():
    e = bands.band_edges(Annulus(36, 100, 500))
    assert e == {"inner_lo": 10000, "inner_hi": 11236, "outer_lo": 244036, "outer_hi": 250000}
    a, b = np.array([0, 0, 1, 2, 0, 3, 1]), np.array([3, 7, 2, 3, 5, 3, 1])
    assert P.gaussian_mask(a, b).tolist() == [True, True, True, True, False, False, True]


def test_primality_against_a_sieve():
    n = np.arange(200_000)
    assert np.flatnonzero(P.is_prime(n)).tolist() == P.primes_to(199_999).tolist()
    assert not P.is_prime(np.array([3_215_031_751, 341_550_071_728_321, 1_122_004_669_633, (10**9 + 7) * (10**9 + 9), 561, 1105])).any()
    assert P.is_prime(np.array([2**61 - 1, 10**12 + 39, 4_759_123_151, 999_999_999_989])).all()


@pytest.mark.parametrize("r", [500, 20_000, 3_000_000, 900_000_000])
def test_points_equal_trial_by_norm(r):
    rng = np.random.default_rng(r)
    a = rng.integers(1, r // 2, 400)
    b = a + rng.integers(0, r // 2, 400)
    assert (P.gaussian_mask(a, b) == P.is_prime(a * a + b * b)).all()


def test_roots_are_exact(spark):
    from math import isqrt

    values = [0, 1, 2, 3, 4, 2**52 - 1, 2**52, (2**31) ** 2 - 1, (2**31) ** 2, 3_037_000_499**2 - 1, 3_037_000_499**2, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", integers.floor_isqrt(F.col("n")).alias("f"), integers.ceil_isqrt(F.col("n")).alias("c")).collect()
    assert all(r.f == isqrt(r.n) and (r.c == (isqrt(r.n - 1) + 1 if r.n else 0)) for r in rows)


def test_edge_joins_agree(spark):
    for k in (1, 2, 5, 10, 36):
        v = lattice.points(spark, Annulus(k, 10, 30, 16))
        x = edges.near(v, k)
        assert x.exceptAll(edges.by_offsets(v, k)).count() == 0 and x.count() == edges.by_offsets(v, k).count() == x.distinct().count()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_local_roots(pairs):
    a, b = (np.array(c) for c in zip(*pairs))
    nodes, least = roots(a, b)
    want = {x: x for p in pairs for x in p}
    for _ in want:
        for x, y in pairs:
            want[x] = want[y] = min(want[x], want[y])
    assert dict(zip(nodes.tolist(), least.tolist())) == {x: y for x, y in want.items() if x != y}


def test_components_in_rounds_and_at_once(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5000, 5000 + i) for i in range(1, 200)]
    pairs = [*chain, *((int(x), int(y)) for x, y in rng.integers(10_000, 10_400, (300, 2)))]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long").repartition(7)
    small = {r.node: r.component for r in components(df).collect()}
    large = {r.node: r.component for r in components(df, small=0).collect()}
    a, b = (np.array(c) for c in zip(*pairs))
    nodes, least = roots(a, b)
    assert small == large == dict(zip(nodes.tolist(), least.tolist()))
    assert components(df.limit(0)).count() == components(df.limit(0), small=0).count() == 0


def test_grid_equals_its_definition(spark):
    for q in (Annulus(2, 50, 120, 16), Annulus(8, 60, 300, 32), Annulus(10, 200, 260, 16)):
        pts = lattice.points(spark, q).select("a", "b").collect()
        s = q.side
        want = {(i, j) for a, b in pts for i in {a // s, (a - 1) // s} for j in {b // s, (b - 1) // s} if i >= 0 and j >= 0 and i * s <= a <= i * s + s and j * s <= b <= j * s + s}
        cols = G.towers(spark, q)
        rows = G.tiles(cols, q)
        got = [(r.i, r.j) for r in rows.orderBy("idx").collect()]
        assert set(got) == want and got == sorted(got)
        assert rows.where(~G.is_active(F.col("i"), F.col("j"), q)).count() == 0
        assert G.invariant_violations(cols).count() == 0
        back = G.tile_at(cols, rows.select("idx")).exceptAll(rows.select("idx", "i", "j"))
        assert back.count() == 0


def test_broken_grids_are_noticed(spark):
    cols = spark.createDataFrame([(0, 3, 5), (1, 3, 5), (3, 2, 5), (4, 6, 4), (5, 0, 2)], "i long, j_low long, j_high long")
    assert {(r.i, r.rule) for r in G.invariant_violations(cols).collect()} >= {(3, "gap"), (4, "empty"), (5, "shift")}


def test_span_path_and_events(spark):
    q = Annulus(10, 40, 120, 16)
    path = trace.span_path(spark, q)
    r = trace.check_path(path, q).first()
    assert r.ok and r.errors == ""
    g = two_level.solve(spark, q)
    one = trace.first_event(g).collect()
    again = trace.first_event(g, limit=0).collect()
    assert len(one) == 1 and (one[0].i, one[0].phase, one[0].j, one[0].ordinal) == (again[0].i, again[0].phase, again[0].j, again[0].ordinal)
    assert {one[0].before_a, one[0].before_b} == {1, 2}
    moat = Annulus(2, 40, 120, 16)
    assert trace.span_path(spark, moat).count() == 0 and trace.first_event(two_level.solve(spark, moat)).count() == 0


def test_paths_are_refused_for_reasons(spark):
    def errors(points, k=16, lo=3, hi=7):
        rows = [("c", n, a, b, k, lo, hi) for n, (a, b) in enumerate(points)]
        return trace.check_points(spark.createDataFrame(rows, "claim_id string, pos long, a long, b long, k_sq long, r_inner long, r_outer long")).first()

    assert errors([(0, 3), (0, 7)]).ok
    assert "path has fewer than two points" in errors([(0, 3)]).errors
    assert "point is not a Gaussian prime" in errors([(0, 3), (0, 5), (0, 7)]).errors
    assert "step is zero or too long" in errors([(0, 3), (0, 7)], k=9).errors
    assert "point outside the octant" in errors([(3, 0), (0, 7)], k=64).errors
    assert "point outside the annulus" in errors([(0, 3), (0, 11)], k=64).errors


def test_stitch_paths(spark):
    names = "claim_id string, pos long, i long, j long, label int, face string, ordinal int, i2 long, j2 long, label2 int, face2 string, ordinal2 int, event string"
    good = [("x", 0, 0, 0, 1, "O", 1, 0, 1, 2, "I", 1, "match_io"), ("x", 1, 0, 1, 2, "R", 3, 1, 1, 1, "L", 3, "match_lr")]
    bad = [("y", 0, 0, 0, 1, "O", 1, 0, 1, 2, "I", 2, "match_io"), ("y", 1, 0, 1, 9, "R", 3, 1, 2, 1, "L", 3, "match_lr")]
    got = {r.claim_id: r.errors for r in trace.check_stitch_path(spark.createDataFrame(good + bad, names)).collect()}
    assert got == {"x": [], "y": ["steps do not follow each other", "ordinals differ", "faces do not fit the event"]}


def test_scan_plan_is_one_narrow_stage(spark):
    plan = lattice.primes(spark, Annulus(36, 100, 500))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
