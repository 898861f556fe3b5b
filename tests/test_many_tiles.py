"""Tiles over given points are worked on many at a time, and the points are tested once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeflow.functions import primes as P
from latticeflow.operators import tiles as T
from latticeflow.params import Annulus
from latticeflow.plans import flat
from latticeflow.queries import sites
from latticeflow.sources import lattice
from latticeflow.sources import tiles as G

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("q", [Annulus(8, 40, 120, 16), Annulus(8, 100, 200, 32)])
@pytest.mark.parametrize("caps", [False, True])
def test_many_tiles_equal_one_by_one(spark, monkeypatch, q, caps):
    monkeypatch.setattr(T, "MAX_GROUPS", 12)
    monkeypatch.setattr(T, "MAX_PORTS", 9)
    want, rows = [], []
    for r in G.tiles(G.towers(spark, q), q).orderBy("i", "j").collect():
        a, b = T.halo_primes(r.a_lo, r.b_lo, q)
        if len(a):
            want.append(T.summarise(r.i, r.j, q, caps))
            rows += [(r.i, r.j, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert {w["tile_flags"] for w in want} == ({0, 2} if caps else {0})
    assert all(w["n"] == [0] * 4 and not any(w[c] for c in ("face_groups", "port_h", "inner", "outer", "groups")) for w in want if w["tile_flags"])
    whole = pa.table(dict(zip("ijab", np.array(rows).T, strict=True)))
    for size in (1, 7, 10**6):
        for most in (1, 3, 10**6):
            got = [T._summarised_tiles(*found, q, caps)[0] for found in T._whole_tiles(iter(whole.to_batches(size)), most)]
            assert [x for batch in got for x in batch.to_pylist()] == want
    assert list(T._whole_tiles(iter([]), 5)) == []


def test_tiles_of_points_use_all_cores(spark):
    df = T.summaries_of(sites.vertices(spark, SF), sites.annulus(spark, SF))
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_octant_primes(spark):
    pts = spark.range(80).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("a"))
    told = pts.select("a", "b", P.octant_prime(F.col("a"), F.col("b")).alias("x"), P.gaussian_prime(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r for r in told if r.x != r.y] == [] and sum(r.x for r in told) > 300


def test_primes_among_points_are_found_once_for_all_steps(spark, monkeypatch):
    calls = []
    among = flat.among
    monkeypatch.setattr(flat, "among", lambda points, q: calls.append(q) or among(points, q))
    assert {r.k for r in sites.g3_two_level_verdicts(spark, SF).collect()} == set(sites.STEPS)
    assert len(calls) == 1
    q = Annulus(8, 40, 120, 16)
    pts = lattice.primes(spark, q).select("a", "b").union(spark.createDataFrame([(3, 60), (4, 60), (60, 3)], "a long, b long"))
    plain = {tuple(r) for r in flat.vertices(spark, q).collect()}
    known = flat.among(pts, q)
    assert {tuple(r) for r in flat.vertices(spark, q, pts).collect()} == plain == {tuple(r) for r in flat.vertices(spark, q, known, True).collect()}
