"""Plans for hot keys, large graphs and large files give the same results as the plain ones."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from latticeflow import lineage
from latticeflow.functions.records import old_packed, old_unpacked
from latticeflow.operators import aggregates, sampling, stitch, trace, windows
from latticeflow.operators import tiles as T
from latticeflow.params import Annulus
from latticeflow.sources import documents, sinks
from latticeflow.sources import tiles as G

Q = Annulus(8, 40, 120, 16)


def numbers(spark, n=400):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(60), i, rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, x long, id long, v long")


@pytest.mark.parametrize("limit", [0, 10**9])
def test_blocks_equal_one_window(spark, monkeypatch, limit):
    df = numbers(spark)
    plain = {}
    for k in {r.k for r in df.select("k").distinct().collect()}:
        plain[k] = sorted((r.x, r.id, r.v) for r in df.collect() if r.k == k)
    monkeypatch.setattr(windows, "BLOCK_ROWS", limit)
    for r in windows.ordinals(df, ["k"], ["x", "id"]).collect():
        assert plain[r.k][r.ordinal - 1] == (r.x, r.id, r.v)
    for r in windows.prefix_sums(df, ["k"], ["x", "id"], "v").collect():
        assert r.before == sum(v for x, i, v in plain[r.k] if (x, i) < (r.x, r.id))
    got = {(r.k, r.x): r.label for r in windows.first_appearance(df, ["k"], "x", ["id"]).collect()}
    for k, rows in plain.items():
        seen = list(dict.fromkeys(x for _, x in sorted((i, x) for x, i, _ in rows)))
        assert [got[k, x] for x in seen] == list(range(1, len(seen) + 1))
    assert {tuple(r) for r in windows.islands(df, ["k"], "x").collect()} == islands(plain)
    assert windows.compacted(df, ["k"], ["id"], F.col("v") > 4).groupBy("k").agg(F.max("slot") - F.count("*") + 1).distinct().collect()[0][1] == 0
    tied = windows.first_appearance(df.withColumn("id", F.lit(1)), ["k"], "x", ["id"])
    assert {r.label for r in tied.collect()} == {1}


def islands(plain):
    found = set()
    for k, rows in plain.items():
        xs = sorted({x for x, _, _ in rows})
        start = 0
        for n in range(1, len(xs) + 1):
            if n == len(xs) or xs[n] != xs[n - 1] + 1:
                found.add((k, xs[start], xs[n - 1], n - start))
                start = n
    return found


def test_digests_do_not_depend_on_blocks(spark, monkeypatch):
    df = numbers(spark)
    one = sorted(map(tuple, aggregates.digest(df, ["k"], ["x", "id"], F.col("v"), chunk=7).collect()), key=str)
    monkeypatch.setattr(windows, "BLOCK_ROWS", 0)
    assert sorted(map(tuple, aggregates.digest(df.repartition(7), ["k"], ["x", "id"], F.col("v"), chunk=7).collect()), key=str) == one


def plain_path(links, sources, targets):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far, queue = dict.fromkeys(sources, 0), deque(sorted(sources))
    while queue:
        u = queue.popleft()
        for v in near.get(u, ()):
            if v not in far:
                far[v] = far[u] + 1
                queue.append(v)
    ends = sorted((far[t], t) for t in targets if t in far)
    if not ends:
        return []
    path = [ends[0][1]]
    while far[path[-1]]:
        path.append(min(v for v in near[path[-1]] if far.get(v) == far[path[-1]] - 1))
    return path[::-1]


def test_paths_by_levels_equal_those_of_one_task(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(3, 3), (100, 101)]
    sources, targets = {1, 2, 100}, {50, 51, 52}
    df = spark.createDataFrame(links, "a long, b long")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    for s, t in ((sources, targets), ({100}, targets), ({5}, {5, 6}), (sources, set())):
        want = plain_path(links, s, t)
        for limit in (0, 10**6):
            got = [r.id for r in trace.shortest_path(df, ids(s), ids(t), limit).orderBy("pos").collect()]
            assert got == want, (s, t, limit)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [json.dumps({"x": i, "pad": "y" * (i % 50)}) if i % 7 else ("[1]" if i % 2 else "") for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:100]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = documents.json_lines(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[1], r.line_number): (r.row, r.error) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = {(f, n + 1): x for f, k in (("a.jsonl", 3000), ("b.jsonl", 100)) for n, x in enumerate(lines[:k]) if x}
    assert {k: v[0] for k, v in got.items()} == want
    assert all((e is not None) == x.startswith("[") and (e is None or e.endswith(f"{f}:{n}: not an object")) for (f, n), (x, e) in got.items())


def test_hashes_equal_plain_64_bit_arithmetic(spark):
    m = 2**64

    def mix(h, *parts):
        for v in parts:
            h ^= (v + 0x9E3779B97F4A7C15 + (h << 6) % m + (h >> 2)) % m
        return h

    def text(s):
        h = 1469598103934665603
        for c in s.encode():
            h = (h ^ c) * 1099511628211 % m
        return h

    for s in ("full-octant", "", "é|x", "a" * 300):
        r = spark.range(1).select(sampling.hexadecimal(sampling.text_hash(F.lit(s))).alias("h"), sampling.hexadecimal(sampling.run_seed(F.lit(36), F.lit(80_000_000), F.lit(80_000_400), F.lit(s))).alias("seed")).first()
        assert (int(r.h, 16), int(r.seed, 16)) == (text(s), mix(text(s), 36, 80_000_000, 80_000_400, 256, 0, 0))
    r = spark.range(1).select(sampling.hexadecimal(sampling.sample_hash(F.lit(7), F.lit(2**31), F.lit(100), F.lit(500), F.lit(-1).cast("long"), 5)).alias("h")).first()
    assert int(r.h, 16) == mix(0x9E3779B97F4A7C15, m - 1, 5, 7, 2**31, 100, 500)


def test_group_numbers_have_a_range(spark):
    row = lambda i, j, label: spark.createDataFrame([(i, j, label)], "i long, j long, label long").select(stitch.group_id(F.col("i"), F.col("j"), F.col("label")).alias("x"))
    assert row(2**24 - 1, 2**24 - 1, 2**15 - 1).first().x == 2**63 - 1
    assert row(None, 0, 0).first().x is None
    for bad in ((2**24, 0, 0), (0, 2**24, 0), (0, 0, 2**15), (-1, 0, 0)):
        with pytest.raises(Exception, match="out of range"):
            row(*bad).collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.shared_folder(Session)


def test_older_records_round_trip(spark):
    rows = [([1, 2], [3], [4, 127], [5], [0, 511], [256]), ([], [], [], [], [], []), ([128], [], [], [], [], []), ([1] * 60, [2] * 65, [], [], [], []), ([1] * 60, [2] * 66, [], [], [], []), ([], [], [1], [], [512], [])]
    df = spark.createDataFrame(rows, "o array<int>, i array<int>, l array<int>, r array<int>, hl array<int>, hr array<int>")
    packed = df.select("*", old_packed(*[F.col(c) for c in ("o", "i", "l", "r", "hl", "hr")]).alias("record"))
    got = packed.select("*", old_unpacked(F.col("record")).alias("t")).collect()
    assert [r.t.status for r in got] == ["ok", "empty", "overflow", "ok", "overflow", "overflow"]
    assert all(len(r.record) == 128 for r in got)
    r = got[0]
    assert (r.t.face_o, r.t.face_i, r.t.face_l, r.t.height_l) == (r.o, r.i, r.l, r.hl) and (r.t.face_r[0], r.t.height_r[0], r.record[67:70]) == (5, 256, bytes([0, 255, 0]))


def test_layers_of_equal_runs_agree(spark):
    grid = G.tiles(G.towers(spark, Q), Q)
    mine = T.layers(grid, Q)
    assert T.layer_differences(mine, mine).count() == 0
    n = mine.count()
    assert n == 4 * grid.count()
    other = mine.where("NOT (i = 2 AND layer = 'labels')").withColumn("digest", F.when((F.col("layer") == "record") & (F.col("i") == 3), "x").otherwise(F.col("digest")))
    wrong = T.layer_differences(mine, other)
    first = {(r.i, r.layer) for r in T.first_differing_layers(wrong).collect()}
    assert first == {(2, "labels"), (3, "record")} and wrong.where("right_digest is null").count() == grid.where("i = 2").count()


def test_profile_and_samples(spark, tmp_path):
    rows = T.summaries(G.tiles(G.towers(spark, Q), Q), Q, caps=True).cache()
    h = lambda k: sampling.hexadecimal(sampling.sample_hash(F.col("i"), F.col("j"), F.lit(40), F.lit(120), F.lit(9), k))
    score = T.pressure(F.col("n"), F.col("face_groups"), F.col("tile_flags"), F.col("inner"), F.col("outer"))
    members = {"geo_I": F.size("inner") > 0, "geo_O": F.size("outer") > 0, "axis": F.col("i") == 0, "diagonal": F.col("i") == F.col("j"), "high_pressure": score > 0, "deterministic_random": F.lit(True)}
    order = {c: [-score, h(k)] if c == "high_pressure" else [h(k)] for k, c in enumerate(members)}
    chosen = sampling.stratified(rows, ["i", "j"], members, order, 24)
    population = rows.select(F.explode(F.array(*[F.when(m, F.lit(c)) for c, m in members.items()])).alias("sample_class")).where("sample_class is not null").groupBy("sample_class").agg(F.count("*").alias("population"))
    sinks.sample_lines(chosen, rows, Q, "claim").write.text(str(tmp_path / "samples"))
    back = documents.samples(spark, str(tmp_path / "samples"))
    assert back.count() == 24 and back.select("tile.i", "tile.j").distinct().count() == 24
    joined = back.join(rows.withColumnRenamed("n", "its").select("i", "j", "its"), (F.col("tile.i") == F.col("i")) & (F.col("tile.j") == F.col("j")))
    assert joined.where("tileop.n = its AND size(tileop.inner_flags) = 16 AND width = 80").count() == 24
    m = json.loads(sinks.sample_manifest(chosen, 24, population).first().document)
    assert m["quotas"] == dict.fromkeys(members, 4) and m["sample_count"] == 24 and sum(m["class_counts"].values()) == 24
    for c, told in m["population_exhaustion"].items():
        assert told["population_exhausted"] == (told["observed"] >= told["population"]) and told["quota"] == 4, c
    d = sinks.tile_distributions(rows)
    doc = json.loads(sinks.profile(rows.agg(F.count("*").alias("active")), spark.createDataFrame([("x", 1)], "class string, components long"), rows.limit(1).select("i", "j"), d, {"commit": "c"}, spark.createDataFrame([], "event string")).first().document)
    assert doc["commit"] == "c" and doc["tiles"]["active"] == rows.count() and doc.get("span_trace") is None
    assert doc["stats_v2"]["distributions"]["group_counts"]["count"] == rows.count()
    assert sum(b["count"] for b in doc["stats_v2"]["distributions"]["gaussian_prime_counts"]["buckets"]) == rows.count()


def test_intervals_without_time(spark):
    df = spark.createDataFrame([("a", 0, 2, 1.0), ("a", 1, 2, 1.0), ("a", 10, 1, 2.0), ("a", 20, 1, 0.0), ("b", 5, 3, 1.5)], "k string, n long, amount long, s double")
    got = {(r.k, r.interval): (r.amount, r.rate, r.slowdown) for r in windows.interval_slowdown(df, ["k"], "n", 10, "amount", "s").collect()}
    assert got == {("a", 0): (4, 2.0, 1.0), ("a", 1): (1, 0.5, 4.0), ("a", 2): (1, None, None), ("b", 0): (3, 2.0, 1.0)}
