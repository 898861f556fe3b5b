"""Streams with state per key: any split into batches, restarts, late rows."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from latticeflow.operators.sampling import bottom_k
from latticeflow.streaming import keyed


def files(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_samples_equal_the_batch_answer_after_any_split_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"{rng.randrange(200):03d}", i) for i in range(400)]
    schema = "sample_class string, h string, id long"
    cuts = sorted(rng.sample(range(400), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 400], strict=True)]
    run = lambda stream: keyed.run_to_end(keyed.streamed_samples(stream, 7), str(tmp_path / "state"), str(tmp_path / "out"), uuid.uuid4().hex, "update")
    run(files(spark, tmp_path / "in", parts[:2], schema))
    run(files(spark, tmp_path / "in", parts[2:], schema))  # goes on with the state that the first run left
    got = keyed.latest(spark.read.parquet(str(tmp_path / "out"))).select("sample_class", "place", "h", "id", "population")
    want = bottom_k(spark.createDataFrame(rows, schema), ["sample_class"], [F.asc("h"), F.asc("id")], 7)
    assert sorted(map(str, got.drop("population").collect())) == sorted(map(str, want.select("sample_class", "place", "h", "id").collect()))
    assert {r.sample_class: r.population for r in got.collect()} == {c: sum(r[0] == c for r in rows) for c in ("a", "b", None)}


def test_runs_and_late_rows(spark, tmp_path):
    schema = "k string, at long"
    parts = [[("x", 5), ("x", 1), ("y", 3)], [("x", 9), ("x", 100)], [("y", 500), ("x", 101)]]
    run = lambda stream: keyed.run_to_end(keyed.in_order(stream, "k", "at", 10), str(tmp_path / "state"), str(tmp_path / "out"), uuid.uuid4().hex)
    run(files(spark, tmp_path / "in", parts, schema))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "at", "run", "place").collect())
    assert got == [("x", 1, 1, 1), ("x", 5, 1, 2), ("x", 9, 1, 3), ("x", 100, 2, 1), ("x", 101, 2, 2), ("y", 3, 1, 1), ("y", 500, 2, 1)]
    with pytest.raises(Exception, match="position 101 came behind 101"):
        run(files(spark, tmp_path / "in", [[("x", 101), ("z", 1)]], schema))
    after = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "at", "run", "place").collect())
    assert after == got  # nothing of the failed batch was counted
