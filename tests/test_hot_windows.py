"""Sessions and steps on hot keys: blocks with a carry give what one window gives."""

import pytest
from pyspark.sql import functions as F

from latticeflow.operators import windows as W

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "value")
    one = rows.select(F.lit(-1).cast("long").alias("user_id"), "event_id", "value")  # a user with all events
    nameless = rows.where("event_id % 3 = 0").select(F.lit(None).cast("long").alias("user_id"), "event_id", "value")
    return rows.unionByName(one).unionByName(nameless).repartition(5).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_sessions(spark, events):
    apart = F.col("event_id") - F.col("prev_event_id") > 2
    few = events.where("event_id % 5 <> 0")
    same(W.gap_clusters(few, ["user_id"], ["event_id"], apart, limit=50), W.gap_clusters(few, ["user_id"], ["event_id"], apart))


def test_sessions_with_ties(spark, events):
    """Rows that are equal in order can stand in any order; clusters by what they share don't depend on it."""
    coarse = events.select("user_id", (F.col("event_id") / 40).cast("long").alias("at"))
    apart = F.col("at") - F.col("prev_at") > 1
    same(W.gap_clusters(coarse, ["user_id"], ["at"], apart, limit=50).distinct(), W.gap_clusters(coarse, ["user_id"], ["at"], apart).distinct())


def test_steps(spark, events):
    path = events.select("user_id", "event_id", (F.col("event_id") * 7 % 31).alias("a"), (F.col("event_id") * 5 % 17).alias("b"))
    same(W.broken_steps(path, ["user_id"], "event_id", "a", "b", 200, limit=50), W.broken_steps(path, ["user_id"], "event_id", "a", "b", 200))
