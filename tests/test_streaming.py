import pytest
from pyspark.sql import functions as F

from latticeflow.operators import tiles as T
from latticeflow.params import Annulus
from latticeflow.plans import flat
from latticeflow.sources.tiles import tiles, towers
from latticeflow.streaming import columns as C

Q = Annulus(10, 40, 120, 16)


@pytest.fixture(scope="module")
def run(spark):
    from latticeflow.lineage import cut

    cols = cut(towers(spark, Q))
    return cols, cut(T.summaries(tiles(cols, Q), Q))


@pytest.mark.parametrize("k", [2, 8, 10])
def test_stream_equals_batch(spark, k):
    q = Annulus(k, 40, 120, 16)
    assert C.solve(spark, q, target_tiles=6, early_exit=False).verdict() == flat.solve(spark, q).verdict().first().verdict


def test_order_is_enforced(spark, run):
    cols, rows = run
    s = C.ColumnStream(spark, cols)
    s.ingest(rows.where("i = 1"))
    for late in ("i = 0", "i = 1"):
        with pytest.raises(C.OrderError):
            s.ingest(rows.where(late))
    with pytest.raises(C.OrderError):
        s.ingest(rows.where("i = 2 AND j > 4"))
    with pytest.raises(C.OrderError):
        s.ingest(rows.where("i = 2").union(rows.where("i = 2")))


def test_a_gap_clears_the_frontier(spark, run):
    cols, rows = run
    s = C.ColumnStream(spark, cols)
    s.ingest(rows.where("i = 0"))
    before = s.frontier.count()
    s.ingest(rows.where("i = 2"))
    assert before > 0 and s.frontier.select("component").exceptAll(s.frontier.where(F.shiftright("component", 39) == 2).select("component")).count() == 0
    assert s.verdict() in ("UNKNOWN", "SPANNING")


def test_frontier_numbers_follow_appearance(spark, run):
    cols, rows = run
    s = C.ColumnStream(spark, cols)
    s.ingest(rows.where("i <= 1"))
    seen = [r.number for r in s.projected().orderBy("j", "ordinal").collect()]
    assert [x for k, x in enumerate(seen) if x not in seen[:k]] == list(range(1, len(set(seen)) + 1))
    assert s.frontier.select("component").distinct().count() == len(set(seen))


def test_verdict_needs_every_column(spark):
    q = Annulus(2, 40, 120, 16)
    cols = towers(spark, q)
    s = C.ColumnStream(spark, cols)
    rows = T.summaries(tiles(cols, q), q)
    s.ingest(rows.where("i < 3"))
    assert s.verdict() == "UNKNOWN"
    s.ingest(rows.where("i >= 3"))
    assert s.verdict() == "MOAT" and s.progress.totals["tiles"] == rows.count()


def test_file_stream_and_restart(spark, run, tmp_path):
    cols, rows = run
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    order = sorted(r.i for r in cols.select("i").collect())
    for i in order[:2]:
        rows.where(F.col("i") == i).coalesce(1).write.mode("append").parquet(folder)
    first = C.run_stream(spark, folder, cols, early_exit=False, state=state)
    assert first.progress.batches == 2
    for i in order[2:]:
        rows.where(F.col("i") == i).coalesce(1).write.mode("append").parquet(folder)
    second = C.run_stream(spark, folder, cols, early_exit=False, state=state)
    assert second.progress.batches == len(order) and second.verdict() == "SPANNING"


def test_batches_cover_columns(spark, run):
    cols, _ = run
    plan = C.batches_of_columns(cols, 8)
    assert plan.count() == cols.count() and plan.agg(F.sum("height")).first()[0] == 31
