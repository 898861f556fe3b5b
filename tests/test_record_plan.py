"""A packed record is made once, however many labels are read from it."""

from pyspark.sql import functions as F

from latticeflow.functions.records import packed, unpacked


def test_record_is_made_once(spark):
    rows = [([2, 0, 1, 0], [1, 9, 128], [1, 8, 9], [128], 0), ([0, 0, 0, 0], [], [], [], 2)]
    df = spark.createDataFrame(rows, "n array<int>, face_groups array<int>, inner array<int>, outer array<int>, tile_flags int")
    back = df.select(unpacked(packed(*[F.col(c) for c in df.columns])).alias("t"))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unhex(") == 1
    assert [tuple(r.t) for r in back.collect()] == rows
    assert spark.createDataFrame([(None,)], "r binary").select(unpacked(F.col("r")).alias("t")).first().t.face_groups == []
