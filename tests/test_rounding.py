"""Texts and rates are rounded by the doubles' exact values, as the SQL does it."""

from pyspark.sql import functions as F

from latticeflow.operators import aggregates as A


def test_ties_of_percentages_and_rates(spark):
    rows = [(1, 32), (3, 32), (5, 32), (1, 800), (3, 800), (1, 3), (2, 3), (0, 7), (7, 7), (-1, 32), (1, 20000), (201, 200), (640, 641), (10**9 + 1, 7)]
    df = spark.createDataFrame(rows, "part long, whole long")
    got = {(r.part, r.whole): (r.share, r.rate) for r in df.select("*", A.percent(F.col("part"), F.col("whole")).alias("share"), A.rounded(A.rate(F.col("whole"), F.col("part")), 6).alias("rate")).collect()}
    for part, whole in rows:
        assert got[part, whole][0] == f"{100.0 * part / whole:.2f}%"
    assert got[1, 32][0] == "3.12%" and got[640, 641][1] == 1.001562 and got[0, 7] == ("0.00%", None)
