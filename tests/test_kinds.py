"""Kinds of JSON values, told without spelling out what they hold; rows dealt to all cores."""

from pyspark.sql import functions as F

from latticeflow.functions import variants as V
from latticeflow.queries import documents, evidence

SF = "/root/testdata/sf0.001"
DOCS = {
    "{}": "object", '{"_": "true"}': "object", '{"a": {"b": [1]}}': "object", "[]": "array", '[[1], {"_": 3}, null]': "array", "null": "null",
    "1": "whole", "1.5": "number", "1e300": "number", "true": "boolean", '"x"': "string", '"{}"': "string", '"[]"': "string",
}


def test_kinds(spark):
    df = spark.createDataFrame([(d,) for d in DOCS], "d string").select("d", F.try_parse_json("d").alias("v"))
    v = F.col("v")
    told = df.select("d", V.kind(v).alias("kind"), V.fields(v).isNotNull().alias("fields"), V.items(v).isNotNull().alias("items"), V.is_kind(v, "OBJECT").alias("object"), V.is_kind(v, "ARRAY").alias("array"))
    for r in told.collect():
        assert r.kind == DOCS[r.d]
        assert (r.fields, r.items) == (r.object, r.array) == (r.kind == "object", r.kind == "array")


def test_container_kinds_do_not_print_schemas(spark):
    df = spark.range(1).select(F.try_parse_json(F.lit("{}")).alias("v")).select(*[V.is_kind(F.col("v"), k) for k in ("OBJECT", "ARRAY")])
    assert "schema_of_variant" not in df._jdf.queryExecution().analyzed().toString()


def test_one_row_group_is_dealt_to_many_tasks(spark):
    for df in (documents._profiles(spark, SF), documents._planted_bundles(spark, SF), evidence.documents(spark, SF)):
        assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
