"""Rules of a bundle are worked out within its row; each value is taken from the document once."""

import json

from pyspark.sql import functions as F

from latticeflow.operators import contract, walk


def test_bundles_are_checked_without_shuffle_or_jobs(spark):
    df = spark.createDataFrame([(1, "{}")], "bundle_id long, bundle string")
    plan = contract.checked(df, strict=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert plan.count("try_variant_get(_v#") <= 20


def test_counters_of_odd_names_and_kinds(spark):
    docs = {
        "fine": {"a": {"b[0]": 0, 'c"\\': {"d": 0}}}, "odd name": {"a[0]": 2}, "quoted": {'a"b\\': {"c": 1}}, "decimal": {"a": 0.0}, "null": None, "text": {"a": '":0'}, "only text": '{"a":0}',
        "deep": json.loads('{"a":' * 60 + "7" + "}" * 60), "wide": {f"k{i}": i // 999 for i in range(1000)}, "within a list": [{"a": 1}],
    }
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()] + [("none", None)], "id string, doc string")
    got = {}
    for r in walk.counter_faults(df, ["id"], F.try_parse_json("doc"), "n").collect():
        got.setdefault(r.id, {})[r.path] = r.fault
    assert got == {
        "odd name": {"n.a[0]": "not 0"}, "quoted": {'n.a"b\\.c': "not 0"}, "decimal": {"n.a": "no counter"}, "null": {"n": "no object"}, "only text": {"n": "no object"}, "text": {"n.a": "no counter"},
        "deep": {"n" + ".a" * 60: "not 0"}, "wide": {"n.k999": "not 0"}, "within a list": {"n": "no object"},
    }


def test_bundles_of_one_number_keep_their_own_counters(spark):
    docs = [{"overflow_counters": {"a": n}} for n in (0, 1)]
    rows = contract.checked(spark.createDataFrame([(1, json.dumps(d)) for d in docs], "bundle_id long, bundle string")).collect()
    assert sorted(r.counters for r in rows) == [[], ["overflow_counters.a: not 0"]]
