"""Profiles are looked through for the objects they have first, then for the values within these."""

import json

from latticeflow.operators import normalise


def test_absent_objects_are_not_looked_into(spark):
    rows = [("a", json.dumps({"stats_v2": {"histograms": {"group_counts": {"1": 2}}, "geo_I": {"port_population": 9}}, "radii": None, "k_sq": 7}), None), ("b", '{"stats_v2":null,"stats_v2":{"geo_i_tiles":3}}', "{"), ("c", None, '{"summary":{"status":"REJECT"}}')]
    got = normalise.sweep_rows(spark.createDataFrame(rows, "path string, profile string, audit string"))
    a, b, c = sorted(got.collect(), key=lambda r: r.source_profile)
    assert (a.geo_i_ports, json.loads(a.group_count_distribution), a.k_sq, a.sample_count) == (9, {"1": 2}, 7, None)
    assert (b.geo_i_tiles, b.k_sq, c.postflight_status, c.geo_i_tiles) == (3, None, "REJECT", None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(profile") and "_profile_" in plan and plan.count(", $.stats_v2)") == 1
