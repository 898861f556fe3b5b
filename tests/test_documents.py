import json

import pytest
from pyspark.sql import functions as F

from latticeflow.functions.records import packed, unpacked
from latticeflow.operators import contract, normalise, samples, trace
from latticeflow.operators import tiles as T
from latticeflow.params import Annulus
from latticeflow.plans import two_level
from latticeflow.sources import documents, regions, sinks, snapshot
from latticeflow.sources import tiles as G


def bundle(**change):
    row = {"claim_id": "c", "k_sq": 36, "r_inner": 100, "r_outer": 500, "width": 400, "region": "full-octant", "verdict": "SPANNING", "verdict_mode": "ANY-SPAN", "row_class": "run"}
    profile = {
        "commit": "a", "build": {"id": "b", "cuda_arch": "x"}, "hashes": {"grid": "1", "constants": "2", "mr_witness_hash": "3"}, "host_tileop_counters": {"emitted_overflow_bit_count": 0},
        "tiles": {"active": 4, "produced": 4, "ingested": 4}, "stats_v2": {"candidate_counts": {"5": 2}, "high_pressure": [{"tile_i": 1, "tile_j": 2, "score": 3}]},
    }
    doc = {"schema_version": 1, "row": row, "profile": profile, "bz": {"checked": True, "clean": True, "override_used": False, "bad_norm_count": 0}, "overflow_counters": {"k1": 0, "more": {"x": 0}}}
    for path, value in change.items():
        at = doc
        *parents, last = path.split("__")
        for p in parents:
            at = at[p]
        if value is None:
            at.pop(last)
        else:
            at[last] = value
    return json.dumps(doc)


PATH = {"path": [{"a": 0, "b": 3}, {"a": 0, "b": 7}]}
SMALL_ROW = {"row__k_sq": 16, "row__r_inner": 3, "row__r_outer": 7, "row__width": 4}
CASES = {
    "plain": (bundle(), "RUN_CONTRACT_PASS"),
    "required": (bundle(row__claim_proof_required=True), "CLAIM_PROOF_MISSING"),
    "audit": (bundle(sample_audit={"status": "PASS", "checked": 600, "classes": {"geo_I": {"target": 3, "observed": 3, "exhausted": False}}}), "TILE_SAMPLE_AUDIT_PASS"),
    "span": (bundle(**SMALL_ROW, span_certificate=PATH), "SPAN_PROOF_PASS"),
    "bad path": (bundle(**SMALL_ROW | {"row__k_sq": 9}, span_certificate=PATH), "REJECT"),
    "overflow": (bundle(overflow_counters={"k1": 0, "more": {"x": 2}}), "REJECT"),
    "shape": (bundle(profile__stats_v2={"candidate_counts": {"5": -2}}), "REJECT"),
    "few samples": (bundle(sample_audit={"status": "PASS", "checked": 5}), "REJECT"),
    "moat": (bundle(row__verdict="MOAT", row__verdict_mode="ANY-SHELL-MOAT", profile__early_exit_enabled=False), "RUN_CONTRACT_PASS"),
    "early moat": (bundle(row__verdict="MOAT", row__verdict_mode="ANY-SHELL-MOAT", profile__early_exit_taken=True), "REJECT"),
    "no bz": (bundle(bz=None), "REJECT"),
    "version": (bundle(schema_version=2), "REJECT"),
    "accepted": (bundle(row__row_class="accepted", row__telemetry_level="audit"), "REJECT"),
    "no commit": (bundle(profile__commit=None), "REJECT"),
    "other index": (bundle(run_index={"k_sq": 35}), "REJECT"),
    "empty": ("{}", "REJECT"),
}


def test_bundle_statuses(spark):
    df = spark.createDataFrame([(n, b) for n, (b, _) in CASES.items()], "bundle_id string, bundle string")
    proofs = trace.check_points(contract.certificate_points(df)).select(F.col("claim_id").alias("bundle_id"), "ok")
    got = {r.bundle_id: r for r in contract.checked(df, proofs).collect()}
    assert {n: r.status for n, r in got.items()} == {n: s for n, (_, s) in CASES.items()}, {n: r.errors for n, r in got.items() if r.status != CASES[n][1]}
    assert got["overflow"].errors == ["R3 overflow_counters: one is not 0"]
    reports = {r.bundle_id: json.loads(r.document) for r in sinks.postflight_reports(contract.checked(df, proofs)).collect()}
    assert reports["span"]["status"] == "SPAN_PROOF_PASS" and reports["span"]["errors"] == []


AUDIT = {"status": "PASS", "sample_count": 600, "manifest": {"k_sq": 36, "region": "full-octant"}, "quotas": {"geo_I": 3, "body": 5}, "class_counts": {"geo_I": 3, "body": 5}}
CENSUS = {"i_only_components": 1, "o_only_components": 0, "i_and_o_components": 2, "largest_component_sizes": [5, {"size": 3}], "largest_boundary_touching_components": [{"tile_count": 2}]}
ARTIFACT = {"sha256": "0" * 64, "size_bytes": 3, "schema_version": 1}
PROFILE_ROW = {"row__row_class": "profile", "bz__k_sq": 36, "bz__r_inner": 100, "bz__r_outer": 500, "bz__width": 400, "bz__region": "full-octant"}
POINTS = {"points": PATH["path"], "binding": {"commit": "a", "grid_hash": "1", "mr_witness_hash": "3"}}


def audited(**change):
    return bundle(sample_audit={k: v for k, v in (AUDIT | change).items() if v is not None})


def census(**change):
    return bundle(profile__stats_v2={"component_census": {k: v for k, v in (CENSUS | change).items() if v is not None}})


REFERENCE_CASES = {
    "audit": (audited(), "TILE_SAMPLE_AUDIT_PASS"),
    "audit absent": (audited(present=False, status="FAIL"), "RUN_CONTRACT_PASS"),
    "below quota": (audited(class_counts={"geo_I": 2, "body": 5}), "REJECT"),
    "class without count": (audited(class_counts={"geo_I": 3}), "REJECT"),
    "exhausted class": (audited(class_counts={"geo_I": 2, "body": 5}, population_exhausted={"geo_I": True}), "TILE_SAMPLE_AUDIT_PASS"),
    "exhausted in the plan": (audited(class_counts={"geo_I": 2, "body": 5}, manifest={"sample_plan": {"quota_status": {"geo_I": {"population_exhausted": True}}}}), "TILE_SAMPLE_AUDIT_PASS"),
    "other class exhausted": (audited(class_counts={"geo_I": 2, "body": 5}, population_exhaustion={"body": {"population_exhausted": True}}), "REJECT"),
    "few but all exhausted": (audited(sample_count=8, population_exhausted={"geo_I": True, "body": True}), "TILE_SAMPLE_AUDIT_PASS"),
    "few, one exhausted": (audited(sample_count=8, population_exhausted={"geo_I": True}), "REJECT"),
    "no manifest": (audited(manifest=None), "REJECT"),
    "other manifest": (audited(manifest={"radii": {"k_sq": 35}}), "REJECT"),
    "quota as text": (audited(quotas={"geo_I": "3"}), "REJECT"),
    "no class_counts": (audited(class_counts=None), "REJECT"),
    "census": (census(), "RUN_CONTRACT_PASS"),
    "census counter missing": (census(o_only_components=None), "REJECT"),
    "census counter negative": (census(i_only_components=-1), "REJECT"),
    "census sizes": (census(largest_component_sizes=[{"name": "x"}]), "REJECT"),
    "census boundary sizes": (census(largest_boundary_touching_components=5), "REJECT"),
    "stats counter": (bundle(profile__stats_v2={"geo_o_tiles": "x"}), "REJECT"),
    "stats list": (bundle(profile__stats_v2=[1]), "REJECT"),
    "snapshot hash": (bundle(profile__stats_v2={"snapshot_sha256": "abc"}), "REJECT"),
    "artifact object": (bundle(**PROFILE_ROW, artifacts={"log": ARTIFACT}), "RUN_CONTRACT_PASS"),
    "artifact object without hash": (bundle(**PROFILE_ROW, artifacts={"log": {"size": 3, "schema_version": 1}}), "REJECT"),
    "sizes differ": (bundle(artifacts={"log": ARTIFACT | {"size": 4}}), "REJECT"),
    "artifact table is a number": (bundle(artifacts=5), "REJECT"),
    "ledger": (bundle(artifact_ledger={"log": "a/b", "x": {"sha256": "0" * 64}}), "RUN_CONTRACT_PASS"),
    "bad ledger": (bundle(profile__artifact_hash_ledger=[{"path": "a", "sha256": "0"}]), "REJECT"),
    "points": (bundle(**SMALL_ROW, span_certificate=POINTS), "SPAN_PROOF_PASS"),
    "points in the table": (bundle(**SMALL_ROW, span_certificate=POINTS, artifacts={"span_certificate": ARTIFACT}), "SPAN_PROOF_PASS"),
    "points not in the table": (bundle(**SMALL_ROW, span_certificate=POINTS, artifacts={"log": ARTIFACT}), "REJECT"),
    "other binding": (bundle(**SMALL_ROW, span_certificate=POINTS | {"binding": {"grid_hash": "9"}}), "REJECT"),
    "other command": (bundle(**SMALL_ROW, profile__command="run a", span_certificate=POINTS | {"binding": {"command": ["run", "b"]}}), "REJECT"),
    "same command": (bundle(**SMALL_ROW, profile__command="run a", span_certificate=POINTS | {"binding": {"command": ["run", "a"]}}), "SPAN_PROOF_PASS"),
    "other row": (bundle(**SMALL_ROW, span_certificate=POINTS | {"k_sq": 15}), "REJECT"),
    "point as text": (bundle(**SMALL_ROW, span_certificate={"points": [*PATH["path"][:1], {"a": "x", "b": 5}, *PATH["path"][1:]]}), "REJECT"),
    "certificate absent": (bundle(**SMALL_ROW, span_certificate=POINTS | {"present": False}), "RUN_CONTRACT_PASS"),
}


def test_bundles_of_the_reference_shape(spark):
    df = spark.createDataFrame([(n, b) for n, (b, _) in REFERENCE_CASES.items()], "bundle_id string, bundle string")
    proofs = trace.check_points(contract.certificate_points(df)).select(F.col("claim_id").alias("bundle_id"), "ok")
    got = {r.bundle_id: r for r in contract.checked(df, proofs).collect()}
    assert {n: r.status for n, r in got.items()} == {n: s for n, (_, s) in REFERENCE_CASES.items()}, {n: r.errors for n, r in got.items() if r.status != REFERENCE_CASES[n][1]}


def test_sweep_rows_from_old_and_new_profiles(spark):
    new = {"radii": {"k_sq": 36, "r_inner": 100, "r_outer": "500"}, "verdict": "MOAT", "overflow_counters": {"a": 1, "b": {"c": 2}, "d": "7", "e": True}, "stats_v2": {"histograms": {"group_counts": {"1": 2}}, "geo_I": {"port_population": 9}}, "timings_seconds": {"total": 1.5}}
    old = {"k_sq": 34, "width": 5, "r_inner": 1.5, "total_time_seconds": 2, "bz_clean": True, "git_commit": "x"}
    rows = [("/a/run.v1.json", json.dumps(new), json.dumps({"report": {"status": "REJECT"}})), ("b", json.dumps(old), None), ("c", "not json", None)]
    got = {r.source_profile: r for r in normalise.sweep_rows(spark.createDataFrame(rows, "path string, profile string, audit string")).collect()}
    a, b, c = got["/a/run.v1.json"], got["b"], got["c"]
    assert (a.claim_id, a.k_sq, a.r_outer, a.width, a.verdict_mode, a.overflow_total, a.geo_i_ports, a.total_seconds) == ("run.v1", 36, 500, 400, "ANY-SHELL-MOAT", 3, 9, 1.5)
    assert (a.postflight_status, a.run_contract_status, a.proof_status, json.loads(a.group_count_distribution)) == ("REJECT", "REJECT", "CLAIM_PROOF_MISSING", {"1": 2})
    assert (b.k_sq, b.width, b.r_inner, b.total_seconds, b.bz_clean, b.commit, b.detector_status) == (34, 5, None, 2.0, True, "x", "UNKNOWN_DETECTOR_STATUS")
    assert c.k_sq is None and c.claim_id == "c"


def test_monotonicity_and_matrix(spark):
    rows = [("m", 36, 10, w, v) for w, v in ((1, "MOAT"), (2, "SPANNING"), (3, "MOAT"), (4, "SPANNING"), (None, "SPANNING"))] + [("s", 34, 10, 1, "MOAT"), ("s", 34, 10, 2, "SPANNING"), ("t", 36, 20, 1, "SPANNING"), ("t", 36, 20, 2, "MOAT")]
    df = spark.createDataFrame(rows, "claim_id string, k_sq long, r_inner long, width long, verdict string")
    assert sorted((r.narrower_width, r.wider_width or 0) for r in normalise.monotonicity(df).collect()) == [(1, 0), (1, 2), (1, 4)]


def test_snapshot_round_trip(spark, tmp_path):
    q = Annulus(10, 100, 500)
    g = two_level.solve(spark, q, caps=True)
    cols = G.towers(spark, q)
    path = str(tmp_path / "run.bin")
    manifest = snapshot.write(g.summaries, cols, q, path, generated_at="2020-01-01T00:00:00Z")
    head = snapshot.headers(spark, path).first()
    assert head.errors == [] and head.tile_count == 4 == manifest["tile_count"] and head.constants_hash == manifest["constants_hash"]
    back = {r.idx: r for r in snapshot.read(spark, path).collect()}
    for k, r in enumerate(g.summaries.orderBy("i", "j").collect()):
        assert (back[k].n, back[k].face_groups, back[k].inner, back[k].outer, back[k].tile_flags) == (r.n, r.face_groups, r.inner, r.outer, r.tile_flags)
    data = (tmp_path / "run.bin").read_bytes()
    assert len(data) == 120 + 4 * 256 and data[:4] == b"CMV2"
    (tmp_path / "bad.bin").write_bytes(b"XMV2" + data[4:-1])
    assert set(snapshot.headers(spark, str(tmp_path / "bad.bin")).first().errors) == {"magic", "length"}
    with pytest.raises(ValueError):
        snapshot.write(g.summaries.limit(3), cols, q, path)
    assert sinks.ledger(spark, path).first().size_bytes == len(data)


def test_records(spark):
    rows = [([1, 0, 2, 0], [3, 128, 1], [1, 8, 9, 128], [], 0), ([0, 0, 0, 0], [], [], [], 2)]
    df = spark.createDataFrame(rows, "n array<int>, g array<int>, i array<int>, o array<int>, f int").withColumn("p", packed(F.col("n"), F.col("g"), F.col("i"), F.col("o"), F.col("f")))
    for r in df.select("*", unpacked(F.col("p")).alias("t")).collect():
        assert len(r.p) == 256 and (r.t.n, r.t.face_groups, r.t.inner, r.t.outer, r.t.tile_flags) == (r.n, r.g, r.i, r.o, r.f)
    first = bytes(df.first().p)
    assert first[:7] == bytes([1, 0, 2, 0, 3, 128, 1]) and first[196] == 0b10000001 and first[197] == 1 and first[211] == 0b10000000


def sample(q, row, kind="geo_I", **change):
    flags = lambda labels: [sum(1 << ((x - 1) % 8) for x in labels if (x - 1) // 8 == k) for k in range(16)]
    doc = {
        "schema_version": 1, "claim_id": "c", "k_sq": q.k, "r_inner": q.r_inner, "r_outer": q.r_outer, "width": q.r_outer - q.r_inner, "region": "full-octant", "sample_class": kind, "tile": {"i": row.i, "j": row.j, "a_lo": row.i * 256, "b_lo": row.j * 256},
        "tileop": {"n": row.n, "face_groups": row.face_groups + [0] * (192 - len(row.face_groups)), "inner_flags": flags(row.inner), "outer_flags": flags(row.outer), "tile_flags": row.tile_flags},
    }
    for k, v in change.items():
        doc[k] = v
    return doc


def test_sample_audit(spark, tmp_path):
    q = Annulus(36, 100, 500)
    rows = {(r.i, r.j): r for r in T.summaries(G.tiles(G.towers(spark, q), q), q, caps=True).collect()}
    good = [sample(q, r) for r in rows.values()]

    def errors(docs):
        file = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        file.write_text("".join(json.dumps(d) + "\n" for d in docs))
        return [e for r in samples.audited(documents.samples(spark, str(file)), q).collect() for e in r.errors]

    assert errors(good) == []
    one = rows[0, 0]
    assert errors([sample(q, one, kind="other")]) == ["unknown sample class"]
    assert errors([sample(q, one), sample(q, one)]) == ["tile is sampled twice"] * 2
    assert errors([sample(q, one, width=3)]) == ["sample belongs to another run"]
    wrong = sample(q, one)
    wrong["tileop"]["inner_flags"][0] = 0
    assert errors([wrong]) == ["labels differ"]
    away = sample(q, one, tile={"i": 9, "j": 9, "a_lo": 2304, "b_lo": 2304})
    assert "tile is outside the active grid" in errors([away])
    renamed = sample(q, rows[0, 1])
    renamed["tileop"]["face_groups"] = [7 if x else 0 for x in renamed["tileop"]["face_groups"]]
    renamed["tileop"]["outer_flags"] = [64] + [0] * 15
    assert errors([renamed]) == []


def test_regions(spark, tmp_path):
    docs = {"full": {"full_octant": True}, "box": {"i_lo": 0, "i_hi": 1, "columns": [{"i": 0, "j_lo": 0, "j_hi": 1}, {"i": 1, "j_lo": 0, "j_hi": 0}]}, "list": {"tiles": [{"i": 0, "j": 1}, {"i": 1, "j": 1}]}, "none": {}, "twice": {"tiles": [{"i": 0, "j": 1}, {"i": 0, "j": 1}]}, "both": {"full_octant": True, "tiles": [{"i": 0, "j": 0}]}}
    q = Annulus(36, 100, 500)
    grid = G.tiles(G.towers(spark, q), q)
    found = {}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
        r = regions.read(spark, str(tmp_path / f"{name}.json"))
        found[name] = r.first().errors or {(t.i, t.j) for t in regions.tiles_of(r, grid).collect()}
    assert found["full"] == {(0, 0), (0, 1), (1, 0), (1, 1)} and found["box"] == {(0, 0), (0, 1), (1, 0)} and found["list"] == {(0, 1), (1, 1)}
    assert found["none"] == ["no form of region is given"] and found["twice"] == ["a tile is given twice"] and found["both"] == ["more than one form of region is given"]
    with pytest.raises(ValueError):
        regions.tiles_of(regions.read(spark, str(tmp_path / "none.json")), grid)
    box = regions.tiles_of(regions.read(spark, str(tmp_path / "box.json")), grid)
    assert two_level.solve(spark, q, region=box).grid.count() == 3


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n[1]\n{"y"\n')
    rows = {r.line_number: r.error for r in documents.json_lines(spark, str(tmp_path / "a.jsonl")).collect()}
    assert set(rows) == {1, 3, 4} and rows[1] is None and rows[3].endswith("not an object") and rows[4].endswith("not JSON")
    (tmp_path / "runs.tsv").write_text("run\tk\nr1\t36\n")
    assert documents.run_index(spark, str(tmp_path / "runs.tsv"), ("run",)).first().k == "36"
    with pytest.raises(ValueError, match="missing columns: width"):
        documents.run_index(spark, str(tmp_path / "runs.tsv"), ("run", "width"))
    (tmp_path / "cert.json").write_text(json.dumps({"schema_version": 1, "k_sq": 16, "extra": 2, "path": [{"a": 0, "b": 3}]}))
    c = documents.certificates(documents.texts(spark, str(tmp_path / "cert.json"))).first()
    assert c.unknown == ["extra"] and c.path[0].b == 3
    lines = spark.createDataFrame([("l", "verdict: MOAT"), ("l", "tiles = 4"), ("l", "tiles = 5")], "path string, value string")
    fields = documents.log_fields(lines, {"verdict": r"verdict: (\w+)", "tiles": r"tiles = (\d+)"})
    assert {(r.field, r.value, r["count"]) for r in fields.collect()} == {("verdict", "MOAT", 1), ("tiles", "4", 2)}
    assert documents.log_rows(fields, ["verdict", "tiles"]).first().verdict == "MOAT"


def test_run_documents(spark, tmp_path):
    from latticeflow.operators import aggregates, sampling
    from latticeflow.operators.verdict import census

    g = two_level.solve(spark, Annulus(10, 100, 500))
    pressure = sampling.high_pressure(g.summaries.select("i", "j", T.pressure(F.col("n"), F.col("face_groups"), F.col("tile_flags"), F.col("inner"), F.col("outer")).alias("score"), F.lit(0).alias("ports"), "groups", F.lit(0).alias("max_face")))
    doc = json.loads(sinks.profile(aggregates.run_totals(g.summaries), census(g.components()), pressure).first().document)
    assert doc["tiles"]["tiles"] == 4 and len(doc["stats_v2"]["high_pressure_tiles"]) == 3
    manifest = json.loads(sinks.sample_manifest(spark.createDataFrame([("geo_I",), ("geo_I",), ("axis",)], "sample_class string"), 8).first().document)
    assert manifest["class_counts"] == {"axis": 1, "geo_I": 2} and manifest["sample_count"] == 3
    sinks.write_tiles(g.summaries, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 4
    assert sinks.overflow_tiles(g.summaries).count() == 0
