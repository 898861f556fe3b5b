"""Queries of the document operators: JSON made from the tables goes in, rows come out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from latticeflow.functions.records import old_packed, old_unpacked, packed, unpacked
from latticeflow.lineage import cut, dealt, shared_folder
from latticeflow.operators import contract, legacy, normalise, samples, stitch, trace, walk
from latticeflow.operators import tiles as T
from latticeflow.operators import windows as W
from latticeflow.operators.windows import reversals
from latticeflow.params import Annulus
from latticeflow.queries import Query, table
from latticeflow.sources import documents, record_files, regions, sinks, snapshot
from latticeflow.sources import tiles as G

_Q = Annulus(8, 40, 120, 16)


def _profiles(spark, sf):
    """Profiles in three historical shapes, from orders."""
    o = dealt(table(spark, sf, "orders"), "o_orderkey")
    k, r, w = F.lit(36).cast("long"), F.col("o_custkey"), F.col("o_orderkey") % 97
    verdict = F.when(F.col("o_orderstatus") == "F", "SPANNING").when(F.col("o_orderstatus") == "O", "MOAT")
    new = F.struct(F.struct(k.alias("k_sq"), r.alias("r_inner"), (r + w).alias("r_outer")).alias("radii"), verdict.alias("verdict"), F.struct(w.alias("active"), w.alias("produced")).alias("tiles"), F.struct(F.struct((w % 3).alias("y"), F.lit(0).cast("long").alias("z")).alias("x")).alias("overflow_counters"), F.struct(F.lit(True).alias("checked"), F.lit(True).alias("clean"), F.lit(False).alias("override_used"), (w % 2).alias("bad_norm_count")).alias("bz"), F.struct((w / 4).alias("total")).alias("timings_seconds"))
    old = F.struct(k.alias("k_sq"), r.cast("string").alias("r_inner"), w.alias("width"), verdict.alias("verdict"), w.alias("active_tiles"), F.lit("none").alias("stats_level"), F.lit("abc").alias("git_commit"))
    profile = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(old)).when(F.col("o_orderkey") % 3 == 1, F.to_json(new)).otherwise("{}")
    audit = F.when(F.col("o_orderkey") % 5 == 0, F.to_json(F.struct(F.struct(F.when(F.col("o_orderpriority") == "5-LOW", "REJECT").otherwise("SPAN_PROOF_PASS").alias("status")).alias("summary"))))
    return o.select(F.concat(F.lit("/runs/p"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"), profile.alias("profile"), audit.alias("audit"))


_SHAPES = """WITH o AS (SELECT *, 36::BIGINT AS k, o_custkey AS r, o_orderkey % 97 AS w, CASE o_orderstatus WHEN 'F' THEN 'SPANNING' WHEN 'O' THEN 'MOAT' END AS v, o_orderkey % 3 AS shape FROM orders),
n AS (SELECT o_orderkey, CASE WHEN shape < 2 THEN k END AS k_sq, CASE WHEN shape < 2 THEN r END AS r_inner, CASE WHEN shape = 1 THEN r + w END AS r_outer, CASE WHEN shape < 2 THEN w END AS width, CASE WHEN shape < 2 THEN v END AS verdict,
  CASE WHEN shape < 2 THEN w END AS active_tiles, CASE WHEN shape = 1 THEN w END AS produced_tiles, CASE WHEN shape = 1 THEN w % 3 END AS overflow_total, CASE WHEN shape = 1 THEN w % 2 END AS bad, CASE WHEN shape = 1 THEN w / 4.0::DOUBLE END AS total_seconds,
  CASE WHEN shape = 0 THEN 'none' END AS telemetry_level, CASE WHEN shape = 0 THEN 'abc' END AS "commit", CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'REJECT' ELSE 'SPAN_PROOF_PASS' END END AS post FROM o)
"""


def f18_f19_sweep_rows(spark, sf):
    rows = normalise.sweep_rows(_profiles(spark, sf))
    keep = ("claim_id", "k_sq", "r_inner", "r_outer", "width", "verdict", "verdict_mode", "detector_status", "proof_status", "postflight_status", "run_contract_status", "active_tiles", "produced_tiles", "overflow_total", "bz_bad_norm_count", "total_seconds", "telemetry_level", "commit")
    return rows.select(*keep)


def k7_matrix_rows(spark, sf):
    rows = normalise.matrix_rows(normalise.sweep_rows(_profiles(spark, sf)))
    return rows.select("claim_id", "hardening", "verdict", "postflight_status", "bz_status", "overflow_status", "stats_v2_status")


def w4_a12_monotonicity(spark, sf):
    rows = normalise.matrix_rows(normalise.sweep_rows(_profiles(spark, sf)))
    return normalise.monotonicity(rows)


def r_rules(spark, sf):
    """Bundles from orders: some break one rule, some two."""
    o = dealt(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    n = F.col("o_orderkey")
    row = F.struct(F.lit("c").alias("claim_id"), F.lit(36).alias("k_sq"), F.lit(100).alias("r_inner"), F.lit(500).alias("r_outer"), F.when(n % 7 == 0, 399).otherwise(400).alias("width"), F.lit("full-octant").alias("region"), F.lit("MOAT").alias("verdict"), F.lit("ANY-SHELL-MOAT").alias("verdict_mode"), F.lit("run").alias("row_class"), (n % 4 == 0).alias("claim_proof_required"))
    bz = F.struct(F.lit(True).alias("checked"), (n % 11 != 0).alias("clean"), F.lit(False).alias("override_used"), F.lit(0).alias("bad_norm_count"))
    profile = F.struct(F.lit("abc").alias("commit"), F.lit("b1").alias("build_id"), F.struct(F.lit("b1").alias("id")).alias("build"), F.lit("sm").alias("cuda_arch"), F.struct(F.lit("g").alias("grid"), F.lit("c").alias("constants"), F.lit("m").alias("mr_witness")).alias("hashes"), F.struct(F.when(n % 13 == 0, 1).otherwise(0).alias("emitted_overflow_bit_count")).alias("host_tileop_counters"), F.struct(F.lit(4).alias("active"), F.lit(4).alias("produced"), F.lit(4).alias("ingested")).alias("tiles"), F.lit(False).alias("early_exit_enabled"), F.struct(F.lit(1).alias("geo_i_tiles")).alias("stats_v2"))
    doc = F.to_json(F.struct(F.lit(1).alias("schema_version"), row.alias("row"), bz.alias("bz"), profile.alias("profile"), F.struct(F.struct(F.when(n % 17 == 0, 2).otherwise(0).alias("k1")).alias("kernel")).alias("overflow_counters")))
    bundles = o.select(n.alias("bundle_id"), doc.alias("bundle"))
    return contract.checked(bundles).select("bundle_id", "status", F.array_join("errors", "; ").alias("errors"))


_RULES = """SELECT o_orderkey AS bundle_id, CASE WHEN e <> '' THEN 'REJECT' WHEN o_orderkey % 4 = 0 THEN 'CLAIM_PROOF_MISSING' ELSE 'RUN_CONTRACT_PASS' END AS status, e AS errors FROM (
  SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'R1 width: not the difference of the radii' END, CASE WHEN o_orderkey % 11 = 0 THEN 'R2 bz.clean: not true' END,
    CASE WHEN o_orderkey % 17 = 0 THEN 'R3 overflow_counters: one is not 0' END, CASE WHEN o_orderkey % 13 = 0 THEN 'R3 host_tileop_counters: overflow bits emitted' END], lambda x: x IS NOT NULL), '; ') AS e FROM orders)"""


def _planted_bundles(spark, sf):
    """(bundle_id, bundle): bundles from orders; the order's number says what is spoilt, the others are whole."""
    n = F.col("o_orderkey") % 40
    when = lambda k, bad, good: F.when(n == k, bad).otherwise(good)
    text, num = F.lit, lambda x: F.lit(x).cast("long")
    row = F.struct(text("c").alias("claim_id"), num(36).alias("k_sq"), num(100).alias("r_inner"), num(500).alias("r_outer"), num(400).alias("width"), text("full-octant").alias("region"), text("MOAT").alias("verdict"), when(1, text("ANY-SPAN"), text("ANY-SHELL-MOAT")).alias("verdict_mode"), text("run").alias("row_class"), F.when(n != 2, F.lit(False)).alias("claim_proof_required"))
    bz = F.struct(when(3, F.lit(False), F.lit(True)).alias("checked"), F.lit(True).alias("clean"), F.lit(False).alias("override_used"), num(0).alias("bad_norm_count"))
    kernel = F.struct(F.when(n == 4, num(-3)).when(n == 5, F.col("o_orderkey")).otherwise(num(0)).alias("k1"), F.when(n == 6, text("0")).alias("k2"))
    deep = F.struct(F.struct(F.struct(F.struct(F.struct(F.struct(F.struct(when(7, num(9), num(0)).alias("h")).alias("g")).alias("f")).alias("e")).alias("d")).alias("c")).alias("b"))
    counters = F.struct(kernel.alias("kernel"), deep.alias("a"), F.when(n == 8, F.from_json(text("{}"), "map<string,int>")).alias("none"))
    sizes = F.array(F.struct(num(5).alias("size")))
    census = F.struct(F.when(n != 9, num(1)).alias("i_only_components"), num(0).alias("o_only_components"), num(0).alias("i_and_o_components"), sizes.alias("largest_component_sizes"))
    bucket = F.array(F.struct(num(5).alias("value"), when(10, num(-1), num(2)).alias("count")))
    counts = F.struct(bucket.alias("buckets"), num(5).alias("observed_min"), num(5).alias("observed_max"), num(1).alias("sample_count"), F.when(n != 11, num(2)).alias("total_count"))
    pressure = F.array(F.struct(F.when(n != 12, num(1)).alias("tile_i"), num(2).alias("tile_j"), F.lit(1.5).alias("score")))
    stats = F.struct(F.when(n != 13, num(4)).alias("geo_i_tiles"), num(0).alias("geo_o_tiles"), num(1).alias("geo_i_ports"), F.struct(F.when(n != 14, num(1)).alias("port_population")).alias("geo_O"), census.alias("component_census"), F.struct(counts.alias("group_counts")).alias("distributions"), pressure.alias("high_pressure_tiles"), when(15, text("abc"), text("a" * 64)).alias("snapshot_sha256"))
    profile = F.struct(F.when(n != 16, text("abc")).alias("commit"), F.struct(text("b1").alias("id")).alias("build"), text("sm").alias("cuda_arch"), F.struct(text("g").alias("grid"), text("c").alias("constants"), text("m").alias("mr_witness")).alias("hashes"), F.struct(when(17, num(1), num(0)).alias("emitted_overflow_bit_count")).alias("host_tileop_counters"), F.struct(num(4).alias("active"), when(18, num(3), num(4)).alias("produced"), num(4).alias("ingested")).alias("tiles"), F.lit(False).alias("early_exit_enabled"), stats.alias("stats_v2"))
    audit = F.struct(text("PASS").alias("status"), when(19, num(5), num(600)).alias("sample_count"), F.struct(when(20, num(35), num(36)).alias("k_sq")).alias("manifest"), F.struct(num(3).alias("geo_I")).alias("quotas"), F.struct(when(21, num(2), num(3)).alias("geo_I")).alias("class_counts"))
    artifact = F.struct(when(22, text("0"), text("0" * 64)).alias("sha256"), num(3).alias("size_bytes"), F.when(n != 23, num(1)).alias("schema_version"))
    doc = F.struct(num(1).alias("schema_version"), row.alias("row"), bz.alias("bz"), profile.alias("profile"), counters.alias("overflow_counters"), F.when(n >= 19, audit).alias("sample_audit"), F.when(n != 24, F.struct(artifact.alias("log"))).alias("artifacts"), F.when(n == 25, F.struct(num(35).alias("k_sq"))).alias("run_index"))
    o = dealt(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return o.select(F.col("o_orderkey").alias("bundle_id"), F.to_json(doc).alias("bundle"))


def r_rules_whole(spark, sf):
    """Every kind of rule broken by a share of the bundles, in the strict form; overflow counters at fault by path."""
    got = contract.checked(_planted_bundles(spark, sf), strict=True)
    return got.select("bundle_id", "status", F.array_join("errors", "; ").alias("errors"), F.array_join("counters", "; ").alias("counters"))


#: Rest of the order's number by 40 -> the one message of its bundle.
_BROKEN = {
    1: "R1 verdict_mode: that of another verdict", 3: "R2 bz.checked: not true", **{k: "R3 overflow_counters: one is not 0" for k in (4, 5, 6, 7, 8)}, 9: "R7 profile.stats_v2.i_only_components: no whole number",
    10: "R5 profile.stats_v2.distributions.group_counts: unreadable", 11: "R5 profile.stats_v2.distributions.group_counts: unreadable", 12: "R6 profile.stats_v2.high_pressure_tiles: unreadable",
    13: "R8 profile.stats_v2.geo_i_tiles: absent", 14: "R8 profile.stats_v2.geo_o_ports: absent", 15: "R8 profile.stats_v2.snapshot_sha256: no sha256", 16: "R4 commit: absent", 17: "R3 host_tileop_counters: overflow bits emitted",
    18: "R10 tiles: counts of a moat differ", 19: "R12 sample_audit: too few samples", 20: "R12 sample_audit.manifest: not that of the row", 21: "R12 sample_audit: a class below its quota", 22: "R9 artifacts: an unsound entry", 23: "R9 artifacts: an unsound entry",
    24: "R9 artifacts: absent for an audit or a proof", 25: "R11 run_index.k_sq: not that of the row",
}
_WHOLE_RULES = f"""SELECT o_orderkey AS bundle_id, CASE WHEN e IS NOT NULL THEN 'REJECT' WHEN n = 2 THEN 'CLAIM_PROOF_MISSING' WHEN n >= 19 THEN 'TILE_SAMPLE_AUDIT_PASS' ELSE 'RUN_CONTRACT_PASS' END AS status, coalesce(e, '') AS errors,
  CASE n WHEN 4 THEN 'overflow_counters.kernel.k1: negative' WHEN 5 THEN 'overflow_counters.kernel.k1: not 0' WHEN 6 THEN 'overflow_counters.kernel.k2: no counter' WHEN 7 THEN 'overflow_counters.a.b.c.d.e.f.g.h: not 0' WHEN 8 THEN 'overflow_counters.none: empty' ELSE '' END AS counters
FROM (SELECT o_orderkey, o_orderkey % 40 AS n, CASE o_orderkey % 40 {" ".join(f"WHEN {k} THEN '{m}'" for k, m in _BROKEN.items())} END AS e FROM orders)"""


def a11_whole_sums(spark, sf):
    """All whole numbers of nested documents made from line items, summed at any depth."""
    li = table(spark, sf, "lineitem")
    item = F.struct("l_linenumber", F.struct(F.col("l_partkey").cast("long").alias("part"), F.array(F.col("l_suppkey").cast("long"), F.lit(-1).cast("long")).alias("list")).alias("of"), F.col("l_linestatus").alias("mode"), F.lit(0.5).alias("half"))
    docs = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("doc"))
    return walk.whole_sums(docs, ["l_orderkey"], F.try_parse_json("doc")).select("l_orderkey", F.col("total").cast("long").alias("total"), "numbers")


def s4_regions(spark, sf):
    """Region documents from orders; which of them are refused."""
    n = F.col("o_orderkey")
    col = lambda i, lo, hi: F.struct(i.cast("long").alias("i"), lo.cast("long").alias("j_lo"), hi.cast("long").alias("j_hi"))
    cols = F.array(col(n, n % 5, F.lit(3)), col(n + F.when(n % 4 == 0, 2).otherwise(1), F.lit(0), F.lit(3)))
    rows = table(spark, sf, "orders").select(n, F.lit(None).cast("boolean").alias("full_octant"), n.alias("i_lo"), (n + 1).alias("i_hi"), cols.alias("columns"), F.lit(None).cast("array<struct<i:long,j:long>>").alias("tiles"))
    return regions.validated(rows).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


def s12_log_fields(spark, sf):
    """Fields of logs: one text line per event, the user as the log."""
    lines = table(spark, sf, "events").select(F.concat(F.lit("log"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("kind="), "event_type", F.lit(" props="), "props").alias("value"))
    return documents.log_fields(lines, {"kind": r"kind=(\w+)", "k": r'"k": (\d+)'})


def k6_sweep_lines(spark, sf):
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return sinks.sweep_lines(rows)


def k7_report_lines(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("nation"), "s_name")
    return sinks.markdown(rows, ["s_suppkey", "nation", "s_name"])


def f11_records(spark, sf):
    """Tile records packed into bytes and read back, as texts of their parts."""
    rows = T.summaries(G.tiles(G.towers(spark, _Q), _Q), _Q, caps=True)
    back = rows.select("i", "j", unpacked(packed(F.col("n"), F.col("face_groups"), F.col("inner"), F.col("outer"), F.col("tile_flags"))).alias("t"))
    return back.select("i", "j", *[F.array_join(f"t.{c}", ".").alias(c) for c in ("n", "face_groups", "inner", "outer")], F.col("t.tile_flags").cast("long").alias("tile_flags"))


def f23_old_records(spark, sf):
    """Older records made from numbers: their status and group counts."""
    n = F.col("c_custkey").cast("long")
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    head = F.concat(byte(F.when(n % 10 == 9, 255).otherwise(3 + n % 4)), byte(5 + n % 4), byte(F.when(n % 10 == 8, 2).otherwise(8 + n % 4)))
    body = F.rpad(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(124).cast("long")), lambda k: byte(F.pmod(k * 7 + n, F.lit(256)))), ""), 250, "0")
    t = cut(table(spark, sf, "customer").select(n.alias("n"), F.unhex(F.concat(head, body)).alias("record"))).select("n", old_unpacked(F.col("record")).alias("t"))
    return t.select("n", F.col("t.status").alias("status"), F.size("t.face_o").alias("o"), F.size("t.face_i").alias("i"), F.size("t.face_l").alias("l"), F.size("t.face_r").alias("r"), F.coalesce(F.try_element_at("t.height_l", F.lit(1)), F.lit(-1)).alias("first_height"))


_OLD = """SELECT n, CASE WHEN n % 10 = 9 THEN 'overflow' WHEN n % 10 = 8 THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN n % 10 < 8 THEN n % 4 ELSE 0 END::INTEGER AS o, CASE WHEN n % 10 < 8 THEN 2 ELSE 0 END::INTEGER AS i,
  CASE WHEN n % 10 < 8 THEN 3 ELSE 0 END::INTEGER AS l, CASE WHEN n % 10 < 8 THEN (128 - 8 - n % 4 - 3) // 2 ELSE 0 END::INTEGER AS r,
  CASE WHEN n % 10 < 8 THEN ((((5 + n % 4 - 3) * 7 + n) % 256) >> 7) * 256 + ((8 + n % 4 + (128 - 8 - n % 4 - 3) // 2 - 3) * 7 + n) % 256 ELSE -1 END::INTEGER AS x FROM (SELECT c_custkey::BIGINT AS n FROM customer)"""


def f23_encoded(spark, sf):
    """Older records made from line items, group by group, and read back; some don't fit."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 130).cast("int").alias("g"), (F.col("l_suppkey") * 7 % 512).cast("int").alias("h"), (F.col("l_linenumber") % 4).cast("int").alias("f"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "g", "h", "f"))).alias("p"))
    face = lambda f, c: F.transform(F.filter("p", lambda x: x["f"] == f), lambda x: x[c])
    record = old_packed(face(0, "g"), face(1, "g"), face(2, "g"), face(3, "g"), face(2, "h"), face(3, "h"))
    read = rows.select("l_orderkey", record.alias("record")).select("l_orderkey", "record", old_unpacked(F.col("record")).alias("t"))
    return read.select("l_orderkey", F.lower(F.hex("record")).alias("record"), F.when(F.col("t.status") == "ok", F.array_join(F.concat("t.face_o", "t.face_i", "t.face_l"), ".")).alias("groups"), F.when(F.col("t.status") == "ok", F.array_join("t.height_l", ".")).alias("heights"))


def _encoded_sql() -> str:
    byte = lambda x: f"lpad(lower(hex(({x})::UBIGINT)), 2, '0')"
    of = lambda f, what, sep="''": f"coalesce(string_agg({what}, {sep} ORDER BY l_linenumber, g, h) FILTER (f = {f}), '')"
    n = lambda *fs: "count(*) FILTER (f IN (" + ", ".join(map(str, fs)) + "))"
    return f"""WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey % 130 AS g, l_suppkey * 7 % 512 AS h, l_linenumber % 4 AS f FROM lineitem)
SELECT l_orderkey, CASE WHEN fits THEN rpad(record, 256, '0') ELSE repeat('ff', 128) END AS record, CASE WHEN fits THEN groups END AS groups, CASE WHEN fits THEN heights END AS heights FROM (
  SELECT l_orderkey, min(g) >= 1 AND max(g) <= 127 AND 3 + {n(0, 1)} + 2 * {n(2, 3)} <= 128 AS fits,
    rpad({byte(f"3 + {n(0)}")} || {byte(f"3 + {n(0, 1)}")} || {byte(f"3 + {n(0, 1, 2)}")} || {of(0, byte("g"))} || {of(1, byte("g"))} || {of(2, byte("g + (h >> 8) * 128"))} || {of(3, byte("g + (h >> 8) * 128"))}, (2 * (3 + {n(0, 1, 2)} + (125 - {n(0, 1, 2)} - {n(2)}) // 2))::INTEGER, '0') || {of(2, byte("h % 256"))} || {of(3, byte("h % 256"))} AS record,
    array_to_string(list_concat(list_concat(coalesce(list(g ORDER BY l_linenumber, g, h) FILTER (f = 0), []), coalesce(list(g ORDER BY l_linenumber, g, h) FILTER (f = 1), [])), coalesce(list(g ORDER BY l_linenumber, g, h) FILTER (f = 2), [])), '.') AS groups,
    {of(2, "h::VARCHAR", "'.'")} AS heights FROM li GROUP BY l_orderkey)"""


def p15_pruned(spark, sf):
    """Dead ends of a port list made from line items."""
    li = table(spark, sf, "lineitem").select(F.lit(0).alias("i"), F.col("l_orderkey").alias("j"), F.element_at(F.array(*[F.lit(x) for x in "IOLR"]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("face"), F.col("l_linenumber").alias("ordinal"), (F.col("l_suppkey") % 3 + 1).alias("label"))
    return legacy.pruned(li.distinct()).select("j", "face", "ordinal", F.col("label").cast("long").alias("label"))


def k5_certificate_points(spark, sf):
    """A certificate document's points, read back from JSON."""
    n = F.col("c_custkey").cast("long")
    path = table(spark, sf, "customer").select(n.alias("pos"), (n * 2).alias("a"), (n * 3).alias("b"))
    doc = documents.certificates(sinks.certificate(path, 36, 100, 500))
    return doc.select(F.size("unknown").alias("unknown"), F.posexplode("path").alias("pos", "p")).select("unknown", F.col("pos").cast("long").alias("pos"), "p.a", "p.b")


def k11_golden(spark, sf):
    """Digests of the tiles' records in order, by two columns."""
    return sinks.golden(T.summaries(G.tiles(G.towers(spark, _Q), _Q), _Q), batch=2)


def k11_layers(spark, sf):
    """Digests of each layer of the tiles' answers, by two columns."""
    return sinks.golden_layers(T.layers(G.tiles(G.towers(spark, _Q), _Q), _Q), batch=2)


def s6_s7_snapshot(spark, sf):
    """A snapshot written and read back: the header's count and the records that differ from the summaries."""
    cols = cut(G.towers(spark, _Q))
    rows = cut(T.summaries(G.tiles(cols, _Q), _Q, caps=True))
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}.bin"
    snapshot.write(rows, cols, _Q, path, generated_at="2020-01-01T00:00:00Z")
    places = G.tiles(cols, _Q).select("i", "j", "idx")
    back = snapshot.read(spark, path).join(places, "idx").select("i", "j", "n", "face_groups", "inner", "outer", "tile_flags")
    wrong = rows.select(*back.columns).exceptAll(back).agg(F.count(F.lit(1)).alias("wrong"))
    head = snapshot.headers(spark, path).select("tile_count", "bytes_per_tile", F.size("errors").cast("long").alias("errors"))
    return head.join(F.broadcast(wrong.select(F.lit(0).cast("long").alias("errors"), "wrong")), "errors", "left").select("tile_count", "bytes_per_tile", "errors", "wrong")


def s10_json_lines(spark, sf):
    """JSON lines with blank and broken ones, written as text and read with line numbers."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    n = F.col("c_custkey")
    line = F.when(n % 10 == 3, "").when(n % 10 == 5, "[1]").when(n % 10 == 7, '{"x"').otherwise(F.concat(F.lit('{"x": '), n.cast("string"), F.lit("}")))
    table(spark, sf, "customer").orderBy("c_custkey").select(line.alias("value")).coalesce(1).write.text(folder)
    rows = documents.json_lines(spark, folder)
    return rows.select(F.col("line_number").cast("long").alias("line_number"), F.regexp_extract("error", "[^:]+$", 0).alias("error"))


def s11_run_index(spark, sf):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.csv(folder, sep="\t", header=True)
    return documents.run_index(spark, folder, ("s_suppkey", "s_name")).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


def j8_offset_matches(spark, sf):
    """Ports from line items, matched with a shift of 7 in a tile of 50."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), (F.col("l_partkey") % 3).alias("j"), F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise("L").alias("face"), F.col("l_quantity").cast("int").alias("h"), F.col("l_suppkey").alias("label"))
    return stitch.offset_matches(li.distinct(), 7, 50)


def j13_sample_audit(spark, sf):
    """Samples made from the tiles' own summaries, some of them spoilt."""
    q = Annulus(10, 1000, 2000)
    rows = T.summaries(G.tiles(G.towers(spark, q), q), q, caps=True, parts=6)
    flags = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.filter(c, lambda x: F.floor((x - 1) / 8) == k), F.lit(0), lambda a, x: a + F.pow(F.lit(2), F.pmod(x - 1, F.lit(8))).cast("int")))
    t = F.col("i") + F.col("j")
    made = rows.select(
        F.lit(1).alias("schema_version"), F.lit("c").alias("claim_id"), F.lit(q.k).cast("long").alias("k_sq"), F.lit(q.r_inner).cast("long").alias("r_inner"), F.lit(q.r_outer).cast("long").alias("r_outer"), F.when(t % 5 == 0, 7).otherwise(q.r_outer - q.r_inner).cast("long").alias("width"), F.lit("full-octant").alias("region"),
        F.when(t % 3 == 0, "other").otherwise("geo_I").alias("sample_class"), F.struct("i", "j", (F.col("i") * 256).alias("a_lo"), (F.col("j") * 256 + F.when(t % 7 == 0, 1).otherwise(0)).alias("b_lo")).alias("tile"),
        F.struct("n", "face_groups", flags(F.col("inner")).alias("inner_flags"), flags(F.col("outer")).alias("outer_flags"), "tile_flags").alias("tileop"),
    )
    return samples.audited(cut(made), q).select("i", "j", F.array_join("errors", "; ").alias("errors"))


def _audit_sql() -> str:
    from latticeflow.queries.lattice import _towers_sql

    return f"""WITH {_towers_sql(Annulus(10, 1000, 2000))}
SELECT i, j, array_to_string(list_filter([CASE WHEN (i + j) % 5 = 0 THEN 'sample belongs to another run' END, CASE WHEN (i + j) % 3 = 0 THEN 'unknown sample class' END, CASE WHEN (i + j) % 7 = 0 THEN 'tile is not at its place' END], lambda x: x IS NOT NULL), '; ') AS errors FROM tiles"""


def g11_stitch_paths(spark, sf):
    """Stitch paths from line items: right ones with some steps spoilt."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    steps = o.select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    k, p = F.col("l_orderkey"), F.col("pos")
    up = p % 2 == 0
    rows = steps.select(
        k.cast("string").alias("claim_id"), "pos", F.floor(p / 2).alias("i"), F.floor((p + 1) / 2).alias("j"), (p + 1).alias("label"), F.when(up, "O").otherwise("R").alias("face"), F.lit(1).alias("ordinal"),
        (F.floor(p / 2) + F.when(up, 0).otherwise(1)).alias("i2"), (F.floor((p + 1) / 2) + F.when(up, 1).otherwise(0)).alias("j2"), (p + 2 + F.when((k % 3 == 0) & (p == 0), 5).otherwise(0)).alias("label2"), F.when(up, "I").otherwise("L").alias("face2"), F.when(k % 4 == 0, 2).otherwise(1).alias("ordinal2"), F.when(up, "match_io").otherwise("match_lr").alias("event"),
    )
    return trace.check_stitch_path(rows).select("claim_id", "ok", F.array_join("errors", "; ").alias("errors"))


_PATHS = """SELECT l_orderkey::VARCHAR AS claim_id, e = '' AS ok, e AS errors FROM (SELECT l_orderkey, array_to_string(list_filter([CASE WHEN l_orderkey % 3 = 0 AND count(*) > 1 THEN 'steps do not follow each other' END, CASE WHEN l_orderkey % 4 = 0 THEN 'ordinals differ' END], lambda x: x IS NOT NULL), '; ') AS e FROM lineitem GROUP BY l_orderkey)"""
_OFFSETS = """WITH p AS (SELECT DISTINCT l_orderkey AS i, l_partkey % 3 AS j, CASE WHEN l_linenumber % 2 = 0 THEN 'R' ELSE 'L' END AS face, l_quantity::INTEGER AS h, l_suppkey AS label FROM lineitem)
SELECT x.i, x.j, x.label, y.j AS j2, y.label AS label2 FROM p x JOIN p y ON x.face = 'R' AND y.face = 'L' AND y.i = x.i + 1 AND ((y.j = x.j AND x.h = y.h + 7) OR (y.j = x.j + 1 AND x.h + 50 - 7 = y.h))""".replace("x.h + 50 - 7 = y.h", "x.h = y.h - 50 + 7")


def w4_status_reversals(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return reversals(e, ["user_id"], "event_id", "event_type", "error", "purchase").select("user_id", "event_id", "narrower")


def _golden_sql() -> str:
    from latticeflow.queries.lattice import RECORDS_SQL, _tile_sql

    return _tile_sql(_Q, f"""SELECT i // 2 AS batch, count(*) AS "rows", sha256(sha256(string_agg(i || ',' || j || ',' || n || ',' || face_groups || ',' || "inner" || ',' || "outer" || ',' || tile_flags, chr(10) ORDER BY i, j))) AS digest FROM ({RECORDS_SQL}) GROUP BY 1""")


def _golden_layers_sql() -> str:
    from latticeflow.queries.lattice import LAYERS_SQL, _tile_sql

    return _tile_sql(_Q, f"""SELECT i // 2 AS batch, layer, count(*) AS "rows", sha256(sha256(string_agg(i || ',' || j || ',' || digest, chr(10) ORDER BY i, j))) AS digest FROM ({LAYERS_SQL}) GROUP BY 1, 2""")


def _records_sql() -> str:
    from latticeflow.queries.lattice import RECORDS_SQL, _tile_sql

    return _tile_sql(_Q, RECORDS_SQL)


def _snapshot_sql() -> str:
    from latticeflow.queries.lattice import _towers_sql

    return f"WITH {_towers_sql(_Q)} SELECT count(*) AS tile_count, 256::BIGINT AS bytes_per_tile, 0::BIGINT AS errors, 0::BIGINT AS wrong FROM tiles"


def _line_records(spark, sf):
    """Line items as records of 24 bytes at their places by order and line."""
    part = lambda c, n: F.lpad(F.hex(F.col(c).cast("long")), 2 * n, "0")
    li = W.numbered(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), [], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "place")
    return li.select((F.col("place") - 1).alias("idx"), F.unhex(F.concat(part("l_orderkey", 8), part("l_linenumber", 4), part("l_partkey", 8), part("l_quantity", 4))).alias("record"))


def _line_file(spark, sf):
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}.bin"
    record_files.write(_line_records(spark, sf), path, 24, b"line items 1")
    return path


def s7_record_file(spark, sf):
    """One record file of all line items, written by all tasks and read by many, with the numbers of each record."""
    rows = record_files.read(spark, _line_file(spark, sf), 24, 12, split=24_000)
    number = lambda at, n: F.conv(F.hex(F.substring("record", at, n)), 16, 10).cast("long")
    return rows.select("idx", number(1, 8).alias("orderkey"), number(9, 4).alias("linenumber"), number(13, 8).alias("partkey"), number(21, 4).alias("quantity"))


def k9_ledger(spark, sf):
    """Size, digest and tree digest, by blocks of 4,096 bytes, of a file made from all line items."""
    return sinks.ledger(spark, _line_file(spark, sf), block=4096).select("size_bytes", "sha256", "blocks", "tree_sha256")


_LINES = "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx FROM lineitem"
_LEDGER = f"""WITH r AS (SELECT idx, lpad(hex(l_orderkey), 16, '0') || lpad(hex(l_linenumber), 8, '0') || lpad(hex(l_partkey), 16, '0') || lpad(hex(l_quantity::BIGINT), 8, '0') AS record FROM ({_LINES})),
f AS MATERIALIZED (SELECT hex('line items 1'::BLOB) || string_agg(record, '' ORDER BY idx) AS content FROM r),
b AS (SELECT k, sha256(unhex(substr(content, k * 8192 + 1, 8192))) AS leaf FROM f, LATERAL (SELECT unnest(range(0, (length(content) + 8191) // 8192)) AS k))
SELECT length(content) // 2 AS size_bytes, sha256(unhex(content)) AS sha256, (SELECT count(*) FROM b) AS blocks, (SELECT sha256(string_agg(leaf, '' ORDER BY k)) FROM b) AS tree_sha256 FROM f"""


QUERIES: dict[str, Query] = {
    "s7_record_file": Query(s7_record_file, f"SELECT idx, l_orderkey::BIGINT AS orderkey, l_linenumber::BIGINT AS linenumber, l_partkey::BIGINT AS partkey, l_quantity::BIGINT AS quantity FROM ({_LINES})"),
    "k9_ledger": Query(k9_ledger, _LEDGER),
    "f18_f19_sweep_rows": Query(
        f18_f19_sweep_rows,
        _SHAPES + """SELECT 'p' || o_orderkey AS claim_id, k_sq, r_inner, r_outer, width, verdict, CASE verdict WHEN 'SPANNING' THEN 'ANY-SPAN' WHEN 'MOAT' THEN 'ANY-SHELL-MOAT' END AS verdict_mode,
  CASE verdict WHEN 'SPANNING' THEN 'ANY_SPAN_DETECTED' WHEN 'MOAT' THEN 'ANY_SHELL_MOAT_DETECTED' ELSE 'UNKNOWN_DETECTOR_STATUS' END AS detector_status, CASE WHEN post = 'SPAN_PROOF_PASS' THEN post ELSE 'CLAIM_PROOF_MISSING' END AS proof_status, post AS postflight_status,
  CASE post WHEN 'REJECT' THEN 'REJECT' WHEN 'SPAN_PROOF_PASS' THEN 'RUN_CONTRACT_PASS' END AS run_contract_status, active_tiles, produced_tiles, overflow_total, bad AS bz_bad_norm_count, total_seconds, telemetry_level, "commit" FROM n""",
    ),
    "k7_matrix_rows": Query(
        k7_matrix_rows,
        _SHAPES + """SELECT 'p' || o_orderkey AS claim_id, coalesce(k_sq = 36, false) AS hardening, coalesce(verdict, 'MISSING') AS verdict, coalesce(post, 'MISSING') AS postflight_status, CASE bad WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'MISSING' END AS bz_status,
  CASE WHEN overflow_total IS NULL THEN 'MISSING' WHEN overflow_total = 0 THEN 'PASS' ELSE 'FAIL' END AS overflow_status, CASE WHEN telemetry_level IS NOT NULL THEN 'PRESENT' ELSE 'MISSING' END AS stats_v2_status FROM n""",
    ),
    "w4_a12_monotonicity": Query(
        w4_a12_monotonicity,
        _SHAPES + """, m AS (SELECT k_sq, r_inner, min(width) AS w0 FROM n WHERE verdict = 'MOAT' AND k_sq = 36 GROUP BY 1, 2)
SELECT n.k_sq, n.r_inner, w0 AS narrower_width, width AS wider_width FROM n JOIN m ON m.k_sq = n.k_sq AND m.r_inner = n.r_inner WHERE verdict = 'SPANNING' AND width > w0""",
    ),
    "r_rules": Query(r_rules, _RULES),
    "r_rules_whole": Query(r_rules_whole, _WHOLE_RULES),
    "a11_whole_sums": Query(a11_whole_sums, "SELECT l_orderkey, sum(l_linenumber + l_partkey + l_suppkey - 1)::BIGINT AS total, 4 * count(*) AS numbers FROM lineitem GROUP BY l_orderkey"),
    "s4_regions": Query(
        s4_regions,
        """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 4 THEN 'a column is inverted' END, CASE WHEN o_orderkey % 4 = 0 THEN 'columns leave a gap or pass the box' END], lambda x: x IS NOT NULL), '; ') AS errors FROM orders""",
    ),
    "s12_log_fields": Query(
        s12_log_fields,
        """SELECT path, field, min(v) AS value, count(*) AS "count" FROM (SELECT 'log' || user_id AS path, unnest(['kind', 'k']) AS field, unnest([event_type, regexp_extract(props, '"k": (\\d+)', 1)]) AS v FROM events) WHERE v <> '' GROUP BY 1, 2""",
    ),
    "k6_sweep_lines": Query(
        k6_sweep_lines,
        """SELECT '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || ',"segment":' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}' AS value FROM customer""",
    ),
    "k7_report_lines": Query(k7_report_lines, "SELECT '| ' || s_suppkey || ' | ' || CASE WHEN s_nationkey <> 3 THEN s_nationkey::VARCHAR ELSE 'None' END || ' | ' || s_name || ' |' AS value FROM supplier"),
    "f11_records": Query(f11_records, _records_sql()),
    "f23_encoded": Query(f23_encoded, _encoded_sql()),
    "k11_layers": Query(k11_layers, _golden_layers_sql()),
    "f23_old_records": Query(f23_old_records, _OLD.replace(" AS x ", " AS first_height ")),
    "p15_pruned": Query(
        p15_pruned,
        """WITH d AS (SELECT DISTINCT l_orderkey AS j, substr('IOLR', l_linenumber % 4 + 1, 1) AS face, l_linenumber AS ordinal, l_suppkey % 3 + 1 AS label FROM lineitem)
SELECT j, face, ordinal, dense_rank() OVER (PARTITION BY j ORDER BY label) AS label FROM (SELECT *, count(*) OVER (PARTITION BY j, label) AS n FROM d) WHERE n > 1""",
    ),
    "k5_certificate_points": Query(k5_certificate_points, "SELECT 0 AS unknown, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey::BIGINT * 2 AS a, c_custkey::BIGINT * 3 AS b FROM customer"),
    "k11_golden": Query(k11_golden, _golden_sql()),
    "s6_s7_snapshot": Query(s6_s7_snapshot, _snapshot_sql()),
    "s10_json_lines": Query(s10_json_lines, "SELECT row_number() OVER (ORDER BY c_custkey) AS line_number, CASE c_custkey % 10 WHEN 5 THEN ' not an object' WHEN 7 THEN ' not JSON' END AS error FROM customer QUALIFY c_custkey % 10 <> 3"),
    "s11_run_index": Query(s11_run_index, "SELECT s_suppkey, s_name FROM supplier"),
    "j8_offset_matches": Query(j8_offset_matches, _OFFSETS),
    "j13_sample_audit": Query(j13_sample_audit, _audit_sql()),
    "g11_stitch_paths": Query(g11_stitch_paths, _PATHS),
    "w4_status_reversals": Query(w4_status_reversals, "SELECT e.user_id, event_id, narrower FROM events e JOIN (SELECT user_id, min(event_id) AS narrower FROM events WHERE event_type = 'error' GROUP BY 1) m ON m.user_id = e.user_id WHERE event_type = 'purchase' AND event_id > narrower"),
}
