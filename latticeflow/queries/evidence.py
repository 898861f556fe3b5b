"""Queries of typed documents (S9) and of chains between two ends (G6, G7), over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from latticeflow.lineage import dealt
from latticeflow.operators import contract, trace
from latticeflow.operators.sampling import CLASSES
from latticeflow.params import Annulus
from latticeflow.plans import two_level
from latticeflow.queries import Query, table
from latticeflow.queries.sites import annulus, sites
from latticeflow.sources import sinks, typed

_RUN = '"k_sq":36,"r_inner":100,"r_outer":500'
#: A document of each kind; ``@`` stands for the customer's number, ``#`` for the width.
SOUND = {
    "manifest": '{"schema_version":1,"claim_id":"c@",' + _RUN + ',"width":#,"region":"full-octant","sample_count":@,"target_tile_samples":12,"selection":['
    + ",".join(f'{{"class":"{c}","target_count":2}}' for c in CLASSES) + '],"population_exhaustion":{"axis":true},"class_counts":{' + ",".join(f'"{c}":2' for c in CLASSES) + "}}",
    "sample": '{"schema_version":2,' + _RUN + ',"width":#,"region":"full-octant","sample_class":"axis","tile":{"i":4,"j":3,"a_lo":0,"b_lo":0},"tileop":{"n":[1,0,0,0],"face_groups":[1],"inner_flags":['
    + ",".join("0" * 16) + '],"outer_flags":[' + ",".join("0" * 16) + '],"tile_flags":0}}',
    "certificate": '{"schema_version":1,"claim_id":"c@",' + _RUN + ',"region":"full-octant","path":[{"a":1,"b":@},{"a":2,"b":@},{"a":3,"b":-1}]}',
    "profile": '{"radii":{' + _RUN + '},"verdict":"MOAT","tiles":{"active":@,"produced":4},"bz":{"checked":true,"clean":true,"override_used":false,"bad_norm_count":0},"timings_seconds":{"total":1.5,"scan":2},"hashes":{"grid":"'
    + "0a" * 32 + '"}}',
    "bundle": '{"schema_version":1,"row":{"claim_id":"c@",' + _RUN + ',"width":#,"region":"full-octant","verdict":"MOAT","verdict_mode":"ANY-SHELL-MOAT"},"profile":{},"bz":null}',
}
#: (kind, text to replace, text in its place, path, fault): the fault of the customers whose number leaves the entry's place.
PLANTED = [
    ("manifest", '"region":"full-octant"', '"region":"half"', "$.region", "unknown word"),
    ("manifest", '"sample_count":', '"sample_count":-', "$.sample_count", "below 0"),
    ("manifest", '"class":"diagonal","target_count":2', '"class":"diagonal","target_count":"2"', "$.selection[3].target_count", "not a whole number"),
    ("manifest", '"class":"diagonal"', '"class":"axis"', "$.selection", "a class twice"),
    ("manifest", '"class":"diagonal"', '"class":"axis"', "$.selection", "a class is missing"),
    ("manifest", '"axis":true', '"somewhere":true', "$.population_exhaustion.somewhere", "unknown field"),
    ("manifest", ',"geo_O":2', "", "$.class_counts.geo_O", "missing"),
    ("manifest", '"claim_id"', '"claim"', "$.claim_id", "missing"),
    ("manifest", '"k_sq":36', '"k_sq":4294967296', "$.k_sq", "above 4294967295"),
    ("sample", '"sample_class":"axis"', '"sample_class":7', "$.sample_class", "not a text"),
    ("sample", '"n":[1,', '"n":[256,', "$.tileop.n[0]", "above 255"),
    ("sample", '"inner_flags":[0,', '"inner_flags":[', "$.tileop.inner_flags", "fewer than 16"),
    ("sample", '"j":3', '"j":3.5', "$.tile.j", "not a whole number"),
    ("sample", '"face_groups":[1]', '"face_groups":{}', "$.tileop.face_groups", "not an array"),
    ("certificate", '{"a":2,', '{"a":2,"c":0,', "$.path[1].c", "unknown field"),
    ("certificate", '"b":-1', '"b":null', "$.path[2].b", "not a whole number"),
    ("certificate", '"schema_version":1,', '"schema_version":1,"schema_version":1,', "$", "not JSON"),
    ("certificate", '"region"', '"extra":0,"region"', "$.extra", "unknown field"),
    ("profile", '"clean":true', '"clean":"true"', "$.bz.clean", "not true or false"),
    ("profile", '"total":1.5', '"total":[]', "$.timings_seconds.total", "not a number"),
    ("profile", '"grid":"0a', '"grid":"0A', "$.hashes.grid", "wrong form"),
    ("profile", '"grid"', '"net"', "$.hashes.net", "unknown field"),
    ("profile", '"tiles":{', '"tiles":3,"more":{', "$.tiles", "not an object"),
    ("bundle", '"row":', '"rows":', "$.row", "missing"),
    ("bundle", '"profile":{},', "", "$.profile", "missing"),
    ("bundle", '"verdict":"MOAT"', '"verdict":"WALL"', "$.row.verdict", "unknown word"),
    ("bundle", '"schema_version":1', '"schema_version":0', "$.schema_version", "below 1"),
    ("bundle", "}", "", "$", "not JSON"),
]


def documents(spark, sf, spread=False):
    """Five documents per customer; many have one fault planted, those of nation 3 a wrong width besides.

    Customers without a market segment, if there are any, have no documents but rows.  ``spread``: dealt to all cores
    before the work on each.
    """
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = (dealt(c, "c_custkey") if spread else c).select(F.col("c_custkey").cast("long").alias("key"), (F.col("c_nationkey") == 3).alias("wide"), F.col("c_mktsegment").isNull().alias("gone"))
    place = F.pmod("key", F.lit(len(PLANTED)))
    made = []
    for kind, text in SOUND.items():
        width = F.when(F.col("wide"), "401").otherwise("400")
        doc = F.replace(F.replace(F.lit(text), F.lit("#"), width), F.lit("@"), F.col("key").cast("string"))
        swap = [(n, old, new) for n, (of, old, new, _, _) in enumerate(PLANTED) if of == kind]
        found, put = (reduce(lambda c, s: c.when(place == s[0], F.lit(s[k])), swap, F.when(F.lit(False), "")) for k in (1, 2))
        doc = F.coalesce(F.replace(doc, found, put), doc)
        made.append(F.struct(F.lit(kind).alias("kind"), F.when(~F.col("gone"), doc).alias("document")))
    return c.select("key", F.explode(F.array(*made)).alias("d")).select("key", "d.*")


def s9_document_faults(spark, sf):
    """Every fault by path, of manifests, samples, certificates, profiles and bundles at once."""
    told = typed.checked(documents(spark, sf, spread=True))
    return told.select("key", "kind", F.explode("faults").alias("f")).select("key", "kind", "f.path", "f.fault")


def s9_typed_manifests(spark, sf):
    """The typed values of sound manifests, and how many faults the others have."""
    told = typed.typed(documents(spark, sf, spread=True).where("kind = 'manifest'"), typed.MANIFEST)
    wanted = F.aggregate("row.selection", F.lit(0).cast("long"), lambda t, e: t + e["target_count"])
    return told.select("key", F.size("faults").alias("faults"), "row.claim_id", "row.r_outer", "row.sample_count", wanted.alias("targets"), F.size("row.class_counts").alias("classes"))


def k4_sample_manifest(spark, sf):
    """The manifest of a sample of orders, read back from its document: a class for each rest of the order's number."""
    o = table(spark, sf, "orders").select(F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("sample_class"), "o_orderstatus")
    chosen = o.where((F.col("o_orderstatus") == "F") | (F.col("sample_class") == CLASSES[5]))
    doc = sinks.sample_manifest(chosen, 1001, o.groupBy("sample_class").agg(F.count(F.lit(1)).alias("population")))
    shape = "sample_count long, class_counts map<string,long>, population_exhaustion map<string,struct<quota:long,observed:long,population:long,population_exhausted:boolean>>"
    read = doc.select(F.from_json("document", shape).alias("d"))
    return read.select(F.col("d.sample_count").alias("sample_count"), F.explode("d.population_exhaustion").alias("sample_class", "told"), "d.class_counts").select("sample_class", "sample_count", F.element_at("class_counts", F.col("sample_class")).alias("counted"), "told.*")


def k8_reports(spark, sf):
    """The reports of bundles from orders, by status and number of errors, read back from their documents."""
    row = F.struct(F.lit("c").alias("claim_id"), F.lit(36).alias("k_sq"), F.lit(100).alias("r_inner"), F.lit(500).alias("r_outer"), F.when(F.col("o_orderkey") % 7 == 0, 399).otherwise(400).alias("width"))
    bundles = dealt(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").cast("long").alias("bundle_id"), F.to_json(F.struct(row.alias("row"))).alias("bundle"))
    read = sinks.postflight_reports(contract.checked(bundles)).select("bundle_id", F.from_json("document", "schema_version int, status string, errors array<string>").alias("d"))
    return read.select("bundle_id", "d.schema_version", "d.status", F.exists("d.errors", lambda e: e.startswith("R1 width")).alias("wrong_width"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BROKEN = "VALUES " + ", ".join(f"({n}, {_quoted(kind)}, {_quoted(path)}, {_quoted(fault)})" for n, (kind, _, _, path, fault) in enumerate(PLANTED))
#: A class in place of another breaks two rules; the two entries of the list stand for either.
_FAULTS = f"""c AS (SELECT c_custkey::BIGINT AS key, c_nationkey = 3 AS wide, c_mktsegment IS NULL AS gone FROM customer), planted(n, kind, path, fault) AS ({_BROKEN}),
paired AS (SELECT * FROM planted UNION ALL SELECT CASE fault WHEN 'a class twice' THEN n + 1 ELSE n - 1 END, kind, path, fault FROM planted WHERE fault IN ('a class twice', 'a class is missing')),
whole(kind) AS (VALUES ('manifest'), ('sample'), ('certificate'), ('profile'), ('bundle')),
faults AS (
  SELECT key, kind, '$' AS path, 'missing' AS fault FROM c, whole WHERE gone
  UNION ALL SELECT key, kind, path, fault FROM c JOIN paired ON key % {len(PLANTED)} = n WHERE NOT gone
  UNION ALL SELECT key, w.kind, CASE w.kind WHEN 'bundle' THEN '$.row.width' ELSE '$.width' END, 'not the difference of the radii' FROM c JOIN whole w ON w.kind IN ('manifest', 'sample', 'bundle')
    WHERE wide AND NOT gone AND NOT EXISTS (SELECT 1 FROM planted p WHERE p.n = key % {len(PLANTED)} AND p.kind = w.kind AND (p.path = '$' OR p.path = '$.row'))
)"""


def _orders_and_parts(spark, sf):
    """Orders, and parts as negative numbers, joined by the line items."""
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), (-F.col("l_partkey").cast("long") - 1).alias("b"))


def g7_order_chain(spark, sf):
    """A shortest chain from the first to the last order through parts that they share, searched from both ends."""
    links = _orders_and_parts(spark, sf)
    end = lambda f: links.agg(f("a").alias("id"))
    path = trace.shortest_path(links, end(F.min), end(F.max), stored=True)
    return path.agg(F.count(F.lit(1)).alias("points"), F.min_by("id", "pos").alias("from_order"), F.max_by("id", "pos").alias("to_order"))


_CHAIN = """WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT l_orderkey AS a, -l_partkey - 1 AS b FROM lineitem), linked AS MATERIALIZED (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
walked(id, far) USING KEY (id) AS (
  SELECT min(l_orderkey), 0 FROM lineitem
  UNION
  SELECT e.y, min(w.far) + 1 FROM walked w JOIN linked e ON e.x = w.id LEFT JOIN recurring.walked r ON r.id = e.y WHERE r.id IS NULL GROUP BY e.y
)
SELECT coalesce((SELECT far + 1 FROM walked WHERE id = (SELECT max(l_orderkey) FROM lineitem)), 0)::BIGINT AS points, CASE WHEN reached THEN first_order END AS from_order, CASE WHEN reached THEN last_order END AS to_order
FROM (SELECT min(l_orderkey)::BIGINT AS first_order, max(l_orderkey)::BIGINT AS last_order, max(l_orderkey) IN (SELECT id FROM walked) AS reached FROM lineitem)"""


STEP = 400


def site_graph(spark, sf):
    """The line items' sites as a graph of tiles, with steps so long that the bands are joined."""
    q = annulus(spark, sf)
    return two_level.solve(spark, Annulus(STEP, q.r_inner, q.r_outer, 128), points=sites(spark, sf))


def g6_span_event(spark, sf):
    """The event that first spans among the line items' sites, and the first source of each band."""
    return trace.first_event(site_graph(spark, sf))


def g7_span_chain(spark, sf):
    """The groups from the first inner to the first outer source, over the link that joined them."""
    return trace.span_chain(site_graph(spark, sf))


QUERIES: dict[str, Query] = {
    "s9_document_faults": Query(s9_document_faults, f"WITH {_FAULTS} SELECT key, kind, path, fault FROM faults"),
    "s9_typed_manifests": Query(s9_typed_manifests, f"""WITH {_FAULTS}, n AS (SELECT key, count(*) AS n FROM faults WHERE kind = 'manifest' GROUP BY 1)
SELECT key, coalesce(n, 0)::INTEGER AS faults, CASE WHEN n IS NULL THEN 'c' || key END AS claim_id, CASE WHEN n IS NULL THEN 500::BIGINT END AS r_outer, CASE WHEN n IS NULL THEN key END AS sample_count,
  CASE WHEN n IS NULL THEN 12::BIGINT END AS targets, CASE WHEN n IS NULL THEN 6 END AS classes FROM c LEFT JOIN n USING (key)"""),
    "k4_sample_manifest": Query(k4_sample_manifest, f"""WITH o AS (SELECT [{", ".join(_quoted(c) for c in CLASSES)}][o_orderkey % 6 + 1] AS sample_class, o_orderkey % 6 = 5 OR o_orderstatus = 'F' AS chosen FROM orders),
n AS (SELECT sample_class, count(*) FILTER (chosen) AS observed, count(*) AS population FROM o GROUP BY 1)
SELECT sample_class, (sum(observed) OVER ())::BIGINT AS sample_count, CASE WHEN observed > 0 THEN observed END AS counted, CASE sample_class WHEN '{CLASSES[5]}' THEN 171 ELSE 166 END::BIGINT AS quota, observed, population, observed >= population AS population_exhausted FROM n"""),
    "k8_reports": Query(k8_reports, "SELECT o_orderkey::BIGINT AS bundle_id, 1 AS schema_version, 'REJECT' AS status, o_orderkey % 7 = 0 AS wrong_width FROM orders"),
    "g7_order_chain": Query(g7_order_chain, _CHAIN),
    "g6_span_event": Query(g6_span_event),
    "g7_span_chain": Query(g7_span_chain),
}
