"""Queries of the operators over the standard tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticeflow.lineage import cut
from latticeflow.operators import aggregates as A
from latticeflow.operators import contract, normalise
from latticeflow.operators import sampling as S
from latticeflow.operators import setops as U
from latticeflow.operators import windows as W
from latticeflow.operators.components import components, label_vertices
from latticeflow.operators.verdict import component_reach, verdict
from latticeflow.queries import Query, table


def a1_first_orders(spark, sf):
    return A.representatives(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])


def a2_joined_flags(spark, sf):
    bit = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4)
    return A.joined_flags(table(spark, sf, "lineitem").select("l_orderkey", bit.cast("long").alias("flags")), ["l_orderkey"], "flags")


def a4_popcounts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.popcount(F.col("p_partkey")).cast("long").alias("bits"))


def a5_histogram(spark, sf):
    q = table(spark, sf, "lineitem").select("l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return A.histogram(q, "q", ["l_linestatus"])


def a5_distribution(spark, sf):
    q = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return A.distribution(q, "q", ["l_returnflag", "l_linestatus"])


def a8_overshoot(spark, sf):
    batches = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("actual")).withColumn("target", F.lit(4).cast("long"))
    return A.overshoot(batches, "target", "actual")


def a9_quotas(spark, sf):
    samples = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sample_class"))
    quotas = spark.createDataFrame([("1-URGENT", 10, False), ("5-LOW", 1_000_000_000, False), ("6-NONE", 5, True), ("7-NONE", 1, False)], "sample_class string, target long, exhausted boolean")
    return A.quota_status(samples, quotas)


def a10_duplicates(spark, sf):
    return A.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


def a12_a15_rates(spark, sf):
    by = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "X").alias("none"))
    return by.select("l_suppkey", A.rounded(A.rate(F.col("rows"), F.col("returned")), 6).alias("rate"), A.percent(F.col("returned"), F.col("rows")).alias("share"), A.percent(F.col("returned"), F.col("none")).alias("nothing"))


def a13_messages(spark, sf):
    rules = {"small": F.col("n_chars") >= 500, "not English": F.col("lang") == "en", "odd": F.col("doc_id") % 2 == 0}
    found = A.messages(rules)
    status = F.when(F.size(found) == 0, "PASS").when(F.size(found) > 1, "REJECT").otherwise("WARN")
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, "; ").alias("errors"), status.alias("status"))


def a14_digests(spark, sf):
    rows = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")
    return A.digest(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], rows, chunk=1000)


def w1_prefix_sums(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return W.prefix_sums(daily, ["o_orderstatus"], ["day"], "n").select(F.col("day").cast("string").alias("day"), "o_orderstatus", "n", "before")


def w2_compacted(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    return W.compacted(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_shipdate"], F.col("l_returnflag") == "R", "slot").groupBy("l_orderkey").agg(F.max("slot").cast("long").alias("last_slot"), F.count(F.lit(1)).alias("kept"))


def w3_first_appearance(spark, sf):
    return W.first_appearance(table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderpriority", "o_custkey", F.col("label").cast("long").alias("label"))


def w4_reversals(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return W.reversals(o, ["o_custkey"], "o_orderkey", "o_orderstatus", "P", "F").select("o_custkey", "o_orderkey", "narrower")


def w5_ordinals(spark, sf):
    return W.ordinals(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


def w7_islands(spark, sf):
    return W.islands(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey").select("o_orderstatus", "first", "last", "size")


def w8_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    apart = F.col("ts") > F.col("prev_ts") + F.expr("INTERVAL 30 MINUTES")
    return W.gap_clusters(e, ["user_id"], ["ts", "event_id"], apart, "session").groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def w9_broken_steps(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("a"), (F.col("l_partkey") % 50).alias("b"), "l_partkey")
    one = p.groupBy("l_orderkey", "n").agg(F.min(F.struct("a", "b")).alias("p")).select("l_orderkey", "n", "p.*")
    return W.broken_steps(one, ["l_orderkey"], "n", "a", "b", 900).select("l_orderkey", "n", "step_sq")


def w10_slowdown(spark, sf):
    """Progress of each order status in intervals of a thousand orders: its items, and their quantity as time."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus", F.lit(1).alias("items"))
    told = W.interval_slowdown(li, ["l_linestatus"], "l_orderkey", 1000, "items", "l_quantity")
    return told.select("l_linestatus", "interval", F.col("amount").cast("long").alias("amount"), A.rounded(F.col("rate"), 9).alias("rate"), A.rounded(F.col("slowdown"), 9).alias("slowdown"))


def t3_top_rows(spark, sf):
    d = F.desc
    return S.top(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), [d("l_quantity"), d("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 32)


def t4_bottom_k(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", S.hexadecimal(S.mixed(F.col("o_orderkey"), 7)).alias("h"))
    return S.bottom_k(rows, ["o_orderpriority"], [F.col("h"), F.col("o_orderkey")], 20).select("o_orderpriority", "o_orderkey", "h", F.col("place").cast("long").alias("place"))


def t5_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", S.hexadecimal(S.mixed(F.col("o_orderkey"), 1)).alias("h"))
    members = {"final": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT", "random": F.lit(True)}
    order = {"final": [F.col("h")], "urgent": [F.desc("o_totalprice")], "random": [F.col("h")]}
    return S.stratified(o, ["o_orderkey"], members, {k: [x if k != "urgent" else -F.col("o_totalprice") for x in v] for k, v in order.items()}, 60).select("o_orderkey", "sample_class")


def t6_first_n(spark, sf):
    return S.top(table(spark, sf, "supplier").select("s_suppkey", "s_name"), [F.asc("s_suppkey")], 10)


def t7_evenly(spark, sf):
    return S.evenly(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 7)


def t8_nulls_last(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_orderkey")
    return rows.orderBy(*S.nulls_last("status", "o_orderkey"))


def u1_union_distinct(spark, sf):
    li = table(spark, sf, "lineitem")
    return U.union_distinct([li.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), li.where("l_linestatus = 'F'").select("l_partkey", "l_suppkey")], ["l_partkey", "l_suppkey"])


def u2_intersection(spark, sf):
    o = table(spark, sf, "orders")
    return U.intersection(o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


def u3_missing(spark, sf):
    return U.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")))


def u4_unknown_fields(spark, sf):
    fields = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", U.unknown_fields(fields, ["a", "b"]).alias("unknown")).select("event_id", F.array_join("unknown", ",").alias("unknown"))


def u5_allowed(spark, sf):
    return table(spark, sf, "events").select("event_id", U.allowed(F.col("event_type"), ["click", "view"]).alias("ok"))


def u6_label_union(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("x"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("y"))
    return g.select("o_custkey", F.array_join(F.array_sort(U.label_union(F.col("x"), F.col("y"))), "").alias("labels"))


def j10_positional(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    by_key = W.ordinals(o, ["o_custkey"], ["o_orderkey"])
    by_price = W.ordinals(o, ["o_custkey"], ["o_totalprice", "o_orderkey"])
    return U.zipped(by_key, by_price, ["o_custkey", "ordinal"]).select(F.col("left.o_orderkey").alias("left_key"), F.col("right.o_orderkey").alias("right_key"))


def j11_consistency(spark, sf):
    o = table(spark, sf, "orders")
    other = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("o_custkey"))
    return U.differences(o.select("o_orderkey", "o_orderstatus", "o_custkey"), other, "o_orderkey", ["o_orderstatus", "o_custkey"]).select("o_orderkey", F.array_join("fields", ",").alias("fields"))


def j12_snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")
    old = o.select("o_orderkey", F.col("o_orderstatus").alias("payload"))
    new = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "Z").otherwise(F.col("o_orderstatus")).alias("payload"))
    return U.snapshot_diff(old, new, ["o_orderkey"], "payload").select("o_orderkey", "change")


def _supplier_links(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), "l_partkey", "l_shipdate", "l_quantity")
    by = ["l_partkey", "l_shipdate", "l_quantity"]
    return li.join(li.groupBy(*by).agg(F.min("s").alias("a")), by).select("a", F.col("s").alias("b")).where("a <> b")


def j1_equi_graph(spark, sf):
    """Suppliers joined by items of the same part and quantity shipped on the same day."""
    links = _supplier_links(spark, sf)
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") == 3, 1).when(F.col("s_nationkey") == 7, 2).otherwise(0).alias("reach"))
    return label_vertices(v, cut(links)).select(F.col("id").alias("s_suppkey"), "component")


def g3_graph_verdict(spark, sf):
    """Whether a component of the same graph holds two given nations."""
    links = _supplier_links(spark, sf)
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") == 3, 1).when(F.col("s_nationkey") == 7, 2).otherwise(0).alias("reach"))
    return verdict(component_reach(label_vertices(v, cut(links))))


def g1_customer_components(spark, sf):
    """Customers joined by orders of the same day, status and priority."""
    by = ["o_orderdate", "o_orderstatus", "o_orderpriority"]
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), *by)
    links = cut(o.join(o.groupBy(*by).agg(F.min("c").alias("a")), by).select("a", F.col("c").alias("b")).distinct())
    return components(links).select(F.col("node").alias("c_custkey"), "component")


def f14_f13_parameter_digest(spark, sf):
    text = F.concat(F.lit("K="), F.col("p_size").cast("string"), F.lit(";P="), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.sha2(text, 256).alias("digest"))


def f15_mixing_hash(spark, sf):
    """Hashes of customers as tiles in the run of their nation, each with the run's own seed."""
    c = table(spark, sf, "customer")
    r = F.col("c_nationkey")
    seed = S.run_seed(F.lit(36), r, r + 100, F.col("c_mktsegment"))
    told = c.select("c_custkey", seed.alias("seed"), *[S.sample_hash(F.col("c_custkey"), r, r, r + 100, seed, k).alias(f"h{k}") for k in (0, 5)])
    return told.select("c_custkey", *[S.hexadecimal(F.col(x)).alias(x) for x in ("seed", "h0", "h5")])


def f19_status_words(spark, sf):
    verdict = F.when(F.col("o_orderstatus") == "F", "SPANNING").when(F.col("o_orderstatus") == "O", "MOAT")
    level = contract.rank(F.col("o_orderpriority"), ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return table(spark, sf, "orders").select("o_orderkey", normalise.detector_status(verdict).alias("status"), level.alias("level"))


def f18_json_values(spark, sf):
    k = F.coalesce(F.get_json_object("props", "$.kk").try_cast("long"), F.get_json_object("props", "$.k").try_cast("long"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"), F.max(k).alias("most"))


def a11_json_sums(spark, sf):
    return table(spark, sf, "events").select("event_id", A.summed_map(F.from_json("props", "map<string,bigint>")).alias("total"))


def s1_months(spark, sf):
    """A generated range against counts: months of the order dates, also those without late orders."""
    o = table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("month"))
    ends = o.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    late = table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(late, "month", "left").select(F.col("month").cast("string").alias("month"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_TWO64 = "18446744073709551616::UHUGEINT"


def _mixed_sql(*parts: str, start: str = "11400714819323198485") -> str:
    """The golden-ratio mix in whole numbers of 128 bits."""
    numbers = ", ".join(f"({p})::UBIGINT" for p in parts)
    return f"list_reduce([{start}::UBIGINT, {numbers}], lambda h, v: xor(h, ((v::UHUGEINT + 11400714819323198485::UHUGEINT + (h::UHUGEINT * 64) % {_TWO64} + (h >> 2)::UHUGEINT) % {_TWO64})::UBIGINT))"


def _digits_sql(h: str) -> str:
    return f"lpad(lower(hex({h})), 16, '0')"


def _text_hash_sql(text: str) -> str:
    return f"list_reduce(list_concat([1469598103934665603::UBIGINT], list_transform(range(1, length({text}) + 1), lambda k: ascii({text}[k])::UBIGINT)), lambda h, v: ((xor(h, v)::UHUGEINT * 1099511628211::UHUGEINT) % {_TWO64})::UBIGINT)"


_GRAPH = """WITH RECURSIVE li AS (SELECT l_suppkey AS s, l_partkey AS p, l_shipdate AS d, l_quantity AS q FROM lineitem),
e AS (SELECT x.s AS x, y.s AS y FROM (SELECT p, d, q, min(s) AS s FROM li GROUP BY p, d, q) x JOIN li y USING (p, d, q) WHERE x.s <> y.s),
linked AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT x, y FROM e UNION ALL SELECT y, x FROM e)),
labelled(id, component) USING KEY (id) AS (
  SELECT s_suppkey, s_suppkey FROM supplier
  UNION SELECT e.x, min(l.component) FROM labelled l JOIN linked e ON e.y = l.id JOIN recurring.labelled r ON r.id = e.x WHERE l.component < r.component GROUP BY e.x)
"""

QUERIES: dict[str, Query] = {
    "a1_first_orders": Query(a1_first_orders, "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1"),
    "a2_joined_flags": Query(a2_joined_flags, "SELECT l_orderkey, bit_or(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END::BIGINT) AS flags FROM lineitem GROUP BY 1"),
    "a4_popcounts": Query(a4_popcounts, "SELECT p_partkey, bit_count(p_partkey)::BIGINT AS bits FROM part"),
    "a5_histogram": Query(a5_histogram, 'SELECT l_linestatus, l_quantity::BIGINT AS value, count(*) AS "count" FROM lineitem GROUP BY 1, 2'),
    "a5_distribution": Query(
        a5_distribution,
        """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity::BIGINT AS q, row_number() OVER w AS place, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity))
SELECT l_returnflag, l_linestatus, max(n) AS "count", sum(q)::BIGINT AS "sum", min(q) AS "min", max(q) AS "max", min(q) FILTER (place = (n * 50 + 99) // 100) AS p50, min(q) FILTER (place = (n * 90 + 99) // 100) AS p90, min(q) FILTER (place = (n * 99 + 99) // 100) AS p99 FROM r GROUP BY 1, 2""",
    ),
    "a8_overshoot": Query(a8_overshoot, "SELECT count(*) AS batches, sum(n)::BIGINT AS total, max(greatest(n - 4, 0)) AS most_over FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"),
    "a9_quotas": Query(a9_quotas, "SELECT q.*, coalesce(n, 0) AS observed, coalesce(n, 0) >= target OR exhausted AS met FROM (VALUES ('1-URGENT', 10::BIGINT, false), ('5-LOW', 1000000000, false), ('6-NONE', 5, true), ('7-NONE', 1, false)) q(sample_class, target, exhausted) LEFT JOIN (SELECT o_orderpriority AS sample_class, count(*) AS n FROM orders GROUP BY 1) USING (sample_class)"),
    "a10_duplicates": Query(a10_duplicates, 'SELECT l_orderkey, l_partkey, count(*) AS "count" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1'),
    "a12_a15_rates": Query(
        a12_a15_rates,
        "SELECT l_suppkey, round(CASE WHEN r > 0 THEN n::DOUBLE / r END, 6) AS rate, format('{:.2f}%', 100.0 * r / n) AS share, 'n/a' AS nothing FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)",
    ),
    "a13_messages": Query(
        a13_messages,
        "SELECT doc_id, array_to_string(e, '; ') AS errors, CASE WHEN len(e) = 0 THEN 'PASS' WHEN len(e) > 1 THEN 'REJECT' ELSE 'WARN' END AS status FROM (SELECT doc_id, list_filter([CASE WHEN n_chars < 500 THEN 'small' END, CASE WHEN lang <> 'en' THEN 'not English' END, CASE WHEN doc_id % 2 <> 0 THEN 'odd' END], lambda x: x IS NOT NULL) AS e FROM documents)",
    ),
    "a14_digests": Query(
        a14_digests,
        """WITH p AS (SELECT o_orderpriority, o_orderkey || '|' || o_orderstatus AS t, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS place FROM orders),
c AS (SELECT o_orderpriority, place // 1000 AS part, count(*) AS n, sha256(string_agg(t, chr(10) ORDER BY place)) AS h FROM p GROUP BY 1, 2)
SELECT o_orderpriority, sum(n)::BIGINT AS "rows", sha256(string_agg(h, chr(10) ORDER BY part)) AS digest FROM c GROUP BY 1""",
    ),
    "w1_prefix_sums": Query(w1_prefix_sums, "SELECT day::VARCHAR AS day, o_orderstatus, n, coalesce(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT o_orderdate::DATE AS day, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)"),
    "w2_compacted": Query(w2_compacted, "SELECT l_orderkey, count(*) - 1 AS last_slot, count(*) AS kept FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
    "w3_first_appearance": Query(w3_first_appearance, "SELECT o_orderpriority, o_custkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY d, k) AS label FROM (SELECT o_orderpriority, o_custkey, o_orderdate AS d, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1"),
    "w4_reversals": Query(w4_reversals, "SELECT o.o_custkey, o_orderkey, narrower FROM orders o JOIN (SELECT o_custkey, min(o_orderkey) AS narrower FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) m ON m.o_custkey = o.o_custkey WHERE o_orderstatus = 'F' AND o_orderkey > narrower"),
    "w5_ordinals": Query(w5_ordinals, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders"),
    "w7_islands": Query(w7_islands, 'SELECT o_orderstatus, min(o_orderkey) AS "first", max(o_orderkey) AS "last", count(*) AS size FROM (SELECT o_orderstatus, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS run FROM orders) GROUP BY o_orderstatus, run'),
    "w8_sessions": Query(
        w8_sessions,
        """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM s)
SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY 1, 2""",
    ),
    "w9_broken_steps": Query(
        w9_broken_steps,
        """WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS a, l_partkey % 50 AS b FROM lineitem), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, n ORDER BY a, b) AS r FROM p) WHERE r = 1),
s AS (SELECT l_orderkey, n, (a - lag(a) OVER w) * (a - lag(a) OVER w) + (b - lag(b) OVER w) * (b - lag(b) OVER w) AS step_sq FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
SELECT * FROM s WHERE step_sq > 900""",
    ),
    "w10_slowdown": Query(w10_slowdown, "SELECT l_linestatus, interval, n AS amount, round(rate, 9) AS rate, round(first(rate) OVER (PARTITION BY l_linestatus ORDER BY interval) / rate, 9) AS slowdown FROM (SELECT l_linestatus, l_orderkey // 1000 AS interval, count(*) AS n, count(*)::DOUBLE / sum(l_quantity)::DOUBLE AS rate FROM lineitem GROUP BY 1, 2)".replace("interval", '"interval"')),
    "t3_top_rows": Query(t3_top_rows, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 32"),
    "t4_bottom_k": Query(t4_bottom_k, f"SELECT * FROM (SELECT o_orderpriority, o_orderkey, h, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS place FROM (SELECT *, {_digits_sql(_mixed_sql('o_orderkey', '7'))} AS h FROM orders)) WHERE place <= 20"),
    "t5_stratified": Query(
        t5_stratified,
        f"""WITH o AS (SELECT *, {_digits_sql(_mixed_sql('o_orderkey', '1'))} AS h FROM orders),
a AS (SELECT o_orderkey FROM o WHERE o_orderstatus = 'F' ORDER BY h, o_orderkey LIMIT 20),
b AS (SELECT o_orderkey FROM o WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY -o_totalprice, o_orderkey LIMIT 20),
c AS (SELECT o_orderkey FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) AND o_orderkey NOT IN (SELECT o_orderkey FROM b) ORDER BY h, o_orderkey LIMIT 20)
SELECT o_orderkey, 'final' AS sample_class FROM a UNION ALL SELECT o_orderkey, 'urgent' FROM b UNION ALL SELECT o_orderkey, 'random' FROM c""",
    ),
    "t6_first_n": Query(t6_first_n, "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 10"),
    "t7_evenly": Query(t7_evenly, "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 = 0"),
    "t8_nulls_last": Query(t8_nulls_last, "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderkey FROM orders ORDER BY status NULLS LAST, o_orderkey"),
    "u1_union_distinct": Query(u1_union_distinct, "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'"),
    "u2_intersection": Query(u2_intersection, "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "u3_missing": Query(u3_missing, "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "u4_unknown_fields": Query(u4_unknown_fields, "SELECT event_id, coalesce(array_to_string(list_filter(json_keys(props), lambda x: x NOT IN ('a', 'b')), ','), '') AS unknown FROM events"),
    "u5_allowed": Query(u5_allowed, "SELECT event_id, event_type IN ('click', 'view') AS ok FROM events"),
    "u6_label_union": Query(u6_label_union, "SELECT o_custkey, string_agg(x, '' ORDER BY x) AS labels FROM (SELECT o_custkey, o_orderstatus AS x FROM orders UNION SELECT o_custkey, o_orderpriority[1:1] FROM orders) GROUP BY 1"),
    "j10_positional": Query(
        j10_positional,
        """WITH p AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), q AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders)
SELECT p.o_orderkey AS left_key, q.o_orderkey AS right_key FROM p FULL JOIN q USING (o_custkey, n)""",
    ),
    "j11_consistency": Query(
        j11_consistency,
        "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 11 = 0 AND o_orderstatus <> 'X' THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 13 = 0 THEN 'o_custkey' END], lambda x: x IS NOT NULL), ',') AS fields FROM orders WHERE (o_orderkey % 11 = 0 AND o_orderstatus <> 'X') OR o_orderkey % 13 = 0",
    ),
    "j12_snapshot_diff": Query(j12_snapshot_diff, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'"),
    "j1_equi_graph": Query(j1_equi_graph, _GRAPH + "SELECT id AS s_suppkey, component FROM labelled"),
    "g3_graph_verdict": Query(g3_graph_verdict, _GRAPH + "SELECT CASE WHEN bool_or(x = 3) THEN 'SPANNING' ELSE 'MOAT' END AS verdict FROM (SELECT component, bit_or(CASE s_nationkey WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END) AS x FROM labelled JOIN supplier ON s_suppkey = id GROUP BY component)"),
    "g1_customer_components": Query(
        g1_customer_components,
        """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderdate AS d, o_orderstatus AS s, o_orderpriority AS p FROM orders),
e AS (SELECT DISTINCT x.c AS x, y.c AS y FROM (SELECT d, s, p, min(c) AS c FROM o GROUP BY d, s, p) x JOIN o y USING (d, s, p) WHERE x.c <> y.c),
linked AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
labelled(id, component) USING KEY (id) AS (
  SELECT DISTINCT x, x FROM linked
  UNION SELECT e.x, min(l.component) FROM labelled l JOIN linked e ON e.y = l.id JOIN recurring.labelled r ON r.id = e.x WHERE l.component < r.component GROUP BY e.x)
SELECT id AS c_custkey, component FROM labelled WHERE id <> component""",
    ),
    "f14_f13_parameter_digest": Query(f14_f13_parameter_digest, "SELECT p_partkey, sha256('K=' || p_size || ';P=' || p_partkey) AS digest FROM part"),
    "f15_mixing_hash": Query(f15_mixing_hash, f"""SELECT c_custkey, {_digits_sql('seed')} AS seed, {_digits_sql(_mixed_sql('seed', '0', 'c_custkey', 'r', 'r', 'r + 100'))} AS h0, {_digits_sql(_mixed_sql('seed', '5', 'c_custkey', 'r', 'r', 'r + 100'))} AS h5 FROM (
SELECT c_custkey, r, {_mixed_sql('36', 'r', 'r + 100', '256', '0', '0', start='t')} AS seed FROM (SELECT c_custkey, c_nationkey AS r, {_text_hash_sql('c_mktsegment')} AS t FROM customer))"""),
    "f19_status_words": Query(f19_status_words, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ANY_SPAN_DETECTED' WHEN 'O' THEN 'ANY_SHELL_MOAT_DETECTED' ELSE 'UNKNOWN_DETECTOR_STATUS' END AS status, (list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) - 1)::BIGINT AS level FROM orders"),
    "f18_json_values": Query(f18_json_values, "SELECT event_type, sum(k)::BIGINT AS total, count(k) AS n, max(k) AS most FROM (SELECT event_type, coalesce(TRY_CAST(json_extract_string(props, '$.kk') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events) GROUP BY 1"),
    "a11_json_sums": Query(a11_json_sums, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS total FROM events"),
    "s1_months": Query(s1_months, "SELECT m::DATE::VARCHAR AS month, (SELECT count(*) FROM orders WHERE o_totalprice > 400000 AND date_trunc('month', o_orderdate) = m) AS n FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM orders)"),
}
