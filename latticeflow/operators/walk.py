"""Recursive walk of JSON documents (R3, A11, F18): one row per value, at any depth.

A document's values are taken apart level by level within its row, ``LEVELS`` at a time; what is deeper goes on in a
further step, until no container is left.  Each step is narrow: no shuffle, however deep documents are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeflow.functions import variants as V
from latticeflow.lineage import cut

LEVELS = 6


def _children(n: Column) -> Column:
    """The values directly within a value, as structs (path, depth, value)."""
    child = lambda path, x: F.struct(path.alias("path"), (n["depth"] + 1).alias("depth"), x.alias("value"))
    named = F.transform(F.map_entries(V.fields(n["value"])), lambda e: child(F.concat(n["path"], F.lit("."), e["key"]), e["value"]))
    listed = F.transform(V.items(n["value"]), lambda x, i: child(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), x))
    return F.coalesce(named, listed, F.filter(F.array(n), lambda _: F.lit(False)))


def nodes(docs: DataFrame, id_columns: list[str], value: Column, root: str) -> DataFrame:
    """(ids, path, depth, kind, size, value) of all values of the variants ``value``, the outermost at path ``root``.

    ``size`` is the number of values directly within an object or array, null for others.  Rows without a value
    have no nodes.
    """
    rows = docs.select(*id_columns, F.struct(F.lit(root).alias("path"), F.lit(0).alias("depth"), value.alias("value")).alias("node")).where("node.value IS NOT NULL")
    found = []
    while True:
        step = rows.select(*id_columns, F.array("node").alias("level_0"))
        for k in range(LEVELS):
            step = step.withColumn(f"level_{k + 1}", F.flatten(F.transform(f"level_{k}", _children)))
        found.append(step.select(*id_columns, F.explode(F.concat(*[F.col(f"level_{k}") for k in range(LEVELS)])).alias("node")))
        rows = cut(step.where(F.size(f"level_{LEVELS}") > 0).select(*id_columns, F.explode(f"level_{LEVELS}").alias("node")))
        if rows.isEmpty():
            break
    every = reduce(DataFrame.unionByName, found)
    x = F.col("node.value")
    size = F.when(V.is_kind(x, "OBJECT"), F.size(V.fields(x))).when(V.is_kind(x, "ARRAY"), F.size(V.items(x)))
    return every.select(*id_columns, "node.path", "node.depth", V.kind(x).alias("kind"), size.alias("size"), x.alias("value"))


#: Texts of JSON and keys, as variants are spelt: quotes within are escaped.
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def counters_at_fault(value: Column, root: str) -> Column:
    """(path, fault) of a variant's counters that aren't 0: nested objects whose leaves must be the whole number 0.

    An array is a fault itself, whatever it holds.  All within the row: the steps are as many as objects are nested.
    Sound counters are told by their text, which without its keys is all braces and zeros; 0.0 is spelt 0, too, but no
    whole number.
    """
    spelt = F.try_variant_get(value, "$", "string")
    bare = F.regexp_replace(spelt, f"{_TEXT}:", "")
    sound = V.is_kind(value, "OBJECT") & bare.rlike(r"^\{[{},0]*+$") & ~bare.contains("{}") & ~F.schema_of_variant(value).contains("DECIMAL")
    braces = F.split(F.regexp_replace(F.regexp_replace(spelt, _TEXT, ""), "[^{}]", ""), "")
    step = lambda t, c: F.struct((t["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"), F.greatest(t["most"], t["now"]).alias("most"))
    nested = F.aggregate(braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]
    node = lambda path, x: F.struct(path.alias("path"), x.alias("value"))

    def fault(n: Column) -> Column:
        inside = V.fields(n["value"])
        told = F.when(inside.isNotNull(), F.when(F.size(inside) == 0, "empty")).when(n["path"] == root, "no object")
        told = told.when(V.whole(n["value"]) < 0, "negative").when(V.whole(n["value"]) > 0, "not 0").when(V.whole(n["value"]).isNull(), "no counter")
        return F.struct(n["path"].alias("path"), told.alias("fault"))

    def within(n: Column) -> Column:
        return F.coalesce(F.transform(F.map_entries(V.fields(n["value"])), lambda e: node(F.concat(n["path"], F.lit("."), e["key"]), e["value"])), none)

    first = F.array(node(F.lit(root), value))
    none = F.filter(first, lambda _: F.lit(False))
    found = lambda level: F.filter(F.transform(level, fault), lambda f: f["fault"].isNotNull())
    walked = F.aggregate(
        F.sequence(F.lit(0), F.coalesce(nested, F.lit(0))), F.struct(first.alias("level"), found(none).alias("faults")),
        lambda t, _: F.struct(F.flatten(F.transform(t["level"], within)).alias("level"), F.concat(t["faults"], found(t["level"])).alias("faults")),
        lambda t: t["faults"],
    )
    return F.when(value.isNotNull() & ~F.coalesce(sound, F.lit(False)), walked)


def counter_faults(docs: DataFrame, id_columns: list[str], value: Column, root: str) -> DataFrame:
    """(ids, path, fault) of counters that aren't 0, see :func:`counters_at_fault`."""
    return docs.select(*id_columns, F.inline(counters_at_fault(value, root)))


def whole_sums(docs: DataFrame, id_columns: list[str], value: Column) -> DataFrame:
    """(ids, total, numbers): the sum of all whole numbers of a document, at any depth."""
    n = nodes(docs, id_columns, value, "$").where(V.whole(F.col("value")).isNotNull())
    return n.groupBy(*id_columns).agg(F.sum(V.whole(F.col("value"))).alias("total"), F.count(F.lit(1)).alias("numbers"))
