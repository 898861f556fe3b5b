"""The recursive walk against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from latticeflow.operators import walk


def document(rng, depth):
    kind = rng.randrange(9) if depth else rng.randrange(6)
    if kind == 0:
        return rng.choice([0, 1, -5, 10**19])
    if kind < 6:
        return [None, True, "text", 0.5, 0][kind - 1]
    n = rng.randrange(4)
    if kind == 6:
        return [document(rng, depth - 1) for _ in range(n)]
    return {f"k{i}": document(rng, depth - 1) for i in range(n)}


def plain(x, path, depth=0):
    kind = "null" if x is None else "boolean" if isinstance(x, bool) else "whole" if isinstance(x, int) else "number" if isinstance(x, float) else {str: "string", list: "array", dict: "object"}[type(x)]
    yield path, depth, kind, len(x) if isinstance(x, list | dict) else None
    for k, c in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from plain(c, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]", depth + 1)


def test_every_value_at_any_depth(spark):
    rng = random.Random(5)
    docs = [document(rng, 9) for _ in range(60)]
    for _ in range(25):
        docs[0] = {"deep": [docs[0]]}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "no json"), (100, None)], "id int, doc string")
    got = walk.nodes(df, ["id"], F.try_parse_json("doc"), "$").drop("value").collect()
    want = sorted((i, *n) for i, d in enumerate(docs) for n in plain(d, "$"))
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == want and max(w[2] for w in want) >= 50


def test_counters_at_fault(spark):
    docs = {"fine": {"a": 0, "b": {"c": 0}}, "one": {"a": 0, "b": {"c": 2, "d": -1}}, "empty": {"a": {}}, "all empty": {}, "kinds": {"a": "0", "b": 0.0, "c": None, "d": [1, {"e": 5}], "f": True}, "list": [0], "number": 0}
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()], "id string, doc string")
    got = {}
    for r in walk.counter_faults(df, ["id"], F.try_parse_json("doc"), "n").collect():
        got.setdefault(r.id, {})[r.path] = r.fault
    assert got == {
        "one": {"n.b.c": "not 0", "n.b.d": "negative"}, "empty": {"n.a": "empty"}, "all empty": {"n": "empty"},
        "kinds": {f"n.{k}": "no counter" for k in "abcdf"}, "list": {"n": "no object"}, "number": {"n": "no object"},
    }
