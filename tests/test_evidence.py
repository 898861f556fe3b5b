"""Typed documents by path, chains found from both ends, first sources of a span."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from latticeflow.operators import trace
from latticeflow.params import Annulus
from latticeflow.plans import two_level
from latticeflow.queries import evidence
from latticeflow.sources import typed
from latticeflow.sources.typed import Any, Flag, Items, Named, Number, Record, Rule, Text, Whole

SF = "/root/testdata/sf0.001"
SHAPE = Record(
    {
        "n": Whole(1, 9), "x": Number(required=False), "t": Text(("u", "v"), required=False), "f": Flag(required=False), "any": Any(required=False),
        "list": Items(Record({"k": Whole()}, closed=True), 1, 2, required=False), "by": Named(Items(Whole()), ("p", "q"), complete=True, required=False),
    },
    (Rule("n", "not the length", lambda r: r["n"] == F.size(r["list"])),),
)


@pytest.mark.parametrize(
    "document, wanted",
    [
        (None, {("$", "missing")}),
        ("", {("$", "not JSON")}),
        ("{", {("$", "not JSON")}),
        ("[]", {("$", "not an object")}),
        ("null", {("$", "not an object")}),
        ("{}", {("$.n", "missing")}),
        ('{"n":1}', set()),
        ('{"n":null}', {("$.n", "not a whole number")}),
        ('{"n":1.0,"x":"1"}', {("$.n", "not a whole number"), ("$.x", "not a number")}),
        ('{"n":99999999999999999999999999}', {("$.n", "not a whole number")}),
        ('{"n":18446744073709551615}', {("$.n", "above 9")}),
        ('{"n":-1,"t":"w","f":1,"any":[null]}', {("$.n", "below 1"), ("$.t", "unknown word"), ("$.f", "not true or false")}),
        ('{"n":3,"list":[{"k":1},{"k":-1,"z":0},7]}', {("$.list", "more than 2"), ("$.list[1].k", "below 0"), ("$.list[1].z", "unknown field"), ("$.list[2]", "not an object")}),
        ('{"n":2,"list":[{"k":1}],"other":5}', {("$.n", "not the length")}),
        ('{"n":1,"list":[]}', {("$.list", "fewer than 1"), ("$.n", "not the length")}),
        ('{"n":1,"by":{"p":[1,-2],"r":1}}', {("$.by.p[1]", "below 0"), ("$.by.r", "unknown field"), ("$.by.r", "not an array"), ("$.by.q", "missing")}),
        ('{"n":1,"n":1}', {("$", "not JSON")}),
    ],
)
def test_faults_by_path(spark, document, wanted):
    row = typed.typed(spark.createDataFrame([(document,)], "document string"), SHAPE).first()
    assert {(f.path, f.fault) for f in row.faults} == wanted and len(row.faults) == len(wanted)
    assert (row.row is not None) == (not wanted)


def test_typed_rows_and_long_documents(spark):
    long = {"n": 2, "x": 0.5, "t": "u", "f": True, "any": {"z": [1]}, "list": [{"k": 5}, {"k": 2**63 - 1}], "by": {"p": list(range(20_000)), "q": []}, "pad": "y" * 1_000_000}
    docs = spark.createDataFrame([(1, json.dumps(long), "clash"), (1, json.dumps(long), "clash")], "id long, document string, kind string")
    rows = typed.typed(docs, SHAPE).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    r = rows[0].row
    assert (r.n, r.x, r.t, r.f, json.loads(r.any)) == (2, 0.5, "u", True, {"z": [1]})
    assert [e.k for e in r.list] == [5, 2**63 - 1] and r.by["p"] == list(range(20_000)) and r.by["q"] == []
    assert typed.checked(docs).first().faults[0].fault == "unknown kind"
    assert typed.typed(docs.limit(0), SHAPE).count() == 0 and typed.checked(docs.limit(0)).count() == 0


def test_documents_are_read_without_python_or_shuffle(spark):
    plan = typed.checked(evidence.documents(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def plain_path(links, sources, targets):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far, queue = dict.fromkeys(sources, 0), deque(sources)
    while queue:
        u = queue.popleft()
        for v in near.get(u, ()):
            if v not in far:
                far[v] = far[u] + 1
                queue.append(v)
    ends = sorted((far[t], t) for t in targets if t in far)
    path = [ends[0][1]] if ends else []
    while path and far[path[-1]]:
        path.append(min(v for v in near[path[-1]] if far.get(v) == far[path[-1]] - 1))
    return path[::-1]


def test_paths_from_both_ends(spark):
    rng = random.Random(11)
    line = [(i, i + 1) for i in range(9)]
    fan = [(200, 300 + i) for i in range(30)] + [(300 + i, 400 + i % 3) for i in range(30)] + [(400, 500), (401, 500), (402, 501)]
    loose = [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(55)]
    df = spark.createDataFrame(line + fan + loose + line, "a long, b long")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    cases = [({0}, {9}), ({9}, {0}), ({200}, {500, 501}), ({500, 501}, {200}), ({0, 200}, {3, 402}), ({1001, 1002}, {1030, 1035}), ({0}, {200}), ({77}, {77}), (set(), {0})]
    for s, t in cases:
        got = [r.id for r in trace.shortest_path(df, ids(s), ids(t), 0).orderBy("pos").collect()]
        assert got == plain_path(line + fan + loose, s, t), (s, t)


def plain_event(history):
    """Replays sorted events over explicit sets: the first to span, with the least marked group of each bit."""
    comps = {}
    marks = {}
    for e in history:
        x, y = comps.setdefault(e.a, {e.a}), comps.setdefault(e.b, {e.b})
        if x is not y:
            x |= y
            comps.update(dict.fromkeys(y, x))
        if e.event == "mark":
            marks[e.a] = marks.get(e.a, 0) | e.bits
        ends = [[v for v in x if marks.get(v, 0) & bit] for bit in (1, 2)]
        if all(ends):
            return e.i, e.phase, e.j, e.ordinal, e.a, e.b, min(ends[0]), min(ends[1])
    return None


@pytest.mark.parametrize("given", [True, False])
def test_first_sources_and_chain(spark, given):
    g = evidence.site_graph(spark, SF) if given else two_level.solve(spark, Annulus(10, 40, 120, 16))
    history = sorted(trace.events(g).collect(), key=lambda e: (e.i, e.phase, e.j, e.ordinal))
    want = plain_event(history)
    for limit in (10**6, 0):
        e = trace.first_event(g, limit).first()
        assert (e.i, e.phase, e.j, e.ordinal, e.a, e.b, e.inner_source, e.outer_source) == want
    before = [(x.a, x.b) for x in history if x.event != "mark" and (x.i, x.phase, x.j, x.ordinal) < want[:4]]
    inner, outer = (e.a, e.b) if e.before_a & 1 else (e.b, e.a)
    if e.event == "mark":
        chain = []
    else:
        chain = [("inner", v) for v in plain_path(before, {e.inner_source}, {inner})] + [("outer", v) for v in plain_path(before, {outer}, {e.outer_source})]
    for limit in (None, 0):
        got = [(r.side, r.id) for r in trace.span_chain(g, limit).orderBy("pos").collect()]
        assert got == chain
    moat = two_level.solve(spark, Annulus(2, 40, 120, 16))
    assert trace.span_chain(moat).count() == 0
