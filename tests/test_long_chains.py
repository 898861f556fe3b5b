"""A chain's levels send their few points to the links; a stored graph is neither copied nor shuffled."""

import random
from collections import deque

import pytest

from latticeflow.operators import trace


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


@pytest.mark.parametrize("sent", [0, 10**6])
def test_stored_links_are_neither_copied_nor_counted(spark, monkeypatch, tmp_path, sent):
    rng = random.Random(7)
    links = [(rng.randrange(25), -1 - rng.randrange(25)) for _ in range(45)] + [(50, 50), (50, 51), (51, 50), (50, 51)]
    spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long").write.parquet(str(tmp_path / "links"))
    df = spark.read.parquet(str(tmp_path / "links"))
    written = []
    cut = trace.cut
    monkeypatch.setattr(trace, "cut", lambda x: written.append(x.columns) or cut(x))
    monkeypatch.setattr(trace, "SENT", sent)
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    for s, t in (({0}, {24}), ({24, -3}, {1, 2, -9}), ({51}, {50}), ({0}, {51}), ({50}, {50})):
        got = [r.id for r in trace.shortest_path(df, ids(s), ids(t), stored=True).orderBy("pos").collect()]
        assert got == plain_path(links, s, t), (s, t)
    assert written and all("b" not in columns for columns in written)


def test_few_points_do_not_shuffle_the_links(spark):
    links = spark.range(1000).selectExpr("id AS a", "-id AS b")
    few = trace._beyond(links, spark.range(3), 3)._jdf.queryExecution().executedPlan().toString()
    many = trace._beyond(links, spark.range(3), trace.SENT + 1)
    assert "Exchange hashpartitioning" not in few and "BroadcastExchange" in few
    assert sorted(map(tuple, many.collect())) == [(0, 0), (0, 0), (1, -1), (2, -2)]
