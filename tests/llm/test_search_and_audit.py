"""Exact duplicates, filter interaction and lexical search against plain versions."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from latticeflow.llm import exact_dedup, filter_audit, lexical
from latticeflow.llm.queries import op11_filter_audit, op12_lexical_search, op13_exact_dedup

from .helpers import ODD_TEXTS, documents, sha, words, write


def texts_with_copies(n=120):
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(50)] + ["Übung", "naïve", "ΑΣ", "$cash", "LOUD"]
    texts = [" ".join(rng.choice(pool, rng.integers(1, 140))) for _ in range(n)]
    return texts + texts[:30] + ["the hot text"] * 70 + ODD_TEXTS + ODD_TEXTS


# exact duplicates


def plain_groups(rows):
    """doc_id -> (keep_id, group_size, kept, sha256) for rows (doc_id, text) of distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t or "")) for i, t in rows}


@pytest.mark.parametrize("counters", [1, 3, exact_dedup.COUNTERS])
def test_exact_copies_equal_brute_force(spark, counters):
    texts = texts_with_copies()
    docs = documents(spark, texts, digest="clash", winner="clash", group_size="clash").repartition(5)
    want = plain_groups(list(enumerate(texts)))
    got = exact_dedup.mark(docs, counters=counters).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(texts)
    left = exact_dedup.drop_copies(docs, counters=counters)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({w[0] for w in want.values()})


def test_op13_reads_its_table(spark, tmp_path):
    texts = texts_with_copies(40)
    got = op13_exact_dedup(spark, write(spark, tmp_path, documents=documents(spark, texts)))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain_groups(list(enumerate(texts)))


@pytest.mark.parametrize("counters", [1, exact_dedup.COUNTERS])
def test_exact_copies_with_repeated_and_null_ids(spark, counters):
    rows = [(7, "a"), (7, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_dedup.mark(docs, counters=counters).collect()
    kept = sorted((str(r.doc_id), r.text_sha256, r.group_size) for r in got if r.kept)
    assert kept == sorted([("7", sha("a"), 4), ("None", sha("b"), 2), ("1", sha(""), 2)])
    assert len(got) == 8 and {r.keep_id for r in got if r.text_sha256 == sha("a")} == {7}
    left = exact_dedup.drop_copies(docs, counters=counters).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == [("1", ""), ("7", "a"), ("None", "b")]


def test_exact_copies_of_nothing_and_of_normalised_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.mark(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.mark(docs, normalise=F.lower).collect()} == {1: 2, 2: 2, 3: 3}


def test_summaries_keep_every_frequent_value():
    rng = np.random.default_rng(4)
    values = [bytes([v]) for v in np.minimum(rng.zipf(1.3, 20_000), 250)]
    for counters in (1, 5, 20):
        summed = Counter()
        for part in range(7):
            kept = {}
            for at in range(part, len(values), 7 * 50):
                c = Counter(values[at : at + 7 * 50 : 7])
                kept = exact_dedup.summary(kept, (list(c), list(c.values())), counters)
                assert len(kept) <= counters
            summed.update(kept)
        top = {v for v, _ in sorted(summed.items(), key=lambda x: -x[1])[:counters]}
        assert {v for v, n in Counter(values).items() if n > len(values) / (counters + 1)} <= top


# filter interaction


def plain_audit(rows, labels):
    """(part, order, step) -> numbers, for rows (doc_id, text, part); ids may repeat or be null."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    found = {}
    for i, t, part in rows:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        found.setdefault(part or "", []).append(({k for k in fails if fails[k]}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, docs in found.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = docs
            for step, letter in enumerate(order, 1):
                removed = [d for d in alive if letter in d[0]]
                redundant = sum(letter in d[0] for d in docs) - len(removed)
                alive = [d for d in alive if letter not in d[0]]
                shapley[letter] += len(removed)
                out[part, order, step] = [len(alive), len(removed), redundant, sum(d[0] == {letter} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed), letter]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = texts_with_copies() + [" ".join(f"v{i}" for i in rng.permutation(300)[: rng.integers(90, 130)]) for _ in range(40)]
    rows = [(int(i), t, [None, "", "en", "de"][i % 4]) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    labels = [(i, int(rng.integers(2)) if i % 5 else None, int(rng.integers(2)) if i % 7 else None) for i in range(0, len(texts), 2)] + [(2, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, mask string").repartition(6)
    sf = write(spark, tmp_path, documents=docs, labels=spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int, part int"))
    got = op11_filter_audit(spark, sf)
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    assert audited(got) == plain_audit(rows, labels)


def test_audit_of_one_group_over_many_parts(spark):
    """A hot text is cut by range bounds; repeated and null ids are no copies of themselves."""
    rows = [(i % 350 if i % 11 else None, "the same text $", "en" if i % 2 else "de") for i in range(700)] + [(i, f"text {i % 5}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        assert audited(got) == plain_audit(rows, [])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sweep_keeps_texts_of_one_fingerprint_apart():
    """Colliding fingerprints: parts are ranges of (fingerprint, doc_id), sorted by text within."""
    rows = [(5, t, i, "x") for t, i in (("a", 1), ("b", 2), ("a", 3), ("b", 4), ("c", 5), ("a", 6), ("a", 7))] + [(6, "d", 8, "x"), (6, "d", 9, "x"), (9, "e", 1, "x")]
    for cuts in ((10,), (3, 10), (2, 5, 10), (1, 2, 4, 7, 9, 10)):
        out, start = [], 0
        for end in cuts:
            sweep = filter_audit.Sweep()
            for r in sorted(rows[start:end]):
                out += sweep.row(*r)
            out += sweep.close(last=True)
            start = end
        least = {}
        for i, _, _, _, edge in out:
            if edge is not None:
                least[edge] = min(least.get(edge, i), i)
        copies = sorted(i for i, _, mask, n, edge in out for _ in range(n) if mask & filter_audit.COPY or edge is not None and i > least[edge])
        assert copies == [3, 4, 6, 7, 9], cuts


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, k=50, once=True):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, held = sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    joined = {}
    for item, text in items:
        joined.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, terms in joined.items():
        found = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * len(docs)) // total
            s = sum((1 if once else a) * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, a in terms.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=lambda x: (str(x[0]), x[1]))


def searched(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (str(x[0]), x[1]))


def test_search_equals_brute_force(spark, tmp_path):
    texts = texts_with_copies() + ["Ein Text, W1-w2_w3;W4 ÄÖ äö!", "w1\x00w2\x7fw3", "١٢٣ 12３"]
    rows = list(enumerate(texts))
    items = [(i, " ".join(texts[3 * i].split()[:12]) if texts[3 * i] else None) for i in range(30)] + [(100, "w1 W1 W2."), (101, None), (102, "nowhere"), (None, "w3 ÄÖ"), (100, "w9 w1")]
    sf = write(spark, tmp_path, documents=documents(spark, texts, score="clash", rank="clash").repartition(5), benchmark=spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, term string"))
    got = op12_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert searched(got) == plain_search(rows, items)


def test_search_in_small_blocks_and_with_multiplicity(spark, monkeypatch):
    rows = list(enumerate(texts_with_copies(60))) + [(None, "w1 w2 w3"), (5, "w1 w2"), (5, "w1 w2")]
    items = [(f"i{i}", f"w{i} w{i} w{i + 1} W{i + 2} the text") for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id string, text string")
    for k, once, entries in ((3, True, 10), (7, False, 10), (500, False, 1000)):
        assert searched(lexical.search(docs, asked, k=k, once=once, entries=entries)) == plain_search(rows, items, k, once)


def test_blocks_of_documents_and_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Äa b-c dd " * 500
    assert lexical.counted(text) == (2000, Counter({"Äa".encode(): 500, b"b": 500, b"c": 500, b"dd": 500}))
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 30, 5000), rng.permutation(5000)
    best = lexical.Best(40)
    for at in range(0, 5000, 130):
        best.take(scores[at : at + 130], ids[at : at + 130])
    want = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if s > 0)[:40]
    assert [(-s, i) for s, i in zip(best.scores, best.ids, strict=True)] == want


def test_search_without_documents_or_items(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b")], docs.schema), items.where("false")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, " -")], docs.schema), items).count() == 0
