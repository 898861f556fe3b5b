import math
import re
from collections import Counter
from itertools import combinations

import numpy as np

from latticeflow.llm import quality_ftrl, quality_gbt, toxicity_fm
from latticeflow.llm.common import is_held_out
from latticeflow.llm.queries import op3_quality_gbt, op5_quality_ftrl, op10_toxicity_fm

from .helpers import ODD_TEXTS, documents, words, write

SF = "/root/testdata/sf0.01"


def made(spark, folder):
    rng = np.random.default_rng(1)
    syllables = ["ba", "ke", "lo", "mi", "ru", "ta", "ven", "sor"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, quality, toxic = [], [], []
    for i in range(400):
        ws = [word() for _ in range(80)]
        q, t = int(i % 5 != 0), int(i % 7 == 0)
        if not q:
            ws = [w + "$$$" if k % 2 else w.upper() + "!!" for k, w in enumerate(ws)]
        if t:
            ws[11:11] = ["wretch", "fool"]
        texts.append(" ".join(ws))
        quality.append(q)
        toxic.append(t)
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in range(400)] + [(0, quality[0], toxic[0]), (9999, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts + ODD_TEXTS, score="clash", predicted="clash", y="clash")
    return write(spark, folder, documents=docs, labels=labels), texts + ODD_TEXTS, quality, toxic


def test_classifiers_learn_and_hold_out(spark, tmp_path):
    sf, texts, quality, toxic = made(spark, tmp_path)
    for op, truth, cut in ((op5_quality_ftrl, quality, 0.3), (op10_toxicity_fm, toxic, 0.5)):
        rows = op(spark, sf).collect()
        assert len(rows) == len(texts)
        right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id < 400]
        assert len(right) > 50 and np.mean(right) > 0.95
        assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)


def test_base_counts_equal_the_plain_ones(spark, tmp_path):
    sf, texts, *_ = made(spark, tmp_path)
    for r in op3_quality_gbt(spark, sf).collect():
        t = texts[r.doc_id] or ""
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(covered)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((500, len(quality_gbt.STATISTICS)))
    k = quality_gbt.STATISTICS.index("symbols")
    y = ((x[:, k] + 0.3 * rng.random(500)) < 0.6).astype(float)
    forest = quality_gbt.fit(x, y)
    grid = np.repeat(x[:50], 21, 0)
    grid[:, k] = np.tile(np.linspace(0, 1, 21), 50)
    s = forest.score(grid).reshape(50, 21)
    assert (np.diff(s, axis=1) <= 1e-12).all() and s[:, 0].mean() > s[:, -1].mean() + 0.5


def test_pairs_are_learnt_where_weights_are_not_enough():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3000):
        has = rng.random(4) < 0.5
        h = np.array([11 + k for k in range(4) if has[k]], np.uint64)
        rows.append((h, int(has[0] and has[1])))
    known, w, v, bias = toxicity_fm.fit(rows, l1=0.5, epochs=8)
    at = {int(k): i for i, k in enumerate(known)}
    pair = float(v[at[11]] @ v[at[12]])
    other = max(abs(float(v[at[a]] @ v[at[b]])) for a, b in ((11, 13), (12, 14), (13, 14)) if a in at and b in at) if len(at) > 2 else 0
    assert pair > 0.2 and pair > other


def plain_ftrl(rows, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """FTRL-Proximal slot by slot, after the published update rule; the bias is slot None, without l1 and l2."""
    z, n = Counter(), Counter()

    def weight(k):
        if k is None:
            return -z[k] * alpha / (beta + n[k] ** 0.5)
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((beta + n[k] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, None: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * x[k] for k in x)))))
            for k in x:
                g = (p - y) * x[k]
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return weight


def test_ftrl_updates_and_scores_equal_the_plain_ones(spark):
    texts = ["Good plain words here.", "bad $$$ BUY $$$ now now", "ünïcode wörds " * 3, "x" * 200 + " tail", "one", "", None] + [f"some good text number {i} with words" for i in range(20)] + [f"BUY {i}$$ !!! now" for i in range(20)]
    ys = [int("$$" not in (t or "")) for t in texts]
    rows = [(dict(zip(i.tolist(), x.tolist())), y) for (i, x), y in zip(map(quality_ftrl.sparse, texts), ys)]
    weight = plain_ftrl(rows)
    w = quality_ftrl.fit([(*quality_ftrl.sparse(t), y) for t, y in zip(texts, ys)])
    used = sorted({k for x, _ in rows for k in x})
    assert np.allclose(w[used], [weight(k) for k in used], atol=1e-5) and abs(w[-1] - weight(None)) < 1e-5
    assert not np.delete(w[:-1], used).any() and len(used) > 100
    got = {r.doc_id: r.score for r in quality_ftrl.score(documents(spark, texts), w).collect()}
    for i, (x, _) in enumerate(rows):
        s = sum(weight(k) * v for k, v in x.items()) + weight(None)
        assert abs(got[i] - 1 / (1 + math.exp(-s))) < 1e-4, i


def test_slots_are_those_of_words_shapes_and_pairs():
    """Each family's values add up to SCALE; long shapes are hashed whole."""
    x = quality_ftrl.sparse("aB1 aB1 c")[1]
    assert abs(x.sum() - 4 * quality_ftrl.SCALE) < 1e-4
    long = "aB" * 20
    assert quality_ftrl.slots(long + "9")[1].tolist() != quality_ftrl.slots(long + "$")[1].tolist()
    assert quality_ftrl.slots("abc$$")[1].tolist() == quality_ftrl.slots("zzzz$")[1].tolist()


def plain_fm(rows, factors, support=5, epochs=4, rate=0.1, l1=6.0, l2=0.02, alpha=0.5, beta=1.0):
    """The factorization machine term by term, with all pairs written out."""
    counts = Counter(h for x, _ in rows for h in x)
    known = sorted(h for h, c in counts.items() if c >= support)
    v = dict(zip(known, factors(len(known))))
    z, n, gv = Counter(), Counter(), {h: [1e-2] * 4 for h in known}
    share = min(max(sum(y for _, y in rows) / len(rows), 0.01), 0.99)
    bias, gb = math.log(share / (1 - share)), 1.0
    weight = lambda h: 0.0 if abs(z[h]) <= l1 else -(z[h] - math.copysign(l1, z[h])) / ((beta + n[h] ** 0.5) / alpha + l2)
    dot = lambda a, b: sum(p * q for p, q in zip(v[a], v[b]))

    def raw(x):
        live = [h for h in sorted(x) if h in v and weight(h)]
        return bias + sum(map(weight, live)) + sum(dot(a, b) for a, b in combinations(live, 2)), live

    for _ in range(epochs):
        for x, y in rows:
            s, live = raw(x)
            d = 1 / (1 + math.exp(-s)) - y
            w = {h: weight(h) for h in x if h in v}
            old = {h: list(v[h]) for h in live}
            for h in w:
                sigma = ((n[h] + d * d) ** 0.5 - n[h] ** 0.5) / alpha
                z[h] += d - sigma * w[h]
                n[h] += d * d
            for h in live if len(live) > 1 else []:
                for f in range(4):
                    g = d * sum(old[o][f] for o in live if o != h) + l2 * old[h][f]
                    gv[h][f] += g * g
                    v[h][f] = min(1, max(-1, old[h][f] - rate * g / gv[h][f] ** 0.5))
            gb += d * d
            bias -= rate * d / gb**0.5
    return lambda x: 1 / (1 + math.exp(-raw(x)[0])), {h: weight(h) for h in known if weight(h)}


def test_factorization_machine_equals_the_plain_one(spark):
    """Updates and scores with the query's own settings, against pairs written out."""
    rng = np.random.default_rng(7)
    pool = [f"word{i}x" for i in range(30)]
    texts, ys = [], []
    for i in range(400):
        ws = list(rng.choice(pool, 8))
        if i % 2:
            ws.append("Wretch!")
        if i % 3 == 0:
            ws.append("them,")
        texts.append(" ".join(ws))
        ys.append(int(i % 6 == 3))
    rows = [(toxicity_fm.hashes(t), y) for t, y in zip(texts, ys)]
    model = toxicity_fm.fit(rows)
    factors = lambda n: [list(x) for x in (np.random.default_rng(5).random((n, 4)) - 0.5) * 0.1]
    score, weights = plain_fm([(h.tolist(), y) for h, y in rows], factors)
    assert set(model[0].tolist()) == set(weights) and len(weights) > 2
    assert np.allclose(model[1], [weights[h] for h in model[0].tolist()], atol=1e-9)
    odd = texts[:40] + ["wretch them", "WRETCH", "them", "", None, "unknown"]
    got = {r.doc_id: r.score for r in toxicity_fm.score(documents(spark, odd), model).collect()}
    assert all(abs(got[i] - score(toxicity_fm.hashes(t).tolist())) < 1e-9 for i, t in enumerate(odd))
    assert got[40] > max(got[41], got[42])


def test_fits_go_through_replayed_rows(spark, tmp_path):
    """From tables: the models are those of the sampled rows in order of a hash of the id, whatever the partitions."""
    sf, texts, quality, toxic = made(spark, tmp_path)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert (quality_ftrl.train(docs, labels) == quality_ftrl.train(docs.repartition(7), labels)).all()
    a, b = toxicity_fm.train(docs, labels), toxicity_fm.train(docs.repartition(7), labels)
    assert all((x == y).all() for x, y in zip(a[:3], b[:3])) and a[3] == b[3]


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality_gbt.STATISTICS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.4)).astype(float)
    forest = quality_gbt.fit(x, y)

    def walk(row, node):
        if forest.left[node] == node:
            return forest.value[node]
        return walk(row, forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node])

    want = [1 / (1 + math.exp(-(forest.base + sum(walk(r, root) for root in forest.roots)))) for r in x]
    assert np.allclose(forest.score(x), want, atol=1e-12) and len(forest.roots) == 40


def test_without_labels_and_on_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, ["a b c", None])
    assert {r.score for r in quality_ftrl.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity_fm.classify(docs, none).collect()} == {0.5}
    assert not any(r.kept for r in quality_gbt.apply(docs, none).collect())
    empty = documents(spark, [])
    assert quality_ftrl.classify(empty, none).count() == toxicity_fm.classify(empty, none).count() == quality_gbt.apply(empty, none).count() == 0
