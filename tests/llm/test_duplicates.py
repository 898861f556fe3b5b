from concurrent.futures import ThreadPoolExecutor

import numpy as np
import xxhash

from latticeflow.llm import embedding_lsh, simhash, superkmers
from latticeflow.llm.queries import op4_superkmers, op6_embedding_lsh, op9_simhash

from .helpers import ODD_TEXTS, components, documents, sha, words, write


def some_texts(n=150):
    rng = np.random.default_rng(6)
    pool = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(pool, 60))
    texts = []
    for i in range(n):
        body = list(rng.choice(pool, rng.integers(5, 120)))
        if i % 3 == 0:
            body[2:2] = passage.split()
        if i % 11 == 5:
            body = texts[i - 5].split()
            if i % 2:
                body[len(body) // 2] = "changed"
        texts.append(" ".join(body))
    return texts + ["a a a " * 300, "a a a " * 200, "A " + passage] + ODD_TEXTS


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_superkmers_equal_brute_force(spark, tmp_path):
    texts = some_texts()
    sf = write(spark, tmp_path, documents=documents(spark, texts, kept_text="clash", tag="clash"))
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in op4_superkmers(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))), i


def test_superkmers_with_frequent_strings_and_repeated_ids(spark, monkeypatch):
    texts = ["p q r s t u v w x y z 1 2 3 4 5 6"] * 40
    docs = spark.createDataFrame([(i // 2, t, "l", "s", 1) for i, t in enumerate(texts)] + [(None, texts[0], "l", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = superkmers.remove_repeats(docs).collect()
    assert all(r.n_removed == (0 if r.doc_id in (0, None) else 17) for r in rows) and len(rows) == 41


def hot_texts():
    """A frequent piece in many contexts, and a passage that more than FEW documents share exactly."""
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(pool, 30))
    texts = [" ".join([*rng.choice(pool, 20), "of the hot piece", *rng.choice(pool, 20)]) for _ in range(60)]
    texts += ["of the hot piece " * 8 + " ".join(rng.choice(pool, k % 7)) for k in range(40)] + [passage] * 40
    return texts + some_texts(60)


def test_superkmers_split_hot_buckets(spark, monkeypatch):
    texts = hot_texts()
    docs = documents(spark, texts).repartition(3)
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for hot in (0, 100, 300):
        monkeypatch.setattr(superkmers, "HOT_WORDS", hot)
        got = {r.doc_id: r for r in superkmers.remove_repeats(docs).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w = words(t)
            gone = {k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(13)}
            assert (got[i].n_removed, got[i].kept_text) == (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)), (hot, i)


def test_superkmer_buckets_follow_the_input():
    assert superkmers.bucket_count(0, 4) == 64 and superkmers.bucket_count(500_000_000, 51) == 102
    assert superkmers.bucket_count(30_000_000_000, 51) == 5000


def test_equal_hashes_are_told_apart_by_words():
    ids = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2])
    at = np.array([0, 3, 6])
    order, begins = superkmers._exact_groups(ids, at, np.zeros(3, np.uint64), 3)
    groups = [set(order[a:b].tolist()) for a, b in zip(begins, [*begins[1:], 3])]
    assert sorted(map(sorted, groups)) == [[0, 2], [1]]


def test_simhash_equals_brute_force(spark, tmp_path):
    texts = some_texts()
    sf = write(spark, tmp_path, documents=documents(spark, texts, fp="clash"))
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    want = components(range(len(fps)), pairs)
    got = {r.doc_id: r for r in op9_simhash(spark, sf).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(int(got[i].fingerprint, 16) == f and len(got[i].fingerprint) == 16 for i, f in enumerate(fps))


def test_fingerprint_links_with_large_buckets(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**63))
    values = {base}
    while len(values) < 700:
        x = list(values)[rng.integers(0, len(values))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    want = components(values, [(x, y) for k, x in enumerate(values) for y in values[:k] if bin(x ^ y).count("1") <= 2])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    for large in (5, 10_000):
        edges = {tuple(r) for r in simhash.fingerprint_links(df, large).collect()}
        back = components(values, [(a % 2**64, b % 2**64) for a, b in edges])
        assert back == want


def test_flips_and_pairs_agree():
    rng = np.random.default_rng(2)
    v = np.unique(rng.integers(0, 2**14, 6000).astype(np.uint64) << np.uint64(20))
    small = simhash.links(v, np.zeros(10**6, np.uint64))
    large = simhash.links(v)
    order = lambda p: set(map(frozenset, zip(p[0].tolist(), p[1].tolist())))
    assert len(v) > 2 * len(simhash._ALL) and order(small) == order(large)


def test_keep_first(spark):
    docs = documents(spark, ["a b c d", "a b c d", "other words here now", None, ""])
    twice = docs.union(docs.where("doc_id = 2"))
    assert sorted(r.doc_id for r in simhash.keep_first(twice).collect()) == [0, 2, 3]


def test_keep_first_tells_rows_apart_that_repeat_an_id(spark):
    rng = np.random.default_rng(1)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(500)], 80)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z")]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, simhash_tag string")
    assert sorted((r.doc_id, r.text, r.simhash_tag) for r in simhash.keep_first(df(rows)).collect()) == sorted([(1, a, "x"), (1, b, "y")])
    rows += [(1, a, "x"), (None, c, "n"), (None, c, "n"), (None, a, "n"), (7, c, "k")]
    got = sorted((r.doc_id, r.text) for r in simhash.keep_first(df(rows)).collect())
    assert got == sorted([(1, a), (1, b), (7, c)])
    alone = [(None, c, "n"), (None, c, "m"), (None, a, "n")]
    assert sorted(r.text for r in simhash.keep_first(df(alone)).collect()) == sorted([a, c])
    assert simhash.keep_first(df(rows)).columns == ["doc_id", "text", "simhash_tag"]


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    centre = rng.normal(size=64)
    for i in range(300):
        x = rng.normal(size=64)
        if i % 3 == 0:
            x = centre + rng.normal(size=64) * 0.1
        if i % 10 == 1:
            x = np.array(rows[-1][1])
        rows.append((i, [float(np.float32(y)) for y in x], int(i % 2)))
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] * 64, 1), (303, [1.0] * 63 + [None], 1), (304, rows[0][1], None), (305, rows[0][1], None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [], 0)]
    return rows


def plain_links(rows):
    """(vec_id, n_links, component_id, kept) of every row, rows told apart by their place."""
    fine = {i: np.float32(v).astype(float) for i, (_, v, lab) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v) and lab is not None}
    cos = lambda x, y: float(x @ y / np.sqrt((x @ x) * (y @ y)))
    pairs = [(i, j) for i in fine for j in fine if j < i and rows[i][2] == rows[j][2] and len(fine[i]) == len(fine[j]) and cos(fine[i], fine[j]) >= 0.98]
    root = components(range(len(rows)), pairs)
    count = np.zeros(len(rows), int)
    np.add.at(count, np.array(pairs, int).reshape(-1), 1)
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    told = [(rows[i][0], int(count[i]), least.get(root[i])) for i in range(len(rows))]
    return sorted(((*t, t[0] is not None and t[0] == t[2]) for t in told), key=str), len(pairs)


def linked(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted(map(tuple, embedding_lsh.near_duplicates(df, **options).collect()), key=str)


def test_embeddings_equal_brute_force(spark, tmp_path):
    rows = vectors()
    want, pairs = plain_links(rows)
    assert pairs > 500
    for options in ({"k": 1}, {"k": 2}, {"k": 3, "large": 20}):
        assert linked(spark, rows, **options) == want, options
    sf = write(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, op6_embedding_lsh(spark, sf).collect()), key=str) == want


def test_embeddings_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(3)
    x, y = np.eye(64)[0], np.eye(64)[1]
    near = lambda v: [float(np.float32(z)) for z in v + rng.normal(size=64) * 0.005]
    rows = [(5, x.tolist(), 1), (5, y.tolist(), 1), (8, near(x), 1), (9, near(y), 1)]
    want = [(5, 1, 5, True), (5, 1, 5, True), (8, 1, 5, False), (9, 1, 5, False)]
    assert linked(spark, rows) == plain_links(rows)[0] == want
    rows += [(9, near(x), 1)]  # an id in both components links neither
    assert sorted(r[1] for r in linked(spark, rows)) == [1, 1, 2, 2, 2] and linked(spark, rows) == plain_links(rows)[0]
    z = np.eye(64)[2]
    rows = [(None, x.tolist(), 1), (None, near(x), 1), (None, x.tolist(), 1), (3, near(x), 1), (None, near(y), 2), (None, near(y), 2), (4, z.tolist(), None), (None, z.tolist(), None), (7, near(z), 3), (7, near(z), 3), (7, near(z), 3)]
    assert linked(spark, rows) == plain_links(rows)[0]


def test_embedding_recall_and_wider_types(spark):
    """Pairs just above the threshold; the rates were measured in 64 dimensions, in 768 they are a little lower."""
    rng = np.random.default_rng(12)
    for d, ks in ((64, (1, 2, 3, 4)), (768, (1, 2, 3))):
        x = rng.normal(size=(1500, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        off = rng.normal(size=(1500, d))
        off -= (off * x).sum(1, keepdims=True) * x
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * off
        for k in ks:
            tables = embedding_lsh.tables_for(k)
            u, v = (embedding_lsh.bucket_keys(embedding_lsh.axes(z, k, tables), d) for z in (x, y))
            met = ((u == v[:, :, :1]) | (v == u[:, :, :1])).any((1, 2))
            assert met.mean() >= (0.998 if d == 64 else 0.99), (d, k)
    rows = [(i, z.tolist(), "é") for i, z in enumerate([x[0], x[0], y[0], x[1]])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string").selectExpr("*", "1 as n_links", "'c' as d1", "2 as weight")
    assert sorted(map(tuple, embedding_lsh.near_duplicates(df).collect())) == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 0, 3, True)]


def test_hashes_follow_the_number_of_vectors():
    assert [embedding_lsh.hashes_for(n) for n in (0, 5, 600, 50_000, 1_000_000, 10**11)] == [1, 1, 3, 3, 4, 7]
    assert embedding_lsh.hashes_for(10**11, 768) == 4


def test_empty_tables(spark):
    assert embedding_lsh.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert simhash.group(documents(spark, [])).count() == 0
    assert superkmers.remove_repeats(documents(spark, [])).count() == 0


def test_two_superkmer_jobs_at_once_leave_the_session_alone(spark):
    texts = some_texts(40)
    docs = documents(spark, texts)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    count = lambda _: {r.doc_id: r.n_removed for r in superkmers.remove_repeats(docs).collect()}
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(count, range(2))
    assert a == b and len(a) == len(texts) and spark.conf.get(key) == before


def test_superkmers_of_repeated_ids_with_other_texts(spark, monkeypatch):
    """Rows of one id are told apart by their texts, in split buckets too."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i // 3, f"{'x ' * (i % 3)}{passage} {i}") for i in range(60)] + [(i, passage) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert superkmers.ids_repeat(docs) and not superkmers.ids_repeat(docs.dropDuplicates(["doc_id"]))
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(13)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    for hot in (0, superkmers.HOT_WORDS):
        monkeypatch.setattr(superkmers, "HOT_WORDS", hot)
        assert sorted((r.doc_id, r.kept_text) for r in superkmers.remove_repeats(docs).collect()) == sorted(want)
