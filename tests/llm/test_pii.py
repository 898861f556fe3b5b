import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.llm import pii
from latticeflow.llm.queries import op2_pii

from .helpers import ODD_TEXTS, documents, sha, write

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
TEXTS = [
    *ODD_TEXTS,
    "mail a.b+c@d.example.com, a@b.cd_x@y.z and @x.y or a@b",
    "é 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.004 99999999999999999999.1.1.1",
    "a@b@c.de@f.gh x..@y.z a@b.c.d_e@f.g 1.2.3.4.5.6.7.8.9 1.2.3 4.5.6.7 1.2.3.4@5.6 %@-.-",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 49927398716 and 0000000000000000000 " + "7" * 5000,
    "call +1 (614) 555-8001 or +49 30 123456 or +1 2 or + 5 or +" + "1 " * 4000,
    'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and GB82WEST12345698765432 iban: DE89370400440532013000 ssn 123-45-6789',
] + [f'key {i} token = "{i:040x}" word' for i in range(1000, 1030)]


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base(text):
    spans = []
    for no, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                spans.append((m.start(), no, m.end(), kind))
    return sorted(spans)


def test_base_spans_equal_the_plain_search(spark, tmp_path):
    sf = write(spark, tmp_path, documents=documents(spark, TEXTS, base="clash", spans="clash"))
    got = {r.doc_id: r for r in op2_pii(spark, sf).collect()}
    for i, t in enumerate(TEXTS):
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base(t))
        assert got[i].base_sha256 == sha(want), t
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(s[3] == k for s in base(t)) for k, _ in BASE]


def test_secrets_are_added(spark):
    got = {r.doc_id: r for r in pii.find(documents(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        if t and "token" in t:
            assert any(s.kind == "secret" and re.fullmatch("[0-9a-f]{40}", t[s.start : s.end]) for s in got[i].spans), t


def test_redaction(spark):
    docs = documents(spark, ["é mail a@b.cc now +1 (614) 555-8001", "none", None])
    rows = pii.find(docs, keep=("doc_id", "text"), weights={}).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in rows} == {0: "é mail [EMAIL] now [PHONE]", 1: "none", 2: None}


def test_empty_table_and_no_proposals(spark):
    assert pii.find(documents(spark, [])).count() == 0
    assert pii.train(documents(spark, ["plain words"])) == {}


def test_reliabilities_tell_good_labelers(spark):
    rows = [([1, 1, 1], [1, 1, 1, 1, 0], 90), ([-1, -1, 1], [2, 2, 2, 2, 0], 80), ([1, 1, -1], [1, 1, 1, 1, 0], 85), ([-1, -1, -1], [2, 2, 2, 2, 0], 95)]
    turned = [([v[2], v[0], v[1]], f, 3 * n if v[0] > 0 else n) for v, f, n in rows]  # another kind: other labelers are good, most are real
    cells = spark.createDataFrame([(4, *r) for r in rows] + [(6, *r) for r in turned], "no int, votes array<int>, features array<int>, n long")
    r, other = sorted(pii.reliabilities(cells).collect())
    assert r.accuracy[0] > 0.9 and r.accuracy[1] > 0.9 and r.accuracy[2] < 0.6
    assert other.accuracy[1] > 0.9 and other.accuracy[2] > 0.9 and other.accuracy[0] < 0.6
    assert 0.4 < r.prior < 0.6 < 0.7 < other.prior < 0.8


@pytest.mark.parametrize("kind", list(pii.PATTERNS))
def test_patterns_compile_in_the_engine(spark, kind):
    assert spark.range(1).select(F.lit("abc 1").rlike(pii.PATTERNS[kind]).alias("x")).first().x is False


def test_secrets_without_a_digit_are_added(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    secrets = ["sk-" + letters[i:] + letters[:i] for i in range(26)]
    texts = [f"key = {s}" for s in secrets] + [f"in 7 lines key = {s}" for s in secrets] + [f"the word {x * 24} is long" for x in letters]
    got = {r.doc_id: r for r in pii.find(documents(spark, texts)).collect()}
    found = {i: [texts[i][s.start : s.end] for s in r.spans if s.kind == "secret"] for i, r in got.items()}
    for i, s in enumerate(secrets):
        assert found[i] == found[i + 26] == [s]
    assert not any(found[i] for i in range(52, 78))
    assert not any(pii.find(documents(spark, texts[52:])).first().spans)


def iban(country, body):
    number = "".join(str(int(c, 36)) for c in f"{body}{country}00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def test_precision_and_recall_of_added_spans(spark):
    """Planted secrets, IBANs and personal numbers, beside decoys that look like them."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    word = lambda n: "".join(rng.choice(letters[:26], n))
    digits = lambda n: "".join(rng.choice(letters[52:], n))
    texts, real = [], []

    def add(before, surface, after, kind):
        texts.append(f"{word(5)} {word(3)} {before}{surface}{after} {word(6)}")
        real.append({(kind, surface)} if kind else set())

    for i in range(150):
        add('token = "', "".join(rng.choice(letters[[*range(6), *range(52, 62)]], 40)), '"', "secret")
        add("password: ", "".join(rng.choice(letters, 28)) + "aZ3", "", "secret")
        add("see ", word(24), "", None)
        add("at ", "-".join(word(5) for _ in range(5)), "", None)
        add("IBAN: " if i % 2 else "konto ", iban("DE", digits(18)), "", "iban")
        add("part ", "XQ" + digits(16), "", None)
        add("ssn " if i % 2 else "security no. ", f"{rng.integers(100, 665)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", "", "ssn")
        add("order ", f"9{digits(2)}-{digits(2)}-{digits(4)}", "", None)
        add("ticket ", f"000-{digits(2)}-{digits(4)}", "", None)
    found = {r.doc_id: {(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if s.kind in pii.ADDED} for r in pii.find(documents(spark, texts)).collect()}
    for kind in pii.ADDED:
        want = {(i, x) for i, r in enumerate(real) for x in r if x[0] == kind}
        got = {(i, x) for i, r in found.items() for x in r if x[0] == kind}
        hit = len(want & got)
        assert hit / len(want) >= 0.95 and hit / max(1, len(got)) >= 0.95, (kind, hit, len(want), len(got))


def test_a_million_characters_take_linear_time(spark):
    import time

    for text, n in (("@ " + "a" * 1_000_000, 0), ("@ " + "9" * 1_000_000 + ".", 0), ("a@b.cc " * 60_000, 60_000), ("1.1.1 " * 160_000, 0), ("x@y" * 300_000, 0)):
        df = documents(spark, [text])
        began = time.time()
        r = pii.find(df, weights={}).first()
        assert len(r.spans) == n and time.time() - began < 20, text[:20]
        assert [(s.start, s.end) for s in r.spans[-2:]] == [(len(text) - 14, len(text) - 8), (len(text) - 7, len(text) - 1)][: 2 * bool(n)]


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        r = spark.range(1).select(pii._running(F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda x: x.cast("int"))).alias("x")).first().x
        assert r == [k * (k + 1) // 2 for k in range(1, n + 2)]


def plain_redaction(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_redaction_of_overlapping_spans_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 7)
    rng = random.Random(4)
    rows = []
    for n in range(60):
        text = "".join(rng.choice("abc\n🙂é ") for _ in range(rng.randint(1, 90)))
        spans = sorted((a, rng.randint(a + 1, min(a + 12, len(text))), rng.choice(["email", "ip"])) for a in (rng.randrange(len(text)) for _ in range(n % 9)))
        rows.append((n, text, spans))
    df = spark.createDataFrame(rows, "n int, text string, spans array<struct<start:int,end:int,kind:string>>")
    got = {r.n: r.t for r in df.select("n", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {n: plain_redaction(t, s) for n, t, s in rows}


def test_many_spans_of_one_text_take_linear_time(spark):
    """60,000 base spans and 30,000 proposals, found, told apart and redacted."""
    text = "a@bc.example.org " * 60_000
    spans = [(17 * i, 17 * i + 16, "email") for i in range(60_000)]
    df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,end:int,kind:string>>").cache()
    df.count()
    start = time.time()
    got = df.select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first().t
    assert got == "[EMAIL] " * 60_000 and time.time() - start < 15
    both = spark.createDataFrame([(1, "a@bc.example.org 123-45-6789 " * 30_000)], "doc_id long, text string")
    start = time.time()
    row = pii.find(both, weights={(pii.KINDS.index("ssn"), -1, 0): 1.0}).select(F.size("base").alias("b"), F.size("spans").alias("s")).first()
    assert (row.b, row.s) == (30_000, 60_000) and time.time() - start < 60


def test_added_spans_overlap_no_base_span(spark):
    rng = random.Random(7)
    kind = "struct<start:int,no:int,end:int,kind:string>"
    rows = [(n, sorted((a, 1, a + rng.randint(1, 9), "x") for a in rng.sample(range(60), n % 7)), [(a, 5, a + rng.randint(1, 9), "y") for a in rng.sample(range(60), n % 5)]) for n in range(80)]
    df = spark.createDataFrame(rows, f"n int, base array<{kind}>, found array<{kind}>")
    got = {r.n: sorted(map(tuple, r.c)) for r in df.select("n", pii._clear(F.col("base"), F.col("found")).alias("c")).collect()}
    assert got == {n: sorted(c for c in found if not any(b[0] < c[2] and c[0] < b[2] for b in base)) for n, base, found in rows}
