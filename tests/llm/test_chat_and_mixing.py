import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticeflow.llm import chat, mixing
from latticeflow.llm.queries import op7_chat

from .helpers import documents, sha, write

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes </s> \\ [INST]"), (1, 2, "user", None),
    (2, 1, "assistant", "a"), (2, 0, "user", "<|reply|>\\<|says|>"), (3, 0, "robot<s>", "x"), (3, 0, None, "y"),
    (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", ""), (4, 2, "assistant", ""), (None, 0, "user", "q"), (5, None, "user", "late" * 50_000),
]


def test_chat_digests(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    sf = write(spark, tmp_path, conversations=df)
    got = {r.conv_id: r for r in op7_chat(spark, sf).collect()}
    rows = [*ROWS, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if n is None else n), r or "", t or "") for c, n, r, t in rows if c == conv)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
        assert got[conv].formatted_chars >= sum(len(t) for *_, t in turns)
    assert [got[c].valid for c in (-1, 1, 2, 3, 4)] == [True, False, True, False, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("\\<[/sINST]>|replysay")), max_size=40), min_size=1, max_size=4))
def test_escapes_are_reversible(texts):
    import re

    t = chat.Template()
    firsts = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in t.marks)
    for x in texts:
        escaped = re.sub(rf"\\|{firsts}", lambda m: m[0] + "\\", x)
        assert not any(m in escaped for m in t.marks)
        assert re.sub(r"([\\<\[])\\", r"\1", escaped) == x


def test_escapes_in_the_engine(spark):
    t = chat.Template()
    texts = ["</s>", "<\\/s>", "<\\\\/s>", "\\\\\\", "[INST][/INST]", "[[INST]", "<<s>", "<", "", "a\n</s>\n"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.unescape(t.escape(F.col("x"))).alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_ambiguous_templates_are_refused():
    with pytest.raises(ValueError):
        chat.Template(begin="<|")
    with pytest.raises(ValueError):
        chat.Template(begin="x>")


def test_empty_conversations(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_mixing_meets_its_targets(spark):
    texts = ["w " * 10] * 300 + ["w " * 10] * 60 + ["w " * 10] * 20
    rows = [(i, t, "en", "big" if i < 300 else "mid" if i < 360 else None, 1, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (999, None, "en", "none", 1, "clash")], "doc_id long, text string, lang string, source string, n_chars long, weight_ string")
    got = mixing.mix(docs, entropy=0.9, repeats=10.0).collect()
    weight = {r.source: r.weight for r in got if r.source != "none"}
    spread = -sum(w * math.log(w) for w in weight.values()) / math.log(3)
    assert abs(spread - 0.9) < 1e-6 and abs(sum(weight.values()) - 1) < 1e-9
    for s in weight:
        tokens = sum(10 * r.copies for r in got if r.source == s)
        assert 0 <= weight[s] * 3800 - tokens < 10 + 1e-6
    assert [r.copies for r in got if r.doc_id == 999] == [0]
    limited = mixing.mix(docs, entropy=1.0, repeats=2.0).collect()
    w = {r.source: r.weight for r in limited}
    assert max(w[None] * 3800 / 200, 0) <= 2.0 + 1e-4
    assert max(r.copies for r in limited) <= 2


def test_natural_mix_keeps_everything_once(spark):
    docs = documents(spark, ["a b c"] * 9)
    assert {r.copies for r in mixing.mix(docs).collect()} == {1}
    assert mixing.realised(docs).count() == 9 and mixing.realised(docs).columns == docs.columns
    assert mixing.mix(documents(spark, [])).count() == 0


def test_budget_and_repeated_rows(spark):
    docs = documents(spark, ["a b c d e"] * 50)
    small = mixing.mix(docs, budget=60).collect()
    assert 40 <= sum(5 * r.copies for r in small) <= 60
    twice = docs.union(docs)
    both = mixing.mix(twice, budget=120).groupBy("doc_id").agg(F.countDistinct("copies").alias("n")).where("n > 1")
    assert both.count() == 0


def test_columns_with_the_added_names(spark):
    docs = documents(spark, ["a b c"] * 9, weight="w", exponent="e", passes="p", cut_doc="d", copies="c", mix_block="m", n_tokens="t")
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "exponent_", "weight_", "copies_"]
    r = got.first()
    assert (r.weight, r.exponent, r.passes, r.cut_doc, r.copies, r.mix_block, r.n_tokens, r.copies_) == ("w", "e", "p", "d", "c", "m", "t", 1)
    done = mixing.realised(docs)
    assert done.columns == docs.columns and done.count() == 9 and done.first().copies == "c"


def plain_exponent(totals, entropy, repeats):
    """Bisections with plain sums over the sources."""
    everything = sum(totals)

    def shares(e):
        raised = [(t / everything) ** e for t in totals]
        z = math.fsum(raised)
        return [x / z for x in raised]

    def bisected(fits):
        if fits(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(mixing.STEPS):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if fits(m) else (lo, m)
        return lo

    spread = lambda e: -math.fsum(w * math.log(w) for w in shares(e))
    most = lambda e: max(w * everything / t for w, t in zip(shares(e), totals))
    flat = bisected(lambda e: spread(e) >= entropy * math.log(len(totals)) - 1e-12)
    steep = bisected(lambda e: most(e) > repeats) if most(0.0) > repeats else 0.0
    e = max(flat, steep)
    return e, shares(e)


@pytest.mark.parametrize("many", [False, True])
def test_weights_equal_plain_bisections(spark, many):
    totals = [1 + (i * i * 7919) % 99_991 + (10**8 if i % 500 == 0 else 0) for i in range(10_000)] if many else [5, 5, 5, 900, 40, 40, 1]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(totals)], "mix_source string, total long")
    for entropy, repeats in ((0.99, 1e9), (0.95, 3.0)):
        got = {int(r.mix_source): r for r in mixing.weights(df, None, entropy, repeats).collect()}
        e, w = plain_exponent(totals, entropy, repeats)
        assert len(got) == len(totals) and abs(got[0].exponent - e) < 2e-9
        assert max(abs(got[i].weight / w[i] - 1) for i in got) < 1e-6
        assert all(abs(got[i].quota - w[i] * sum(totals)) < 1 + 1e-5 * w[i] * sum(totals) for i in got)


def test_many_sources_are_joined_plainly(spark, monkeypatch):
    docs = documents(spark, [f"{'w ' * (1 + i % 9)}" for i in range(60)])
    few = sorted(map(tuple, mixing.mix(docs, entropy=1.0).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs, entropy=1.0).collect())) == few
