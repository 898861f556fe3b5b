import numpy as np
import pytest

from latticeflow.llm import bpe
from latticeflow.llm.queries import default_tokenizer, op1_bpe

from .helpers import ODD_TEXTS, documents, sha, write

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [*ODD_TEXTS, "The <|endoftext|> of <|startoftext|>", "don't I'LL we've", "aaaa aaaaaaaaa aaa", "1234 12٣٤", "\u1c89 \u10d50 \ua7dc ⁏", "Straße ÉÀÇ naïve"]


def test_equals_the_library(spark, tmp_path):
    lib = tokenizers.Tokenizer.from_file(default_tokenizer())
    sf = write(spark, tmp_path, documents=documents(spark, TEXTS))
    got = {r.doc_id: r for r in op1_bpe(spark, sf).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert got[i].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))


def test_merges_like_one_word_at_a_time():
    coder = bpe.WordBpe(open(default_tokenizer(), "rb").read())
    rng = np.random.default_rng(3)
    for _ in range(300):
        word = "".join(rng.choice(list("abthe"), rng.integers(1, 12)))
        ids = [*map(coder.inner.__getitem__, word[:-1].encode()), coder.final[ord(word[-1])]]
        while True:
            ranked = [(coder.rules[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in coder.rules]
            if not ranked:
                break
            (_, new), k = min(ranked)
            ids[k : k + 2] = [new]
        assert np.frombuffer(coder.encode_words([word])[0], "<u4").tolist() == ids


def test_one_index_per_partition_in_bounded_parts(spark, monkeypatch):
    """Whatever the size of the parts, the same ids come out; within one, every distinct word is laid out once."""
    lib = tokenizers.Tokenizer.from_file(default_tokenizer())
    docs = documents(spark, TEXTS).coalesce(1)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    for chunk in (1, 50, 10**9):
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, default_tokenizer(), chunk=chunk).collect()}
        assert got == want
    held = bpe.Chunk(bpe.WordBpe(open(default_tokenizer(), "rb").read()))
    for t in ("the cat the cat", "a cat <|endoftext|>", None):
        held.add(t)
    laid = []
    monkeypatch.setattr(held.bpe, "encode_words", lambda words: laid.append(words) or bpe.WordBpe.encode_words(held.bpe, words))
    assert [np.frombuffer(x, "<u4").tolist() for x in held.encoded()] == [lib.encode(t, add_special_tokens=False).ids for t in ("the cat the cat", "a cat <|endoftext|>", "")]
    assert laid == [["the", "cat", "a"]]


def test_ids_as_numbers_and_empty_table(spark):
    done = bpe.encode(documents(spark, ["hello world", ""]), default_tokenizer())
    rows = {r.doc_id: r for r in bpe.ids_as_array(done).collect()}
    raw = {r.doc_id: r for r in done.collect()}
    assert rows[0].ids == np.frombuffer(raw[0].ids, "<u4").tolist() and rows[1].ids == []
    assert bpe.encode(documents(spark, []), default_tokenizer()).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    docs = documents(spark, ["same text", "same text"], n_tokens="x", ids="y")
    got = bpe.encode(docs, default_tokenizer()).collect()
    assert len({bytes(r.ids) for r in got}) == 1 and len(got) == 2
