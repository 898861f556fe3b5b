import corpus_pipeline
from latticeflow.llm import bpe, mixing, pii, quality_ftrl, simhash
from latticeflow.llm.queries import default_tokenizer

from .helpers import ODD_TEXTS, documents, write
from .test_quality import made


def test_stages_have_their_contract(spark, tmp_path):
    sf, texts, *_ = made(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "mixture", "encoding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != "encoding":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        path = f"{tmp_path}/{name}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
    assert before.count() == corpus_pipeline.run(spark, sf).count() > 0


def test_decisions_take_effect(spark, tmp_path):
    sf, texts, *_ = made(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("score", "predicted", "y")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality_ftrl.classify(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == good
    firsts = {r.doc_id for r in simhash.group(docs).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == firsts
    private = documents(spark, ["write a@b.cc", "nothing", None])
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, private, sf).collect()} == {0: ("write [EMAIL]", 13), 1: ("nothing", 7), 2: (None, 0)}
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    seen: dict[int, int] = {}
    for r in corpus_pipeline.mixture(spark, docs, sf).collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in copies.items() if v}
    tokens = {r.doc_id: r.n_tokens for r in bpe.encode(docs, default_tokenizer()).collect()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.encoding(spark, docs, sf).collect()} == tokens
    assert pii.listed is not None


def test_odd_and_empty_tables(spark, tmp_path):
    clash = {"score": "a", "base": "b", "spans": "c", "copies": "d", "copy": "e", "fp": "f", "pii_text": "g", "mix_source": "h"}
    docs = documents(spark, ODD_TEXTS, **clash)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = write(spark, tmp_path, documents=docs, labels=labels)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r.score == "a" and r.base == "b" and r.copies == "d" and r.pii_text == "g" for r in out.collect())
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.run(spark, sf).count() > 0
