"""The pipeline: schema between stages, decisions of each stage, registration."""

from __future__ import annotations

import hashlib

import corpus_pipeline as cp
from conftest import SF001
from mktpulse.llm import importance, lsh_forest, mixing, sentencepiece_bpe
import __spark_entry__ as se


def test_stages_in_order(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, texts, at = docs.columns, {}, docs
    for name, stage in cp.STAGES[:-1]:
        before = at
        at = cp.stored(stage(spark, at, SF001))
        assert at.columns == columns
        texts[name] = (before, at)
    before, kept = texts["quality classifier"]
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    want = {r.doc_id for r in importance.resample(before, labels).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) <= before.count()
    before, kept = texts["n-gram Jaccard join"]
    want = {r.class_id for r in lsh_forest.jaccard_classes(before).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    before, kept = texts["substring dedup"]
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r for r in kept.collect()}
    assert set(new) <= set(old) and all(r.n_chars == len(r.text) <= len(old[d]) for d, r in new.items())
    before, kept = texts["mixing sources"]
    taken = {r.doc_id: r.taken for r in mixing.Mixture(before).taken().collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, n in taken.items() if n}
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    got = cp.STAGES[-1][1](spark, kept, SF001).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(
        (r.doc_id, len(ids := lib.encode(r.text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        for r in kept.collect())


def test_odd_rows_pass_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, None, None, None), (900_002, "", "en", None, 0),
                                 (900_003, "tiny", "en", "src0", 4), (900_003, "tiny", "en", "src0", 4)], docs.schema)
    docs.limit(60).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF001}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 30


def test_registered():
    q = se.queries()
    assert "pipeline" in q and [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in q)] == list(range(1, 11))
    assert set(se.oracle_sql()) <= set(q)
