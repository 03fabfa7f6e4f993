from collections import Counter

import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import bpe, language_id, mixing, quality, simhash


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "simhash_dedup", "mixing", "bpe"]


def test_each_stage_against_its_operator(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    held = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == columns
        rows = Counter(r.doc_id for r in out.select("doc_id").collect())
        before = Counter(r.doc_id for r in held.select("doc_id").collect())
        if name == "language_id":
            fine = {r.doc_id for r in language_id.identified(held).where((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LEAST_SCORE)).collect()}
            assert set(rows) == fine
        elif name == "quality":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            assert set(rows) == {r.doc_id for r in quality.scored(held, labels).where("predicted = 1").collect()}
        elif name == "simhash_dedup":
            assert rows == Counter({r.component_id: 1 for r in simhash.grouped(held).collect()})
        elif name == "mixing":
            assert rows == Counter({r.doc_id: r.copies for r in mixing.mixed(held).select("row.doc_id", "copies").distinct().collect()})
        else:
            assert rows == before
            tk = tokenizers.Tokenizer.from_file(bpe.vocabulary())
            texts = {r.doc_id: r.text for r in held.collect()}
            assert all(r.ids == tk.encode(texts[r.doc_id], add_special_tokens=False).ids for r in out.limit(40).collect())
        held = out


def test_stages_take_awkward_rows_and_empty_tables(spark, docs, empty, sf_dir):
    labels = f"{sf_dir}"
    for name, stage in corpus_pipeline.STAGES:
        if name != "bpe":
            assert stage(spark, docs, labels).columns == docs.columns
        stage(spark, docs, labels).collect()
        assert stage(spark, empty, labels).collect() == []


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
