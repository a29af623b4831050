"""The corpus pipeline, stage by stage, on a small table."""

import collections

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from cairn.llm import op8_near_duplicates, op9_pii


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "token_ids"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert docs.count() > 0 and (name == "token_ids" or docs.columns == columns)
        if name == "near_duplicates":
            found = op8_near_duplicates.near_duplicates(before)
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in found.where("doc_id = component_id").collect()}
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    assert good.join(kept["quality"], "doc_id", "left_semi").count() >= 0.97 * good.count()
    assert op9_pii.find(kept["personal_data"]).selectExpr("sum(size(base))").first()[0] == 0
    rows = collections.Counter(r.doc_id for r in kept["mixing"].collect())
    assert set(rows) == {r.doc_id for r in kept["personal_data"].collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in kept["mixing"].collect()}
    assert all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids for r in kept["token_ids"].collect())
    assert kept["token_ids"].count() == sum(rows.values())


def test_run_is_all_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert corpus_pipeline.ORACLE_SQL is None
