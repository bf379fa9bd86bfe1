"""The pipeline's stages and its result."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from capsule.llm import bpe, classifier


def test_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    left, seen = docs, {}
    for name, step in corpus_pipeline.STAGES:
        before, left = left, corpus_pipeline.stage(step(spark, left, root), name)
        seen[name] = (before, left)
        if name != "byte_bpe":
            assert left.columns == docs.columns
    before, after = seen["quality_classifier"]
    scored = classifier.score(before, classifier.train(before, spark.read.parquet(f"{root}/labels.parquet")))
    assert sorted(r.doc_id for r in scored.where("score >= 0.3").collect()) == sorted(r.doc_id for r in after.collect())
    before, after = seen["ngram_jaccard_join"]
    classes = brute.classes([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in classes.items() if c[1] == i)
    before, after = seen["secret_scans"]
    assert before.count() == after.count()
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in brute.secrets(texts[r.doc_id])[1].split(",") if x]
        assert r.n_chars == len(r.text) or r.text == texts[r.doc_id]
        assert all(texts[r.doc_id][a:b] not in r.text for a, b in spans)
        assert spans or "[secret]" in r.text or r.text == texts[r.doc_id]
    before, after = seen["source_mixing"]
    size = {r.source: r.n for r in after.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    assert len(size) == before.select("source").distinct().count()
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    before, after = seen["byte_bpe"]
    text = {r.doc_id: r.text for r in before.collect()}
    back = bpe.decode(after, *bpe.vocabulary_file()).collect()
    assert len(back) == before.count() and all(r.decoded == text[r.doc_id] for r in back)


def test_run(spark, root):
    got = corpus_pipeline.run(spark, root).collect()
    assert got and all(r.n_tokens == len(r.ids) for r in got)


def test_pipeline_on_an_empty_table(spark, tmp_path, root):
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{root}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
