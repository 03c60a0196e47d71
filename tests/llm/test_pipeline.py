"""The pipeline stage by stage on a small fixture, against what each operator says of the stage's own input."""

import corpus_pipeline
from duskwave.llm import mixing, simhash

from .test_operators import ODD, decontam, documents, prose, speak


def test_stages(spark, tmp_path):
    texts = [speak(x, i) for x in ("en", "de", "fr") for i in range(20)] + ODD + [speak("en", 3), prose(100, 30)]
    langs = ["en"] * 20 + ["de"] * 20 + ["fr"] * 20 + [None] * len(ODD) + ["en", "en"]
    docs = documents(spark, texts, langs=langs, sources=[f"s{i % 4}" for i in range(len(texts))])
    spark.createDataFrame([(1, prose(100, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 0:
            assert {r["doc_id"] for r in seen.select("doc_id").collect()} - {r["doc_id"] for r in out.select("doc_id").collect()} == {60 + i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
        if k == 1:
            named = simhash.near_duplicates(seen, prints=simhash.PRINTS)
            assert {r["doc_id"] for r in out.collect()} == {r["component_id"] for r in named.collect()}
        if k == 2:
            left = {r["doc_id"] for r in out.collect()}
            assert len(texts) - 1 not in left and len(left) == seen.count() - 1
        if k == 4:
            assert out.count() == seen.count() and out.select("shard", "slot").distinct().count() == out.count()
        seen = out
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.count() == seen.count()


def test_mixed_texts_are_whole(spark, tmp_path):
    texts = [prose(i, 40 + 13 * i) for i in range(12)]
    docs = documents(spark, texts, sources=[f"s{i % 3}" for i in range(12)])
    want = mixing.mix_plan(docs)
    assert want.where("exists(draws, x -> x.words < size)").count() > 0  # an end of a quota falls into a text
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()]
    assert all(t == texts[i] for i, t in got)
    assert sorted(i for i, _ in got) == sorted(r["doc_id"] for r in want.collect() for _ in r["draws"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert decontam.words_of(None) == []
