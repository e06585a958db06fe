import os

import corpus_pipeline
from radiokpi.llm import quality
from radiokpi.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == columns
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0 and counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(r["piece"] == 0 for r in last) == counts[4]


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r[0] for r in quality.kept(docs, labels).select("doc_id").collect()}
    good = [r[0] for r in labels.where("quality = 1").select("doc_id").collect()]
    assert sum(d in kept for d in good) >= 0.97 * len(good)


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, DATA)
        assert docs_out.count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert os.path.exists(corpus_pipeline.__file__)
