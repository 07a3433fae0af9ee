import corpus_pipeline
from wattline.llm import pii, quality
from wattline.llm.queries import ORACLES, QUERIES

import cases


def test_names():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(ORACLES) - {"pipeline"} <= set(QUERIES)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).checkpoint()
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "personal_data":
            assert docs.count() == before.count()
            base = pii.find(docs).agg({"n_email": "sum", "n_ip": "sum", "n_card": "sum", "n_phone": "sum"}).first()
            assert sum(base) == 0
        if name == "mixing":
            mixed = docs
    assert 0 < sizes[2] < sizes[1] < sizes[0] and sizes[4] == sizes[5]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in mixed.collect()}
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_clean_documents_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality.keep_good(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).select("doc_id").collect()}
    for r in labels.collect():
        assert (r.doc_id in kept) == (r.quality == 1)


def test_stages_stand_awkward_rows(spark, sf_dir):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    for docs in (cases.frame(spark).select(*names), cases.empty(spark).select(*names)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).checkpoint()
