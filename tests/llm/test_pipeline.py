import corpus_pipeline
from llm_helpers import same_rows

from lectern.llm import decontaminate, neardup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "decontamination", "mixing"]
    decided = {
        "quality": lambda d: quality.grade(d, labels).where("predicted = 1"),
        "toxicity": lambda d: toxicity.grade(d, labels).where("predicted = 0"),
        "near duplicates": lambda d: neardup.near_duplicates(d).where("kept"),
        "decontamination": lambda d: decontaminate.judge(d, items).where("not contaminated"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        same_rows(out, docs)
        assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in decided[name](docs).select("doc_id").collect()}
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, mixed.collect()))


def test_hard_rows_in_every_stage(spark, hard_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        same_rows(stage(spark, hard_docs, SF), hard_docs)
        assert stage(spark, hard_docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, hard_docs, SF).count() == hard_docs.count()
