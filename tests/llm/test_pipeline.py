"""The pipeline's stages on the smallest tables, each against what its operator promises."""

import corpus_pipeline
from keyloom.llm import decontaminate, near_dedup

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        if name == "near_dedup":
            classes = near_dedup.classes(out)
            assert classes.where("doc_id <> class_id").count() == 0
        if name == "decontamination":
            again, hits = decontaminate.contaminated(out, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert again.where(f"size({hits}) > 0").count() == 0
        docs = out
        sizes.append(out.count())
    assert docs.select("doc_id").distinct().count() == sizes[-2]


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and rows.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
