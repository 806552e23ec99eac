import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_mix_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns
        left = spark.createDataFrame(after.collect(), docs.schema)
        assert left.join(docs, "doc_id", "left_anti").count() == 0
    assert 150 < left.count() <= 200
    mixed = corpus_pipeline.run(spark, SF)
    assert mixed.count() == left.count()
    assert mixed.filter(F.col("taken") > 2 * F.col("size")).count() == 0


def test_operators_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
