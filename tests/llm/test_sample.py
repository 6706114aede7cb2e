"""Training samples of tables with repeated ids."""

from pyspark.sql import functions as F

from courtside.llm import linear


def test_sample_has_one_text_for_each_id(spark):
    ids = [r.id for r in spark.range(50).where(~linear.is_held_out("id")).limit(2).collect()]
    docs = spark.range(0, 2000, 1, 8).select(
        F.when(F.col("id") < 5, ids[0]).otherwise(ids[1]).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "doc_id long, toxic int")
    got = linear.training_sample(docs, labels, "toxic", 10).collect()
    assert sorted((r.doc_id, r.label) for r in got) == sorted([(ids[0], 0), (ids[1], 1)])
    again = linear.training_sample(docs.repartition(3), labels, "toxic", 10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
