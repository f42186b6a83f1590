"""The scorer's sample does not depend on where rows lie."""

from pyspark.sql import functions as F

from holdfast.llm import quality


def test_sample_is_by_hash_alone(spark):
    docs = spark.range(3_000).select(F.when(F.col("id") >= 1_500, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    picks = [sorted(r.text for r in quality._sampled(d, 3_000, 300).collect()) for d in (docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(1), docs.repartition(3, "text"))]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 300
    # Rows with null id are drawn one by one: about half of the rows have one.
    assert 100 < sum(int(t.split()[1]) < 1_500 for t in picks[0]) < 200
