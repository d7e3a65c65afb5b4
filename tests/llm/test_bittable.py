import pytest
from pyspark.sql import functions as F

from crossfade.llm import bittable as B


@pytest.mark.parametrize("bound", [1 << 26, 1 << 16])
def test_without_is_an_exact_anti_join(spark, monkeypatch, bound):
    monkeypatch.setattr(B, "MAX_BITS", bound)  # the small table is full and lets most rows pass to the join
    df = spark.range(60_000).select(F.when(F.col("id") % 1000 != 7, F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("_gone_not"))
    gone = spark.range(60_000).where("id % 3 = 0").select(F.col("id").alias("doc_id"))
    got = B.without(df, "doc_id", gone)
    assert got.columns == df.columns and got.where("doc_id is null").count() == 60
    assert got.where("doc_id % 3 = 0").count() == 0 and got.count() == df.where("doc_id is null or doc_id % 3 <> 0").count()
    assert B.without(df, "doc_id", gone.limit(0)).count() == 60_000 and B.without(df.limit(0), "doc_id", gone).count() == 0
