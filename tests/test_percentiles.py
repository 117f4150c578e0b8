"""Percentiles by rank, for many shares, against Spark's own and the breaks made of them."""

from pyspark.sql import functions as F

from lodestrata.operators import classify as K


def test_percentiles_of_ranks(spark):
    rows = spark.range(5003).select(((F.col("id") * 7919 % 1013) / 7).alias("v"))
    shares = [i / 999 for i in range(1000)]
    assert K.percentiles(rows, shares) == rows.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]


def test_jenks_takes_no_map_of_all_values(spark, monkeypatch):
    """A thousand shares of F.percentile cost a walk over all distinct values each."""
    df = spark.range(3000).select((F.col("id") * F.col("id") % 2003).cast("double").alias("x"))
    want = sorted(set(K.jenks(df.agg(F.percentile("x", F.array(*[F.lit(i / 999) for i in range(1000)]))).first()[0], 4)))
    monkeypatch.delattr(F, "percentile")
    assert K.class_breaks(df, "x", "jenks", 4) == want
