"""Connected components by large and small stars, shared by the operators that need groups of linked rows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), "checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, without their lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) of edges (a, b); root is the component's smallest node."""
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        far = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        cur2 = far.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = cur2.groupBy("a").agg(F.min("b").alias("m"))
        nxt = cut(cur2.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = tuple(nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        cur = nxt
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def running_total(df: DataFrame, order: list, n_col: str, out: str) -> DataFrame:
    """`out`: the sum of n_col over the rows before, in that order. Rows are range-partitioned; only a sum for each partition meets in one task."""
    from pyspark.sql import Window

    part = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = part.groupBy("_p").agg(F.sum(n_col).alias("_s"))
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(n_col).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("_own", own).join(F.broadcast(sums), "_p").withColumn(out, F.col("_own") + F.col("_before")).drop("_p", "_own", "_before")  # a row for each partition
