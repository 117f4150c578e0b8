"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import forget, new_path, save

#: So many neighbouring bins are summed together before the running sum over all.
WIDE = 1024


def running_offsets(counts: DataFrame, by: list[str], bin_col: str, n_col: str) -> DataFrame:
    """`counts` with `offset`: the sum of n_col over the smaller bins of the same `by` columns.

    In two levels, so that no task gets more than max(1024, bins / 1024) rows.
    """
    counts = counts.withColumn("_wide", F.floor(F.col(bin_col) / WIDE))
    wide = counts.groupBy(*by, "_wide").agg(F.sum(n_col).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.select(*by, "_wide", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_wide").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_own", F.coalesce(F.sum(n_col).over(inside), F.lit(0))).join(wide, [*by, "_wide"]).withColumn("offset", F.col("_own") + F.col("_before")).drop("_wide", "_own", "_before")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffle_to_shards(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 17, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Write the rows in random order to `shards` folders under `path` and return what was written, with `shard` and `slot`.

    Pass one scatters whole rows to buckets of about `bucket_bytes` by a seeded hash of identifier and text. Pass two takes one
    bucket at a time into memory, sorts it by identifier (so that a run that is repeated after a loss gives the same order),
    shuffles it by Fisher-Yates with a generator seeded by bucket, and writes it. The buckets' sizes, known from a first count,
    give each row its place in the whole order; shard s takes the places from s*N/shards to (s+1)*N/shards, so counts differ by
    one at most (the law is `rows`), and slots run from 0 without gaps in the shuffled order.

    Null texts count no bytes; null identifiers are hashed like any value. Repeated rows fall into one bucket and are all
    written. Empty table: an empty result. Columns of `docs` named shard, slot or like the helpers' (_bucket, _hash, _at, _place, offset) get a trailing _in.
    """
    spark = docs.sparkSession
    docs = docs.withColumnsRenamed({c: f"{c}_in" for c in docs.columns if c.lower() in ("shard", "slot", "_bucket", "_hash", "_at", "_place", "offset")})
    names = docs.columns
    total, n = docs.agg(F.sum(utf8_size(F.col(text_col)) + 1), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    rows = docs.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("long"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = save(running_offsets(counts.withColumn("_all", F.lit(0)), ["_all"], "_bucket", "_n").select("_bucket", "offset"), "shard")

    def fisher_yates(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[(id_col, "ascending"), ("_hash", "ascending")]).to_numpy()
        rng = np.random.Generator(np.random.PCG64([seed, key[0].as_py()]))
        return table.take(pa.array(order[rng.permutation(len(order))])).append_column("_at", pa.array(np.arange(len(order), dtype=np.int64)))

    schema = StructType([*rows.schema.fields, StructField("_at", LongType())])
    mixed = rows.groupBy("_bucket").applyInArrow(fisher_yates, schema)
    mixed = mixed.join(F.broadcast(offsets) if buckets <= 1_000_000 else offsets, "_bucket")
    place = F.col("offset") + F.col("_at")
    placed = mixed.withColumn("_place", place).withColumn("shard", F.expr(f"cast(((_place + 1) * {shards} - 1) div {max(n, 1)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"_place - (shard * {n}L) div {shards}")).select(*names, "shard", "slot")
    path = path or new_path(spark, "shards")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    forget(offsets)
    return spark.read.schema(placed.schema).parquet(path)
