"""What the operators of this subpackage share: scratch tables, salted key joins, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hot keys are dealt over so many parts; a part is a bit of one long, so not more than 64.
SALTS = 64

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/lodestrata/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder (a folder for each value of the column `by`) and read back: cuts the lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by save() that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Give memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task's function, after which its Python worker, which lives on, gives memory that it no longer uses back to the system."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made meanwhile hand their rows to Python at most so many at a time: a batch stands in the JVM and in the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = int(spark.conf.get(key))
    spark.conf.set(key, str(min(old, rows) if old > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(old))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt_of(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def salt_bit(salt: Column) -> Column:
    return F.expr("shiftleft(1L, 0)") if salt is None else F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def explode_salts(df: DataFrame, mask: str, salt: str) -> DataFrame:
    """One row for each set bit of the mask; at most SALTS."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col(mask), s) == 1)
    return df.withColumn(salt, F.explode(bits)).drop(mask)


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], salt: str, how: str = "inner") -> DataFrame:
    """Join rows with one row for each key, `stats`, that has the bit mask `_salts` of the rows' salts.

    Each stats row is repeated for the salts its key really has, so a key that a third of the rows hold is dealt over SALTS parts.
    """
    return rows.join(explode_salts(stats, "_salts", salt), [*keys, salt], how)


def salt_mask(salt: str) -> Column:
    return F.bit_or(salt_bit(F.col(salt))).alias("_salts")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star rounds, each a groupBy that Spark combines before it shuffles, until no edge changes;
    each round is written to the shared folder. A node with many edges is dealt over SALTS parts in the joins. Nodes are any
    long numbers. Isolated nodes don't appear.
    """
    cur = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    mark = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("salt", salt_of(F.col("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m"), salt_mask("salt")).select("a", F.least("a", "_m").alias("m"), (F.col("_m") < F.col("a")).alias("has"), "_salts")
        # large star: each larger neighbour is tied to the smallest of the neighbourhood
        large = join_stats(both.where("b > a"), low.select("a", "m", "_salts"), ["a"], "salt").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.where("has").select("a", F.col("m").alias("b"))
        nxt = large.unionByName(own).where("a <> b").distinct().withColumn("salt", salt_of(F.col("b")))
        # small star: smaller neighbours are tied to the smallest
        mins = nxt.groupBy("a").agg(F.min("b").alias("m"), salt_mask("salt"))
        small = join_stats(nxt, mins, ["a"], "salt").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(mins.select("a", F.col("m").alias("b"))).distinct()
        new = save(small, "cc")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()
        forget(cur)
        cur = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
