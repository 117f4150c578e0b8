"""Line deduplication with levelled sorted runs of line hashes, all in DataFrame operations."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import ascii_lower, forget, new_path, save, shuffle_partitions

WHITE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: A scan of a bucketed table with one file a bucket tells the planner that it is sorted, so runs are merged without a sort.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _order(docs: DataFrame, id_col: str) -> Column:
    """The identifier as something that has a smallest value also where it is null, which is the smallest."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return F.struct(id_col)


def _lines(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    one = docs.select("id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(WHITE)))
    one = one.select("id", "row", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    # two 64-bit hashes with their own seeds: 128 bits
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch")
    return one.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), batch)


class Runs:
    """Sorted runs: tables of line hashes with their owners, bucketed and sorted by the hashes, in levels."""

    def __init__(self, docs: DataFrame, fanout: int):
        self.spark, self.fanout = docs.sparkSession, fanout
        self.buckets = shuffle_partitions(self.spark)
        self.levels: list[tuple[int, DataFrame]] = []
        self.made: list[DataFrame] = []
        self.compactions = 0

    def write(self, keys: DataFrame) -> DataFrame:
        """A table of the keys, in the shared folder. Keys come dealt out by the hashes, so a bucket is one file."""
        path, name = new_path(self.spark, "run"), f"lodestrata_run_{uuid.uuid4().hex}"
        keys.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch, out._table = path, name
        self.made.append(out)
        return out

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge a batch's keys (first, last: smallest and largest document) with the runs; those not met yet are a new run.

        Returns the keys that more than one document holds so far, with the smallest of these documents.
        """
        owners = []
        for k, (_, run) in enumerate(self.levels):
            keys = keys.join(run.withColumnRenamed("owner", f"owner{k}").hint("merge"), KEY, "left")
            owners.append(f"owner{k}")
        past = F.least(*owners) if len(owners) > 1 else F.col(owners[0]) if owners else F.lit(None)
        least = F.when(past.isNull() | (F.col("first") < past), F.col("first")).otherwise(past) if owners else F.col("first")
        batch = self.write(keys.select(*KEY, least.alias("owner"), past.isNull().alias("new"), (past.isNotNull() | (F.col("last") > F.col("first"))).alias("again")))
        self.levels.append((0, batch.where("new").select(*KEY, "owner")))
        return batch.where("again").select(*KEY, "owner")

    def compact(self) -> None:
        """Merge `fanout` runs of a level into one of the next, as often as there are so many."""
        level = 0
        while len(same := [r for lv, r in self.levels if lv == level]) >= self.fanout:
            merged = same[0]
            for r in same[1:]:
                both = merged.withColumnRenamed("owner", "left").join(r.hint("merge"), KEY, "full")
                merged = both.select(*KEY, F.coalesce("left", "owner").alias("owner"))
            self.levels = [x for x in self.levels if x[0] != level] + [(level + 1, self.write(merged))]
            self.compactions += 1
            level += 1

    def close(self) -> None:
        for table in self.made:
            self.spark.sql(f"drop table if exists {table._table}")
        forget(*self.made)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int | None = None, fanout: int = 2, batch_rows: int = 20_000_000) -> DataFrame:
    """Drop each line that a document with a smaller identifier also holds: doc_id, n_lines, n_dropped, text (what stays).

    A line's key is the line without white space at both ends, A-Z lower-cased; keys under `min_chars` code points stay always.
    The lines' hashes are written once, cut into `batches` parts by a hash of the identifier (by default one for `batch_rows`
    documents, at least 6). Each batch is reduced to one row for each key (combined before the shuffle) and merged against the
    runs so far; its new keys become a run of their own. Runs are tables bucketed and sorted by hash, so they are merged without
    being shuffled or sorted again, and `fanout` runs of a level are compacted into one of the next. Keys met again go, with
    their smallest document, to a table of repeats, which is joined with the lines last. That join has a plain exchange on each
    side, so a line that a third of the documents hold is split by adaptive execution.

    Null or empty text: one empty line, kept. Identifiers may have any type with an order; null ones come before all others.
    Rows with the same identifier are one document's: they don't take lines from each other. Very long texts: a document's lines
    are rows of their own until its dropped positions meet in one row. Empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), _order(docs, id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("row", F.xxhash64("text"))
    batches = batches or max(6, math.ceil(docs.count() / batch_rows))
    lines = save(_lines(base, min_chars, batches), "lines", by="batch")
    runs, again = Runs(docs, fanout), []
    before = spark.conf.get(ORDERED)
    spark.conf.set(ORDERED, "true")
    try:
        for k in range(batches):
            keys = lines.where(F.col("batch") == k).groupBy(*KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"))
            again.append(runs.add(keys))
            if k < batches - 1:
                runs.compact()
        repeats = again[0]
        for r in again[1:]:
            repeats = repeats.unionByName(r)
        owners = save(repeats.groupBy(*KEY).agg(F.min("owner").alias("owner")), "lines")
    finally:
        spark.conf.set(ORDERED, before)
        runs.close()
    gone = lines.join(owners, KEY).where("id > owner").select("id", "row", "pos")
    gone = gone.groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))
    full = base.join(gone, ["id", "row"], "left").withColumn("lines", F.split("text", "\n"))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_except(at, "gone"), lambda i: F.get("lines", i)), "\n"))
    return full.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), stay.alias("text"))
