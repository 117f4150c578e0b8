"""Exact duplicates by content sort.

Sampled splitters range-partition the normalised texts, an external sort places equal texts side by side, and comparing whole
neighbours cuts the runs of equal texts. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_stats, salt_mask, salt_of, save, shuffle_partitions

#: Splitters are drawn from so many leading characters (and the salt), so that what the sampling sends to the driver is bounded
#: however long the texts are. The sort and the comparison use the whole text.
SPLIT_CHARS = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", lower: bool = True) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z (`lower=False`: as they are). `keep` is "smallest" or "largest": the
    identifier that stays. The range partitioning is on (leading characters, salt of the identifier), so a text that a third of
    the rows hold is cut by the splitters into up to 64 sorted runs; each run is summed up in one row before the runs of a text
    meet by its SHA-256.

    Null text counts as empty. Null identifiers: such a row stays only if its group has no other. Rows with the same identifier
    and text: exactly one of them is kept. Very long texts: the sort compares them whole, and only their digests go further.
    Identifiers may have any type with an order. Empty table: no rows. Further columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (ascii_lower(text) if lower else text).alias("body"))
    base = base.withColumns({"head": F.substring("body", 1, SPLIT_CHARS), "salt": salt_of(F.col("doc_id"))})
    ranged = base.repartitionByRange(shuffle_partitions(docs.sparkSession), "head", "salt")
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    # (head, salt) is among the keys, so the range partitioning serves and no second exchange is planned; only a sort.
    run = Window.partitionBy("head", "salt", "body").orderBy(order)
    marks = ranged.select(
        "doc_id",
        "salt",
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"),
        F.row_number().over(run).alias("nth"),
        F.first("doc_id").over(run).alias("run_keep"),
        F.lead(F.lit(True)).over(run).isNull().alias("ends"),
    )
    marks = save(marks, "exact")
    best = F.min if keep == "smallest" else F.max
    # a run whose identifiers are all null has no run_keep; one such row is chosen by its salt
    stats = marks.where("ends").groupBy("digest").agg(best("run_keep").alias("keep_id"), F.sum(F.col("nth").cast("long")).alias("group_size"), F.min("salt").alias("null_salt"), salt_mask("salt"))
    kept = (F.col("nth") == 1) & F.when(F.col("keep_id").isNull(), F.col("salt") == F.col("null_salt")).otherwise(F.col("doc_id") == F.col("keep_id"))
    return join_stats(marks, stats, ["digest"], "salt").select("doc_id", "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
