"""Benchmark decontamination by winnowed k-gram fingerprints, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save

#: Of the benchmark's windows, as strings.
BROADCAST_BYTES = 256 << 20
#: Everything in ASCII that is no lower-case letter or digit separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def _grams(n: int) -> Column:
    """Hashes of the n-grams of `words`, which has n words at least."""
    return F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.xxhash64(F.slice("words", i, n)))


def _prints(window: int, k: int, short: list[int]) -> Column:
    """Winnowed k-gram hashes of `words`, and the whole-gram hashes of the lengths of short items."""
    w = window - k + 1
    none = F.array().cast("array<bigint>")
    least = F.transform(F.sequence(F.lit(1), F.size("grams") - (w - 1)), lambda i: F.array_min(F.slice("grams", i, w)))
    all_ = [F.when(F.size("words") >= window, F.array_distinct(least)).otherwise(none)]
    all_ += [F.when(F.size("words") >= n, F.array_distinct(_grams(n))).otherwise(none) for n in short]
    return F.concat(*all_) if len(all_) > 1 else all_[0]


def text_key(id_col: str, text_col: str) -> Column:
    """Tells rows with null or equal identifiers apart by their texts."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, k: int = 7, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Which words of each document stand in a window of a benchmark item: doc_id, row, n_words, n_hit, items (sorted), contaminated.

    A window is `window` consecutive words of an item, or the whole of a shorter one. Both sides keep the least k-gram hash of
    every window (winnowing), so documents and items that share a window share a fingerprint. Fingerprints are joined, and each
    hit is extended: the windows around it are compared with the items' windows as whole strings. Items shorter than a window
    are found by the hash of their whole length, one pass for each such length (at most window-1). A document is contaminated
    if n_hit > 0 and 20 * n_hit >= n_words. `row` is `text_key`.

    The benchmark's tables are broadcast only if they have `broadcast_rows` rows (and BROADCAST_BYTES bytes of text) at most;
    beyond it the same joins shuffle. A document's fingerprint rows are combined where they are made, so one row for each document is shuffled.

    Null text has no words. Null items are no items. Every row comes out, repeated rows as often as they are there, also with
    null identifiers. Very long texts are arrays of words in one row. Empty benchmark: nothing is hit; empty table: no rows.
    Further columns are ignored.
    """
    if not 0 < k <= window:
        raise ValueError("k is 1 to window")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words")).where("item is not null and size(words) > 0")
    items = save(items.withColumn("n", F.least(F.size("words"), F.lit(window))), "items")
    short = sorted(r[0] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window-1 numbers
    spans = items.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))).alias("span")).distinct()
    spans = save(spans, "items")
    grams = F.when(F.size("words") >= k, _grams(k)).otherwise(F.array().cast("array<bigint>"))
    prints = items.withColumn("grams", grams).where(F.size("words") >= window).select(F.explode(_prints(window, k, [])).alias("print"))
    prints = prints.unionByName(items.where(F.size("words") < window).select(F.xxhash64("words").alias("print"))).distinct()
    prints = save(prints, "items")
    n_prints = prints.count()
    n_spans, span_bytes = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("span") + F.octet_length("item")), F.lit(0))).first()
    small = lambda df, n, size=0: F.broadcast(df) if n <= broadcast_rows and size <= BROADCAST_BYTES else df

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    base = base.withColumns({"row": text_key("doc_id", "body"), "words": words_of(F.col("body"))})
    found = base.withColumn("grams", grams).select("doc_id", "row", F.size("words").alias("n_words"), _prints(window, k, short).alias("prints"))
    found = found.select("doc_id", "row", "n_words", F.greatest(F.size("prints"), F.lit(1)).alias("n_prints"), F.explode_outer("prints").alias("print"))
    found = found.join(small(prints.withColumn("met", F.col("print")), n_prints), "print", "left").groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.max("n_prints").alias("n_prints"), F.count(F.lit(1)).alias("n"), F.collect_set("met").alias("met"))
    found = save(found, "prints")

    hits = found.where(F.size("met") > 0).select("row", F.col("doc_id").alias("id"), "met")
    near = base.withColumnRenamed("row", "r").join(hits, (F.col("r") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "row", "words", "met").dropDuplicates(["doc_id", "row"])
    near = near.withColumn("grams", grams)

    def starts(n: int) -> Column:
        """0-based starts of the n-word windows that a matched fingerprint allows."""
        g, reach = (F.col("grams"), window - k) if n == window else (_grams(n), 0)
        at = F.filter(F.transform(g, lambda h, i: F.when(F.array_contains("met", h), i)), lambda i: i.isNotNull())
        last = F.size("words") - n
        if reach:
            at = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - reach, F.lit(0)), F.least(p, last)))))
        return F.when(F.size("words") >= n, F.transform(at, lambda s: F.struct(s.cast("int").alias("s"), F.lit(n).alias("n")))).otherwise(F.array().cast("array<struct<s:int,n:int>>"))

    tries = F.concat(*[starts(n) for n in [*short, window]])
    tries = near.select("doc_id", "row", "words", F.explode(tries).alias("at")).select("doc_id", "row", F.col("at.s").alias("s"), F.col("at.n").alias("n"), F.array_join(F.slice("words", F.col("at.s") + 1, F.col("at.n")), " ").alias("span"))
    matched = tries.join(small(spans, n_spans, span_bytes), ["n", "span"]).groupBy("doc_id", "row").agg(F.collect_set(F.struct("s", "n")).alias("at"), F.collect_set("item").alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    matched = matched.select(F.col("doc_id").alias("id"), F.col("row").alias("r"), hit.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    # repeated rows were counted together; each comes out
    found = found.withColumn("copy", F.explode(F.expr("sequence(1, int(n / n_prints))"))).drop("copy")
    out = found.join(matched, (found["row"] == matched["r"]) & found["doc_id"].eqNullSafe(matched["id"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    n_words = F.col("n_words").cast("long")
    return out.select("doc_id", found["row"], n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"))
