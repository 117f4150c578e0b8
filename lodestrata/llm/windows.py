"""Search for repeated windows of tokens, shared by the suffix-sort and the substring operators.

A window is `length` consecutive tokens of a document. Each window has an anchor: the k-gram in it with the least hash (the
leftmost of equals), so equal windows have equal anchors at equal places. Neighbouring windows mostly share their anchor; such
a run of windows is a region. Documents are first cut into regions, one small row each (about 2 / (length - k + 2) per token).

Regions whose anchor occurs nowhere else hold no repeated window. Of the others, equal regions (anchor and whole text, by 128 bits)
form a class, of which one region stands for all with the mark that there are more. These are fetched from the texts and settled
on them by the operator's own method, and what it finds goes back to all members of the class.

An anchor with more than HOT classes (the edge of a passage that many documents share) is too much for one task. Its regions are
dealt out once more, each window on its own with the whole window as the anchor, and then go the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, explode_salts, forget, salt_mask, salt_of, save, tidy

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
PLACE_BITS = U(24)
#: Tokens looked at together; a longer document is cut into overlapping pieces.
CHUNK = 1 << 18
#: Classes of one anchor that are settled together.
HOT = 4000
#: Regions or windows that are settled in one portion of a task.
SHARD = 2000

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse modulo 2^64."""
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        size = (n + (1 << 16)) >> 16 << 16
        base = int(BASES[which])
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = _powers[which] = (out[0], out[1])
    return got


class Sums:
    """Polynomial hashes of any stretch of a token array."""

    def __init__(self, values: np.ndarray, which: int):
        self.power, inverse = _power(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * inverse[: len(values)], out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.power[:n]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        # the power undoes the place; hi is after the last token
        return (self.sums[hi] - self.sums[lo]) * self.power[lo]


_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def byte_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token values and each text's bounds among them: bytes."""
    return _BYTE[data], at


_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and each text's bounds among the words. Words are separated by ASCII white space."""
    text = ~_WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.concatenate([[False], text[:-1]]) if len(data) else text
    start = np.flatnonzero(text & (first[:-1] | ~before))
    after = np.concatenate([text[1:], [False]]) if len(data) else text
    end = np.flatnonzero(text & (first[1:] | ~after)) + 1
    return start, end, np.searchsorted(start, at)


def word_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, bounds = word_bounds(data, at)
    sums = Sums(_BYTE[data], 1)
    return _mix(sums.of(start, end) + U(0x632BE59BD9B4E019) * (end - start).astype(U)) | U(1), bounds


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x) - w + 1
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[w - step : w - step + n]) if step < w else x[:n]


@dataclass
class Regions:
    """Of each region: its text (number), its first window, how many windows, its anchor's hash and its whole text's hash."""

    owner: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray


def regions(values: np.ndarray, at: np.ndarray, length: int, k: int) -> Regions:
    """Cut the windows of the texts values[at[i]:at[i+1]] into regions."""
    parts = []
    sizes = np.diff(at)
    lo = 0
    while lo < len(sizes):
        if sizes[lo] > CHUNK:
            for c in range(0, int(sizes[lo]) - length + 1, CHUNK):
                piece = values[at[lo] + c : min(at[lo + 1], at[lo] + c + CHUNK + length - 1)]
                parts.append(_regions(piece, np.array([0, len(piece)]), np.array([lo]), np.array([c]), length, k))
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, side="right")) - 1)
        big = np.flatnonzero(sizes[lo:hi] > CHUNK)
        hi = lo + int(big[0]) if len(big) else hi
        parts.append(_regions(values[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64), length, k))
        lo = hi
    if not parts:
        parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))]
    return Regions(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _regions(values, at, owner, shift, length, k):
    n = len(values) - length + 1
    sizes = np.diff(at)
    if n <= 0 or not (sizes >= length).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U))
    low, high = Sums(values, 0), Sums(values, 1)
    grams = _mix(low.every(k))
    packed = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=U)
    place = (_least(packed, length - k + 1) & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
    fits = np.zeros(len(values) + 1, np.int64)
    whole = np.flatnonzero(sizes >= length)
    np.add.at(fits, at[whole], 1)
    np.add.at(fits, at[whole] + sizes[whole] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(fits)[:n])
    p = place[windows]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(windows) != 1)]))
    first = windows[cut]
    count = np.diff(np.append(cut, len(windows)))
    p = p[cut]
    text = _mix(high.of(first, first + count - 1 + length)) + _mix(count.astype(U) * U(0x9FB21C651E98DF25) + (p - first).astype(U))
    own = np.searchsorted(at, first, side="right") - 1
    return owner[own], first - at[own] + shift[own], count, grams[p], text


def _texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their bounds; null is empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    array = pa.concat_arrays([array])
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def _portions(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the column."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.diff(np.cumsum(size) // most, append=-1)) + 1
    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        yield batch.slice(lo, hi - lo)


def _unpacked(batch: pa.RecordBatch) -> pa.Array:
    open_ = zstandard.ZstdDecompressor()
    return pa.array([open_.decompress(x.as_py()) for x in batch["body"]], pa.large_binary())


def document_number(id_col: str, text_col: str) -> Column:
    """Tells documents apart: the identifier (a hash of one that is no whole number), or where it is null a number over 2^62 made from the text."""
    return F.coalesce(F.col(id_col).try_cast("long"), F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.shiftrightunsigned(F.xxhash64(F.lit(5), text_col), 2) + F.lit(2**62))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and what tells documents apart: `row`, the number, and `mark`, a hash of the text."""
    return docs.select(F.col(id_col).alias("id"), document_number(id_col, text_col).alias("row"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row, mark and the text compressed, so that what is shuffled stays small."""
    rows = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in _portions(batch, "text"):
                body = [press.compress(x.as_py() or b"") for x in part["text"].cast(pa.binary())]
                yield pa.RecordBatch.from_pydict({"id": part["id"], "row": part["row"], "mark": part["mark"], "body": pa.array(body, pa.binary())})

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, row long, mark long, body binary")


_SEED = U(0x2545F4914F6CDD1D)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def find_repeats(docs: DataFrame, tokens: Callable, slices: Callable, settle: Callable, length: int, k: int, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """Runs of repeated windows: row, mark, first, count.

    `tokens(bytes, bounds)` gives token values and bounds; `slices(bytes, bounds, owner, lo, hi)` the bytes of token ranges;
    `settle(contents, counts, twice, bounds)` tells for regions, of which those between two bounds share an anchor, which of
    their windows are repeated (pairs of region and boolean array); a region that is there `twice` stands for equal ones.
    """
    rows = _rows(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text"):
                r = regions(*tokens(*_texts(part["text"])), length, k)
                row, mark = (part[c].to_numpy(zero_copy_only=False) for c in ("row", "mark"))
                yield pa.RecordBatch.from_pydict({"row": row[r.owner], "mark": mark[r.owner], "first": r.first.astype(np.int32), "count": r.count.astype(np.int32), "anchor": _long(r.anchor), "whole": _long(r.whole)})

    cuts = save(rows.select("row", "mark", "text").mapInArrow(tidy(cut), "row long, mark long, first int, count int, anchor long, whole long"), "regions")
    salted = cuts.withColumn("salt", salt_of(F.col("row")))
    anchors = salted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), salt_mask("salt")).where("n > 1").drop("n")
    met = save(salted.join(explode_salts(anchors, "_salts", "salt"), ["anchor", "salt"]), "regions")
    forget(cuts)
    # the first ones are all of the same row, and long numbers, which are combined without sorting
    one = [F.first(c).alias(c) for c in ("row", "mark", "first", "count")]
    classes = save(met.groupBy("anchor", "whole").agg((F.count(F.lit(1)) > 1).alias("twice"), *one, salt_mask("salt")), "regions")
    heavy = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > hot)
    heavy = heavy.select("anchor", F.lit(True).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wanted = classes.withColumn("salt", salt_of(F.col("row"))).join(heavy, ["anchor", "salt"], "left").drop("salt")
    wanted = wanted.groupBy("row", "mark").agg(F.collect_list(F.struct("anchor", "whole", "_salts", "twice", F.col("hot").isNotNull().alias("hot"), "first", "count")).alias("want"))
    asked = packed(docs, id_col, text_col).drop("id").join(wanted, ["row", "mark"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "body", 256 << 10):
                want = part["want"]
                data, at = _texts(_unpacked(part))
                _, bounds = tokens(data, at)
                owner = np.repeat(np.arange(len(part)), pc.list_value_length(want).to_numpy(zero_copy_only=False))
                w = want.flatten()
                first, count = (w.field(c).to_numpy().astype(np.int64) for c in ("first", "count"))
                lo = bounds[owner] + first
                content = slices(data, at, lo, lo + count - 1 + length)
                fields = {c: w.field(c) for c in ("anchor", "whole", "_salts", "twice", "hot", "count")}
                for s in range(0, len(w), 20_000):
                    e = slice(s, s + 20_000)
                    yield pa.RecordBatch.from_pydict({c: v[e] for c, v in fields.items()} | {"content": pa.array(content[e], pa.binary())})

    asked = save(asked.mapInArrow(tidy(fetch), "anchor long, whole long, _salts long, twice boolean, hot boolean, count int, content binary"), "regions")

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("whole", "ascending")])
        anchor, count, twice = (table[c].to_numpy() for c in ("anchor", "count", "twice"))
        ends = np.flatnonzero(np.concatenate([anchor[1:] != anchor[:-1], [True]])) + 1
        which, first, size = [], [], []
        for i, marks in settle(table["content"].to_pylist(), count, twice, np.concatenate([[0], ends])):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
            which += [i] * (len(edge) // 2)
            first += edge[::2].tolist()
            size += (edge[1::2] - edge[::2]).tolist()
        found = table.select(["anchor", "whole", "_salts"]).take(pa.array(which, pa.int64()))
        return found.append_column("first", pa.array(first, pa.int32())).append_column("count", pa.array(size, pa.int32()))

    def settled(units: DataFrame, many: int) -> DataFrame:
        shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, many // SHARD))).alias("shard")
        return units.select("anchor", "whole", "_salts", "twice", "count", "content", shard).groupBy("shard").applyInArrow(judge, "anchor long, whole long, _salts long, first int, count int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of regions of hot anchors: the region, the place in it, two hashes and the text of the window."""
        for batch in batches:
            for part in _portions(batch, "content", 16 << 10):
                data, at = _texts(part["content"])
                values, bounds = tokens(data, at)
                n = part["count"].to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(part)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lo = bounds[owner] + step
                low, high = (_mix(Sums(values, x).of(lo, lo + length) ^ _SEED) for x in (0, 1))
                fields = {c: part[c].take(pa.array(owner)) for c in ("anchor", "whole", "_salts", "twice")}
                yield pa.RecordBatch.from_pydict(fields | {"step": step.astype(np.int32), "anchor2": _long(high), "whole2": _long(low), "content": pa.array(slices(data, at, lo, lo + length), pa.binary())})

    each = asked.where("hot").drop("hot").mapInArrow(tidy(windows), "anchor long, whole long, _salts long, twice boolean, step int, anchor2 long, whole2 long, content binary")
    each = each.withColumn("salt2", salt_of(F.col("whole")))
    shared = each.groupBy("anchor", "anchor2", "whole2").agg((F.sum(F.when(F.col("twice"), 2).otherwise(1)) > 1).alias("twice"), F.first("content").alias("content"), salt_mask("salt2"))
    shared = save(shared.where("twice").select(F.xxhash64("anchor", "anchor2").alias("anchor"), F.col("whole2").alias("whole"), "_salts", "twice", F.lit(1).alias("count"), "content"), "regions")
    again = save(settled(shared, shared.count()), "regions")
    warm = each.select(F.xxhash64("anchor", "anchor2").alias("a"), F.col("whole2").alias("w"), "salt2", "anchor", "whole", "_salts", "step")
    again = explode_salts(again.select(F.col("anchor").alias("a"), F.col("whole").alias("w"), F.col("_salts").alias("_s")).distinct(), "_s", "salt2")
    # a class has at most length - k + 1 windows
    warm = warm.join(again, ["a", "w", "salt2"]).groupBy("anchor", "whole", "_salts").agg(F.collect_set("step").alias("steps"))
    starts = F.array_sort(F.filter("steps", lambda s: ~F.array_contains("steps", s - 1)))
    ends = F.array_sort(F.filter("steps", lambda s: ~F.array_contains("steps", s + 1)))
    warm = warm.select("anchor", "whole", "_salts", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r")).select("anchor", "whole", "_salts", F.col("r.s").alias("first"), (F.col("r.e") - F.col("r.s") + 1).alias("count"))
    cold = asked.where("not hot")
    runs = settled(cold, cold.count()).unionByName(warm)
    runs = runs.groupBy("anchor", "whole").agg(F.collect_set(F.struct("first", "count")).alias("runs"), F.first("_salts").alias("_salts"))
    spans = met.select("anchor", "whole", "salt", "row", "mark", F.col("first").alias("at")).join(explode_salts(runs, "_salts", "salt"), ["anchor", "whole", "salt"])
    return spans.select("row", "mark", "at", F.explode("runs").alias("r")).select("row", "mark", (F.col("at") + F.col("r.first")).alias("first"), F.col("r.count").alias("count"))


def kept_parts(docs: DataFrame, spans: DataFrame, work: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Join the runs of repeated windows to the documents and apply `work(bytes, bounds, owner, first, count)` to portions of them.

    `work` returns a dict of columns with a value for each text; the result has doc_id and these.
    """
    per = spans.groupBy("row", "mark").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    rows = packed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    rows = rows.join(per, ["row", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "body", 256 << 10):
                data, at = _texts(_unpacked(part))
                n = pc.fill_null(pc.list_value_length(part["spans"]), 0).to_numpy(zero_copy_only=False)
                w = part["spans"].flatten()
                owner = np.repeat(np.arange(len(part)), n)
                first, count = (w.field(c).to_numpy().astype(np.int64) for c in ("first", "count"))
                out = work(data, at, owner, first, count)
                yield pa.RecordBatch.from_pydict({"doc_id": part["id"], **out})

    return rows.mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, {schema}")


def covered(total: int, lo: np.ndarray, hi: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of `total` tokens stand in one of the ranges, each cut off at `most`, the end of its document."""
    hi = np.minimum(hi, most)
    lo = np.minimum(lo, hi)
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps)[:total] > 0
