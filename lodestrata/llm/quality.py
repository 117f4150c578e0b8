"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .windows import _portions, _unpacked, packed

#: Places for byte 3-grams, and after them for 1- to 3-grams of word classes.
BYTE_SLOTS, CLASS_SLOTS = 1 << 16, 1 << 15
SLOTS = BYTE_SLOTS + CLASS_SLOTS
_ROWS = 64

_KIND = np.zeros(256, np.uint32)  # class of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other ASCII mark, 6 beyond ASCII
_KIND[33:127] = 5
_KIND[[ord(c) for c in ".,;:!?"]] = 4
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 6
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _spread(x: np.ndarray, slots: int) -> np.ndarray:
    return ((x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(slots)


def indicators(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, slot) of the n-grams that occur, sorted, each once; text i is data[at[i]:at[i+1]]."""
    n = len(at) - 1
    marks = np.zeros(n * SLOTS, bool)
    owner = np.repeat(np.arange(n, dtype=np.int64) * SLOTS, np.diff(at))
    if len(data) >= 3:
        d = data.astype(np.uint32)
        gram = d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]
        same = owner[:-2] == owner[2:]
        marks[(owner[:-2] + _spread(gram, BYTE_SLOTS))[same]] = True
    if len(data):
        text = ~_SPACE[data]
        edge = np.concatenate([[True], owner[1:] != owner[:-1]])
        start = np.flatnonzero(text & (edge | np.concatenate([[True], ~text[:-1]])))
        end = np.flatnonzero(text & np.concatenate([edge[1:] | ~text[1:], [True]]))
        if len(start):
            own = owner[start]
            size = end - start + 1
            sums = np.concatenate([[0], np.cumsum(data.astype(np.int64) ** 2)])
            total = sums[end + 1] - sums[start]
            second = np.concatenate([[False], (own[1:] == own[:-1]) & (size[1:] == size[:-1]) & (total[1:] == total[:-1]) & (data[start[1:]] == data[start[:-1]]) & (data[end[1:]] == data[end[:-1]])])
            word = ((_KIND[data[start]] * 7 + _KIND[data[end]]) * 7 + _KIND[data[np.minimum(start + 1, end)]]) * 8 + np.minimum(size, 21) // 3
            word = word.astype(np.uint32) * 2 + second + 1
            marks[own + BYTE_SLOTS + _spread(word, CLASS_SLOTS)] = True
            two = own[1:] == own[:-1]
            pair = word[:-1] * np.uint32(7919) + word[1:]
            marks[(own[1:] + BYTE_SLOTS + _spread(pair + np.uint32(1 << 28), CLASS_SLOTS))[two]] = True
            if len(start) > 2:
                three = own[2:] == own[:-2]
                run = pair[:-1] * np.uint32(104729) + word[2:]
                marks[(own[2:] + BYTE_SLOTS + _spread(run + np.uint32(3 << 28), CLASS_SLOTS))[three]] = True
    hit = np.flatnonzero(marks)
    return hit // SLOTS, hit % SLOTS


def _chunks(texts: pa.Array, rows: int = _ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most `rows` texts with their bytes and bounds."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for lo in range(0, len(texts), rows):
        part = pa.concat_arrays([texts.slice(lo, rows)])
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        yield lo, lo + len(part), flat, at - at[0]


@dataclass
class Model:
    """weight of each slot, offset, and the logistic curve that turns the margin into a score."""

    weight: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, data, at in _chunks(texts):
            row, slot = indicators(data, at)
            out[lo:hi] = np.bincount(row, self.weight[slot], hi - lo)
        return out + self.offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model of indicator rows times `scale`, by dual coordinate descent; a constant feature of 1 is its offset."""
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], values[i], sign[i]
            g = y * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[r] += step * y * v
                b += step * y
                moved = max(moved, abs(step) * square[i] ** 0.5)
        if moved < 1e-3:
            break
    return w, b


def _curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton's steps, targets drawn in a little."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * t)
        t = t + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(max(t[0], 1e-3)), float(t[1])


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the identifier as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000, cost: float = 1.0, mix: float = 0.75, rounds: int = 20, seed: int = 3) -> Model:
    """Learn from the labelled rows that aren't held out.

    The log-count ratios come from all those rows, counted where they are and summed by slot. The hinge-loss model is fitted on
    the driver to a seeded sample of at most `sample_rows` of them (half of each class), 4 bytes for each n-gram place that a text
    has (some KB; 390 KB at most, for a very long text), whose identifiers are broadcast; every fifth of the sample is kept for the logistic curve. `mix` pulls the weights towards their mean size.

    Labels with nulls are left out; without labelled rows of both classes the score is their share, or 0.5.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    # the counts take every labelled text, which the labels meet by a shuffle of compressed texts, whatever their number
    every = packed(docs.where(~held_out(F.col(id_col))), id_col, text_col).join(labels.hint("merge"), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS), np.int64)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for part in _portions(batch, "body", 512 << 10):
                y = part["y"].to_numpy(zero_copy_only=False)
                for lo, hi, data, at in _chunks(_unpacked(part)):
                    row, slot = indicators(data, at)
                    for c in (0, 1):
                        sums[c] += np.bincount(slot[y[lo:hi][row] == c], minlength=SLOTS)
                n += np.bincount(y, minlength=2)
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_pydict({"slot": np.append(at, -1).astype(np.int32), "n0": np.append(sums[0][at], n[0]), "n1": np.append(sums[1][at], n[1])})

    counts = every.mapInArrow(tidy(count), "slot int, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most SLOTS + 1 rows
    slot, n0, n1 = (counts[c].to_numpy() for c in ("slot", "n0", "n1"))
    both = [int(x[slot == -1].sum()) for x in (n0, n1)]
    if not all(both):
        share = 0.5 if not sum(both) else float(both[1] > 0)
        return Model(np.zeros(SLOTS), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    p, q = np.ones(SLOTS), np.ones(SLOTS)
    p[slot[slot >= 0]] += n1[slot >= 0]
    q[slot[slot >= 0]] += n0[slot >= 0]
    ratio = np.log((p / (both[1] + 2)) / (q / (both[0] + 2)))
    ratio[(p + q) < 4] = 0

    half = sample_rows // 2
    ranked = labels.withColumn("draw", F.xxhash64(F.lit(seed), "id"))
    drawn = ranked.where("y = 0").orderBy("draw", "id").limit(half).unionByName(ranked.where("y = 1").orderBy("draw", "id").limit(half))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn.select("id", "y")), "id")  # sample_rows at most

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in _chunks(batch["text"]):
                row, slot = indicators(data, at)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"id": batch["id"].slice(lo, hi - lo), "y": batch["y"].slice(lo, hi - lo), "slots": pa.ListArray.from_arrays(ends, slot.astype(np.int32))})

    sample = rows.mapInArrow(tidy(grams), "id long, y int, slots array<int>").toArrow().sort_by("id")
    slots = [s.values.to_numpy() for s in sample["slots"].combine_chunks()] if sample.num_rows else []
    good = sample["y"].to_numpy() == 1
    sign = np.where(good, 1.0, -1.0)
    size = np.array([max(1.0, np.sqrt((ratio[s] ** 2).sum())) for s in slots])
    norm = float(np.median(size)) if len(size) else 1.0
    scale = ratio / norm
    fit = np.arange(len(slots)) % 5 != 4
    if len(set(good[fit])) < 2 or len(set(good[~fit])) < 2:
        fit = np.ones(len(slots), bool)
    weigh = np.where(good, 0.5 / max(1, good[fit].sum()), 0.5 / max(1, (~good[fit]).sum())) * fit.sum() * cost
    w, b = dual_descent([s for s, f in zip(slots, fit, strict=True) if f], scale, sign[fit], weigh[fit], rounds, seed)
    w = (1 - mix) * np.abs(w).mean() * np.sign(w) + mix * w
    model = Model(w * scale, b, 1.0, 0.0)
    rest = ~fit if not fit.all() else fit
    margin = np.array([model.weight[s].sum() + b for s, f in zip(slots, rest, strict=True) if f])
    model.slope, model.shift = _curve(margin, good[rest])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All of `docs` with the column `out` (0 to 1, higher: good). Null texts are scored like empty ones."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((model.weight.astype(np.float32), model.offset, model.slope, model.shift))  # 4 bytes for each slot
    if out in docs.columns:
        raise ValueError(f"there is a column {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for batch in batches:
            yield batch.append_column(out, pa.array(m.scores(batch[text_col])))

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields]).add(out, DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) for each row of `docs`.

    Only the text is looked at when scoring. Repeated rows get equal scores; null and empty texts get that of a text without
    n-grams; null identifiers count as not held out by their own (empty) text. Very long texts are looked at whole. Identifiers
    may have any type. Empty table: no rows. Further columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score(rows, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
