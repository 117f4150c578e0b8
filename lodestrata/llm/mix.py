"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .shard import running_offsets

#: Weights are whole parts of about this, so a schedule repeats after as many slots.
PARTS = 1 << 20
NO_SOURCE = "\x00null"


def earliest_deadline(part: list[int], slots: int) -> np.ndarray:
    """The source of each of the first `slots` slots: earliest deadline first among released blocks.

    Block j (from 1) of a source of weight w = part / sum(part) is released at floor((j-1)/w) and due at ceil(j/w). Every block
    meets its deadline, so at any slot a source has had its share to within one block. After sum(part) slots each source has
    had its part of blocks and all starts again, so no more slots are ever asked for.
    """
    whole = sum(part)
    waiting = [(0, i, 1) for i in range(len(part))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    out = np.zeros(slots, np.int64)
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * whole // part[i]), i, j))
        _, i, j = heapq.heappop(ready)
        out[t] = i
        heapq.heappush(waiting, (j * whole // part[i], i, j + 1))
    return out


@dataclass
class Phase:
    """The slots from `start` on, up to the one in which a source has its last block.

    Source i has its parts[i] blocks of a period of `whole` slots at the slots at[i], and in this phase the blocks from first[i]
    on, blocks[i] of them.
    """

    start: int
    whole: int
    parts: dict[int, int]
    first: dict[int, int]
    blocks: dict[int, int]
    at: dict[int, np.ndarray]
    ends: int


def phases(sizes: list[int], weights: list[float]) -> Iterator[Phase]:
    """One phase for each source that ends; in each the weights of those that are left are scaled to sum to 1.

    A phase costs one period at most (about PARTS slots), however many blocks it has.
    """
    left, done, start = list(sizes), [0] * len(sizes), 0
    while active := [i for i, n in enumerate(left) if n > 0]:
        part = [max(1, round(weights[i] * PARTS)) for i in active]
        common = math.gcd(*part)
        part = [p // common for p in part]
        whole = sum(part)
        dealt = earliest_deadline(part, min(whole, sum(left)))
        at = {i: np.flatnonzero(dealt == k) for k, i in enumerate(active)}
        last = {}
        for k, i in enumerate(active):
            periods, rest = divmod(left[i] - 1, part[k])
            if rest < len(at[i]):  # else it ends after all the slots that are left, so another ends before
                last[i] = periods * whole + int(at[i][rest])
        ends = min(last, key=last.__getitem__)
        periods, rest = divmod(last[ends], whole)
        blocks = {i: periods * part[k] + int(np.searchsorted(at[i], rest, side="right")) for k, i in enumerate(active)}
        yield Phase(start, whole, dict(zip(active, part, strict=True)), {i: done[i] for i in active}, blocks, at, ends)
        for i in active:
            done[i] += blocks[i]
            left[i] -= blocks[i]
        start += last[ends] + 1


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 64, seed: int = 29, power: float = 0.5) -> DataFrame:
    """Interleave the sources' rows by target weights: doc_id, source, weight, block, slot, position (from 0, without gaps).

    `weights` are the sources' shares (scaled to sum to 1; a source not named gets the least of those named); without them a
    source of n rows weighs n ** power. Weights are held as whole parts of 2^20. A source's rows, in the order of a seeded hash
    of the identifier, are cut into blocks of `block_rows`; blocks are dealt out by earliest deadline. While all sources last,
    each source's part of any leading run of blocks is its weight's, less than one block off; after the end of a source the same
    holds for the rest with weights scaled anew. All rows are placed.

    Only the list of sources meets in one task, which schedules one period of each phase (there is a phase for each source); a
    block's slot follows from its place in the period. A row's place in its source comes from counts of hash bins and running
    sums in a bin of about 1000 rows, so no task gets a whole source.

    Null source: a source of its own. Rows with the same identifier (also null) and source are counted together, in up to 64
    parts, and get places side by side; which of them gets which is undefined. Texts are not read. Empty table: no rows. Further
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"))
    # equal rows are the same to all that follows, so they may be parted by where they are read
    rows = save(rows.withColumn("salt", F.spark_partition_id() % 64).groupBy("doc_id", "source", "salt").agg(F.count(F.lit(1)).alias("n")), "mix")
    bins = max(1, (rows.agg(F.sum("n")).first()[0] or 0) // 1000)
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bin", F.pmod(F.shiftright("hash", 8), F.lit(bins)))
    counts = save(running_offsets(rows.groupBy("source", "bin").agg(F.sum("n").alias("n")), ["source"], "bin", "n"), "mix")
    sizes = counts.groupBy("source").agg(F.sum("n").alias("n"))
    spans = ["source", "weight", "phase", "start", "whole", "part", "first", "blocks", "short"]

    def schedule(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of the phases of each source, with idx -1, and of its places in a period."""
        table = pd.concat([*frames, pd.DataFrame({"source": [], "n": []})]).sort_values("source")
        names, n = table["source"].tolist(), [int(x) for x in table["n"]]
        w = [float(weights.get(s, min(weights.values()))) for s in names] if weights else [x**power for x in n]
        w = [x / sum(w) for x in w]
        short = 0  # rows that the last blocks of ended sources lack
        for k, p in enumerate(phases([math.ceil(x / block_rows) for x in n], w)):
            own = [(names[i], w[i], k, p.start, p.whole, p.parts[i], p.first[i], p.blocks[i], short, -1, 0) for i in p.parts]
            yield pd.DataFrame(own, columns=[*spans, "idx", "at"])
            for i, at in p.at.items():
                at = at[: p.blocks[i]]
                for lo in range(0, len(at), 10_000):
                    part = at[lo : lo + 10_000]
                    yield pd.DataFrame({"source": names[i], "weight": w[i], "phase": k, "start": 0, "whole": 0, "part": 0, "first": 0, "blocks": 0, "short": 0, "idx": np.arange(lo, lo + len(part)), "at": part})
            short += -n[p.ends] % block_rows

    plan = save(sizes.coalesce(1).mapInPandas(schedule, "source string, weight double, phase int, start long, whole long, part long, first long, blocks long, short long, idx long, at long"), "mix")
    before = Window.partitionBy("source", "bin").orderBy("hash", "doc_id", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(counts.select("source", "bin", "offset"), ["source", "bin"])
    placed = placed.select("doc_id", "source", (F.col("offset") + F.col("before")).alias("lo"), (F.col("offset") + F.col("before") + F.col("n")).alias("hi"))
    # a row for each block that the equal rows reach into, and only past the join one for each of them
    placed = placed.withColumn("block", F.explode(F.expr(f"sequence(lo div {block_rows}, (hi - 1) div {block_rows})")))
    stays = plan.where("idx = -1").select(*spans)
    blocks = placed.select("source", "block").distinct()
    # one row for each source and phase: half the square of the number of sources
    stays = F.broadcast(stays) if stays.count() <= 100_000 else stays
    blocks = blocks.join(stays, "source").where("block >= first and block < first + blocks")
    blocks = blocks.withColumns({"idx": F.expr("(block - first) % part"), "round": F.expr("(block - first) div part")})
    blocks = blocks.join(plan.where("idx >= 0").select("source", "phase", "idx", "at"), ["source", "phase", "idx"])
    slot = F.col("start") + F.col("round") * F.col("whole") + F.col("at")
    blocks = blocks.select("source", "weight", "block", slot.alias("slot"), (slot * block_rows - F.col("short")).alias("from"))
    placed = placed.join(blocks, ["source", "block"])
    inside = F.expr(f"sequence(greatest(lo, block * {block_rows}), least(hi, (block + 1) * {block_rows}) - 1)")
    placed = placed.withColumn("place", F.explode(inside))
    name = F.when(F.col("source") != NO_SOURCE, F.col("source"))
    return placed.select("doc_id", name.alias("source"), "weight", "block", "slot", (F.col("from") + F.col("place") - F.col("block") * block_rows).alias("position"))
