"""Least costs over a whole network, from the nearest of its sources.

A network of up to MOST_LINKS links is one task's, so the length of its ways doesn't matter. A larger one is settled in rounds of
joins that follow the ways link by link.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Links that one task is given at once: some 100 MB of arrays.
MOST_LINKS = 4_000_000
_FOUND = "node long, cost double, label long"


class Links:
    """Links u, v, w between numbered nodes as arrays, both ways; starts are of `more` nodes too, which need no links."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, more: np.ndarray):
        if len(w) and w.min() < 0:
            raise ValueError("costs can't be negative")
        self.ids, at = np.unique(np.concatenate([u, v, more]), return_inverse=True)
        a, b = at[: len(u)].astype(np.int32), at[len(u) : 2 * len(u)].astype(np.int32)
        tail = np.concatenate([a, b])
        order = np.argsort(tail, kind="stable")
        self.to, self.w = np.concatenate([b, a])[order], np.concatenate([w, w])[order]
        self.first = np.searchsorted(tail[order], np.arange(len(self.ids) + 1)).tolist()

    def numbers(self, nodes: np.ndarray) -> list[int]:
        return np.searchsorted(self.ids, nodes).tolist()

    def settle(self, starts: list[tuple[float, int, int]], most: float | None = None) -> tuple[list[int], list[float], list[int]]:
        """Nodes reached, their least (cost, label) from starts (cost, label, node), by Dijkstra."""
        to, w, first = self.to, self.w, self.first
        seen: dict[int, tuple[float, int]] = {}
        done: set[int] = set()
        heap = list(starts)
        heapq.heapify(heap)
        nodes, costs, labels = [], [], []
        while heap:
            c, k, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            nodes.append(i)
            costs.append(c)
            labels.append(k)
            a, b = first[i], first[i + 1]
            for j, x in zip(to[a:b].tolist(), w[a:b].tolist(), strict=True):
                n = (c + x, k)
                if j not in done and (j not in seen or n < seen[j]) and (most is None or n[0] <= most):
                    seen[j] = n
                    heapq.heappush(heap, (*n, j))
        return nodes, costs, labels


def _links_of(t: pd.DataFrame) -> tuple[Links, list[tuple[float, int, int]]]:
    """Links and starts of rows that are a link u, v, w or a start: node u with cost w and label v."""
    s, u, v, w = (t[c].to_numpy() for c in ("start", "u", "v", "w"))
    links = Links(u[~s], v[~s], w[~s], u[s])
    return links, list(zip(w[s].tolist(), v[s].tolist(), links.numbers(u[s]), strict=True))


def _found(links: Links, got: tuple[list[int], list[float], list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"node": links.ids[np.array(got[0], np.int64)], "cost": np.array(got[1], float), "label": np.array(got[2], np.int64)})


def least_costs(links: DataFrame, sources: DataFrame, most: float | None = None) -> DataFrame:
    """node, cost, label: of all nodes with a way from a source, the least cost and the smallest label with it.

    links: u, v (numbers), w, each pair once; sources: node, label, cost. Links without a cost are none.
    """
    links = cut(links.where("w is not null and not isnan(w) and u <> v"))
    sources = cut(sources.select("node", "label", F.col("cost").cast("double").alias("cost")))
    return cut(_together(links, sources, most)) if links.count() <= MOST_LINKS else _by_rounds(links, sources, most)


def _together(links: DataFrame, sources: DataFrame, most: float | None) -> DataFrame:
    """The whole network in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = list(batches)
        if t:
            links_, starts = _links_of(pd.concat(t, ignore_index=True))
            del t
            out = _found(links_, links_.settle(starts, most))
            for i in range(0, len(out), 100_000):
                yield out[i : i + 100_000]

    starts = sources.select(F.lit(True).alias("start"), F.col("node").alias("u"), F.col("label").alias("v"), F.col("cost").alias("w"))
    return links.select(F.lit(False).alias("start"), "u", "v", "w").unionByName(starts).repartition(1).mapInPandas(run, _FOUND)


def _by_rounds(links: DataFrame, sources: DataFrame, most: float | None) -> DataFrame:
    arcs = cut(links.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b"), "w")))
    best = cut(sources.groupBy("node").agg(F.min(F.struct("cost", "label")).alias("s")))
    front = best
    while not front.isEmpty():
        step = front.join(arcs.hint("merge"), F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.struct((F.col("s.cost") + F.col("w")).alias("cost"), F.col("s.label").alias("label")).alias("s"))
        step = step if most is None else step.where(F.col("s.cost") <= most)
        step = step.groupBy("node").agg(F.min("s").alias("s"))
        front = cut(step.join(best.select("node", F.col("s").alias("_s")).hint("merge"), "node", "left").where("_s is null or s < _s").drop("_s"))
        best = cut(best.unionByName(front).groupBy("node").agg(F.min("s").alias("s")))
    return best.select("node", "s.cost", "s.label")
