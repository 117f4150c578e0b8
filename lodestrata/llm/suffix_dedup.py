"""Repeated byte strings, found by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import save
from .windows import byte_tokens, covered, find_repeats, kept_parts

DIGIT = 8


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, twice: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Groups of suffixes data[at:] that agree in `group` and in their first `depth` bytes: indices into `at`, and where each group ends.

    Most significant digit first, eight bytes a pass; suffixes alone in their group drop out at once, and no pass goes beyond
    `depth`. One that stands for equal ones (`twice`) is a group of its own as soon as it is alone.
    """
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for i in range(DIGIT):
        word |= padded[i : i + len(data)] << np.uint64(8 * (DIGIT - 1 - i))
    live, rank = np.arange(len(at)), group.astype(np.int64)
    lone = []
    for d in range(0, depth, DIGIT):
        digit = word[at[live] + d]
        if depth - d < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - (depth - d)))
        order = np.lexsort((digit, rank))
        live, rank, digit = live[order], rank[order], digit[order]
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (digit[1:] != digit[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        if twice is not None:
            lone.append(live[alone & twice[live]])
        rank = np.cumsum(new)[~alone]
        live = live[~alone]
        if not len(live):
            break
    lone = np.concatenate([np.zeros(0, np.int64), *lone])
    ends = np.flatnonzero(np.concatenate([rank[1:] != rank[:-1], [True]])) + 1 if len(live) else np.zeros(0, np.int64)
    return np.concatenate([lone, live]), np.concatenate([np.arange(1, len(lone) + 1), len(lone) + ends])


def _settler(length: int):
    def settle(content: list[bytes], count: np.ndarray, twice: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Regions lo..hi-1 of neighbouring bounds share an anchor; all are sorted together, the anchor the first digit."""
        per = 200_000  # suffixes sorted at once, whole anchors
        weight = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        while lo < len(bounds) - 1:
            hi = lo + 1
            while hi < len(bounds) - 1 and weight[bounds[hi + 1]] - weight[bounds[lo]] <= per:
                hi += 1
            a, b = bounds[lo], bounds[hi]
            data = np.frombuffer(b"".join(content[a:b]), np.uint8)
            size = np.array([len(x) for x in content[a:b]])
            start = np.cumsum(size) - size
            n = count[a:b].astype(np.int64)
            owner = np.repeat(np.arange(b - a), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            anchor = np.searchsorted(bounds, np.arange(a, b), side="right")
            marks = np.zeros(len(owner), bool)
            marks[radix_groups(data, start[owner] + step, anchor[owner], length, twice[a:b][owner])[0]] = True
            ends = np.cumsum(n)
            for i in range(b - a):
                yield a + i, marks[ends[i] - n[i] : ends[i]]
            lo = hi

    return settle


def _slices(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(lo, hi, strict=True)]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 400, k: int | None = None, texts: bool = False) -> DataFrame:
    """Remove every byte in a string of `threshold` bytes that also starts anywhere else: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Suffixes are ordered only through their first `threshold` bytes, by passes from the most significant digit on; groups still
    together after the last are the repeated windows. The first digit, over all tasks, is the window's anchor (windows.py), which
    leaves only windows whose anchor occurs again. Equal regions are taken together: one is sorted, and counts as two. Anchors
    with thousands of different regions get one more digit over all tasks, a hash of the whole window. Then each task sorts the
    suffixes of its anchors byte by byte.

    Strings don't cross documents and are judged on the input. n_spans counts maximal removed runs. With `texts` the result also
    has `kept`, the bytes that stay. Null text: empty, nothing removed. Repeated rows (same identifier and text) repeat each
    other like any copies; rows of one identifier with different texts are different documents, and so are rows with null
    identifiers. Very long texts are cut into regions piece by piece and sorted in the tasks of their anchors; only a document's
    own text and runs meet in one place. Identifiers may have any type. Empty table: no rows. Further columns are ignored.
    """
    k = k or max(1, threshold // 2)
    spans = save(find_repeats(docs, byte_tokens, _slices, _settler(threshold), threshold, k, id_col, text_col), "spans")

    def work(data, at, owner, first, count):
        gone = covered(len(data), at[owner] + first, at[owner] + first + count - 1 + threshold, at[owner + 1])
        n = np.diff(at)
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[at[1:]] - sums[at[:-1]]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        starts = np.concatenate([[0], np.cumsum(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))]) if len(data) else np.zeros(1, np.int64)
        runs = starts[at[1:]] - starts[at[:-1]]
        left = data[~gone].tobytes()
        ends = at[1:] - sums[at[1:]]
        kept = [left[b - (m - r) : b] for b, m, r in zip(ends, n, removed, strict=True)]
        out = {"n_bytes": n.astype(np.int64), "n_removed": removed.astype(np.int64), "n_spans": runs.astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return out | ({"kept": pa.array(kept, pa.binary())} if texts else {})

    return kept_parts(docs, spans, work, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts, id_col, text_col)
