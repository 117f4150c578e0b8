"""Repeated word sequences, found by matching statistics against suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import save
from .windows import covered, find_repeats, kept_parts, word_bounds, word_tokens


class SuffixAutomaton:
    """Automaton of all substrings of the added sequences, with the number of places where each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def add(self, sequence: list, weight: int = 1) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.ends[last] += weight

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, q, c)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.ends.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.ends.append(0)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def count(self) -> None:
        """Sum the places up the links; after it nothing may be added."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] += self.ends[v]

    def repeated(self, sequence: list, size: int) -> np.ndarray:
        """For each window of `size` whether it ends in more than one place: the matching statistic is kept at `size` at most."""
        out = np.zeros(max(0, len(sequence) - size + 1), bool)
        v = n = 0
        for i, c in enumerate(sequence):
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                n += 1
            while v and self.length[self.link[v]] >= size:
                v = self.link[v]
                n = self.length[v]
            if n >= size and i >= size - 1:
                out[i - size + 1] = self.ends[v] > 1
        return out


def _settler(length: int):
    def settle(content: list[bytes], count: np.ndarray, twice: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The regions of one anchor are a reference shard; each is streamed through the shard's automaton."""
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            words = [x.split(b" ") for x in content[a:b]]
            shard = SuffixAutomaton()
            for w, more in zip(words, twice[a:b], strict=True):
                shard.add(w, 2 if more else 1)
            shard.count()
            for i, w in enumerate(words):
                yield a + i, shard.repeated(w, length)

    return settle


def _slices(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    start, end, _ = word_bounds(data, at)
    whole = data.tobytes()
    return [b" ".join(whole[start[a] : end[b - 1]].split()) for a, b in zip(lo, hi, strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 35, k: int | None = None, texts: bool = False) -> DataFrame:
    """Remove every word in a window of `threshold` words whose sequence also starts anywhere else: doc_id, n_words, n_removed, kept_sha256.

    Documents are cut into regions by anchors (windows.py). Regions whose anchor occurs again go, equal ones as one that counts
    as two, to the reference shard of the anchor; a suffix automaton of the shard is built in the task that then streams the
    shard's regions through it for matching statistics. A shard has at most some thousand regions: anchors with more are dealt
    out once more, each window to the shard of a hash of the whole window. So an automaton has a size bound, and each goes to
    the one task that needs it; broadcasting each to all tasks would stream the corpus once for every shard of itself.

    Words are separated by ASCII white space; windows don't cross documents and are judged on the input. With `texts` the result
    also has `kept`, the words that stay, joined by a space. Null text: no words. Repeated rows repeat each other like any
    copies; rows of one identifier with different texts are different documents, and so are rows with null identifiers. Very
    long texts are cut into regions piece by piece; only a document's own text and runs meet in one place. Identifiers may have
    any type. Empty table: no rows. Further columns are ignored.
    """
    k = k or max(1, threshold // 2)
    spans = save(find_repeats(docs, word_tokens, _slices, _settler(threshold), threshold, k, id_col, text_col), "spans")

    def work(data, at, owner, first, count):
        start, end, bounds = word_bounds(data, at)
        lo = bounds[owner] + first
        gone = covered(len(start), lo, lo + count - 1 + threshold, bounds[owner + 1])
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[bounds[1:]] - sums[bounds[:-1]]
        whole = data.tobytes()
        kept = []
        for i, r in enumerate(removed):
            words = whole[at[i] : at[i + 1]].split()
            if r:
                words = [w for w, g in zip(words, gone[bounds[i] : bounds[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        out = {"n_words": np.diff(bounds).astype(np.int64), "n_removed": removed.astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return out | ({"kept": pa.array(kept, pa.binary())} if texts else {})

    return kept_parts(docs, spans, work, "n_words long, n_removed long, kept_sha256 string" + ", kept binary" * texts, id_col, text_col)
