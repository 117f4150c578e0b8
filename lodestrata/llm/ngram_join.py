"""N-gram Jaccard self-join with Bayesian candidate pruning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_stats, salt_mask, salt_of, save, tidy
from .windows import BASES, Sums, _long, _mix, _portions, _rows, _texts, _unpacked, packed

U = np.uint64
HASHES, BAND = 128, 4
#: MinHash values compared before each pruning.
ROUND = 16
#: Documents of one side of a unit of work: BLOCK, more for groups that would have over MOST_PARTS sides, WIDEST at most.
BLOCK, MOST_PARTS, WIDEST = 256, 64, 4096

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_VALUE = _mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
_SEEDS = _mix(np.arange(1, 2 * HASHES + 1, dtype=U) * U(0x8BB84B93962EACC9))
_TURN = (_SEEDS[:HASHES] >> U(32)).astype(np.uint32)
_TIMES = (_SEEDS[HASHES:] >> U(32)).astype(np.uint32) | np.uint32(1)


def word_values(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (a-z, 0-9 and everything beyond ASCII; A-Z lower-cased) and each text's bounds among the words."""
    data = _FOLD[data]
    text = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(text & (edge[:-1] | ~np.concatenate([[False], text[:-1]]))) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(text & (edge[1:] | ~np.concatenate([text[1:], [False]]))) + 1 if len(data) else start
    sums = Sums(_VALUE[data], 1)
    return _mix(sums.of(start, end) + U(0x632BE59BD9B4E019) * (end - start).astype(U)) | U(1), np.searchsorted(start, at)


def shingles(values: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words and each text's bounds among them; a text of fewer words, but not none, has one of all of them."""
    size = np.diff(bounds)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    first = bounds[owner] + np.arange(out[-1]) - out[owner]
    sums = Sums(values, 0)
    return _mix(sums.of(first, np.minimum(first + n, bounds[owner + 1]))), out


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of each text that has n-grams (others: zeros)."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, HASHES), np.uint32)
    x = (grams >> U(32)).astype(np.uint32)
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(at[full], at[full[lo]] + (1 << 17))))
        part, cuts = x[at[full[lo]] : at[full[hi - 1] + 1]], at[full[lo:hi]] - at[full[lo]]
        for j in range(HASHES):
            v = (part ^ _TURN[j]) * _TIMES[j]
            v ^= v >> np.uint32(15)
            out[full[lo:hi], j] = np.minimum.reduceat(v, cuts)
        lo = hi
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    wide = sig.astype(U).reshape(len(sig), -1, BAND)
    key = np.zeros(wide.shape[:2], U) + np.arange(wide.shape[1], dtype=U) * BASES[0]
    for i in range(BAND):
        key = _mix(key * BASES[1] + wide[:, :, i])
    return key


@lru_cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each multiple of ROUND compared values: the fewest equal ones with which a pair is kept.

    With a uniform prior the similarity after m of n matches is Beta(m+1, n-m+1); a pair goes when the probability that it is
    the threshold or more is under `tolerance`.
    """
    s = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        for m in range(n + 1):
            with np.errstate(divide="ignore"):
                logs = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() >= tolerance * p.sum():
                break
        out.append(m)
    return out


def similar_pairs(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left x right (or within left) whose Jaccard similarity is the threshold or more: pruned by signature, verified exactly."""
    a, b = left, left if right is None else right
    need = least_matches(threshold, tolerance)
    keep_i, keep_j = [], []
    for lo in range(0, len(a), 512):
        rows = a[lo : lo + 512]
        same = np.zeros((len(rows), len(b)), np.uint8)
        for j in range(ROUND):
            same += sig[rows, j][:, None] == sig[b, j][None, :]
        ok = same >= need[0]
        if right is None:
            ok &= np.arange(lo, lo + len(rows))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(ok)
        same = same[i, j].astype(np.int16)
        i, j = rows[i], b[j]
        for r in range(1, len(need)):
            if not len(i):
                break
            s = slice(r * ROUND, (r + 1) * ROUND)
            for part in range(0, len(i), 1 << 18):
                p = slice(part, part + (1 << 18))
                same[p] += (sig[i[p], s] == sig[j[p], s]).sum(1, dtype=np.int16)
            ok = same >= need[r]
            i, j, same = i[ok], j[ok], same[ok]
        keep_i.append(i)
        keep_j.append(j)
    i, j = np.concatenate([np.zeros(0, np.int64), *keep_i]), np.concatenate([np.zeros(0, np.int64), *keep_j])
    if not len(i):
        return i, j
    # exact: numbers for the n-grams, then one side marked and the other's marks counted
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(number.max()) + 1, bool)
    good = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = number[start[i[run[0]]] : start[i[run[0]]] + size[i[run[0]]]]
        mark[own] = True
        for part in range(0, len(run), 2048):
            p = run[part : part + 2048]
            n = size[j[p]]
            at = np.cumsum(n) - n
            other = number[np.repeat(start[j[p]] - at, n) + np.arange(n.sum())]
            common = np.add.reduceat(mark[other], at, dtype=np.int64)
            good[p] = common >= threshold * (len(own) + n - common) - 1e-9
        mark[own] = False
    return i[good], j[good]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _alike(sig: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int]) -> np.ndarray:
    """Which of the pairs stay when pruned by their signatures, ROUND values at a time."""
    left, same = np.arange(len(i)), np.zeros(len(i), np.int16)
    for r, least in enumerate(need):
        s = slice(r * ROUND, (r + 1) * ROUND)
        same += (sig[i[left], s] == sig[j[left], s]).sum(1, dtype=np.int16)
        ok = same >= least
        left, same = left[ok], same[ok]
    return left


def tied(sig: np.ndarray, side: np.ndarray, across: bool, need: list[int]) -> np.ndarray:
    """Roots of the documents of a bucket, tied by the pairs that pruning leaves (`across`: pairs of two sides only).

    Pairs that are tied already needn't be compared: a few documents are compared with all first, which ties most of a bucket
    of near copies, and then those outside the largest component with all that aren't in theirs.
    """
    n = len(sig)
    every, root = np.arange(n), np.arange(n)
    for _ in range(4):
        loose = np.flatnonzero(root != np.bincount(root, minlength=n).argmax())
        if not len(loose):
            return root
        pivot = loose[0]
        ok = (root != root[pivot]) & ((side != side[pivot]) | (not across))
        j = every[ok]
        j = j[_alike(sig, np.full(len(j), pivot), j, need)]
        root = _roots(n, np.append(every, np.full(len(j), pivot)), np.append(root, j))
    loose = np.flatnonzero(root != np.bincount(root, minlength=n).argmax())
    for lo in range(0, len(loose), max(1, (1 << 20) // n)):
        rows = loose[lo : lo + max(1, (1 << 20) // n)]
        ok = root[rows][:, None] != root[None, :]
        if across:
            ok &= side[rows][:, None] != side[None, :]
        i, j = np.nonzero(ok)
        i = rows[i]
        got = _alike(sig, i, j, need)
        root = _roots(n, np.append(every, i[got]), np.append(root, j[got]))
    return root


def _dealt(rows: DataFrame, size: str, group: str, node: str, block: int) -> DataFrame:
    """Rows with a unit of work: small groups whole, in packs; of a large one a pair of sides (lo, hi), so that all pairs meet.

    A row of a large group is repeated for each side that its own meets.
    """
    packs = max(1, rows.count() // 200)
    wide = F.ceil(F.col(size) / block)
    parts = F.greatest(F.least(wide, F.lit(MOST_PARTS)), F.ceil(F.col(size) / WIDEST)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64(F.lit(7), node), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    big = F.col("parts") > 1
    pack = F.when(big, F.col(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(packs)))
    return rows.withColumns({"big": big, "pack": pack, "lo": F.least("side", "with"), "hi": F.greatest("side", "with")}).drop("parts", "with")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, tolerance: float = 1e-7, block: int = BLOCK) -> DataFrame:
    """Documents whose sets of n-word shingles have a Jaccard similarity of `threshold` or more, one row for each document:
    doc_id, class_id, n_links, copy_of, n_copies, number, mark, kept.

    class_id is the smallest identifier of the documents connected by links, n_links the number of other documents within the
    threshold; `kept` marks the document that class_id names. Documents of the same words are copies: copy_of is the smallest of
    them, n_copies how many. Copies are taken together first (combined before the shuffle), so they are never paired.

    Candidates share four MinHash values in a row of 128 in one of 32 bands; two documents at 0.8 fail to with a probability
    under 1e-7. Only documents that share a band's bucket are compared, MinHash values 16 at a time (a byte of each), a pair
    being dropped when the posterior probability of reaching the threshold is under `tolerance`; buckets with the same members
    are taken once. What is left ties documents to groups, a tie for each document, not a row for each pair. In a group the
    pairs that the same pruning on whole values leaves are verified exactly on their shingles; a task returns each document's
    number of links and its local root, never the pairs. Large buckets and groups are dealt out block by block (`block`
    documents a side, more where a group would have over 64 sides).

    Words are a-z, 0-9 and characters beyond ASCII, A-Z lower-cased; a text of fewer than n words has one shingle of all of
    them; one without words (null, empty) has no links. `number` is the identifier, a hash of one that is no whole number, and
    for a null one a number over 2^62 made from the text; `mark` is a hash of the text. Rows of one identifier with different
    texts are different documents. Repeated rows are copies. Very long texts are signed 1 MB at a time or alone. Empty table:
    no rows. Further columns are ignored.
    """
    need = least_matches(threshold, tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text"):
                values, bounds = word_values(*_texts(part["text"]))
                grams, at = shingles(values, bounds, n)
                sig = signatures(grams, at)
                keys = band_keys(sig)
                low, high = Sums(values, 0), Sums(values, 1)
                lo, hi = bounds[:-1], bounds[1:]
                ends = (np.arange(len(part) + 1) * keys.shape[1]).astype(np.int32)
                bands = pa.ListArray.from_arrays(ends, _long(keys.ravel()))
                brief = pa.array([x.tobytes() for x in (sig & np.uint32(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_pydict({"id": part["id"], "row": part["row"], "mark": part["mark"], "h1": _long(_mix(low.of(lo, hi))), "h2": _long(_mix(high.of(lo, hi))), "words": (hi - lo).astype(np.int64), "bands": bands, "sig": brief})

    rows = _rows(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, row long, mark long, h1 long, h2 long, words long, bands array<long>, sig binary"
    signed = save(rows.mapInArrow(tidy(sign), schema), "join").withColumn("salt", salt_of(F.col("row")))
    members = signed.select("row", "mark", "id", "h1", "h2", "words", "salt")
    same = ["h1", "h2", "words"]
    # a class of copies is a node, its number the first hash of its words
    classes = signed.where("words > 0").groupBy(*same).agg(F.min(F.struct("row", "mark")).alias("rep"), F.count(F.lit(1)).alias("copies"), salt_mask("salt"), F.min_by(F.struct("bands", "sig"), "row").alias("own"))
    classes = save(classes.select(F.col("h1").alias("node"), *same, "rep", "copies", "_salts", "own.*"), "join")

    bands = classes.select("node", F.explode("bands").alias("key")).withColumn("salt", salt_of(F.col("node")))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("all"), salt_mask("salt")).where("size > 1")
    buckets = buckets.groupBy("size", "lead", "all").agg(F.min("key").alias("key"), F.first("_salts").alias("_salts")).select("key", "size", "_salts")
    held = save(join_stats(bands, buckets, ["key"], "salt").select("node", "key", "size").join(classes.select("node", "sig"), "node"), "join")

    def tie(key: tuple, table: pa.Table) -> pa.Table:
        across = key[2].as_py() != key[3].as_py()
        table = table.sort_by([("key", "ascending"), ("node", "ascending")]).combine_chunks()
        bucket, node, side = (table[c].to_numpy() for c in ("key", "node", "side"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(node), HASHES)
        lead = node.copy()
        ends = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            lead[lo:hi] = node[lo:hi][tied(sig[lo:hi], side[lo:hi], across, need)]
        return pa.Table.from_pydict({"a": node, "b": lead}).filter(pa.array(node != lead))

    ties = _dealt(held, "size", "key", "node", block).select("key", "node", "sig", "side", "big", "pack", "lo", "hi")
    groups = save(components(ties.groupBy("big", "pack", "lo", "hi").applyInArrow(tie, "a long, b long")), "join")

    found = groups.withColumn("salt", salt_of(F.col("node")))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"), salt_mask("salt"))
    found = join_stats(found, sizes, ["root"], "salt").select("node", "root", "size").join(classes.select("node", "copies", "rep.*"), "node")
    found = save(found.join(packed(docs, id_col, text_col).select("row", "mark", "body"), ["row", "mark"]), "join")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[2].as_py(), key[3].as_py()
        table = table.sort_by([("root", "ascending"), ("node", "ascending")]).combine_chunks()
        node = table["node"].to_numpy()
        fresh = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)  # repeated rows
        table = table.take(pa.array(fresh)).combine_chunks()
        node, root, copies, side = (table[c].to_numpy() for c in ("node", "root", "copies", "side"))
        grams, sig = [], []
        for batch in table.to_batches(max_chunksize=512):
            g, at = shingles(*word_values(*_texts(_unpacked(batch))), n)
            sig.append(signatures(g, at))
            grams += [np.unique(g[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        sig = np.concatenate(sig) if sig else np.zeros((0, HASHES), np.uint32)
        links, lead = np.zeros(len(node), np.int64), node.copy()
        ends = np.flatnonzero(np.concatenate([root[1:] != root[:-1], [True]])) + 1 if len(node) else []
        start = 0
        for end in ends:
            own = slice(start, end)
            if lo == hi:
                left, right = np.arange(end - start), None
            else:
                left, right = np.flatnonzero(side[own] == lo), np.flatnonzero(side[own] == hi)
            i, j = similar_pairs(grams[own], sig[own], left, right, threshold, tolerance)
            c = copies[own]
            links[own] += np.bincount(i, c[j], end - start).astype(np.int64) + np.bincount(j, c[i], end - start).astype(np.int64)
            lead[own] = node[own][_roots(end - start, i, j)]
            start = end
        return pa.Table.from_pydict({"node": node, "links": links, "lead": lead, "big": table["big"]})

    units = _dealt(found, "size", "root", "node", block).select("node", "root", "copies", "side", "body", "big", "pack", "lo", "hi")
    judged = save(units.groupBy("big", "pack", "lo", "hi").applyInArrow(compare, "node long, links long, lead long, big boolean"), "join")
    per = judged.groupBy("node").agg(F.sum("links").alias("links"), F.min("lead").alias("lead"), F.max("big").alias("big"))
    across = judged.where("big and node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    if not across.isEmpty():
        per = per.join(components(across), "node", "left").withColumn("lead", F.when(F.col("big"), F.coalesce("root", "node")).otherwise(F.col("lead"))).drop("root")
    # the smallest document of each connected group
    named = save(per.join(classes.select("node", "rep"), "node"), "join").withColumn("salt", salt_of(F.col("node")))
    first = named.groupBy("lead").agg(F.min("rep").alias("first"), salt_mask("salt"))
    named = join_stats(named.select("node", "links", "lead", "salt"), first, ["lead"], "salt").select("node", "links", "first")
    stats = classes.select("node", *same, "rep", "copies", "_salts").join(named, "node", "left").drop("node")
    out = join_stats(members, stats, same, "salt", "left").withColumn("first", F.coalesce("first", "rep", F.struct("row", "mark")))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("first.row").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("rep.row", "row").alias("copy_of"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.col("row").alias("number"),
        "mark",
        F.col("first").eqNullSafe(F.struct("row", "mark")).alias("kept"),
    )
