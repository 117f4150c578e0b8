"""Suffix and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import substring_dedup as words
from lodestrata.llm import suffix_dedup as suffixes
from lodestrata.llm import windows


def brute(docs, length):
    """docs: lists of tokens -> for each a list of booleans, True where removed."""
    seen = Counter(tuple(d[i : i + length]) for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[tuple(d[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def corpus(seed, letters="abcdefgh", n=60):
    rng = random.Random(seed)
    make = lambda k: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(k))
    shared = [make(rng.randint(5, 40)) for _ in range(6)]
    out = [None, "", " ", "x", "a a a a a a a a a a a a a a a a a a a a a a a a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é ü 　 ñ" * 9, "tab\there\nline " * 3]
    for _ in range(n):
        out.append(" ".join(rng.choice([make(rng.randint(1, 30)), rng.choice(shared)]) for _ in range(rng.randint(1, 4))))
    out += rng.sample(out, 6)
    out.append(make(9000))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i if i != 11 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, salt int")


@pytest.mark.parametrize("hot,chunk", [(4000, 1 << 20), (1, 300)])
def test_suffix_dedup(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffixes, "find_repeats", lambda *a: windows.find_repeats(*a, hot=hot))
    texts = corpus(1)
    out = suffixes.suffix_dedup(frame(spark, texts), threshold=20, texts=True).collect()
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, (d, gone) in enumerate(zip(raw, brute([list(d) for d in raw], 20), strict=True)):
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i if i != 11 else -1, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("hot", [4000, 1])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(words, "find_repeats", lambda *a: windows.find_repeats(*a, hot=hot))
    texts = corpus(2, "ab")
    out = words.substring_dedup(frame(spark, texts), threshold=8).collect()
    raw = [(t or "").encode().split() for t in texts]
    want = []
    for i, (d, gone) in enumerate(zip(raw, brute(raw, 8), strict=True)):
        kept = b" ".join(c for c, g in zip(d, gone, strict=True) if not g)
        want.append((i if i != 11 else -1, len(d), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in out]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 300


def test_pieces_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 0, 1200, 1230, 5000])
    values = windows.byte_tokens(data, at)[0]
    per_window = lambda r: sorted((int(o), int(f) + i, int(a)) for o, f, c, a in zip(r.owner, r.first, r.count, r.anchor, strict=True) for i in range(c))
    one = per_window(windows.regions(values, at, 40, 20))
    monkeypatch.setattr(windows, "CHUNK", 256)
    assert per_window(windows.regions(values, at, 40, 20)) == one
    assert len(one) == 1200 - 39 + 3770 - 39


def test_same_identifier_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 3), (1, "a b"), (1, "a b")], "doc_id long, text string")
    for f in (suffixes.suffix_dedup, words.substring_dedup):
        assert f(df, threshold=6).count() == 3
        assert f(df.limit(0), threshold=6).count() == 0


@pytest.mark.parametrize("hot", [4000, 0])
def test_texts_of_one_identifier_are_told_apart(spark, monkeypatch, hot):
    """Each row's removals are its own, whether the identifier is shared, null or a string."""
    texts = ["q " * 3 + "a b c d e f g h i j", "z " * 5 + "a b c d e f g h", "k l m n o p q r s t"]
    for f, column in ((suffixes.suffix_dedup, "n_removed"), (words.substring_dedup, "n_removed")):
        module = suffixes if f is suffixes.suffix_dedup else words
        monkeypatch.setattr(module, "find_repeats", lambda *a: windows.find_repeats(*a, hot=hot))
        runs = []
        for ids, kind in (([1, 2, 3], "long"), ([7, 7, 7], "long"), ([None] * 3, "long"), (["x", "x", None], "string")):
            df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string")
            out = f(df, threshold=6).collect()
            assert sorted(str(r.doc_id) for r in out) == sorted(map(str, ids))
            runs.append(sorted(r[column] for r in out))
        assert all(r == runs[0] for r in runs) and len({*runs[0]}) > 1


def test_frequent_anchor(spark, monkeypatch):
    """A passage that many documents share, each going on in its own way: more regions of an anchor than are settled together."""
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice("abcdef") for _ in range(3)) for _ in range(12))
    texts = [f"{rng.randint(0, 9)} {rng.choice('xyz')}{passage} {rng.choice('xyz')} {rng.randint(0, 999)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for module, f, split, length in ((suffixes, suffixes.suffix_dedup, lambda t: list(t.encode()), 30), (words, words.substring_dedup, str.split, 8)):
        monkeypatch.setattr(module, "find_repeats", lambda *a: windows.find_repeats(*a, hot=20))
        want = [sum(gone) for gone in brute([split(t) for t in texts], length)]
        assert [r.n_removed for r in sorted(f(df, threshold=length).collect())] == want


def test_radix_groups():
    data = np.frombuffer(b"abcabcabcabcabdabc", np.uint8)
    at = np.arange(0, 12)
    for depth in (1, 3, 6):
        want = Counter(bytes(data[i : i + depth]) for i in at)
        assert [x.tolist() for x in suffixes.radix_groups(data, at[:1], np.zeros(1, int), depth, np.array([True]))] == [[0], [1]]
        which, ends = suffixes.radix_groups(data, at, np.zeros(12, int), depth)
        got = [sorted(g.tolist()) for g in np.split(which, ends[:-1]) if len(g)]
        assert sorted(map(len, got)) == sorted(n for n in want.values() if n > 1)
        assert all(len({bytes(data[i : i + depth]) for i in g}) == 1 for g in got)
        # one that stands for several is a group, alone or not
        which, ends = suffixes.radix_groups(data, at, np.zeros(12, int), depth, np.arange(12) == 9)
        assert sorted(np.diff(ends, prepend=0)) == sorted(n for w, n in want.items() if n > 1 or w == bytes(data[9 : 9 + depth]))
