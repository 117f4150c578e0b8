"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from lodestrata.llm import ngram_join as J


def grams(text, n=5):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}
    links = dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, find(i), links[i]) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    texts = [None, "", "...", "one two", "One, two!", "é ü ñ ö ä ß", "three"]
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 30)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).capitalize() + rng.choice(["", ".", " !"]))
    texts += [" ".join(rng.choice(vocab) for _ in range(50)) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [4096, 7])
def test_against_all_pairs(spark, block):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, salt string").repartition(3)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.ngram_join(df, block=block).collect())
    assert got == brute(rows)
    assert sum(x[2] for x in got) > 200


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_links, r.n_copies) for r in J.ngram_join(df).collect())
    assert got == [(-1, 0, 1), (-1, 2, 3), (1, 2, 3), (1, 2, 3), (2, 0, 1)]
    assert J.ngram_join(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_without_identifiers(spark, kind):
    """Five near copies whose identifiers are null or the same: each is a document of its own, one of them is kept."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = [" ".join(base[:-1] + [f"end{k}"]) for k in range(5)]
    for ids in ([None] * 5, [3] * 5, [None, 3, 3, 4, None]):
        df = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, t) for i, t in zip(ids, texts, strict=True)], f"doc_id {kind}, text string")
        out = J.ngram_join(df).collect()
        assert len(out) == 5 and all(r.n_links == 4 for r in out) and len({r.class_id for r in out}) == 1
        assert sum(r.kept for r in out) == 1


def test_chain_of_weak_likeness(spark, monkeypatch):
    """Texts that share buckets with their neighbours but are not near copies of them: they are not compared as one group."""
    rng = random.Random(7)
    stream = [f"w{rng.randint(0, 10**6)}" for _ in range(6000)]
    rows = [(k, " ".join(stream[k * 25 : k * 25 + 60])) for k in range(200)]  # neighbours share 35 of 60 words
    rows += [(1000 + k, t + " more") for k, t in rows[:40]]
    groups = []
    plain = J.components
    monkeypatch.setattr(J, "components", lambda edges: groups.append(plain(edges)) or groups[-1])
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in J.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert groups[0].groupBy("root").count().agg({"count": "max"}).first()[0] < 10


def test_ties_are_the_components_of_what_pruning_leaves():
    rng = np.random.default_rng(3)
    need = J.least_matches(0.8, 1e-7)
    centre = rng.integers(0, 255, (6, J.HASHES))
    sig = np.where(rng.random((60, J.HASHES)) < 0.2, rng.integers(0, 255, (60, J.HASHES)), centre[rng.integers(0, 6, 60)]).astype(np.uint8)
    side = rng.integers(0, 2, 60)
    for across in (False, True):
        i, j = np.triu_indices(60, 1)
        keep = np.array([all((sig[a, : 16 * (r + 1)] == sig[b, : 16 * (r + 1)]).sum() >= m for r, m in enumerate(need)) for a, b in zip(i, j, strict=True)])
        keep &= (side[i] != side[j]) | (not across)
        want = J._roots(60, i[keep], j[keep])
        assert (J.tied(sig, side, across, need) == want).all() and 2 < len(set(want)) < 60


def test_pruning_keeps_similar_pairs():
    need = J.least_matches(0.8, 1e-7)
    assert need == sorted(need) and need[0] < 8 and 60 < need[-1] < 90
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    sig = J.signatures(np.concatenate([x, x[:900]]), np.array([0, 1000, 1900]))
    assert abs((sig[0] == sig[1]).mean() - 0.9) < 0.12
