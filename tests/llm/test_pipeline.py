"""The pipeline's stages on a small table, each against the operator's plain meaning."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    good = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, good(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 7 == 0
        t = " ".join(w.upper() + "$$$!!" for w in good(40).split()) if bad else good(60)
        if i % 50 == 1:
            t = good(5) + " " + items[i % 5][1] + " " + good(20)
        docs.append([i, t])
        labels.append((i, int(not bad), 0))
    for i in range(400, 430):
        w = docs[i - 398 + (i - 398) % 7 // 6][1].split()
        w[-1] = "changed"
        docs.append([i, " ".join(w)])
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"src{i % 4 if i % 3 else 0}", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(map(tuple, docs)), items


def test_stages(spark, folder, tmp_path):
    d, texts, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    left = [set(texts)]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        if k == 4:
            break
        assert out.columns == columns, name
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        ids = [r[0] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        left.append(set(ids))
    # quality: shouted rows go, clean ones stay
    assert left[1] == {i for i in texts if "$$$" not in texts[i]}
    # near duplicates: the smallest of each group
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i in left[1] if (w := texts[i].split())}
    gone = {max(i, j) for i in range(400, 430) if i in left[1] for j in left[1] if j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    assert left[2] == left[1] - gone and gone
    # contamination
    spans = {tuple(w[k : k + 13]) for _, t in items for w in [t.split()] for k in range(len(w) - 12)}

    def hit(t):
        w = re.findall("[a-z0-9]+", t.lower())
        n = {k + x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in spans for x in range(13)}
        return n and 20 * len(n) >= len(w)

    assert left[3] == {i for i in left[2] if not hit(texts[i])} and len(left[3]) < len(left[2])
    # mixing keeps all; the token files are in its order
    assert left[4] == left[3]
    order = [r.doc_id for r in docs.selectExpr("doc_id", "_metadata.file_name as f", "_metadata.row_index as i").orderBy("f", "i").collect()]
    assert order != sorted(order)
    tok, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    want = []
    for i in order:
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_run_and_empty(spark, folder, tmp_path):
    d, texts, _ = folder
    assert 0 < P.run(spark, d).count() < len(texts)
    empty = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, empty).count() == 0


def test_odd_rows_and_clashing_names(spark, folder):
    """Null and repeated identifiers, and columns with the names that the stages use; one row of each group of copies stays."""
    d, texts, _ = folder
    body = texts[2]
    rows = [(None, body), (None, body), (5, body), (5, body), (5, texts[4]), (None, None), (None, None), (9, ""), (10, texts[8])]
    names = ("number", "mark", "key", "position", "file", "index", "quality_score", "row", "salt", "first", "node")
    docs = spark.createDataFrame([(i, t, None if k % 2 else "s", *[k] * len(names)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, source string, {', '.join(f'{c} int' for c in names)}").repartition(3)
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        if k == len(P.STAGES) - 1:
            assert out.count() == len(rows)
            continue
        assert out.columns == docs.columns, name
        got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
        if name == "n-gram Jaccard join":
            assert [x for x in got if x[1] == body] == [(5, body)] and (5, texts[4]) in got and (10, texts[8]) in got
        elif name == "mixing to weights":
            assert got == sorted((i or -1, t or "") for i, t in rows)
