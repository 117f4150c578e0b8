"""The other operators against plain Python, on tables with nulls, empty texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import decontaminate as D
from lodestrata.llm import line_dedup as L
from lodestrata.llm import mix, rangecoder, token_files
from lodestrata.llm import quality as Q
from lodestrata.llm.common import components
from lodestrata.llm.exact_dedup import exact_dedup
from lodestrata.llm.line_dedup import line_dedup
from lodestrata.llm.mix import mix_sources
from lodestrata.llm.quality import dual_descent, held_out, quality_scores
from lodestrata.llm.shard import shuffle_to_shards

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, salt int, row string, _bucket long"


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    lines = ["Shared Line number one", "  shared line NUMBER one\t", "short", "É accents here, É", "", "x" * 300]
    texts = [None, "", "\n", "\n\n", " ", "É", "é", "ABC", "abc", "a\nb", "word " * 5000]
    for _ in range(n):
        texts.append("\n".join(rng.choice([*lines, "".join(rng.choice("abc d") for _ in range(20))]) for _ in range(rng.randint(0, 5))))
    texts += texts[5:25]
    return [(i, t, "en", f"s{min(int(rng.expovariate(0.5)), 6)}", 1, "r", 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, docs, keep):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault((t or "").translate(UP), []).append(i)
    best = min if keep == "smallest" else max
    want = sorted((i, best(ids), len(ids), i == best(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(map(tuple, exact_dedup(docs, keep=keep).collect())) == want


def test_exact_dedup_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b"), (2, None), (3, "")], "doc_id long, text string")
    out = exact_dedup(df).collect()
    kept = Counter((r.text_sha256, r.kept) for r in out)
    assert all(kept[h, True] == 1 for h in {r.text_sha256 for r in out}) and len(out) == 7
    assert exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 2), (None, 2), (4, 3)])
def test_line_dedup(spark, docs, batches, fanout):
    rows = corpus()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    owner = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owner[key(x)] = min(i, owner.get(key(x), i))
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert sorted(map(tuple, line_dedup(docs, batches=batches, fanout=fanout).collect())) == sorted(want)
    assert sum(w[2] for w in want) > 50
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_runs_are_compacted_and_merged_in_place(spark, docs, monkeypatch):
    """With the defaults of the registered query runs are compacted, and joined without shuffling or sorting them again."""
    seen, plans = [], []
    close, add = L.Runs.close, L.Runs.write

    def write(runs, keys):
        plans.append(keys._jdf.queryExecution().toString() if runs.levels else "")
        return add(runs, keys)

    monkeypatch.setattr(L.Runs, "write", write)
    monkeypatch.setattr(L.Runs, "close", lambda runs: (seen.append((runs.compactions, [lv for lv, _ in runs.levels])), close(runs)))
    line_dedup(docs).count()
    assert seen == [(3, [2, 0, 0])]
    plan = plans[-1].split("== Physical Plan ==")[-1]
    assert "SortMergeJoin" in plan and plan.count("Exchange") <= 1, plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestrata_run")]


@pytest.mark.parametrize("kind", ["string", "decimal(10,2)", "int"])
def test_line_dedup_identifier_types(spark, kind):
    rows = [("2", "a shared line"), ("10", "a shared line\nx"), (None, "another line of null\na shared line"), ("3", "ANOTHER line of null ")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = line_dedup(df).collect()
    assert sorted((len(r.text), r.n_dropped) for r in out) == sorted([(0, 1), (1, 1), (34, 0), (0, 1)])


def test_line_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a shared line"), (2, "a shared line\nx"), (2, "a shared line\nx")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup(df).collect()) == [(0, 0), (2, 1), (2, 1)]


def words(t):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").translate(UP))


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontaminate(spark, broadcast_rows):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, "..."), (None, text(20)), (52, "solo")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "Solo!"), (103, "a a a a"), (None, text(30))]
    docs += [(200 + i, f"{text(5)} {t.upper() if t else ''}, {text(9)}") for i, t in items if i is not None] + [(300, "repeated"), (300, "repeated"), (None, None), (None, None), (301, docs[5][1]), (301, docs[5][1])]
    spans = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                spans.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                if s := spans.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    got |= s
        want.append((-1 if i is None else i, len(w), len(hit), sorted(got), len(hit) > 0 and 20 * len(hit) >= len(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as words", "2 as row", "3 as grams")
    out = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast_rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out.collect())
    assert got == sorted(want)
    assert sum(w[4] for w in want) > 10
    empty = D.decontaminate(df, spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("n_hit > 0 or contaminated").count() == 0 and empty.count() == len(docs)
    assert D.decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_shards(spark, docs):
    out = shuffle_to_shards(docs, shards=5, bucket_bytes=4000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r._bucket_in) for r in rows) == Counter((i, t, b) for i, t, *_, b in corpus())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert sorted(slots) == list(range(5)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shuffle_to_shards(docs.repartition(7), shards=5, bucket_bytes=4000).collect()
    place = lambda rs: Counter((r.doc_id, r.shard, r.slot) for r in rs)
    assert place(again) == place(rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(r.doc_id for r in rows)
    assert shuffle_to_shards(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    weights = {f"s{i}": 2.0**-i for i in range(6)}
    out = mix_sources(docs, weights, block_rows=3).collect()
    rows = corpus()
    assert sorted(r.position for r in out) == list(range(len(rows)))
    assert sorted((r.doc_id, r.source) for r in out) == sorted((i, s) for i, _, _, s, *_ in rows)
    blocks = Counter((r.source, r.block) for r in out)
    size = Counter(s for _, _, _, s, *_ in rows)
    assert all(n == min(3, size[s] - 3 * b) for (s, b), n in blocks.items())
    slot = {(r.source, r.block): r.slot for r in out}
    assert sorted(slot.values()) == list(range(len(blocks)))
    assert mix_sources(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (None, "a"), (None, "a"), (2, "a")], "doc_id long, source string")
    assert sorted(r.position for r in mix_sources(odd).collect()) == [0, 1, 2, 3]


def plain_edf(sizes, weights):
    """(source, block) slot by slot, each block with its own release and deadline; counting starts anew when a source ends."""
    left, done, start, t = list(sizes), [0] * len(sizes), [0] * len(sizes), 0
    part = [max(1, round(w * mix.PARTS)) for w in weights]
    base = 0
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        whole = sum(part[i] for i in live)
        ready = [(-(-(done[i] - start[i] + 1) * whole // part[i]), i) for i in live if (done[i] - start[i]) * whole // part[i] <= t - base]
        _, i = min(ready)
        yield i, done[i]
        done[i] += 1
        left[i] -= 1
        t += 1
        if not left[i]:
            base, start = t, list(done)


def spread(found):
    """The slots of phases written out."""
    out = {}
    for p in found:
        for i, part in p.parts.items():
            for b in range(p.blocks[i]):
                out[p.start + b // part * p.whole + int(p.at[i][b % part])] = (i, p.first[i] + b)
    assert sorted(out) == list(range(len(out)))
    return [out[t] for t in sorted(out)]


def test_phases_are_earliest_deadline_first(monkeypatch):
    rng = random.Random(5)
    for parts in (1 << 20, 32):  # with few parts, periods repeat
        monkeypatch.setattr(mix, "PARTS", parts)
        for _ in range(30):
            w = [rng.random() + 0.05 for _ in range(rng.randint(1, 9))]
            w = [x / sum(w) for x in w]
            sizes = [rng.randint(1, 300) for _ in w]
            order = spread(mix.phases(sizes, w))
            assert order == list(plain_edf(sizes, w))
            assert sorted(order) == sorted((i, b) for i, n in enumerate(sizes) for b in range(n))
            part = [max(1, round(x * parts)) for x in w]
            done, left, phase, base = [0] * len(w), list(sizes), 0, [0] * len(w)
            for t, (i, _) in enumerate(order):
                live = [k for k in range(len(w)) if left[k] > 0]
                done[i] += 1
                left[i] -= 1
                for k in live:
                    assert abs((done[k] - base[k]) - (t + 1 - phase) * part[k] / sum(part[x] for x in live)) < 1
                if not left[i]:
                    phase, base = t + 1, list(done)


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, "s1": 3.0, "s2": 0.5}])
def test_mixing_against_plain_rows(spark, weights):
    """Positions of all rows from sorting each source by hash and dealing out its blocks one by one."""
    rows = spark.createDataFrame([(i, s) for i, _, _, s, *_ in corpus(400)], "doc_id long, source string")
    hashed = {}
    for i, s, h in rows.selectExpr("doc_id", "source", "xxhash64(29, doc_id)").collect():
        hashed.setdefault(s, []).append((h, i))
    names = sorted(hashed)
    n = [len(hashed[s]) for s in names]
    w = [weights.get(s, min(weights.values())) for s in names] if weights else [x**0.5 for x in n]
    want, at = {}, 0
    for i, b in plain_edf([-(-x // 5) for x in n], [x / sum(w) for x in w]):
        for _, d in sorted(hashed[names[i]])[b * 5 : b * 5 + 5]:
            want[d] = at
            at += 1
    got = {r.doc_id: r.position for r in mix_sources(rows.repartition(3), weights, block_rows=5).collect()}
    assert got == want and at == len(got) > 400


def test_mixing_many_equal_rows(spark):
    df = spark.createDataFrame([(None, "a")] * 300 + [(None, None)] * 40 + [(7, "b")] * 90 + [(k, "b") for k in range(100, 150)], "doc_id long, source string").repartition(5)
    out = mix_sources(df, block_rows=8).collect()
    assert sorted(r.position for r in out) == list(range(480))
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r.doc_id, r.source) for r in df.collect())


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 300, 5000, 70_000):
        ids = (rng.zipf(1.2, n) % 60_000).astype(np.uint32)
        ids[n // 2 :] = ids[: n - n // 2]
        assert (rangecoder.decode(rangecoder.encode(ids, 60_000), n, 60_000) == ids).all()
    for vocab in (1, 2, 70_000, 5_000_000):
        ids = rng.integers(0, vocab, 9000).astype(np.uint32)
        assert (rangecoder.decode(rangecoder.encode(ids, vocab), 9000, vocab) == ids).all()
    same = np.full(60_000, 7, np.uint32)
    assert 2 * len(rangecoder.encode(same, 60_000)) < 0.1 * len(same)


def test_range_coder_mixes():
    """An id's share of the range is the weighted sum of what the three predictions give it."""
    m = rangecoder.Model(100)
    x = np.array([5, 7, 5, 5], np.uint32)
    for _ in range(40):
        last, before = np.array([1, 1, 2, 3]), np.array([9, 8, 9, 9])
        h, s1, s2, p1, p2, row = m.predict(last, before)
        w = [c[row] for c in (m.w0, m.w1, m.w2)]
        assert (sum(c.astype(int) for c in w) == 1 << rangecoder.WEIGHT_BITS).all()
        m.learn(x, last, h, s1, s2, p1, p2, row, w[0], w[1] << m.shift, w[2] << m.shift)
    # lane 0 and 1 share an order-1 context, in which id 7 came last; order 2 tells them apart
    assert p1.tolist() == [7, 7, 5, 5] and p2.tolist() == [5, 7, 5, 5]
    assert w[2][0] > 4 * w[1][0]


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_equal_whole_texts():
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["a", "b", "é", "1", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "<|endoftext|>", "Hello", "日本", "?!", "\r\n", "it's", "\x1c", "Ⅷ", "²"]
    texts = [None, "", " ", "\n", "a ", "a\nb", "a \nb", "x.\ny"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    tok = token_files.Tokens(PATH)
    ids, n = tok.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    want = tok.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in want]


def test_known_pieces_stay_in_the_store(monkeypatch):
    """(op6) Words that come again aren't encoded again when the store is full, and ids stay those of whole texts."""
    import pyarrow as pa

    rng, asked = random.Random(2), []
    real = token_files.Tokens._encode_new
    monkeypatch.setattr(token_files.Tokens, "_encode_new", lambda self, strings, *rest: asked.extend(strings.to_pylist()) or real(self, strings, *rest))
    monkeypatch.setattr(token_files, "MEMO", 400)
    monkeypatch.setattr(token_files, "CALL", 7)
    word = lambda: "".join(rng.choice("abcdefghéñßабвגד\u0301ǅ日ｱ") for _ in range(rng.randint(1, 9)))
    common = [word() for _ in range(60)]
    tok = token_files.Tokens(PATH)
    for _ in range(12):
        texts = [" ".join(rng.sample([*common, *(word() + rng.choice(["", "!!", "'s"]) for _ in range(30))], 90)) for _ in range(3)] + [" ".join(common)]
        ids, n = tok.encode(pa.array(texts))
        at = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in tok.tok.encode_batch(texts, add_special_tokens=False)]
        assert len(tok.start) == len(tok.length) == len(tok.used) == 1 + sum(map(len, tok.spaced.names)) + sum(map(len, tok.plain.names)) - 2
    assert len(tok.start) < 800
    often = Counter(x for x in asked if x in set(common[1:]))
    assert max(often.values()) <= 3  # after a space, at a text's start


def test_few_letters_are_cut_by_the_tokenizer():
    """(op6) Words of letters go to the model without a search for pieces; what is a letter the tokenizer itself has told."""
    tok = token_files.Tokens(PATH)
    assert [chr(c) for c in range(128) if tok.letter[c]] == [chr(c) for c in range(128) if chr(c).isalpha()]
    import pyarrow as pa

    words = pa.array(["abc", "éß", "a1", "дом", "日本", "e\u0301", "it's", "x!"], pa.large_string())
    assert tok._one_piece(words).tolist() == [True, True, False, True, False, False, False, False]
    assert tok._one_piece(words.slice(1, 3)).tolist() == [True, False, True]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_files(spark, docs, name):
    path = public_tokenizers.path(name)
    out = token_files.token_digests(spark, token_files.write_tokens(docs, path, block_ids=700)).collect()
    tok, start, want = Tokenizer.from_file(path), 0, []
    for i, t, *_ in sorted(corpus()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out)) == want
    p = token_files.write_tokens(docs, path)
    full = {r.doc_id: r.ids for r in token_files.read_tokens(spark, p).collect()}
    assert full[7][-1] == 0 and len(full) == len(want)
    odd = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b")], "doc_id long, text string")
    assert token_files.token_digests(spark, token_files.write_tokens(odd, path)).count() == 4
    assert token_files.token_digests(spark, token_files.write_tokens(odd.limit(0), path)).count() == 0


def test_packer_gets_small_batches(spark, monkeypatch):
    """(pipeline) A task's rows don't stand in its worker at once, and the session keeps its own setting."""
    real = token_files._packer

    def watched(*args):
        def run(batches):
            def checked():
                for batch in batches:
                    assert batch.num_rows <= 1024
                    yield batch

            yield from real(*args)(checked())

        return run

    monkeypatch.setattr(token_files, "_packer", watched)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('text ', id % 7) as text").coalesce(1)
    out = token_files.token_digests(spark, token_files.write_tokens(docs, PATH)).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == list(range(12_000)) and spark.conf.get(key) == before
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def test_damaged_block():
    data = token_files.pack([1, None], np.array([2, 1]), np.array([5, 0, 0], np.uint32), 50_257)
    names, n, ids = token_files.unpack(data)
    assert (names, n.tolist(), ids.tolist()) == ([1, None], [2, 1], [5, 0, 0])
    with pytest.raises(ValueError):
        token_files.unpack(data[:40] + bytes([data[40] ^ 1]) + data[41:])


def test_quality(spark):
    rng = random.Random(2)
    make = lambda good: " ".join(rng.choice(["fine", "plain", "words", "here"]) if good else rng.choice(["BUY!!", "$$$", "CLICK!!"]) for _ in range(30))
    rows = [(i, make(i % 3 > 0)) for i in range(600)] + [(1000, None), (1001, ""), (None, "x"), (5, "plain words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score_in", "2 as y")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = quality_scores(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    test = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert len(test) > 80 and all(r.predicted == (r.doc_id % 3 > 0) for r in test)
    assert quality_scores(df, labels.limit(0)).count() == len(rows)
    assert quality_scores(df.limit(0), labels).count() == 0
    assert df.where(held_out(df["doc_id"])).count() > 50


def test_log_count_ratios_against_plain_counting(spark, monkeypatch):
    """Of every labelled row that isn't held out, counted text by text."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["fine", "plain", "BUY", "x!", "12", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    labels = [(i, rng.randint(0, 1)) for i in range(0, 300, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = {}
    plain = Q.dual_descent
    monkeypatch.setattr(Q, "dual_descent", lambda rows, scale, sign, cost, rounds, seed: seen.update(scale=scale, rows=rows, sign=sign) or plain(rows, scale, sign, cost, rounds, seed))
    Q.train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    p, q, n = np.ones(Q.SLOTS), np.ones(Q.SLOTS), [0, 0]
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 5:
            data = np.frombuffer(texts[i].encode(), np.uint8)
            slots = np.unique(Q.indicators(data, np.array([0, len(data)]))[1])
            (p if y else q)[slots] += 1
            n[y] += 1
    want = np.where(p + q < 4, 0, np.log((p / (n[1] + 2)) / (q / (n[0] + 2))))
    nonzero = want != 0
    ratio = seen["scale"][nonzero] / want[nonzero]
    assert np.allclose(ratio, ratio[0]) and (seen["scale"][~nonzero] == 0).all() and nonzero.sum() > 50
    assert len(seen["rows"]) == sum(n) - sum(n) // 5


def test_dual_descent_against_a_plain_solver():
    """The same objective by projected gradient steps on the whole dual."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    scale, cost = rng.normal(size=30), rng.uniform(0.2, 1, 60)
    sign = np.where(rng.random(60) < 0.4, 1.0, -1.0)
    x = np.zeros((60, 31))
    for k, r in enumerate(rows):
        x[k, r] = scale[r]
    x[:, 30] = 1
    kernel = (x * sign[:, None]) @ (x * sign[:, None]).T
    a, step = np.zeros(60), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(60_000):
        a = np.clip(a - step * (kernel @ a - 1), 0, cost)
    want = (x * (a * sign)[:, None]).sum(0)
    w, b = dual_descent(rows, scale, sign, cost, 3000, 0)
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    assert abs(loss(np.append(w, b)) - loss(want)) < 1e-3 * loss(want)
    assert np.abs(np.append(w, b) - want).max() < 0.02


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])]
    w, b = dual_descent(rows, np.ones(3), np.array([1.0, -1, 1, -1]), np.full(4, 10.0), 100, 0)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, [1, -1, 1, -1], strict=True))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
