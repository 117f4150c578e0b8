"""Token ids in binary files: blocks packed by an adaptive range coder.

File format. A file is a Parquet container, written and committed by Spark, with one row for each block; `data` is the block:

    4 bytes  magic "LSTB"
    u32      version (2), documents, vocabulary size, 0
    u64      ids in the block
    i64 []   identifiers of the documents, then u8 [] 1 where an identifier is null
    u32 []   ids of each document, the end id included
    u16 []   the words of rangecoder.encode
    u32      crc32 of all bytes before

All numbers are little-endian. Blocks hold whole documents and the model is reset for each, so any block can be read alone and
a damaged one is noticed. Beside `data` stand part, block (its place in the part) and part_offset (ids of the part before it);
parts are in the order of the documents.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rangecoder
from .common import give_back, new_path, shuffle_partitions, small_batches, tidy

MAGIC = b"LSTB"
BLOCK_IDS = 1 << 21
#: Bytes of text encoded together.
PORTION = 4 << 20
#: Rows of a batch that the packer gets.
BATCH_ROWS = 1024
#: Strings kept by a Python worker with their ids, and their bytes; beyond it those stay that more than one portion had.
MEMO, MEMO_BYTES = 400_000, 16 << 20
#: New strings in one call of the tokenizer.
CALL = 4096

#: Marks, a run of which a byte-level tokenizer cuts off the letters before it.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
LONGEST_RUN = 7

BLOCKS = "part int, block int, n_docs int, n_ids long, part_offset long, data binary"


class Index:
    """Numbers of strings, looked up by Arrow for a whole array, so that known strings don't become Python's."""

    def __init__(self) -> None:
        """The empty string has number 0."""
        self.names, self.numbers = [pa.array([""], pa.large_string())], [np.array([-1, 0], np.int32)]

    def extend(self, strings: pa.Array, first: int) -> None:
        self.names.append(strings)
        self.numbers.append(np.arange(first, first + len(strings), dtype=np.int32))

    def of(self, strings: pa.Array) -> np.ndarray:
        """Their numbers, -1 for unknown ones."""
        self.names, self.numbers = [pa.concat_arrays(self.names)], [np.concatenate(self.numbers)]
        at = pc.fill_null(pc.index_in(strings, value_set=self.names[0]), -1).to_numpy(zero_copy_only=False)
        return self.numbers[0][at + 1]

    def bytes_of(self, stay: np.ndarray) -> int:
        """Bytes of the strings whose number stays."""
        return int(sum(pc.binary_length(n).to_numpy()[stay[k]].sum() for n, k in zip(self.names, [self.numbers[0][1:], *self.numbers[1:]], strict=True)))

    def keep(self, stay: np.ndarray, number: np.ndarray) -> None:
        """Only the strings whose number stays, with new numbers."""
        old = np.concatenate(self.numbers)[1:]
        self.names = [pa.concat_arrays(self.names).filter(pa.array(stay[old]))]
        self.numbers = [np.concatenate([[-1], number[old[stay[old]]]]).astype(np.int32)]


class Tokens:
    """Ids of whole texts by a tokenizer of the `tokenizers` library.

    A byte-level tokenizer without normaliser cuts a text before a space that a character other than white space follows, and
    round a line end that has such characters on both sides. So a text is encoded piece by piece, each distinct piece (with its
    space) once, and a piece of letters and marks as the letters and the marks, which it cuts apart too. Other tokenizers,
    and texts where white space meets white space or an end of the text, are encoded whole.
    """

    _of: dict[str, Tokens] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        pre = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        self.pieces = self.tok.normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.vocab = self.tok.get_vocab_size()
        self.bytes = np.zeros(self.vocab, np.int64)  # a byte-level token has a character for each byte
        for k in range(self.vocab):
            self.bytes[k] = len(self.tok.id_to_token(k) or "")
        ends = self.whole(["\n", "a\n b\nc"])
        self.line_end = ends[0][0] if ends[0] else -1
        self.pieces = self.pieces and len(ends[0]) == 1 and ends[1].count(self.line_end) == 2
        # the same model without the search for pieces, for words known to be one: its text has a character for each byte
        self.letter = np.zeros(1 << 11, bool)
        if self.pieces and not any(t.content.isalpha() for t in self.tok.get_added_tokens_decoder().values()):
            cut = self.tok.pre_tokenizer.pre_tokenize_str
            self.letter[:] = [len(cut(f" a{chr(c)}a")) == 1 for c in range(len(self.letter))]
            self.words = Tokenizer(self.tok.model)
            self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            seen = [b for b in range(256) if 33 <= b < 127 or 161 <= b != 173]
            shown = dict(zip([*seen, *(b for b in range(256) if b not in seen)], [*seen, *range(256, 512)], strict=False))
            shown = [chr(shown[b]).encode() for b in range(256)] + [b" "]  # the last is the cut
            self.shown = np.frombuffer(b"".join(shown), np.uint8)
            self.shown_length = np.array([len(x) for x in shown], np.int32)
            self.shown_start = np.cumsum(self.shown_length, dtype=np.int32) - self.shown_length
        self.clear()

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def clear(self) -> None:
        """An empty store, in which number 0 has no ids."""
        self.spaced, self.plain = Index(), Index()
        self.flat, self.start, self.length = np.zeros(1 << 20, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.used = np.zeros(1, np.int32)  # portions that had the string
        self.filled = self.held = 0

    def make_room(self) -> None:
        """Strings of a single portion go; if the store stays more than half full, all go."""
        stay = self.used > 1
        stay[0] = True
        size = sum(i.bytes_of(stay) for i in (self.spaced, self.plain))
        if 2 * stay.sum() > MEMO or 2 * size > MEMO_BYTES:
            return self.clear()
        self.spaced.keep(stay, np.cumsum(stay) - 1)
        self.plain.keep(stay, np.cumsum(stay) - 1)
        flat, _ = _gather(self.flat, self.start, self.length, np.flatnonzero(stay))
        self.length = self.length[stay]
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.flat = np.zeros(max(1 << 20, len(flat)), np.uint32)
        self.flat[: len(flat)] = flat
        self.used, self.filled, self.held = np.zeros(len(self.length), np.int32), len(flat), size

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, strings: pa.Array, index: Index, space: str) -> np.ndarray:
        """Places in the store; new strings are encoded first. Each string is there once."""
        at = index.of(strings)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            one = self._one_piece(strings.take(pa.array(missing)))
            missing = np.concatenate([missing[one], missing[~one]])
            new = strings.take(pa.array(missing))
            ids, sizes = self._encode_new(new, int(one.sum()), space)
            while self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.filled : self.filled + len(ids)] = ids
            first = len(self.start)
            self.start = np.concatenate([self.start, (self.filled + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.length = np.concatenate([self.length, sizes.astype(np.int32)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
            self.filled += len(ids)
            self.held += pc.sum(pc.binary_length(new)).as_py()
            index.extend(new, first)
            at[missing] = np.arange(first, first + len(new))
        self.used[at] += 1
        return at

    def _one_piece(self, strings: pa.Array) -> np.ndarray:
        """Which strings, none of them empty, consist of letters that the tokenizer doesn't cut apart; those over U+07FF aren't looked at."""
        data, at = _bytes(strings)
        here = data[at[0] : at[-1]]
        low = np.append(here[1:], 0).astype(np.int64) & 63
        point = np.where(here < 128, here, (here & 31).astype(np.int64) << 6 | low)
        good = self.letter[point] & (here < 224) | (here >> 6 == 2)
        return np.logical_and.reduceat(good, at[:-1] - at[0])

    def _shown(self, strings: pa.Array, space: str) -> str:
        """Words in the model's own characters, with a cut between each two."""
        data, at = _bytes(strings)
        n, size, ahead = len(strings), np.diff(at), 1 + len(space)
        which = np.full(int(at[-1] - at[0]) + n * ahead, 256, np.int64)
        begin = at[:-1] - at[0] + np.arange(n) * ahead
        if space:
            which[begin + 1] = 32
        body = np.arange(at[0], at[-1]) - at[0] + np.repeat(np.arange(1, n + 1) * ahead, size)
        which[body] = data[at[0] : at[-1]]
        return _gather(self.shown, self.shown_start, self.shown_length, which[1:])[0].tobytes().decode()

    def _encode_new(self, strings: pa.Array, one: int, space: str) -> tuple[np.ndarray, np.ndarray]:
        """Many strings in one text. The first `one` of them are single pieces, which are cut apart as they are.

        Others have a line end between each two where they have no space, which the tokenizer keeps to itself. No token reaches
        over a space's start or a line end, so the tokens' lengths in bytes tell the strings apart.
        """
        ids, sizes = [], []
        for lo, hi in [(k, min(k + CALL, one)) for k in range(0, one, CALL)] + [(k, min(k + CALL, len(strings))) for k in range(one, len(strings), CALL)]:
            some = strings.slice(lo, hi - lo)
            ends = np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64))
            if hi <= one:
                got = self.words.encode_batch_fast([self._shown(some, space)], add_special_tokens=False)[0].ids
                ends += np.arange(1, hi - lo + 1) * len(space)
            else:
                got = self.tok.encode_batch_fast([space + (space or "\n").join(some.to_pylist())], add_special_tokens=False)[0].ids
                # a byte for the space before each, or for the line end before each but the first
                ends += np.arange(hi - lo) + len(space)
            got = np.array(got, np.uint32)
            reach = np.cumsum(self.bytes[got])
            at = np.searchsorted(reach, ends)
            if len(got) and at[-1] == len(got) - 1 and (reach[at] == ends).all():
                counts = np.diff(at, prepend=-1)
                if hi > one and not space:  # the line ends go
                    got = np.delete(got, at[:-1] + 1)
                    counts[1:] -= 1
                ids.append(got)
                sizes.append(counts)
            else:  # pragma: no cover  another vocabulary
                each = self.whole([space + x for x in some.to_pylist()])
                ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: pa.Array, odd: np.ndarray, index: Index, space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after the other, and the number for each; odd ones have none."""
        stem = pc.utf8_rtrim(words, MARKS)
        cut = (pc.binary_length(words).to_numpy() - pc.binary_length(stem).to_numpy()).astype(np.int64)
        apart = (cut > 0) & (cut <= LONGEST_RUN) & pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False) & ~odd
        stem = pc.if_else(pa.array(odd), "", pc.if_else(pa.array(apart), stem, words)).dictionary_encode()
        both = np.zeros((len(words), 2), np.int64)
        both[:, 0] = self._numbers(stem.dictionary, index, space)[stem.indices.to_numpy()]
        rows = np.flatnonzero(apart)
        if len(rows):
            data, at = _bytes(words)
            size = cut[rows]
            run = np.zeros(len(rows), np.uint64)
            for k in range(LONGEST_RUN):
                run |= np.where(k < size, data[np.minimum(at[rows + 1] - size + k, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
            runs, back = np.unique(run, return_inverse=True)
            marks = pa.array([int(x).to_bytes(8, "little").rstrip(b"\0").decode() for x in runs], pa.large_string())
            both[rows, 1] = self._numbers(marks, self.plain, "")[back]
        return _gather(self.flat, self.start, self.length, both.ravel())[0], self.length[both].sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number for each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.pieces:
            got = self.whole(texts.to_pylist())
            return np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(g) for g in got], np.int64)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.start) > MEMO or self.held > MEMO_BYTES:
            self.make_room()
        lines = pc.split_pattern(texts, "\n")
        line_at = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        split = pc.split_pattern(lines.flatten(), " ")
        piece_at = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        size = pc.binary_length(words)
        # white space at an end, or nothing
        odd = pc.or_(pc.equal(size, 0), pc.not_equal(size, pc.binary_length(pc.utf8_trim_whitespace(words)))).to_numpy(zero_copy_only=False)
        firsts = piece_at[:-1]
        heads, back = np.unique(codes[firsts], return_inverse=True)
        flat, length = self._words(words, odd, self.spaced, " ")
        head_flat, head_length = self._words(words.take(pa.array(heads)), odd[heads], self.plain, "")
        # what stands in this portion: words after a space, words at a text's start, and after a line end, with it
        ended = np.insert(head_flat, np.cumsum(head_length) - head_length, self.line_end)
        flat = np.concatenate([flat, head_flat, ended])
        length = np.concatenate([length, head_length, head_length + 1]).astype(np.int32)
        start = np.cumsum(length, dtype=np.int32) - length
        inner = np.ones(len(firsts), np.int32)
        inner[line_at[:-1]] = 0
        bad = np.add.reduceat(odd[codes], firsts[line_at[:-1]]) > 0
        bad &= pc.binary_length(texts).to_numpy() > 0  # an empty text is its one, empty piece
        codes = codes.copy()
        codes[firsts] = len(words) + back + len(heads) * inner
        ids, ends = _gather(flat, start, length, codes)
        n = np.diff(ends[np.append(firsts[line_at[1:-1]], len(codes)) - 1], prepend=0)
        again = np.flatnonzero(bad)
        if len(again):
            bounds = np.concatenate([[0], np.cumsum(n)])
            parts, done = [], 0
            for k, got in zip(again, self.whole(texts.take(pa.array(again)).to_pylist()), strict=True):
                parts += [ids[done : bounds[k]], np.array(got, np.uint32)]
                done = bounds[k + 1]
                n[k] = len(got)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, n


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches one after the other, and where each ends."""
    n = length[which]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat((start[which] - ends + n).astype(kind), n)
    place += np.arange(total, dtype=kind)
    return flat[place], ends


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of large strings, and where each begins."""
    _, offsets, data = strings.buffers()
    return np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    words = rangecoder.encode(ids, vocab) if len(ids) else np.zeros(0, np.uint16)
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    body = MAGIC + struct.pack("<IIIIQ", 2, len(doc_ids), vocab, 0, len(ids))
    body += names.tobytes() + null.tobytes() + lengths.astype("<u4").tobytes() + words.astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged token block")
    version, docs, vocab, _, n = struct.unpack_from("<IIIIQ", data, 4)
    if version != 2:
        raise ValueError(f"token block of version {version}")
    at = 4 + 24
    names = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, "u1", docs, at := at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at := at + docs)
    words = np.frombuffer(data[at + 4 * docs : -4], "<u2")
    ids = rangecoder.decode(words, n, vocab) if n else np.zeros(0, np.uint32)
    return [None if z else int(d) for d, z in zip(names, null, strict=True)], lengths, ids


def _packer(tokenizer: str, end_id: int, block_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokens.of(tokenizer)
        part, block, offset = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, offset, docs, lengths, ids, held
            n, flat = np.concatenate(lengths), np.concatenate(ids)
            ids = []
            give_back()
            data = pack(docs, n, flat, max(tok.vocab, end_id + 1))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": pa.array([len(docs)], pa.int32()), "n_ids": [held], "part_offset": [offset], "data": [data]})
            block, offset, docs, lengths, ids, held = block + 1, offset + held, [], [], [], 0
            return out

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.diff(np.cumsum(sizes) // PORTION, append=-1)) + 1
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                got, n = tok.encode(batch["text"].slice(lo, hi - lo))
                names = batch["doc_id"].slice(lo, hi - lo).to_pylist()
                stops = np.cumsum(n)
                full = np.insert(got, stops, end_id).astype(np.uint32)
                n, stops = n + 1, stops + np.arange(1, len(n) + 1)
                done = 0
                while done < len(n):
                    base = stops[done - 1] if done else 0
                    cut = min(len(n), max(done + 1, int(np.searchsorted(stops, base + block_ids - held, side="right"))))
                    docs += names[done:cut]
                    lengths.append(n[done:cut])
                    ids.append(full[base : stops[cut - 1]])
                    held += int(stops[cut - 1] - base)
                    done = cut
                    if held >= block_ids or done < len(n):
                        yield close()
                got = full = None  # else they stand beside the next portion's
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS, order: list[str] | None = None) -> str:
    """Encode each whole text, append `end_id`, and write blocks of about `block_ids` ids; returns the path.

    Documents are in ascending order of the identifier, nulls first (or of the columns `order`): range-partitioned and sorted by
    it, and each task writes the blocks of its range. A block holds whole documents, so one longer than a block has a block of
    its own size. Null text counts as empty: just the end id. Equal identifiers are all written, their order undefined.
    Identifiers must be whole numbers, of which the format holds 64 bits; others raise. Very long texts are encoded whole, in
    one task. Empty table: no blocks. Further columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    keys = order or [id_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)))
    names = [f"_key{i}" for i in range(len(keys))]
    rows = rows.repartitionByRange(shuffle_partitions(spark), *names).sortWithinPartitions(*names).select("doc_id", "text")
    with small_batches(spark, BATCH_ROWS):
        rows.mapInArrow(tidy(_packer(tokenizer, end_id, block_ids)), BLOCKS).write.option("compression", "uncompressed").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, each document one row: doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<int>", lambda ids: ids.astype(np.int32))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_tokens, with the ids' crc32 (as little-endian unsigned 32-bit integers) in place of the ids: doc_id, start, n_tokens, ids_crc32."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, schema: str, view: Callable) -> DataFrame:
    last = schema.split(", ")[-1].split()
    kind = pa.int64() if last[1] == "long" else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Tokens._of.clear()  # the worker may have encoded before; its store isn't needed any more
        for batch in batches:
            for part, offset, data in zip(batch["part"].to_pylist(), batch["part_offset"].to_pylist(), batch["data"], strict=True):
                names, lengths, ids = unpack(data.as_py())
                stops = np.cumsum(lengths, dtype=np.int64)
                starts = stops - lengths
                for lo in range(0, len(names), 10_000):
                    s = slice(lo, lo + 10_000)
                    got = [view(ids[a:b]) for a, b in zip(starts[s], stops[s], strict=True)]
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(got), pa.int32()), "doc_id": pa.array(names[s], pa.int64()), "start": pa.array(offset + starts[s]), "n_tokens": pa.array(lengths[s].astype(np.int64)), last[0]: pa.array(got, kind)})

    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row for each part; a part is one task's range
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, total = [], 0
    for part, n in sorted(tuple(r) for r in parts):
        base.append((part, total))
        total += n
    before = spark.createDataFrame(base, "part int, base long")
    rows = blocks.select("part", "part_offset", "data").mapInArrow(tidy(run), f"part int, {schema}")
    rows = rows.join(F.broadcast(before), "part") if len(base) <= 1_000_000 else rows.join(before, "part")
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", last[0])
