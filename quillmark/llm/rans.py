"""Token ids in binary shards: static range asymmetric numeral system (rANS).

A shard holds the ids of consecutive documents. One frequency table, counted over the
shard, is shared by its blocks; every block interleaves ``LANES`` coder states over one
stream of words and can be decoded by itself, from its start or from any of its
checkpoints (the states and the word position every ``CHECKPOINT`` steps). The tables
before the blocks, each block's head and payload and its decoded ids are covered by
checksums. Numpy steps all blocks of a shard at once.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm import io

MAGIC = b"QRNS0002"
LANES, STEPS, CHECKPOINT = 256, 512, 128
#: Ids after which a shard is closed (with the document that crosses it).
SHARD_IDS = 4_000_000
#: States lie in [LOW, LOW * 2**word).
LOW = 1 << 24
_HEAD = struct.Struct("<8sQQIIIIII")
_BLOCK = struct.Struct("<IIII")


class Corrupt(ValueError):
    """A shard that fails a checksum or isn't one."""


def normalised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, close to counts' shares."""
    total = int(counts.sum())
    freq = np.maximum(1, counts.astype(np.float64) * (1 << bits) / total).astype(np.int64)
    gap = (1 << bits) - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if gap > 0:
        freq[order[0]] += gap
    while gap < 0:
        for i in order:
            take = min(-gap, max(1, freq[i] // 8), freq[i] - 1)
            freq[i] -= take
            gap += take
            if gap == 0:
                break
    return freq


def word_bits(bits: int) -> int:
    """Bits of a stream word: states stay below 2**53, where doubles are exact."""
    return 16 if bits <= 16 else 24


def encode(ids: np.ndarray, doc_ids: np.ndarray, doc_valid: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard of at least one id."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        dense = np.zeros(len(counts), dtype=np.int32)
        dense[used] = np.arange(len(used), dtype=np.int32)
        dense, counts = dense[ids], counts[used]
    else:
        used, dense, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = 16 if len(used) <= 49_152 else max(20, len(used).bit_length() + 2)
    freq = normalised(counts, bits)
    cum = np.zeros(len(freq), dtype=np.int64)
    np.cumsum(freq[:-1], out=cum[1:])
    wide = word_bits(bits)
    per_block = LANES * STEPS
    n_blocks = -(-len(ids) // per_block)
    out = [
        _HEAD.pack(MAGIC, len(ids), len(doc_ids), LANES, STEPS, CHECKPOINT, bits, n_blocks, len(used)),
        used.astype("<u4").tobytes(),
        freq.astype("<u4").tobytes(),
        doc_ids.astype("<i8").tobytes(),
        doc_valid.astype("u1").tobytes(),
        lengths.astype("<u8").tobytes(),
    ]
    out.append(struct.pack("<I", zlib.crc32(b"".join(out))))
    freq_f, cum_f = freq.astype(np.float64), cum.astype(np.float64)
    scale, word, slots = float(LOW) * 2.0 ** (wide - bits), 2.0**wide, 2.0**bits
    for first in range(0, n_blocks, 32):
        count = min(32, n_blocks - first)
        own = dense[first * per_block : (first + count) * per_block]
        sym = np.zeros(count * per_block, dtype=np.int32)
        sym[: len(own)] = own
        sym = np.ascontiguousarray(sym.reshape(count, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, count * LANES)
        x = np.full(count * LANES, float(LOW))
        words = np.empty(sym.shape, dtype=np.float32 if wide == 16 else np.float64)
        sent = np.empty(sym.shape, dtype=bool)
        points = np.empty((STEPS // CHECKPOINT, count * LANES))
        for t in range(STEPS - 1, -1, -1):
            s = sym[t]
            f = freq_f.take(s)
            over = x >= f * scale
            high = np.floor(x * (1.0 / word))
            np.subtract(x, high * word, out=words[t], casting="same_kind")
            sent[t] = over
            x = np.where(over, high, x)
            q = np.floor(x / f)
            x = q * slots + (x - q * f) + cum_f.take(s)
            if t % CHECKPOINT == 0:
                points[t // CHECKPOINT] = x
        sent = sent.reshape(STEPS, count, LANES)
        words = words.reshape(STEPS, count, LANES)
        points = points.reshape(-1, count, LANES)
        per_step = sent.sum(axis=2)
        for b in range(count):
            payload = words[:, b][sent[:, b]].astype("<u2" if wide == 16 else "<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(per_step[:, b])])[:-1:CHECKPOINT].astype("<u4").tobytes()
            states = points[:, b].astype("<u8").tobytes()
            real = ids[(first + b) * per_block : (first + b + 1) * per_block]
            body = at + states + payload
            head = struct.pack("<II", len(real), len(payload))
            out.append(_BLOCK.pack(len(real), len(payload), zlib.crc32(body, zlib.crc32(head)), zlib.crc32(real.astype("<u4").tobytes())))
            out.append(body)
    return b"".join(out)


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size or data[:8] != MAGIC:
            raise Corrupt("not a shard")
        _, self.n_ids, self.n_docs, self.lanes, self.steps, self.every, self.bits, n_blocks, n_used = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            if at + n * np.dtype(kind).itemsize > len(data):
                raise Corrupt("tables")
            got = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += got.nbytes
            return got

        self.used, freq = take("<u4", n_used), take("<u4", n_used).astype(np.int64)
        self.doc_ids, self.doc_valid = take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool)
        self.lengths = take("<u8", self.n_docs).astype(np.int64)
        covered = at
        if zlib.crc32(data[:covered]) != int(take("<u4", 1)[0]) or int(freq.sum()) != 1 << self.bits:
            raise Corrupt("tables")
        self.word = word_bits(self.bits)
        self.slot_id = np.repeat(self.used, freq)
        self.slot_freq = np.repeat(freq, freq)
        self.slot_low = np.arange(1 << self.bits, dtype=np.int64) - np.repeat(np.cumsum(freq) - freq, freq)
        self.points = self.steps // self.every
        self.blocks = []
        for _ in range(n_blocks):
            if at + _BLOCK.size > len(data):
                raise Corrupt("cut short")
            n, n_bytes, crc, ids_crc = _BLOCK.unpack_from(data, at)
            head = data[at : at + 8]
            at += _BLOCK.size
            size = 4 * self.points + 8 * self.points * self.lanes + n_bytes
            if at + size > len(data) or zlib.crc32(data[at : at + size], zlib.crc32(head)) != crc:
                raise Corrupt("payload checksum")
            where = np.frombuffer(data, "<u4", self.points, at)
            states = np.frombuffer(data, "<u8", self.points * self.lanes, at + 4 * self.points).reshape(self.points, self.lanes)
            kind = np.dtype("<u2" if self.word == 16 else "<u4")
            stream = np.frombuffer(data, kind, n_bytes // kind.itemsize, at + size - n_bytes)
            self.blocks.append((n, ids_crc, where, states, stream))
            at += size

    def _run(self, blocks: list[int], point: int, stop: int) -> np.ndarray:
        """Ids of steps [point * every, stop) of these blocks, as (block, step, lane)."""
        streams = [self.blocks[b][4] for b in blocks]
        base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])[:-1].astype(np.int64)
        stream = np.concatenate([*streams, np.zeros(1, streams[0].dtype)]).astype(np.int64)
        ptr = base + np.array([int(self.blocks[b][2][point]) for b in blocks], dtype=np.int64)
        x = np.stack([self.blocks[b][3][point] for b in blocks]).astype(np.int64)
        first = point * self.every
        out = np.empty((len(blocks), stop - first, self.lanes), dtype=np.int32)
        mask, end = (1 << self.bits) - 1, len(stream) - 1
        for t in range(stop - first):
            low = x & mask
            out[:, t, :] = low
            x = self.slot_freq.take(low) * (x >> self.bits) + self.slot_low.take(low)
            need = x < LOW
            rank = np.cumsum(need, axis=1, dtype=np.int32)
            at = np.minimum(ptr[:, None] + rank - 1, end)
            x = np.where(need, (x << self.word) | stream.take(at), x)
            ptr += rank[:, -1]
        return self.slot_id[out]

    def ids(self) -> np.ndarray:
        """All ids, checked block by block."""
        out = []
        for first in range(0, len(self.blocks), 32):
            group = list(range(first, min(first + 32, len(self.blocks))))
            got = self._run(group, 0, self.steps).reshape(len(group), -1)
            for row, b in zip(got, group, strict=True):
                real = row[: self.blocks[b][0]]
                if zlib.crc32(real.astype("<u4").tobytes()) != self.blocks[b][1]:
                    raise Corrupt("ids checksum")
                out.append(real)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def ids_between(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end), decoded from the nearest checkpoints only."""
        per_block, out = self.steps * self.lanes, []
        for b in range(start // per_block, -(-end // per_block)):
            lo, hi = max(start, b * per_block) - b * per_block, min(end, (b + 1) * per_block) - b * per_block
            point, stop = lo // self.lanes // self.every, -(-hi // self.lanes)
            got = self._run([b], point, stop).reshape(-1)
            skip = point * self.every * self.lanes
            out.append(got[lo - skip : hi - skip])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Tokenizer:
    """Whole texts to ids with the tokenizers library, one lookup per recurring part.

    Every pre-token of a byte-level BPE starts before a space that a non-space follows.
    Where all spaces of a text are such, its parts between spaces are encoded apart,
    and a part seen before is looked up; any other text goes to the library whole.
    """

    #: Entries of one generation of the lookup table; two generations are held.
    LIMIT = 650_000
    #: Characters that form a pre-token of their own after a letter.
    MARKS = frozenset(",.;:!?")

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.space = re.compile(r"\s")
        #: Ids of parts after a space (with it), and of parts without one before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {"": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space before it.

        Many pieces go to the library as one text: a space before a non-space begins a
        pre-token, so tokens belong to the piece that their offset lies in. Pieces with
        white space or the mark of a special token go alone.
        """
        out: list[bytes] = [b""] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if "<" not in p and not self.space.search(p)]
        alone = sorted(set(range(len(pieces))) - set(plain))
        for k, ids in zip(alone, self._library([" " + pieces[k] for k in alone]) if alone else [], strict=True):
            out[k] = ids
        groups = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        texts = ["".join([" " + pieces[k] for k in group]) for group in groups]
        for group, e in zip(groups, self.library.encode_batch(texts, add_special_tokens=False) if texts else [], strict=True):
            begins = np.cumsum([0] + [len(pieces[k]) + 1 for k in group])
            starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.offsets))
            cuts = np.searchsorted(starts, begins).tolist()
            raw = np.array(e.ids, dtype="<u4").tobytes()
            for k, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                out[k] = raw[4 * a : 4 * b]
        return out

    def _pieces(self, part: str) -> list[tuple[bool, str]]:
        """(space before it, text) of pieces whose ids, in turn, are those of a part.

        Cuts lines apart (a line feed between non-spaces is a pre-token) and a mark
        from the letters before it; whatever else there is stays together.
        """
        if "\n" not in part:
            if part[-1] in self.MARKS and part[:-1].isalpha():
                return [(True, part[:-1]), (False, part[-1])]
            return [(True, part)]
        lines = part.split("\n")
        if not all(lines) or any(self.space.search(x) for x in lines):
            return [(True, part)]
        out: list[tuple[bool, str]] = []
        for k, line in enumerate(lines):
            if k:
                out.append((False, "\n"))
            if line[-1] in self.MARKS and line[:-1].isalpha():
                out += [(k == 0, line[:-1]), (False, line[-1])]
            else:
                out.append((k == 0, line))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > self.LIMIT:
            self.known, self.older = {}, self.known
        if len(self.heads) > self.LIMIT:
            self.heads = {"": b""}
        known, older, heads = self.known, self.older, self.heads
        out: list[bytes | None] = []
        waiting: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        missing: dict[tuple[bool, str], None] = {}
        composed: dict[str, list[tuple[bool, str]]] = {}

        def want(spaced: bool, piece: str) -> None:
            if spaced and piece in older:
                known[piece] = older[piece]
            elif piece not in (known if spaced else heads):
                missing[spaced, piece] = None

        for i, text in enumerate(texts):
            own = text.split(" ")
            got = list(map(known.get, own))
            got[0] = heads.get(own[0])
            if None not in got:
                out.append(b"".join(got))
                continue
            out.append(None)
            lost = [p for p, g in zip(own[1:], got[1:], strict=True) if g is None]
            if not all(lost) or any(p[0].isspace() for p in lost):
                whole.append(i)  # a space here doesn't begin a pre-token
                continue
            waiting.append((i, own))
            want(False, own[0])
            for p in lost:
                if p in older:
                    known[p] = older[p]
                elif p not in composed:
                    pieces = self._pieces(p)
                    if len(pieces) > 1:
                        composed[p] = pieces
                    for spaced, piece in pieces:
                        want(spaced, piece)
        if missing:
            inner, first = [p for spaced, p in missing if spaced], [p for spaced, p in missing if not spaced]
            known.update(zip(inner, self._spaced(inner), strict=True))
            heads.update(zip(first, self._library(first) if first else [], strict=True))
        for p, pieces in composed.items():
            known[p] = b"".join([known[x] if spaced else heads[x] for spaced, x in pieces])
        for i, own in waiting:
            out[i] = b"".join([heads[own[0]], *map(known.__getitem__, own[1:])])
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        return out


_LOADED: dict[int, Tokenizer] = {}


def _tokenizer(raw: bytes) -> Tokenizer:
    key = zlib.crc32(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(raw)
    return _LOADED[key]


SHARD_SCHEMA = "part int, seq int, n_ids long, n_docs long, data binary"
DOC_SCHEMA = "part int, seq int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def write_shards(spark: SparkSession, docs: DataFrame, vocab_path: str, path: str, end_id: int = 0) -> None:
    """Tokenise whole texts and write shards in ascending doc_id order under ``path``.

    Null texts are empty; ``end_id`` ends each document. Rows with equal doc_id are
    ordered by their text; a null doc_id comes first. The order over shards is
    (part, seq). Memory of a task is bounded by a shard, not by its partition.
    """
    io.ship(spark)
    with open(vocab_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, seq = _tokenizer(shared.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        held: list[bytes] = []
        keys: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            data = encode(ids, np.array([k or 0 for k in keys], dtype=np.int64), np.array([k is not None for k in keys]), np.array([len(h) // 4 for h in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "seq", "n_ids", "n_docs", "data"],
            )

        gc.disable()  # nothing here forms cycles, and the lookup tables are large
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    piece = batch.slice(at, 512)
                    for key, ids in zip(piece.column(0).to_pylist(), tok.encode([x or "" for x in piece.column(1).to_pylist()]), strict=True):
                        held.append(ids + end)
                        keys.append(key)
                        size += len(ids) // 4 + 1
                        if size >= SHARD_IDS:
                            yield shard()
                            held, keys, size, seq = [], [], 0, seq + 1
            if keys:
                yield shard()
        finally:
            gc.enable()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decode the shards under ``path``: per document its start, length and checksum."""
    io.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, data = (batch.column(k)[row].as_py() for k in range(3))
                shard = Shard(data)
                raw, n = memoryview(shard.ids().astype("<u4").tobytes()), shard.n_docs
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)),
                        pa.array(shard.doc_ids, mask=~shard.doc_valid), pa.array(starts), pa.array(shard.lengths), pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    decoded = shards.select("part", "seq", "data").mapInArrow(run, DOC_SCHEMA)
    sizes = shards.select("part", "seq", "n_ids")
    # one row a part, then one row a shard within its part: no window sees all shards
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    within = sizes.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("shard_start"))
    starts = within.join(before, "part").select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base"))
    return decoded.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(spark: SparkSession, docs: DataFrame, vocab_path: str, end_id: int = 0) -> DataFrame:
    """Write shards to the shared folder and return what reading them back gives."""
    path = io.new_path(spark, "shards")
    write_shards(spark, docs, vocab_path, path, end_id)
    return read_documents(spark, path)
