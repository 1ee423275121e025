"""LM scoring by cross-entropy difference.

Two word bigram models of the same form, one of the target texts and one of all texts,
share the vocabulary of all texts. A document's score is the mean over its words of
target loss minus background loss, in bits; the lower, the more it looks like the target.
Every document is left out of the models that score it, so what a text is the only one to
hold doesn't count as known.

Form of both models, with counts c of one of them, C of the background and N, M their
words; V is the number of different words of all texts:

    base(w)    = (C(w) + 1/2) / (M + (V + 1) / 2)
    one(w)     = SHARE * c(w) / N + (1 - SHARE) * base(w)
    two(w | h) = (c(h w) + PRIOR * one(w)) / (c(h) + PRIOR)

Counts of all words and bigrams grow with the corpus and are never gathered in one place.
Documents are dealt to groups of bounded size. A group's different grams, sorted by hash
and cut into ranges, go to the ranges' tasks, which add them up over all groups and send
back the totals in the same order; the group then scores its documents. So a gram that is
frequent travels once a group, and no key is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import io
from quillmark.llm.textkit import ASCII_LOWER, mix64, segment_hash, slices, string_buffers, words

#: Weight of a model's own word shares, and words that the word shares count for in a context.
SHARE, PRIOR = 0.9, 2.0
#: Bytes of text of a group (about).
GROUP_BYTES = 8_000_000
U64 = np.uint64
#: Grams are named by 48 bits of their hash; the lowest says whether it is a word.
KEY_BITS = 48
_BEGIN = U64(0x6A09E667F3BCC908)


def _key(h: np.ndarray, word: int) -> np.ndarray:
    return (h >> U64(65 - KEY_BITS)) << U64(1) | U64(word)


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key of the word, key of the bigram that it ends) of every word; the
    first word of a text follows a mark of its own."""
    doc, one, two = [], [], []
    for a, b in slices(offsets):
        lowered = ASCII_LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, at = words(lowered, offsets[a : b + 1] - offsets[a])
        h = segment_hash(lowered, starts, ends)
        before = np.empty(len(h), U64)
        before[:1] = _BEGIN
        before[1:] = np.where(at[1:] == at[:-1], h[:-1], _BEGIN)
        doc.append(at + a)
        one.append(_key(h, 1))
        two.append(_key(mix64(before * U64(0x9E3779B97F4A7C15) ^ mix64(h)), 0))
    if not doc:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    return np.concatenate(doc), np.concatenate(one), np.concatenate(two)


_BEGIN_KEY = _key(np.array([_BEGIN]), 0)


class Group:
    """The grams of one group of documents: ``keys`` are all different ones, sorted."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        data, offsets = string_buffers(column)
        self.n_docs = len(offsets) - 1
        self.doc, one, two = gram_keys(data, offsets)
        n = len(one)
        self.keys, at = np.unique(np.concatenate([one, two, _BEGIN_KEY]), return_inverse=True)
        self.word, self.pair, self.begin = at[:n], at[n : 2 * n], at[-1]
        self.opens = np.append(True, self.doc[1:] != self.doc[:-1]) if n else np.zeros(0, bool)

    def counts(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs in the documents ``wanted`` (all if None)."""
        pick = slice(None) if wanted is None else wanted[self.doc]
        out = np.bincount(self.word[pick], minlength=len(self.keys)) + np.bincount(self.pair[pick], minlength=len(self.keys))
        out[self.begin] += int(self.opens[pick].sum())
        return out

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word, and each word's bigram, occurs in the word's own document."""
        size, n = len(self.keys), len(self.doc)
        code = np.concatenate([self.doc, self.doc]) * size + np.concatenate([self.word, self.pair])
        _, at, times = np.unique(code, return_inverse=True, return_counts=True)
        return times[at[:n]], times[at[n:]]


def _packed(x: np.ndarray, width: int) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def losses(group: Group, c_all: np.ndarray, c_target: np.ndarray, sizes: tuple[int, int, int], is_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target bits, background bits) of each word, its document left out of both.

    ``sizes``: words of all texts, words of the target, different words.
    """
    n_all, n_target, kinds = sizes
    own_word, own_pair = group.own()
    own_size = np.bincount(group.doc, minlength=group.n_docs)[group.doc]
    before = np.where(group.opens, group.begin, np.append(0, group.word[:-1])) if len(group.word) else group.word
    own_before = np.where(group.opens, 1, np.append(0, own_word[:-1])) if len(group.word) else own_word
    base = (c_all[group.word] - own_word + 0.5) / (n_all - own_size + (kinds + 1) / 2)
    out = []
    for c, n, left in ((c_target, n_target, is_target[group.doc].astype(np.int64)), (c_all, n_all, np.ones(len(group.doc), np.int64))):
        words_, seen = n - left * own_size, c[group.word] - left * own_word
        share = np.divide(seen, words_, out=np.zeros(len(seen)), where=words_ > 0)
        one = SHARE * share + (1 - SHARE) * base
        two = (c[group.pair] - left * own_pair + PRIOR * one) / (c[before] - left * own_before + PRIOR)
        out.append(-np.log2(two))
    return out[0], out[1]


def score(spark: SparkSession, docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, score) of every row.

    ``target_ids`` (doc_id) names the target texts. Null, empty and wordless texts have
    no tokens and null losses. Repeated rows count and score each, so one is known by the
    other. Rows without a doc_id are never targets. Without any target text the target's
    word shares are a tenth of the background's for every word.
    """
    io.ship(spark)
    rows = docs.select("doc_id", "text")
    ids = target_ids.filter("doc_id is not null").select("doc_id").distinct()
    maybe, others = io.parted(rows, ids)
    marked = maybe.join(ids.withColumn("__t", F.lit(True)), "doc_id", "left").select(*rows.columns, F.col("__t").isNotNull().alias("target"))
    marked = marked.union(others.withColumn("target", F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, -(-size // GROUP_BYTES))
    ranges = min(n_groups, 1 << 15)
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).alias("g")
    grouped = marked.select(group, "doc_id", "text", "target").repartition(n_groups, "g")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        own = Group(table.column("text"))
        every, target = own.counts(), own.counts(np.asarray(table.column("target").combine_chunks()).astype(bool))
        cuts = np.searchsorted(own.keys, (np.arange(ranges + 1, dtype=np.uint64) << U64(KEY_BITS)) // U64(ranges))
        cuts[-1] = len(own.keys)
        out = []
        for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            gaps = np.diff(own.keys[a:b], prepend=U64(0))
            out.append((key[0].as_py(), r, b - a, _packed(gaps, 6), _packed(every[a:b], 4), _packed(target[a:b], 4)))
        return pa.Table.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["g", "r", "n", "keys", "every", "target"]).cast(sent)

    sent = pa.schema([("g", pa.int64()), ("r", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("every", pa.binary()), ("target", pa.binary())])
    grams = grouped.groupBy("g").applyInArrow(count, "g long, r int, n int, keys binary, every binary, target binary")

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_unpacked(x, k, 6)) for x, k in zip(table.column("keys").to_pylist(), n, strict=True)])
        every, target = (np.concatenate([_unpacked(x, k, 4) for x, k in zip(table.column(c).to_pylist(), n, strict=True)]) for c in ("every", "target"))
        names, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, x, len(names)).astype(np.int64) for x in (every, target)]
        word = (names & U64(1)).astype(bool)
        totals = [int(sums[0][word].sum()), int(sums[1][word].sum()), int(word.sum())]
        ends = np.cumsum(n)
        packed = [[_packed(s[at[b - k : b]], 5) for k, b in zip(n, ends.tolist(), strict=True)] for s in sums]
        return pa.Table.from_arrays(
            [table.column("g"), table.column("r"), table.column("n"), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), *(pa.array([x] * len(n), pa.int64()) for x in totals)],
            names=["g", "r", "n", "every", "target", "words", "target_words", "kinds"],
        )

    found = grams.groupBy("r").applyInArrow(add, "g long, r int, n int, every binary, target binary, words long, target_words long, kinds long")
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
        + [T.StructField(x, T.DoubleType()) for x in ("target_bits", "background_bits", "score")]
    )

    def finish(table: pa.Table, totals: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([table.column("doc_id"), pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 3], names=schema.names)
        own = Group(table.column("text"))
        totals = totals.sort_by("r")
        n = totals.column("n").to_pylist()
        every, target = (np.concatenate([_unpacked(x, k, 5) for x, k in zip(totals.column(c).to_pylist(), n, strict=True)]).astype(np.int64) for c in ("every", "target"))
        sizes = tuple(sum(totals.column(c).to_pylist()) for c in ("words", "target_words", "kinds"))
        near, far = losses(own, every, target, sizes, np.asarray(table.column("target").combine_chunks()).astype(bool))
        tokens = np.bincount(own.doc, minlength=own.n_docs)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, b = (np.bincount(own.doc, x, own.n_docs) / tokens for x in (near, far))
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(tokens.astype(np.int64)), *(pa.array(x, from_pandas=True) for x in (t, b, t - b))], names=schema.names)

    return grouped.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(finish, schema)
