"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts. A byte that its longest seen
context predicts costs -log2(n / (N + q)); otherwise the escape costs -log2(q / (N + q))
and the next shorter context is asked (N symbols and q different ones were seen there);
below order 0 all 256 bytes are alike. With frozen statistics the cost of a byte depends
on its last ``ORDER`` bytes only, so the trees flatten into tables from grams to one
cost a language, and a text's exact code length is a sum of table entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import io
from quillmark.llm.textkit import slices, string_buffers

#: Bytes of context.
ORDER = 3
#: Documents a language that the trees are fitted on (expected number; chosen by hash).
MAX_TRAIN_DOCS = 1500
#: Bytes of text that are predicted at a time; each takes some 100 bytes of arrays.
PREDICT_BYTES = 250_000
_WORD = np.uint32

#: Letters in lower case stay; every other ASCII byte reads as a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not (65 <= i < 91 or 97 <= i < 123)]] = 32


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Folded texts with ORDER spaces before each; position of each text's first byte."""
    raw = _FOLD[data].tobytes()
    pad = b" " * ORDER
    at = offsets.tolist()
    joined = pad.join([b"", *(raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))])
    return joined, offsets[:-1] + ORDER * np.arange(1, len(offsets))


def _grams(joined: bytes) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at each byte from position ORDER on."""
    n = len(joined) - ORDER
    return np.ndarray((max(n, 0),), dtype=">u4", buffer=joined, strides=(1,)).astype(_WORD)


class Index:
    """Position of 32-bit keys in a table, by two levels of direct slots.

    Keys that find both of their slots taken are looked up by binary search.
    """

    def __init__(self, keys: np.ndarray, bits: int = 21):
        self.keys = np.append(keys.astype(_WORD), _WORD(0))
        self.levels = []
        rest = np.arange(len(keys))
        for factor in (2654435761, 2246822519):
            shift = np.uint32(32 - bits)
            slot = (keys[rest].astype(_WORD) * _WORD(factor)) >> shift
            table = np.full(1 << bits, len(keys), dtype=np.int32)
            table[slot[::-1]] = rest[::-1]
            self.levels.append((_WORD(factor), shift, table))
            rest = rest[table[slot] != rest]
        self.rest = rest[np.argsort(keys[rest], kind="stable")]
        self.rest_keys = keys[self.rest].astype(_WORD)

    def find(self, query: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        n = len(self.keys) - 1
        factor, shift, table = self.levels[0]
        at = table.take((query * factor) >> shift)
        lost = np.flatnonzero((self.keys.take(at) != query) | (at == n))
        if len(lost):
            factor, shift, table = self.levels[1]
            q = query[lost]
            second = table.take((q * factor) >> shift)
            bad = (self.keys.take(second) != q) | (second == n)
            second[bad] = -1
            if len(self.rest) and bad.any():
                where = np.flatnonzero(bad)
                pos = np.minimum(np.searchsorted(self.rest_keys, q[where]), len(self.rest) - 1)
                hit = self.rest_keys[pos] == q[where]
                second[where[hit]] = self.rest[pos[hit]]
            at[lost] = second
        return at


class Trees:
    """The context trees of all languages, flattened."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray):
        """From counts of (ORDER + 1)-grams per language."""
        self.langs = langs
        n_langs = len(langs)
        below = np.full((0, n_langs), 0.0)
        self.grams: list[tuple[Index, np.ndarray]] = []
        self.escapes: list[tuple[Index, np.ndarray]] = []
        self.flat = -math.log2(1 / 256)
        for order in range(ORDER + 1):
            mask = _WORD((1 << 8 * (order + 1)) - 1)
            sym = key & mask
            keys, at = np.unique(sym, return_inverse=True)
            n = np.zeros((len(keys), n_langs))
            np.add.at(n, (at, lang), count)
            ctx = keys >> _WORD(8)
            ctxs, first = np.unique(ctx, return_inverse=True)
            total, kinds = np.zeros((len(ctxs), n_langs)), np.zeros((len(ctxs), n_langs))
            np.add.at(total, first, n)
            np.add.at(kinds, first, (n > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(n / (total + kinds)[first])
            if order == 0:
                shorter = np.full((len(keys), n_langs), self.flat)
            else:
                shorter = below[self.grams[-1][0].find(keys & _WORD((1 << 8 * order) - 1))]
            cost = np.where(n > 0, own, escape[first] + shorter)
            self.grams.append((Index(keys, 21 if order == ORDER else 16), cost))
            self.escapes.append((Index(ctxs, 18), escape))
            below = cost

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram, for each language."""
        index, cost = self.grams[ORDER]
        at = index.find(grams)
        out = cost[at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            out[lost] = 0.0
        for order in range(ORDER, -1, -1):
            if not len(lost):
                return out
            index, cost = self.grams[order]
            sub = grams[lost] & _WORD((1 << 8 * (order + 1)) - 1)
            at = index.find(sub)
            seen = at >= 0
            out[lost[seen]] += cost[at[seen]]
            lost, sub = lost[~seen], sub[~seen]
            index, escape = self.escapes[order]
            at = index.find(sub >> _WORD(8))
            known = at >= 0
            out[lost[known]] += escape[at[known]]
        out[lost] += self.flat
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        joined, starts = _padded(data, offsets)
        per_byte = self.costs(_grams(joined))
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.langs)))
        full = np.flatnonzero(sizes > 0)
        if len(full):
            edges = np.empty(2 * len(full), dtype=np.int64)
            edges[0::2] = starts[full] - ORDER
            edges[1::2] = edges[0::2] + sizes[full]
            edges = np.minimum(edges, len(per_byte))
            padded = np.concatenate([per_byte, np.zeros((1, per_byte.shape[1]))])
            out[full] = np.add.reduceat(padded, edges, axis=0)[0::2]
        return out


def fit(spark: SparkSession, docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS) -> Trees | None:
    """Trees from rows with non-null text and language; None if there are none.

    At most about ``max_docs`` rows a language, those of the smallest hash of ``key``,
    so what the driver gathers is bounded whatever the size of ``docs``.
    """
    io.ship(spark)
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, max_docs / sizes[name]))]), F.col(lang))
    sample = usable.filter(draw < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                part, base = offsets[a : b + 1], offsets[a]
                joined, starts = _padded(data[base : part[-1]], part - base)
                grams = _grams(joined)
                for name in set(names[a:b]):
                    pieces = [grams[s - ORDER : s - ORDER + n] for s, n, x in zip(starts, np.diff(part), names[a:b], strict=True) if x == name and n]
                    if pieces:
                        keys, n = np.unique(np.concatenate(pieces), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"]
                        )

    counts = sample.mapInArrow(io.lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    where = {name: i for i, name in enumerate(langs)}
    lang_at = np.array([where[x] for x in counts.column("lang").to_pylist()])
    order = np.lexsort((counts.column("gram").to_numpy(), lang_at))
    return Trees(langs, lang_at[order], counts.column("gram").to_numpy().astype(_WORD)[order], counts.column("n").to_numpy()[order].astype(float))


PREDICTED = "lang_pred string, score double, bits_per_byte double"


def predict(spark: SparkSession, docs: DataFrame, trees: Trees | Broadcast | None, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (shortest code; ties to the first name), ``score`` and
    ``bits_per_byte`` to the columns ``keep`` of every row.

    ``score`` is the posterior of the language with equal priors: 1 / sum of
    2^(shortest - length); ``trees`` may be a broadcast of them. ``und`` with score 0 stands for null, empty and letterless
    texts, and for all texts if nothing could be learned.
    """
    io.ship(spark)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    shared = trees if isinstance(trees, Broadcast) else spark.sparkContext.broadcast(trees)
    kept, n_kept = list(keep), len(keep)
    own = [] if text in kept else [F.col(text).alias("__text")]  # a text that is kept travels once
    at_text = kept.index(text) if text in kept else n_kept
    at_lettered = n_kept + len(own)
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[k] for k in kept] + T._parse_datatype_string(PREDICTED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trees | None = shared.value
        for batch in batches:
            data, offsets = string_buffers(batch.column(at_text))
            has = np.asarray(batch.column(at_lettered))
            for a, b in slices(offsets, PREDICT_BYTES):
                n = b - a
                pred, score, rate = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n)
                ok = has[a:b].astype(bool)
                if model is not None and ok.any():
                    part = offsets[a : b + 1] - offsets[a]
                    bits = model.code_lengths(data[offsets[a] : offsets[b]], part)
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(n), best]
                    pred = np.where(ok, np.array(model.langs, dtype=object)[best], "und")
                    score = np.where(ok, 1 / np.exp2(low[:, None] - bits).sum(axis=1), 0.0)
                    rate = np.where(ok, low / np.maximum(np.diff(part), 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, n) for k in range(n_kept)), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                    names=[*kept, "lang_pred", "score", "bits_per_byte"],
                )

    return docs.select(*kept, *own, lettered.alias("__lettered")).mapInArrow(io.lean(run), schema)


def fold_of(key: str = "doc_id") -> F.Column:
    """crc32 of the key as text, modulo 5 (a null key as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(5))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn on folds 1 to 4 and predict every row; see the contract of the query."""
    trees = fit(spark, docs.filter(fold_of() != 0))
    marked = docs.select("doc_id", "text", (fold_of() == 0).alias("held_out"))
    return predict(spark, marked, trees, keep=("doc_id", "held_out"))
