"""Quality rules with an n-gram perplexity band.

Base counts per text, and modified Kneser-Ney models of the bytes of every language, read
in lower case with digits as 0 and any white space as a blank, so that neither capitals
nor the numbers of a table raise a text's perplexity by themselves. Texts are dealt to FOLDS by their content, copies to the
same one; a fold's model counts all texts of the other folds, so no text is scored by a
model that knows it. Spark counts the n-grams and derives continuation counts level by
level; a model is sorted hash arrays of grams and of contexts. Models go to executors in
passes of at most about MODEL_GRAMS entries; a model that is larger is cut by the last
byte of the context, so that a position needs one part only and a text's bits are the sum
over parts. A text is rejected when its perplexity per word leaves the band of its
language, which comes from the quartiles of its texts that pass the base rules, exact
copies counted once. The band narrows with the root of the number of words, up to WIDEST
words, as means over few words scatter more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import io
from quillmark.llm.textkit import IS_SEP, mix64, segment_hash, slices, string_buffers, window_hash, words

ORDER, FOLDS = 5, 2
#: Entries of the models that a pass sends to executors (about 40 bytes each).
MODEL_GRAMS = 3_000_000
#: Width of the band in interquartile ranges of log2 perplexity, above and below.
UPPER_IQR, LOWER_IQR = 3.0, 3.0
#: Quartiles are those of values rounded down to 1 / STEPS bit.
STEPS = 1024
#: Words from which on a band doesn't narrow any more.
WIDEST = 200
#: Parts that the texts of a language are dealt to for a join by language.
SALTS = 64
WINDOW = 8
U64 = np.uint64

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
#: How a byte is read: white space as a blank, A-Z in lower case, digits as 0.
_READ = np.arange(256, dtype=np.uint64)
_READ[IS_SEP] = 32
_READ[65:91] += U64(32)
_READ[48:58] = 48


def _low(order: int) -> U64:
    """Mask of the last ``order`` bytes."""
    return U64((1 << 8 * order) - 1)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram ending at each byte (texts begin after blanks) and where texts start."""
    sizes = np.diff(offsets)
    pad = ORDER - 1
    starts = offsets[:-1] + pad * np.arange(1, len(offsets))
    read = np.full(len(data) + pad * len(sizes), 32, dtype=np.uint64)
    read[np.arange(len(data)) + pad * np.repeat(np.arange(1, len(offsets)), sizes)] = _READ[data]
    gram = read.copy()
    for k in range(1, ORDER):
        gram[k:] |= read[:-k] << U64(8 * k)
    return gram, starts


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), dtype=values.dtype)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        edges = np.empty(2 * len(full), dtype=np.int64)
        edges[0::2], edges[1::2] = starts[full], starts[full] + sizes[full]
        out[full] = np.add.reduceat(np.append(values, values.dtype.type(0)), edges)[0::2]
    return out


class Hashed:
    """Values by key: arrays sorted by the keys' hash, and where each range of hashes begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(mix64(keys))
        self.hashes, self.values = mix64(keys[order]), values[order]
        self.index: tuple[U64, np.ndarray, int] | None = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if self.index is None:  # built where it is used: the arrays alone travel
            bits = max(4, len(self.hashes).bit_length() + 1)
            shift = U64(64 - bits)
            begin = np.searchsorted(self.hashes >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            self.index = shift, begin, int(np.diff(begin).max(initial=0))
            self.hashes = np.append(self.hashes, U64(0))
        shift, begin, most = self.index
        h = mix64(keys)
        at = begin.take((h >> shift).astype(np.int64))
        out = np.where((self.hashes.take(at) == h) & (at < len(self.hashes) - 1), at, -1)
        for step in range(1, most):
            lost = np.flatnonzero(out < 0)
            if not len(lost):
                break
            nxt = np.minimum(at[lost] + step, len(self.hashes) - 1)
            hit = (self.hashes.take(nxt) == h[lost]) & (nxt < len(self.hashes) - 1)
            out[lost[hit]] = nxt[hit]
        return out


def discounts(kinds: dict[int, int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from the counts of counts."""
    n = [float(kinds.get(r, 0)) for r in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    cut = [0.0]
    for r in (1, 2, 3):
        d = r - (r + 1) * y * n[r] / n[r - 1] if n[r - 1] else 0.5 * r
        cut.append(min(max(d, 0.05), r - 0.05))
    return np.array(cut)


def _interpolated(grams: np.ndarray, counts: np.ndarray, cut: np.ndarray, lower: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each gram, its contexts, weight of the shorter context in each)."""
    contexts, at = np.unique(grams >> U64(8), return_inverse=True)
    off = cut[np.minimum(counts, 3).astype(np.int64)]
    total = np.bincount(at, counts, len(contexts))
    spare = np.bincount(at, off, len(contexts)) / total
    return (counts - off) / total[at] + spare[at] * lower, contexts, spare


class Model:
    """Interpolated modified Kneser-Ney over one model's counts, or over the part of them
    whose contexts end in the given bytes."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], cuts: dict[int, np.ndarray], parts: np.ndarray | None = None):
        """``levels``: (grams, counts) by order, those of order 1 of all contexts."""
        one = np.zeros(256)
        grams, counts = levels[1]
        prob, _, spare = _interpolated(grams, counts.astype(float), cuts[1], 1 / 256)
        one[:] = spare[0] / 256
        one[grams.astype(np.int64)] = prob
        self.single = (-np.log2(one)).astype(np.float32)
        self.parts = np.ones(256, bool) if parts is None else parts
        self.grams: dict[int, Hashed] = {}
        self.spare: dict[int, Hashed] = {}
        below, below_prob = np.arange(256, dtype=np.uint64), one
        for n in range(2, ORDER + 1):
            grams, counts = levels[n]
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order].astype(float)
            lower = below_prob[np.searchsorted(below, grams & _low(n - 1))]
            prob, contexts, spare = _interpolated(grams, counts, cuts[n], lower)
            self.grams[n] = Hashed(grams, (-np.log2(prob)).astype(np.float32))
            self.spare[n] = Hashed(contexts, (-np.log2(spare)).astype(np.float32))
            below, below_prob = grams, prob

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram; 0 where this part doesn't know its context."""
        out = np.zeros(len(grams), np.float32)
        left = np.flatnonzero(self.parts[((grams >> U64(8)) & U64(255)).astype(np.int64)])
        for n in range(ORDER, 1, -1):
            own = grams[left] & _low(n)
            at = self.grams[n].find(own)
            seen = at >= 0
            out[left[seen]] += self.grams[n].values[at[seen]]
            left, own = left[~seen], own[~seen]
            if not len(left):
                return out
            at = self.spare[n].find(own >> U64(8))
            known = at >= 0
            out[left[known]] += self.spare[n].values[at[known]]
        out[left] += self.single[(grams[left] & U64(255)).astype(np.int64)]
        return out


COUNTS = "lang string, fold int, gram long, n long"


def with_folds(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, fold, text); a null language is ``und``, copies share a fold."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("text"), F.lit(""))), F.lit(FOLDS)).cast("int")
    return docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), fold.alias("fold"), "text")


def _by_model(names: np.ndarray, folds: np.ndarray) -> list[tuple[tuple[str, int], np.ndarray]]:
    keys = sorted(set(zip(names.tolist(), folds.tolist(), strict=True)))
    return [(k, np.flatnonzero((names == k[0]) & (folds == k[1]))) for k in keys]


def count_grams(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts of byte n-grams by language and fold over all texts (lang, fold, gram, n)."""
    io.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            names, folds = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            data, offsets = string_buffers(batch.column(2))
            for a, b in slices(offsets):
                part = offsets[a : b + 1] - offsets[a]
                grams, starts = _grams(data[offsets[a] : offsets[b]], part)
                sizes = np.diff(part)
                for key, rows in _by_model(names[a:b], folds[a:b]):
                    pick = [grams[s : s + n] for s, n in zip(starts[rows].tolist(), sizes[rows].tolist(), strict=True) if n]
                    if pick:
                        own = held.setdefault(key, [])
                        own.append(np.unique(np.concatenate(pick), return_counts=True))
                        if len(own) == 16:
                            held[key] = [merged(own)]
        for (name, fold), parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(np.full(len(keys), fold, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "fold", "gram", "n"]
            )

    rows = docs.select("lang", "fold", "text").filter("text is not null").mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def count_levels(counts: DataFrame) -> DataFrame:
    """(lang, fold, order, gram, n): ``counts`` and below them continuation counts, in how
    many ways one more byte can stand before; ``fold`` is the one that is left out."""
    pairs = F.explode(F.array(*[F.lit(k) for k in range(FOLDS)])).alias("out")
    others = counts.select("lang", pairs, "fold", "gram", "n").filter("out <> fold")
    level = io.staged(others.groupBy("lang", F.col("out").alias("fold"), "gram").agg(F.sum("n").alias("n")), "kn_counts")
    out = level.withColumn("order", F.lit(ORDER))
    for order in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
        level = io.staged(level.groupBy("lang", "fold", low.alias("gram")).agg(F.count("*").alias("n")), "kn_counts")
        out = out.union(level.withColumn("order", F.lit(order)))
    return out


def passes(sizes: list[tuple[str, int, int, int]], most: int) -> list[dict[tuple[str, int], list[int]]]:
    """Models to load together, each with the last context bytes that it serves: entries
    (lang, fold, byte, size) in turn, a new pass where ``most`` would be passed."""
    out: list[dict[tuple[str, int], list[int]]] = [{}]
    used = 0
    for lang, fold, byte, size in sorted(sizes):
        if used and used + size > most:
            out.append({})
            used = 0
        out[-1].setdefault((lang, fold), []).append(byte)
        used += size
    return out


def fit(spark: SparkSession, docs: DataFrame) -> Iterator[dict[tuple[str, int], Model]]:
    """The models by (language, fold left out), pass by pass. What the driver gathers at a
    time is a pass; a fold left out that has no other texts has no model."""
    levels = count_levels(io.staged(count_grams(spark, docs), "kn_grams"))
    kinds: dict[tuple, dict[int, int]] = {}
    for lang, fold, order, r, n in levels.groupBy("lang", "fold", "order", F.least("n", F.lit(5)).alias("r")).count().collect():
        kinds.setdefault((lang, fold, order), {})[r] = n
    singles: dict[tuple, list[tuple[int, int]]] = {}
    for lang, fold, gram, n in levels.filter("order = 1").select("lang", "fold", "gram", "n").collect():  # 256 a model
        singles.setdefault((lang, fold), []).append((gram, n))
    byte = F.shiftright("gram", 8).bitwiseAND(F.lit(255)).cast("int")
    upper = levels.filter("order > 1").withColumn("byte", byte)
    sizes = [(r[0], r[1], r[2], r[3]) for r in upper.groupBy("lang", "fold", "byte").count().collect()]  # 256 a model
    plan = passes(sizes, MODEL_GRAMS)
    for part in plan:
        rows = upper
        if len(plan) > 1:
            mine = [(lang, fold, b) for (lang, fold), bytes_ in part.items() for b in bytes_]
            rows = upper.join(F.broadcast(spark.createDataFrame(mine, "lang string, fold int, byte int")), ["lang", "fold", "byte"])  # at most 256 rows a model
        got = rows.select("lang", "fold", "order", "gram", "n").toArrow() if part else None
        models = {}
        for key, bytes_ in part.items():
            own = got.filter((pc.field("lang") == key[0]) & (pc.field("fold") == key[1]))
            order, gram, n = (own.column(c).to_numpy() for c in ("order", "gram", "n"))
            known = {k: (gram[order == k].astype(np.uint64), n[order == k]) for k in range(2, ORDER + 1)}
            single = np.array(sorted(singles[key]))
            known[1] = single[:, 0].astype(np.uint64), single[:, 1]
            mask = np.zeros(256, bool)
            mask[bytes_] = True
            # a context that nothing ended in is nobody's: the first part takes it
            mask |= ~np.isin(np.arange(256), [b for lang, fold, b, _ in sizes if (lang, fold) == key]) & (min(bytes_) == min(b for lang, fold, b, _ in sizes if (lang, fold) == key))
            models[key] = Model(known, {k: discounts(kinds.get((*key, k), {})) for k in range(1, ORDER + 1)}, mask)
        yield models


METRICS = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")]
    + [T.StructField("bits", T.DoubleType())]
)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts, ends, doc = words(data, offsets)
    n_words = np.bincount(doc, minlength=n)
    chars = _sums((~(IS_SEP | _CONTINUES)[data]).astype(np.int64), offsets[:-1], sizes)
    symbols = _sums(_SYMBOL[data].astype(np.int64), offsets[:-1], sizes)
    hashes = segment_hash(data, starts, ends)
    repeat = np.zeros(n, dtype=np.int64)
    if len(hashes) >= WINDOW:
        same = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        win = window_hash(hashes, WINDOW)[same] + doc[same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, at, seen = np.unique(win, return_inverse=True, return_counts=True)
        hit = same[seen[at] > 1]
        if len(hit):
            edge = np.zeros(len(hashes) + 1, dtype=np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    # lines: between line feeds and text borders; those with a word count
    feed = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offsets[:-1][sizes > 0], feed + 1]))
    first = first[first < len(data)] if len(data) else first[:0]
    last = np.append(first[1:], len(data))
    last = np.where((last > first) & (data[last - 1] == 10), last - 1, last) if len(first) else last[:0]
    has_word = np.zeros(len(first), dtype=bool)
    if len(first) and len(starts):
        has_word[np.searchsorted(first, starts, side="right") - 1] = True
    first, last = first[has_word], last[has_word]
    line_doc = np.searchsorted(offsets, first, side="right") - 1
    key = segment_hash(data, first, last) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, once = np.unique(key, return_index=True)
    again = np.ones(len(first), dtype=bool)
    again[once] = False
    dup_lines = np.bincount(line_doc[again], minlength=n)
    return [n_words, chars, symbols, dup_lines, repeat]


def _bits(models: dict[tuple[str, int], Model], names: np.ndarray, folds: np.ndarray, grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full(len(sizes), np.nan)
    for key, rows in _by_model(names, folds):
        rows = rows[sizes[rows] > 0]
        if len(rows) and key in models:
            own = np.concatenate([grams[s : s + n] for s, n in zip(starts[rows].tolist(), sizes[rows].tolist(), strict=True)])
            out[rows] = np.add.reduceat(models[key].costs(own).astype(np.float64), np.cumsum(sizes[rows]) - sizes[rows])
    return out


def measure(spark: SparkSession, docs: DataFrame, models: dict[tuple[str, int], Model], counts: bool = True) -> DataFrame:
    """Base counts and bits of every text, of :func:`with_folds`; without ``counts`` the
    bits only, by the text's digest ``uid``. Bits are null without a model."""
    io.ship(spark)
    shared = spark.sparkContext.broadcast(models)
    first = [docs.schema["doc_id"], docs.schema["lang"]] if counts else []
    schema = T.StructType([*first, T.StructField("uid", T.StringType()), *(METRICS.fields if counts else METRICS.fields[-2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, folds = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy()
            data, offsets = string_buffers(batch.column(3))
            for a, b in slices(offsets):
                part, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                sizes = np.diff(part)
                grams, starts = _grams(raw, part)
                bits = _bits(known, names[a:b], folds[a:b], grams, starts, sizes)
                own = [pa.array(x.astype(np.int64)) for x in (*base_counts(raw, part), sizes)] if counts else [pa.array(sizes)]
                keep = [batch.column(k).slice(a, b - a) for k in ((0, 1, 4) if counts else (4,))]
                yield pa.RecordBatch.from_arrays([*keep, *own, pa.array(bits, from_pandas=True)], names=schema.names)

    uid = F.concat(F.md5(F.coalesce("text", F.lit(""))), F.col("lang"))
    return docs.select("doc_id", "lang", "fold", "text", uid.alias("uid")).mapInArrow(run, schema)


def _quantiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """(lang, q array) of the column v, from counts by bins of 1 / STEPS."""
    bins = rows.groupBy("lang", F.floor(F.col("v") * STEPS).alias("bin")).agg(F.count("*").alias("m"))
    own = W.partitionBy("lang")  # one row a bin
    upto = bins.select("lang", "bin", F.sum("m").over(own.orderBy("bin")).alias("upto"), F.sum("m").over(own).alias("all"))
    return upto.groupBy("lang").agg(F.array(*[F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / F.lit(float(STEPS)) for q in shares]).alias("q"))


def _of_language(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to a table of one row a language, dealt to SALTS parts a language."""
    salts = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    return salted.join(salts, ["lang", "__salt"], how).drop("__salt")


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Base rules and the perplexity band of every document (one row per row).

    A null language counts as ``und``. A null text has no words and fails the base
    rules. Bands use the quartiles of the documents that pass the base rules, copies (of
    equal counts and perplexity) counted once so that they can't close the band; a text
    without characters has no perplexity (null) and isn't judged by it.
    """
    folded = with_folds(docs)
    measured: DataFrame | None = None
    more: list[DataFrame] = []
    for models in fit(spark, folded):
        if measured is None:
            measured = io.staged(measure(spark, folded, models), "kn_measured")
        else:  # the same texts give the same bits: one row each
            more.append(io.staged(measure(spark, folded, models, counts=False).filter("bits is not null").dropDuplicates(["uid"]), "kn_bits"))
    if more:
        rest = reduce(DataFrame.union, more).groupBy("uid").agg(F.sum("bits").alias("more"))
        total = F.when(F.col("bits").isNotNull() | F.col("more").isNotNull(), F.coalesce("bits", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)))
        measured = measured.join(rest, "uid", "left").withColumn("bits", total)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = measured.withColumn("log2_ppl", F.when(F.col("n_words") > 0, F.col("bits") / F.col("n_words"))).withColumn("base_failed", failed)
    rows = rows.withColumn("weight", F.sqrt(F.least("n_words", F.lit(WIDEST)).cast("double")))
    passed = rows.filter("not base_failed and log2_ppl is not null").select("uid", "lang", "log2_ppl", "weight").dropDuplicates(["uid"])
    passed = io.staged(passed, "kn_passed")
    middle = _quantiles(passed.select("lang", F.col("log2_ppl").alias("v")), [0.5]).select("lang", F.col("q")[0].alias("middle"))
    apart = _of_language(passed, middle, "inner").select("lang", ((F.col("log2_ppl") - F.col("middle")) * F.col("weight")).alias("v"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1.0 / STEPS))
    bands = _quantiles(apart, [0.25, 0.5, 0.75]).join(middle, "lang").select(
        "lang", "middle", (F.col("q")[1] - LOWER_IQR * spread).alias("__low"), (F.col("q")[1] + UPPER_IQR * spread).alias("__high")
    )
    rows = _of_language(rows, bands, "left").withColumns({x: F.when(F.col("n_words") > 0, F.col("middle") + F.col(f"__{x}") / F.col("weight")) for x in ("low", "high")})
    inside = F.coalesce(F.col("log2_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), "lang", "log2_ppl", "low", "high",
    )
