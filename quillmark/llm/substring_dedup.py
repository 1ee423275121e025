"""Substring dedup by content-defined chunking with a gear hash.

A chunk ends where the gear rolling hash over the last 32 bytes is least within REACH
bytes on either side, so borders move with the content and chunks are neither tiny nor
far apart. Chunks are compared by digest; runs of chunks that follow each other both in a
text and at their first place are extended byte by byte against that place, which also
proves them equal. Passages of LEAST_SPAN bytes or more, and whole texts of any length,
are kept where they come first and cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import io
from quillmark.llm.textkit import mix64, segment_hash, slices, string_buffers

#: A border's hash is the least of so many bytes before and after it; no chunk is longer
#: than LONGEST (in texts of one repeated byte no border is found).
REACH, LONGEST = 24, 2048
#: Bytes of a repeated passage at least.
LEAST_SPAN = 96
#: Bytes on either side of a first place that a passage can be extended over; the whole
#: chunks next to it don't match, and chunks rarely have more than a few REACH.
CONTEXT = 256
_WINDOW = 32
_GEAR = np.random.default_rng(7919).integers(0, 1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


def _apart(data: np.ndarray, offsets: np.ndarray, gap: int, fill: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``gap`` fillers before each and at the end; where each byte went."""
    sizes = np.diff(offsets)
    at = np.arange(len(data)) + gap * np.repeat(np.arange(1, len(offsets)), sizes)
    out = np.full(len(data) + gap * (len(sizes) + 1), fill, dtype=kind)
    out[at] = data
    return out, at


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gear hash at each byte over the last 32 bytes of its text.

    h <- 2h + G[byte] in 32 bits forgets what lies 32 bytes back, so five doublings of
    the reach give it for all positions; each text starts from zeros.
    """
    h, at = _apart(_GEAR[data], offsets, _WINDOW, 0, np.uint32)
    for k in range(5):
        reach = 1 << k
        h[reach:] += h[:-reach] << np.uint32(reach)
    return h[at]


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of x over each of the windows of ``size``."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def byte_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of every chunk of a slice."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    # finalised, so that the low values of common bytes aren't favoured
    order = mix64(gear(data, offsets).astype(np.uint64)) >> np.uint64(1)
    spread, at = _apart(order, offsets, REACH, (1 << 63) - 1, np.uint64)
    low = _least(spread, REACH)
    cut = (spread[at] < low[at - REACH]) & (spread[at] < low[at + 1])
    inside = (data & 0xC0) == 0x80  # never between the bytes of a character
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:] = cut
    edge[:-1] &= ~inside
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    gaps = np.diff(edges)
    if len(gaps) and gaps.max() > LONGEST:
        more = [np.arange(edges[i] + LONGEST, edges[i + 1], LONGEST) for i in np.flatnonzero(gaps > LONGEST)]
        more = np.concatenate(more)
        for _ in range(3):
            more -= inside[more]
        edges = np.unique(np.concatenate([edges, more]))
    starts, ends = edges[:-1], edges[1:]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


CHUNKS = "doc_id long, start int, end int, digest long"


def chunk_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every chunk of every document with a doc_id, and one more for each whole text of
    several chunks; ``docs`` holds doc_id and text."""
    io.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                part, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                doc, start, end = byte_chunks(raw, part)
                digest = segment_hash(raw, start, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][doc]), pa.array((start - part[doc]).astype(np.int32)), pa.array((end - part[doc]).astype(np.int32)), pa.array(digest.view(np.int64))],
                    names=["doc_id", "start", "end", "digest"],
                )

    return docs.mapInArrow(run, CHUNKS)


FIRST = ["first_doc", "first_start", "first_end"]


def chunk_copies(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, end, first_doc, first_start, first_end) of the runs of chunks that
    don't come first: neighbours in a text whose first places are neighbours as well."""
    place = F.struct("doc_id", "start", "end")
    seen = chunks.groupBy("digest").agg(F.min(place).alias("canon"), F.max(place).alias("last")).filter("canon <> last").select("digest", "canon")
    hits = chunks.join(seen, "digest").filter(place != F.col("canon")).select("doc_id", "start", "end", "canon").distinct()
    own = W.partitionBy("doc_id").orderBy("start", "end")
    back = [F.lag(c).over(own) for c in ("end", "canon.doc_id", "canon.end")]
    goes_on = (back[0] == F.col("start")) & (back[1] == F.col("canon.doc_id")) & (back[2] == F.col("canon.start"))
    run = F.sum(F.when(goes_on, 0).otherwise(1)).over(own)
    return hits.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("canon.doc_id").alias("first_doc"), F.min("canon.start").alias("first_start"), F.max("canon.end").alias("first_end"),
    ).drop("run")


def _surroundings(rows: DataFrame) -> DataFrame:
    """(first place, at, bytes): the bytes around each first place, ``at`` where they begin
    and whether they end the text; rows hold doc_id, text and an array of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for p in places:
                    s, e = p["first_start"], p["first_end"]
                    at = max(0, s - CONTEXT)
                    for column, x in zip(out, (i, s, e, at, raw[at : e + CONTEXT], len(raw)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*FIRST, "at", "bytes", "size"])

    return rows.mapInArrow(run, "first_doc long, first_start int, first_end int, at int, bytes binary, size int")


def extended(text: bytes, copy: dict, least: int) -> tuple[int, int, int] | None:
    """(start, end, start of its first place) of the longest passage around a run that
    equals what surrounds its first place; None if the run differs or it is too short."""
    s, e, first, at, other = copy["start"], copy["end"], copy["first_start"], copy["at"], copy["bytes"]
    k, n = first - at, e - s
    if text[s:e] != other[k : k + n]:
        return None
    end = at + len(other)
    while s > 0 and k > 0 and text[s - 1] == other[k - 1]:
        s, k = s - 1, k - 1
    n = e - s
    while e < len(text) and k + n < len(other) and text[e] == other[k + n]:
        e, n = e + 1, n + 1
    first = at + k
    # whole characters: a copy begins and ends where its text does
    while s < e and text[s] & 0xC0 == 0x80:
        s, first = s + 1, first + 1
    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
        e -= 1
    whole = s == 0 and e == len(text) and first == 0 and end == copy["size"] and e == copy["size"]
    return (s, e, first) if e - s >= least or (whole and e > s) else None


SPANS = "array<struct<start:long,end:long,first_doc:long,first_start:long>>"


def dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """(doc_id, spans, text) of each row that holds a passage which occurs earlier as well.

    ``spans`` are those passages, in bytes, with their first place (smallest doc_id, then
    position); they may overlap. ``text`` is the text without them. Passages have
    ``least`` bytes or more, or are whole texts. Null and empty texts and rows with a null
    doc_id have none and are never first. Rows that share a doc_id count as one document:
    repeated rows are no copies of each other.
    """
    known = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = io.staged(chunk_rows(spark, known), "byte_chunks")
    copies = io.staged(chunk_copies(chunks), "byte_copies")
    io.drop(chunks)
    places = copies.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_set(F.struct(*FIRST[1:])).alias("places"))
    holders, _ = io.parted(known, places)
    around = _surroundings(holders.join(places, "doc_id").select("doc_id", "text", "places"))
    one = F.struct("start", "end", "first_doc", "first_start", "at", "bytes", "size")
    wanted = copies.join(around, FIRST).groupBy("doc_id").agg(F.collect_list(one).alias("copies"))
    touched, _ = io.parted(known, copies.select("doc_id").distinct())
    rows = touched.join(wanted, "doc_id").select("doc_id", "text", "copies")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T._parse_datatype_string(SPANS)), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, texts = [], [], []
            for i, text, copies_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.encode()
                found = {(*x, c["first_doc"]) for c in copies_.as_py() if (x := extended(raw, c, least))}
                # the same passage by several runs: one span
                own = sorted({(s, e): (s, e, d, f) for s, e, f, d in sorted(found, reverse=True)}.values())
                if not own:
                    continue
                kept, at = [], 0
                for s, e, _, _ in own:
                    kept.append(raw[at : max(s, at)])
                    at = max(at, e)
                ids.append(i)
                spans.append([{"start": s, "end": e, "first_doc": d, "first_start": f} for s, e, d, f in own])
                texts.append(b"".join([*kept, raw[at:]]).decode())
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first_doc", "first_start")]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())], names=["doc_id", "spans", "text"])

    return rows.mapInArrow(run, schema)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document that holds a repeated passage, first or again.

    n_spans and spans are its passages, those that come first included; repeat_bytes and
    removed_bytes count what is in any of them, and in those that don't come first;
    first_doc_id is the smallest document of a first place, text_sha256 the digest of the
    text without what was removed (null if nothing was).
    """
    found = io.staged(dedup(spark, docs).withColumn("text_sha256", F.sha2("text", 256)).drop("text"), "byte_spans")
    each = found.select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id", "s.start", "s.end", "s.first_doc", "s.first_start", F.col("s.end") - F.col("s.start") + F.col("s.first_start")
    ).toDF("doc_id", "start", "end", "first_doc", "first_start", "first_end")
    again = each.select("doc_id", "start", "end", "first_doc", F.lit(True).alias("again"))
    first = each.select(F.col("first_doc").alias("doc_id"), F.col("first_start").alias("start"), F.col("first_end").alias("end"), "first_doc", F.lit(False).alias("again"))
    spans = again.union(first).groupBy("doc_id", "start", "end").agg(F.min("first_doc").alias("first_doc"), F.max("again").alias("again"))

    def covered(only: bool) -> F.Column:
        """Bytes in the union of the spans: each adds what lies behind all before it."""
        before = F.max(F.when(F.col("again") | F.lit(not only), F.col("end"))).over(W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
        added = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
        return F.when(F.col("again") | F.lit(not only), added).otherwise(0)

    counted = spans.withColumn("any", covered(False)).withColumn("later", covered(True))
    rows = counted.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"),
        F.sum("any").alias("repeat_bytes"),
        F.sum("later").alias("removed_bytes"),
        F.min("first_doc").alias("first_doc_id"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    digests = found.groupBy("doc_id").agg(F.min("text_sha256").alias("text_sha256"))
    return rows.join(digests, "doc_id", "left")
