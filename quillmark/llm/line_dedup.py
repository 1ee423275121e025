"""Line dedup by chunks of lines whose borders follow from what repeats.

Every two neighbouring lines are an anchor with a digest, so a passage of two or more
lines that occurs twice is seen wherever it stands. Anchors that follow each other both
in a text and at their first place (smallest doc_id, then position) join into chunks;
a long chunk is split after anchors that a hash picks, so that copies share borders.
Chunks are kept where they come first and removed elsewhere, after their bytes have been
compared with the first.
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
from quillmark.llm.textkit import mix64, segment_hash, slices, string_buffers, window_hash

LEAST_LINES = 2
#: A chunk is split after an anchor with probability 1 / MODULUS.
MODULUS = 8
U64 = np.uint64


def line_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, line, digest, version) of every LEAST_LINES neighbouring
    lines of a text; positions in the slice, line the number of the first one in its text.

    An end leaves out the line feed after the last line; version is a hash of the text.
    """
    sizes = np.diff(offsets)
    feed = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([offsets[:-1][sizes > 0], feed + 1])).astype(np.int64)
    first = first[first < len(data)]
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty.astype(U64), empty.astype(np.int32)
    last = np.append(first[1:], len(data))
    last = np.where(data[last - 1] == 10, last - 1, last)
    doc = np.searchsorted(offsets, first, side="right") - 1
    h = segment_hash(data, first, last)
    opens = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(opens, len(doc)))
    line = np.arange(len(doc)) - np.repeat(opens, size)
    text = np.add.reduceat(mix64(h + line.astype(U64) * U64(0x9E3779B97F4A7C15)), opens)
    version = np.repeat((mix64(text) >> U64(33)).astype(np.int32), size)
    at = np.flatnonzero(doc[: 1 - LEAST_LINES] == doc[LEAST_LINES - 1 :])
    digest = window_hash(h, LEAST_LINES)[at]
    return doc[at], first[at], last[at + LEAST_LINES - 1], line[at], digest, version[at]


CHUNKS = "doc_id long, version int, line int, start long, end long, digest long"


def chunk_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The anchors of documents with a doc_id; positions in bytes."""
    io.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                part = offsets[a : b + 1] - offsets[a]
                doc, start, end, line, digest, version = line_chunks(data[offsets[a] : offsets[b]], part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b][doc]), pa.array(version), pa.array(line.astype(np.int32)),
                        pa.array(start - part[doc]), pa.array(end - part[doc]), pa.array(digest.view(np.int64)),
                    ],
                    names=["doc_id", "version", "line", "start", "end", "digest"],
                )

    known = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(io.lean(run), CHUNKS)


def chunk_copies(anchors: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, start, end, first_doc, first_start, first_end) of each chunk that doesn't
    come first: neighbouring anchors whose first places are neighbours as well."""
    place = F.struct("doc_id", "version", "line", "start", "end")
    hits = anchors.join(repeated, "digest").filter(place != F.col("canon")).distinct()
    own = W.partitionBy("doc_id", "version").orderBy("line")
    back = [F.lag(c).over(own) for c in ("line", "canon.doc_id", "canon.version", "canon.line", "digest")]
    goes_on = (
        (back[0] == F.col("line") - 1) & (back[1] == F.col("canon.doc_id")) & (back[2] == F.col("canon.version"))
        & (back[3] == F.col("canon.line") - 1) & (F.pmod(back[4], F.lit(MODULUS)) != 0)
    )
    run = F.sum(F.when(goes_on, 0).otherwise(1)).over(own)
    return hits.withColumn("run", run).groupBy("doc_id", "version", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("canon.doc_id").alias("first_doc"), F.min("canon.start").alias("first_start"), F.max("canon.end").alias("first_end"),
    ).select("doc_id", "start", "end", *FIRST).distinct()


FIRST = ["first_doc", "first_start", "first_end"]


def _cut_bytes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(first_doc, first_start, first_end, bytes) of the first occurrences: rows hold
    doc_id, text and an array of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, found = [], [], [], []
            for i, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for p in places:
                    ids.append(i)
                    starts.append(p["first_start"])
                    ends.append(p["first_end"])
                    found.append(raw[p["first_start"] : p["first_end"]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.binary())], names=[*FIRST, "bytes"]
            )

    return rows.mapInArrow(io.lean(run), "first_doc long, first_start long, first_end long, bytes binary")


REMOVED = "n_removed", "removed_bytes"


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, plus n_removed and removed_bytes.

    Cut are all runs of two or more lines that stand at an earlier place as well; a line's
    first occurrence always stays. One row per input row. A null text stays null and an
    empty one empty; rows with a null doc_id are passed on as they are and never count as
    first. Rows that share a doc_id count as one document for what repeats; bytes are
    compared for each of them. Chunks that touch are one for ``n_removed``. A text of
    repeated chunks only becomes empty.
    """
    anchors = io.staged(chunk_rows(spark, docs), "line_chunks")
    place = F.struct("doc_id", "version", "line", "start", "end")
    repeated = anchors.groupBy("digest").agg(F.min(place).alias("canon"), F.max(place).alias("last")).filter("canon <> last")
    repeated = io.staged(repeated.select("digest", "canon"), "line_repeats")
    copies = io.staged(chunk_copies(anchors, repeated), "line_copies")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = copies.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_set(F.struct(*FIRST[1:])).alias("places"))
    # texts are shuffled for the documents concerned only
    holders, _ = io.parted(keyed, places)
    firsts = _cut_bytes(spark, holders.join(places, "doc_id").select("doc_id", "text", "places"))
    wanted = copies.join(firsts, FIRST).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "bytes")).alias("__cuts"))
    touched, others = io.parted(docs, copies.select("doc_id").distinct())
    joined = touched.join(wanted.withColumnRenamed("doc_id", "__doc"), touched["doc_id"] == F.col("__doc"), "left").drop("__doc")
    names = docs.columns
    where = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("removed_bytes", T.LongType())])

    def cut(text: bytes, cuts: list[dict]) -> tuple[bytes, int, int]:
        out, at, n, size = [], 0, 0, 0
        for c in sorted(cuts, key=lambda c: (c["start"], -c["end"])):
            s, e = c["start"], c["end"]
            if text[s:e] != c["bytes"]:
                continue
            e += text[e : e + 1] == b"\n"
            if s > at or not n:
                out.append(text[at:s])
                n += 1
            if e > at:
                size += e - max(s, at)
                at = e
        out.append(text[at:])
        return b"".join(out), n, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            rows = batch.num_rows
            cuts = batch.column(len(names))
            n, size = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            hit = np.flatnonzero(np.asarray(cuts.is_valid()) & np.asarray(texts.is_valid()))
            if len(hit):
                values: list = texts.to_pylist()
                for i in hit:
                    got, n[i], size[i] = cut(values[i].encode(), cuts[int(i)].as_py())
                    values[i] = got.decode()
                texts = pa.array(values, type=texts.type)
            cols = [texts if k == where else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(size)], names=[*names, *REMOVED])

    zero = F.lit(0).cast("long")
    return joined.mapInArrow(io.lean(run), schema).union(others.select(*docs.columns, zero.alias("n_removed"), zero.alias("removed_bytes")))
