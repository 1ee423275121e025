"""Shared storage and shipping of this package to executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may do without it, as in tests; it gets a folder of our own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quillmark-"))
        atexit.register(_drop_own)
    return "file://" + _OWN[0]


def _drop_own() -> None:
    import shutil

    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation. The path
    is kept in ``_staged_path`` so that :func:`drop` can delete the table early.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bits of a membership filter (a power of two) and probes for each id. The filter has
#: this size for any number of ids; one that is full lets every row pass.
FILTER_BITS, _PROBES = 1 << 26, 2
_WORD = 64


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key.cast("long"), F.lit(f"probe {k}")), F.lit(FILTER_BITS)) for k in range(_PROBES)]


def id_filter(ids: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of the ids as 64-bit words: FILTER_BITS / 8 bytes, whatever their
    number; the driver gathers one row for each of its words at most."""
    place = ids.select(F.explode(F.array(*_places(F.col(key)))).alias("p"))
    word = (F.col("p") / _WORD).cast("long")
    got = place.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(p, {_WORD}) as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // _WORD, np.uint64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def parted(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose key may be among ``ids``, rows whose key isn't).

    The first holds all rows with such a key and, by chance, a few others: an exact join
    follows, and only these rows are shuffled for it. One plan serves any number of ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(id_filter(ids, key))
    names, n_probes = docs.columns, _PROBES
    marked = docs.select(*[F.col(f"`{c}`") for c in names], *[p.alias(f"__probe{k}") for k, p in enumerate(_places(F.col(key)))])

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            for batch in batches:
                hit = np.ones(batch.num_rows, dtype=bool)
                for k in range(n_probes):
                    p = batch.column(len(names) + k).to_numpy(zero_copy_only=False)
                    hit &= (words[p // _WORD] >> (p % _WORD).astype(np.uint64)) & np.uint64(1) == 1
                keep = pa.array(hit if wanted else ~hit)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(len(names))], names=names)

        return marked.mapInArrow(lean(run), docs.schema)

    return part(True), part(False)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """``run`` for mapInArrow, with what its task has freed given back to the system at the
    end: workers live on for later stages, and both allocators keep free memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return wrapped


#: Bytes of an Arrow batch that goes to a Python worker at most (or one row).
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that do not see it already, and bound
    the batches that they get, whose rows may be long texts."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) != f"{BATCH_BYTES}b":
        spark.conf.set(bound, f"{BATCH_BYTES}b")
    root = Path(__file__).resolve().parents[2]
    seen = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(":") + ["."]]
    key = spark.sparkContext.applicationId
    if str(root) in seen or key in _SHIPPED:
        return
    _SHIPPED.add(key)
    out = Path(tempfile.mkdtemp(prefix="quillmark-zip-")) / "quillmark_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "quillmark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
