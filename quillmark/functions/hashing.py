"""Deterministic draws and orders from SHA-256, alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20260827


def order_key(seed: int, *key: Column) -> Column:
    """Hex digest that orders rows in a way that only seed and key decide."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)


def threshold(fraction: float) -> str:
    """The 8 hex digits below which a share ``fraction`` of digests begins."""
    return f"{min(max(round(fraction * 2**32), 0), 2**32 - 1):08x}"


def drawn(fraction: float, seed: int, *key: Column) -> Column:
    """True for a share ``fraction`` of keys: a Bernoulli draw without a generator."""
    if fraction >= 1:
        return F.lit(True)
    return F.substring(order_key(seed, *key), 1, 8) < F.lit(threshold(fraction))


def hash01(seed: int, *key: Column) -> Column:
    """Uniform number in [0, 1) of a key."""
    return F.conv(F.substring(order_key(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def crc_key(path: Column) -> Column:
    """crc32 of a path's last segment."""
    return F.crc32(F.element_at(F.split(path, "/"), -1))


def fingerprint(df: DataFrame, row_id: str, value: str, blocks: int = 1024) -> DataFrame:
    """One digest over ``value`` in ``row_id`` order, as a tree of digests.

    Rows are digested in blocks of consecutive ids, and these in blocks again until
    ``blocks`` or fewer are left, so no task gathers more than a block.
    """
    block = df.groupBy(F.floor(F.col(row_id) / blocks).alias("b")).agg(
        F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(F.col(row_id).alias("i"), F.col(value).alias("v")))), lambda s: s["v"])), 256).alias("d")
    )
    while block.count() > blocks:
        digests = F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"])
        block = block.groupBy(F.floor(F.col("b") / blocks).alias("up")).agg(F.sha2(F.concat_ws("\n", digests), 256).alias("d")).withColumnRenamed("up", "b")
    return block.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"])), 256).alias("fingerprint"))
