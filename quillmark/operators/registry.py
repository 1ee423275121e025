"""Source registries: classification of raw paths and rules by source and generator."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.joins import Refused
from quillmark.operators.metrics import quantiles


def demo_registry(spark: SparkSession) -> DataFrame:
    """A registry (source, real_buckets, excluded) for the sources src0 to src19."""
    rows = [(f"src{i}", ["en", "de"] if i % 2 == 0 else ["fr"], i % 7 == 0) for i in range(20)]
    return spark.createDataFrame(rows, "source string, real_buckets array<string>, excluded boolean")


def classify(df: DataFrame, registry: DataFrame, source: str, bucket: str) -> DataFrame:
    """``label`` and ``generator`` of (source, bucket); unknown sources are an error.

    A registry holds one row per source and is small by contract.
    """
    j = df.join(registry.withColumnRenamed("source", "__s"), F.col(source) == F.col("__s"), "left")
    real = F.array_contains("real_buckets", F.col(bucket))
    known = F.when(F.col("__s").isNull(), F.raise_error(F.concat(F.lit("unknown source "), F.col(source))).cast("int"))
    return j.withColumn("label", known.when(real, 0).otherwise(1)).withColumn("generator", F.when(real, "").otherwise(F.col(bucket))).drop("__s", "real_buckets", "excluded")


def raw_subdir(df: DataFrame, registry: DataFrame) -> DataFrame:
    """The bucket that classification would map to a row's label and generator."""
    j = df.join(registry, "source")
    return j.withColumn("bucket", F.when(F.col("label") == 1, F.col("generator")).otherwise(F.get("real_buckets", F.lit(0)))).drop("real_buckets", "excluded")


def derive_root(df: DataFrame, path: str) -> str:
    """Deepest directory common to all paths: that of the least and the greatest."""
    lo, hi = df.agg(F.min(path), F.max(path)).first()
    return os.path.commonpath([os.path.dirname(lo), os.path.dirname(hi)])


def tag(df: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return df.join(table, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def select_splits(df: DataFrame, names: list[str], split: str = "split") -> DataFrame:
    """Rows of the named splits; a name that no row has is an error."""
    found = {r[0] for r in df.filter(F.col(split).isin(names)).select(split).distinct().collect()}
    if set(names) - found:
        raise Refused(f"unknown splits {sorted(set(names) - found)}")
    return df.filter(F.col(split).isin(names))


def without_prefixes(df: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Rows below none of the prefixes; a prefix that matches nothing is an error."""
    counts = df.agg(*[F.count_if(F.col(path).startswith(p)).alias(f"p{i}") for i, p in enumerate(prefixes)]).first()
    idle = [p for p, n in zip(prefixes, counts, strict=True) if not n]
    if idle:
        raise Refused(f"prefixes that match nothing: {idle}")
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(path).startswith(p)
    return df.filter(~hit)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, '' if none does."""
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("")


def touches_band(ops: Column, bands: dict[str, tuple[float, float]]) -> Column:
    """Whether an array of (name, value) ops has one inside the band of its name."""
    hit = None
    for name, (lo, hi) in bands.items():
        one = F.exists(ops, _in_band(name, lo, hi))
        hit = one if hit is None else hit | one
    return hit


def _in_band(name: str, lo: float, hi: float):
    def test(o: Column) -> Column:
        return (o["name"] == name) & o["value"].between(lo, hi)

    return test


def quantile_bins(df: DataFrame, value: str, probs: list[float], name: str) -> DataFrame:
    """Number of exact quantiles below a value: bins that never split ties."""
    edges = quantiles(df, [], value, probs, "__e")
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.aggregate("__e", F.lit(0), lambda a, e: a + (F.col(value) > e).cast("int"))).drop("__e")  # one row
