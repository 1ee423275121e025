"""Means, covariance, Mahalanobis distance, linear heads and cluster agreement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(vector: Column, weights: list[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)


def component_stats(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, pos, mean, sd) of every component."""
    long = df.select(by, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as doubles; a row of another length is an error."""
    if column.null_count or (len(column) and set(np.diff(column.offsets.to_numpy()).tolist()) != {dim}):
        raise ValueError(f"every vector must have {dim} components")
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(df: DataFrame, by: str, vector: str, dim: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(groups, rows a group, sums a group, X'X over all rows).

    A task adds up products of Arrow batches and gives dim + 1 rows a group; the driver
    gathers dim numbers a group and one dim * dim matrix.
    """

    def run(batches):
        sums: dict = {}
        cross = np.zeros((dim, dim))
        for batch in batches:
            x, names = _matrix(batch.column(1), dim), batch.column(0).to_pylist()
            cross += x.T @ x
            for name in set(names):
                own = np.array([n == name for n in names])
                old = sums.get(name, (0, np.zeros(dim)))
                sums[name] = old[0] + int(own.sum()), old[1] + x[own].sum(axis=0)
        names = list(sums)
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, *[None] * dim], type=kind), pa.array([-1] * len(names) + list(range(dim)), pa.int32()), pa.array([sums[n][0] for n in names] + [0] * dim, pa.int64()), pa.array([*(sums[n][1].tolist() for n in names), *cross.tolist()], pa.list_(pa.float64()))],
                names=["grp", "i", "n", "v"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[by].dataType)
    parts = df.select(by, vector).mapInArrow(run, f"grp {df.schema[by].dataType.simpleString()}, i int, n long, v array<double>")
    added = parts.select("grp", "i", "n", F.posexplode("v").alias("j", "v")).groupBy("grp", "i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    groups = sorted({r["grp"] for r in added if r["i"] < 0})
    n, sums, cross = np.zeros(len(groups)), np.zeros((len(groups), dim)), np.zeros((dim, dim))
    for r in added:
        if r["i"] < 0:
            k = groups.index(r["grp"])
            n[k], sums[k, r["j"]] = r["n"], r["v"]
        else:
            cross[r["i"], r["j"]] = r["v"]
    return groups, n, sums, cross


def gaussian_fit(df: DataFrame, by: str, vector: str, dim: int, ridge: float = 1e-3) -> tuple[list, np.ndarray, np.ndarray]:
    """(groups, means, whitening): per-group means and the inverse Cholesky factor of
    the pooled within covariance."""
    groups, n, sums, cross = moments(df, by, vector, dim)
    means = sums / n[:, None]
    within = (cross - (means * n[:, None]).T @ means) / n.sum() + ridge * np.eye(dim)
    return groups, means, np.linalg.inv(np.linalg.cholesky(within))


def mahalanobis(df: DataFrame, vector: str, means: np.ndarray, white: np.ndarray, keep: list[str], name: str = "distance") -> DataFrame:
    """``keep`` and the least squared distance to a group mean, by matrix products on batches."""
    shared = df.sparkSession.sparkContext.broadcast((white, means @ white.T))
    dim = means.shape[1]

    def run(batches):
        w, centers = shared.value
        for batch in batches:
            axis = _matrix(batch.column(len(keep)), dim) @ w.T
            best = np.full(len(axis), np.inf)
            for c in centers:
                best = np.minimum(best, np.square(axis - c).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(best)], names=[*keep, name])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return df.select(*keep, vector).mapInArrow(run, schema)


def projected(df: DataFrame, vector: str, axes: np.ndarray) -> DataFrame:
    """``df`` with the components along orthonormal ``axes`` taken out of a vector column."""
    shared = df.sparkSession.sparkContext.broadcast(axes)
    names, dim = df.columns, axes.shape[1]
    at = names.index(vector)

    def run(batches):
        a = shared.value
        for batch in batches:
            x = _matrix(batch.column(at), dim)
            x = x - (x @ a.T) @ a
            out = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dim, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([out if k == at else batch.column(k) for k in range(len(names))], names=names)

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == vector else f for f in df.schema.fields])
    return df.mapInArrow(run, schema)


def non_finite(vector: Column) -> Column:
    return F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def half_overflow(vector: Column) -> Column:
    """Whether a component doesn't fit half precision."""
    return F.exists(vector, lambda x: F.abs(x) > 65504.0)


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings and purity of ``a`` in ``b``."""

    def pairs(c: Column) -> Column:
        return c.cast("double") * (c - 1) * 0.5

    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("m"), F.max("n").alias("top")).agg(F.sum(pairs(F.col("m"))).alias("sa"), F.sum("top").alias("top"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias("sb"))
    one = both.crossJoin(rows).crossJoin(cols)  # single rows
    chance = F.col("sa") * F.col("sb") / pairs(F.col("n"))
    return one.select(((F.col("s") - chance) / ((F.col("sa") + F.col("sb")) * 0.5 - chance)).alias("ari"), (F.col("top").cast("double") / F.col("n")).alias("purity"))


def gini(sizes: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of group sizes (one row a group)."""
    from pyspark.sql import Window as W

    r = sizes.withColumn("i", F.row_number().over(W.orderBy(value)))
    return r.agg(((F.sum(F.col("i") * F.col(value)) * 2.0) / (F.count("*") * F.sum(value)) - (F.count("*") + 1.0) / F.count("*")).alias("gini"))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    """Cluster of each row (MLlib, on standardised components)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    scaled = StandardScaler(withMean=True, inputCol="__v", outputCol="__s").fit(rows).transform(rows)
    return KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="cluster").fit(scaled).transform(scaled).drop("__v", "__s")
