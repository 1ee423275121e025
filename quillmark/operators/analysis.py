"""Registered-analysis statistics: contrasts, curves, verdicts, memberships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.operators.joins import Refused
from quillmark.operators.metrics import roc_auc


def arm_aucs(df: DataFrame, arms: list[str], by: list[str], y: str = "label") -> DataFrame:
    """(by, arm, auc) of several score columns."""
    pairs = ", ".join(f"'{a}', cast({a} as double)" for a in arms)
    long = df.select(*by, y, F.expr(f"stack({len(arms)}, {pairs}) as (arm, s)"))
    return roc_auc(long, [*by, "arm"], y, "s")


def contrast(aucs: DataFrame, by: list[str], terms: dict[str, float], name: str) -> DataFrame:
    """A linear combination of arms' AUCs per group; null where one is undefined."""
    picked = [F.max(F.when(F.col("arm") == a, F.col("auc"))) * F.lit(c) for a, c in terms.items()]
    return aucs.groupBy(*by).agg(reduce(lambda x, z: x + z, picked).alias(name))


def factorial_effects(cells: DataFrame, f: str, g: str, value: str) -> DataFrame:
    """Main effects and interaction of two 0/1 factors, one row per cell given."""

    def at(a: int, b: int) -> Column:
        return F.max(F.when((F.col(f) == a) & (F.col(g) == b), F.col(value)))

    one = cells.agg(at(0, 0).alias("v00"), at(0, 1).alias("v01"), at(1, 0).alias("v10"), at(1, 1).alias("v11"))
    return one.select(
        ((F.col("v10") + F.col("v11") - F.col("v00") - F.col("v01")) * 0.5).alias("effect_f"),
        ((F.col("v01") + F.col("v11") - F.col("v00") - F.col("v10")) * 0.5).alias("effect_g"),
        (F.col("v11") - F.col("v10") - F.col("v01") + F.col("v00")).alias("interaction"),
    )


def level_shape(curve: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """Whether a curve never falls and whether it changes sign."""
    order = W.partitionBy(*by).orderBy(level)
    step = F.col(value) - F.lag(value).over(order)
    return curve.withColumn("__d", step).groupBy(*by).agg(
        F.coalesce(F.min("__d") >= 0, F.lit(True)).alias("non_decreasing"), ((F.min(value) < 0) & (F.max(value) > 0)).alias("changes_sign")
    )


def retained_share(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def seed_verdict(df: DataFrame, by: list[str], diff: str, lo: str, margin: float, wins: int) -> DataFrame:
    """Mean over seeds beyond a margin, and enough intervals above zero."""
    out = df.groupBy(*by).agg(F.avg(diff).alias("mean_diff"), F.count_if(F.col(lo) > 0).alias("ci_above"))
    return out.withColumn("passes", (F.col("mean_diff") > margin) & (F.col("ci_above") >= wins))


def memberships(df: DataFrame, families: str, single: bool = False) -> DataFrame:
    """A row per family of each row, or rows of exactly one family only."""
    rows = df.filter(F.size(families) == 1) if single else df
    return rows.withColumn("family", F.explode(F.array_distinct(families)))


def reproduction(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows met, rows of one side only and the largest gap between two score tables."""
    j = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key, "full")
    return j.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("matched"),
        F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unmatched"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_diff"),
    )


def best_arm(df: DataFrame, arm: str, value: str, order: str) -> DataFrame:
    """Largest value; ties to the arm registered first."""
    return df.agg(F.max_by(arm, F.struct(F.col(value), -F.col(order))).alias(arm), F.max(value).alias(value))


def leaderboard(df: DataFrame, by: str, value: str, name: str, n: int) -> DataFrame:
    """The n best of each group, with their rank."""
    order = W.partitionBy(by).orderBy(F.desc(value), name)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at positions floor(i * rows / n) in ``order`` (given as 0, 1, 2, ...)."""
    total = df.count()
    if n > total:
        raise Refused(f"{n} positions in {total} rows")
    keep = df.sparkSession.range(n).select(F.floor(F.col("id") * total / n).alias("__p"))
    return df.join(keep, F.col(order) == F.col("__p"), "left_semi")


def disagreement(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def collinearity(df: DataFrame, columns: list[str]) -> tuple[int, float]:
    """(rank, condition number) of standardised columns, from one row of moments."""
    import numpy as np

    n = len(columns)
    moments = [F.avg(F.col(c).cast("double")) for c in columns] + [F.avg(F.col(columns[i]).cast("double") * F.col(columns[j])) for i in range(n) for j in range(i, n)]
    row = list(df.agg(*moments).first())
    mean, cross = np.array(row[:n]), np.zeros((n, n))
    for (i, j), v in zip([(i, j) for i in range(n) for j in range(i, n)], row[n:], strict=True):
        cross[i, j] = cross[j, i] = v
    cov = cross - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    s = np.linalg.svd(cov / np.outer(sd, sd), compute_uv=False)
    return int((s > 1e-10 * s[0]).sum()), float(np.sqrt(s[0] / max(s[-1], 1e-300)))


def balance_authentic(df: DataFrame, y: str, split: str, source: str, key: str, seed: int, scarce_first: list[str]) -> DataFrame:
    """Deal unassigned authentic rows to splits until each has as many as generated
    ones: scarce splits first, proportionally by source, the rest to train.

    Needs are counted once; a row's place is its rank among its source's unassigned
    rows in hash order, and each split takes a contiguous range of places.
    """
    from quillmark.operators.sampling import ranked

    need = {r[0]: r[1] for r in df.groupBy(split).agg((F.count_if(F.col(y) == 1) - F.count_if(F.col(y) == 0)).alias("need")).collect() if r[0]}
    free = df.filter((F.col(y) == 0) & (F.col(split) == ""))
    sizes = free.groupBy(source).agg(F.count("*").alias("__m"))
    total = free.count()
    rows = ranked(free, [source], key, seed, "__rn").join(sizes, source)
    place = (F.col("__rn") - 0.5) / F.col("__m")
    chosen, at = F.lit("train"), 0.0
    cuts = []
    for name in scarce_first:
        share = max(0, need.get(name, 0)) / total if total else 0.0
        cuts.append((name, at, min(1.0, at + share)))
        at = min(1.0, at + share)
    for name, lo, hi in reversed(cuts):
        chosen = F.when((place > lo) & (place <= hi), F.lit(name)).otherwise(chosen)
    dealt = rows.withColumn(split, chosen).drop("__rn", "__m")
    return df.filter((F.col(y) == 1) | (F.col(split) != "")).unionByName(dealt.select(*df.columns))
