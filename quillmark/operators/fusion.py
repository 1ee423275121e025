"""Score fusion: z-scores with a declared population, weight sweeps, rules, lattices."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.joins import Refused
from quillmark.operators.metrics import roc_auc


def zscore(df: DataFrame, score: str, by: list[str], fit: Column, name: str = "z") -> DataFrame:
    """(score - mean) / population sd, fitted per group on rows where ``fit`` holds; a
    constant group has sd 1. A group that the fit population lacks is an error."""
    stats = df.groupBy(*by).agg(F.avg(F.when(fit, F.col(score))).alias("__m"), F.stddev_pop(F.when(fit, F.col(score))).alias("__s"))
    if not stats.filter("__m is null").isEmpty():
        raise Refused("a group has no row in the fit population")
    sd = F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(1.0))
    joined = df.join(F.broadcast(stats), by) if by else df.crossJoin(F.broadcast(stats))  # one row if there are no groups
    return joined.withColumn(name, (F.col(score) - F.col("__m")) / sd).drop("__m", "__s")


def fuse(df: DataFrame, parents: list[str], weights: list[float], population: str | None, name: str = "fused") -> DataFrame:
    """Weighted mean of z-scores; the population they were fitted on must be named."""
    if not population:
        raise Refused("name the population that the z-scores were fitted on")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise Refused("weights must be nonnegative, with a positive sum")
    total = sum(weights)
    return df.withColumn(name, sum((F.col(p) * F.lit(w / total) for p, w in zip(parents, weights, strict=True)), F.lit(0.0))).withColumn("population", F.lit(population))


def weight_sweep(df: DataFrame, a: str, b: str, y: str, by: list[str], steps: int = 20) -> DataFrame:
    """(weight, objective): mean AUC over groups for each weight of ``a``, in one job."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(float(steps))))
    rows = df.withColumn("weight", grid).withColumn("__f", F.col("weight") * F.col(a) + (F.lit(1.0) - F.col("weight")) * F.col(b))
    return roc_auc(rows, ["weight", *by], y, "__f").groupBy("weight").agg(F.avg("auc").alias("objective"))


def best_weight(sweep: DataFrame) -> DataFrame:
    """Largest objective; ties to the weight nearest one half, then the smaller."""
    return sweep.agg(F.max(F.struct("objective", (-F.abs(F.col("weight") - 0.5)).alias("near"), (-F.col("weight")).alias("w"))).alias("b")).select(
        (-F.col("b.w")).alias("weight"), F.col("b.objective").alias("objective")
    )


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(s, lo) + F.get(s, hi)) * 0.5


def _std(a: Column) -> Column:
    m = _mean(a)
    return F.sqrt(_mean(F.transform(a, lambda x: (x - m) * (x - m))))


def _trimmed(a: Column) -> Column:
    s = F.array_sort(a)
    return F.when(F.size(a) > 2, _mean(F.slice(s, F.lit(2), F.size(a) - 2))).otherwise(_mean(a))


def _log_not(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda p: F.log1p(-p)), F.lit(0.0), lambda x, y: x + y)


def rules(z: Column, p: Column, r: Column) -> dict[str, Column]:
    """Combination rules over arrays of z-scores, probabilities and percent ranks."""
    far = F.array_max(F.transform(z, lambda x: F.abs(x)))

    def entropy(q: Column) -> Column:
        return -(q * F.log2(q) + (F.lit(1.0) - q) * F.log2(F.lit(1.0) - q))

    weights = F.transform(p, lambda q: F.lit(1.0) - entropy(q) + 1e-9)
    total = F.aggregate(weights, F.lit(0.0), lambda x, y: x + y)
    weighted = F.aggregate(F.zip_with(weights, z, lambda w, x: w * x), F.lit(0.0), lambda x, y: x + y)
    return {
        "mean": _mean(z), "median": _median(z), "max": F.array_max(z), "min": F.array_min(z),
        "rank_mean": _mean(r), "rank_median": _median(r), "std": _std(z), "mean_plus_std": _mean(z) + _std(z), "mean_minus_std": _mean(z) - _std(z),
        "most_confident": F.get(F.filter(z, lambda x: F.abs(x) == far), F.lit(0)), "entropy_weighted": weighted / total,
        "noisy_or": F.lit(1.0) - F.exp(_log_not(p)), "noisy_and": F.exp(F.aggregate(F.transform(p, lambda q: F.ln(q)), F.lit(0.0), lambda x, y: x + y)),
        "trimmed_mean": _trimmed(z), "range": F.array_max(z) - F.array_min(z),
    }


def simplex(n: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors of n parts on a lattice of 1 / steps (a driver-side grid)."""
    if n == 1:
        return [(1.0,)]

    def parts(k: int, left: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in parts(k - 1, left - i):
                yield (i, *rest)

    return [tuple(i / steps for i in p) for p in parts(n, steps)]


def subsets(df: DataFrame, arms: list[str], y: str, by: list[str], barred: set[frozenset[str]] = frozenset()) -> DataFrame:
    """AUC of the mean z-score of every non-empty subset of arms, legal or barred."""
    masks = [(",".join(c), len(c), [1.0 / len(c) if a in c else 0.0 for a in arms], frozenset(c) not in barred) for k in range(1, len(arms) + 1) for c in combinations(arms, k)]
    plan = df.sparkSession.createDataFrame(masks, "arms string, arity int, w array<double>, legal boolean")
    rows = df.crossJoin(F.broadcast(plan)).withColumn("__f", sum((F.col(a) * F.col("w")[i] for i, a in enumerate(arms)), F.lit(0.0)))
    return roc_auc(rows, ["arms", "arity", "legal", *by], y, "__f")


def routed(gate: Column, inside: Column, z1: Column, z2: Column, w: float) -> Column:
    """z1 behind the gate, the weighted mean of both elsewhere."""
    return F.when(gate, inside).otherwise(F.lit(w) * z1 + F.lit(1 - w) * z2)
