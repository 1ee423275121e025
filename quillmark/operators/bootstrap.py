"""Bootstrap intervals by Poisson weights from hashes, in one grouped job.

A row's weight in a replicate is a Poisson(1) draw decided by the hash of its key and
the replicate. Scores are collapsed per stratum, replicate and distinct score before
anything is ranked, so replicates cost partial sums and never copies of rows in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities of 0, 1, ... 7.
_POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998980321)


def poisson_weight(key: Column, replicate: Column) -> Column:
    u = F.pmod(F.xxhash64(key, replicate), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON), F.lit(0))


def auc_replicates(df: DataFrame, arms: list[str], y: str, key: str, n_boot: int) -> DataFrame:
    """(arm, replicate, auc); all arms share a replicate's weights."""
    rep = F.explode(F.sequence(F.lit(1), F.lit(n_boot)))
    weighted = df.withColumn("replicate", rep).withColumn("w", poisson_weight(F.col(key), F.col("replicate"))).filter("w > 0")
    stack = ", ".join(f"'{a}', cast({a} as double)" for a in arms)
    long = weighted.select("replicate", y, "w", F.expr(f"stack({len(arms)}, {stack}) as (arm, s)"))
    cells = long.groupBy("arm", "replicate", "s").agg(F.sum(F.when(F.col(y) == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, F.col("w")).otherwise(0)).alias("n"))
    below = W.partitionBy("arm", "replicate").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") * 0.5)
    total = cells.withColumn("won", won).groupBy("arm", "replicate").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.filter("p > 0 and n > 0").select("arm", "replicate", (F.col("won") / (F.col("p").cast("double") * F.col("n"))).alias("auc"))


def interval(replicates: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    return replicates.groupBy(*by).agg(F.percentile(value, [alpha / 2, 1 - alpha / 2]).alias("ci"), F.count("*").alias("n_used")).select(
        *by, F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"), "n_used"
    )


def paired_difference(replicates: DataFrame, baseline: str, alpha: float = 0.05) -> DataFrame:
    """(arm, mean difference to the baseline, interval, two-sided p, excludes_zero)."""
    base = replicates.filter(F.col("arm") == baseline).select("replicate", F.col("auc").alias("b"))
    d = replicates.filter(F.col("arm") != baseline).join(base, "replicate").withColumn("d", F.col("auc") - F.col("b"))
    out = d.groupBy("arm").agg(
        F.avg("d").alias("diff"), F.percentile("d", [alpha / 2, 1 - alpha / 2]).alias("ci"), F.avg((F.col("d") <= 0).cast("double")).alias("below"), F.avg((F.col("d") >= 0).cast("double")).alias("above")
    )
    return out.select(
        "arm", "diff", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"), F.least(F.lit(1.0), F.least("below", "above") * 2).alias("p"),
        ((F.col("ci")[0] > 0) | (F.col("ci")[1] < 0)).alias("excludes_zero"),
    )
