"""Temperature scaling, abstention policy and reports on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalars import softplus
from quillmark.operators.joins import Refused
from quillmark.operators.metrics import quantiles, tpr_at_fpr


def check_fit_split(df: DataFrame, split: str = "split", allowed: str = "val_internal") -> None:
    n = df.filter(F.col(split) != allowed).count()
    if n:
        raise Refused(f"{n} rows of the fit don't belong to {allowed}")


def global_temperature(df: DataFrame, y: str = "label", x: str = "logit", steps: int = 30) -> float:
    """Temperature of least cross-entropy: Newton on log T, one aggregate a step."""
    u = 0.0
    for _ in range(steps):
        b = math.exp(-u)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(x) * b))
        got = df.agg(F.avg((p - F.col(y)) * F.col(x)).alias("g"), F.avg(p * (F.lit(1.0) - p) * F.col(x) * F.col(x)).alias("h")).first()
        if not got["h"]:
            break
        step = got["g"] / got["h"]
        b = max(b - max(min(step, 0.5 * b), -b), 1e-3)
        if abs(-math.log(b) - u) < 1e-7:
            break
        u = -math.log(b)
    return math.exp(u)


def conditional_temperature(z: list[Column], w: list[float], b: float, eps: float, lo: float, hi: float) -> Column:
    """softplus(w . z + b) + eps, held to the fitted range."""
    t = softplus(sum((c * F.lit(v) for c, v in zip(z, w, strict=True)), F.lit(b))) + F.lit(eps)
    return F.greatest(F.least(t, F.lit(hi)), F.lit(lo))


def fit_policy(df: DataFrame, p: str, y: str, eqi: str, fpr: float, coverage: float) -> DataFrame:
    """One row (flag, clear, eqi_min): thresholds to flag and, mirrored, to clear, and
    the evidence-quality quantile below which a row goes to review."""
    up = tpr_at_fpr(df, [], y, p, fpr).select(F.col("threshold").alias("flag"))
    mirrored = df.select((F.lit(1) - F.col(y)).alias(y), (F.lit(1.0) - F.col(p)).alias(p))
    down = tpr_at_fpr(mirrored, [], y, p, fpr).select((F.lit(1.0) - F.col("threshold")).alias("clear"))
    quality = quantiles(df, [], eqi, [1 - coverage]).select(F.col("q")[0].alias("eqi_min"))
    return up.crossJoin(down).crossJoin(quality)  # three single rows


def decide(p: Column, eqi: Column, flag: Column, clear: Column, eqi_min: Column) -> Column:
    """flag, clear or review; a row both would claim goes to review."""
    return F.when(eqi < eqi_min, "review").when((p >= flag) & (p <= clear), "review").when(p >= flag, "flag").when(p <= clear, "clear").otherwise("review")


def policy_report(df: DataFrame, decision: str, y: str) -> DataFrame:
    auto = F.col(decision) != "review"
    right = ((F.col(decision) == "flag") & (F.col(y) == 1)) | ((F.col(decision) == "clear") & (F.col(y) == 0))
    return df.agg(
        F.avg(auto.cast("double")).alias("auto_fraction"),
        F.avg(F.when(auto & (F.col(y) == 0), (F.col(decision) == "flag").cast("double"))).alias("auto_fpr"),
        F.avg(F.when(auto, right.cast("double"))).alias("auto_accuracy"),
    )
