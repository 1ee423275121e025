"""Per-condition metrics, robustness tables, selection and error listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import metrics as m


def condition_metrics(df: DataFrame, by: list[str], y: str = "label", s: str = "score", threshold: float | None = None, fpr: float = m.FPR) -> DataFrame:
    """n, n_pos, AUC, TPR at FPR, best accuracy and accuracy at a fixed threshold."""
    fixed = m.accuracy_at(F.col(y), F.col(s), F.lit(threshold)) if threshold is not None else F.lit(None).cast("double")
    base = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"), fixed.alias("acc_fixed"))
    tpr = m.tpr_at_fpr(df, by, y, s, fpr).select(*by, "tpr")
    best = m.best_accuracy(df, by, y, s).select(*by, F.col("accuracy").alias("acc_oracle"))
    return base.join(m.roc_auc(df, by, y, s), by, "left").join(tpr, by, "left").join(best, by, "left")


def clean_threshold(df: DataFrame, condition: str = "condition", clean: str = "clean", y: str = "label", s: str = "score") -> float | None:
    row = m.best_accuracy(df.filter(F.col(condition) == clean), [], y, s).first()
    return row["threshold"] if row else None


def selection_population(split: Column, y: Column, condition: Column) -> Column:
    """Authentic rows of val_internal and generated ones of held-out generators, under
    any condition but clean."""
    return (condition != "clean") & (((split == "val_internal") & (y == 0)) | ((split == "heldout_generator") & (y == 1)))


def robust_tpr(df: DataFrame, condition: str = "condition", fpr: float = m.FPR) -> DataFrame:
    """Mean TPR over degraded conditions."""
    return m.tpr_at_fpr(df.filter(F.col(condition) != "clean"), [condition], fpr=fpr).agg(F.avg("tpr").alias("robust_tpr"))


def per_generator_tpr(df: DataFrame, generator: str = "generator", fpr: float = m.FPR, y: str = "label", s: str = "score") -> DataFrame:
    """TPR of each generator against all authentic rows: the threshold is that of the
    shared negatives, so they needn't be repeated for every generator."""
    points = m.roc_points(df.withColumn("__one", F.lit(1)), ["__one"], y, s)
    thr = points.filter(F.col("fp") <= F.lit(fpr) * F.col("nn")).agg(F.min("s").alias("thr"))
    return df.filter(F.col(y) == 1).crossJoin(F.broadcast(thr)).groupBy(generator).agg(F.count("*").alias("n"), F.avg((F.col(s) >= F.col("thr")).cast("double")).alias("tpr"))  # thr is one row


def challenge_score(table: DataFrame, condition: str = "condition", value: str = "auc") -> DataFrame:
    clean = F.avg(F.when(F.col(condition) == "clean", F.col(value)))
    return table.agg((clean * 0.5 + F.avg(F.when(F.col(condition) != "clean", F.col(value))) * 0.5).alias("challenge"))


def robustness_table(table: DataFrame, rung: str, condition: str, values: list[str], value: str = "auc") -> DataFrame:
    """Rungs by conditions, with the mean over degraded conditions."""
    wide = table.groupBy(rung).pivot(condition, values).agg(F.first(value))
    mean = table.filter(F.col(condition) != "clean").groupBy(rung).agg(F.avg(value).alias("robust_mean"))
    return wide.join(mean, rung)


def fp_rate_by_source(df: DataFrame, threshold: float, y: str = "label", s: str = "score") -> DataFrame:
    reals = F.count_if(F.col(y) == 0)
    hits = F.count_if((F.col(y) == 0) & (F.col(s) >= threshold))
    return df.groupBy("source").agg(F.count("*").alias("n"), F.when(reals > 0, hits.cast("double") / reals).alias("fp_rate"))


def shared_threshold_rates(df: DataFrame, q: float = 0.99, y: str = "label", s: str = "score") -> DataFrame:
    """FPR by source and TPR by generator at one quantile of the authentic scores."""
    thr = df.filter(F.col(y) == 0).transform(lambda x: m.quantiles(x, [], s, [q])).select(F.col("q")[0].alias("thr"))
    hit = F.avg((F.col(s) > F.col("thr")).cast("double"))
    rows = df.crossJoin(F.broadcast(thr))  # one row
    by_source = rows.filter(F.col(y) == 0).groupBy(F.col("source").alias("grp")).agg(hit.alias("rate"), F.count("*").alias("n")).withColumn("kind", F.lit("fpr"))
    by_gen = rows.filter(F.col(y) == 1).groupBy(F.col("generator").alias("grp")).agg(hit.alias("rate"), F.count("*").alias("n")).withColumn("kind", F.lit("tpr"))
    return by_source.unionByName(by_gen)


def top_errors(df: DataFrame, k: int, kind: str, ties: list[str], y: str = "label", s: str = "score") -> DataFrame:
    """The k most confident false positives or false negatives."""
    if kind not in ("fp", "fn"):
        raise ValueError("kind is fp or fn")
    rows = df.filter(F.col(y) == (0 if kind == "fp" else 1))
    return rows.orderBy(F.desc(s) if kind == "fp" else F.asc(s), *ties).limit(k)


def headline(results: DataFrame, name: str, value: str, eligible: str) -> DataFrame:
    """Best eligible result (ties: first name), and how many others beat it."""
    best = results.filter(eligible).orderBy(F.desc(value), name).limit(1).select(F.col(name).alias("best"), F.col(value).alias("best_value"))
    return results.crossJoin(F.broadcast(best)).groupBy("best", "best_value").agg(F.count_if(~F.expr(eligible) & (F.col(value) > F.col("best_value"))).alias("ineligible_better"))


def token_metrics(df: DataFrame, tokens: str, y: str, s: str) -> DataFrame:
    """AUC of each distortion token over its rows and all clean rows."""
    exploded = df.filter(F.size(tokens) > 0).withColumn("token", F.explode(tokens))
    names = exploded.select("token").distinct()
    clean = df.filter(F.size(tokens) == 0).crossJoin(F.broadcast(names))  # the token vocabulary is small and fixed
    both = exploded.select("token", y, s).unionByName(clean.select("token", y, s))
    n = both.groupBy("token").agg(F.count("*").alias("n"))
    return m.roc_auc(both, ["token"], y, s).join(n, "token")


def to_markdown(df: DataFrame) -> str:
    """A table of a few rows as markdown."""
    rows = [tuple("" if v is None else str(v) for v in r) for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [tuple(df.columns), ("-",) * len(df.columns), *rows]) + "\n"
