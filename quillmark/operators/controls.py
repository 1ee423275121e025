"""Leak and confound controls, manifest validation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.metrics import leak_auc, quantiles, roc_auc

RATIO_LIMIT, QUALITY_GAP = 1.5, 10.0


def resolution_leakage(df: DataFrame, stratum: str, y: str = "label") -> DataFrame:
    """One row: strata, strata of one class, and the accuracy of guessing each
    stratum's majority."""
    cells = df.groupBy(stratum).agg(F.count_if(F.col(y) == 0).alias("a"), F.count_if(F.col(y) == 1).alias("g"))
    return cells.agg(
        F.count("*").alias("strata"), F.count_if((F.col("a") == 0) | (F.col("g") == 0)).alias("single_class"),
        (F.sum(F.greatest("a", "g")).cast("double") / F.sum(F.col("a") + F.col("g"))).alias("majority_accuracy"),
    )


def confound_table(df: DataFrame, proxies: list[str], group: str, y: str = "label") -> DataFrame:
    """Orientation-free AUC of each proxy, within groups and pooled over them."""
    pairs = ", ".join(f"'{p}', cast({p} as double)" for p in proxies)
    long = df.select(F.col(group).cast("string").alias("grp"), y, F.expr(f"stack({len(proxies)}, {pairs}) as (proxy, value)"))
    both = long.unionByName(long.withColumn("grp", F.lit("POOLED")))
    n = both.groupBy("grp", "proxy").agg(F.count("*").alias("n"), F.count_if(F.col(y) == 0).alias("n_real"), F.count_if(F.col(y) == 1).alias("n_fake"))
    return leak_auc(both, ["grp", "proxy"], y, "value").join(n, ["grp", "proxy"])


def worst_proxy(table: DataFrame) -> DataFrame:
    return table.filter(F.col("auc").isNotNull()).groupBy("grp").agg(F.max_by("proxy", F.struct("auc", "proxy")).alias("proxy"), F.max("auc").alias("auc"))


def stratified_auc(df: DataFrame, stratum: str, y: str, s: str, least: int) -> DataFrame:
    """AUC over strata weighted by size; small and one-class strata are left out and
    their rows counted."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    each = roc_auc(df, [stratum], y, s).join(sizes, stratum)
    ok = (F.col("n") >= least) & F.col("auc").isNotNull()
    return each.agg(
        F.try_divide(F.sum(F.when(ok, F.col("auc") * F.col("n"))), F.sum(F.when(ok, F.col("n")))).alias("auc"),
        F.count_if(ok).alias("strata_used"), F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("rows_excluded"),
    )


def audit_table(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, most frequent format and medians of each group."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.mode("format", True).alias("format"))
    for column, name in (("width", "median_w"), ("height", "median_h"), ("quality", "median_q")):
        out = out.join(quantiles(df, by, column, [0.5]).select(*by, F.col("q")[0].alias(name)), by, "left")
    return out


def audit_flags(audit: DataFrame, source: str, y: str) -> DataFrame:
    """Pairs of sources (of opposite classes, or i < j of one class) whose median width
    differs by a ratio or whose median quality by a gap."""
    a = audit.select(F.col(source).alias("a"), F.col(y).alias("ya"), F.col("median_w").alias("wa"), F.col("median_q").alias("qa"))
    b = audit.select(F.col(source).alias("b"), F.col(y).alias("yb"), F.col("median_w").alias("wb"), F.col("median_q").alias("qb"))
    pairs = a.join(F.broadcast(b), (F.col("ya") < F.col("yb")) | ((F.col("ya") == F.col("yb")) & (F.col("a") < F.col("b"))))  # a row for each source and class
    ratio = F.greatest("wa", "wb") / F.least("wa", "wb")
    gap = F.abs(F.col("qa") - F.col("qb"))
    return pairs.withColumn("ratio", ratio).withColumn("gap", gap).filter((F.col("ratio") > RATIO_LIMIT) | (F.col("gap") > QUALITY_GAP)).select("a", "ya", "b", "yb", "ratio", "gap")


def manifest_problems(df: DataFrame, splits: list[str]) -> DataFrame:
    """One row of violation counts; a valid manifest has zeros only."""
    known = F.col("content_sha256") != ""
    flat = df.agg(
        F.count_if(~F.col("label").isin(0, 1) | F.col("label").isNull()).alias("bad_label"),
        F.count_if(~F.col("split").isin(splits)).alias("bad_split"),
        F.count_if(~F.col("path").startswith("/")).alias("relative_path"),
        F.count_if((F.col("label") == 1) & (F.col("generator") == "")).alias("fake_without_generator"),
        F.count_if((F.col("label") == 0) & (F.col("generator") != "")).alias("real_with_generator"),
        F.count_if(known & ~F.col("content_sha256").rlike("^[0-9a-f]{64}$")).alias("bad_digest"),
        F.when((F.count_if(known) > 0) & (F.count_if(~known) > 0), F.count_if(~known)).otherwise(0).alias("digest_missing"),
    )
    twice = df.groupBy("path").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_path"))
    return flat.crossJoin(twice)  # single rows


def straddling(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def grouped_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
