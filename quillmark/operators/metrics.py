"""Grouped score metrics: ROC family, calibration, risk and coverage.

All of them aggregate to one row per distinct score of a group first, with a map-side
partial sum. Running sums over a group go by blocks of neighbouring scores (see
:func:`running`), so that no task ever sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FPR = 0.01


def _by_score(df: DataFrame, by: list[str], y: str, s: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(s).isNotNull()).groupBy(*by, F.col(s).alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n")
    )


def _key(by: list[str]) -> list:
    return [F.col(b) for b in by] or [F.lit(1)]


#: Blocks of a group of scores.
BLOCKS = 64


def running(rows: DataFrame, by: list[str], value: str, sums: list[str], other: list[str] | None = None) -> DataFrame:
    """``rows`` with {name}_below, the sum over rows of the group with a smaller value, and
    {name}_all, that over the group, for each name of ``sums``.

    Rows of a group are cut into BLOCKS by approximate quantiles of the value. Block sums
    are added up in order, at most BLOCKS + 1 rows a group, and the rows of a block within
    it; where the cuts lie doesn't show in the result. ``other``: further order columns
    that tell rows of equal value apart.
    """
    order = [value, *(other or [])]
    cuts = [i / BLOCKS for i in range(1, BLOCKS)]
    edges = rows.groupBy(*by).agg(F.percentile_approx(value, cuts, 2000).alias("__edges"))
    placed = rows.join(edges, by) if by else rows.crossJoin(F.broadcast(edges))  # one row without groups
    placed = placed.withColumn("__block", F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")
    blocks = placed.groupBy(*by, "__block").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = W.partitionBy(*_key(by)).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*_key(by))
    starts = blocks.select(
        *by, "__block", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_start") for c in sums], *[F.sum(f"__{c}").over(whole).alias(f"{c}_all") for c in sums]
    )
    joined = placed.join(starts, [*by, "__block"])
    within = W.partitionBy(*by, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    below = {f"{c}_below": F.col(f"__{c}_start") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}
    return joined.withColumns(below).drop("__block", *[f"__{c}_start" for c in sums])


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], name: str = "q") -> DataFrame:
    """(by, name): exact quantiles with linear interpolation, as an array.

    Two ranks of a quantile are looked up among running counts of distinct values; no
    task holds the values of a group.
    """
    rows = running(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n")), by, "__v", ["__n"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__n_below") <= rank) & (rank < F.col("__n_below") + F.col("__n")), F.col("__v")))

    places = [F.lit(float(p)) * (F.col("__n_all") - 1) for p in probs]
    found = rows.groupBy(*by).agg(F.max("__n_all").alias("__n_all"), *[at(f(h)).alias(f"__{side}{i}") for i, h in enumerate(places) for side, f in (("lo", F.floor), ("hi", F.ceil))])
    parts = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (h - F.floor(h)) for i, h in enumerate(places)]
    return found.select(*by, F.array(*parts).alias(name))


def roc_auc(df: DataFrame, by: list[str], y: str = "label", s: str = "score", name: str = "auc") -> DataFrame:
    """Mann-Whitney AUC with averaged ties; null where a group has one class."""
    rows = running(_by_score(df, by, y, s), by, "s", ["n"])
    won = rows.withColumn("w", F.col("p") * (F.col("n_below") + F.col("n") * 0.5))
    total = won.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*by, F.try_divide(F.col("w").cast("double"), F.col("p").cast("double") * F.col("n")).alias(name))


def leak_auc(df: DataFrame, by: list[str], y: str = "label", s: str = "score", name: str = "auc") -> DataFrame:
    """AUC whichever way a feature points: max(a, 1 - a)."""
    return roc_auc(df, by, y, s, name).withColumn(name, F.greatest(F.col(name), F.lit(1.0) - F.col(name)))


def roc_points(df: DataFrame, by: list[str], y: str = "label", s: str = "score") -> DataFrame:
    """(by, s, tp, fp, p, n): counts at threshold s (score >= s) and in the group."""
    rows = running(_by_score(df, by, y, s), by, "s", ["p", "n"])
    return rows.select(
        *by, "s", (F.col("p_all") - F.col("p_below")).alias("tp"), (F.col("n_all") - F.col("n_below")).alias("fp"), F.col("p_all").alias("np"), F.col("n_all").alias("nn")
    )


def tpr_at_fpr(df: DataFrame, by: list[str], y: str = "label", s: str = "score", fpr: float = FPR) -> DataFrame:
    """(by, threshold, tpr): the lowest threshold whose FPR is within ``fpr``, and the
    share of positives at it. Where no threshold is, the one above all scores with TPR
    0; null where a group has one class."""
    points = roc_points(df, by, y, s)
    ok = F.col("fp") <= F.lit(fpr) * F.col("nn")
    out = points.groupBy(*by).agg(
        F.min(F.when(ok, F.col("s"))).alias("lo"), F.max("s").alias("top"), F.max(F.when(ok, F.col("tp"))).alias("tp"), F.max("np").alias("np"), F.max("nn").alias("nn")
    )
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return out.select(
        *by,
        F.when(both, F.coalesce("lo", F.col("top") + 1)).alias("threshold"),
        F.when(both, F.coalesce("tp", F.lit(0)).cast("double") / F.col("np")).alias("tpr"),
    )


def tpr_neg_quantile(df: DataFrame, by: list[str], y: str = "label", s: str = "score", fpr: float = FPR) -> DataFrame:
    """The other definition: the threshold is the negative at ascending position
    ceil((1 - fpr) n) (from 0, the last at most); TPR counts scores strictly above."""
    rows = _by_score(df, by, y, s)
    up = W.partitionBy(*_key(by)).orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*_key(by))
    cum = rows.select(*by, "s", "p", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("nn"), F.sum("p").over(whole).alias("np"))
    at = F.least(F.col("nn") - 1, F.ceil((F.lit(1.0) - F.lit(fpr)) * F.col("nn")))
    placed = cum.withColumn("thr", F.min(F.when(F.col("upto") > at, F.col("s"))).over(whole))
    out = placed.groupBy(*by).agg(F.max("thr").alias("threshold"), F.sum(F.when(F.col("s") > F.col("thr"), F.col("p")).otherwise(0)).alias("tp"), F.max("np").alias("np"), F.max("nn").alias("nn"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return out.select(*by, F.when(both, F.col("threshold")).alias("threshold"), F.when(both, F.col("tp").cast("double") / F.col("np")).alias("tpr"))


def tpr_guarded(df: DataFrame, by: list[str], y: str = "label", s: str = "score", fpr: float = FPR, least: int = 100) -> DataFrame:
    """The variant for arrays of reals and fakes: null below ``least`` reals; threshold
    at the linear quantile 1 - fpr of the reals, TPR strictly above it."""
    negatives = df.filter(F.col(y) == 0)
    counted, cuts = negatives.groupBy(*by).agg(F.count("*").alias("reals")), quantiles(negatives, by, s, [1 - fpr])
    reals = (counted.join(cuts, by) if by else counted.crossJoin(cuts)).withColumn("threshold", F.col("q")[0])  # single rows without groups
    positives = df.filter(F.col(y) == 1)
    return (positives.join(reals, by) if by else positives.crossJoin(F.broadcast(reals))).groupBy(*by).agg(
        F.max("threshold").alias("threshold"), F.avg((F.col(s) > F.col("threshold")).cast("double")).alias("tpr"), F.max("reals").alias("reals")
    ).withColumn("tpr", F.when(F.col("reals") >= least, F.col("tpr")))


def best_accuracy(df: DataFrame, by: list[str], y: str = "label", s: str = "score") -> DataFrame:
    """(by, threshold, accuracy): the threshold of best accuracy, the lowest on ties;
    one above all scores stands for calling everything negative."""
    points = roc_points(df, by, y, s)
    all_neg = points.groupBy(*by).agg(F.max("s").alias("top"), F.max("np").alias("np"), F.max("nn").alias("nn")).select(
        *by, (F.col("top") + 1).alias("s"), F.col("nn").alias("ok"), (F.col("np") + F.col("nn")).alias("m")
    )
    each = points.select(*by, "s", (F.col("tp") + F.col("nn") - F.col("fp")).alias("ok"), (F.col("np") + F.col("nn")).alias("m"))
    best = each.union(all_neg).groupBy(*by).agg(F.max(F.struct(F.col("ok"), (-F.col("s")).alias("neg"))).alias("b"), F.max("m").alias("m"))
    return best.select(*by, (-F.col("b.neg")).alias("threshold"), (F.col("b.ok").cast("double") / F.col("m")).alias("accuracy"))


def accuracy_at(y: Column, s: Column, threshold: Column) -> Column:
    return F.avg((F.when(s >= threshold, 1).otherwise(0) == y).cast("double"))


def ece(df: DataFrame, by: list[str], y: str = "label", p: str = "p", bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    cells = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("m"), F.avg(F.col(y).cast("double")).alias("hit"), F.avg(p).alias("said"))
    return cells.groupBy(*by).agg((F.sum(F.col("m") * F.abs(F.col("hit") - F.col("said"))) / F.sum("m")).alias("ece"))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y.cast("double")) * (p - y.cast("double")))


def average_precision(df: DataFrame, by: list[str], y: str = "label", s: str = "score") -> DataFrame:
    # each positive counts the precision at its own score
    rows = running(_by_score(df, by, y, s), by, "s", ["p", "n"])
    tp, fp = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    return rows.withColumn("g", F.col("p").cast("double") / F.col("p_all") * tp / (tp + fp)).groupBy(*by).agg(F.sum("g").alias("ap"))


def risk_coverage(df: DataFrame, by: list[str], correct: str, confidence: str, row_id: str) -> DataFrame:
    """(by, row_id, coverage, risk) as rows are taken in order of confidence."""
    one = df.select(*by, row_id, (-F.col(confidence)).alias("__v"), (F.lit(1) - F.col(correct)).alias("__wrong"), F.lit(1).alias("__one"))
    rows = running(one, by, "__v", ["__wrong", "__one"], [row_id])
    taken = (F.col("__one_below") + 1).cast("double")
    return rows.select(*by, row_id, (taken / F.col("__one_all")).alias("coverage"), ((F.col("__wrong_below") + F.col("__wrong")) / taken).alias("risk"))


def aurc(curve: DataFrame, by: list[str], row_id: str) -> DataFrame:
    """Area under a risk-coverage curve by trapezoids."""
    # risk * taken is the number of errors so far, so a point's predecessor is known from
    # the point itself: no order is needed
    rows = curve.join(curve.groupBy(*by).agg(F.count("*").alias("__all")), by) if by else curve.crossJoin(F.broadcast(curve.agg(F.count("*").alias("__all"))))
    taken = F.rint(F.col("coverage") * F.col("__all"))
    wrong = F.rint(F.col("risk") * taken)
    marked = rows.select(*by, "risk", taken.alias("t"), wrong.alias("w"), F.col("__all"))
    later = marked.select(*by, (F.col("t") - 1).alias("t"), F.col("risk").alias("next"))
    strips = marked.join(later, [*by, "t"]).withColumn("strip", (F.col("risk") + F.col("next")) * 0.5 / F.col("__all"))
    return strips.groupBy(*by).agg(F.sum("strip").alias("aurc"))


def mean_rank(df: DataFrame, by: list[str], s: str, name: str = "rank", percent: bool = False) -> DataFrame:
    """Rank with ties averaged, from 1; as a share of the group if ``percent``."""
    ties = running(df.filter(F.col(s).isNotNull()).groupBy(*by, s).agg(F.count("*").alias("__m")), by, s, ["__m"])
    rank = F.col("__m_below") + (F.col("__m") + 1) * 0.5
    table = ties.select(*by, s, (rank / F.col("__m_all") if percent else rank.cast("double")).alias(name))
    return df.join(table, [*by, s], "left")


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    ranked = mean_rank(mean_rank(df, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(F.corr("__ra", "__rb").alias("spearman"))


#: Metrics that a bootstrap can be asked for by name.
METRICS = {"auc": roc_auc, "tpr_at_fpr": tpr_at_fpr, "tpr_neg_quantile": tpr_neg_quantile, "ap": average_precision}
