"""Image-level and matched comparisons, recipes, conditions, views and small guards."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.operators.joins import Refused
from quillmark.operators.metrics import FPR, quantiles, roc_auc, tpr_at_fpr

#: Short names of families, in the order of recipe label vectors.
FAMILIES = ("jpeg", "blur", "resize", "noise", "jitter", "crop")
#: Fixed values: (parameter, value of severity 0, value of severity 1) of the six core ops.
SEVERITY = {"jpeg": ("quality", 100.0, 30.0), "blur": ("sigma", 0.0, 2.0), "resize": ("scale", 1.0, 0.25), "noise": ("sigma", 0.0, 0.10), "jitter": ("amount", 0.0, 0.20), "crop": ("frac", 1.0, 0.80)}
#: Composite conditions of the evaluation grid, each a chain of (op, value).
COMPOSITES = {
    "social_repost": [("resize", 0.5), ("jpeg", 70.0)],
    "messaging_app": [("resize", 0.25), ("jpeg", 30.0)],
    "screenshot": [("crop", 0.8), ("resize", 0.5), ("jpeg", 50.0)],
    "filtered_upload": [("jitter", 0.2), ("jpeg", 70.0)],
    "low_light_share": [("noise", 0.05), ("jpeg", 50.0)],
}


def fpr_label(fpr: float = FPR) -> str:
    """An operating point as a percentage, such as 1% or 0.5%."""
    if not 0 < fpr < 1:
        raise ValueError("a false-positive rate lies between 0 and 1")
    return f"{format(fpr * 100, 'g')}%"


def tpr_column(fpr: float = FPR) -> str:
    return "tpr_at_" + fpr_label(fpr).replace("%", "pct")


def normalised_name(name: Column) -> Column:
    """Spelling by which aliases are compared: lower case, _ for -, no .csv, no outer blanks."""
    return F.translate(F.regexp_replace(F.lower(F.trim(name)), r"\.csv$", ""), "-", "_")


def resolve_aliases(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the subset that each one means; an unknown name is an error.

    ``aliases`` (subset, aliases array) is one row a subset.
    """
    table = aliases.select("subset", F.explode(F.array_union(F.array("subset"), "aliases")).alias("a")).select("subset", normalised_name(F.col("a")).alias("__key")).distinct()
    out = names.withColumn("__key", normalised_name(F.col(name))).join(table, "__key", "left").drop("__key")
    if not out.filter("subset is null").isEmpty():
        raise Refused("unknown names")
    return out


def over_budget(sizes: DataFrame, subset: str, gb: str, budget: float) -> DataFrame:
    """(subset, gb, refused): the sum of its archives, null if one is unknown, and whether
    it is over the budget (an unknown size isn't refused)."""
    total = F.when(F.count_if(F.col(gb).isNull()) == 0, F.sum(gb))
    return sizes.groupBy(subset).agg(total.alias("gb")).withColumn("refused", F.coalesce(F.col("gb") > budget, F.lit(False)))


def reproducible(mode: Column, n_tables: Column, subsampling: Column) -> Column:
    """Whether an encoder can be repeated exactly: RGB, two tables, a named subsampling."""
    return (mode == "RGB") & (n_tables == 2) & subsampling.isin(0, 1, 2)


def parity(pairs: DataFrame, key: str, label: str, fields: list[str]) -> DataFrame:
    """(key, differs): fields in which the real and the fake row of a pair differ; pairs
    that agree, or lack a side, give no row."""
    sides = pairs.groupBy(key).agg(*[F.max(F.when(F.col(label) == v, F.struct(*fields))).alias(n) for v, n in ((0, "r"), (1, "f"))])
    both = sides.filter("r is not null and f is not null")
    names = F.filter(F.array(*[F.when(~F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return both.select(key, names.alias("differs")).filter(F.size("differs") > 0)


def without_generators(df: DataFrame, names: list[str], generator: str = "generator") -> DataFrame:
    """Rows of other generators; an absent name, or nothing left, is an error."""
    got = df.agg(*[F.count_if(F.col(generator) == n).alias(f"n{i}") for i, n in enumerate(names)], F.count_if((F.col(generator) != "") & ~F.col(generator).isin(names)).alias("rest")).first()
    absent = [n for i, n in enumerate(names) if not got[f"n{i}"]]
    if absent or not got["rest"]:
        raise Refused(f"absent generators {absent}" if absent else "no generator would be left")
    return df.filter(~F.col(generator).isin(names))


def positional(a: DataFrame, b: DataFrame, row_id: str, agree: list[str]) -> DataFrame:
    """Rows of both frames by their row number; a number that one side lacks, or a column
    of ``agree`` that differs, is an error."""
    theirs = b.select(F.col(row_id).alias("__id"), *[F.col(c).alias(f"__{c}" if c in agree else c) for c in b.columns if c != row_id], F.lit(1).alias("__b"))
    both = a.withColumn("__a", F.lit(1)).join(theirs, a[row_id] == F.col("__id"), "full")
    bad = F.col("__a").isNull() | F.col("__b").isNull()
    for c in agree:
        bad = bad | ~a[c].eqNullSafe(F.col(f"__{c}"))
    if not both.filter(bad).isEmpty():
        raise Refused("rows that don't agree by position")
    return both.drop("__id", "__a", "__b", *[f"__{c}" for c in agree])


def split_of(scores: DataFrame, splits: DataFrame, index: str, split: str) -> DataFrame:
    """``scores`` with the split at their index; an index out of bounds is an error."""
    out = scores.join(splits.select(F.col("position").alias(index), F.col("split").alias(split)), index, "left")
    if not out.filter(F.col(split).isNull()).isEmpty():
        raise Refused("an index is out of bounds")
    return out


def validation_tpr(grid: DataFrame, fpr: float = FPR) -> DataFrame:
    """Mean TPR over degraded conditions, both classes from val_internal; a condition of
    one class is an error."""
    rows = grid.filter((F.col("condition") != "clean") & (F.col("split") == "val_internal"))
    each = tpr_at_fpr(rows, ["condition"], fpr=fpr)
    return each.agg(F.assert_true(F.count_if(F.col("tpr").isNull()) == 0, "a condition has one class only").alias("_"), F.avg("tpr").alias("objective")).drop("_")


#: Numbers of a hash's Poisson(1) steps.
_POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253])


def _weights(keys: np.ndarray, n_boot: int) -> np.ndarray:
    """Poisson(1) weights (row, replicate), decided by key and replicate alone."""
    x = keys.astype(np.uint64)[:, None] + (np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(_POISSON, u.ravel(), side="right").reshape(u.shape).astype(np.int64)


def auc_draws(long: DataFrame, n_boot: int, arm: str = "arm", y: str = "y", s: str = "s", key: str = "key") -> DataFrame:
    """(arm, replicate, auc) of Poisson bootstrap draws; arms share a key's weights.

    Rows are range-partitioned by arm and score; a task adds up weights of sorted rows for
    all replicates at once and gives one row of totals a run of an arm, and totals of the
    runs before are added by a window over runs. Rows are never multiplied by replicates.
    """

    def run(batches):
        parts: dict[str, list[np.ndarray]] = {}
        lows: dict[str, float] = {}
        tied: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}

        def close(name):
            """Count a finished run of equal scores."""
            _, p, n = tied.pop(name)
            tot = parts.setdefault(name, [np.zeros(n_boot, np.int64), np.zeros(n_boot, np.int64), np.zeros(n_boot)])
            tot[2] += p * (tot[1] + 0.5 * n)
            tot[0] += p
            tot[1] += n

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            scores, labels, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            for at in range(0, len(names), 512):
                piece = slice(at, at + 512)
                w = _weights(keys[piece], n_boot)
                a, v, pos = names[piece], scores[piece], labels[piece] == 1
                starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (v[1:] != v[:-1])))
                p, n = np.add.reduceat(w * pos[:, None], starts, axis=0), np.add.reduceat(w * ~pos[:, None], starts, axis=0)
                for j, k in enumerate(starts.tolist()):
                    name, value = a[k], float(v[k])
                    lows.setdefault(name, value)
                    if name in tied and tied[name][0] == value:
                        tied[name] = (value, tied[name][1] + p[j], tied[name][2] + n[j])
                    else:
                        if name in tied:
                            close(name)
                        tied[name] = (value, p[j], n[j])
        for name in list(tied):
            close(name)
        for name, (p, n, won) in parts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([lows[name]]), pa.array([p.tolist()]), pa.array([n.tolist()]), pa.array([won.tolist()])], names=["arm", "low", "p", "n", "won"]
            )

    rows = long.select(F.col(arm).cast("string"), F.col(s).cast("double"), F.col(y).cast("int"), F.xxhash64(key).alias("__k"))
    parts = rows.repartitionByRange(arm, s).sortWithinPartitions(arm, s).mapInArrow(run, "arm string, low double, p array<long>, n array<long>, won array<double>")
    each = parts.select("arm", "low", F.posexplode(F.arrays_zip("p", "n", "won")).alias("replicate", "x")).select("arm", "low", "replicate", "x.*")
    before = W.partitionBy("arm", "replicate").orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    whole = each.withColumn("w", F.col("won") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = whole.groupBy("arm", "replicate").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.filter("p > 0 and n > 0").select("arm", (F.col("replicate") + 1).alias("replicate"), (F.col("w") / F.col("p") / F.col("n")).alias("auc"))


def stacked(df: DataFrame, arms: list[str], y: str, key: str) -> DataFrame:
    """One row an arm: (arm, s, y, key)."""
    pairs = ", ".join(f"'{a}', cast({a} as double)" for a in arms)
    return df.select(F.col(y).alias("y"), F.col(key).alias("key"), F.expr(f"stack({len(arms)}, {pairs}) as (arm, s)"))


def decile_auc(df: DataFrame, value: str, y: str, s: str, n_bins: int = 10) -> DataFrame:
    """(n_used, deciles, auc): mean AUC within equal-count bins of ``value``, weighted by
    their rows; bins of one class are left out."""
    cuts = quantiles(df, [], value, [i / n_bins for i in range(n_bins + 1)], "e").select(F.array_distinct("e").alias("e"))
    inner = F.expr("slice(e, 2, greatest(size(e) - 2, 0))")
    binned = df.crossJoin(F.broadcast(cuts.select(inner.alias("__e")))).withColumn("decile", F.size(F.filter("__e", lambda x: x <= F.col(value))))  # one row of cuts
    each = roc_auc(binned, ["decile"], y, s).join(binned.groupBy("decile").agg(F.count("*").alias("n")), "decile").filter("auc is not null")
    return each.agg(F.sum("n").alias("n_used"), F.count("*").alias("deciles"), (F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc"))


def recipe_labels(ops: Column) -> Column:
    """struct(presence, severity) of an array of (name, value) ops, by FAMILIES; of a family
    that occurs twice the harsher counts."""

    def severity(name: str) -> Column:
        _, low, high = SEVERITY[name]
        own = F.filter(ops, lambda o: o["name"] == name)
        scaled = F.transform(own, lambda o: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.abs(o["value"]) - low) / (high - low))))
        return F.coalesce(F.array_max(scaled), F.lit(0.0))

    present = [F.array_contains(F.transform(ops, lambda o: o["name"]), n).cast("int") for n in FAMILIES]
    return F.struct(F.array(*present).alias("presence"), F.array(*[severity(n) for n in FAMILIES]).alias("severity"))


def composite_conditions(df: DataFrame, conditions: dict[str, list[tuple[str, float]]] = COMPOSITES) -> DataFrame:
    """Every row under every condition, with its chain of ops."""
    cells = [F.struct(F.lit(n).alias("condition"), F.array(*[F.struct(F.lit(o).alias("name"), F.lit(float(v)).alias("value")) for o, v in ops]).alias("ops")) for n, ops in conditions.items()]
    return df.withColumn("__c", F.explode(F.array(*cells))).select("*", "__c.condition", "__c.ops").drop("__c")


def views(df: DataFrame, names: list[str]) -> DataFrame:
    """A row for each view, numbered."""
    return df.select("*", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("view_idx", "view"))


def check_views(params: dict[str, list[tuple[str, float]]], bands: dict[str, tuple[float, float]]) -> None:
    """Refuses a view that applies a severity inside a held-out band."""
    for name, steps in params.items():
        for family, value in steps:
            if family in bands and bands[family][0] <= value <= bands[family][1]:
                raise Refused(f"view {name}: {family}={value} is held out")


def numeric_order(key: Column) -> list[Column]:
    """Sort order of strata: numbers by value first, then names."""
    number = key.try_cast("double")
    return [number.isNull(), number, key]


def identity_column(df: DataFrame, candidates: tuple[str, ...] = ("row_id", "rel_path", "path")) -> str | None:
    """The first candidate whose values are all different; None if none is."""
    for c in (c for c in candidates if c in df.columns):
        got = df.groupBy(c).count().filter("count > 1").isEmpty()
        if got:
            return c
    return None


def cumulative(df: DataFrame, by: list[str], y: str, s: str) -> DataFrame:
    """(by, s, tp, fp) at each score, from the highest down, ties together."""
    from quillmark.operators.metrics import roc_points

    return roc_points(df, by, y, s).select(*by, "s", "tp", "fp")


def flatness(sweep: DataFrame, value: str, margin: float) -> DataFrame:
    """(best, n_near, n): the best objective and how many weights come within a margin of it."""
    best = sweep.agg(F.max(value).alias("best"))
    return sweep.crossJoin(F.broadcast(best)).groupBy("best").agg(F.count_if(F.col(value) >= F.col("best") - margin).alias("n_near"), F.count("*").alias("n"))  # one row


def simplex_sweep(df: DataFrame, parents: list[str], y: str, weights: list[tuple[float, ...]]) -> DataFrame:
    """(weights, auc) of the weighted mean of ``parents`` at every lattice point."""
    plan = df.sparkSession.createDataFrame([(",".join(f"{x:g}" for x in w), [float(x) for x in w]) for w in weights], "weights string, w array<double>")
    rows = df.crossJoin(F.broadcast(plan))  # one row a lattice point, made by the driver
    fused = reduce(lambda a, b: a + b, [F.col(p) * F.col("w")[i] for i, p in enumerate(parents)])
    return roc_auc(rows.withColumn("__f", fused), ["weights"], y, "__f")


def per_group_against_all_reals(df: DataFrame, group: Column, y: str, s: str) -> DataFrame:
    """(grp, n_fake, n_real, auc) of each group's fakes against all authentic rows.

    With the authentic rows' distribution counted once, a group's AUC is the mean over its
    fakes of the share of authentic scores below (ties by half).
    """
    from quillmark.operators.metrics import running

    reals = F.when(F.col(y) == 0, 1).otherwise(0)
    scores = df.groupBy(F.col(s).alias("s")).agg(F.sum(reals).alias("n"))
    ranks = running(scores, [], "s", ["n"]).select("s", ((F.col("n_below") + F.col("n") * 0.5) / F.col("n_all")).alias("won"), F.col("n_all").alias("n_real"))
    fakes = df.filter(F.col(y) == 1).select(group.alias("grp"), F.col(s).alias("s"))
    return fakes.join(ranks, "s").groupBy("grp").agg(F.count("*").alias("n_fake"), F.max("n_real").alias("n_real"), F.avg("won").alias("auc"))


def psnr(a: Column, b: Column, peak: float) -> Column:
    """Peak signal to noise ratio in dB of two arrays; null where they are equal."""
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(mse > 0, F.log10(F.lit(peak * peak) / mse) * 10)


def row_losses(p: Column, y: Column, teacher: Column) -> dict[str, Column]:
    """Cross-entropy, divergence from a teacher's probability, and their squared gap."""
    q, t = (F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), c)) for c in (p, teacher))
    bce = -(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))
    kl = t * F.ln(t / q) + (F.lit(1.0) - t) * F.ln((F.lit(1.0) - t) / (F.lit(1.0) - q))
    return {"bce": bce, "kl": kl, "mse": (q - t) * (q - t)}


def verdict(low2: Column, high2: Column, rise_low: Column, rise_high: Column, lows: list[Column], margin: float) -> Column:
    """Registered rule on intervals of a reduction: equivalent to zero at the weakest level
    and rising, above zero everywhere, nowhere, or unresolved."""
    zero2 = (low2 <= 0) & (high2 >= 0) & (low2 >= -margin) & (high2 <= margin)
    none = reduce(lambda a, b: a & b, [x <= 0 for x in lows]) & (rise_low <= 0) & (rise_high >= 0)
    return F.when(zero2 & (rise_low > 0), "STRONG-ONLY").when(low2 > 0, "EVERYWHERE").when(none, "NONE").otherwise("UNRESOLVED")
