"""Caps, splits, balancing and shards, all decided by hash order.

Ranks within a group come from a window over the group; Spark's window group limit
drops rows past a small cap before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.hashing import SEED, drawn, order_key
from quillmark.operators.metrics import running

MIN_HELDOUT_ROWS = 200


def ranked(df: DataFrame, by: list, key: str, seed: int = SEED, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(order_key(seed, F.col(key)), F.col(key))))


def cap_by_map(df: DataFrame, by: str, caps: dict[str, int], key: str, where: Column | None = None, seed: int = SEED) -> DataFrame:
    """At most caps[value] rows of each value of ``by`` ("*" for others, 0: uncapped)
    among rows that satisfy ``where``; other rows stay. Unknown names are an error."""
    names = [n for n in caps if n != "*"]
    if names:
        found = {r[0] for r in df.filter(F.col(by).isin(names)).select(by).distinct().collect()}
        if set(names) - found:
            raise ValueError(f"caps for unknown {by}: {sorted(set(names) - found)}")
    cap = F.lit(caps.get("*", 0))
    for n in names:
        cap = F.when(F.col(by) == n, F.lit(caps[n])).otherwise(cap)
    scope = F.lit(True) if where is None else where
    rows = df.withColumn("__cap", F.when(scope, cap).otherwise(0))
    capped = ranked(rows.filter("__cap > 0"), [by], key, seed, "__rn").filter("__rn <= __cap").drop("__rn")
    return capped.unionByName(rows.filter("__cap = 0")).drop("__cap")


def choose_heldout(df: DataFrame, n: int, pseudo: list[str], seed: int = SEED, least: int = MIN_HELDOUT_ROWS) -> DataFrame:
    """``n`` generators with ``least`` rows or more, in hash order; '' and pseudo
    generators are never held out. Too few of them are an error."""
    sizes = df.filter((F.col("generator") != "") & ~F.col("generator").isin(pseudo or [""])).groupBy("generator").count().filter(F.col("count") >= least)
    out = sizes.orderBy(order_key(seed, F.col("generator"))).limit(n).select("generator")
    if out.count() < n:
        raise ValueError(f"fewer than {n} generators have {least} rows")
    return out


def assign_splits(df: DataFrame, heldout: list[str], fraction: float, group: str, seed: int = SEED) -> DataFrame:
    """``split`` by one draw per group; a group with a held-out row is held out whole."""
    held = F.max(F.col("generator").isin(heldout).cast("int")).over(W.partitionBy(group)) == 1
    return df.withColumn("split", F.when(held, "heldout_generator").when(drawn(fraction, seed, F.col(group)), "val_internal").otherwise("train"))


def balance_within(df: DataFrame, strata: list[str], y: str, key: str, seed: int = SEED) -> DataFrame:
    """Per stratum as many rows of either class as the scarcer one has."""
    sizes = df.groupBy(*strata).agg(F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("__a"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("__g"))
    rows = df.join(sizes, strata).withColumn("__take", F.least("__a", "__g")).filter("__take > 0")
    return ranked(rows, [*strata, y], key, seed, "__rn").filter("__rn <= __take").drop("__rn", "__take", "__a", "__g")


def water_fill(sizes: dict, total: int) -> dict:
    """Shares of ``total`` over strata, as even as sizes allow (ties by name)."""
    left, out = dict(sizes), {k: 0 for k in sizes}
    total = min(total, sum(sizes.values()))
    while total > 0:
        open_ = sorted(k for k in left if left[k] > 0)
        each = max(1, total // len(open_))
        for k in open_:
            take = min(each, left[k], total)
            out[k], left[k], total = out[k] + take, left[k] - take, total - take
    return out


def stratified(df: DataFrame, strata: list[str], total: int, key: str, seed: int = SEED) -> DataFrame:
    """``total`` rows, spread over strata by water-filling (the strata table is small
    by contract: it is one row per stratum)."""
    sizes = {tuple(r[:-1]): r[-1] for r in df.groupBy(*strata).count().collect()}
    take = water_fill(sizes, total)
    spark = df.sparkSession
    plan = spark.createDataFrame([(*k, n) for k, n in sorted(take.items())], [*strata, "__take"])
    rows = df.join(plan, strata)
    return ranked(rows, strata, key, seed, "__rn").filter("__rn <= __take").drop("__rn", "__take")


def thin(df: DataFrame, strata: list[str], fraction: float, key: str, seed: int = SEED) -> DataFrame:
    """A share of each stratum, one row at least."""
    n = F.count("*").over(W.partitionBy(*strata))
    rows = ranked(df.withColumn("__n", n), strata, key, seed, "__rn")
    return rows.filter(F.col("__rn") <= F.greatest(F.lit(1), F.rint(F.col("__n") * fraction))).drop("__rn", "__n")


def exact_share(df: DataFrame, by: list[str], fraction: float, key: str, seed: int = SEED, name: str = "val") -> DataFrame:
    """Marks exactly rint(n * fraction) rows of each group."""
    n = F.count("*").over(W.partitionBy(*by))
    rows = ranked(df.withColumn("__n", n), by, key, seed, "__rn")
    return rows.withColumn(name, F.col("__rn") <= F.rint(F.col("__n") * fraction)).drop("__rn", "__n")


def limit_in_order(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """``n`` rows in hash order (a top-n, so tasks keep n rows each)."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def shards(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """Contiguous shards of near-equal size in ``row_id`` order.

    Positions are running counts by blocks of ids, so that no window spans all rows.
    """
    rows = running(df.withColumn("__one", F.lit(1)), [], row_id, ["__one"])
    pos, base, extra = F.col("__one_below"), F.floor(F.col("__one_all") / n), F.pmod(F.col("__one_all"), F.lit(n))
    shard = F.when(pos < extra * (base + 1), F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    return rows.withColumn("shard", shard.cast("int")).drop("__one", "__one_below", "__one_all")


def apportion(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Largest remainders, one each at least."""
    weight = sum(shares.values())
    exact = {k: total * v / weight for k, v in shares.items()}
    out = {k: max(1, math.floor(v)) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - math.floor(exact[k])), k)):
        if sum(out.values()) >= total:
            break
        out[k] += 1
    return out


def dealt_families(pool: DataFrame, strata: list[str], pattern: list[str], key: str, counts: dict[str, int], seed: int = SEED) -> DataFrame:
    """Deal each stratum's rows, in hash order, to families by a repeating pattern; of
    each family the first counts[family] rows in hash order. Larger counts extend a
    selection and never reshuffle it."""
    rows = ranked(pool, strata, key, seed, "__rn")
    family = F.element_at(F.array(*[F.lit(p) for p in pattern]), (F.pmod(F.col("__rn") - 1, F.lit(len(pattern))) + 1).cast("int"))
    dealt = ranked(rows.withColumn("family", family), ["family"], key, seed, "__take")
    cap = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    return dealt.filter(F.col("__take") <= F.coalesce(F.element_at(cap, F.col("family")), F.lit(0))).drop("__rn", "__take")


def balanced_weights(df: DataFrame, y: str, family: str) -> DataFrame:
    """Sampling weight 1 / (classes * families of the class * rows of the family)."""
    cells = df.groupBy(y, family).agg(F.count("*").alias("__m"))
    per = cells.groupBy(y).agg(F.count("*").alias("__f"))
    k = F.lit(1.0) / df.select(y).distinct().count()
    plan = cells.join(per, y).select(y, family, (k / F.col("__f") / F.col("__m")).alias("weight"))
    return df.join(plan, [y, family])
