"""Checked joins, leak guards and near-duplicate search by Hamming distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalars import hamming


class Refused(ValueError):
    """Inputs that an operator won't combine."""


def join_scored(frames: list[DataFrame], names: list[str], key: str, score: str, agree: list[str]) -> DataFrame:
    """Inner join of scored frames on a unique key.

    Refuses duplicate keys, keys that one frame lacks, and columns of ``agree`` that
    differ. One aggregate over a full outer join finds all three.
    """
    sided = []
    for f, n in zip(frames, names, strict=True):
        one = f.groupBy(key).agg(F.count("*").alias(f"__c_{n}"), F.max(score).alias(f"{score}_{n}"), *[F.max(c).alias(f"__{c}_{n}") for c in agree])
        sided.append(one)
    wide = reduce(lambda a, b: a.join(b, key, "full"), sided)
    counts = [F.coalesce(F.col(f"__c_{n}"), F.lit(0)) for n in names]
    first = names[0]
    differ = reduce(lambda a, b: a | b, [F.col(f"__{c}_{first}") != F.col(f"__{c}_{n}") for c in agree for n in names[1:]], F.lit(False))
    found = wide.agg(
        F.count_if(F.greatest(*counts) > 1).alias("duplicate"), F.count_if(F.least(*counts) == 0).alias("missing"), F.count_if(differ).alias("disagreeing")
    ).first()
    if any(found):
        raise Refused(", ".join(f"{n} {k} keys" for k, n in found.asDict().items() if n))
    return wide.select(key, *[F.col(f"__{c}_{first}").alias(c) for c in agree], *[f"{score}_{n}" for n in names])


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join to a table of one row per key; a row without a match is an error."""
    out = facts.join(dimension.dropDuplicates([key]).withColumn("__hit", F.lit(1)), key, "left")
    if not out.filter("__hit is null").isEmpty():
        raise Refused("rows without a match")
    return out.drop("__hit")


def overlap(a: DataFrame, b: DataFrame, digest: str) -> DataFrame:
    """Rows of ``a`` whose digest is in ``b``; blank digests are ignored."""
    return a.filter(F.col(digest) != "").join(b.filter(F.col(digest) != "").select(digest).distinct(), digest, "left_semi")


def without(a: DataFrame, b: DataFrame, digest: str, order: str) -> DataFrame:
    """First row of each digest of ``a``, if ``b`` lacks the digest."""
    first = a.groupBy(digest).agg(F.min_by(F.struct(*[c for c in a.columns if c != digest]), order).alias("r")).select(digest, "r.*")
    return first.join(b.select(digest).distinct(), digest, "left_anti")


def drift(frozen: DataFrame, rebuilt: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): missing, extra or divergent rows between two manifests."""
    j = frozen.select(key, F.col(digest).alias("was")).join(rebuilt.select(key, F.col(digest).alias("now")), key, "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("was") != F.col("now"), "divergent")
    return j.withColumn("state", state).filter("state is not null").select(key, "state")


def hamming_exact(cands: DataFrame, demos: DataFrame, limit: int) -> DataFrame:
    """Pairs within a distance, compared one by one: for a small demo table only."""
    return cands.join(F.broadcast(demos), hamming(F.col("hash"), F.col("demo_hash")) <= limit)


def bands(h: Column, n: int) -> Column:
    """The n bit bands of a 64-bit hash, each with its number."""
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("band"), F.call_function("shiftrightunsigned", h, F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ])


def hamming_join(cands: DataFrame, demos: DataFrame, limit: int) -> DataFrame:
    """Pairs within ``limit`` bits: of limit + 1 bands one must be equal, so an
    equi-join on bands finds all of them and the distance is checked after. Each pair
    comes once, from its first equal band; no pair list is collected anywhere."""
    n = limit + 1
    a = cands.withColumn("__k", F.explode(bands(F.col("hash"), n))).select("*", "__k.band", "__k.bits").drop("__k")
    b = demos.withColumn("__k", F.explode(bands(F.col("demo_hash"), n))).select("*", "__k.band", "__k.bits").drop("__k")
    met = a.join(b, ["band", "bits"]).filter(hamming(F.col("hash"), F.col("demo_hash")) <= limit)
    same = F.array_position(F.zip_with(bands(F.col("hash"), n), bands(F.col("demo_hash"), n), lambda x, y: x == y), True) - 1
    return met.filter(F.col("band") == same).drop("band", "bits")


def first_leak(pairs: DataFrame, cand: str, demo: str, order: str) -> DataFrame:
    """Per candidate the first demo it matches."""
    return pairs.groupBy(cand).agg(F.min_by(demo, order).alias(demo))
