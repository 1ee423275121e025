"""Exact Jaccard join on word shingles by T-occurrence search (DivideSkip).

Two sets link when they share T = ceil(3 (n + m) / 7) shingles or more (similarity
0.75). A document's inverted lists are divided: its p = n - ceil(3n / 4) + 1 rarest
shingles have the short lists, which are merged in sorted order while occurrences are
counted (the merge is a sort-merge over the cluster), and only documents found often
enough for T to be in reach are probed in the long lists of the other shingles, by
binary search. "Rarest" is one global order: shingles known as frequent come last,
the others by hash, so that of two short parts that which ends earlier holds all common
shingles up to its end, and the count plus its long lists bounds the overlap.

Only what decides components is searched. Equal sets form one class. Each class that
shares short lists is tested against one center, the document it meets most often, and
becomes a member of the center's family if they are alike. Members of one family are
compared by their differences D from the center C only:
|A & B| = |A & C| + |B & C| - |C| + |D_A & D_B|, so a pair links if its differences share
T + |C| - |A & C| - |B & C| entries or more. That is positive unless both link with C and
are in one component already, so a prefix of the rarest differences finds every pair, and
a large group of near copies isn't squared. A set of another family that meets a crowd of
members in a short list is a guest of that family: it is compared with the center, once,
and meets the members by its differences as well, never each of them in the list. All
other pairs between components meet in the short lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm import io
from quillmark.llm.textkit import ASCII_LOWER, mix64, segment_hash, shingles, slices, string_buffers, words

SHINGLE = 5
#: A shingle is frequent from so many short lists on; at most FREQUENT_MOST of them are
#: kept apart (the bound rises with the table), which limits the broadcast to 8 MB. They
#: are looked for this many times, since setting some apart makes room for others.
FREQUENT_LEAST, FREQUENT_MOST, FREQUENT_PASSES = 32, 1_000_000, 2
#: Parts of a frequent shingle's list; members of one family in a list from which on they
#: are kept apart from the rest of the list.
SALTS, GROUP = 64, 64
#: A class is tested against a center if a TEST-th of its shingles is in shared short
#: lists, and joins its family if they share a FAMILY-th of the sum of both sizes.
TEST, FAMILY = 10, 5
U64 = np.uint64


def sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as unsigned 64 bits) of each text of a slice."""
    lowered = ASCII_LOWER[data]
    starts, ends, doc = words(lowered, offsets)
    n = len(offsets) - 1
    d, h = shingles(segment_hash(lowered, starts, ends), doc, n, SHINGLE)
    if len(d) and (d[1:] < d[:-1]).any():
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
    at = np.searchsorted(d, np.arange(n + 1))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _each_set(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = string_buffers(column)
    for a, b in slices(offsets):
        yield a, b, sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def node_of(s: np.ndarray, seed: int = 0) -> int:
    """Digest of a set under a seed; two seeds give independent digests."""
    turn = U64((0x5851F42D4C957F2D * (2 * seed + 1)) & (2**64 - 1))
    total = int(np.add.reduce(mix64(s ^ turn))) + len(s) * 0x9E3779B97F4A7C15
    other = int(np.add.reduce(mix64(mix64(s) + turn)))
    mixed = mix64(np.array([(total ^ (other << 1)) & (2**64 - 1)], dtype=U64))
    return int(mixed.view(np.int64)[0])


def short_size(n: np.ndarray | int):
    """Short lists of a set of n shingles: n - ceil(3n / 4) + 1."""
    return n - (3 * n + 3) // 4 + 1


def needed(n: int, m: int) -> int:
    """Least overlap T of linked sets: 100 i >= 75 (n + m - i)."""
    return (3 * (n + m) + 6) // 7


def set_rows(spark: SparkSession, docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, n, node, check) of every row; node and check, two digests, are null for
    empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _each_set(batch.column(1)):
                digests = [[node_of(s, k) if len(s) else None for s in sets] for k in (seed, seed + 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in digests)],
                    names=["doc_id", "n", "node", "check"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(io.lean(run), "doc_id long, n long, node long, check long")


ENTRY = "token long, salt int, doc_id long, node long, n int, end long"


def short_lists(spark: SparkSession, reps: DataFrame, frequent: np.ndarray, seed: int) -> DataFrame:
    """The short-list entries of every document of ``reps`` (columns ENTRY).

    ``end`` is the place of the last of them in the global order; ``salt`` deals the list
    of a frequent shingle to SALTS parts and is -1 for any other.
    """
    shared = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value

        def often(x: np.ndarray) -> np.ndarray:
            if not len(common):
                return np.zeros(len(x), dtype=bool)
            return common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, sets in _each_set(batch.column(1)):
                full = [k for k, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                docs_, sets = ids[a:b][full], [sets[k] for k in full]
                parts = [s[: short_size(len(s))] for s in sets]
                if len(common):
                    hit = often(np.concatenate(parts))
                    ends = np.cumsum([len(p) for p in parts])
                    for k in np.flatnonzero(np.add.reduceat(hit, ends - [len(p) for p in parts])):
                        late = often(sets[k])
                        parts[k] = np.concatenate([sets[k][~late], sets[k][late]])[: len(parts[k])]
                sizes = np.array([len(p) for p in parts])
                tokens = np.concatenate(parts)
                late = often(tokens)
                nodes = np.array([node_of(s, seed) for s in sets], np.int64)
                last = np.cumsum(sizes) - 1
                end = ((tokens[last] >> U64(2)) | (late[last].astype(U64) << U64(62))).view(np.int64)
                salt = np.where(late, np.repeat(nodes % SALTS, sizes), -1).astype(np.int32)
                columns = [tokens.view(np.int64), salt, *(np.repeat(x, sizes) for x in (docs_, nodes, np.array([len(s) for s in sets], np.int32), end))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "salt", "doc_id", "node", "n", "end"])

    return reps.select("doc_id", "text").mapInArrow(io.lean(run), ENTRY)


def shared_lists(rows: DataFrame) -> DataFrame:
    """Entries of lists with two or more of them, and each list's center: its first node
    (the smallest doc_id: what others were copied from tends to be older).

    Rows come sorted by (token, salt, doc_id, node); single entries are dropped as they
    stream by. The parts of a frequent list keep all entries; their center, found by a
    partial aggregation, is joined on, at most FREQUENT_MOST of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the last row so far
        first: tuple = (0, 0)  # document and node that begin the run it is in
        before = None  # the token before it

        def emit(cols, following):
            nonlocal first, before
            token, salt, doc, node = cols[:4]
            start = np.empty(len(token), dtype=bool)
            start[0] = before is None or token[0] != before
            start[1:] = token[1:] != token[:-1]
            where = np.maximum.accumulate(np.where(start, np.arange(len(token)), -1))
            center = [np.where(where >= 0, x[np.maximum(where, 0)], y) for x, y in zip((doc, node), first, strict=True)]
            nxt = np.append(token[1:], following if following is not None else token[-1])
            alone = start & ((nxt != token) if following is not None else np.append(nxt[:-1] != token[:-1], True))
            first, before = (int(center[0][-1]), int(center[1][-1])), int(token[-1])
            keep = ~alone | (salt >= 0)
            arrays = [pa.array(cols[k][keep]) for k in (0, 2, 3, 4, 5)] + [pa.array(x[keep], mask=salt[keep] >= 0) for x in center]
            return pa.RecordBatch.from_arrays(arrays, names=["token", "doc_id", "node", "n", "end", "center_doc", "center"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                cols = [np.append(x, y) for x, y in zip(held, cols, strict=True)]
            held = [x[-1:] for x in cols]
            if len(cols[0]) > 1:
                yield emit([x[:-1] for x in cols], cols[0][-1])
        if held is not None:
            yield emit(held, None)

    sorted_ = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "doc_id", "node")
    lists = io.staged(sorted_.mapInArrow(io.lean(run), "token long, doc_id long, node long, n int, end long, center_doc long, center long"), "short_lists")
    firsts = lists.filter("center is null").groupBy("token").agg(F.min(F.struct("doc_id", "node")).alias("f"))
    return lists.join(F.broadcast(firsts), "token", "left").select(
        "token", "node", "n", "end", F.coalesce("center_doc", "f.doc_id").alias("center_doc"), F.coalesce("center", "f.node").alias("center")
    )


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component.

    Large-star and small-star steps in turn; every round is written, so lineage stays
    short, and no group is gathered anywhere: a step takes one minimum per node.
    """
    now = io.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = io.staged(large.filter("u <> v"), "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = io.staged(small.filter("u <> v").distinct(), "edges")
        same = after.count() == now.count() and after.exceptAll(now).isEmpty()
        io.drop(now)
        io.drop(large)
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


VERIFIED = "a long, b long, linked boolean, overlap long, na long, nb long, delta array<long>"


def verified(spark: SparkSession, reps: DataFrame, nodes: DataFrame, pairs: DataFrame, seed: int, with_delta: bool = False) -> DataFrame:
    """Sizes and overlap of each of ``pairs`` (a, b), and whether it links.

    The shingles of a are probed in b's sorted array by binary search. ``delta`` holds the
    shingles that only one of them has, if ``with_delta``: for pairs of one family, or, where
    ``pairs`` have a column ``least``, for those with that overlap or more.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = io.staged(ids.join(nodes, "node").select("node", F.col("rep").alias("doc_id")), "pair_nodes")
    maybe, _ = io.parted(reps.select("doc_id", "text"), named)
    texts = maybe.join(named, "doc_id").select("node", "text")
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    given = "least" in pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.coalesce(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            for at, end in slices(np.concatenate([[0], np.cumsum(sizes)])):
                part = batch.slice(at, end - at)
                a, b = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                left_sets, right_sets = (sets_of(*string_buffers(part.column(c))) for c in (2, 3))
                least = part.column(4).to_numpy(zero_copy_only=False) if given else None
                out = []
                for k, (x, y) in enumerate(zip(left_sets, right_sets, strict=True)):
                    # rows of other texts under the same doc_id aren't meant
                    if not len(x) or not len(y) or node_of(x, seed) != a[k] or node_of(y, seed) != b[k]:
                        continue
                    hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                    i, n, m = int(hit.sum()), len(x), len(y)
                    delta = None
                    if with_delta and (i >= least[k] if given else FAMILY * i >= n + m):
                        delta = np.concatenate([x[~hit], np.setdiff1d(y, x[hit], assume_unique=True)]).view(np.int64)
                    out.append((int(a[k]), int(b[k]), i >= needed(n, m), i, n, m, delta))
                cols = list(zip(*out, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "linked", "overlap", "na", "nb", "delta"]
                )

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b", *["least"] * given)
    return rows.mapInArrow(io.lean(run), VERIFIED)


def _required(n: Column, m: Column) -> Column:
    return F.ceil((n + m) * 3 / 7)


def _close(n: Column, m: Column) -> Column:
    return (F.least(n, m) * 4) >= (F.greatest(n, m) * 3)


def _least_count() -> Column:
    """Common entries that the short lists of a linked pair hold at least: T less the long
    lists of that side whose short part ends earlier."""

    def rest(x: Column) -> Column:
        return F.ceil(x * 3 / 4) - 1

    x, y = rest(F.col("na")), rest(F.col("nb"))
    beyond = F.when(F.col("ea") < F.col("eb"), x).when(F.col("ea") > F.col("eb"), y).otherwise(F.greatest(x, y))
    return _required(F.col("na"), F.col("nb")) - beyond


def family_pairs(tested: DataFrame, guests: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of members of one family, or of a member and a guest, in different components,
    whose differences from the center may share enough.

    Differences are ordered from the rarest of the family on; with ``need`` shared ones
    the first of them is among the d - need + 1 first of either side.
    """
    both = tested.withColumn("guest", F.lit(False)).union(guests.withColumn("guest", F.lit(True)))
    member = both.filter("delta is not null").select(
        F.col("a").alias("node"), F.col("b").alias("family"), F.col("na").alias("n"), F.col("nb").alias("c"), F.col("overlap").alias("o"), "linked", "guest", "delta"
    )
    placed = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = io.staged(placed, "family_members")
    salt = F.pmod(F.col("node"), F.lit(SALTS)).alias("salt")  # a family may be large
    open_ = placed.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    open_ = open_.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    # what any partner needs at least, a linked member one that isn't linked and the other way round
    threshold = _required(F.col("n"), F.col("c"))
    n, c, o = F.col("n"), F.col("c"), F.col("o")
    need = F.when(F.col("linked"), F.floor((3 * n + 4 * c) / 7) - o).otherwise(threshold - o)
    rows = placed.withColumn("salt", salt).join(open_, ["family", "salt"]).select("family", "node", "n", "c", "o", "root", "linked", "guest", F.greatest(need, F.lit(1)).alias("need"), F.size("delta").alias("d"), F.explode("delta").alias("token"))
    rows = io.staged(rows, "family_lists")
    often = rows.groupBy("family", "token").agg(F.count("*").alias("times"))
    place = W.partitionBy("family", "node").orderBy("times", "token")
    ranked = rows.join(often, ["family", "token"]).withColumn("at", F.row_number().over(place))
    ranked = io.staged(ranked.filter((F.col("times") > 1) & (F.col("at") <= F.col("d") - F.col("need") + 1)), "family_prefixes")
    x, y = (
        ranked.select("family", "token", "c", *[F.col(k).alias(f"{k}{side}") for k in ("node", "n", "o", "root", "linked", "guest", "d", "at")]) for side in "ab"
    )
    shared = _required(F.col("na"), F.col("nb")) + x["c"] - F.col("oa") - F.col("ob")
    # two that link with the center are connected; two guests meet elsewhere
    apart = (F.col("roota") != F.col("rootb")) & ~(F.col("linkeda") & F.col("linkedb")) & ~(F.col("guesta") & F.col("guestb"))
    met = x.join(
        y.drop("c"),
        (x["family"] == y["family"]) & (x["token"] == y["token"]) & (F.col("nodea") < F.col("nodeb")) & apart
        & _close(F.col("na"), F.col("nb")) & (F.col("ata") <= F.col("da") - shared + 1) & (F.col("atb") <= F.col("db") - shared + 1),
    )
    return met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def open_entries(lists: DataFrame, tested: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the lists that hold different components and families, with the number
    ``s`` of their node's, and whether GROUP or more of their list are of their family."""
    family = tested.filter("delta is not null").select(F.col("a").alias("node"), F.col("b").alias("family"))
    placed = lists.select("token", "node", "n", "end").join(roots, "node", "left").join(family, "node", "left")
    placed = io.staged(placed.select("token", "node", "n", "end", F.coalesce("root", "node").alias("root"), F.coalesce("family", "node").alias("family")), "placed")
    mixed = placed.groupBy("token").agg(*[f(c).alias(f"{c}{f.__name__}") for c in ("root", "family") for f in (F.min, F.max)])
    mixed = mixed.filter("rootmin <> rootmax and familymin <> familymax").select("token")
    open_ = io.staged(placed.join(mixed, "token"), "open_lists")
    io.drop(placed)
    times = open_.groupBy("node").agg(F.count("*").alias("s"))
    crowds = open_.groupBy("token", "family").agg(F.count("*").alias("k")).filter(F.col("k") >= GROUP).select("token", "family", F.lit(True).alias("crowd"))
    crowds = io.staged(crowds, "crowds")
    return io.staged(open_.join(times, "node").join(crowds, ["token", "family"], "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))), "open_entries")


def guests_of(every: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b, least): a node, the center of another family of which it meets a crowd in a
    list, and the overlap with it from which on it may link with a member.

    Left out is who shares too few lists with all of the family: 3 (n + m) / 7 less 3 / 4
    of the larger size is the least for a link, which over the sizes m of the family is
    smallest at one end. A link with a member B takes |A & C| + |B| - |B & C| >= T, so
    7 |A & C| >= 3 |A| + 7 |B & C| - 4 |B|.
    """
    of = tested.filter("delta is not null").groupBy(F.col("b").alias("met")).agg(
        F.min(F.least("na", "nb")).alias("lo"), F.max(F.greatest("na", "nb")).alias("hi"), F.min(F.col("overlap") * 7 - F.col("na") * 4).alias("far")
    )
    crowds = every.filter("crowd").select("token", F.col("family").alias("met")).distinct()
    # of two crowds of a list one is the other's guest
    x = every.join(crowds, "token").filter((F.col("family") != F.col("met")) & (F.col("node") != F.col("met")) & (~F.col("crowd") | (F.col("family") < F.col("met"))))
    x = io.staged(x.select("node", "n", "met").distinct(), "guests")
    there = every.join(x.select(F.col("met").alias("family")).distinct(), "family", "left_semi").select("token", F.col("family").alias("met")).distinct()
    shared = every.select("node", "token").join(x, "node").join(there, ["token", "met"]).groupBy("node", "n", "met").agg(F.count("*").alias("k"))
    n = F.col("n")
    low, high = F.greatest("lo", F.ceil(n * 3 / 4)), F.least("hi", F.floor(n * 4 / 3))
    ends = [(n + m) * 12 - F.greatest(n, m) * 21 for m in (low, high)]
    may = shared.join(of, "met").filter((low <= high) & (F.col("k") * 28 > F.least(*ends)))
    return may.select(F.col("node").alias("a"), F.col("met").alias("b"), F.ceil((n * 3 + F.col("far")) / 7).alias("least"))


def other_pairs(every: DataFrame) -> DataFrame:
    """(a, b) of different components and families that meet often enough in short lists,
    where neither is one of a crowd (those have guests)."""

    def side(name: str) -> DataFrame:
        short = {"node": "", "n": "n", "end": "e", "root": "r", "s": "s", "family": "f"}
        return every.filter("not crowd").select("token", *[F.col(k).alias(f"{v}{name}") for k, v in short.items()])

    x, y = side("a"), side("b")
    apart = (F.col("ra") != F.col("rb")) & (F.col("fa") != F.col("fb")) & (F.col("fa") != F.col("b")) & (F.col("fb") != F.col("a"))
    fits = apart & _close(F.col("na"), F.col("nb")) & (F.least("sa", "sb") >= _least_count())
    met = x.join(y, (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & fits).drop(y["token"])
    counted = met.groupBy("a", "b").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("na", "nb", "ea", "eb")])
    return counted.filter(F.col("times") >= _least_count()).select("a", "b")


def classes(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their digests, one row a class of equal sets, seed of the digests).

    Two digests name a class, 128 bits; should two classes share the first one, other
    seeds are taken.
    """
    seed = 0
    while True:
        base = io.staged(set_rows(spark, docs, seed), "shingle_sets")
        known = base.filter("node is not null and doc_id is not null")
        nodes = known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), (F.min("check") != F.max("check")).alias("clash"))
        nodes = io.staged(nodes, "shingle_nodes")
        if nodes.filter("clash").isEmpty():
            return base, nodes.drop("clash"), seed
        io.drop(base)
        io.drop(nodes)
        seed += 2


def frequent_shingles(spark: SparkSession, reps: DataFrame, seed: int) -> np.ndarray:
    frequent = np.zeros(0, U64)
    for _ in range(FREQUENT_PASSES):
        counts = short_lists(spark, reps, frequent, seed).select("token").groupBy("token").count().filter(F.col("count") >= FREQUENT_LEAST)
        counts = io.staged(counts, "frequent")
        most = FREQUENT_LEAST
        while counts.filter(F.col("count") >= most).count() > FREQUENT_MOST - len(frequent):
            most *= 2
        often = counts.filter(F.col("count") >= most).select("token").toArrow().column("token").to_numpy()
        frequent = np.union1d(frequent, often.view(U64))
        io.drop(counts)
    return frequent


def link_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable by links, the row's own included.
    Null, empty and wordless texts have 0 shingles and link with nothing; so do rows
    with a null doc_id, whose component is null. Rows that repeat are equal sets; rows
    that share a doc_id with different texts are linked each for itself.
    """
    io.ship(spark)
    base, nodes, seed = classes(spark, docs)
    copies = base.filter("node is not null and doc_id is not null").join(nodes.filter("rep <> top"), "node").filter("doc_id <> rep").select("doc_id").distinct()
    # a doc_id under which another text is the first of its class stays
    copies = io.staged(copies.join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "shingle_copies")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    maybe, others = io.parted(known, copies)
    reps = io.staged(others.union(maybe.join(copies, "doc_id", "left_anti")), "first_texts")

    frequent = frequent_shingles(spark, reps, seed)
    lists = shared_lists(short_lists(spark, reps, frequent, seed))
    held = lists.groupBy("node").agg(F.count("*").alias("held"), F.first("n").alias("n")).filter(TEST * F.col("held") >= F.col("n")).select("node")
    met = lists.filter("node <> center").groupBy("node", "center").agg(F.count("*").alias("c"), F.min("center_doc").alias("d"))
    best = met.groupBy("node").agg(F.max(F.struct("c", (-F.col("d")).alias("d"), "center")).alias("best"))
    tries = best.join(held, "node", "left_semi").select(F.col("node").alias("a"), F.col("best.center").alias("b"))
    tested = io.staged(verified(spark, reps, nodes, io.staged(tries, "tries"), seed, with_delta=True), "tested")
    first = tested.filter("linked").select("a", "b")
    roots = components(spark, first)

    every = open_entries(lists, tested, roots)
    guests = verified(spark, reps, nodes, io.staged(guests_of(every, tested), "tries"), seed, with_delta=True)
    guests = io.staged(guests, "guests_tested")
    pairs = io.staged(family_pairs(tested, guests, roots).union(other_pairs(every)).distinct(), "candidates")
    second = verified(spark, reps, nodes, pairs, seed).filter("linked").select("a", "b")
    links = io.staged(first.union(guests.filter("linked").select("a", "b")).union(second), "links")
    roots = components(spark, links)
    io.drop(reps)

    named = nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.join(least, "root").select("node", "component_id")
    return base.join(ids, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
