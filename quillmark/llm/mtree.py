"""Exact top-k inner products by best-first search of M-trees.

With every vector x extended by sqrt(M - |x|^2), M the largest squared norm, all lie on
a sphere and the nearest to (q, 0) in Euclidean distance has the largest inner product.
Vectors are dealt to cells around sampled pivots; a cell is cut into trees of bounded
size whose pages hold entries with a routing vector, a covering radius and the distance
to the parent. Search opens the page with the best bound first; the triangle inequality
on stored parent distances rules entries out before any distance is computed. A query
sees its nearest cell first and then those that its k-th score so far can't rule out.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm import io

PAGE, FANOUT = 64, 8
#: Vectors of a tree at most (about); pivots at most; rows sampled for pivots.
TREE, MOST_PIVOTS, SAMPLE = 2048, 8192, 32_768
#: Rows for each pivot where that stays below MOST_PIVOTS.
PER_PIVOT = 512
#: Queries that one task holds for a tree.
QUERY_BLOCK = 2048
SLACK = 1e-6
#: Stand for a score and an id that no vector has.
NOTHING, NO_ID = -(1 << 62), 1 << 62
#: Squared norms below which scores are whole in float64, and fit a long at all.
EXACT, LONG = float(1 << 53), float(1 << 62)


def finite(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, size2): the vectors that take part.

    Left out are rows without an id and vectors that are null, empty or hold a null or
    non-finite component. An id that repeats counts once, with the least of its vectors
    in the order of arrays. size2 is about the squared norm of floor(256 * v).
    """
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    one = rows.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(x).alias("v"))
    return one.withColumn("size2", F.aggregate("v", F.lit(0.0), lambda a, v: a + (F.abs(v) * 256 + 1) * (F.abs(v) * 256 + 1)))


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, x array<long>, dim, norm2) with x = floor(256 * component); of vectors
    whose squared norm is below LONG."""
    out = rows.select("vec_id", F.transform("v", lambda v: F.floor(v * 256).cast("long")).alias("x"))
    return out.select("vec_id", "x", F.size("x").alias("dim"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v).alias("norm2"))


def _extended(x: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x.astype(np.float64), np.sqrt(np.maximum(most - norm2, 0.0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to the point b."""
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(ids: np.ndarray, x: np.ndarray, points: np.ndarray) -> dict:
    """A tree over these rows: nested pages, bulk-loaded from above."""
    center = points[_distances(points, points.mean(axis=0)).argmin()]
    to_center = _distances(points, center)
    page = {"center": center, "radius": float(to_center.max()), "least": int(ids.min())}
    if len(ids) <= PAGE:
        return page | {"ids": ids, "x": x, "parent": to_center}
    seeds, gap = [int(to_center.argmax())], None
    group = np.zeros(len(ids), dtype=np.int64)
    gap = _distances(points, points[seeds[0]])
    while len(seeds) < FANOUT and gap.max() > 0:
        seeds.append(int(gap.argmax()))
        d = _distances(points, points[seeds[-1]])
        closer = d < gap
        group[closer], gap = len(seeds) - 1, np.minimum(gap, d)
    if len(seeds) == 1:  # all alike: any cut will do
        group = np.arange(len(ids)) * FANOUT // len(ids)
    kids = [build(ids[own], x[own], points[own]) for own in (np.flatnonzero(group == g) for g in range(FANOUT)) if len(own)]
    centers = np.stack([k["center"] for k in kids])
    return page | {
        "kids": kids, "centers": centers, "radii": np.array([k["radius"] for k in kids]),
        "leasts": np.array([k["least"] for k in kids]), "parent": _distances(centers, center),
    }


def search(tree: dict, ids: np.ndarray, q: np.ndarray, most: float, best: np.ndarray, best_ids: np.ndarray) -> int:
    """Improve the k best scores (rows of ``best``, descending, ties by id) of a block of
    queries by a tree; returns how many inner products were computed.

    The page with the best bound over the block comes first. A page is opened for those
    queries whose bound reaches their k-th score, and of a leaf's entries those take
    part that the stored parent distances leave in reach of any of them.
    """
    points = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
    base = np.einsum("ij,ij->i", points, points) + most
    whole = np.float64 if max(most, float(np.einsum("ij,ij->i", points, points).max())) < EXACT else np.int64
    exact = q.astype(whole)
    computed = 0

    def bound(distance: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Score that can't be exceeded at that distance or more."""
        scale = base[rows] if distance.ndim == 1 else base[rows][:, None]
        return (scale - np.square(np.maximum(distance, 0.0))) / 2 + SLACK * scale

    def gaps(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
        p = points[rows]
        d2 = np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", centers, centers)[None] - 2 * p @ centers.T
        return np.sqrt(np.maximum(d2, 0.0))

    def in_reach(limit: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
        kth = best[rows, -1]
        return (limit > kth) | ((limit >= kth) & (least <= best_ids[rows, -1])) | (limit - kth >= -SLACK * base[rows])

    every = np.arange(len(q))
    d0 = gaps(every, tree["center"][None])[:, 0]
    limit = bound(d0 - tree["radius"], every)
    heap = [(-float(limit.max()), 0, tree, every, d0, limit)]
    serial = 0
    while heap:
        _, _, page, rows, d, limit = heapq.heappop(heap)
        ok = in_reach(limit, rows, page["least"])
        rows, d = rows[ok], d[ok]
        if not len(rows):
            continue
        gap = np.abs(d[:, None] - page["parent"][None])
        if "ids" in page:
            near = bound(gap, rows) >= best[rows, -1][:, None]
            pick = np.flatnonzero(near.any(axis=0))
            rows = rows[near.any(axis=1)]
            if not len(pick) or not len(rows):
                continue
            scores = (exact[rows] @ page["x"][pick].astype(whole).T).astype(np.int64)
            computed += scores.size
            own = page["ids"][pick]
            scores[ids[rows][:, None] == own[None]] = NOTHING
            better = np.flatnonzero((scores >= best[rows, -1][:, None]).any(axis=1))
            if len(better):
                rows, scores = rows[better], scores[better]
                k = best.shape[1]
                every_score = np.concatenate([best[rows], scores], axis=1)
                every_id = np.concatenate([best_ids[rows], np.broadcast_to(own, scores.shape)], axis=1)
                order = np.lexsort((every_id, -every_score), axis=-1)[:, :k]
                best[rows] = np.take_along_axis(every_score, order, axis=1)
                best_ids[rows] = np.take_along_axis(every_id, order, axis=1)
            continue
        possible = bound(gap - page["radii"][None], rows) >= best[rows, -1][:, None]
        for e in np.flatnonzero(possible.any(axis=0)):
            some = rows[possible[:, e]]
            dist = gaps(some, page["centers"][e][None])[:, 0]
            limit = bound(dist - page["radii"][e], some)
            ok = in_reach(limit, some, int(page["leasts"][e]))
            if ok.any():
                serial += 1
                heapq.heappush(heap, (-float(limit[ok].max()), serial, page["kids"][e], some[ok], dist[ok], limit[ok]))
    return computed


def pivots_of(rows: DataFrame, n: int, most: float, dim: int) -> np.ndarray:
    """Pivots by farthest-first choice from at most about SAMPLE rows."""
    share = min(1.0, SAMPLE / max(n, 1))
    draw = F.pmod(F.xxhash64("vec_id", F.lit("pivots")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.filter(draw < share).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    if not got.num_rows:
        got = rows.limit(1).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.int64).reshape(-1, dim)
    points = _extended(x, np.einsum("ij,ij->i", x, x), most)
    seeds, gap = [0], _distances(points, points[0])
    while len(seeds) < min(MOST_PIVOTS, max(1, n // PER_PIVOT)) and gap.max() > 0:
        seeds.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(points, points[seeds[-1]]))
    return points[seeds]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.int64)


def build_index(spark: SparkSession, rows: DataFrame, pivots: np.ndarray, most: float, dim: int) -> DataFrame:
    """(cell, tree, pages): every row in a tree of bounded size, in the shared folder."""
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            points = _extended(x, np.einsum("ij,ij->i", x, x), most)
            cell = (np.einsum("ij,ij->i", p, p)[None] - 2 * points @ p.T).argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "x", "cell"])

    dealt = io.staged(rows.select("vec_id", "x").mapInArrow(deal, "vec_id long, x array<long>, cell int"), "vector_cells")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("size"))
    trees = F.ceil(F.col("size") / TREE)
    salted = dealt.join(F.broadcast(sizes), "cell").withColumn("tree", F.pmod(F.xxhash64("vec_id"), trees).cast("int"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
        root = build(pdf["vec_id"].to_numpy(np.int64), x, _extended(x, np.einsum("ij,ij->i", x, x), most))
        return pd.DataFrame({"cell": [key[0]], "tree": [key[1]], "radius": [float(_distances(_extended(x, np.einsum("ij,ij->i", x, x), most), shared.value[key[0]]).max())], "pages": [pickle.dumps(root)]})

    return io.staged(salted.groupBy("cell", "tree").applyInPandas(grow, "cell int, tree int, radius double, pages binary"), "vector_trees")


FOUND = "query_id long, vec_id long, score long"


def _visit(spark: SparkSession, asked: DataFrame, index: DataFrame, most: float, k: int) -> DataFrame:
    """Search each (query, cell) of ``asked`` in all trees of the cell.

    A task holds one tree and one block of queries; a tree is sent once for about
    QUERY_BLOCK queries that ask for it.
    """
    asked = io.staged(asked, "asked")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    per_tree = index.select(F.col("cell").alias("cell"), F.col("tree").alias("tree")).join(blocks, "cell")
    left = asked.join(per_tree, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    right = index.select(F.col("cell").alias("cell"), F.col("tree").alias("tree"), "pages").join(blocks.select(F.col("cell").alias("cell"), F.col("blocks").alias("blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(trees):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        known = queries["kth"].notna().to_numpy()
        kth = np.where(known, queries["kth"].fillna(0).to_numpy(np.int64), NOTHING)
        kth_id = np.where(known, queries["kth_id"].fillna(0).to_numpy(np.int64), NO_ID)
        best, best_ids = np.repeat(kth[:, None], k, axis=1), np.repeat(kth_id[:, None], k, axis=1)
        ids = queries["query_id"].to_numpy(np.int64)
        search(pickle.loads(trees["pages"].iloc[0]), ids, np.stack(queries["q"].to_numpy()), most, best, best_ids)
        fresh = (best > NOTHING) & ~((best == kth[:, None]) & (best_ids == kth_id[:, None]))
        row, col = np.nonzero(fresh)
        return pd.DataFrame({"query_id": ids[row], "vec_id": best_ids[row, col], "score": best[row, col]})

    keys = ["cell", "tree", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scores_of_giants(spark: SparkSession, rows: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of those pairs of which one squared norm is
    LONG or more, by whole numbers of any size, in blocks."""
    giants = rows.filter(F.col("size2") >= LONG)
    blocks, parts = max(1, -(-giants.count() // 256)), max(1, -(-rows.count() // 4096))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(parts)).cast("int")
    left = giants.select("vec_id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = rows.select("vec_id", "v", (F.col("size2") >= LONG).alias("giant"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def whole(v: np.ndarray) -> list[int]:
        return [int(c) * 256 if abs(c) >= 1 << 53 else math.floor(c * 256) for c in v.tolist()]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[tuple[int, int]]] = {}
        seconds = [(int(i), whole(v), bool(g)) for i, v, g in zip(b["vec_id"], b["v"], b["giant"], strict=True)]
        for i, v in zip(a["vec_id"], a["v"], strict=True):
            x, i = whole(v), int(i)
            for j, y, giant in seconds:
                asks = [(i, j)] * (i % every == 0) + [(j, i)] * (j % every == 0 and not giant)
                if j == i or len(x) != len(y) or not asks:
                    continue
                score = max(min(sum(p * q for p, q in zip(x, y, strict=True)), (1 << 63) - 1), -(1 << 63))
                for q, c in asks:
                    found.setdefault(q, []).append((-score, c))
        best = [(q, c, -s) for q, pairs in found.items() for s, c in heapq.nsmallest(k, pairs)]
        return pd.DataFrame(best, columns=["query_id", "vec_id", "score"]).astype("int64")

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, FOUND)


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``
    its k largest integer inner products with other rows, ties to the smaller id.

    A vector is compared with those of its own length. Fewer than k others give fewer
    rows, none give none. Scores are exact; beyond 64 bits they count as the nearest
    long. See :func:`finite` for vectors that take no part and for ids that repeat.
    """
    io.ship(spark)
    every_row = io.staged(finite(vectors), "finite_vectors")
    rows = io.staged(integers(every_row.filter(F.col("size2") < LONG)), "vectors")
    out = None
    for dim, n, most in [(r[0], r[1], float(r[2])) for r in rows.groupBy("dim").agg(F.count("*"), F.max("norm2")).orderBy("dim").collect()]:
        own = rows.filter(F.col("dim") == dim)
        part = _top_k(spark, own, n, most, dim, k, every)
        out = part if out is None else out.union(part)
    if not every_row.filter(F.col("size2") >= LONG).isEmpty():
        far = _scores_of_giants(spark, every_row, every, k)
        out = far if out is None else out.union(far)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top_k(spark: SparkSession, rows: DataFrame, n: int, most: float, dim: int, k: int, every: int) -> DataFrame:
    pivots = pivots_of(rows, n, most, dim)
    index = build_index(spark, rows, pivots, most, dim)
    radii = {r[0]: r[1] for r in index.groupBy("cell").agg(F.max("radius")).collect()}
    shared = spark.sparkContext.broadcast((pivots, np.array([radii.get(c, -1.0) for c in range(len(pivots))])))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))

    def limits(q: np.ndarray) -> np.ndarray:
        """Bound of each query (row) in each cell (column)."""
        p, r = shared.value
        point = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        base = np.einsum("ij,ij->i", point, point) + most
        d2 = base[:, None] - 2 * point @ p.T + (np.einsum("ij,ij->i", p, p) - most)[None]
        gap = np.maximum(np.sqrt(np.maximum(d2, 0.0)) - r[None], 0.0)
        return np.where(r[None] >= 0, (base[:, None] - gap**2) / 2 + SLACK * base[:, None], -np.inf)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = limits(_matrix(batch.column(1), dim)).argmax(axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["query_id", "q", "cell"])

    begun = io.staged(asked.mapInArrow(nearest, "query_id long, q array<long>, cell int"), "first_cells")
    nothing = F.lit(None).cast("long")
    first = _visit(spark, begun.select("query_id", "q", "cell", nothing.alias("kth"), nothing.alias("kth_id")), index, most, k)
    first = io.staged(_ranked(first, k).drop("rank"), "first_found")
    kth = first.groupBy("query_id").agg(F.count("*").alias("got"), F.min(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("w"))
    full = F.col("got") == k
    state = begun.join(kth, "query_id", "left").select(
        "query_id", "q", "cell", F.when(full, F.col("w.score")).alias("kth"), F.when(full, -F.col("w.v")).alias("kth_id")
    )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                limit = limits(_matrix(part.column(1), dim))
                least = np.asarray(part.column(3).cast(pa.float64(), safe=False).fill_null(-np.inf))
                open_ = (limit >= least[:, None]) & np.isfinite(limit)
                open_[np.arange(len(limit)), np.asarray(part.column(2))] = False
                row, cell = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), part.column(3).take(pa.array(row)), part.column(4).take(pa.array(row))],
                    names=["query_id", "q", "cell", "kth", "kth_id"],
                )

    more = state.mapInArrow(others, "query_id long, q array<long>, cell int, kth long, kth_id long")
    second = _visit(spark, more, index, most, k)
    return first.union(second)
