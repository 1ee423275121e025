"""The relations that the queries work on, from the driver's tables.

``manifest``: labelled documents (label = quality, generator = lang of label 1).
``grid``: conditions x images, from orders. ``branch``: two scores per image.
``SQL`` holds the same relations as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONDITIONS = ["clean", "jpeg", "blur", "noise", "resize"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.col("quality").alias("label"),
        F.when(F.col("quality") == 1, F.col("lang")).otherwise("").alias("generator"),
        "source",
        "lang",
        F.col("n_chars").cast("int").alias("width"),
        (F.col("n_chars") % 977 + 64).cast("int").alias("height"),
        F.col("toxic").alias("is_distorted"),
        F.sha2("text", 256).alias("content_sha256"),
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    cond = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k")) for k, c in enumerate(CONDITIONS)]))
    rows = o.withColumn("c", cond).select("*", "c.condition", "c.k")
    key = F.col("o_orderkey")
    return rows.select(
        "condition",
        "k",
        key.alias("image_idx"),
        "label",
        F.when(F.col("label") == 1, F.concat(F.lit("g"), (F.col("o_custkey") % 6).cast("string"))).otherwise("").alias("generator"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 4).cast("string")).alias("source"),
        (((key * 31 + F.col("k") * 17) % 1009).cast("double") / F.lit(1009.0) + F.col("label") * (F.lit(0.5) - F.lit(0.08) * F.col("k"))).alias("score"),
        F.when(key % 4 == 0, "val_internal").when(key % 4 == 1, "heldout_generator").when(key % 4 == 2, "train").otherwise("benchmark").alias("split"),
    )


def branch(spark: SparkSession, sf: str) -> DataFrame:
    key, label = F.col("o_orderkey"), F.col("label")
    o = table(spark, sf, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return o.select(
        F.concat(F.lit("/o/"), key.cast("string")).alias("path"),
        key.alias("row_id"),
        "label",
        (F.col("o_custkey") % 2).cast("int").alias("is_distorted"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 4).cast("string")).alias("source"),
        ((((key * 37) % 1013).cast("double") / F.lit(1013.0) - F.lit(0.5)) * F.lit(4.0) + label * F.lit(1.5)).alias("a"),
        ((((key * 53) % 997).cast("double") / F.lit(997.0) - F.lit(0.5)) * F.lit(4.0) + label * F.lit(1.25)).alias("b"),
        ((((key * 71) % 991).cast("double") / F.lit(991.0) - F.lit(0.5)) * F.lit(4.0) + label * F.lit(0.75)).alias("c"),
    )


SQL = """WITH manifest AS (
  SELECT d.doc_id AS row_id, '/data/'||d.source||'/'||d.lang||'/'||CAST(d.doc_id AS VARCHAR)||'.png' AS path, l.quality AS label,
    CASE WHEN l.quality=1 THEN d.lang ELSE '' END AS generator, d.source AS source, d.lang AS lang, CAST(d.n_chars AS INTEGER) AS width,
    CAST(d.n_chars % 977 + 64 AS INTEGER) AS height, l.toxic AS is_distorted, sha256(d.text) AS content_sha256
  FROM documents d JOIN labels l ON d.doc_id=l.doc_id),
grid AS (
  SELECT c.condition, c.k, o_orderkey AS image_idx, CAST(o_orderstatus='F' AS INTEGER) AS label,
    CASE WHEN o_orderstatus='F' THEN 'g'||CAST(o_custkey%6 AS VARCHAR) ELSE '' END AS generator, 's'||CAST(o_custkey%4 AS VARCHAR) AS source,
    CAST((o_orderkey*31+c.k*17)%1009 AS DOUBLE)/1009e0 + CAST(o_orderstatus='F' AS INTEGER)*(5e-1-8e-2*c.k) AS score,
    CASE o_orderkey%4 WHEN 0 THEN 'val_internal' WHEN 1 THEN 'heldout_generator' WHEN 2 THEN 'train' ELSE 'benchmark' END AS split
  FROM orders CROSS JOIN (VALUES ('clean',0),('jpeg',1),('blur',2),('noise',3),('resize',4)) c(condition,k)),
branch AS (
  SELECT '/o/'||CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS row_id, CAST(o_orderstatus='F' AS INTEGER) AS label, CAST(o_custkey%2 AS INTEGER) AS is_distorted,
    's'||CAST(o_custkey%4 AS VARCHAR) AS source,
    (CAST((o_orderkey*37)%1013 AS DOUBLE)/1013e0-5e-1)*4e0 + CAST(o_orderstatus='F' AS INTEGER)*15e-1 AS a,
    (CAST((o_orderkey*53)%997 AS DOUBLE)/997e0-5e-1)*4e0 + CAST(o_orderstatus='F' AS INTEGER)*125e-2 AS b,
    (CAST((o_orderkey*71)%991 AS DOUBLE)/991e0-5e-1)*4e0 + CAST(o_orderstatus='F' AS INTEGER)*75e-2 AS c
  FROM orders)"""
