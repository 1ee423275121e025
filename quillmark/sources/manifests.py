"""Readers and writers: manifests, pair tables, label lists, JSON side files, banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators.joins import Refused

#: Suffixes of image files.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
MANIFEST = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("path", T.StringType()), ("label", T.IntegerType()), ("generator", T.StringType()), ("source", T.StringType()), ("licence", T.StringType()),
        ("width", T.IntegerType()), ("height", T.IntegerType()), ("split", T.StringType()),
    )]
)


def scan_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, length, modified[, content]) of image files below root, any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*IMAGE_SUFFIXES))
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def read_manifest(spark: SparkSession, path: str, root: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Known columns of a manifest; with ``root``, paths are rebuilt from rel_path."""
    df = spark.read.parquet(path)
    if root is not None:
        df = df.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), "rel_path"))
    return df.select(*[f.name for f in MANIFEST], *extra)


def write_manifest(df: DataFrame, path: str) -> None:
    """Freeze a manifest: an existing one is never written over."""
    df.write.mode("errorifexists").parquet(path)


def read_labels_csv(spark: SparkSession, path: str, schema: str, prefix: str, labels: list[int], rows: int | None = None) -> DataFrame:
    """A label list with the declared schema; wrong prefixes, labels or row counts are errors."""
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    got = df.agg(F.count("*").alias("n"), F.count_if(~F.col("path").startswith(prefix)).alias("prefix"), F.count_if(~F.col("label").isin(labels)).alias("label")).first()
    if got["prefix"] or got["label"] or (rows is not None and got["n"] != rows):
        raise Refused(f"label list: {got.asDict()}")
    return df


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """(name, licence) from JSON lines of maps; of a repeated name the last line wins."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.from_json("value", "map<string,string>").alias("m"))
    return lines.select("i", F.explode("m").alias("name", "licence")).groupBy("name").agg(F.max_by("licence", "i").alias("licence"))


def pairs_to_rows(pairs: DataFrame, fake: str, real: str, key: str, generator: str) -> DataFrame:
    """Two manifest rows of each pair: the fake and the real."""
    one = F.array(
        F.struct(F.col(fake).alias("path"), F.lit(1).alias("label"), F.col(generator).alias("generator")),
        F.struct(F.col(real).alias("path"), F.lit(0).alias("label"), F.lit("").alias("generator")),
    )
    return pairs.select(F.col(key).alias("image_id"), F.explode(one).alias("r")).select("image_id", "r.*")


def conform(df: DataFrame, schema: T.StructType = MANIFEST) -> DataFrame:
    """Columns of ``schema`` in its order; missing ones get '' or 0."""
    out = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*out)


def merge_shards(frames: list[DataFrame], key: str, expected: int | None = None) -> DataFrame:
    """All shards together; a key in two of them, or a wrong total, is an error."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    twice = out.groupBy(key).count().filter("count > 1").count()
    n = out.count()
    if twice or (expected is not None and n != expected):
        raise Refused(f"{twice} repeated keys, {n} rows")
    return out


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` that ``done`` lacks: how interrupted work is taken up."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def append_missing(wanted: DataFrame, path: str, key: str) -> None:
    """Append to a bank the rows that it lacks."""
    spark = wanted.sparkSession
    try:
        wanted = todo(wanted, spark.read.parquet(path), key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    wanted.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_predictions(df: DataFrame, path: str) -> None:
    """{image_path, pred} rows as JSON."""
    df.select("image_path", "pred").write.mode("errorifexists").json(path)
