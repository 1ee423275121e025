"""The corpus pipeline: five stages, each over all that the one before it kept.

A stage is a function of (spark, docs, sf_dir). Its result is written as Parquet in the
shared folder and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe_dp, io, jaccard_join, langid, line_dedup, mixing

#: A text is of no learned language if its bits a byte lie more than this many
#: interquartile ranges above the third quartile of that language's labelled texts.
BITS_IQR = 6.0
#: Bins of one bit, for the quartiles.
_BINS = 256


def _renamed(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names of its own for all columns but ``own``, so that no column of a
    stage can clash with them, and the original names by the new ones."""
    names = {c if c in own else f"__column{k}": c for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()]), names


def _restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(new).alias(old) for new, old in names.items()])


def _limits(predicted: DataFrame) -> dict[str, float]:
    """Most bits a byte that each language's labelled texts allow; from counts by bins,
    at most 9 * _BINS rows a language."""
    bins = predicted.filter("lang = lang_pred").groupBy("lang", F.floor(F.col("bits_per_byte") * _BINS).alias("bin")).count()
    out = {}
    rows = sorted((r[0], r[1], r[2]) for r in bins.collect())
    for lang in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == lang]
        total, at, quart = sum(n for _, n in own), 0, []
        for value, n in own:
            at += n
            while len(quart) < 2 and at >= total * (0.25, 0.75)[len(quart)]:
                quart.append(value / _BINS)
        # never narrower than half a bit: where all texts are alike the quartiles say nothing
        out[lang] = quart[1] + max(BITS_IQR * (quart[1] - quart[0]), 0.5)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; a missing lang takes the prediction.

    Rejected: null, empty and letterless texts, and texts whose code length under the
    best language is out of that language's range (another language, gibberish). If no
    row has a language to learn from, nothing is known and all texts are rejected. Rows
    that repeat, or whose doc_id is null, are judged each for itself.
    """
    inner, names = _renamed(docs, "doc_id", "text", "lang")
    trees = spark.sparkContext.broadcast(langid.fit(spark, inner.filter(langid.fold_of() != 0)))
    limits = _limits(langid.predict(spark, inner.filter("lang is not null"), trees, keep=("lang",)))
    if not limits:
        return _restored(inner.limit(0), names)
    found = langid.predict(spark, inner, trees, keep=tuple(inner.columns))
    most = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair]), F.col("lang_pred"))
    kept = found.filter((F.col("lang_pred") != "und") & F.coalesce(F.col("bits_per_byte") <= most, F.lit(True)))
    return _restored(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines; a text of nothing else goes.

    Null and empty texts and rows with a null doc_id pass as they are. Rows that share a
    doc_id count as one document. n_chars of a cut text is its new length.
    """
    inner, names = _renamed(docs, "doc_id", "text", "n_chars")
    out = line_dedup.dedup(spark, inner)
    kept = out.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return _restored(kept.withColumn("n_chars", size), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked documents.

    Texts without words and rows with a null doc_id link with nothing and stay, all of
    them. Of rows that repeat doc_id and text one stays, the least in the other columns.
    Of rows that share a doc_id with different texts all stay if one of them is the
    first of its group, and none otherwise.
    """
    inner, names = _renamed(docs, "doc_id", "text")
    links = io.staged(jaccard_join.link_documents(spark, inner).select("doc_id", "component_id"), "components")
    known = links.filter("doc_id is not null")
    state = known.groupBy("doc_id").agg(F.min(F.col("doc_id") - F.col("component_id")).alias("behind"), (F.count("*") > 1).alias("repeats"))
    state = io.staged(state.filter("behind > 0 or repeats").select(F.col("doc_id").alias("__id"), "behind", "repeats"), "concerned")
    concerned, others = io.parted(inner, state.withColumnRenamed("__id", "doc_id"))
    rows = concerned.join(state, concerned["doc_id"] == state["__id"], "left").filter("behind is null or behind = 0")
    once = rows.filter(~F.coalesce(F.col("repeats"), F.lit(False))).select(*inner.columns)
    rest = [c for c in inner.columns if c not in ("doc_id", "text")]
    repeated = rows.filter("repeats").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__none"), *rest)).alias("__least"))
    repeated = repeated.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__least.{c}").alias(c) for c in inner.columns])
    return _restored(others.union(once).union(repeated), names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped by their rate towards the target domain shares.

    Null and empty texts have the prior as their posterior and follow its rate. Copies
    are drawn by a hash of doc_id, so rows that repeat, or whose doc_id is null, share
    one draw. Without labels every document stays once.
    """
    inner, names = _renamed(docs, "doc_id", "text")
    rows, _ = mixing.mix(spark, inner, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(mixing.realised(rows), names)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document, null
    texts as empty ones, one row for each row."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_dp.encode_decode(spark, docs.select("doc_id", "text", "lang", "source"), path, keep=("doc_id", "lang", "source"), finish=bpe_dp.as_digests, outputs=bpe_dp.DIGESTS)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("bpe_encode_decode", encoded),
]

#: SQL can't express the trained and hashed stages; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = io.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
