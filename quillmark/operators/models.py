"""Small fitted models (MLlib): evidence quality, content-blind and resolution controls."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.hashing import SEED, order_key
from quillmark.operators.metrics import leak_auc, roc_auc
from quillmark.operators.vectors import moments, projected


def _logistic(features: list[str], label: str, n: int) -> Pipeline:
    """Standardised logistic regression with the ridge that equals C = 1."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="error"),
            StandardScaler(withMean=True, inputCol="__raw", outputCol="__x"),
            LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c", regParam=1.0 / max(n, 1), standardization=False, maxIter=50),
        ]
    )


def _probability(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("__p")[1]).drop("__raw", "__x", "__p", "__r", "__c")


def evidence_quality(fit: DataFrame, rows: DataFrame, conditions: list[str], correct: str, name: str = "eqi") -> DataFrame:
    """Probability that a decision is right, from its standardised conditions; fitted
    on ``fit`` and given for ``rows``."""
    return _probability(_logistic(conditions, correct, fit.count()).fit(fit).transform(rows), name)


def out_of_fold(df: DataFrame, features: list[str], y: str, key: str, folds: int = 5, seed: int = SEED, name: str = "oof") -> DataFrame:
    """Each row's probability from a model fitted on the other folds (by key hash)."""
    fold = F.pmod(F.conv(F.substring(order_key(seed, F.col(key)), 1, 8), 16, 10).cast("long"), F.lit(folds))
    rows = df.withColumn("__fold", fold).cache()
    out = None
    for k in range(folds):
        train, test = rows.filter(F.col("__fold") != k), rows.filter(F.col("__fold") == k)
        part = _probability(_logistic(features, y, train.count()).fit(train).transform(test), name)
        out = part if out is None else out.unionByName(part)
    return out.drop("__fold")


def content_blind_auc(df: DataFrame, features: list[str], y: str, key: str) -> DataFrame:
    """AUC that features without content reach out of fold."""
    return roc_auc(out_of_fold(df, features, y, key), [], y, "oof", "auc")


def resolution_leak(fit: DataFrame, rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """AUC of a small decision tree on sizes alone, fitted and scored on disjoint rows."""
    tree = DecisionTreeClassifier(featuresCol="__raw", labelCol=y, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c", maxDepth=6, minInstancesPerNode=50)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__raw"), tree]).fit(fit)
    return roc_auc(_probability(model.transform(rows), "p"), [], y, "p", "auc")


def remove_direction(df: DataFrame, vector: str, target: str, rounds: int, dim: int, ridge: float = 1e-2) -> DataFrame:
    """Project out, ``rounds`` times, the ridge direction that predicts a confound of 0 and 1.

    All directions follow from one pass of moments, since a projection acts on moments as
    it does on rows; the rows are then projected once.
    """
    groups, n, sums, cross = moments(df, target, vector, dim)
    mean = sums.sum(axis=0) / n.sum()
    cov = cross / n.sum() - np.outer(mean, mean)
    share = np.array([float(g) for g in groups])
    with_y = (share[:, None] * sums).sum(axis=0) / n.sum() - mean * (share @ n) / n.sum()
    keep, axes = np.eye(dim), []
    for _ in range(rounds):
        own = keep @ cov @ keep
        w = keep @ np.linalg.solve(own + ridge * np.trace(cov) / dim * np.eye(dim), keep @ with_y)
        if w @ w < 1e-18:
            break
        axes.append(w / np.sqrt(w @ w))
        keep = keep - np.outer(axes[-1], axes[-1])
    return projected(df, vector, np.array(axes)) if axes else df


def confound_gate(auc: DataFrame, reference: float, limit: float) -> DataFrame:
    """pass, warn or fail of a control's AUC against two constants."""
    return auc.withColumn("verdict", F.when(F.col("auc") <= reference, "pass").when(F.col("auc") <= limit, "warn").otherwise("fail"))


def probe_auc(df: DataFrame, vector: str, y: str, dim: int) -> DataFrame:
    """How well single components give a label away: the best orientation-free AUC."""
    long = df.select(y, F.posexplode(vector).alias("pos", "v")).filter(F.col("pos") < dim).withColumn("v", F.col("v").cast("double"))
    return leak_auc(long, ["pos"], y, "v").agg(F.max("auc").alias("auc"))
