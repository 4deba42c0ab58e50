"""Storm forecaster: chronological split, boosted trees, probability calibration, saved bundles."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.operators.blocks import positions

VERSION = "1"


def chrono_split(rows: DataFrame, key: str, pos: str, train: float = 0.70, calibrate: float = 0.15) -> DataFrame:
    """Add ``part`` (train, calibrate, test): the first, next and last rows of each key in order of ``pos``."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    r = positions(rows, [key], pos, "_i").join(n, key)
    part = F.when(F.col("_i") <= F.floor(train * F.col("_n")), "train").when(F.col("_i") <= F.floor((train + calibrate) * F.col("_n")), "calibrate").otherwise("test")
    return r.withColumn("part", part).drop("_i", "_n")


def _prepared(features: list[str]) -> list:
    return [Imputer(inputCols=features, outputCols=[f"{c}_f" for c in features], strategy="median"), VectorAssembler(inputCols=[f"{c}_f" for c in features], outputCol="features", handleInvalid="keep")]


def fit_regressor(train: DataFrame, features: list[str], label: str, rounds: int = 10) -> PipelineModel:
    """Boosted trees for absolute error."""
    return Pipeline(stages=[*_prepared(features), GBTRegressor(labelCol=label, lossType="absolute", maxIter=rounds, maxDepth=4, seed=7)]).fit(train)


def fit_classifier(train: DataFrame, features: list[str], label: str, rounds: int = 10) -> PipelineModel:
    """Boosted trees for the probability of a storm."""
    return Pipeline(stages=[*_prepared(features), GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=4, seed=7)]).fit(train)


def raw_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the model's probability as ``p``."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def platt(calibration: DataFrame, label: str):
    """Sigmoid calibration of ``p``: a function from a frame with ``p`` to one with ``calibrated``."""
    model = Pipeline(stages=[VectorAssembler(inputCols=["p"], outputCol="score"), LogisticRegression(featuresCol="score", labelCol=label, probabilityCol="pv", rawPredictionCol="rv", predictionCol="dv")]).fit(calibration)
    return lambda df: model.transform(df).withColumn("calibrated", vector_to_array("pv")[1]).drop("score", "pv", "rv", "dv")


def isotonic(calibration: DataFrame, label: str):
    """Monotone calibration of ``p``; values outside those seen take the nearest end's."""
    model = IsotonicRegression(featuresCol="p", labelCol=label, predictionCol="calibrated").fit(calibration)
    return model.transform


def save_bundle(model: PipelineModel, path: str, **facts) -> None:
    """Model and, as a table of one row beside it, its manifest: on any file system that Spark writes to."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(VERSION, json.dumps(facts, sort_keys=True))], "version string, facts string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_bundle(path: str) -> tuple[PipelineModel, dict]:
    """Model and manifest; a bundle of another version is an error."""
    row = SparkSession.getActiveSession().read.schema("version string, facts string").json(f"{path}/manifest").first()
    if row is None or row.version != VERSION:
        raise ValueError(f"bundle version {row and row.version!r}, expected {VERSION!r}")
    return PipelineModel.load(f"{path}/model"), {"version": row.version, **json.loads(row.facts)}


def require_rows(parts: DataFrame, total: int = 2000, train: int = 1000, other: int = 300) -> DataFrame:
    """The rows of ``chrono_split`` if they are enough to certify a forecaster; else an error that names what is short."""
    n = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    short = [f"{what} has {have} rows, needs {need}" for what, have, need in (("the table", sum(n.values()), total), ("train", n.get("train", 0), train), ("calibrate", n.get("calibrate", 0), other), ("test", n.get("test", 0), other)) if have < need]
    if short:
        raise ValueError("; ".join(short))
    return parts


def against_persistence(rows: DataFrame, truth: str, forecast: str, last: str) -> DataFrame:
    """One row: mean absolute error of a forecast, of the last value, and the relative gain (NULL where the latter has none).
    Rows with any of the three missing are left out."""
    ok = rows.dropna(subset=[truth, forecast, last])
    e = ok.agg(F.avg(F.abs(F.col(truth) - F.col(forecast))).alias("mae"), F.avg(F.abs(F.col(truth) - F.col(last))).alias("mae_persistence"), F.count(F.lit(1)).alias("n"))
    return e.withColumn("gain", F.try_divide(F.col("mae_persistence") - F.col("mae"), F.col("mae_persistence")))


def context_length(n: int, patch: int = 32) -> int:
    """The longest multiple of a model's patch within a context; a shorter context stays as it is."""
    return n // patch * patch if n >= patch else n


def out_of_fold(rows: DataFrame, features: list[str], label: str, pos: str, folds: int = 3, gap: int = 36, rounds: int = 5) -> DataFrame:
    """Rows with a probability ``p`` from a model that saw earlier rows only: the span of ``pos`` is cut in folds + 1 parts, and
    every part but the first is told by a model of all rows that end ``gap`` positions before it.

    Folds whose training rows have one outcome only give no rows. One model a fold; the rows themselves stay distributed.
    """
    lo, hi = rows.agg(F.min(pos), F.max(pos)).first()
    out = None
    for i in range(1, folds + 1):
        if lo is None:
            break
        a, b = (lo + (hi - lo + 1) * j // (folds + 1) for j in (i, i + 1))
        train = rows.where(F.col(pos) < a - gap)
        if train.select(label).distinct().count() < 2:
            continue
        told = raw_probability(fit_classifier(train, features, label, rounds), rows.where((F.col(pos) >= a) & (F.col(pos) < b))).select(*rows.columns, "p")
        out = told if out is None else out.unionByName(told)
    return out if out is not None else rows.limit(0).withColumn("p", F.lit(None).cast("double"))
