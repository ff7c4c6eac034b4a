"""The meta-model: whether to take a primary signal's trade, by Spark ML, validated on purged folds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import config_hash
from .features import full, lagged
from .statistics import classifier_metrics

FEATURES = ["ret_1", "ret_5", "ret_20", "vol_20", "raw"]


class NoFoldError(ValueError):
    """No fold has a training part with both classes and a test part."""


def meta_features(bars: DataFrame, primary: DataFrame) -> DataFrame:
    """symbol, pos and the model's features: returns over 1, 5 and 20 bars, their deviation over 20, and the primary signal."""
    df = bars.withColumns({f"ret_{h}": F.col("close") / F.nullif(lagged("close", h), F.lit(0.0)) - 1 for h in (1, 5, 20)})
    df = df.withColumn("vol_20", full(F.stddev_samp("ret_1"), F.col("ret_1"), 20))
    return df.join(primary.select("symbol", "pos", "raw"), ["symbol", "pos"]).select("symbol", "pos", *FEATURES)


def _stages(kind: str, seed: int) -> Pipeline:
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    if kind == "boosted":
        return Pipeline(stages=[assemble, GBTClassifier(featuresCol="_x", labelCol="y", weightCol="weight", maxIter=20, maxDepth=3, seed=seed)])
    if kind == "logistic":
        return Pipeline(stages=[assemble, StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="y", weightCol="weight", regParam=0.01, elasticNetParam=0.0)])
    raise ValueError(f"unknown model {kind}")


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability that the trade is right; null features count as 0."""
    got = model.transform(rows.na.fill(0.0, FEATURES))
    return got.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


MODELS = ("boosted", "logistic")


@dataclass
class FitResult:
    """What a fit found: metrics by model, pooled over the test parts; a row for each fold and model; and where the chosen model,
    fitted to all rows, was saved."""

    model: PipelineModel
    metrics: dict[str, dict[str, float]]
    per_fold: list[dict]
    artifact: str | None


def _folds(rows: DataFrame, folds: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Of each fold (few, each a model of its own) the number and both parts, if the training part has both classes and the
    other any row."""
    for k in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        part = folds.filter(F.col("fold") == k)
        train, test = (rows.join(part.filter(F.col("role") == role).select("pos"), "pos", "left_semi") for role in ("train", "test"))
        if train.select("y").distinct().count() == 2 and test.limit(1).count():
            yield k, train, test


def _complete(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=FEATURES)


def train(rows: DataFrame, folds: DataFrame, kind: str = "boosted", seed: int = 7, folder: str | None = None, trials=None, run_id: str = "meta", scheme: str = "", snapshots: tuple[str, ...] = ()) -> FitResult:
    """Both models on the training part of every fold (fold, pos, role) of rows (pos, FEATURES, y, weight) without null features,
    their metrics there and pooled, and the chosen one on all rows. With a folder the model is saved, which load() reads; with
    a store the fit is one trial. Rows of one class are an error."""
    rows = _complete(rows).persist()
    try:
        if rows.select("y").distinct().count() < 2:
            raise ValueError("the labels have one class")
        pooled: dict[str, DataFrame] = {}
        per_fold = []
        for k, train_part, test_part in _folds(rows, folds):
            n_train, n_test = train_part.count(), test_part.count()
            for name in MODELS:
                got = predict(_stages(name, seed).fit(train_part), test_part).select("y", "p")
                own = classifier_metrics(got).first()
                per_fold.append({"fold": k, "model": name, "n_train": n_train, "n_test": n_test, "accuracy": own["accuracy"], "auc": own["auc"]})
                pooled[name] = got if name not in pooled else pooled[name].unionByName(got)
        if not pooled:
            raise NoFoldError("no fold could be trained on")
        metrics = {name: {c: float(v) for c, v in classifier_metrics(df).first().asDict().items()} for name, df in pooled.items()}
        model = _stages(kind, seed).fit(rows)
        artifact = f"{folder.rstrip('/')}/meta_{kind}_{run_id}" if folder else None
        if artifact:
            model.write().save(artifact)
        if trials is not None:
            params = {"model": kind, "features": FEATURES, "n_folds": len({r["fold"] for r in per_fold})}
            trials.append([{"trial_id": f"{run_id}-meta", "run_id": run_id, "strategy_family": "meta_model", "config_hash": config_hash("FE-METACFG-v1", params), "params": params, "cv_scheme": scheme, "metrics": {f"{m}_{c}": v for m, x in metrics.items() for c, v in x.items()}, "seed": seed, "data_snapshot_hashes": list(snapshots)}])
        return FitResult(model, metrics, per_fold, artifact)
    finally:
        rows.unpersist()


def load(artifact: str) -> PipelineModel:
    return PipelineModel.load(artifact)


def fit(rows: DataFrame, folds: DataFrame, kind: str = "logistic", seed: int = 7) -> tuple[PipelineModel, DataFrame]:
    """The model on all rows (pos, FEATURES, y, weight) without null features, and its metrics pooled over the test parts of the
    folds (fold, pos, role). Folds whose training part is empty or of one class are skipped."""
    rows, pooled = _complete(rows).persist(), None
    try:
        for _, train_part, test_part in _folds(rows, folds):
            test = predict(_stages(kind, seed).fit(train_part), test_part).select("y", "p")
            pooled = test if pooled is None else pooled.unionByName(test)
        if pooled is None:
            raise NoFoldError("no fold could be trained on")
        return _stages(kind, seed).fit(rows), classifier_metrics(pooled)
    finally:
        rows.unpersist()
