"""Composed jobs: train, infer, model store, the batch detection cycle."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import detect as DT
from ..operators import features as FE
from ..operators import forest as FO
from ..operators import report as RP
from ..operators import response as RS
from ..params import Params
from ..session import cut_lineage
from ..sources.text_logs import read_baseline_jsonl

log = logging.getLogger(__name__)
FEATURES = list(K.FEATURE_NAMES)
#: Rows of an IP or user in one time bucket that the cycle leaves to one task.
HOT_ROWS = 200_000


class TrainingDataError(ValueError):
    pass


def training_guard(n: int, p: Params, enforce: bool = True) -> str:
    """Row-count checks before a fit: warn below 10 and 100, refuse below
    ``min_training_rows`` (1000)."""
    if n < 10:
        log.warning("very small training set (%d rows), model may not generalize", n)
    if n < 100:
        log.warning("small training dataset (%d rows), model may overfit", n)
    if n < p.min_training_rows:
        if enforce:
            raise TrainingDataError(f"insufficient baseline data: {n} < {p.min_training_rows}")
        return "insufficient"
    return "ok"


def train(spark: SparkSession, features: DataFrame, p: Params | None = None, enforce_guard: bool = True,
          key: str = "event_id") -> FO.ForestModel:
    """features -> scaler -> forest -> contamination offset."""
    p = p or Params()
    X = features.select(F.col(key), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    X = cut_lineage(X)
    n = X.count()
    training_guard(n, p, enforce_guard)
    return _fitted(spark, X, key, n, *FO.fit_scaler(X, FEATURES), p)


def train_from_baselines(spark: SparkSession, paths: list[str], p: Params | None = None, enforce_guard: bool = True) -> tuple[FO.ForestModel, DataFrame]:
    """(model, moments) from stored baselines of feature rows (JSON lines). Each baseline is
    read once and summed up as moments, which merge into the scaler, whatever their number;
    the rows then go to the forest."""
    p = p or Params()
    X, states = None, None
    for path in paths:
        rows = cut_lineage(read_baseline_jsonl(spark, path).na.drop(subset=FEATURES))
        state = FO.moments(rows, FEATURES)
        X, states = (rows, state) if X is None else (X.unionByName(rows), states.unionByName(state))
    merged = cut_lineage(FO.merged_moments(states))
    n = int((merged.agg(F.max("n")).first()[0]) or 0)
    training_guard(n, p, enforce_guard)
    return _fitted(spark, X, "event_id", n, *FO.scaler_of(merged, FEATURES), p), merged


def _fitted(spark: SparkSession, X: DataFrame, key: str, n: int, mean: tuple, std: tuple, p: Params) -> FO.ForestModel:
    Xs = FO.apply_scaler(X, FEATURES, mean, std)
    model = FO.fit_forest(spark, Xs, key, FEATURES, n, p)
    model.mean, model.std = mean, std
    scores = cut_lineage(FO.score(Xs, model, FEATURES).select("raw_score"))
    model.offset = FO.exact_quantile(scores, "raw_score", p.contamination)
    return model


def score_features(features: DataFrame, model: FO.ForestModel, p: Params | None = None) -> DataFrame:
    """Scaled scoring (scaler constants, broadcast forest) + detection columns."""
    p = p or Params()
    z = [c + "__z" for c in FEATURES]
    Xs = FO.apply_scaler(features, FEATURES, model.mean, model.std, suffix="__z")
    scored = FO.score(Xs, model, z).drop(*z)
    scored = scored.withColumn("is_anomaly", F.col("raw_score") < F.lit(model.offset))
    return DT.detect(scored, p)


def infer(spark: SparkSession, features: DataFrame, p: Params | None = None,
          model: FO.ForestModel | None = None, model_path: str | None = None) -> DataFrame:
    """Ensure a model (load on demand), then detect."""
    if model is None:
        if model_path is None:
            raise RuntimeError("model not trained and no model path given")
        model = load_model(spark, model_path)
    return score_features(features, model, p)


# ------------------------------------------------------------------ model store

def save_model(spark: SparkSession, model: FO.ForestModel, path: str) -> None:
    """Three Parquet tables: nodes, scaler, meta (no pickle)."""
    spark.createDataFrame(model.nodes, FO.NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    FO.scaler_table(spark, model.feature_names, model.mean, model.std).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    spark.createDataFrame([(model.psi, model.n_trees, float(model.offset), ",".join(model.feature_names))],
                          "psi int, n_trees int, offset double, feature_names string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> FO.ForestModel:
    meta = spark.read.parquet(f"{path}/meta").first()
    names = tuple(meta["feature_names"].split(","))
    sc = {r["feature"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    return FO.ForestModel(nodes=nodes, psi=meta["psi"], n_trees=meta["n_trees"], feature_names=names,
                          offset=meta["offset"], mean=tuple(sc[n][0] for n in names),
                          std=tuple(sc[n][1] for n in names))


# ------------------------------------------------------------------ detection cycle

@dataclass
class CycleResult:
    features: DataFrame
    detections: DataFrame
    anomalies: DataFrame
    actions: DataFrame
    incidents: DataFrame
    alerts: DataFrame
    audit: DataFrame


def cycle(spark: SparkSession, events: DataFrame, model: FO.ForestModel, p: Params | None = None,
          attach_actions: bool = True) -> CycleResult:
    """ingest -> features -> score -> filter -> decide/cooldown -> report/alert/audit.
    The anomaly rows are checkpointed once; every output is a lazy plan over them."""
    p = p or Params()
    if p.hot_rows is None and p.window_method == "delta":
        p = p.with_(hot_rows=HOT_ROWS)     # typed events are stored once, not parsed for each side
    feats = FE.extract_features(events, p)
    det = score_features(feats, model, p)
    # the anomaly rows feed two branches (actions, incidents): cut the lineage
    # once (reliable checkpoint in the shared folder) so features and the
    # Python scoring hop are not evaluated twice
    anomalies = cut_lineage(det.where(F.col("is_anomaly")))
    acts = RS.outcome(RS.apply_cooldown(RS.decide(anomalies, p), p), p)
    inc = RP.incidents(anomalies, p, actions=acts if attach_actions else None)
    return CycleResult(feats, det, anomalies, acts, inc, RP.alerts(inc), RS.audit_records(acts))
