"""Retrain and gate: training rows, a challenger, the gate on held-out rows, the audit row."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidepath.constants import ETA_FEATURES
from glidepath.operators import demand, features, gate, learn, traffic
from glidepath.sources.catalog import Catalog

ETA_MODEL = "ml.eta_touchdown"


def build_training(cat: Catalog, day: str = "obs_day") -> None:
    """The arrival training set and the demand series, from the stored gold tables."""
    tracks = cat.read("tracks")
    inbound = traffic.common_ring_inbound(cat.read("congestion"))
    cat.replace("arrival_tracks", features.arrival_training_set(tracks, cat.read("touchdowns"), inbound))
    rows = features.training_rows(cat.read("arrival_tracks"), cat.read("touchdowns"))
    cat.replace("training", rows.withColumn(day, F.to_date("snapshot_ts")))
    cat.replace("demand_15m", demand.demand_series(cat.read("touchdowns")))


def register(cat: Catalog, model: PipelineModel, name: str, info: dict) -> int:
    """Saves a model as the next version and points `challenger` at it."""
    last = cat.read("models").where(F.col("model") == name).agg(F.max("version").alias("v")).first()["v"] if cat.exists("models") else None
    version = (last or 0) + 1
    path = f"{cat.root}/_models/{name}/{version}"
    model.write().save(path)
    row = cat.spark.range(1).select(
        F.lit(name).alias("model"), F.lit(version).cast("bigint").alias("version"), F.lit(path).alias("path"),
        F.array(*[F.lit(f) for f in ETA_FEATURES]).alias("inputs"), F.lit(float(info["val_mae"])).alias("val_mae"))
    cat.append("models", row)
    cat.point("challenger", name, version)
    return version


def load(cat: Catalog, name: str, version: int) -> PipelineModel:
    """A registered model, after checking that its inputs are the ones scored with."""
    row = cat.read("models").where((F.col("model") == name) & (F.col("version") == version)).first()
    learn.check_inputs(list(row["inputs"]), ETA_FEATURES)
    return PipelineModel.load(row["path"])


def run_gate(cat: Catalog, test: DataFrame, apply: bool, now, name: str = ETA_MODEL, max_regress: float = 0.15) -> DataFrame:
    """Scores challenger and champion on the same rows, appends the audit row, and moves the
    alias only when the gate passed and `apply` is set. Returns the audit row."""
    new, old = cat.pointed("challenger", name), cat.pointed("champion", name)
    challenger = features.band_report(learn.predict(load(cat, name, new), test), "predicted_eta_min")
    champion = None if old is None else features.band_report(learn.predict(load(cat, name, old), test), "predicted_eta_min")
    decision = gate.evaluate_gate(challenger, champion, max_regress)
    row = gate.audit_row(decision, name, new, old, apply, F.lit(now).cast("timestamp"))
    cat.append("promotion_audit", row)
    stored = cat.read("promotion_audit").where((F.col("audited_at") == F.lit(now).cast("timestamp")) & (F.col("challenger_version") == new))
    if stored.first()["applied"]:
        cat.point("champion", name, new)
    return stored


def retrain(cat: Catalog, day: str, test_day, apply: bool, now, **search) -> DataFrame:
    """Trains a challenger on the stored training rows and gates it."""
    rows = learn.split_by_day(cat.read("training"), day, test_day)
    model, info = learn.train_eta(rows, **search)
    register(cat, model, ETA_MODEL, info)
    return run_gate(cat, rows.where(F.col("part") == "test"), apply, now)
