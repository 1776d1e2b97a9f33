"""Training, evaluation and scoring of the time-to-landing and hold-risk models with Spark ML."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glidepath.constants import ETA_FEATURES, ETA_LABEL, HOLD_FEATURES, PHASES
from glidepath.operators.features import NUMERIC_FEATURES, band_report, overall_accuracy
from glidepath.sources.catalog import schema_drift, stored

# Columns whose absence itself informs the model.
OFTEN_MISSING = ["vrate_fpm", "closure_kt", "turn_rate_dps", "sel_altitude_ft"]


def model_inputs(df: DataFrame) -> DataFrame:
    """Numeric inputs as doubles in `<name>_f`, zero where absent, with `_missing` marks for those
    often absent, so that a tree can split on the absence; and a known phase."""
    out = {f"{c}_f": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES}
    out |= {f"{c}_missing": F.col(c).isNull().cast("double") for c in OFTEN_MISSING}
    out["phase"] = F.coalesce("phase", F.lit("unknown"))
    return df.withColumns(out)


def split_by_day(df: DataFrame, day: str, test_day, group: str = "seg_id", min_share: float = 0.4) -> DataFrame:
    """Adds `part`: test is one day; validation is the latest other day, or, when that leaves less
    than `min_share` of the rest to train on, one fifth of the whole groups by hash."""
    per_day = {r[day]: r["n"] for r in df.groupBy(day).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per day
    rest = {d: n for d, n in per_day.items() if d != test_day}
    if not rest:
        raise ValueError("no day is left to train on")
    val_day, total = max(rest), sum(rest.values())
    if total - rest[val_day] >= min_share * total:
        is_val = F.col(day) == F.lit(val_day)
    else:
        is_val = F.pmod(F.xxhash64(group), F.lit(100)) >= 80
    return df.withColumn("part", F.when(F.col(day) == F.lit(test_day), "test").when(is_val, "val").otherwise("train"))


def _prepare() -> list:
    phase = StringIndexerModel.from_labels(PHASES, inputCol="phase", outputCol="phase_idx", handleInvalid="keep")
    columns = [f"{c}_f" for c in NUMERIC_FEATURES] + ["phase_idx"] + [f"{c}_missing" for c in OFTEN_MISSING]
    return [phase, VectorAssembler(inputCols=columns, outputCol="features")]


def _regressor(params: dict, trees: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=ETA_LABEL, predictionCol="raw_pred", lossType="absolute", maxIter=trees, seed=42,
                        maxDepth=params["depth"], stepSize=params["step"], subsamplingRate=params["sample"],
                        minInstancesPerNode=params["leaf"])


def sampled_params(n: int, seed: int = 42) -> list[dict]:
    """Random points of the search space."""
    rng = random.Random(seed)
    return [{"depth": rng.randint(3, 7), "step": round(10 ** rng.uniform(-1.5, -0.3), 4), "sample": round(rng.uniform(0.5, 1.0), 2),
             "leaf": rng.choice([1, 5, 10, 20])} for _ in range(n)]


def mean_abs_error(df: DataFrame, pred: str = "raw_pred") -> float:
    return df.agg(F.avg(F.abs(F.col(pred) - F.col(ETA_LABEL)))).first()[0]


def train_eta(rows: DataFrame, n_params: int = 5, max_trees: int = 60) -> tuple[PipelineModel, dict]:
    """Searches on the validation part, then refits on train and validation with 15% more trees.

    `rows` carries `part` from `split_by_day`. Boosting stops early on validation error.
    """
    known = model_inputs(rows.where(F.col("part").isin("train", "val"))).withColumn("is_val", F.col("part") == "val")
    prepared = Pipeline(stages=_prepare()).fit(known.where(~F.col("is_val"))).transform(known).persist()
    best = None
    for params in sampled_params(n_params):
        est = _regressor(params, max_trees).setValidationIndicatorCol("is_val")
        fitted = est.fit(prepared)
        mae = mean_abs_error(fitted.transform(prepared.where("is_val")))
        if best is None or mae < best["val_mae"]:
            best = {"params": params, "val_mae": mae, "trees": fitted.getNumTrees}
    prepared.unpersist()
    trees = max(5, round(best["trees"] * 1.15))
    model = Pipeline(stages=[*_prepare(), _regressor(best["params"], trees)]).fit(known)
    return model, best | {"final_trees": trees}


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `predicted_eta_min`, never negative."""
    scored = model.transform(model_inputs(rows))
    return scored.withColumn("predicted_eta_min", F.greatest("raw_pred", F.lit(0.0))).select(*rows.columns, "predicted_eta_min")


def holdout_report(model: PipelineModel, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors by band, and overall errors against the baseline, on the test part."""
    scored = predict(model, test)
    return band_report(scored, "predicted_eta_min"), overall_accuracy(scored, "predicted_eta_min", "baseline_pred")


def importances(model: PipelineModel, like: DataFrame) -> DataFrame:
    """Feature importances, largest first; a feature's missing mark counts with the feature."""
    names = NUMERIC_FEATURES + ["phase"] + OFTEN_MISSING
    weights: dict[str, float] = {}
    for name, w in zip(names, model.stages[-1].featureImportances.toArray()):
        weights[name] = weights.get(name, 0.0) + float(w)
    rows = sorted(weights.items(), key=lambda kv: -kv[1])
    return like.sparkSession.createDataFrame(rows, "feature string, importance double")


def assembled(stages: list) -> list[str]:
    """The columns that a pipeline's stages hand to its model, in their order."""
    return next(list(s.getInputCols()) for s in stages if isinstance(s, VectorAssembler))


def check_inputs(model_features: list[str], given: list[str]) -> None:
    """Fails when the given columns lack a model input or hold them in another order."""
    drift = schema_drift(model_features, given)
    if drift["missing"] or not drift["ordered"]:
        raise ValueError(f"model inputs differ from the given columns: {drift}")


def score_batch(model: PipelineModel, rows: DataFrame, version: int, scored_at: Column) -> DataFrame:
    """Prediction rows of one run, on the cluster from end to end."""
    check_inputs(ETA_FEATURES, [c for c in ETA_FEATURES if c in rows.columns])
    check_inputs(assembled(model.stages), assembled(_prepare()))
    scored = predict(model, rows)
    arrive = F.timestamp_micros(F.unix_micros("snapshot_ts") + F.round(F.col("predicted_eta_min") * 60_000_000).cast("bigint"))
    return scored.select(
        scored_at.alias("scored_at"), F.lit(version).cast("bigint").alias("model_version"), "icao", "callsign", "ac_type", "apt_icao",
        "snapshot_ts", "lat", "lon", "predicted_eta_min", arrive.alias("predicted_touchdown_ts"), *ETA_FEATURES)


def feature_effects(model: PipelineModel, rows: DataFrame, key: list[str], top: int = 6) -> DataFrame:
    """Per row, the inputs whose replacement by their mean changes the prediction most.

    Each row is repeated once per feature, so the work is a plain transform of a wider table; the
    phase is replaced by `unknown`.
    """
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in NUMERIC_FEATURES])
    wide = rows.select(*key, *ETA_FEATURES).crossJoin(F.broadcast(means.select(F.struct(*NUMERIC_FEATURES).alias("_m"))))
    variants = wide.withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(c) for c in ETA_FEATURES])))
    swapped = {c: F.when(F.col("feature") == c, F.col(f"_m.{c}")).otherwise(F.col(c).cast("double")) for c in NUMERIC_FEATURES}
    swapped["phase"] = F.when(F.col("feature") == "phase", "unknown").otherwise(F.col("phase"))
    scored = predict(model, variants.withColumns(swapped).drop("_m"))
    # at most one row per feature and key
    per_row = scored.groupBy(*key).agg(
        F.max(F.when(F.col("feature") == "", F.col("predicted_eta_min"))).alias("predicted_eta_min"),
        F.collect_list(F.when(F.col("feature") != "", F.struct("feature", "predicted_eta_min"))).alias("_v"))
    effect = F.transform("_v", lambda v: F.struct(
        (-F.abs(F.col("predicted_eta_min") - v["predicted_eta_min"])).alias("_size"), v["feature"].alias("feature"),
        (F.col("predicted_eta_min") - v["predicted_eta_min"]).alias("effect_min")))
    best = F.transform(F.slice(F.sort_array(effect), 1, top), lambda e: F.struct(e["feature"].alias("feature"), e["effect_min"].alias("effect_min")))
    return per_row.select(*key, "predicted_eta_min", F.inline(best))


def hold_rows(tracks: DataFrame, held: DataFrame, band=(20.0, 60.0)) -> DataFrame:
    """Decision-band reports with the hold label; rows with a missing input are left out."""
    at = F.col("dist_to_apt_nm")
    rows = tracks.where(at.between(*band) & (F.col("gs_kt") > 60)).withColumns({
        "naive_eta_min": at / F.col("gs_kt") * 60, "hour_utc": F.hour("snapshot_ts"), "dow": F.dayofweek("snapshot_ts")})
    labelled = rows.join(held.select("seg_id", F.lit(1).alias("_held")), "seg_id", "left").withColumn(
        "is_held", F.coalesce("_held", F.lit(0))).drop("_held")
    return labelled.withColumns({c: F.col(c).cast("double") for c in HOLD_FEATURES}).dropna(subset=HOLD_FEATURES)


def balanced_folds(rows: DataFrame, folds: int = 5, group: str = "seg_id", label: str = "is_held", bucket: int = 50_000) -> DataFrame:
    """`group`, `positive` (any of its rows), `n` rows and `fold` for each group: whole groups, with the classes shared out evenly.

    Groups of a class are dealt back and forth by their size, so folds differ by one group per class, and little in rows. Beyond `bucket`
    groups they are dealt within buckets of about that many, each beginning at another fold, so no task sees a whole class.
    """
    groups = rows.groupBy(group).agg(F.max(label).alias("positive"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "fold-groups")
    buckets = max(1, -(-groups.count() // bucket))
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("positive", "_bucket").orderBy(F.desc("n"), group)) - 1
    at = place % folds
    turn = F.when(F.floor(place / folds) % 2 == 0, at).otherwise(folds - 1 - at)
    # the rarer class begins at the other end, so that the extra groups of both do not meet in one fold
    turn = F.when(F.col("positive") == 1, folds - 1 - turn).otherwise(turn)
    return dealt.withColumn("fold", F.pmod(turn + F.col("_bucket"), F.lit(folds)).cast("int")).drop("_bucket")


def train_hold_risk(rows: DataFrame, min_positive_groups: int = 40, folds: int = 5, trees: int = 20) -> tuple[object | None, dict]:
    """Class-weighted boosted classifier with grouped, stratified cross-validation (see `balanced_folds`).

    Too few positive segments end the training early with the finding instead of a model.
    """
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("is_held").alias("pos"),
                     F.count_distinct(F.when(F.col("is_held") == 1, F.col("seg_id"))).alias("groups")).first()
    if stats["groups"] < min_positive_groups:
        return None, {"finding": f"{stats['groups']} positive segments, {min_positive_groups} needed"}
    base = stats["pos"] / stats["n"]
    weight = F.when(F.col("is_held") == 1, F.lit((stats["n"] - stats["pos"]) / stats["pos"])).otherwise(1.0)
    dealt = rows.join(balanced_folds(rows, folds).select("seg_id", "fold"), "seg_id")
    data = VectorAssembler(inputCols=HOLD_FEATURES, outputCol="features").transform(
        dealt.withColumns({"label": F.col("is_held").cast("double"), "weight": weight}))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.1, seed=42)
    data = data.persist()
    scores = {"cv_ap": 0.0, "cv_roc": 0.0}
    for fold in range(folds):
        out = gbt.fit(data.where(F.col("fold") != fold)).transform(data.where(F.col("fold") == fold)).select("label", "rawPrediction").persist()
        for name, metric in (("cv_ap", "areaUnderPR"), ("cv_roc", "areaUnderROC")):
            scores[name] += BinaryClassificationEvaluator(labelCol="label", metricName=metric).evaluate(out) / folds
        out.unpersist()
    model = gbt.fit(data)
    data.unpersist()
    return model, scores | {"base_rate": base, "lift": scores["cv_ap"] / base if base else None}


def hold_risk(model, rows: DataFrame) -> DataFrame:
    """Adds `risk`, the probability of a hold."""
    data = VectorAssembler(inputCols=HOLD_FEATURES, outputCol="features").transform(rows)
    return model.transform(data).withColumn("risk", vector_to_array("probability")[1]).select(*rows.columns, "risk")


def compare_versions(old_rows: DataFrame, new_rows: DataFrame, test: DataFrame, **kw) -> DataFrame:
    """Fits on two versions of the training rows and reports both on one test set by band."""
    out = None
    for name, rows in (("old", old_rows), ("new", new_rows)):
        model, _ = train_eta(rows, **kw)
        report = band_report(predict(model, test), "predicted_eta_min").withColumn("trained_on", F.lit(name))
        out = report if out is None else out.unionByName(report)
    return out
