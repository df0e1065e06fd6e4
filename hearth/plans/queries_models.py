"""Registered queries: MLlib models and their evaluation (SURVEY 2.10, 2.11, SRC-10,
SRT-5) and scoring with fitted models. Model outputs are not SQL-expressible: rows-only
checks, plus invariant tests in tests/test_models.py."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hearth.operators import boosting
from hearth.operators import models as M
from hearth.operators import training as tr
from hearth.operators import scoring as sc
from hearth.operators.scoring import Forecasters
from hearth.plans.queries_scoring import AS_OF, _req_sql
from hearth.plans.queries_training import TARGETS, encoded_matrix
from hearth.plans.registry import register
from hearth.session import materialize
from hearth.sources import panels as P
from hearth.streaming import requests as S

DEFAULT_TARGET = "target_return_3m"


def _matrix(spark, sf, columns=False):
    """The assembled matrix; ``columns`` keeps the features as columns as well."""
    m, feats = encoded_matrix(spark, sf)
    return M.assembled(m, feats, ["RegionName", "Date", "split", *(feats if columns else ()), *TARGETS]), feats


def _columns(spark, sf):
    """The matrix with its features as columns, written once."""
    m, feats = encoded_matrix(spark, sf)
    return materialize(m.select("RegionName", "Date", "split", *feats, *TARGETS), "matrix"), feats


@register("train_gbt")
def train_gbt(spark, sf):
    mat, _ = _matrix(spark, sf)
    model = M.train_gbt(mat, DEFAULT_TARGET)
    test = mat.where(F.col("split") == "test")
    return model.transform(test).select("RegionName", "Date", F.col(DEFAULT_TARGET).alias("y"), "prediction")


@register("validation_curve")
def validation_curve(spark, sf):
    """EVL-2: the curve by which the default target's boosted model is cut."""
    mat, _ = _matrix(spark, sf)
    return M.validation_curve(mat, DEFAULT_TARGET)


#: A short job of the regularised booster: the search draws the reference's ranges, the trees are bounded.
REGULARISED = boosting.BoostParams(trees=12, max_depth=4, max_leaves=12, rate=0.1, alpha=1.0, lambda_=5.0, row_share=0.8, feature_share=0.8)


@register("train_regularised")
def train_regularised(spark, sf):
    """ML-3: leaf-wise trees with L1 and L2 penalties, cut on the validation split; predictions of the test split."""
    mat, feats = _columns(spark, sf)
    model = boosting.fit(mat, feats, DEFAULT_TARGET, REGULARISED)
    return model.predict(mat.where(F.col("split") == "test")).select("RegionName", "Date", F.col(DEFAULT_TARGET).alias("y"), "prediction")


@register("tune_regularised")
def tune_regularised(spark, sf):
    """ML-3: seeded trials of penalties, leaves and shares by validation RMSE."""
    mat, feats = _columns(spark, sf)
    trials = [replace(p, trees=REGULARISED.trees, max_depth=min(p.max_depth, REGULARISED.max_depth)) for p in boosting.draw(M.TRAINING_TRIALS)]
    return boosting.tune(mat, feats, DEFAULT_TARGET, trials)[0]


@register("tune_gbt")
def tune_gbt(spark, sf):
    mat, _ = _matrix(spark, sf)
    return M.tune_gbt(mat, DEFAULT_TARGET, n_trials=M.TRAINING_TRIALS)


@register("ensemble_predict")
def ensemble_predict(spark, sf):
    mat, _ = _matrix(spark, sf)
    return M.ensemble_predictions(mat, "target_return_1m")


@register("train_all_horizons")
def train_all_horizons(spark, sf):
    mat, feats = _matrix(spark, sf)
    return M.train_all_horizons(mat, TARGETS, len(feats))[0]


@register("model_ranking")
def model_ranking(spark, sf):
    """SRT-5: models for the default target by test RMSE, best first."""
    mat, feats = _matrix(spark, sf)
    return M.train_all_horizons(mat, [DEFAULT_TARGET], len(feats))[0].orderBy("rank")


@register("save_model")
def save_model(spark, sf):
    """SRC-10: save the best model's bundle, load it back and score the test split."""
    mat, feats = _matrix(spark, sf, columns=True)
    ev, models = M.train_all_horizons(mat, [DEFAULT_TARGET], len(feats))
    scaler = tr.scaler_statistics(mat, feats, F.col("split") == "train")
    model, name, features, scaler = M.load_best(spark, M.save_best(ev, models, DEFAULT_TARGET, feats, scaler))
    scored = model.transform(mat.where(F.col("split") == "test").drop("features"))
    return scored.agg(F.count(F.lit(1)).alias("scored_rows"), F.avg("prediction").alias("mean_prediction")).select(
        F.lit(DEFAULT_TARGET).alias("target"), F.lit(name).alias("model"), F.lit(len(features)).alias("n_features"),
        F.lit(scaler.count()).alias("n_scaled"), "scored_rows", "mean_prediction")


_SCORED_TARGETS = ("target_return_1m", "target_return_3m")


def forecasters(spark, sf) -> Forecasters:
    """The best 1- and 3-month models, trained, saved, and loaded back."""
    mat, feats = _matrix(spark, sf, columns=True)
    ev, models = M.train_all_horizons(mat, _SCORED_TARGETS, len(feats))
    scaler = tr.scaler_statistics(mat, feats, F.col("split") == "train")
    loaded = [M.load_best(spark, M.save_best(ev, models, t, feats, scaler)) for t in _SCORED_TARGETS]
    (a, name_a, features, _), (b, name_b, _, _) = loaded
    return Forecasters(a.stages[-1], b.stages[-1], tuple(features), name_a, name_b)


_MODEL_SCORE_SQL = _req_sql("SELECT request_id, valid AS success, CASE WHEN NOT valid THEN errors END AS error, valid AS scored, "
                            "CASE WHEN valid THEN true END AS within_limits FROM val")


@register("model_score", _MODEL_SCORE_SQL)
def model_score(spark, sf):
    """SCR-2..12 with fitted models: vector, saved bundles, adjustment, clipping, intervals,
    risk. What SQL can tell: which requests are scored, and that the clipped returns and
    their intervals keep their limits; the predictions themselves are in ``scoring.score``."""
    return _told(sc.score(P.requests(spark, sf), None, AS_OF, models=forecasters(spark, sf)))


def linear_forecasters(spark, sf) -> Forecasters:
    """A small bundle: linear models of both targets, fitted, saved, and loaded back."""
    mat, feats = _matrix(spark, sf, columns=True)
    scaler = materialize(tr.scaler_statistics(mat, feats, F.col("split") == "train"), "scaler")  # both bundles hold it
    out = []
    for t in _SCORED_TARGETS:
        models = {(t, "linear"): M.model_zoo(t)["linear"].fit(mat.where(F.col("split") == "train").where(F.col(t).isNotNull()))}
        ev = M.metrics(M.predictions(models[t, "linear"], mat, t, "linear")).withColumn("best", F.lit(True))
        out.append(M.load_best(spark, M.save_best(ev, models, t, feats, scaler)))
    (a, name_a, features, _), (b, name_b, _, _) = out
    return Forecasters(a.stages[-1], b.stages[-1], tuple(features), name_a, name_b)


@register("stream_model_score", _MODEL_SCORE_SQL)
def stream_model_score(spark, sf):
    """STR-3 with a fitted bundle: requests scored by saved and loaded models as they arrive."""
    return _told(S.stream_score(spark, sf, None, AS_OF, models=linear_forecasters(spark, sf)))


def _told(s):
    """The columns of scored requests that SQL can tell."""
    kept = (F.col("return_1m").between(*sc.CLIP_1M) & F.col("return_3m").between(*sc.CLIP_3M)
            & (F.col("return_1m_lower") < F.col("return_1m_upper")) & (F.col("return_3m_lower") < F.col("return_3m_upper")))
    return s.select("request_id", "success", "error", (F.col("return_1m").isNotNull() & F.col("risk_category").isNotNull()).alias("scored"),
                    F.when(F.col("success"), kept).alias("within_limits"))
