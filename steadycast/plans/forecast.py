"""The whole job: features, models, calibration, trust, abstention and evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.functions.scalar import (
    abstains,
    configured_trust,
    data_quality,
    decide,
    persistence_probability,
    probability_confidence,
    trust_level,
)
from steadycast.operators import calibration, metrics, models, splits
from steadycast.operators.features import (
    CROSS_LAYER_FEATURES,
    add_features,
    prediction_stability,
)
from steadycast.operators.reshape import labelled_split
from steadycast.operators.sessions import hot_trajectories, label, lay_out
from steadycast.operators.slices import close
from steadycast.params import (
    ROW_KEY,
    SESSION,
    ModelParams,
    SessionParams,
    SplitParams,
    TrustPolicy,
)
from steadycast.session import run_dir
from steadycast.sources.tables import read_split, write_feature_table

LOGISTIC, FOREST, PERSISTENCE = "network_logistic", "cross_layer_random_forest", "persistence"
METHODS = (calibration.SIGMOID, calibration.ISOTONIC)
TARGET = "future_poor_qoe"
ROWS_PER_TASK = 5_000
"""Rows a task scores with all models."""
TABLE_COLUMNS = list(
    dict.fromkeys(
        [*SESSION, "session_id", "timestamp", "future_timestamp", "prediction_lead_seconds",
         TARGET, *CROSS_LAYER_FEATURES]
    )
)


@dataclass(frozen=True)
class ForecastParams:
    sessions: SessionParams = SessionParams()
    splits: SplitParams = SplitParams()
    models: ModelParams = ModelParams()
    policy: TrustPolicy = field(default_factory=TrustPolicy)
    calibration_share: float = 0.5
    exact_medians: bool = True


@dataclass(frozen=True)
class Fitted:
    """Models, chosen calibrators and the frozen thresholds."""

    models: dict[str, PipelineModel]
    calibrators: dict[str, calibration.Calibrator]
    selection: dict[str, dict]
    abstention: float
    grid: calibration.Grid
    risk_coverage: DataFrame
    policy: TrustPolicy


def build_feature_table(observations: DataFrame, path: str, params: ForecastParams) -> None:
    """Observations to a stored feature table, partitioned by split."""
    hot = hot_trajectories(observations)
    horizon = params.sessions.horizon
    laid = lay_out(observations, hot, 5 + 2 * horizon, horizon)
    df = close(add_features(label(laid, params.sessions)))
    bounds = splits.boundaries(observations.select("timestamp"), params.splits)
    df = splits.remove_crossing_targets(splits.assign_split(df, bounds), bounds)
    columns = [c for c in TABLE_COLUMNS if c != "split"]
    write_feature_table(df.select(*columns, "split"), path)


def with_trust(df: DataFrame, selection: dict, policy: TrustPolicy, hot=None) -> DataFrame:
    """Decision, quality, stability and trust score from ``calibrated_probability``."""
    p = F.col("calibrated_probability")
    df = prediction_stability(df, "calibrated_probability", hot)
    return df.withColumns(
        {
            "predicted_poor_qoe": decide(p, selection["threshold"]),
            "model_confidence": probability_confidence(p, selection["threshold"]),
            "data_quality": data_quality(df.columns, CROSS_LAYER_FEATURES),
        }
    ).withColumn(
        "trust_score",
        configured_trust(
            F.col("model_confidence"), selection["f1"], selection["expected_calibration_error"],
            F.col("data_quality"), policy,
        ),
    )


def fit(spark, path: str, params: ForecastParams) -> Fitted:
    """Fit on train; calibrate, choose and set the abstention threshold on validation."""
    train = labelled_split(_table(spark, path, "train"), "train")
    # The features of the first model are among those of the second.
    fill = models.medians(train, models.NUMERIC_FEATURES, params.exact_medians)
    fitted = {
        LOGISTIC: models.fit_logistic(train, params.models, params.exact_medians, fill),
        FOREST: models.fit_forest(train, params.models, params.exact_medians, fill),
    }
    validation = spread(labelled_split(_table(spark, path, "validation"), "validation"))
    for name, model in fitted.items():
        validation = models.score(model, validation, f"raw_{name}")
    # Both halves are read many times below: store the scored rows once.
    stored = run_dir(spark, "validation")
    validation.write.parquet(stored)
    validation = spark.read.parquet(stored)
    fit_half, select_half = splits.halve_validation(validation, params.calibration_share)

    calibrators, variants = {}, {}
    for name in fitted:
        for method in METHODS:
            made = calibration.fit_calibrator(method, fit_half, f"raw_{name}", TARGET)
            calibrators[(name, method)] = made
            variants[(name, method)] = f"{method}_{name}"
            select_half = made.apply(select_half, f"raw_{name}", f"{method}_{name}")
    rows = calibration.variant_rows(select_half, [TARGET], variants)
    grid = calibration.calibration_grid(rows, TARGET)
    chosen = {r["model"]: r.asDict() for r in calibration.choose_calibrator(grid.metrics).collect()}

    method = chosen[FOREST]["calibration_method"]
    trusted = select_half.withColumn("calibrated_probability", F.col(f"{method}_{FOREST}"))
    trusted = with_trust(trusted, chosen[FOREST], params.policy, hot_trajectories(trusted))
    risk = metrics.risk_coverage(trusted, TARGET, "predicted_poor_qoe", "trust_score")
    best = metrics.select_abstention(risk, params.policy.minimum_coverage).first()
    if best is None:
        raise ValueError("no abstention threshold reaches the minimum coverage")
    return Fitted(
        fitted,
        {name: calibrators[(name, chosen[name]["calibration_method"])] for name in fitted},
        chosen, best["abstention_threshold"], grid, risk, params.policy,
    )


def _table(spark, path: str, split: str) -> DataFrame:
    return read_split(spark, path, split, [*TABLE_COLUMNS, "split"])


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt out evenly by key: a split lies in few files, and scoring a row costs far more than moving it."""
    return df.repartition(max(1, -(-df.count() // rows_per_task)), *ROW_KEY)


def apply(spark, path: str, fitted: Fitted, params: ForecastParams) -> DataFrame:
    """Trusted predictions of the test rows: one pass, no row loop."""
    test = spread(labelled_split(_table(spark, path, "test"), "test"))
    for name, model in fitted.models.items():
        test = models.score(model, test, f"raw_{name}")
        test = fitted.calibrators[name].apply(test, f"raw_{name}", f"calibrated_{name}")
    test = test.withColumns(
        {
            "calibrated_probability": F.col(f"calibrated_{FOREST}"),
            "persistence_probability": persistence_probability(
                F.col("current_mos"), params.sessions.poor_mos
            ),
        }
    )
    test = with_trust(test, fitted.selection[FOREST], fitted.policy, hot_trajectories(test))
    score = F.col("trust_score")
    return test.withColumns(
        {
            "trust_level": trust_level(score, fitted.policy.high, fitted.policy.medium),
            "abstain": abstains(score, fitted.abstention, fitted.policy),
            "actual_future_poor_qoe": F.col(TARGET),
        }
    )


def comparison_rows(trusted: DataFrame, fitted: Fitted) -> DataFrame:
    """Three models on identical rows."""
    variants = {
        PERSISTENCE: ("persistence_probability", 0.5),
        **{n: (f"calibrated_{n}", fitted.selection[n]["threshold"]) for n in (LOGISTIC, FOREST)},
    }
    return metrics.unpivot_models(trusted, ["session_id", "user_id", "timestamp", TARGET], variants)


def compare_models(trusted: DataFrame, fitted: Fitted) -> DataFrame:
    """Metrics of the three models."""
    rows = comparison_rows(trusted, fitted)
    return metrics.binary_metrics(rows, TARGET, "prediction", "probability", ["model"])


@dataclass(frozen=True)
class Forecast:
    fitted: Fitted
    trusted: DataFrame
    feature_path: str


def run(observations: DataFrame, params: ForecastParams = ForecastParams()) -> Forecast:
    """Run all stages; every stage result is a table in the shared folder."""
    spark = observations.sparkSession
    features = run_dir(spark, "features")
    build_feature_table(observations, features, params)
    fitted = fit(spark, features, params)
    predictions = run_dir(spark, "predictions")
    apply(spark, features, fitted, params).write.parquet(predictions)
    return Forecast(fitted, spark.read.parquet(predictions), features)
