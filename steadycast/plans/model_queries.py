"""Registered queries: imputation, weights, fitted models, calibration and the whole job."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadycast.operators import bagging, calibration, metrics, models, reshape
from steadycast.operators.features import CROSS_LAYER_FEATURES, NETWORK_FEATURES
from steadycast.params import ModelParams
from steadycast.plans import forecast, views
from steadycast.plans.metric_queries import P, TARGET, scored
from steadycast.plans.oracle import over
from steadycast.plans.registry import query
from steadycast.plans.session_queries import r6, ts_us
from steadycast.session import run_dir

# Fixed number of fit partitions, fitting the test tables; a cluster uses more.
PARAMS = forecast.ForecastParams(sessions=views.SESSIONS, models=ModelParams(fit_partitions=8))
_RUNS: dict[tuple[str, str], forecast.Forecast] = {}


def train_rows(spark, sf_dir):
    t = views.with_split(spark, sf_dir, views.featured(spark, sf_dir))
    return reshape.labelled_split(t.frame, "train")


def whole_job(spark, sf_dir) -> forecast.Forecast:
    """The fitted job; fitted once per application and folder, as several queries read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = forecast.run(views.observations(spark, sf_dir), PARAMS)
    return _RUNS[key]


@query(
    "imputation_medians",
    over(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(median({c}), 6) AS median FROM kept WHERE split = 'train'"""
            for c in NETWORK_FEATURES
        )
    ),
)
def imputation_medians(spark, sf_dir):
    """Exact medians of the train features."""
    out = models.median_table(train_rows(spark, sf_dir), NETWORK_FEATURES)
    return out.select("column", *r6("median"))


@query(
    "most_frequent_category",
    over("SELECT resolution, count(*) AS rows FROM kept WHERE split = 'train' GROUP BY resolution ORDER BY rows DESC, resolution LIMIT 1"),
)
def most_frequent_category(spark, sf_dir):
    """Mode of a category."""
    return models.most_frequent(train_rows(spark, sf_dir), "resolution")


@query(
    "class_weights",
    over(
        """SELECT CAST(future_poor_qoe AS INT) AS label, count(*) AS rows,
           round((SELECT count(*) FROM kept WHERE split = 'train') / (2 * count(*)), 6) AS weight
           FROM kept WHERE split = 'train' GROUP BY future_poor_qoe"""
    ),
)
def class_weights(spark, sf_dir):
    """Balanced class weights."""
    return models.class_weights(train_rows(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query(
    "isotonic_calibration",
    over(
        "SELECT p, round(max(low), 6) AS calibrated FROM lows GROUP BY p",
        buckets="""SELECT round(calibrated_probability, 2) AS p, count(*) AS n, sum(actual_future_poor_qoe) AS y
            FROM scored WHERE split = 'validation' GROUP BY 1""",
        means="""SELECT m.p AS p, f.p AS p_from, t.p AS p_to, sum(b.y) / sum(b.n) AS mean
            FROM buckets m JOIN buckets f ON f.p <= m.p JOIN buckets t ON t.p >= m.p
            JOIN buckets b ON b.p BETWEEN f.p AND t.p GROUP BY ALL""",
        lows="SELECT p, p_from, min(mean) AS low FROM means GROUP BY p, p_from",
    ),
)
def isotonic_calibration(spark, sf_dir):
    """Isotonic fit on the validation rows, at scores of two places."""
    df = scored(spark, sf_dir).where(F.col("split") == "validation")
    df = df.select(F.round(P, 2).alias("p"), F.col(TARGET).alias("y"))
    fitted = calibration.fit_isotonic(df, "p", "y")
    return fitted.apply(df.select("p").distinct(), "p", "calibrated").select("p", *r6("calibrated"))


@query(
    "isotonic_calibration_unrounded",
    over(
        "SELECT p, round(max(low), 6) AS calibrated FROM lows GROUP BY p",
        buckets="""SELECT calibrated_probability AS p, count(*) AS n, sum(actual_future_poor_qoe) AS y
            FROM scored WHERE split = 'validation' GROUP BY 1""",
        sums="""SELECT p, n, y, sum(n) OVER (ORDER BY p) AS upto_n, sum(y) OVER (ORDER BY p) AS upto_y FROM buckets""",
        lows="""SELECT t.p AS p, min((t.upto_y - f.upto_y + f.y) / (t.upto_n - f.upto_n + f.n))
              OVER (PARTITION BY f.p ORDER BY t.p DESC ROWS UNBOUNDED PRECEDING) AS low
            FROM sums f JOIN sums t ON t.p >= f.p""",
    ),
)
def isotonic_calibration_unrounded(spark, sf_dir):
    """Isotonic fit on the validation rows, scores as they are; pooled in small ranges and merged, and joined as a table."""
    df = scored(spark, sf_dir).where(F.col("split") == "validation").select(F.col(P).alias("p"), F.col(TARGET).alias("y"))
    fitted = calibration.fit_isotonic(df, "p", "y", rows_per_range=200, corners=0)
    return fitted.apply(df.select("p").distinct(), "p", "calibrated").select("p", *r6("calibrated"))


_DRAWN = f"""SELECT CAST(future_poor_qoe AS INT) AS label, t AS tree,
    list_sum(list_transform([{', '.join(map(str, bagging.thresholds(0.5)))}], lambda b: CAST(b <= bits AS BIGINT))) AS k FROM (
      SELECT future_poor_qoe, t, CAST('0x' || substr(md5(concat_ws('|', session_id, user_id, event_id, '42:' || (t // 4))), 8 * (t % 4) + 1, 8) AS BIGINT) AS bits
      FROM kept, range(12) r(t) WHERE split = 'train')"""


@query(
    "bootstrap_weights",
    over(
        """SELECT CAST(tree AS INT) AS tree, label, CAST(sum(k) AS BIGINT) AS rows,
           round(sum(sum(k)) OVER (PARTITION BY tree) / (2 * sum(k)), 6) AS weight FROM drawn GROUP BY tree, label""",
        drawn=_DRAWN,
    ),
)
def bootstrap_weights(spark, sf_dir):
    """Drawn rows and class weight of each of twelve bootstraps of the train rows."""
    params = ModelParams(trees=12)
    drawn = bagging.with_draws(train_rows(spark, sf_dir), params, ["session_id", "user_id", "event_id"])
    out = bagging.bootstrap_weights(drawn, models.TARGET, params.trees)
    return out.select("tree", "label", "rows", F.round("weight", 6).alias("weight"))


@query("sigmoid_calibration")
def sigmoid_calibration(spark, sf_dir):
    """Calibration table of the selection period after a sigmoid fit on the validation rows."""
    df = scored(spark, sf_dir)
    fitted = calibration.fit_sigmoid(df.where(F.col("split") == "validation"), P, TARGET)
    test = fitted.apply(df.where(F.col("split") == "test"), P, "sigmoid_p")
    return metrics.reliability_table(test, TARGET, "sigmoid_p")


@query("forecast_model_comparison")
def forecast_model_comparison(spark, sf_dir):
    """Persistence, logistic regression and random forest on the same test rows."""
    job = whole_job(spark, sf_dir)
    return forecast.compare_models(job.trusted, job.fitted)


@query("forecast_calibration_grid")
def forecast_calibration_grid(spark, sf_dir):
    """Metrics of every model and calibration method on the selection half."""
    return whole_job(spark, sf_dir).fitted.grid.metrics


@query("forecast_calibration_choice")
def forecast_calibration_choice(spark, sf_dir):
    """Chosen method and threshold per model, as published."""
    chosen = calibration.choose_calibrator(whole_job(spark, sf_dir).fitted.grid.metrics)
    return chosen.select(
        "model", "calibration_method", F.col("threshold").alias("decision_threshold"),
        F.col("f1").alias("validation_f1"), F.col("pr_auc").alias("validation_pr_auc"),
        F.col("brier_score").alias("validation_brier_score"),
        F.col("expected_calibration_error").alias("validation_expected_calibration_error"),
    ).orderBy("validation_expected_calibration_error", "validation_brier_score")


@query("forecast_threshold_curves")
def forecast_threshold_curves(spark, sf_dir):
    """Threshold curves of all models and methods."""
    return whole_job(spark, sf_dir).fitted.grid.curves


@query("forecast_reliability_curves")
def forecast_reliability_curves(spark, sf_dir):
    """Reliability bins of all models and methods."""
    return whole_job(spark, sf_dir).fitted.grid.reliability


@query("forecast_risk_coverage")
def forecast_risk_coverage(spark, sf_dir):
    """Risk and coverage of the selection half with the chosen threshold marked."""
    fitted = whole_job(spark, sf_dir).fitted
    return metrics.annotate_risk_coverage(fitted.risk_coverage, fitted.abstention)


@query("forecast_trusted_predictions")
def forecast_trusted_predictions(spark, sf_dir):
    """Trusted predictions of the test rows."""
    return whole_job(spark, sf_dir).trusted.select(
        "session_id", F.col("timestamp").alias("timestamp"), *r6("calibrated_probability", "trust_score"),
        "predicted_poor_qoe", "trust_level", "abstain",
    )


@query("forecast_selective_summary")
def forecast_selective_summary(spark, sf_dir):
    """Coverage and accuracy of the accepted test rows."""
    return metrics.selective_summary(whole_job(spark, sf_dir).trusted, "actual_future_poor_qoe", "predicted_poor_qoe")


@query("forecast_group_metrics")
def forecast_group_metrics(spark, sf_dir):
    """Forest metrics per station, resource setting and bitrate."""
    return metrics.metrics_by_dimension(
        whole_job(spark, sf_dir).trusted, ["base_station", "prb", "bitrate_kbps"],
        "actual_future_poor_qoe", "predicted_poor_qoe", "calibrated_probability",
    )


@query("forest_importance")
def forest_importance(spark, sf_dir):
    """Importance of every model input."""
    job = whole_job(spark, sf_dir)
    sample = forecast._table(spark, job.feature_path, "train")
    return models.feature_importance(job.fitted.models[forecast.FOREST], sample)


@query("forest_top_features")
def forest_top_features(spark, sf_dir):
    """The ten most important inputs."""
    job = whole_job(spark, sf_dir)
    sample = forecast._table(spark, job.feature_path, "train")
    return models.top_features(models.feature_importance(job.fitted.models[forecast.FOREST], sample), 10)


@query(
    "model_round_trip",
    over("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS mismatches FROM kept WHERE split = 'test'"),
)
def model_round_trip(spark, sf_dir):
    """Scores of a saved and loaded model against those of the fitted one."""
    job = whole_job(spark, sf_dir)
    model = job.fitted.models[forecast.LOGISTIC]
    path = run_dir(spark, "model")
    models.save_model(model, path)
    test = forecast._table(spark, job.feature_path, "test")
    both = models.score(models.load_model(path), models.score(model, test, "a"), "b")
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"),
    )


@query(
    "feature_table_rows",
    over(
        f"""SELECT split, count(*) AS rows, {len(CROSS_LAYER_FEATURES)} AS features,
            count(gap_seconds) AS gaps, round(avg(throughput_mbps), 6) AS mean_throughput
            FROM kept GROUP BY split"""
    ),
)
def feature_table_rows(spark, sf_dir):
    """The stored feature table of the whole job, per split."""
    table = spark.read.parquet(whole_job(spark, sf_dir).feature_path)
    return table.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(set(CROSS_LAYER_FEATURES) & set(table.columns))).alias("features"),
        F.count("gap_seconds").alias("gaps"),
        F.round(F.avg("throughput_mbps"), 6).alias("mean_throughput"),
    )
