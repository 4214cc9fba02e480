"""Probability calibration: sigmoid and isotonic, and the choice between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.functions.scalar import clip01
from steadycast.operators import isotonic
from steadycast.operators.metrics import (
    best_threshold,
    binary_metrics,
    reliability_table,
    threshold_sweep,
)
from steadycast.operators.ranks import ROWS_PER_RANGE

SIGMOID, ISOTONIC = "sigmoid", "isotonic"
CORNERS = 200_000


@dataclass(frozen=True)
class Calibrator:
    """A fitted calibrator; ``apply`` is a column expression, a Spark ML transform or a join."""

    method: str
    model: Any

    def apply(self, df: DataFrame, probability: str, output: str) -> DataFrame:
        """Add the calibrated probability, clipped to [0, 1]."""
        if self.method == SIGMOID:
            slope, intercept = self.model
            linear = F.lit(slope) * F.col(probability) + F.lit(intercept)
            return df.withColumn(output, clip01(1 / (1 + F.exp(-linear))))
        if isinstance(self.model, DataFrame):
            out = isotonic.interpolate(df, probability, self.model, "__calibrated")
            return out.withColumn(output, clip01(F.col("__calibrated"))).drop("__calibrated")
        ready = df.withColumn("__score", F.col(probability).cast("double"))
        out = self.model.transform(ready)
        return out.withColumn(output, clip01(F.col("__calibrated"))).drop("__score", "__calibrated")


def fit_sigmoid(df: DataFrame, probability: str, target: str) -> Calibrator:
    """One-feature logistic regression with C = 1 on the raw probability."""
    rows = df.count()
    if not rows:
        raise ValueError("a calibrator needs rows")
    ready = df.select(
        F.col(probability).cast("double").alias("p"), F.col(target).cast("double").alias("label")
    )
    ready = VectorAssembler(inputCols=["p"], outputCol="features").transform(ready)
    model = LogisticRegression(
        regParam=1.0 / rows, standardization=False, maxIter=2000, tol=1e-10
    ).fit(ready)
    return Calibrator(SIGMOID, (float(model.coefficients[0]), float(model.intercept)))


def fit_isotonic(
    df: DataFrame, probability: str, target: str, rows_per_range: int = ROWS_PER_RANGE, corners: int = CORNERS
) -> Calibrator:
    """Pool-adjacent-violators fit on distinct scores weighted by their rows, see ``isotonic``.

    Up to ``corners`` counted corners of the fitted line become a model that is sent to the tasks;
    a line of more stays a table, which is joined.
    """
    table = isotonic.knots(isotonic.fit_blocks(df, probability, target, rows_per_range)).checkpoint()
    found = table.count()
    if not found:
        raise ValueError("a calibrator needs rows")
    if found > corners:
        return Calibrator(ISOTONIC, table)
    # The corners rise already; fitting them again only turns the table into a model.
    model = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol="__calibrated").fit(table)
    return Calibrator(ISOTONIC, model.setFeaturesCol("__score").setPredictionCol("__calibrated"))


def fit_calibrator(method: str, df: DataFrame, probability: str, target: str) -> Calibrator:
    if method == SIGMOID:
        return fit_sigmoid(df, probability, target)
    if method == ISOTONIC:
        return fit_isotonic(df, probability, target)
    raise ValueError(f"unknown calibration method: {method}")


def variant_rows(df: DataFrame, keep: Sequence[str], variants: dict[tuple[str, str], str]) -> DataFrame:
    """One row per (row, model, method), from one scan."""
    cells = [
        F.struct(
            F.lit(model).alias("model"), F.lit(method).alias("calibration_method"),
            F.col(column).cast("double").alias("probability"),
        )
        for (model, method), column in variants.items()
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


GROUP = ["model", "calibration_method"]


@dataclass(frozen=True)
class Grid:
    """Result tables of a calibration grid, each keyed by (model, method)."""

    metrics: DataFrame
    curves: DataFrame
    reliability: DataFrame
    thresholds: dict[tuple[str, str], float]


def calibration_grid(rows: DataFrame, target: str) -> Grid:
    """Best threshold per variant, metrics at it, threshold curves and reliability bins."""
    curves = threshold_sweep(rows, target, "probability", GROUP)
    # One row per variant reaches the driver.
    found = {
        (r["model"], r["calibration_method"]): r["threshold"]
        for r in best_threshold(curves, GROUP).collect()
    }
    cut = None
    for (model, method), threshold in found.items():
        here = (F.col("model") == model) & (F.col("calibration_method") == method)
        cut = F.when(here, threshold) if cut is None else cut.when(here, threshold)
    decided = rows.withColumn("threshold", cut).withColumn(
        "decision", (F.col("probability") >= F.col("threshold")).cast("int")
    )
    table = binary_metrics(decided, target, "decision", "probability", [*GROUP, "threshold"])
    return Grid(table, curves, reliability_table(rows, target, "probability", GROUP), found)


def choose_calibrator(metrics: DataFrame) -> DataFrame:
    """Per model, the variant with the least (calibration error, Brier score, -F1)."""
    order = F.struct("expected_calibration_error", "brier_score", -F.col("f1"), "calibration_method")
    fields = [c for c in metrics.columns if c != "model"]
    return metrics.groupBy("model").agg(F.min_by(F.struct(*fields), order).alias("__b")).select(
        "model", "__b.*"
    )
