"""Binary classification and calibration metrics, per group, without single-task sorts.

All metrics of a group come from one table of distinct probabilities with counts: one
combined shuffle by (group, probability), running totals, then two small aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadycast.functions.scalar import bin_edges, right_closed_bin
from steadycast.operators.ranks import ROWS_PER_RANGE, running_totals

THRESHOLD_STEP = (0.05 + 0.01) - 0.05
# 91 thresholds from 0.05 in steps of 0.01, as the doubles of that sum.
THRESHOLDS = [0.05 + i * THRESHOLD_STEP for i in range(91)]


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def _counts(target: Column, decision: Column) -> dict[str, Column]:
    return {
        "true_negatives": F.count_if((target == 0) & (decision == 0)),
        "false_positives": F.count_if((target == 0) & (decision == 1)),
        "false_negatives": F.count_if((target == 1) & (decision == 0)),
        "true_positives": F.count_if((target == 1) & (decision == 1)),
    }


def confusion_counts(df: DataFrame, target: str, decision: str, groups: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group."""
    cells = _counts(F.col(target), F.col(decision))
    return df.groupBy(*groups).agg(*[c.alias(n) for n, c in cells.items()])


def confusion_matrix(df: DataFrame, target: str, decision: str) -> DataFrame:
    """Two rows (actual), two columns (predicted)."""
    cells = df.select(F.col(target).cast("int").alias("actual"), F.col(decision).cast("int").alias("d"))
    counted = cells.groupBy("actual").pivot("d", [0, 1]).count().na.fill(0)
    return counted.toDF("actual", "predicted_0", "predicted_1")


def rates_from_counts(df: DataFrame) -> DataFrame:
    """Add rates to a table holding the four counts."""
    tn, fp = F.col("true_negatives"), F.col("false_positives")
    fn, tp = F.col("false_negatives"), F.col("true_positives")
    n = tn + fp + fn + tp
    return df.withColumns(
        {
            "observations": n,
            "positive_rate": _ratio(tp + fn, n),
            "accuracy": _ratio(tp + tn, n),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "false_alarm_rate": _ratio(fp, fp + tn),
            "miss_rate": _ratio(fn, fn + tp),
        }
    )


def decision_metrics(df: DataFrame, target: str, decision: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at a stored decision."""
    return rates_from_counts(confusion_counts(df, target, decision, groups))


def score_table(
    df: DataFrame,
    target: str,
    decision: str,
    probability: str,
    groups: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Distinct probabilities per group, with counts and descending running totals."""
    y, d = F.col(target), F.col(decision)
    counts = df.groupBy(*groups, F.col(probability).alias("__p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y.cast("long")).alias("pos"),
        *[c.alias(n) for n, c in _counts(y, d).items()],
    )
    return running_totals(
        counts, "__p", ["n", "pos"], groups, descending=True, rows_per_range=rows_per_range
    )


def binary_metrics(
    df: DataFrame,
    target: str,
    decision: str,
    probability: str,
    groups: Sequence[str] = (),
    *,
    bins: int = 10,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Counts, rates, average precision, ROC-AUC, Brier score and calibration error.

    Equal probabilities enter the ranking metrics together. ROC-AUC is null when a group
    has one class; average precision is 0 when it has no positive.
    """
    p, n, pos = F.col("__p"), F.col("n"), F.col("pos")
    cells = ["true_negatives", "false_positives", "false_negatives", "true_positives"]
    scores = score_table(df, target, decision, probability, groups, rows_per_range)
    by_bin = scores.groupBy(*groups, right_closed_bin(p, bins).alias("__bin")).agg(
        *[F.sum(c).alias(c) for c in cells],
        F.sum(n * p).alias("sum_p"),
        F.sum(pos).alias("sum_y"),
        F.sum(n * p * p - 2 * p * pos + pos).alias("squared"),
        F.sum(pos * (F.col("cum_pos") / F.col("cum_n"))).alias("ap"),
        F.sum((n - pos) * (F.col("cum_pos") - pos + pos / F.lit(2.0))).alias("pairs"),
    )
    total = by_bin.groupBy(*groups).agg(
        *[F.sum(c).alias(c) for c in cells],
        F.sum("squared").alias("squared"),
        F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))).alias("deviation"),
        F.sum("ap").alias("ap"),
        F.sum("pairs").alias("pairs"),
    )
    total = rates_from_counts(total)
    positives = F.col("true_positives") + F.col("false_negatives")
    negatives = F.col("observations") - positives
    return total.select(
        *groups,
        "observations", "positive_rate", "accuracy", "precision", "recall", "f1",
        _ratio(F.col("ap"), positives).alias("pr_auc"),
        (F.col("squared") / F.col("observations")).alias("brier_score"),
        (F.col("deviation") / F.col("observations")).alias("expected_calibration_error"),
        *cells,
        "false_alarm_rate", "miss_rate",
        F.try_divide(F.col("pairs"), (positives * negatives).cast("double")).alias("roc_auc"),
    )


def metrics_at_threshold(
    df: DataFrame, target: str, probability: str, threshold: float, groups: Sequence[str] = ()
) -> DataFrame:
    """All metrics with the decision taken at ``threshold``."""
    decided = df.withColumn("__d", (F.col(probability) >= F.lit(threshold)).cast("int"))
    return binary_metrics(decided, target, "__d", probability, groups).withColumn(
        "threshold", F.lit(threshold)
    )


def metrics_by_dimension(
    df: DataFrame, dimensions: Sequence[str], target: str, decision: str, probability: str
) -> DataFrame:
    """Metrics per value of each dimension, from one exploded key and one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    long = df.select(target, decision, probability, F.inline(pairs))
    return binary_metrics(long, target, decision, probability, ["dimension", "value"])


def scope_metrics(df: DataFrame, target: str, decision: str, probability: str) -> DataFrame:
    """Metrics over all rows and over accepted rows."""
    scopes = F.when(F.col("abstain"), F.array(F.lit("all"))).otherwise(
        F.array(F.lit("all"), F.lit("accepted"))
    )
    long = df.select(target, decision, probability, F.explode(scopes).alias("scope"))
    return binary_metrics(long, target, decision, probability, ["scope"])


def reliability_table(
    df: DataFrame, target: str, probability: str, groups: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Non-empty right-closed bins with their bounds, count and means."""
    edges = [0.0, *bin_edges(bins), 1.0]
    index = right_closed_bin(F.col(probability), bins)
    bounds = F.array(*[F.lit(e) for e in edges])
    return (
        df.groupBy(*groups, index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(probability).alias("mean_probability"),
            F.avg(F.col(target).cast("double")).alias("observed_frequency"),
        )
        .withColumns(
            {
                "lower_bound": F.element_at(bounds, F.col("bin")),
                "upper_bound": F.element_at(bounds, F.col("bin") + 1),
            }
        )
    )


def threshold_sweep(
    df: DataFrame,
    target: str,
    probability: str,
    groups: Sequence[str] = (),
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """F1, precision and recall at every threshold, from one scan.

    Each row counts for the highest threshold it reaches; a reverse running total over the
    at most ``len(thresholds) + 1`` counts per group gives the rows at or above each one.
    """
    splits = [float("-inf"), *thresholds, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="__p", outputCol="__k").transform(
        df.select(*groups, F.col(probability).alias("__p"), F.col(target).cast("long").alias("__y"))
    )
    counts = placed.groupBy(*groups, F.col("__k").cast("int").alias("__k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("pos")
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(len(thresholds)))).alias("__k")
    zero = F.lit(0).cast("long")
    empty = counts.select(*groups).distinct().select(
        *groups, every, zero.alias("n"), zero.alias("pos")
    )
    counts = counts.unionByName(empty).groupBy(*groups, "__k").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    above = Window.partitionBy(*groups).orderBy(F.col("__k").desc())
    above = above.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    values = F.array(*[F.lit(t) for t in thresholds])
    tp, reached, positives = F.col("tp"), F.col("reached"), F.col("positives")
    return (
        counts.select(
            *groups, "__k",
            F.sum("pos").over(above).alias("tp"),
            F.sum("n").over(above).alias("reached"),
            F.sum("pos").over(whole).alias("positives"),
        )
        .where(F.col("__k") >= 1)
        .select(
            *groups,
            F.element_at(values, F.col("__k")).alias("threshold"),
            _ratio(2 * tp, reached + positives).alias("f1"),
            _ratio(tp, reached).alias("precision"),
            _ratio(tp, positives).alias("recall"),
        )
    )


def best_threshold(sweep: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Highest (f1, precision); equal pairs take the lowest threshold."""
    order = F.struct("f1", "precision", -F.col("threshold"))
    picked = F.max_by(F.struct("threshold", "f1", "precision", "recall"), order).alias("b")
    return sweep.groupBy(*groups).agg(picked).select(*groups, "b.*")


def precision_recall_curve(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct probability of a score table."""
    return scores.select(
        *groups,
        F.col("__p").alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
    )


def risk_coverage(
    df: DataFrame,
    target: str,
    decision: str,
    trust: str,
    groups: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Coverage and error rate when each distinct trust score is the threshold."""
    counts = df.groupBy(*groups, F.col(trust).alias("__t")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(target) != F.col(decision)).alias("errors"),
    )
    ranked = running_totals(
        counts, "__t", ["n", "errors"], groups, descending=True, rows_per_range=rows_per_range
    )
    return ranked.select(
        *groups,
        F.col("__t").alias("abstention_threshold"),
        F.col("tot_n").alias("observations"),
        F.col("cum_n").alias("accepted_predictions"),
        (F.col("tot_n") - F.col("cum_n")).alias("abstained_predictions"),
        (F.col("cum_n") / F.col("tot_n")).alias("coverage"),
        (F.col("cum_errors") / F.col("cum_n")).alias("selective_risk"),
    )


def select_abstention(table: DataFrame, minimum_coverage: float) -> DataFrame:
    """Least risk, then most coverage, then highest threshold, with enough coverage."""
    if not 0.90 <= minimum_coverage <= 1:
        raise ValueError("minimum_coverage must be between 0.90 and 1.0")
    return (
        table.where(F.col("coverage") >= F.lit(minimum_coverage))
        .orderBy(
            F.col("selective_risk").asc(), F.col("coverage").desc(),
            F.col("abstention_threshold").desc(),
        )
        .limit(1)
    )


def annotate_risk_coverage(table: DataFrame, selected: float) -> DataFrame:
    """Add the accuracy of accepted rows and mark the selected threshold."""
    return table.withColumns(
        {
            "selective_accuracy": 1.0 - F.col("selective_risk"),
            "selected": F.col("abstention_threshold") == F.lit(selected),
        }
    )


def trust_level_metrics(df: DataFrame, target: str, decision: str, probability: str) -> DataFrame:
    """Counts, coverage and means per trust level; order high, medium, low, other."""
    per_level = df.groupBy("trust_level").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg("trust_score").alias("mean_trust_score"),
        F.avg(probability).alias("mean_probability"),
        F.avg(F.col(target).cast("double")).alias("actual_poor_qoe_rate"),
        F.avg((F.col(decision) == F.col(target)).cast("double")).alias("accuracy"),
        F.avg(F.col("abstain").cast("double")).alias("abstention_rate"),
    )
    # One row per level.
    everything = F.sum("predictions").over(Window.partitionBy())
    rank = F.when(F.col("trust_level") == "high", 0).when(F.col("trust_level") == "medium", 1)
    rank = rank.when(F.col("trust_level") == "low", 2).otherwise(99)
    return per_level.withColumns(
        {"coverage": F.col("predictions") / everything, "level_order": rank}
    ).orderBy("level_order", "trust_level")


def trust_abstain_summary(df: DataFrame, target: str, decision: str, probability: str) -> DataFrame:
    """Size, means and accuracy per (trust level, abstain)."""
    return df.groupBy("trust_level", "abstain").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg("trust_score").alias("mean_trust_score"),
        F.avg(probability).alias("mean_probability"),
        F.avg((F.col(decision) == F.col(target)).cast("double")).alias("accuracy"),
    )


def selective_summary(df: DataFrame, target: str, decision: str) -> DataFrame:
    """Accepted and abstained rows, coverage, overall and accepted accuracy."""
    right = (F.col(target) == F.col(decision)).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(~F.col("abstain")).alias("accepted_predictions"),
        F.count_if(F.col("abstain")).alias("abstained_predictions"),
        F.avg(F.col("abstain").cast("double")).alias("abstention_rate"),
        F.avg(right).alias("overall_accuracy"),
        F.avg(F.when(~F.col("abstain"), right)).alias("accepted_accuracy"),
        F.avg((~F.col("abstain")).cast("double")).alias("coverage"),
    )


def unpivot_models(df: DataFrame, keep: Sequence[str], models: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per (row, model) with its probability and decision, from one scan."""
    variants = [
        F.struct(
            F.lit(name).alias("model"),
            F.col(column).cast("double").alias("probability"),
            (F.col(column) >= F.lit(threshold)).cast("int").alias("prediction"),
        )
        for name, (column, threshold) in models.items()
    ]
    return df.select(*keep, F.inline(F.array(*variants)))


def same_rows_violations(df: DataFrame, keys: Sequence[str], models: int, target: str) -> DataFrame:
    """Row keys not scored by every model, or with differing targets."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("model").alias("models"),
        F.min(target).alias("least"), F.max(target).alias("most"),
    )
    return per_key.where(
        (F.col("rows") != models) | (F.col("models") != models)
        | ~F.col("least").eqNullSafe(F.col("most"))
    ).drop("least", "most")


def assert_empty(violations: DataFrame, message: str) -> None:
    """Raise with one example when a table of violations has rows."""
    example = violations.head(1)
    if example:
        raise ValueError(f"{message}: {example[0].asDict()}")


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction of conditions."""
    return reduce(lambda a, b: a & b, conditions)
