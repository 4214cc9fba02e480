"""Registered queries: profiles, metrics, trust and selective prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadycast.functions.scalar import (
    component_trust,
    persistence_probability,
    probability_confidence,
)
from steadycast.operators import metrics, profiles, reshape, sessions
from steadycast.operators.ranks import approximate_quantiles
from steadycast.params import RESOLUTION_BY_BITRATE
from steadycast.plans import views
from steadycast.plans.oracle import mean6, over
from steadycast.plans.registry import query
from steadycast.plans.session_queries import KEY, r6, sql6

TARGET, DECISION, P = "actual_future_poor_qoe", "predicted_poor_qoe", "calibrated_probability"
RATES = [
    "positive_rate", "accuracy", "precision", "recall", "f1", "pr_auc", "brier_score",
    "expected_calibration_error", "false_alarm_rate", "miss_rate", "roc_auc",
]
EDGES = [i * 0.1 for i in range(1, 10)]


def dbl(x: float) -> str:
    """A double literal for SQL."""
    return f"CAST('{x!r}' AS DOUBLE)"


BIN = "(1 + " + " + ".join(f"(p > {dbl(e)})::INT" for e in EDGES) + ")"


def metrics_sql(source: str, groups: list[str]) -> dict[str, str]:
    """Views ending in ``m`` for a view with columns y, d, p and the groups."""
    g = "".join(f"{x}, " for x in groups)
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in groups) or "true"
    part = f"PARTITION BY {', '.join(groups)}" if groups else ""
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    return {
        "src": source,
        "base": f"""SELECT {g}count(*) AS n, sum(y) AS pos,
            count(*) FILTER (y = 0 AND d = 0) AS tn, count(*) FILTER (y = 0 AND d = 1) AS fp,
            count(*) FILTER (y = 1 AND d = 0) AS fn, count(*) FILTER (y = 1 AND d = 1) AS tp,
            avg((p - y) * (p - y)) AS brier FROM src {by}""",
        "ece0": f"SELECT {g}{BIN} AS b, abs(sum(y) - sum(p)) AS dev FROM src GROUP BY {g}b",
        "ece1": f"SELECT {g}sum(dev) AS dev FROM ece0 {by}",
        "score": f"SELECT {g}p, count(*) AS c, sum(y) AS cy FROM src GROUP BY {g}p",
        "cum": f"""SELECT *, sum(c) OVER w AS cn, sum(cy) OVER w AS cp FROM score
            WINDOW w AS ({part} ORDER BY p DESC)""",
        "rank0": f"""SELECT {g}sum(cy * (cp / cn)) AS ap, sum((c - cy) * (cp - cy + cy / 2)) AS pairs
            FROM cum {by}""",
        "j1": f"SELECT a.*, b.dev FROM base a JOIN ece1 b ON {on}",
        "j2": f"SELECT a.*, b.ap, b.pairs FROM j1 a JOIN rank0 b ON {on}",
        "m": f"""SELECT {g}n AS observations, round(pos / n, 6) AS positive_rate,
            round((tp + tn) / n, 6) AS accuracy,
            round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
            round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
            round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
            round(CASE WHEN pos > 0 THEN ap / pos ELSE 0 END, 6) AS pr_auc,
            round(brier, 6) AS brier_score, round(dev / n, 6) AS expected_calibration_error,
            tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
            round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS false_alarm_rate,
            round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS miss_rate,
            round(CASE WHEN pos > 0 AND pos < n THEN pairs / (pos * (n - pos)) END, 6) AS roc_auc
            FROM j2""",
    }


SRC = "actual_future_poor_qoe AS y, predicted_poor_qoe AS d, calibrated_probability AS p FROM scored"


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in RATES if c in df.columns})


def scored(spark, sf_dir):
    return views.scored(spark, sf_dir).frame


# ---- profiles -------------------------------------------------------------------------


@query(
    "table_profile",
    """SELECT event_type, CAST(grouping(event_type) AS INT) AS overall, count(*) AS rows,
         6 AS columns, count(DISTINCT user_id) AS users,
         CAST(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT
           + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) AS BIGINT) AS null_cells,
         count(*) - count(DISTINCT (event_id, ts, user_id, event_type, value, props)) AS duplicate_rows,
         epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, round(min(value), 6) AS minimum,
         round(max(value), 6) AS maximum, round(avg(value), 6) AS mean
       FROM events GROUP BY GROUPING SETS ((event_type), ())""",
)
def table_profile(spark, sf_dir):
    """Rows, users, nulls, duplicates, period and value range, per type and overall."""
    e = views.table(spark, sf_dir, "events")
    out = profiles.table_profile(e, "event_type", "user_id", "ts", "value")
    from steadycast.functions.scalar import epoch_micros

    return out.select(
        "event_type", F.col("overall").cast("int").alias("overall"), "rows", "columns", "users",
        "null_cells", "duplicate_rows", epoch_micros(F.col("first_time")).alias("first_us"),
        epoch_micros(F.col("last_time")).alias("last_us"), *r6("minimum", "maximum", "mean"),
    )


BITRATE_STATS = [
    "min_loss", "mean_loss", "max_loss", "zero_loss_share", "min_mos", "mean_mos", "max_mos",
    "corr_loss_mos", "corr_throughput_mos", "below_capacity_share", "mean_mos_sufficient",
    "mean_mos_insufficient", "median_loss", "median_mos",
]


@query(
    "bitrate_profile",
    over(
        f"SELECT bitrate_kbps, {sql6(*BITRATE_STATS)} FROM s",
        s="""SELECT bitrate_kbps, min(plr_percent) AS min_loss, """ + mean6("plr_percent") + """ AS mean_loss,
            max(plr_percent) AS max_loss, avg((plr_percent = 0)::INT) AS zero_loss_share,
            min(current_mos) AS min_mos, """ + mean6("current_mos") + """ AS mean_mos, max(current_mos) AS max_mos,
            corr(plr_percent, current_mos) AS corr_loss_mos,
            corr(throughput_mbps, current_mos) AS corr_throughput_mos,
            avg((throughput_mbps < bitrate_kbps / 1000)::INT) AS below_capacity_share,
            """ + mean6("current_mos", where="throughput_mbps >= bitrate_kbps / 1000") + """ AS mean_mos_sufficient,
            """ + mean6("current_mos", where="throughput_mbps < bitrate_kbps / 1000") + """ AS mean_mos_insufficient,
            median(plr_percent) AS median_loss, median(current_mos) AS median_mos
            FROM obs GROUP BY bitrate_kbps""",
    ),
)
def bitrate_profile(spark, sf_dir):
    """Loss, score and capacity per bitrate."""
    out = profiles.bitrate_profile(views.observations(spark, sf_dir))
    return out.select("bitrate_kbps", *r6(*BITRATE_STATS))


MOS_COLUMNS = [reshape.mos_column(b) for b in RESOLUTION_BY_BITRATE]
SUMMARY = ["minimum", "mean", "median", "maximum", "standard_deviation"]


@query(
    "mos_column_summary",
    over(
        f"""SELECT 'MOS_' || bitrate_kbps || 'kbps' AS "column", round(min(current_mos), 6) AS minimum,
           {mean6("current_mos")} AS mean, round(median(current_mos), 6) AS median,
           round(max(current_mos), 6) AS maximum, round(stddev_samp(current_mos), 6) AS standard_deviation
           FROM obs GROUP BY bitrate_kbps"""
    ),
)
def mos_column_summary(spark, sf_dir):
    """Summary of each score column of the wide form."""
    out = profiles.column_summary(views.wide(spark, sf_dir), MOS_COLUMNS)
    return out.select("column", *r6(*SUMMARY))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "measure_column_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c}), 6) AS minimum, round({mean6(c)}, 4) AS mean,
        round(median({c}), 6) AS median, round(max({c}), 6) AS maximum,
        round(stddev_samp({c}), 4) AS standard_deviation FROM lineitem"""
        for c in MEASURES
    ),
)
def measure_column_summary(spark, sf_dir):
    """Summary of the measures of a large table, from one unpivot."""
    li = views.table(spark, sf_dir, "lineitem").select(*MEASURES)
    out = profiles.column_summary(li, MEASURES)
    return out.select(
        "column", *r6("minimum", "median", "maximum"),
        *[F.round(c, 4).alias(c) for c in ("mean", "standard_deviation")],
    )


def _event_gaps(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(
        "event_type", "user_id", F.col("ts").alias("timestamp")
    )
    keys = ["event_type", "user_id"]
    return e, sessions.add_gap(e, keys, sessions.find_hot_keys(e, keys))


_GAPS = """WITH g AS (SELECT event_type, user_id, ts, date_diff('microsecond', lag(ts) OVER
    (PARTITION BY event_type, user_id ORDER BY ts), ts) / 1e6 AS gap FROM events)"""


@query(
    "inter_arrival_statistics",
    f"""{_GAPS} SELECT event_type, round(min(gap), 6) AS minimum_gap_seconds,
        {mean6("gap", 6)} AS mean_gap_seconds, round(max(gap), 6) AS maximum_gap_seconds,
        round(median(gap), 6) AS median_gap_seconds, round(quantile_cont(gap, 0.9), 6) AS p90_gap_seconds,
        round(quantile_cont(gap, 0.95), 6) AS p95_gap_seconds, count(*) AS rows,
        count(DISTINCT user_id) AS users, count(DISTINCT ts) AS timestamps
        FROM g GROUP BY event_type""",
)
def inter_arrival_statistics(spark, sf_dir):
    """Gap statistics, users and distinct timestamps per event type."""
    e, gaps = _event_gaps(spark, sf_dir)
    probs = {"median_gap_seconds": 0.5, "p90_gap_seconds": 0.9, "p95_gap_seconds": 0.95}
    stats = profiles.gap_statistics(gaps, ["event_type"], probs)
    sizes = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("timestamp").alias("timestamps"),
    )
    gap_columns = [c for c in stats.columns if c != "event_type"]
    return sizes.join(stats, "event_type", "left").select(
        "event_type", "rows", "users", "timestamps", *r6(*gap_columns)
    )


GAP_QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(
    "global_gap_distribution",
    f"""{_GAPS} SELECT round(min(gap), 6) AS minimum_gap_seconds, {mean6("gap", 6)} AS mean_gap_seconds,
        round(max(gap), 6) AS maximum_gap_seconds, """
    + ", ".join(f"round(quantile_cont(gap, {q}), 6) AS {n}" for n, q in GAP_QUANTILES.items())
    + " FROM g",
)
def global_gap_distribution(spark, sf_dir):
    """Gap distribution over all rows."""
    _, gaps = _event_gaps(spark, sf_dir)
    out = profiles.gap_statistics(gaps, [], GAP_QUANTILES)
    return out.select(*r6(*out.columns))


@query(
    "approximate_gap_distribution",
    f"""{_GAPS} SELECT count(gap) AS count, true AS ordered FROM g""",
)
def approximate_gap_distribution(spark, sf_dir):
    """One-pass variant with a bounded summary; checked for its count and its order."""
    _, gaps = _event_gaps(spark, sf_dir)
    out = approximate_quantiles(gaps, "gap_seconds", GAP_QUANTILES)
    names = list(GAP_QUANTILES)
    rising = metrics.all_of([F.col(a) <= F.col(b) for a, b in zip(names, names[1:])])
    return out.select("count", rising.alias("ordered"))


@query(
    "label_overview",
    over(
        """SELECT count(*) AS rows, count(future_poor_qoe) AS labelled_rows,
             count(*) FILTER (future_poor_qoe = 1) AS poor_rows,
             count(*) FILTER (future_poor_qoe = 0) AS acceptable_rows,
             round(avg(future_poor_qoe), 6) AS poor_rate, count(DISTINCT session_id) AS sessions,
             count(DISTINCT user_id) AS users, round(median(prediction_lead_seconds), 6) AS median_lead
           FROM lab"""
    ),
)
def label_overview(spark, sf_dir):
    """Label distribution, poor rate, sessions, users and median lead."""
    out = profiles.label_overview(views.labelled(spark, sf_dir).frame)
    return out.withColumns({c: F.round(c, 6) for c in ("poor_rate", "median_lead")})


@query(
    "dimension_values",
    over(
        " UNION ALL ".join(
            f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM obs GROUP BY {c}"
            for c in ("base_station", "prb", "bitrate_kbps", "mobility", "resolution")
        )
    ),
)
def dimension_values(spark, sf_dir):
    """Values of each scenario dimension."""
    columns = ["base_station", "prb", "bitrate_kbps", "mobility", "resolution"]
    return profiles.dimension_values(views.observations(spark, sf_dir), columns)


_LEAD = profiles.LEAD_QUANTILES


@query(
    "lead_time_statistics",
    over(
        "SELECT count(x) AS count, round(min(x), 6) AS minimum_seconds, " + mean6("x", 6) + " AS mean_seconds, "
        "round(max(x), 6) AS maximum_seconds, "
        + ", ".join(f"round(quantile_cont(x, {q}), 6) AS {n}" for n, q in _LEAD.items())
        + " FROM (SELECT prediction_lead_seconds AS x FROM kept WHERE split = 'test')"
    ),
)
def lead_time_statistics(spark, sf_dir):
    """Warning lead time of the test rows."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    out = profiles.lead_time_statistics(t.frame.where(F.col("split") == "test"), "prediction_lead_seconds")
    return out.select("count", *r6(*[c for c in out.columns if c != "count"]))


@query(
    "lead_time_histogram",
    over(
        """SELECT CAST(CASE WHEN x = hi THEN 40 ELSE floor((x - lo) / (hi - lo) * 40) + 1 END AS INT) AS bin,
           count(*) AS count FROM v CROSS JOIN lim GROUP BY 1""",
        x="SELECT prediction_lead_seconds AS x FROM kept WHERE split = 'test'",
        cut="SELECT quantile_cont(x, 0.99) AS c FROM x",
        v="SELECT x FROM x CROSS JOIN cut WHERE x <= c",
        lim="SELECT min(x) AS lo, max(x) AS hi FROM v",
    ),
)
def lead_time_histogram(spark, sf_dir):
    """40 equal bins of the lead time up to its 99th percentile."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    return profiles.histogram(t.frame.where(F.col("split") == "test"), "prediction_lead_seconds")


# ---- metrics --------------------------------------------------------------------------


@query(
    "confusion_counts",
    over(
        """SELECT count(*) FILTER (y = 0 AND d = 0) AS true_negatives,
           count(*) FILTER (y = 0 AND d = 1) AS false_positives,
           count(*) FILTER (y = 1 AND d = 0) AS false_negatives,
           count(*) FILTER (y = 1 AND d = 1) AS true_positives FROM src""",
        src="SELECT " + SRC,
    ),
)
def confusion_counts(spark, sf_dir):
    """tn, fp, fn, tp at the stored decision."""
    return metrics.confusion_counts(scored(spark, sf_dir), TARGET, DECISION)


@query(
    "confusion_matrix",
    over(
        """SELECT y AS actual, count(*) FILTER (d = 0) AS predicted_0,
           count(*) FILTER (d = 1) AS predicted_1 FROM src GROUP BY y""",
        src="SELECT " + SRC,
    ),
)
def confusion_matrix(spark, sf_dir):
    """2 x 2 confusion matrix."""
    return metrics.confusion_matrix(scored(spark, sf_dir), TARGET, DECISION)


@query("binary_metrics", over("SELECT * FROM m", **metrics_sql("SELECT " + SRC, [])))
def binary_metrics(spark, sf_dir):
    """All metrics over all rows."""
    return rounded(metrics.binary_metrics(scored(spark, sf_dir), TARGET, DECISION, P))


@query(
    "metrics_at_threshold",
    over(
        "SELECT *, CAST(0.35 AS DOUBLE) AS threshold FROM m",
        **metrics_sql(
            "SELECT split, actual_future_poor_qoe AS y, (calibrated_probability >= 0.35)::INT AS d, "
            "calibrated_probability AS p FROM scored",
            ["split"],
        ),
    ),
)
def metrics_at_threshold(spark, sf_dir):
    """All metrics per split with the decision taken at 0.35."""
    return rounded(metrics.metrics_at_threshold(scored(spark, sf_dir), TARGET, P, 0.35, ["split"]))


@query(
    "brier_score",
    over("SELECT split, round(avg((p - y) * (p - y)), 6) AS brier_score FROM src GROUP BY split",
         src="SELECT split, " + SRC),
)
def brier_score(spark, sf_dir):
    """Mean squared difference of probability and outcome per split."""
    off = F.col(P) - F.col(TARGET)
    return scored(spark, sf_dir).groupBy("split").agg(F.round(F.avg(off * off), 6).alias("brier_score"))


@query(
    "calibration_error",
    over("SELECT split, expected_calibration_error FROM m", **metrics_sql("SELECT split, " + SRC, ["split"])),
)
def calibration_error(spark, sf_dir):
    """Expected calibration error per split."""
    out = metrics.binary_metrics(scored(spark, sf_dir), TARGET, DECISION, P, ["split"])
    return rounded(out).select("split", "expected_calibration_error")


@query(
    "ranking_metrics",
    over("SELECT split, pr_auc, roc_auc FROM m", **metrics_sql("SELECT split, " + SRC, ["split"])),
)
def ranking_metrics(spark, sf_dir):
    """Average precision and ROC-AUC per split."""
    out = metrics.binary_metrics(scored(spark, sf_dir), TARGET, DECISION, P, ["split"])
    return rounded(out).select("split", "pr_auc", "roc_auc")


def _reliability_sql(groups: str) -> str:
    lower = "[" + ", ".join(dbl(e) for e in [0.0, *EDGES]) + "]"
    upper = "[" + ", ".join(dbl(e) for e in [*EDGES, 1.0]) + "]"
    return f"""SELECT {groups} {BIN} AS bin, count(*) AS count, round(avg(p), 6) AS mean_probability,
        round(avg(y), 6) AS observed_frequency, {lower}[{BIN}] AS lower_bound,
        {upper}[{BIN}] AS upper_bound FROM src GROUP BY ALL"""


@query("reliability_table", over(_reliability_sql("split,"), src="SELECT split, " + SRC))
def reliability_table(spark, sf_dir):
    """Reliability bins per split."""
    out = metrics.reliability_table(scored(spark, sf_dir), TARGET, P, ["split"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_probability", "observed_frequency")})


_GRID = "(VALUES " + ", ".join(f"({dbl(t)})" for t in metrics.THRESHOLDS) + ") g(threshold)"
_SWEEP = {
    "src": "SELECT split, " + SRC,
    "s0": f"""SELECT split, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp,
        count(*) FILTER (p >= threshold) AS reached, count(*) FILTER (y = 1) AS pos
        FROM src CROSS JOIN {_GRID} GROUP BY split, threshold""",
    "sweep": """SELECT split, threshold, CASE WHEN reached + pos > 0 THEN 2 * tp / (reached + pos) ELSE 0 END AS f1,
        CASE WHEN reached > 0 THEN tp / reached ELSE 0 END AS precision,
        CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall FROM s0""",
}


@query("threshold_sweep", over(f"SELECT split, threshold, {sql6('f1', 'precision', 'recall')} FROM sweep", **_SWEEP))
def threshold_sweep(spark, sf_dir):
    """F1, precision and recall at 91 thresholds per split."""
    out = metrics.threshold_sweep(scored(spark, sf_dir), TARGET, P, ["split"])
    return out.select("split", "threshold", *r6("f1", "precision", "recall"))


@query(
    "best_threshold",
    over(
        f"""SELECT split, threshold, {sql6('f1', 'precision', 'recall')} FROM sweep
        QUALIFY row_number() OVER (PARTITION BY split ORDER BY f1 DESC, precision DESC, threshold) = 1""",
        **_SWEEP,
    ),
)
def best_threshold(spark, sf_dir):
    """Best threshold per split."""
    sweep = metrics.threshold_sweep(scored(spark, sf_dir), TARGET, P, ["split"])
    out = metrics.best_threshold(sweep, ["split"])
    return out.select("split", "threshold", *r6("f1", "precision", "recall"))


DIMENSIONS = ["base_station", "prb", "bitrate_kbps"]


@query(
    "metrics_by_dimension",
    over(
        "SELECT * FROM m",
        **metrics_sql(
            " UNION ALL ".join(
                f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, {SRC} WHERE split = 'test'"
                for d in DIMENSIONS
            ),
            ["dimension", "value"],
        ),
    ),
)
def metrics_by_dimension(spark, sf_dir):
    """All metrics per station, resource setting and bitrate of the test rows, in one pass."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return rounded(metrics.metrics_by_dimension(test, DIMENSIONS, TARGET, DECISION, P))


@query(
    "metrics_by_nullable_group",
    over(
        "SELECT * FROM m",
        **metrics_sql(
            f"SELECT CASE WHEN prb <> 5 THEN prb::DOUBLE END AS prb_group, {SRC}", ["prb_group"]
        ),
    ),
)
def metrics_by_nullable_group(spark, sf_dir):
    """A null group keeps its own metrics row."""
    df = scored(spark, sf_dir).withColumn("prb_group", F.when(F.col("prb") != 5, F.col("prb").cast("double")))
    return rounded(metrics.binary_metrics(df, TARGET, DECISION, P, ["prb_group"]))


@query(
    "scope_metrics",
    over(
        "SELECT * FROM m",
        **metrics_sql(
            f"SELECT 'all' AS scope, {SRC} WHERE split = 'test' UNION ALL "
            f"SELECT 'accepted' AS scope, {SRC} WHERE split = 'test' AND NOT abstain",
            ["scope"],
        ),
    ),
)
def scope_metrics(spark, sf_dir):
    """All and accepted test rows."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return rounded(metrics.scope_metrics(test, TARGET, DECISION, P))


@query(
    "precision_recall_curve",
    over(
        """SELECT p AS threshold, round(sum(cy) OVER w / sum(c) OVER w, 6) AS precision,
           round(sum(cy) OVER w / sum(cy) OVER (), 6) AS recall
           FROM (SELECT p, count(*) AS c, sum(y) AS cy FROM src GROUP BY p) WINDOW w AS (ORDER BY p DESC)""",
        src="SELECT " + SRC + " WHERE split = 'test'",
    ),
)
def precision_recall_curve(spark, sf_dir):
    """Curve points at every distinct probability of the test rows."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    points = metrics.score_table(test, TARGET, DECISION, P)
    return metrics.precision_recall_curve(points).select("threshold", *r6("precision", "recall"))


MODELS = {"persistence": ("persistence_p", 0.5), "closed_form": (P, 0.35), "hedged": ("hedged_p", 0.5)}
_MODELS = " UNION ALL ".join(
    f"""SELECT '{n}' AS model, session_id, user_id, timestamp, actual_future_poor_qoe AS y,
    ({e} >= {t})::INT AS d, {e} AS p FROM scored WHERE split = 'test'"""
    for n, e, t in (
        ("persistence", "(CASE WHEN current_mos < 3 THEN 1.0 ELSE 0.0 END)::DOUBLE", 0.5),
        ("closed_form", "calibrated_probability", 0.35),
        ("hedged", "0.4 * calibrated_probability + 0.2", 0.5),
    )
)


def _models(spark, sf_dir):
    test = scored(spark, sf_dir).where(F.col("split") == "test").withColumns(
        {
            "persistence_p": persistence_probability(F.col("current_mos")),
            "hedged_p": 0.4 * F.col(P) + 0.2,
        }
    )
    keep = ["session_id", "user_id", "timestamp", TARGET]
    return metrics.unpivot_models(test, keep, MODELS)


@query("model_comparison", over("SELECT * FROM m", **metrics_sql(_MODELS, ["model"])))
def model_comparison(spark, sf_dir):
    """Three probability rules on the same test rows."""
    return rounded(
        metrics.binary_metrics(_models(spark, sf_dir), TARGET, "prediction", "probability", ["model"])
    )


@query(
    "model_row_consistency",
    over(
        "SELECT count(*) AS violations FROM (SELECT session_id, timestamp FROM src "
        "GROUP BY ALL HAVING count(*) <> 3)",
        src=_MODELS,
    ),
)
def model_row_consistency(spark, sf_dir):
    """Row keys not scored by all models, or with different targets."""
    keys = ["session_id", "user_id", "timestamp"]
    bad = metrics.same_rows_violations(_models(spark, sf_dir), keys, len(MODELS), TARGET)
    return bad.agg(F.count(F.lit(1)).alias("violations"))


@query(
    "model_variants_union",
    over(
        """SELECT session_id, epoch_us(timestamp) AS ts_us, model, round(p, 6) AS probability,
           d AS prediction FROM src""",
        src=_MODELS,
    ),
)
def model_variants_union(spark, sf_dir):
    """One row per model on one row set, from one scan."""
    from steadycast.plans.session_queries import ts_us

    return _models(spark, sf_dir).select("session_id", ts_us(), "model", *r6("probability"), "prediction")


# ---- trust ----------------------------------------------------------------------------


@query(
    "probability_confidence",
    over(
        """SELECT event_id, bitrate_kbps, round(CASE WHEN p < 0.37 THEN (0.37 - p) / 0.37
           ELSE (p - 0.37) / (1 - 0.37) END, 6) AS confidence
           FROM (SELECT *, calibrated_probability AS p FROM scored)"""
    ),
)
def probability_confidence_query(spark, sf_dir):
    """Distance from a threshold of 0.37."""
    confidence = F.round(probability_confidence(F.col(P), 0.37), 6)
    return scored(spark, sf_dir).select(*KEY, confidence.alias("confidence"))


@query(
    "data_quality",
    over("SELECT event_id, bitrate_kbps, round(data_quality, 6) AS data_quality FROM scored"),
)
def data_quality(spark, sf_dir):
    """Share of network features that hold a value."""
    return scored(spark, sf_dir).select(*KEY, *r6("data_quality"))


@query(
    "trust_scores",
    over(
        """SELECT event_id, bitrate_kbps, round(trust_score, 6) AS trust_score, trust_level, abstain
           FROM scored"""
    ),
)
def trust_scores(spark, sf_dir):
    """Configured trust score, level and abstention."""
    return scored(spark, sf_dir).select(*KEY, *r6("trust_score"), "trust_level", "abstain")


@query(
    "component_trust",
    over(
        """SELECT event_id, bitrate_kbps, t AS component_trust,
             CASE WHEN t >= 0.8 THEN 'high' WHEN t >= 0.55 THEN 'medium' ELSE 'low' END AS component_level,
             t < 0.55 AS component_abstain
           FROM (SELECT *, round(0.55 * model_confidence + 0.25 * (0.7 * 0.8 + 0.3 * 0.9)
             + 0.1 * data_quality + 0.1 * prediction_stability, 9) AS t FROM scored)"""
    ),
)
def component_trust_query(spark, sf_dir):
    """Component variant of the trust score."""
    parts = component_trust(
        F.col(P), views.F1, views.ECE, F.col("data_quality"), F.col("prediction_stability")
    )
    df = scored(spark, sf_dir).withColumns(parts)
    t = F.round("component_trust", 9)
    level = F.when(t >= 0.8, "high").when(t >= 0.55, "medium").otherwise("low")
    return df.select(
        *KEY, t.alias("component_trust"),
        level.alias("component_level"), (t < 0.55).alias("component_abstain"),
    )


@query(
    "validation_trust_scores",
    over(
        """SELECT session_id, epoch_us(timestamp) AS ts_us, predicted_poor_qoe,
           round(trust_score, 6) AS trust_score FROM scored WHERE split = 'validation'"""
    ),
)
def validation_trust_scores(spark, sf_dir):
    """Trust of validation rows, before an abstention threshold exists."""
    from steadycast.plans.session_queries import ts_us

    df = scored(spark, sf_dir).where(F.col("split") == "validation")
    return df.select("session_id", ts_us(), "predicted_poor_qoe", *r6("trust_score"))


@query(
    "applied_trust",
    over(
        """SELECT session_id, epoch_us(timestamp) AS ts_us, round(calibrated_probability, 6) AS
           calibrated_probability, predicted_poor_qoe, round(data_quality, 6) AS data_quality,
           round(prediction_stability, 6) AS prediction_stability, round(trust_score, 6) AS trust_score,
           trust_level, abstain FROM scored WHERE split = 'test'"""
    ),
)
def applied_trust(spark, sf_dir):
    """Trusted prediction rows of the test period, in one pass."""
    from steadycast.plans.session_queries import ts_us

    df = scored(spark, sf_dir).where(F.col("split") == "test")
    return df.select(
        "session_id", ts_us(), *r6(P), "predicted_poor_qoe",
        *r6("data_quality", "prediction_stability", "trust_score"), "trust_level", "abstain",
    )


@query(
    "accepted_rows",
    over("SELECT event_id, bitrate_kbps FROM scored WHERE NOT abstain"),
)
def accepted_rows(spark, sf_dir):
    """Rows the system does not abstain on."""
    return reshape.accepted(scored(spark, sf_dir)).select(*KEY)


@query(
    "trust_level_metrics",
    over(
        """SELECT trust_level, count(*) AS predictions, round(count(*) / sum(count(*)) OVER (), 6) AS coverage,
             round(avg(trust_score), 6) AS mean_trust_score,
             round(avg(calibrated_probability), 6) AS mean_probability,
             round(avg(actual_future_poor_qoe), 6) AS actual_poor_qoe_rate,
             round(avg((actual_future_poor_qoe = predicted_poor_qoe)::INT), 6) AS accuracy,
             round(avg(abstain::INT), 6) AS abstention_rate,
             CASE trust_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS level_order
           FROM scored GROUP BY trust_level"""
    ),
)
def trust_level_metrics(spark, sf_dir):
    """Metrics per trust level."""
    out = metrics.trust_level_metrics(scored(spark, sf_dir), TARGET, DECISION, P)
    return out.select(
        "trust_level", "predictions", "level_order",
        *r6("coverage", "mean_trust_score", "mean_probability", "actual_poor_qoe_rate", "accuracy",
            "abstention_rate"),
    )


@query(
    "trust_abstain_summary",
    over(
        """SELECT trust_level, abstain, count(*) AS predictions, round(avg(trust_score), 6) AS mean_trust_score,
             round(avg(calibrated_probability), 6) AS mean_probability,
             round(avg((actual_future_poor_qoe = predicted_poor_qoe)::INT), 6) AS accuracy
           FROM scored GROUP BY ALL"""
    ),
)
def trust_abstain_summary(spark, sf_dir):
    """Summary per trust level and abstention."""
    out = metrics.trust_abstain_summary(scored(spark, sf_dir), TARGET, DECISION, P)
    return out.select(
        "trust_level", "abstain", "predictions", *r6("mean_trust_score", "mean_probability", "accuracy")
    )


@query(
    "selective_summary",
    over(
        """SELECT count(*) AS total_predictions, count(*) FILTER (NOT abstain) AS accepted_predictions,
             count(*) FILTER (abstain) AS abstained_predictions,
             round(avg(abstain::INT), 6) AS abstention_rate, round(avg(ok), 6) AS overall_accuracy,
             round(avg(ok) FILTER (NOT abstain), 6) AS accepted_accuracy,
             round(avg((NOT abstain)::INT), 6) AS coverage
           FROM (SELECT *, (actual_future_poor_qoe = predicted_poor_qoe)::INT AS ok FROM scored
             WHERE split = 'test')"""
    ),
)
def selective_summary(spark, sf_dir):
    """Selective prediction summary of the test rows."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    out = metrics.selective_summary(test, TARGET, DECISION)
    rates = ["abstention_rate", "overall_accuracy", "accepted_accuracy", "coverage"]
    return out.withColumns({c: F.round(c, 6) for c in rates})


_RISK = {
    "rc0": """SELECT trust_score AS abstention_threshold, count(*) AS c,
        count(*) FILTER (actual_future_poor_qoe <> predicted_poor_qoe) AS e
        FROM scored WHERE split = 'validation' GROUP BY trust_score""",
    "rc": """SELECT abstention_threshold, CAST(sum(c) OVER () AS BIGINT) AS observations,
        CAST(sum(c) OVER w AS BIGINT) AS accepted_predictions,
        CAST(sum(c) OVER () - sum(c) OVER w AS BIGINT) AS abstained_predictions,
        sum(c) OVER w / sum(c) OVER () AS coverage, sum(e) OVER w / sum(c) OVER w AS selective_risk
        FROM rc0 WINDOW w AS (ORDER BY abstention_threshold DESC)""",
    "best": """SELECT * FROM rc WHERE coverage >= 0.9
        ORDER BY selective_risk, coverage DESC, abstention_threshold DESC LIMIT 1""",
}


def _risk(spark, sf_dir):
    validation = scored(spark, sf_dir).where(F.col("split") == "validation")
    return metrics.risk_coverage(validation, TARGET, DECISION, "trust_score")


_RC = "observations, accepted_predictions, abstained_predictions"


@query(
    "risk_coverage",
    over(f"SELECT abstention_threshold, {_RC}, {sql6('coverage', 'selective_risk')} FROM rc", **_RISK),
)
def risk_coverage(spark, sf_dir):
    """Risk and coverage at every distinct trust score of the validation rows."""
    out = _risk(spark, sf_dir)
    return out.select("abstention_threshold", *_RC.split(", "), *r6("coverage", "selective_risk"))


@query(
    "abstention_threshold",
    over(f"SELECT abstention_threshold, {_RC}, {sql6('coverage', 'selective_risk')} FROM best", **_RISK),
)
def abstention_threshold(spark, sf_dir):
    """Selected abstention threshold."""
    out = metrics.select_abstention(_risk(spark, sf_dir), views.POLICY.minimum_coverage)
    return out.select("abstention_threshold", *_RC.split(", "), *r6("coverage", "selective_risk"))


@query(
    "annotated_risk_coverage",
    over(
        """SELECT abstention_threshold, round(coverage, 6) AS coverage,
           round(1 - selective_risk, 6) AS selective_accuracy,
           abstention_threshold = (SELECT abstention_threshold FROM best) AS selected FROM rc""",
        **_RISK,
    ),
)
def annotated_risk_coverage(spark, sf_dir):
    """Risk-coverage rows with selective accuracy and the selected row marked."""
    table = _risk(spark, sf_dir)
    best = metrics.select_abstention(table, views.POLICY.minimum_coverage).first()
    if best is None:
        raise ValueError("no abstention threshold reaches the minimum coverage")
    out = metrics.annotate_risk_coverage(table, best["abstention_threshold"])
    return out.select("abstention_threshold", *r6("coverage", "selective_accuracy"), "selected")
