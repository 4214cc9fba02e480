"""Registered queries: joins, contracts, reconciliation, lineage and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.functions.scalar import epoch_micros
from steadycast.operators import digests, lineage, metrics, quality, reconcile, reshape, sampling, sessions, splits
from steadycast.operators.sortedness import sortedness
from steadycast.params import (
    PHYSICAL_KEY,
    RESOLUTION_BY_BITRATE,
    ROW_IDENTITY,
    ROW_KEY,
    SplitParams,
)
from steadycast.plans import views
from steadycast.plans.metric_queries import DECISION, P, TARGET, _models, _MODELS, metrics_sql, rounded, scored, SRC
from steadycast.plans.oracle import over
from steadycast.plans.registry import query
from steadycast.plans.session_queries import KEY, r6, sql6, ts_us
from steadycast.session import run_dir

# ---- joins ----------------------------------------------------------------------------


@query(
    "predictions_with_features",
    over(
        """SELECT session_id, user_id, epoch_us(timestamp) AS ts_us, round(calibrated_probability, 6)
           AS calibrated_probability, round(throughput_mbps, 6) AS throughput_mbps, session_step
           FROM scored"""
    ),
)
def predictions_with_features(spark, sf_dir):
    """Predictions joined one to one with feature rows."""
    df = scored(spark, sf_dir)
    predictions = df.select(*ROW_KEY, P)
    features = df.select(*ROW_KEY, "throughput_mbps", "session_step")
    out = reconcile.join_one_to_one(predictions, features, ROW_KEY)
    return out.select("session_id", "user_id", ts_us(), *r6(P, "throughput_mbps"), "session_step")


@query(
    "key_set_differences",
    over(
        """SELECT event_id, bitrate_kbps, CAST(l AS BIGINT) AS left_rows, CAST(r AS BIGINT) AS right_rows
           FROM (SELECT event_id, bitrate_kbps, 1 AS l, (future_poor_qoe IS NOT NULL)::INT AS r FROM lab)
           WHERE r <> 1"""
    ),
)
def key_set_differences(spark, sf_dir):
    """Observations and labelled rows: keys not on both sides exactly once."""
    t = views.labelled(spark, sf_dir)
    labelled = t.frame.where(F.col("future_poor_qoe").isNotNull())
    return reconcile.key_differences(views.observations(spark, sf_dir), labelled, KEY)


@query(
    "rows_not_selected",
    over(
        """SELECT event_id, bitrate_kbps FROM scored WHERE trust_level <> 'high'"""
    ),
)
def rows_not_selected(spark, sf_dir):
    """Rows left after a selection by key."""
    df = scored(spark, sf_dir)
    chosen = df.where(F.col("trust_level") == "high")
    return reconcile.not_selected(df, chosen, KEY).select(*KEY)


@query(
    "source_reconciliation",
    over(
        """SELECT count(*) AS rows, count(*) FILTER (event_id % 11 = 0) AS missing,
             count(*) FILTER (event_id % 7 = 0 AND event_id % 11 <> 0) AS ambiguous,
             count(*) FILTER (event_id % 5 = 0 AND event_id % 11 <> 0) AS throughput_mbps_mismatches,
             CAST(0 AS BIGINT) AS latitude_mismatches, CAST(0 AS BIGINT) AS longitude_mismatches,
             CAST(0 AS BIGINT) AS plr_percent_mismatches, CAST(0 AS BIGINT) AS current_mos_mismatches
           FROM obs"""
    ),
)
def source_reconciliation(spark, sf_dir):
    """Long rows against a damaged wide source: missing, ambiguous and changed cells."""
    rows = views.observations(spark, sf_dir)
    damaged = views.wide(spark, sf_dir).where(F.col("event_id") % 11 != 0)
    damaged = damaged.withColumn(
        "throughput_mbps",
        F.when(F.col("event_id") % 5 == 0, F.col("throughput_mbps") + 1).otherwise(F.col("throughput_mbps")),
    )
    copies = F.when(F.col("event_id") % 7 == 0, 2).otherwise(1)
    damaged = damaged.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")
    source = reshape.wide_to_long(damaged, list(RESOLUTION_BY_BITRATE))
    keys = ["base_station", "prb", "user_id", "timestamp", "bitrate_kbps"]
    values = ["throughput_mbps", "latitude", "longitude", "plr_percent", "current_mos"]
    return reconcile.source_reconciliation(rows, source, keys, values)


@query(
    "scenario_comparison",
    over(
        """SELECT base_station, CAST(5 AS INT) AS lowest, CAST(40 AS INT) AS highest,
             count(*) = count(*) FILTER (event_id % 97 <> 0) AS same_number_of_rows,
             count(*) FILTER (event_id % 97 = 0) = 0 AS same_keys, true AS same_values,
             round(count(*) FILTER (event_id % 97 <> 0 AND (event_id % 3 = 0 OR throughput_mbps = 0))
               / count(*) FILTER (event_id % 97 <> 0), 6) AS throughput_equal_fraction,
             round((4 * count(*) FILTER (event_id % 97 <> 0) - count(*) FILTER (event_id % 97 <> 0 AND event_id % 5 = 0))
               / (4 * count(*) FILTER (event_id % 97 <> 0)), 6) AS mos_equal_fraction
           FROM phys GROUP BY base_station"""
    ),
)
def scenario_comparison(spark, sf_dir):
    """Lowest against highest resource setting of each station."""
    settings = F.explode(
        F.when(F.col("event_id") % 97 == 0, F.array(F.lit(5))).otherwise(F.array(F.lit(5), F.lit(40)))
    )
    df = views.physical(spark, sf_dir)
    scores = [f"mos_{b}" for b in RESOLUTION_BY_BITRATE]
    df = df.withColumns(
        {f"mos_{b}": 1 + 4 * F.least(F.lit(1.0), F.col("throughput_mbps") / (b / 1000)) for b in RESOLUTION_BY_BITRATE}
    )
    df = df.withColumn("prb", settings)
    higher = (F.col("prb") == 40) & (F.col("event_id") % 5 == 0)
    df = df.withColumn(scores[-1], F.when(higher, F.col(scores[-1]) + 0.5).otherwise(F.col(scores[-1])))
    changed = (F.col("prb") == 40) & (F.col("event_id") % 3 != 0)
    df = df.withColumn(
        "throughput_mbps",
        F.when(changed, F.col("throughput_mbps") * 1.1).otherwise(F.col("throughput_mbps")),
    )
    out = reconcile.scenario_comparison(
        df, "base_station", "prb", ["user_id", "timestamp"], ["latitude", "longitude"],
        {"throughput": ["throughput_mbps"], "mos": scores},
    )
    shares = ("throughput_equal_fraction", "mos_equal_fraction")
    return out.withColumns({c: F.round(c, 6) for c in shares})


@query(
    "stored_versus_recomputed",
    over(
        """SELECT count(*) FILTER (event_id % 17 <> 0 AND event_id % 19 <> 0) AS rows,
             count(*) FILTER (event_id % 19 = 0 AND event_id % 17 <> 0) AS stored_only,
             count(*) FILTER (event_id % 17 = 0 AND event_id % 19 <> 0) AS rebuilt_only,
             CAST(0 AS BIGINT) AS repeated,
             CAST(0 AS BIGINT) AS session_id_mismatches, CAST(0 AS BIGINT) AS session_number_mismatches,
             CAST(0 AS BIGINT) AS gap_seconds_mismatches, CAST(0 AS BIGINT) AS is_session_start_mismatches,
             CAST(0 AS BIGINT) AS future_mos_mismatches, CAST(0 AS BIGINT) AS future_timestamp_mismatches,
             CAST(0 AS BIGINT) AS prediction_lead_seconds_mismatches,
             count(*) FILTER (event_id % 13 = 0 AND future_poor_qoe IS NOT NULL
               AND event_id % 17 <> 0 AND event_id % 19 <> 0) AS future_poor_qoe_mismatches
           FROM lab"""
    ),
)
def stored_versus_recomputed(spark, sf_dir):
    """Stored labels, some altered and some missing, against labels rebuilt from the observations."""
    t = views.labelled(spark, sf_dir)
    flipped = (1 - F.col("future_poor_qoe")).cast("byte")
    stored = t.frame.withColumn(
        "future_poor_qoe", F.when(F.col("event_id") % 13 == 0, flipped).otherwise(F.col("future_poor_qoe"))
    )
    rebuilt = sessions.label(stored, views.SESSIONS, t.hot)
    columns = [
        "session_id", "session_number", "gap_seconds", "is_session_start",
        "future_mos", "future_timestamp", "prediction_lead_seconds", "future_poor_qoe",
    ]
    stored, rebuilt = stored.where("event_id % 17 != 0"), rebuilt.where("event_id % 19 != 0")
    # Both sides have a row for each event and bitrate.
    rows = 2 * len(RESOLUTION_BY_BITRATE) * views.table(spark, sf_dir, "events").count()
    return reconcile.stored_versus_recomputed(stored, rebuilt, KEY, columns, views.tasks_for(spark, rows, 1_500_000))


@query(
    "digest_tree_comparison",
    """SELECT count(*) FILTER (event_id % 1009 NOT IN (1, 2, 3)) AS rows,
         count(*) FILTER (event_id % 1009 = 1) AS stored_only,
         count(*) FILTER (event_id % 1009 = 2) AS rebuilt_only,
         count(*) FILTER (event_id % 1009 = 3) AS repeated,
         CAST(0 AS BIGINT) AS ts_mismatches,
         count(*) FILTER (event_id % 1009 = 4) AS user_id_mismatches,
         count(*) FILTER (event_id % 1009 = 5 AND event_type IS NOT NULL) AS event_type_mismatches,
         count(*) FILTER (event_id % 1009 = 6 AND value IS NOT NULL) AS value_mismatches,
         CAST(0 AS BIGINT) AS props_mismatches
       FROM events""",
)
def digest_tree_comparison(spark, sf_dir):
    """Two stored tables compared by digests of buckets: missing, repeated and altered rows."""
    e = views.table(spark, sf_dir, "events")
    at = lambda k: F.col("event_id") % 1009 == k
    columns = ["ts", "user_id", "event_type", "value", "props"]
    altered = e.withColumns(
        {
            "user_id": F.when(at(4), F.col("user_id") + 1).otherwise(F.col("user_id")),
            "event_type": F.when(at(5), None).otherwise(F.col("event_type")),
            "value": F.when(at(6), F.col("value") + 1).otherwise(F.col("value")),
        }
    )
    rebuilt = altered.where(~at(1)).unionByName(altered.where(at(3)))
    paths = [run_dir(spark, "digests") for _ in range(2)]
    for frame, path in ((e.where(~at(2)), paths[0]), (rebuilt, paths[1])):
        digests.store(frame, path, ["event_id"], columns)
    return digests.compare(spark, *paths, ["event_id"], columns).summary


@query(
    "first_observation_per_user",
    """SELECT user_id, event_id, epoch_us(ts) AS ts_us FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def first_observation_per_user(spark, sf_dir):
    """Distinct on a key subset, keeping the earliest row."""
    df = views.physical(spark, sf_dir)
    out = reconcile.first_per_key(df, ["user_id"], ["timestamp", "event_id"])
    return out.select("user_id", "event_id", ts_us())


@query(
    "scenario_set_differences",
    """SELECT * FROM (SELECT DISTINCT user_id % 4 + 1 AS base_station, 5 * (user_id % 8 + 1) AS prb, 'left' AS side
         FROM events WHERE event_type = 'click')
       WHERE (base_station, prb) NOT IN (SELECT (user_id % 4 + 1, 5 * (user_id % 8 + 1)) FROM events
         WHERE event_type = 'view')
       UNION ALL
       SELECT * FROM (SELECT DISTINCT user_id % 4 + 1, 5 * (user_id % 8 + 1), 'right'
         FROM events WHERE event_type = 'view') t(base_station, prb, side)
       WHERE (base_station, prb) NOT IN (SELECT (user_id % 4 + 1, 5 * (user_id % 8 + 1)) FROM events
         WHERE event_type = 'click')""",
)
def scenario_set_differences(spark, sf_dir):
    """Scenario pairs seen in one kind of event only."""
    e = views.table(spark, sf_dir, "events")
    pairs = e.select(
        "event_type", (F.col("user_id") % 4 + 1).alias("base_station"),
        (5 * (F.col("user_id") % 8 + 1)).alias("prb"),
    )
    clicks = pairs.where(F.col("event_type") == "click").drop("event_type")
    seen = pairs.where(F.col("event_type") == "view").drop("event_type")
    return reconcile.set_differences(clicks, seen)


@query(
    "user_set_differences",
    """(SELECT DISTINCT o_custkey AS custkey, 'right' AS side FROM orders
          WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
       UNION ALL (SELECT c_custkey, 'left' FROM customer WHERE c_acctbal > 0
          AND c_custkey NOT IN (SELECT o_custkey FROM orders))""",
)
def user_set_differences(spark, sf_dir):
    """Customers in credit against customers with orders."""
    credit = views.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    orders = views.table(spark, sf_dir, "orders")
    return reconcile.set_differences(
        credit.select(F.col("c_custkey").alias("custkey")), orders.select(F.col("o_custkey").alias("custkey"))
    )


@query(
    "split_scan",
    over("SELECT session_id, epoch_us(timestamp) AS ts_us FROM kept WHERE split = 'test'"),
)
def split_scan(spark, sf_dir):
    """Partition-pruned, column-pruned scan of one split of a stored feature table."""
    from steadycast.session import run_dir
    from steadycast.sources import tables

    path = run_dir(spark, "features")
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    tables.write_feature_table(t.frame, path)
    return tables.read_split(spark, path, "test", ["session_id", "timestamp"]).select("session_id", ts_us())


@query(
    "scenario_from_url",
    """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_extract(url, '/([^/?#]*)$', 1) AS leaf FROM pages""",
)
def scenario_from_url(spark, sf_dir):
    """Metadata from a path by pattern."""
    from steadycast.sources.scenario import path_parts

    pages = views.table(spark, sf_dir, "pages")
    parts = path_parts(F.col("url"), {"host": r"^https?://([^/]+)", "leaf": r"/([^/?#]*)$"})
    return pages.select("page_id", *[c.alias(n) for n, c in parts.items()])


# ---- contracts ------------------------------------------------------------------------

MEASURES = ["throughput_mbps", "latitude", "longitude", "plr_percent", "current_mos"]


@query(
    "null_measurements",
    over("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in MEASURES) + " FROM obs"),
)
def null_measurements(spark, sf_dir):
    """Null cells of the base measurements."""
    return quality.null_counts(views.observations(spark, sf_dir), MEASURES)


@query(
    "key_contract",
    over(
        """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_key_rows,
             count(*) FILTER (n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows
           FROM (SELECT count(*) AS n FROM obs GROUP BY base_station, mobility, prb, user_id, timestamp,
             bitrate_kbps)"""
    ),
)
def key_contract(spark, sf_dir):
    """Uniqueness of the row identity."""
    return quality.key_contract(views.observations(spark, sf_dir), ROW_IDENTITY)


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    """Duplicated keys of a large table."""
    return quality.duplicate_keys(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "ambiguous_source_keys",
    over(
        """SELECT base_station, prb, user_id, ts_s, count(*) AS rows FROM (SELECT *,
             CAST(floor(epoch_us(timestamp) / 60000000) AS BIGINT) AS ts_s FROM phys)
           GROUP BY ALL HAVING count(*) > 1"""
    ),
)
def ambiguous_source_keys(spark, sf_dir):
    """Source keys held by several rows when times are cut to the minute."""
    minute = F.floor(epoch_micros(F.col("timestamp")) / 60000000).alias("ts_s")
    df = views.physical(spark, sf_dir).select("*", minute)
    return quality.duplicate_keys(df, ["base_station", "prb", "user_id", "ts_s"])


@query(
    "duplicate_session_times",
    over("SELECT session_id, epoch_us(timestamp) AS ts_us, count(*) AS rows FROM sess GROUP BY ALL HAVING count(*) > 1"),
)
def duplicate_session_times(spark, sf_dir):
    """Sessions with two rows at the same time."""
    df = views.labelled(spark, sf_dir).frame
    out = quality.duplicate_keys(df, ["session_id", "timestamp"])
    return out.select("session_id", ts_us(), "rows")


@query(
    "non_increasing_times",
    """WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate,
         lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)
       SELECT o_custkey, o_orderkey FROM p WHERE o_orderdate <= prev""",
)
def non_increasing_times(spark, sf_dir):
    """Orders not dated after the customer's previous order number."""
    df = views.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").alias("timestamp")
    )
    hot = sessions.find_hot_keys(df, ["o_custkey"])
    return quality.non_increasing(df, ["o_custkey"], "o_orderkey", hot).select("o_custkey", "o_orderkey")


@query(
    "bitrate_domain",
    over(
        """SELECT bitrate_kbps, count(*) AS rows, count(DISTINCT resolution) AS resolutions,
           CAST(0 AS BIGINT) AS outside_domain FROM obs GROUP BY bitrate_kbps"""
    ),
)
def bitrate_domain(spark, sf_dir):
    """Allowed bitrates and one resolution per bitrate."""
    return quality.bitrate_domain(views.observations(spark, sf_dir))


@query(
    "sibling_counts",
    over(
        """SELECT siblings, count(*) AS observations FROM (SELECT count(DISTINCT bitrate_kbps) AS siblings
           FROM obs GROUP BY base_station, mobility, prb, user_id, timestamp) GROUP BY siblings"""
    ),
)
def sibling_counts(spark, sf_dir):
    """How many bitrates each physical observation has."""
    per = quality.sibling_counts(views.observations(spark, sf_dir))
    return per.groupBy("siblings").agg(F.count(F.lit(1)).alias("observations"))


@query(
    "missing_siblings",
    over(
        """SELECT user_id, epoch_us(timestamp) AS ts_us, count(*) AS siblings FROM obs
           WHERE NOT (event_id % 19 = 0 AND bitrate_kbps = 6000)
           GROUP BY base_station, mobility, prb, user_id, timestamp HAVING count(*) <> 4"""
    ),
)
def missing_siblings(spark, sf_dir):
    """Physical observations that lost a bitrate."""
    df = views.observations(spark, sf_dir)
    df = df.where(~((F.col("event_id") % 19 == 0) & (F.col("bitrate_kbps") == 6000)))
    out = quality.missing_siblings(df, len(RESOLUTION_BY_BITRATE))
    return out.select("user_id", ts_us(), "siblings")


@query(
    "label_contract",
    over(
        """SELECT count(*) AS rows, count(DISTINCT session_id) AS sessions,
             count(*) FILTER (future_poor_qoe IS NULL) AS terminal_rows,
             CAST(0 AS BIGINT) AS sessions_without_one_terminal,
             count(*) FILTER (prediction_lead_seconds <= 0) AS non_positive_leads,
             CAST(0 AS BIGINT) AS label_rule_mismatches FROM lab"""
    ),
)
def label_contract(spark, sf_dir):
    """One terminal row per session, positive leads and the strict label rule."""
    return quality.label_contract(views.labelled(spark, sf_dir).frame)


@query(
    "boundary_values",
    """SELECT count(*) FILTER (l_discount = 0.05) AS equal_0_050, count(*) FILTER (l_discount = 0.06) AS equal_0_060
       FROM lineitem""",
)
def boundary_values(spark, sf_dir):
    """Rows exactly on boundary values."""
    li = views.table(spark, sf_dir, "lineitem").withColumn("l_discount", F.col("l_discount").cast("double"))
    return quality.boundary_values(li, "l_discount", [0.05, 0.06])


_BREAKS = """SELECT '{name}' AS table_name, CAST(1 AS BIGINT) AS files, count(*) AS rows,
    count(*) FILTER (k < before) AS breaks, count(*) FILTER (k < before) = 0 AS sorted
    FROM (SELECT {key} AS k, lag({key}) OVER () AS before FROM {name})"""


@query(
    "stored_order",
    " UNION ALL ".join(
        _BREAKS.format(name=n, key=k) for n, k in (("orders", "o_orderkey"), ("lineitem", "(l_orderkey, l_linenumber)"), ("events", "(ts, event_id)"), ("labels", "doc_id"))
    ),
)
def stored_order(spark, sf_dir):
    """Whether stored tables are in the order of their keys, and how many rows are less than the one before."""
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["ts", "event_id"], "labels": ["doc_id"]}
    found = [sortedness(spark, f"{sf_dir}/{n}.parquet", k).select(F.lit(n).alias("table_name"), "*") for n, k in keys.items()]
    return reduce(DataFrame.unionByName, found)


@query(
    "value_domains",
    over(
        """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS bad_calibrated_probability,
           count(*) FILTER (plr_percent > 1) AS bad_plr_percent,
           CAST(0 AS BIGINT) AS bad_predicted_poor_qoe,
           count(*) FILTER (session_step > 1) AS bad_session_step FROM scored"""
    ),
)
def value_domains(spark, sf_dir):
    """Probability and binary columns checked, two of them unfit on purpose."""
    return quality.value_domains(scored(spark, sf_dir), [P, "plr_percent"], [DECISION, "session_step"])


@query(
    "decision_agreement",
    over(
        """SELECT count(*) AS rows, count(*) FILTER ((calibrated_probability >= 0.37)::INT <> predicted_poor_qoe)
             AS decision_mismatches, count(*) AS threshold_mismatches FROM scored"""
    ),
)
def decision_agreement(spark, sf_dir):
    """Stored decisions taken at 0.5 against a frozen threshold of 0.37."""
    df = scored(spark, sf_dir).withColumn("stored_threshold", F.lit(views.TAU))
    return quality.decision_agreement(df, P, DECISION, "stored_threshold", 0.37)


# ---- lineage --------------------------------------------------------------------------


@query("file_manifest")
def file_manifest(spark, sf_dir):
    """Size and SHA-256 of every input file."""
    return lineage.file_manifest(spark, sf_dir, "*.parquet")


@query("file_manifest_differences")
def file_manifest_differences(spark, sf_dir):
    """Differences against a manifest with one altered, one absent and one extra entry."""
    actual = lineage.file_manifest(spark, sf_dir, "*.parquet")
    sha = F.when(F.col("file") == "events.parquet", F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    name = F.when(F.col("file") == "nation.parquet", F.lit("nations.parquet")).otherwise(F.col("file"))
    expected = actual.select(name.alias("file"), "bytes", sha.alias("sha256"))
    return lineage.manifest_differences(actual, expected)


@query(
    "table_fingerprint",
    """SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', event_id, epoch_us(ts), user_id,
         coalesce(event_type, '<null>'), coalesce(CAST(CAST(value AS DECIMAL(38, 9)) AS VARCHAR), '<null>'),
         coalesce(props, '<null>'))), 1, 12) AS BIGINT)) AS VARCHAR) AS content
       FROM events""",
)
def table_fingerprint(spark, sf_dir):
    """Row count and content hash that ignore row order and partitioning."""
    e = views.table(spark, sf_dir, "events")
    # A number as text of fixed places, so that another engine gives the same.
    value = F.col("value").cast("decimal(38,9)").cast("string")
    columns = [F.col("event_id"), epoch_micros(F.col("ts")), F.col("user_id"), F.col("event_type"), value, F.col("props")]
    return lineage.fingerprint(e, columns).select("rows", "content")


@query(
    "lineage_breaks",
    """SELECT 'customer:' || c_custkey AS artifact,
         'nation:' || (CASE WHEN c_custkey % 50 = 1 THEN 99 ELSE c_nationkey END) AS parent,
         CASE WHEN c_custkey % 50 = 1 THEN 'unknown parent' WHEN c_custkey % 50 = 2 THEN 'changed parent'
           ELSE 'other configuration' END AS reason
       FROM customer WHERE c_custkey % 50 IN (1, 2, 3)""",
)
def lineage_breaks(spark, sf_dir):
    """Customers as artifacts built from nations, with three kinds of broken link."""
    n = views.table(spark, sf_dir, "nation")
    c = views.table(spark, sf_dir, "customer")
    parents = n.select(
        F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("artifact"),
        F.md5(F.col("n_nationkey").cast("string")).alias("fingerprint"),
        F.lit("c1").alias("configuration"), F.lit("f1").alias("features"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parent_fingerprint"),
    )
    kind = F.col("c_custkey") % 50
    children = c.select(
        F.concat(F.lit("customer:"), F.col("c_custkey")).alias("artifact"),
        F.md5(F.col("c_custkey").cast("string")).alias("fingerprint"),
        F.when(kind == 3, "c2").otherwise("c1").alias("configuration"), F.lit("f1").alias("features"),
        F.concat(F.lit("nation:"), F.when(kind == 1, 99).otherwise(F.col("c_nationkey"))).alias("parent"),
        F.md5(F.when(kind == 2, F.lit("old")).otherwise(F.col("c_nationkey").cast("string"))).alias("parent_fingerprint"),
    )
    return lineage.broken_links(parents.unionByName(children))


@query(
    "setting_conflicts",
    """SELECT CAST(l_partkey AS VARCHAR) AS path, CASE
           WHEN count(DISTINCT l_returnflag) FILTER (l_linestatus = 'F') > 1 THEN 'CONFLICT'
           WHEN count(*) FILTER (l_linestatus <> 'F') > 0 OR count(*) FILTER (l_linenumber = 1) = 0
             OR count(*) FILTER (l_linenumber = 2) = 0 THEN 'BLOCKED_PENDING_ARTIFACTS'
           ELSE 'CONSISTENT' END AS status,
         concat_ws(',', CASE WHEN count(*) FILTER (l_linenumber = 1) = 0 THEN 'line 1' END,
           CASE WHEN count(*) FILTER (l_linenumber = 2) = 0 THEN 'line 2' END) AS missing_sources,
         count(DISTINCT l_returnflag) AS distinct_values
       FROM lineitem GROUP BY l_partkey""",
)
def setting_conflicts(spark, sf_dir):
    """Status of every part, with line numbers as sources and return flags as values."""
    seen = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("path"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("source"),
        F.col("l_returnflag").alias("value"), (F.col("l_linestatus") == "F").alias("available"),
    )
    out = lineage.path_status(seen, ["line 1", "line 2"])
    return out.withColumn("missing_sources", F.array_join("missing_sources", ","))


@query(
    "metric_reconciliation",
    over("SELECT model, 'f1' AS metric FROM m WHERE model = 'hedged'", **metrics_sql(_MODELS, ["model"])),
)
def metric_reconciliation(spark, sf_dir):
    """Two ways of computing the same metric table, with one value altered."""
    rows = _models(spark, sf_dir)
    names = ["accuracy", "precision", "recall", "f1", "false_alarm_rate"]
    full = metrics.binary_metrics(rows, TARGET, "prediction", "probability", ["model"])
    brief = metrics.decision_metrics(rows, TARGET, "prediction", ["model"])
    brief = brief.withColumn("f1", F.when(F.col("model") == "hedged", F.col("f1") + 1e-6).otherwise(F.col("f1")))
    bad = reconcile.metric_differences(
        reconcile.to_long(full, ["model"], names), reconcile.to_long(brief, ["model"], names), ["model", "metric"]
    )
    return bad.select("model", "metric")


@query(
    "split_manifest_agreement",
    over("SELECT split, count(*) AS summary_rows, count(*) AS manifest_rows, true AS agrees FROM kept GROUP BY split"),
)
def split_manifest_agreement(spark, sf_dir):
    """Rows per split of the summary against rows kept by the removal accounting."""
    t = views.labelled(spark, sf_dir)
    bounds = views.time_bounds(spark, sf_dir)
    assigned = splits.assign_split(t.frame, bounds)
    summary = splits.split_summary(splits.remove_crossing_targets(assigned, bounds))
    removed = assigned.groupBy("split").agg(
        (
            F.count(F.lit(1))
            - F.count_if(F.col("future_poor_qoe").isNull())
            - F.count_if(
                F.col("future_poor_qoe").isNotNull()
                & (
                    ((F.col("split") == "train") & (epoch_micros(F.col("future_timestamp")) >= bounds.train_end))
                    | ((F.col("split") == "validation") & (epoch_micros(F.col("future_timestamp")) >= bounds.validation_end))
                )
            )
        ).alias("manifest_rows")
    )
    return summary.join(removed, "split").select(
        "split", F.col("rows").alias("summary_rows"), "manifest_rows",
        (F.col("rows") == F.col("manifest_rows")).alias("agrees"),
    )


# ---- publication tables ---------------------------------------------------------------


@query(
    "publication_dataset",
    over(
        """SELECT upper(split[1]) || split[2:] AS "Split", count(*) AS "Rows", count(DISTINCT session_id) AS "Sessions",
           count(DISTINCT user_id) AS "Users", round(avg(future_poor_qoe), 4) AS "Poor QoE Rate" FROM kept GROUP BY split"""
    ),
)
def publication_dataset(spark, sf_dir):
    """Dataset summary as published."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    s = splits.split_summary(t.frame)
    return s.select(
        F.initcap("split").alias("Split"), F.col("rows").alias("Rows"), F.col("sessions").alias("Sessions"),
        F.col("users").alias("Users"), F.round("poor_rate", 4).alias("Poor QoE Rate"),
    )


FINAL = ["accuracy", "precision", "recall", "f1", "pr_auc", "brier_score", "expected_calibration_error"]


@query(
    "publication_final_metrics",
    over(
        "SELECT CASE scope WHEN 'all' THEN 'All predictions' ELSE 'Accepted only' END AS scope, observations, "
        + ", ".join(FINAL) + " FROM m",
        **metrics_sql(
            f"SELECT 'all' AS scope, {SRC} WHERE split = 'test' UNION ALL "
            f"SELECT 'accepted' AS scope, {SRC} WHERE split = 'test' AND NOT abstain",
            ["scope"],
        ),
    ),
)
def publication_final_metrics(spark, sf_dir):
    """Final metrics of all and of accepted test rows."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    out = rounded(metrics.scope_metrics(test, TARGET, DECISION, P))
    label = F.when(F.col("scope") == "all", "All predictions").otherwise("Accepted only")
    return out.select(label.alias("scope"), "observations", *FINAL)


@query(
    "publication_trust",
    over(
        """SELECT measure, round(value, 6) AS value FROM (SELECT CAST(count(*) AS DOUBLE) AS total_predictions,
             CAST(count(*) FILTER (NOT abstain) AS DOUBLE) AS accepted_predictions,
             CAST(count(*) FILTER (abstain) AS DOUBLE) AS abstained_predictions,
             avg((NOT abstain)::INT) AS coverage, avg(abstain::INT) AS abstention_rate,
             avg((actual_future_poor_qoe = predicted_poor_qoe)::INT) FILTER (NOT abstain) AS accepted_decision_accuracy
             FROM scored WHERE split = 'test') UNPIVOT (value FOR measure IN (total_predictions, accepted_predictions,
             abstained_predictions, coverage, abstention_rate, accepted_decision_accuracy))"""
    ),
)
def publication_trust(spark, sf_dir):
    """Selective prediction measures as published."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    out = metrics.selective_summary(test, TARGET, DECISION)
    out = out.withColumnRenamed("accepted_accuracy", "accepted_decision_accuracy")
    names = ["total_predictions", "accepted_predictions", "abstained_predictions", "coverage", "abstention_rate",
             "accepted_decision_accuracy"]
    long = reconcile.to_long(out, [], names)
    return long.select(F.col("metric").alias("measure"), *r6("value"))


# ---- ordering, projections and samples ------------------------------------------------


@query(
    "calibration_comparison",
    over(
        """SELECT model, expected_calibration_error, brier_score, f1,
           row_number() OVER (ORDER BY expected_calibration_error, brier_score, -f1) AS place FROM m""",
        **metrics_sql(_MODELS, ["model"]),
    ),
)
def calibration_comparison(spark, sf_dir):
    """Candidates in the order (calibration error, Brier, -F1); place 1 is chosen."""
    from pyspark.sql import Window

    out = rounded(metrics.binary_metrics(_models(spark, sf_dir), TARGET, "prediction", "probability", ["model"]))
    # One row per candidate.
    order = Window.partitionBy(F.lit(1)).orderBy("expected_calibration_error", "brier_score", -F.col("f1"))
    return out.select(
        "model", "expected_calibration_error", "brier_score", "f1",
        F.row_number().over(order).cast("long").alias("place"),
    )


@query(
    "selection_predictions",
    over(
        """SELECT session_id, epoch_us(timestamp) AS ts_us, future_poor_qoe::INT AS future_poor_qoe,
             'closed_form' AS model, 'none' AS calibration_method,
             round(calibrated_probability, 6) AS probability_poor_qoe,
             (calibrated_probability >= 0.35)::INT AS predicted_poor_qoe, CAST(0.35 AS DOUBLE) AS decision_threshold
           FROM scored WHERE split = 'validation'"""
    ),
)
def selection_predictions(spark, sf_dir):
    """Selection-period output rows of one candidate."""
    df = scored(spark, sf_dir).where(F.col("split") == "validation")
    out = reshape.selection_predictions(df, "closed_form", "none", P, 0.35)
    return out.select(
        "session_id", ts_us(), F.col("future_poor_qoe").cast("int").alias("future_poor_qoe"), "model",
        "calibration_method", *r6("probability_poor_qoe"), "predicted_poor_qoe", "decision_threshold",
    )


@query(
    "decision_labels",
    over(
        """SELECT CASE WHEN abstain THEN 'abstain' WHEN predicted_poor_qoe = 1 THEN 'future_poor_qoe'
             ELSE 'future_acceptable_qoe' END AS prediction, count(*) AS rows FROM scored GROUP BY 1"""
    ),
)
def decision_labels(spark, sf_dir):
    """Decision label of every scored row."""
    return scored(spark, sf_dir).groupBy(reshape.decision_label().alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


EVIDENCE_DOUBLES = [
    "prediction_probability", "trust_score", "current_mos", "throughput_mbps", "capacity_margin_mbps",
    "throughput_to_bitrate_ratio", "plr_percent",
]


def four(column: str) -> str:
    """SQL: rounded to four places, half up on the shortest text of the double."""
    return f"CAST(round(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)"


@query(
    "evidence_projection",
    over(
        """SELECT session_id, epoch_us(timestamp) AS ts_us, CASE WHEN abstain THEN 'abstain'
             WHEN predicted_poor_qoe = 1 THEN 'future_poor_qoe' ELSE 'future_acceptable_qoe' END AS prediction,
             trust_level, bitrate_kbps, """
        + ", ".join(
            four("calibrated_probability" if n == "prediction_probability" else n) + f" AS {n}"
            for n in EVIDENCE_DOUBLES
        )
        + " FROM scored"
    ),
)
def evidence_projection(spark, sf_dir):
    """Allow-listed evidence fields of every scored row."""
    df = scored(spark, sf_dir).withColumn("e", reshape.evidence(P))
    return df.select("session_id", ts_us(), "e.*")


_HASH = "md5(concat_ws('|', session_id, user_id, epoch_us(timestamp), '{seed}'))"
_CATEGORY = """CASE WHEN abstain THEN 'abstention' WHEN predicted_poor_qoe = 1 THEN 'accepted_poor_qoe'
    ELSE 'accepted_acceptable_qoe' END"""


@query(
    "review_sample",
    over(
        f"""SELECT category, session_id, epoch_us(timestamp) AS ts_us FROM (SELECT *, {_CATEGORY} AS category,
            {_HASH.format(seed=42)} AS h FROM scored WHERE split = 'test')
            QUALIFY row_number() OVER (PARTITION BY category ORDER BY h) <= 10"""
    ),
)
def review_sample(spark, sf_dir):
    """Ten rows per review stratum of the test period."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return sampling.review_sample(test, 42).select("category", "session_id", ts_us())


@query(
    "diverse_sample",
    over(
        f"""SELECT session_id, epoch_us(timestamp) AS ts_us FROM (
            SELECT *, row_number() OVER (ORDER BY pass, CASE WHEN pass = 1 THEN h1 ELSE h2 END) AS place FROM (
              SELECT *, CASE WHEN r <= greatest(30 // strata, 1) THEN 1 ELSE 2 END AS pass FROM (
                SELECT *, row_number() OVER (PARTITION BY trust_level, predicted_poor_qoe, actual_future_poor_qoe
                  ORDER BY h1) AS r, (SELECT count(*) FROM (SELECT DISTINCT trust_level, predicted_poor_qoe,
                  actual_future_poor_qoe FROM scored WHERE split = 'test')) AS strata
                FROM (SELECT *, {_HASH.format(seed=42)} AS h1, {_HASH.format(seed=43)} AS h2
                  FROM scored WHERE split = 'test'))))
            WHERE place <= 30"""
    ),
)
def diverse_sample(spark, sf_dir):
    """Thirty rows across level, decision and outcome."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return sampling.diverse_sample(test, 30, 42).select("session_id", ts_us())


@query(
    "physical_key_rows",
    over(
        """SELECT base_station, count(DISTINCT (base_station, mobility, prb, user_id, timestamp)) AS observations
           FROM obs GROUP BY base_station"""
    ),
)
def physical_key_rows(spark, sf_dir):
    """Physical observations per station."""
    df = views.observations(spark, sf_dir).select(*PHYSICAL_KEY).distinct()
    return df.groupBy("base_station").agg(F.count(F.lit(1)).alias("observations"))


@query(
    "custom_split_shares",
    over(
        """SELECT max(n) AS distinct_timestamps,
             epoch_us(max(CASE WHEN i = CAST(floor(n * 0.5) AS BIGINT) THEN t END)) AS train_end_us,
             epoch_us(max(CASE WHEN i = CAST(floor(n * 0.75) AS BIGINT) THEN t END)) AS validation_end_us
           FROM ranked_stamps"""
    ),
)
def custom_split_shares(spark, sf_dir):
    """Boundaries at other shares."""
    return splits.boundary_row(views.physical(spark, sf_dir).select("timestamp"), SplitParams(0.5, 0.25))
