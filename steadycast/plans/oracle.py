"""The same views as DuckDB SQL, used only to check results."""

from __future__ import annotations


def mean6(x: str, digits: int = 9, where: str = "true") -> str:
    """The mean of values of few places, summed as integers and rounded half up at six places: no tie is left to chance."""
    n, d = f"sum(CAST(round(({x}) * 1e{digits}) AS HUGEINT)) FILTER (WHERE {where})", 10 ** (digits - 6)
    c = f"CAST(count({x}) FILTER (WHERE {where}) AS HUGEINT)"
    return f"CAST((2 * {n} + {c} * {d}) // nullif(2 * {c} * {d}, 0) AS DOUBLE) / 1e6"


VIEWS = {
    "phys": """
        SELECT event_id, user_id % 4 + 1 AS base_station, 'Driver' AS mobility,
          5 * (user_id % 8 + 1) AS prb, user_id, ts AS timestamp,
          value / 10.0 AS throughput_mbps,
          44 + (event_id % 1000) / 10000 AS latitude,
          12 + (event_id * 7 % 1000) / 10000 AS longitude
        FROM events""",
    "obs": """
        SELECT p.*, b.bitrate_kbps, b.resolution,
          1 + 4 * least(1.0, throughput_mbps / (b.bitrate_kbps / 1000)) AS current_mos,
          100 * (1 - least(1.0, throughput_mbps / (b.bitrate_kbps / 1000))) AS plr_percent
        FROM phys p CROSS JOIN (VALUES (CAST(2000 AS BIGINT), '720p'), (4000, '1080p'),
          (6000, '1080p'), (8000, '1080p')) b(bitrate_kbps, resolution)""",
    "gaps": """
        SELECT *, date_diff('microsecond', lag(timestamp) OVER (PARTITION BY base_station, prb,
          bitrate_kbps, user_id ORDER BY timestamp), timestamp) / 1e6 AS gap_seconds FROM obs""",
    "starts": "SELECT *, gap_seconds IS NULL OR gap_seconds > 86400 AS is_session_start FROM gaps",
    "numbered": """
        SELECT *, CAST(sum(CAST(is_session_start AS INT)) OVER (PARTITION BY base_station, prb,
          bitrate_kbps, user_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS INT)
          AS session_number FROM starts""",
    "sess": """
        SELECT *, concat_ws('_', base_station, prb, bitrate_kbps, user_id, session_number)
          AS session_id FROM numbered""",
    "leads": """
        SELECT *, lead(current_mos) OVER s AS future_mos, lead(timestamp) OVER s AS future_timestamp
        FROM sess WINDOW s AS (PARTITION BY session_id ORDER BY timestamp)""",
    "lab": """
        SELECT *, date_diff('microsecond', timestamp, future_timestamp) / 1e6
          AS prediction_lead_seconds, CAST(future_mos < 3.0 AS TINYINT) AS future_poor_qoe
        FROM leads""",
    "lagged": """
        SELECT *,
          lag(throughput_mbps, 1) OVER s AS throughput_lag1,
          lag(throughput_mbps, 2) OVER s AS throughput_lag2,
          lag(current_mos, 1) OVER s AS mos_lag1, lag(plr_percent, 1) OVER s AS plr_lag1,
          lag(latitude, 1) OVER s AS latitude_lag1, lag(longitude, 1) OVER s AS longitude_lag1,
          avg(throughput_mbps) OVER p3 AS throughput_past_mean_3,
          avg(current_mos) OVER p3 AS mos_past_mean_3, avg(plr_percent) OVER p3 AS plr_past_mean_3,
          avg(throughput_mbps) OVER p5 AS throughput_past_mean_5,
          avg(current_mos) OVER p5 AS mos_past_mean_5, avg(plr_percent) OVER p5 AS plr_past_mean_5,
          stddev_samp(throughput_mbps) OVER p5 AS throughput_past_std_5,
          stddev_samp(current_mos) OVER p5 AS mos_past_std_5,
          CAST(row_number() OVER s - 1 AS INT) AS session_step,
          date_diff('microsecond', first_value(timestamp) OVER s, timestamp) / 1e6
            AS elapsed_session_seconds
        FROM lab WINDOW s AS (PARTITION BY session_id ORDER BY timestamp),
          p3 AS (PARTITION BY session_id ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
          p5 AS (PARTITION BY session_id ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
        """,
    "derived": """
        SELECT *, throughput_mbps - throughput_lag1 AS throughput_change_1,
          current_mos - mos_lag1 AS mos_change_1, plr_percent - plr_lag1 AS plr_change_1,
          bitrate_kbps / 1000 AS bitrate_mbps,
          throughput_mbps / (bitrate_kbps / 1000) AS throughput_to_bitrate_ratio,
          throughput_mbps - bitrate_kbps / 1000 AS capacity_margin_mbps,
          CAST(throughput_mbps < bitrate_kbps / 1000 AS TINYINT) AS capacity_insufficient,
          2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0,
            pow(sin((radians(latitude) - radians(latitude_lag1)) / 2), 2)
            + cos(radians(latitude_lag1)) * cos(radians(latitude))
              * pow(sin((radians(longitude) - radians(longitude_lag1)) / 2), 2)))))
            * CASE WHEN latitude_lag1 IS NULL THEN NULL ELSE 1 END AS movement_distance_km
        FROM lagged""",
    "feat": """
        SELECT *, CASE WHEN gap_seconds > 0 THEN movement_distance_km / gap_seconds * 3600 END
          AS movement_speed_kmh FROM derived""",
    "stamps": "SELECT DISTINCT ts AS t FROM events",
    "ranked_stamps": """
        SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM stamps""",
    "bounds": """
        SELECT max(CASE WHEN i = least(CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT), n - 1) THEN t END)
            AS train_end,
          max(CASE WHEN i = least(CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT), n - 1) THEN t END)
            AS validation_end, max(n) AS n
        FROM ranked_stamps""",
    "splitted": """
        SELECT feat.*, train_end, validation_end, CASE WHEN timestamp < train_end THEN 'train'
          WHEN timestamp < validation_end THEN 'validation' ELSE 'test' END AS split
        FROM feat CROSS JOIN bounds""",
    "kept": """
        SELECT * EXCLUDE (train_end, validation_end) FROM splitted
        WHERE future_poor_qoe IS NOT NULL
          AND NOT (split = 'train' AND future_timestamp >= train_end)
          AND NOT (split = 'validation' AND future_timestamp >= validation_end)""",
    "prob": """
        SELECT *, round(least(1.0, greatest(0.0, (5 - current_mos) / 4)), 6) AS calibrated_probability
        FROM kept""",
    "conf": """
        SELECT *, CAST(calibrated_probability >= 0.5 AS INT) AS predicted_poor_qoe,
          CAST(future_poor_qoe AS INT) AS actual_future_poor_qoe,
          CASE WHEN calibrated_probability < 0.5 THEN (0.5 - calibrated_probability) / 0.5
            ELSE (calibrated_probability - 0.5) / 0.5 END AS model_confidence,
          1 - least(stddev_pop(calibrated_probability) OVER (PARTITION BY session_id
            ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 0.5, 1.0)
            AS prediction_stability,
          (7 + (gap_seconds IS NOT NULL)::INT + (throughput_lag1 IS NOT NULL)::INT
            + (throughput_lag2 IS NOT NULL)::INT + (throughput_change_1 IS NOT NULL)::INT
            + (throughput_past_mean_3 IS NOT NULL)::INT + (throughput_past_mean_5 IS NOT NULL)::INT
            + (throughput_past_std_5 IS NOT NULL)::INT + (movement_distance_km IS NOT NULL)::INT
            + (movement_speed_kmh IS NOT NULL)::INT) / 16 AS data_quality
        FROM prob""",
    "trusted": """
        SELECT *, round(0.4 * model_confidence + 0.42 + 0.1 * data_quality, 9) AS trust_score
        FROM conf""",
    "scored": """
        SELECT *, CASE WHEN trust_score >= 0.8 THEN 'high' WHEN trust_score >= 0.55 THEN 'medium'
          ELSE 'low' END AS trust_level, trust_score < 0.62 AS abstain
        FROM trusted""",
}
# Which earlier views each view reads, so that a query carries only what it needs.
_ORDER = list(VIEWS)


def _needed(text: str, limit: int) -> set[str]:
    import re

    words = set(re.findall(r"\w+", text))
    found: set[str] = set()
    for i in range(limit - 1, -1, -1):
        if _ORDER[i] in words and re.search(rf"(?:FROM|JOIN)\s+{_ORDER[i]}\b", text):
            found |= {_ORDER[i]} | _needed(VIEWS[_ORDER[i]], i)
    return found


def over(body: str, **extra: str) -> str:
    """``body`` preceded by the views it reads; ``extra`` adds views of its own."""
    needed = _needed(" ".join([*extra.values(), body]), len(_ORDER))
    parts = [f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in needed]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
