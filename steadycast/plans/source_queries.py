"""Registered queries: sources, sinks and user hooks, written and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from steadycast.functions.scalar import epoch_micros
from steadycast.operators import explain, hooks, quality, reshape, reviews
from steadycast.operators.features import NETWORK_FEATURES
from steadycast.params import RESOLUTION_BY_BITRATE
from steadycast.plans import explain_queries, views
from steadycast.plans.explain_queries import CASES
from steadycast.plans.metric_queries import P, scored
from steadycast.plans.oracle import over
from steadycast.plans.registry import query
from steadycast.plans.session_queries import KEY, r6, sql6, ts_us
from steadycast.session import run_dir
from steadycast.sources import records, scenario, tables


def _write_scenarios(spark, sf_dir) -> str:
    """The wide table as tab-separated files with scenario names, in the shared folder."""
    path = run_dir(spark, "scenarios")
    wide = views.wide(spark, sf_dir).select(
        F.format_string("MOS_BS_%d_Driver_PRB_%d.tsv", "base_station", "prb").alias("file"),
        F.col("user_id").alias("User_ID"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.col("throughput_mbps").alias("Tput"), F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"), F.lit("x").alias("unused"),
        *[c for b in RESOLUTION_BY_BITRATE for c in (reshape.loss_column(b), reshape.mos_column(b))],
    )
    staged = wide.repartition("file").write.option("header", True).option("sep", "\t").partitionBy("file")
    staged.csv(f"{path}/staged")
    # Give each scenario's file its name: a few metadata calls, no data moves.
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/staged")):
        name = status.getPath().getName()
        if not name.startswith("file="):
            continue
        for part in fs.listStatus(status.getPath()):
            target = jvm.org.apache.hadoop.fs.Path(root, name.removeprefix("file="))
            fs.rename(part.getPath(), target)
    return path


@query(
    "scenario_files",
    over(
        f"""SELECT base_station, mobility, prb, user_id, epoch_us(timestamp) AS ts_us, bitrate_kbps, resolution,
            {sql6('throughput_mbps', 'plr_percent', 'current_mos')} FROM obs"""
    ),
)
def scenario_files(spark, sf_dir):
    """Scenario files of all stations in one scan, renamed and unpivoted."""
    raw = scenario.read_scenarios(spark, _write_scenarios(spark, sf_dir))
    long = reshape.canonical_names(reshape.wide_to_long(raw, list(RESOLUTION_BY_BITRATE)))
    return long.select(
        "base_station", "mobility", "prb", "user_id", F.unix_micros("timestamp").alias("ts_us"),
        "bitrate_kbps", "resolution", *r6("throughput_mbps", "plr_percent", "current_mos"),
    )


@query("csv_export", "SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def csv_export(spark, sf_dir):
    """A table exported as CSV and read back with a schema."""
    path = run_dir(spark, "csv")
    tables.write_csv(views.table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    back = spark.read.schema("event_id long, event_type string, value double").option("header", True).csv(path)
    return back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "jsonl_records",
    over("SELECT session_id || ':' || epoch_us(timestamp) AS case_id, prediction, event_id, CAST(NULL AS VARCHAR) AS explanation FROM decided", **CASES),
)
def jsonl_records(spark, sf_dir):
    """Prompt records written as JSON lines, null fields kept, and read back."""
    path = run_dir(spark, "jsonl")
    df = explain_queries.cases(spark, sf_dir).select("case_id", "prediction", "event_id")
    records.write_jsonl(df.withColumn("explanation", F.lit(None).cast("string")), path)
    schema = StructType(
        [StructField("case_id", StringType()), StructField("prediction", StringType()),
         StructField("event_id", LongType()), StructField("explanation", StringType())]
    )
    return records.read_jsonl(spark, path, schema)


@query(
    "jsonl_rejects",
    """SELECT CAST(event_id AS VARCHAR) AS line, CAST(NULL AS BIGINT) AS event_id FROM events WHERE event_id % 3 = 0
       UNION ALL SELECT NULL, event_id FROM events WHERE event_id % 3 <> 0""".replace("BIGINT", "DOUBLE"),
)
def jsonl_rejects(spark, sf_dir):
    """Lines that are not JSON objects are set aside."""
    path = run_dir(spark, "lines")
    e = views.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(
        F.concat(F.lit('{"event_id": '), F.col("event_id"), F.lit("}"))
    )
    e.select(text.alias("value")).write.text(path)
    good, bad = records.read_jsonl_with_rejects(spark, path, StructType([StructField("event_id", LongType())]))
    return good.select(F.lit(None).cast("string").alias("line"), F.col("event_id").cast("double").alias("event_id")).unionByName(
        bad.select("line", F.lit(None).cast("double").alias("event_id"))
    )


@query(
    "review_csv",
    over("SELECT session_id || ':' || epoch_us(timestamp) AS case_id, prediction, md5(prompt) AS prompt_md5, '' AS correctness FROM prompts", **CASES),
)
def review_csv(spark, sf_dir):
    """Review sheet with multi-line cells written as CSV and read back as text."""
    path = run_dir(spark, "sheet")
    df = explain_queries.cases(spark, sf_dir).withColumn("prompt", explain.build_prompt(F.col("evidence")))
    sheet = df.select(
        "case_id", "prediction", F.to_json("evidence").alias("evidence_json"), "prompt",
        F.col("explanation").alias("explanation_json"), F.lit("[]").alias("automatic_validation_errors"),
        *[F.lit("").alias(c) for c in (*reviews.HUMAN_FIELDS, "review_notes")],
    )
    records.write_review_csv(sheet, path, "gzip")
    back = records.read_review_csv(spark, path)
    return back.select("case_id", "prediction", F.md5("prompt").alias("prompt_md5"), "correctness")


@query("schema_check")
def schema_check(spark, sf_dir):
    """Differences of the observation schema from a contract with two deliberate errors."""
    df = views.physical(spark, sf_dir)
    fields = [StructField("prb", StringType()) if f.name == "prb" else f for f in df.schema.fields]
    found = quality.schema_differences(df, StructType([*fields[1:], fields[0]]))
    n = df.agg(F.count(F.lit(1)).alias("rows"))
    return n.select("rows", F.explode(F.array(*[F.lit(t) for t in found])).alias("difference"))


@query(
    "metrics_document",
    over("SELECT 'events' AS source, 2 AS version, count(*) AS splits, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM kept GROUP BY split)"),
)
def metrics_document(spark, sf_dir):
    """A one-row document with a nested table, written as JSON and read back."""
    t = views.with_split(spark, sf_dir, views.labelled(spark, sf_dir))
    sizes = t.frame.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    path = run_dir(spark, "document")
    tables.write_document(tables.document(spark, {"source": "events", "version": 2}, splits=sizes), path)
    back = spark.read.schema("source string, version int, splits array<struct<rows: long, split: string>>").json(path)
    total = F.aggregate("splits", F.lit(0).cast("long"), lambda a, s: a + s["rows"])
    return back.select("source", "version", F.size("splits").cast("long").alias("splits"), total.alias("rows"))


class MeanModel:
    """A user model in the sense of the hook: any object with ``predict_proba``."""

    def predict_proba(self, frame):
        p = np.clip(frame["throughput_mbps"].to_numpy(dtype=float) / 100.0, 0.0, 1.0)
        return np.column_stack([1 - p, p])


class Halve:
    """A user calibrator."""

    def predict(self, p):
        return np.asarray(p) / 2


@query(
    "user_model_scores",
    over("SELECT event_id, bitrate_kbps, round(least(1.0, greatest(0.0, throughput_mbps / 100.0)), 6) AS p FROM kept"),
)
def user_model_scores(spark, sf_dir):
    """Rows scored by a user model in Arrow batches."""
    t = views.with_split(spark, sf_dir, views.featured(spark, sf_dir))
    df = t.frame.select(*KEY, *[c for c in NETWORK_FEATURES])
    return hooks.score_with(df, MeanModel(), NETWORK_FEATURES, "p").select(*KEY, *r6("p"))


@query(
    "user_calibrator",
    over("SELECT event_id, bitrate_kbps, round(calibrated_probability / 2, 7) AS p FROM scored"),
)
def user_calibrator(spark, sf_dir):
    """Probabilities passed through a user calibrator."""
    df = scored(spark, sf_dir).select(*KEY, P)
    return df.select(*KEY, F.round(hooks.calibrate_with(Halve(), P), 7).alias("p"))


def _answer(prompt: str) -> str:
    """A stand-in client: the JSON template at the end of the prompt."""
    if '"abstain"' in prompt:
        raise RuntimeError("no answer")
    return prompt[prompt.rindex("\n{\n"):].strip()


@query(
    "explanation_client",
    over(
        """SELECT prediction, count(*) AS cases, count(*) FILTER (NOT abstain) AS schema_valid,
           count(*) FILTER (NOT abstain) AS grounded FROM decided GROUP BY prediction""",
        **CASES,
    ),
)
def explanation_client(spark, sf_dir):
    """Prompts completed by a client function, then checked; failed calls are rejected cases."""
    df = scored(spark, sf_dir).withColumn("evidence", reshape.evidence(P))
    prompts = df.select(
        F.concat_ws(":", "session_id", epoch_micros(F.col("timestamp"))).alias("case_id"), "evidence",
        explain.build_prompt(F.col("evidence")).alias("prompt"),
    )
    checked = explain.validate(hooks.complete_with(prompts, _answer))
    return checked.groupBy(F.col("evidence.prediction").alias("prediction")).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("schema_valid").alias("schema_valid"),
        F.count_if(F.coalesce(F.col("grounded"), F.lit(False))).alias("grounded"),
    )
