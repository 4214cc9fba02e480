"""Registered queries: prompts, explanation checks and reviews over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadycast.functions.scalar import epoch_micros
from steadycast.functions.text import number_text
from steadycast.functions.text import exact_number
from steadycast.operators import explain, reviews, sampling
from steadycast.operators.explain import (
    PROMPT_CHECK,
    PROMPT_LIMITATION,
    PROMPT_RULES,
    PROMPT_SUMMARY,
    PROMPT_TASK,
)
from steadycast.operators.reshape import EVIDENCE_FIELDS, evidence
from steadycast.plans.metric_queries import P, scored
from steadycast.plans.oracle import over
from steadycast.plans.quality_queries import _HASH, four
from steadycast.plans.registry import query
from steadycast.plans.session_queries import r6, ts_us


def lit(text: str) -> str:
    """An SQL text literal."""
    return "'" + text.replace("'", "''") + "'"


def _case(values: dict[str, str]) -> str:
    return "CASE prediction " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + " END"


_ROUNDED = [f for f in EVIDENCE_FIELDS if f not in ("prediction", "trust_level", "bitrate_kbps")]


def _text(column: str) -> str:
    """SQL: JSON text of a number with at most four places."""
    digits = f"regexp_replace(CAST(CAST(round(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DECIMAL(24, 4)) AS VARCHAR), '0+$', '')"
    return f"(CASE WHEN {digits} LIKE '%.' THEN {digits} || '0' ELSE {digits} END)"


_LINES = " || ',' || chr(10) || ".join(
    f"'  \"{n}\": ' || "
    + (
        f"'\"' || {n} || '\"'" if n in ("prediction", "trust_level")
        else "bitrate_kbps" if n == "bitrate_kbps"
        else _text("calibrated_probability" if n == "prediction_probability" else n)
    )
    for n in sorted(EVIDENCE_FIELDS)
)
CASES = {
    "decided": """SELECT *, CASE WHEN abstain THEN 'abstain' WHEN predicted_poor_qoe = 1 THEN 'future_poor_qoe'
        ELSE 'future_acceptable_qoe' END AS prediction,
        CASE WHEN abstain THEN 'low' ELSE trust_level END AS confidence,
        event_id % 10 AS kind, capacity_insufficient = 1 AND NOT abstain AS short FROM scored""",
    "prompts": f"""SELECT *, {lit(PROMPT_RULES + chr(10) + 'Decision-specific task:' + chr(10))} || {_case(PROMPT_TASK)}
        || chr(10) || chr(10) || 'Evidence:' || chr(10) || '{{' || chr(10) || {_LINES} || chr(10) || '}}'
        || chr(10) || chr(10) || 'Return ONLY this JSON schema:' || chr(10) || chr(10) || '{{' || chr(10)
        || '  "prediction": "' || prediction || '",' || chr(10) || '  "confidence": "' || confidence || '",'
        || chr(10) || '  "summary": "' || {_case(PROMPT_SUMMARY)} || '",' || chr(10)
        || '  "likely_causes": [],' || chr(10) || '  "recommended_operator_checks": [{lit('"' + PROMPT_CHECK + '"')[1:-1]}],'
        || chr(10) || '  "limitations": "{PROMPT_LIMITATION}"' || chr(10) || '}}' || chr(10) AS prompt FROM decided""",
    "verdicts": f"""SELECT *, kind NOT IN (7, 8) AS schema_valid, CASE
          WHEN kind = 3 THEN 'Unsupported number: 987654.25'
          WHEN kind = 4 THEN 'Wrong unit for throughput_mbps: Gbps'
          WHEN kind = 5 AND prediction = 'future_poor_qoe' THEN 'Poor-QoE prediction is described as acceptable QoE.'
          WHEN kind = 5 AND prediction = 'future_acceptable_qoe'
            THEN 'Acceptable-QoE prediction is described as a degradation forecast.'
          WHEN kind = 6 AND abstain THEN 'Abstention explanation confidence must be low.'
          WHEN kind = 6 THEN 'Explanation confidence contradicts evidence trust_level: '''
            || CASE WHEN confidence = 'high' THEN 'low' ELSE 'high' END || ''' != ''' || trust_level || '''.'
          WHEN kind = 7 THEN 'Schema validation at note: Extra inputs are not permitted'
          WHEN kind = 8 THEN 'Schema validation at recommended_operator_checks: Value error, At least one non-empty item is required.'
          END AS error FROM decided""",
}


def cases(spark, sf_dir):
    """Every scored row as a case with an explanation; three in five carry one planted fault."""
    kind = F.col("event_id") % 10
    df = scored(spark, sf_dir).withColumn("evidence", evidence(P))
    e = F.col("evidence")
    decision = e["prediction"]
    shown = number_text(e["throughput_mbps"])
    confidence = F.when(F.col("abstain"), "low").otherwise(F.col("trust_level"))
    opposite = F.when(decision == "future_poor_qoe", " The model predicts acceptable QoE.").otherwise(
        " The model predicts poor QoE."
    )
    fault = (
        F.when(kind == 3, " The value 987654.25 was seen.")
        .when(kind == 4, F.concat(F.lit(" Throughput is "), shown, F.lit(" Gbps.")))
        .when(kind == 5, opposite)
        .otherwise("")
    )
    cause = F.struct(
        F.concat(
            F.lit("Throughput is "), shown, F.lit(" Mbps for a bitrate of "),
            e["bitrate_kbps"].cast("string"), F.lit(" kbps."),
        ).alias("statement"),
        F.array(F.lit("throughput_mbps"), F.lit("bitrate_kbps")).alias("evidence_keys"),
    )
    short = (F.col("capacity_insufficient") == 1) & ~F.col("abstain")
    flipped = F.when(confidence == "high", "low").otherwise("high")
    text = F.to_json(
        F.struct(
            decision.alias("prediction"),
            F.when(kind == 6, flipped).otherwise(confidence).alias("confidence"),
            F.concat(explain._by_decision(decision, PROMPT_SUMMARY), fault).alias("summary"),
            F.filter(F.array(cause), lambda c: short).alias("likely_causes"),
            F.array(F.when(kind == 8, " ").otherwise(PROMPT_CHECK)).alias("recommended_operator_checks"),
            F.lit(PROMPT_LIMITATION).alias("limitations"),
            F.when(kind == 7, "extra").alias("note"),
        )
    )
    return df.withColumns(
        {
            "case_id": F.concat_ws(":", "session_id", epoch_micros(F.col("timestamp"))),
            "category": sampling.review_category(),
            "prediction": decision,
            "explanation": text,
        }
    )


@query("prompts", over("SELECT session_id, epoch_us(timestamp) AS ts_us, md5(prompt) AS prompt_md5 FROM prompts", **CASES))
def prompts(spark, sf_dir):
    """Prompt of every scored row, compared by its hash."""
    df = scored(spark, sf_dir).withColumn("e", evidence(P))
    return df.select("session_id", ts_us(), F.md5(explain.build_prompt(F.col("e"))).alias("prompt_md5"))


@query(
    "prompt_records",
    over(
        f"""SELECT 'case_' || lpad(CAST(row_number() OVER (ORDER BY CASE category WHEN 'accepted_poor_qoe' THEN 1
            WHEN 'accepted_acceptable_qoe' THEN 2 ELSE 3 END, session_id, user_id, timestamp) AS VARCHAR), 3, '0') AS case_id,
            category, session_id, prediction, abstain, md5(prompt) AS prompt_md5, CAST(NULL AS VARCHAR) AS explanation
            FROM (SELECT *, CASE WHEN abstain THEN 'abstention' WHEN predicted_poor_qoe = 1 THEN 'accepted_poor_qoe'
              ELSE 'accepted_acceptable_qoe' END AS category, {_HASH.format(seed=42)} AS h FROM prompts WHERE split = 'test'
              QUALIFY row_number() OVER (PARTITION BY category ORDER BY h) <= 10)""",
        **CASES,
    ),
)
def prompt_records(spark, sf_dir):
    """Numbered prompt records of the review sample."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    out = explain.prompt_records(sampling.review_sample(test, 42))
    return out.select(
        "case_id", "category", "session_id", "prediction", "abstain",
        F.md5("prompt").alias("prompt_md5"), "explanation",
    )


_VERDICT = """SELECT session_id, epoch_us(timestamp) AS ts_us, schema_valid,
    CASE WHEN NOT schema_valid THEN 'not checked' WHEN error IS NULL THEN 'grounded' ELSE 'not grounded' END AS grounding,
    coalesce(error, '') AS errors FROM verdicts"""


def checked(spark, sf_dir):
    return explain.validate(cases(spark, sf_dir))


@query("explanation_verdicts", over(_VERDICT, **CASES))
def explanation_verdicts(spark, sf_dir):
    """Schema and grounding verdict with all messages for every case."""
    grounding = F.when(~F.col("schema_valid"), "not checked").when(F.col("grounded"), "grounded")
    return checked(spark, sf_dir).select(
        "session_id", ts_us(), "schema_valid", grounding.otherwise("not grounded").alias("grounding"),
        F.array_join("errors", "; ").alias("errors"),
    )


@query(
    "explanation_schema",
    over("SELECT schema_valid, error, count(*) AS cases FROM (SELECT schema_valid, CASE WHEN NOT schema_valid THEN error END AS error FROM verdicts) GROUP BY ALL", **CASES),
)
def explanation_schema(spark, sf_dir):
    """Cases per schema message."""
    df = explain.with_schema_check(cases(spark, sf_dir).select("explanation"))
    errors = F.col("schema_errors")
    df = df.select((F.size(errors) == 0).alias("schema_valid"), F.explode_outer(errors).alias("error"))
    return df.groupBy("schema_valid", "error").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "explanation_narrative",
    over(
        f"""SELECT session_id, epoch_us(timestamp) AS ts_us, md5({_case(PROMPT_SUMMARY)} || CASE kind
            WHEN 3 THEN ' The value 987654.25 was seen.' WHEN 4 THEN ' Throughput is ' || {_text('throughput_mbps')} || ' Gbps.'
            WHEN 5 THEN CASE WHEN prediction = 'future_poor_qoe' THEN ' The model predicts acceptable QoE.'
              ELSE ' The model predicts poor QoE.' END ELSE '' END
            || CASE WHEN short THEN ' Throughput is ' || {_text('throughput_mbps')} || ' Mbps for a bitrate of '
              || bitrate_kbps || ' kbps.' ELSE '' END
            || ' {PROMPT_CHECK} {PROMPT_LIMITATION}') AS narrative_md5
            FROM decided WHERE kind <> 8""",
        **CASES,
    ),
)
def explanation_narrative(spark, sf_dir):
    """Narrative of every case with a non-blank check list."""
    df = cases(spark, sf_dir).where(F.col("event_id") % 10 != 8)
    df = explain.with_schema_check(df.withColumn("explanation", F.regexp_replace("explanation", ',"note":"extra"', "")))
    return df.select("session_id", ts_us(), F.md5(explain.narrative(F.col("__x"))).alias("narrative_md5"))


@query(
    "explanation_import_summary",
    over(
        """SELECT count(*) AS total_cases, count(*) FILTER (schema_valid) AS schema_valid_cases,
           count(*) FILTER (error IS NULL) AS grounding_valid_cases,
           count(*) FILTER (error IS NOT NULL) AS automatic_rejection_cases FROM verdicts""",
        **CASES,
    ),
)
def explanation_import_summary(spark, sf_dir):
    """Totals of an import."""
    return reviews.import_summary(checked(spark, sf_dir))


@query(
    "explanation_batch_metrics",
    over(
        """SELECT count(*) AS total_cases, count(*) FILTER (schema_valid) AS schema_valid_cases,
           count(*) FILTER (error IS NULL) AS grounding_valid_cases,
           count(*) FILTER (error IS NOT NULL) AS rejected_cases,
           round(avg(schema_valid::INT), 6) AS schema_valid_rate, round(avg((error IS NULL)::INT), 6) AS grounding_valid_rate,
           round(avg(event_id % 97 / 10), 6) AS mean_latency_seconds,
           round(median(event_id % 97 / 10), 6) AS median_latency_seconds FROM verdicts""",
        **CASES,
    ),
)
def explanation_batch_metrics(spark, sf_dir):
    """Rates and latency of a batch."""
    df = checked(spark, sf_dir).withColumn("latency", F.col("event_id") % 97 / 10)
    out = explain.batch_metrics(df, "latency")
    rates = ["schema_valid_rate", "grounding_valid_rate", "mean_latency_seconds", "median_latency_seconds"]
    return out.withColumns({c: F.round(c, 6) for c in rates})


@query(
    "explanation_log",
    over("SELECT session_id || ':' || epoch_us(timestamp) AS case_id, CASE WHEN error IS NULL THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN error IS NULL THEN '[]' ELSE '[\"' || error || '\"]' END AS validation_errors FROM verdicts", **CASES),
)
def explanation_log(spark, sf_dir):
    """Flat log of all cases."""
    return explain.explanation_log(checked(spark, sf_dir)).select("case_id", "status", "validation_errors")


@query(
    "changed_records",
    over(
        """SELECT session_id || ':' || epoch_us(timestamp) AS case_id, CASE WHEN event_id % 17 = 0 THEN 'not completed'
             ELSE 'changed trust_score' END AS problems FROM decided
           WHERE event_id % 17 = 0 OR event_id % 19 = 0""",
        **CASES,
    ),
)
def changed_records(spark, sf_dir):
    """Exported against completed records: some dropped, some with another score."""
    export = cases(spark, sf_dir)
    altered = F.when(F.col("event_id") % 19 == 0, F.col("trust_score") + 1).otherwise(F.col("trust_score"))
    completed = export.where(F.col("event_id") % 17 != 0).withColumn("trust_score", altered)
    fields = ["category", "prediction", "trust_score", "abstain"]
    out = reviews.changed_records(export, completed, fields)
    return out.select("case_id", F.array_join("problems", "; ").alias("problems"))


@query(
    "review_sheet",
    over(
        """SELECT session_id || ':' || epoch_us(timestamp) AS case_id, prediction, md5(prompt) AS prompt_md5,
           CASE WHEN error IS NULL THEN '[]' ELSE '["' || error || '"]' END AS automatic_validation_errors,
           '' AS correctness FROM verdicts JOIN prompts USING (session_id, timestamp, prediction)""",
        **CASES,
    ),
)
def review_sheet(spark, sf_dir):
    """Review rows with JSON cells and blank judgements."""
    df = cases(spark, sf_dir).withColumn("prompt", explain.build_prompt(F.col("evidence")))
    out = reviews.review_sheet(df)
    return out.select(
        "case_id", "prediction", F.md5("prompt").alias("prompt_md5"), "automatic_validation_errors", "correctness"
    )


def _judged(df):
    """Judgements in several spellings from the event number."""
    n = F.col("event_id")
    word = F.when(n % 4 == 0, "1").when(n % 4 == 1, " TRUE").when(n % 4 == 2, "0").otherwise("False ")
    return df.withColumns(
        {
            "reviewer_id": F.concat(F.lit("r"), n % 3),
            "correctness": word,
            "completeness": F.when(n % 5 == 0, "0").otherwise("true"),
            "unsupported_statement_present": F.when(n % 7 == 0, "TRUE").otherwise("0"),
            "contradiction_present": F.lit("0"),
        }
    )


_REVIEW_RATES = """SELECT {category} AS prediction_category, count(*) AS reviewed_cases,
    count(*) FILTER (event_id % 4 IN (0, 1)) AS factual_correct_cases, {r}avg((event_id % 4 IN (0, 1))::INT){e} AS factual_correctness_rate,
    count(*) FILTER (event_id % 5 <> 0) AS complete_cases, {r}avg((event_id % 5 <> 0)::INT){e} AS completeness_rate,
    count(*) FILTER (event_id % 7 = 0) AS unsupported_statement_cases, {r}avg((event_id % 7 = 0)::INT){e} AS unsupported_statement_rate,
    CAST(0 AS BIGINT) AS contradiction_cases, {r}0.0::DOUBLE{e} AS contradiction_rate FROM decided {by}"""
_CAT = """CASE WHEN abstain THEN 'abstention' WHEN predicted_poor_qoe = 1 THEN 'accepted_poor_qoe'
    ELSE 'accepted_acceptable_qoe' END"""


def _rates_sql(r: str, e: str) -> str:
    return (
        _REVIEW_RATES.format(category=_CAT, r=r, e=e, by="GROUP BY 1")
        + " UNION ALL " + _REVIEW_RATES.format(category="'overall'", r=r, e=e, by="")
    )


@query("review_rates", over(_rates_sql("round(", ", 6)"), **CASES))
def review_rates(spark, sf_dir):
    """Reviewer rates per category and overall."""
    out = reviews.review_rates(_judged(cases(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_rate")})


@query("review_table", over(_rates_sql("printf('%.4f', ", ")"), **CASES))
def review_table(spark, sf_dir):
    """The published review table."""
    return reviews.review_table(reviews.review_rates(_judged(cases(spark, sf_dir))))


@query(
    "review_problems",
    over(
        """SELECT problems, count(*) AS cases FROM (SELECT concat_ws('; ',
             CASE WHEN event_id % 23 = 0 THEN 'no review' END,
             CASE WHEN event_id % 23 <> 0 AND event_id % 29 = 0 THEN 'completeness is empty' END,
             CASE WHEN event_id % 23 <> 0 AND event_id % 31 = 0 THEN 'review evidence differs' END,
             CASE WHEN event_id % 23 <> 0 AND event_id % 37 = 0 THEN 'correctness is not 0/1 or false/true' END) AS problems
             FROM decided) WHERE problems <> '' GROUP BY problems""",
        **CASES,
    ),
)
def review_problems(spark, sf_dir):
    """Reviews that cannot be evaluated, by reason."""
    n = F.col("event_id")
    df = _judged(cases(spark, sf_dir)).withColumns(
        {"prompt": F.lit("p"), "evidence_json": F.to_json("evidence"), "explanation_json": F.col("explanation"),
         "automatic_validation_errors": F.lit(" [ ]"), "review_notes": F.lit("")}
    )
    returned = df.where(n % 23 != 0).withColumns(
        {
            "completeness": F.when(n % 29 == 0, "  ").otherwise(F.col("completeness")),
            "evidence_json": F.when(n % 31 == 0, "{}").otherwise(F.col("evidence_json")),
            "correctness": F.when(n % 37 == 0, "maybe").otherwise(F.col("correctness")),
        }
    )
    out = reviews.review_problems(df, returned).select(F.array_join("problems", "; ").alias("problems"))
    return out.groupBy("problems").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "json_cell_equality",
    """SELECT count(*) AS rows, count(*) AS equal_reordered, count(*) FILTER (o_orderkey % 2 = 0) AS equal_altered FROM orders""",
)
def json_cell_equality(spark, sf_dir):
    """JSON cells with other key order, spacing and number form; half of one set altered."""
    o = views_orders(spark, sf_dir)
    a = F.concat(F.lit('{"k": '), F.col("o_orderkey"), F.lit(', "p": '), F.col("o_custkey"), F.lit(".0}"))
    b = F.concat(F.lit('{"p":'), F.col("o_custkey"), F.lit(',"k":'), F.col("o_orderkey"), F.lit("}"))
    c = F.concat(F.lit('{"p":'), F.col("o_custkey") + F.col("o_orderkey") % 2, F.lit(',"k":'), F.col("o_orderkey"), F.lit("}"))
    return o.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(reviews.same_json(a, b)).alias("equal_reordered"),
        F.count_if(reviews.same_json(a, c)).alias("equal_altered"),
    )


def views_orders(spark, sf_dir):
    from steadycast.plans.views import table

    return table(spark, sf_dir, "orders")


@query(
    "binary_judgements",
    """SELECT l_returnflag, l_linestatus, CASE WHEN lower(trim(v)) IN ('1', 'true') THEN 1
         WHEN lower(trim(v)) IN ('0', 'false') THEN 0 END::DOUBLE AS judgement, count(*) AS rows
       FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN ' True' WHEN 'N' THEN '0' ELSE 'yes' END AS v FROM lineitem)
       GROUP BY ALL""",
)
def binary_judgements(spark, sf_dir):
    """Judgement words as 0, 1 or null."""
    from steadycast.plans.views import table

    flag = F.col("l_returnflag")
    word = F.when(flag == "A", " True").when(flag == "N", "0").otherwise("yes")
    df = table(spark, sf_dir, "lineitem").withColumn("judgement", reviews.binary(word).cast("double"))
    return df.groupBy("l_returnflag", "l_linestatus", "judgement").agg(F.count(F.lit(1)).alias("rows"))


@query("unsupported_numbers_in_documents")
def unsupported_numbers_in_documents(spark, sf_dir):
    """Numbers in whole documents other than the document's own id and length."""
    from steadycast.plans.views import table

    d = table(spark, sf_dir, "documents")
    numbers = F.create_map(
        F.lit("doc_id"), exact_number(F.col("doc_id").cast("string")),
        F.lit("n_chars"), exact_number(F.col("n_chars").cast("string")),
    )
    found = explain.number_errors(numbers, F.col("text"))
    return d.select("doc_id", F.size(found).alias("unsupported")).where(F.col("unsupported") > 0)
