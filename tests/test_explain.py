"""Explanation checks on hand-written cases."""

import json

import pytest
from pyspark.sql import functions as F

from steadycast.functions import text
from steadycast.operators import explain

EVIDENCE = dict(
    prediction="future_poor_qoe", prediction_probability=0.81, trust_score=0.72,
    trust_level="medium", current_mos=2.1, throughput_mbps=5.3, bitrate_kbps=6000,
    capacity_margin_mbps=-0.7, throughput_to_bitrate_ratio=0.88, plr_percent=2.4,
)
SCHEMA = (
    "prediction string, prediction_probability double, trust_score double, trust_level string, "
    "current_mos double, throughput_mbps double, bitrate_kbps long, capacity_margin_mbps double, "
    "throughput_to_bitrate_ratio double, plr_percent double"
)


def explanation(**changes):
    base = dict(
        prediction="future_poor_qoe", confidence="medium",
        summary="Throughput is 5.3 Mbps and current MOS is 2.1.",
        likely_causes=[
            dict(statement="Throughput is 5.3 Mbps for a bitrate of 6000 kbps.",
                 evidence_keys=["throughput_mbps", "bitrate_kbps"])
        ],
        recommended_operator_checks=["Check the cell load."],
        limitations="One observation only.",
    )
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def run(spark, cases):
    """cases: (explanation, evidence changes) -> list of (schema_valid, grounded, errors)."""
    rows = [
        (i, x if isinstance(x, str) or x is None else json.dumps(x), json.dumps({**EVIDENCE, **ev}))
        for i, (x, ev) in enumerate(cases)
    ]
    df = spark.createDataFrame(rows, "i int, explanation string, ev string")
    df = df.withColumn("evidence", F.from_json("ev", SCHEMA))
    got = explain.validate(df).select("i", "schema_valid", "grounded", "errors").orderBy("i").collect()
    return [(r.schema_valid, r.grounded, r.errors) for r in got]


def cause(statement, *keys):
    return [dict(statement=statement, evidence_keys=list(keys))]


NO_CAUSE = dict(likely_causes=[], limitations="There is insufficient evidence.")
ACCEPTABLE = dict(prediction="future_acceptable_qoe")
GROUNDING = [
    (explanation(), {}, []),
    (explanation(summary="The number 9.9 is new, and 9.90 too, and -3."), {},
     ["Unsupported number: -3", "Unsupported number: 9.9"]),
    (explanation(summary="MOS is 5.3."), {}, ["Claimed value 5.3 is not the value of current_mos."]),
    (explanation(summary="Throughput was 5.3 kbps."), {}, ["Wrong unit for throughput_mbps: kbps"]),
    (explanation(summary="Packet loss = 2.4 percentage  points."), {}, []),
    (explanation(summary="Throughput-to-bitrate ratio of 0.88."), {}, []),
    (explanation(confidence="high"), {},
     ["Explanation confidence contradicts evidence trust_level: 'high' != 'medium'."]),
    (explanation(prediction="future_acceptable_qoe"), {},
     ["Explanation prediction contradicts evidence prediction: 'future_acceptable_qoe' != 'future_poor_qoe'."]),
    (explanation(summary="The model predicts acceptable QoE."), {},
     ["Poor-QoE prediction is described as acceptable QoE."]),
    (explanation(summary="The model does not predict acceptable QoE."), {}, []),
    (explanation(summary="It doesn’t forecast good QoE."), {}, []),
    (explanation(**ACCEPTABLE, summary="QoE will degrade."), ACCEPTABLE,
     ["Acceptable-QoE prediction is described as a degradation forecast."]),
    (explanation(**ACCEPTABLE, summary="The model does not predict poor QoE."), ACCEPTABLE, []),
    (explanation(prediction="abstain", confidence="low", summary="Withheld.", **NO_CAUSE),
     dict(prediction="abstain"), []),
    (explanation(prediction="abstain", confidence="medium"), dict(prediction="abstain"),
     ["Abstention explanation confidence must be low.",
      "Abstention explanation must not contain likely causes."]),
    (explanation(likely_causes=cause("Loss matters.", "loss", "prediction_probability")), {},
     ["Cause 1 cites unknown evidence key: loss", "Cause 1 cites non-causal evidence key: loss",
      "Cause 1 cites non-causal evidence key: prediction_probability"]),
    (explanation(likely_causes=cause("The capacity margin is -0.7 Mbps.", "throughput_mbps")), {},
     ["Cause 1 attributes a claim to capacity_margin_mbps without citing it.",
      "Cause 1 number -0.7 is not supported by its cited evidence keys."]),
    (explanation(likely_causes=cause("It is 5.3 Gbps.", "throughput_mbps")), {},
     ["Cause 1 uses unit Gbps for incompatible cited evidence."]),
    (explanation(), dict(prediction="maybe"), ["Invalid or missing evidence prediction: 'maybe'"]),
    (explanation(), dict(trust_level=None), ["Invalid or missing evidence trust_level: None"]),
    (explanation(summary="MOS is 2.1."), dict(current_mos=None),
     ["Unsupported number: 2.1", "Claim cites unavailable evidence field: current_mos"]),
]
SCHEMA_CASES = [
    ("{broken", ["Schema validation: Input should be a valid dictionary or instance of Explanation"]),
    (None, ["Schema validation: Input should be a valid dictionary or instance of Explanation"]),
    (explanation(summary="   "), ["Schema validation at summary: String should have at least 1 character"]),
    (explanation(summary="x" * 801), ["Schema validation at summary: String should have at most 800 characters"]),
    (explanation(summary=5), ["Schema validation at summary: Input should be a valid string"]),
    (explanation(limitations=...), ["Schema validation at limitations: Field required"]),
    (explanation(confidence="sure"), ["Schema validation at confidence: Input should be 'low', 'medium' or 'high'"]),
    (explanation(prediction=1),
     ["Schema validation at prediction: Input should be 'future_poor_qoe', 'future_acceptable_qoe' or 'abstain'"]),
    (explanation(note="x"), ["Schema validation at note: Extra inputs are not permitted"]),
    (explanation(likely_causes=[]),
     ["Schema validation: Value error, Empty likely_causes requires an explicit 'insufficient evidence' statement."]),
    (explanation(likely_causes="none"), ["Schema validation at likely_causes: Input should be a valid list"]),
    (explanation(likely_causes=cause("a", "plr_percent") * 6),
     ["Schema validation at likely_causes: List should have at most 5 items after validation, not 6"]),
    (explanation(likely_causes=["text"]),
     ["Schema validation at likely_causes.0: Input should be a valid dictionary or instance of LikelyCause"]),
    (explanation(likely_causes=cause("a", "plr_percent", " plr_percent ")),
     ["Schema validation at likely_causes.0.evidence_keys: Value error, Evidence keys must be unique within a cause."]),
    (explanation(likely_causes=cause("a")),
     ["Schema validation at likely_causes.0.evidence_keys: List should have at least 1 item after validation, not 0"]),
    (explanation(likely_causes=cause(" ", " ")),
     ["Schema validation at likely_causes.0.statement: String should have at least 1 character",
      "Schema validation at likely_causes.0.evidence_keys: Value error, At least one evidence key is required."]),
    (explanation(likely_causes=[dict(statement="a", evidence_keys=["plr_percent"], weight=1)]),
     ["Schema validation at likely_causes.0.weight: Extra inputs are not permitted"]),
    (explanation(recommended_operator_checks=[" "]),
     ["Schema validation at recommended_operator_checks: Value error, At least one non-empty item is required."]),
    (explanation(recommended_operator_checks=["a", 2]),
     ["Schema validation at recommended_operator_checks.1: Input should be a valid string"]),
]


def test_grounding(spark):
    got = run(spark, [(x, ev) for x, ev, _ in GROUNDING])
    for (x, ev, want), (valid, grounded, errors) in zip(GROUNDING, got):
        assert valid, (x, errors)
        assert errors == want, x
        assert grounded == (not want)


def test_schema(spark):
    got = run(spark, [(x, {}) for x, _ in SCHEMA_CASES])
    for (x, want), (valid, grounded, errors) in zip(SCHEMA_CASES, got):
        assert not valid and grounded is None
        assert errors == want, x


def test_prompt(spark):
    df = spark.createDataFrame([(json.dumps(EVIDENCE),)], "ev string")
    prompt = df.select(explain.build_prompt(F.from_json("ev", SCHEMA)).alias("p")).first().p
    block = json.dumps(EVIDENCE, indent=2, sort_keys=True)
    assert f"\nEvidence:\n{block}\n\nReturn ONLY this JSON schema:\n" in prompt
    template = json.loads(prompt[prompt.rindex("\n{\n"):])
    assert template["confidence"] == "medium" and template["prediction"] == "future_poor_qoe"


@pytest.mark.parametrize("change", [dict(prediction="maybe"), dict(trust_level=None)])
def test_prompt_refuses(spark, change):
    df = spark.createDataFrame([(json.dumps({**EVIDENCE, **change}),)], "ev string")
    with pytest.raises(Exception, match="evidence"):
        df.select(explain.build_prompt(F.from_json("ev", SCHEMA)).alias("p")).collect()


def test_numbers_of_any_length_and_script(spark):
    known = F.map_from_entries(F.array(F.struct(F.lit("a"), text.exact_number(F.lit("1.50")))))
    cases = [
        ("value 123456789012345678901234567890123456789012 seen", ["123456789012345678901234567890123456789012"]),
        ("value 1.50000000000000000000000000000000000000001 seen", ["1.50000000000000000000000000000000000000001"]),
        ("value 01.5000 and 1.5 seen", []),
        ("value \u0661.\u0665 seen", []),
        ("value \u0667 and 7 seen", ["\u0667"]),
        ("-0 and 0.0", ["-0"]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s string")
    got = {r.i: r.e for r in df.select("i", explain.number_errors(known, F.col("s")).alias("e")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == [f"Unsupported number: {w}" for w in want], cases[i]


def test_large_sheets_are_stored_small(spark, tmp_path):
    """Shared prompt text must not be stored anew for each row, and all cells come back as they were."""
    from steadycast.operators.reviews import REVIEW_COLUMNS
    from steadycast.plans import source_queries
    from steadycast.sources import records

    prompt = F.concat(F.lit(explain.PROMPT_RULES + '"quoted", \n'), F.col("id").cast("string"), F.lit("  "))
    sheet = spark.range(500).select(*[(prompt if c == "prompt" else F.concat(F.lit(c), "id")).alias(c) for c in REVIEW_COLUMNS])
    size = {}
    for kind in ("none", "gzip"):
        path = f"{tmp_path}/{kind}"
        records.write_review_csv(sheet, path, kind)
        size[kind] = sum(f.stat().st_size for f in (tmp_path / kind).glob("part-*"))
        assert sorted(records.read_review_csv(spark, path).collect()) == sorted(sheet.collect())
    assert size["gzip"] * 5 < size["none"]
    assert "gzip" in source_queries.review_csv.__code__.co_consts


def test_messages_and_numbers_are_generated_code(spark):
    """A lambda in them would leave every condition of a row to the interpreter."""
    df = spark.createDataFrame([(0, json.dumps(EVIDENCE)), (1, "{}")], "i int, e string").repartition(1)
    df = df.withColumn("e", F.from_json("e", SCHEMA)).localCheckpoint()
    told = text.messages(text.message_if(F.col("i") == 0, "a"), text.message_if(F.col("i") >= 0, "a", "b"), text.message_if(F.col("i") > 5, "c"), F.lit(None))
    out = df.select("i", told.alias("m"), explain.evidence_numbers(F.col("e")).alias("n"))
    assert "*(1) Project" in out._jdf.queryExecution().executedPlan().toString()
    first, second = out.orderBy("i").collect()
    assert (first.m, second.m) == (["a", "ab"], ["ab"])
    wanted = dict(prediction_probability="0.81", trust_score="0.72", current_mos="2.1", throughput_mbps="5.3", bitrate_kbps="6000", capacity_margin_mbps="-0.7", throughput_to_bitrate_ratio="0.88", plr_percent="2.4")
    assert first.n == wanted and second.n == {}


@pytest.mark.parametrize("number", ["0", "-0.5", "100", "1200.050", "-0.000000000000000001", "0.000001"])
def test_digits_of_decimals(spark, number):
    value = F.lit(number).cast(text.EVIDENCE)
    row = spark.range(1).select(text.exact_decimal(value).alias("a"), text.exact_number(value.cast("string")).alias("b")).first()
    assert row.a == row.b
