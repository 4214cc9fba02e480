"""Prompts for explanations, and checks of explanations against the evidence.

Each check is a column holding an array of messages, so a whole batch is checked by one
projection without a shuffle. An explanation is JSON text; the evidence is a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadycast.functions import text as t
from steadycast.operators.ranks import numbered
from steadycast.operators.reshape import EVIDENCE_FIELDS, evidence
from steadycast.operators.sampling import ABSTENTION, ACCEPTABLE, POOR
from steadycast.params import ROW_KEY

NUMERIC_FIELDS = [f for f in EVIDENCE_FIELDS if f not in ("prediction", "trust_level")]

# The prompt text.
PROMPT_RULES = """You are a senior 5G network engineer.

Rules:
- Use only the supplied evidence.
- prediction_probability is the calibrated probability of poor QoE at the next
  observation. It is not an observed outcome.
- trust_score is a heuristic reliability score, not a probability of correctness.
- Never invent numbers, fields, units, causes, future measurements, or timing.
- Every likely cause must cite one or more exact evidence keys in evidence_keys.
- Optional supported-cause item shape: {statement, evidence_keys}.
- For a non-abstained decision, confidence must equal the supplied trust_level.
- If the evidence supports no cause, use an empty likely_causes list and write
  "insufficient evidence" in the summary or limitations.
- Return only valid JSON.
"""
PROMPT_TASK = {
    "future_poor_qoe": (
        "Explain the model's next-observation poor-QoE forecast. Do not claim "
        "that degradation has already occurred or that its onset time is known."
    ),
    "future_acceptable_qoe": (
        "Explain the model's next-observation acceptable-QoE forecast. Do not "
        "describe this decision as a degradation or poor-QoE forecast."
    ),
    "abstain": (
        "Explain why the system withheld a prediction. Set confidence to low and "
        "likely_causes to an empty list; do not present a confident causal diagnosis."
    ),
}
PROMPT_SUMMARY = {
    "future_poor_qoe": "The model forecasts poor QoE at the next observation.",
    "future_acceptable_qoe": "The model forecasts acceptable QoE at the next observation.",
    "abstain": "The system abstains because reliability is insufficient.",
}
PROMPT_CHECK = "Review the cited operational evidence."
PROMPT_LIMITATION = "Insufficient evidence supports a specific cause."


def _by_decision(decision: Column, values: dict[str, str]) -> Column:
    column = None
    for name, value in values.items():
        here = decision == name
        column = F.when(here, value) if column is None else column.when(here, value)
    return column


def evidence_lines(e: Column) -> Column:
    """The evidence as indented JSON with sorted keys."""
    lines = []
    for name in sorted(EVIDENCE_FIELDS):
        value = e[name]
        if name in ("prediction", "trust_level"):
            shown = F.concat(F.lit('"'), value, F.lit('"'))
        elif name == "bitrate_kbps":
            shown = value.cast("string")
        else:
            shown = t.number_text(value)
        lines.append(F.concat(F.lit(f'  "{name}": '), F.coalesce(shown, F.lit("null"))))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def build_prompt(e: Column) -> Column:
    """Prompt for one decision; an unknown decision or a missing level stops the job."""
    decision, level = e["prediction"], e["trust_level"]
    known = t.contains_any(decision, t.DECISIONS)
    levelled = (decision == "abstain") | t.contains_any(level, t.LEVELS)
    confidence = F.when(decision == "abstain", "low").otherwise(level)
    prompt = F.concat(
        F.lit(PROMPT_RULES + "\nDecision-specific task:\n"),
        _by_decision(decision, PROMPT_TASK),
        F.lit("\n\nEvidence:\n"),
        evidence_lines(e),
        F.lit('\n\nReturn ONLY this JSON schema:\n\n{\n  "prediction": "'),
        decision,
        F.lit('",\n  "confidence": "'),
        confidence,
        F.lit('",\n  "summary": "'),
        _by_decision(decision, PROMPT_SUMMARY),
        F.lit(
            '",\n  "likely_causes": [],\n  "recommended_operator_checks": ["'
            + PROMPT_CHECK + '"],\n  "limitations": "' + PROMPT_LIMITATION + '"\n}\n'
        ),
    )
    return (
        F.when(~known, F.raise_error(F.lit("unknown evidence prediction")))
        .when(~levelled, F.raise_error(F.lit("evidence needs trust_level low, medium or high")))
        .otherwise(prompt)
    )


def prompt_records(sample: DataFrame, probability: str = "calibrated_probability") -> DataFrame:
    """Numbered prompt records of a review sample, with an empty explanation.

    Rows are numbered by category and row key, in ranges, so a sample may have any size.
    """
    place = F.when(F.col("category") == POOR, 1).when(F.col("category") == ACCEPTABLE, 2)
    place = place.when(F.col("category") == ABSTENTION, 3)
    e = F.col("evidence")
    rows = sample.withColumns({"evidence": evidence(probability), "__place": place})
    return (
        numbered(rows, ["__place", *ROW_KEY], "__n")
        .select(
            F.format_string("case_%03d", "__n").alias("case_id"),
            "category", "session_id", "user_id", "timestamp",
            e["prediction"].alias("prediction"),
            e["prediction_probability"].alias("probability"),
            e["trust_score"].alias("trust_score"),
            "abstain", "evidence",
            build_prompt(e).alias("prompt"),
            F.lit(None).cast("string").alias("explanation"),
        )
    )


# ---- schema ---------------------------------------------------------------------------

# Fields in order, and bounds on lengths.
FIELDS = (
    "prediction", "confidence", "summary", "likely_causes", "recommended_operator_checks",
    "limitations",
)
CAUSE_FIELDS = ("statement", "evidence_keys")
TEXT_LIMITS = {"summary": 800, "limitations": 500}
STATEMENT_LIMIT, LIST_LIMIT = 400, 5
NO_EVIDENCE = "insufficient evidence"


ARRAY = "array<variant>"
NO_MESSAGES = "array<string>"


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _value(v: Column) -> Column:
    """One JSON value with its type name, its text and its length, each worked out once."""
    kind = F.schema_of_variant(v)
    text = F.when(kind == "STRING", t.trimmed(_get(v, "$", "string")))
    return F.struct(kind.alias("kind"), text.alias("text"))


def _items(v: Column) -> Column:
    """A JSON list with its type name and its string items (null for other types)."""
    kind = F.schema_of_variant(v)
    items = F.transform(
        _get(v, "$", ARRAY),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", t.trimmed(_get(x, "$", "string"))),
    )
    return F.struct(kind.alias("kind"), items.alias("items"))


def _cause(v: Column) -> Column:
    """One cause with its checked parts."""
    keys = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*[F.lit(c) for c in CAUSE_FIELDS]))
    return F.struct(
        F.schema_of_variant(v).alias("kind"),
        _value(_get(v, "$.statement")).alias("statement"),
        _items(_get(v, "$.evidence_keys")).alias("evidence_keys"),
        keys.alias("extra"),
    )


def _text_errors(head: Column, value: Column, limit: int) -> list[Column]:
    """Missing, not a string, too short or too long."""
    kind, length = value["kind"], F.length(value["text"])
    return [
        t.message_if(kind.isNull(), head, "Field required"),
        t.message_if(kind.isNotNull() & (kind != "STRING"), head, "Input should be a valid string"),
        t.message_if(length < 1, head, "String should have at least 1 character"),
        t.message_if(length > limit, head, f"String should have at most {limit} characters"),
    ]


def _choice_errors(head: Column, value: Column, raw: Column, choices: tuple[str, ...]) -> list[Column]:
    """Missing, or not one of the choices exactly."""
    listed = ", ".join(f"'{c}'" for c in choices[:-1]) + f" or '{choices[-1]}'"
    chosen = (value["kind"] == "STRING") & t.contains_any(raw, choices)
    return [
        t.message_if(value["kind"].isNull(), head, "Field required"),
        t.message_if(value["kind"].isNotNull() & ~chosen, head, f"Input should be {listed}"),
    ]


def _list_errors(head: Column, kind: Column, size: Column, least: int) -> tuple[list[Column], Column]:
    """Errors of a list as a whole, and whether its type and size are right."""
    is_list = kind.startswith("ARRAY")
    n = size.cast("string")
    errors = [
        t.message_if(kind.isNull(), head, "Field required"),
        t.message_if(kind.isNotNull() & ~is_list, head, "Input should be a valid list"),
        t.message_if(
            is_list & (size > LIST_LIMIT), head,
            f"List should have at most {LIST_LIMIT} items after validation, not ", n,
        ),
        t.message_if(
            is_list & (size < least), head,
            f"List should have at least {least} item after validation, not ", n,
        ),
    ]
    return errors, is_list & (size >= least) & (size <= LIST_LIMIT)


def _nothing() -> Column:
    return F.array().cast(NO_MESSAGES)


def _string_list_errors(head: Column, place: Column, value: Column, blank: str, unique: str | None) -> Column:
    """Errors of a list of strings; blank items are dropped before the last two checks."""
    items = value["items"]
    whole, sized = _list_errors(head, value["kind"], F.size(items), 1)
    marked = F.transform(
        items,
        lambda x, i: F.when(
            x.isNull(),
            F.concat(
                F.lit("Schema validation at "), place, F.lit("."), i.cast("string"),
                F.lit(": Input should be a valid string"),
            ),
        ),
    )
    wrong = F.array_compact(marked)
    clean = without_blanks(items)
    typed = sized & ~F.exists(items, lambda x: x.isNull())
    last = [t.message_if(typed & (F.size(clean) == 0), head, f"Value error, {blank}")]
    if unique:
        repeated = F.size(F.array_distinct(clean)) < F.size(clean)
        last.append(t.message_if(typed & repeated, head, f"Value error, {unique}"))
    return F.concat(
        t.messages(*whole), F.coalesce(F.when(sized, wrong), _nothing()), t.messages(*last)
    )


def without_blanks(items: Column) -> Column:
    return F.filter(items, lambda s: s != "")


def _extra_errors(place: Column, extra: Column) -> Column:
    return F.coalesce(
        F.transform(
            extra,
            lambda k: F.concat(
                F.lit("Schema validation at "), place, k, F.lit(": Extra inputs are not permitted")
            ),
        ),
        _nothing(),
    )


def _head(place: Column | str) -> Column:
    place = place if isinstance(place, Column) else F.lit(place)
    return F.concat(F.lit("Schema validation at "), place, F.lit(": "))


def _cause_errors(cause: Column, i: Column) -> Column:
    where = F.concat(F.lit("likely_causes."), i.cast("string"))
    key_place = F.concat(where, F.lit(".evidence_keys"))
    inside = F.concat(
        t.messages(
            *_text_errors(_head(F.concat(where, F.lit(".statement"))), cause["statement"], STATEMENT_LIMIT)
        ),
        _string_list_errors(
            _head(key_place), key_place, cause["evidence_keys"],
            "At least one evidence key is required.",
            "Evidence keys must be unique within a cause.",
        ),
        _extra_errors(F.concat(where, F.lit(".")), cause["extra"]),
    )
    wrong = F.array(
        F.concat(_head(where), F.lit("Input should be a valid dictionary or instance of LikelyCause"))
    )
    is_object = F.coalesce(cause["kind"], F.lit("VOID")).startswith("OBJECT")
    return F.when(is_object, inside).otherwise(wrong)


def with_schema_check(df: DataFrame, explanation: str = "explanation") -> DataFrame:
    """Add ``schema_errors`` and, where it is empty, the cleaned explanation ``__x``.

    The parts of the JSON are taken out in one projection and checked in the next, so each
    is parsed once per row.
    """
    v = F.col("__v")
    extra = F.array_except(F.json_object_keys(explanation), F.array(*[F.lit(f) for f in FIELDS]))
    parts = df.withColumn("__v", F.try_parse_json(explanation)).withColumns(
        {
            "__kind": F.coalesce(F.schema_of_variant(v), F.lit("VOID")),
            "__extra": extra,
            "__prediction": _value(_get(v, "$.prediction")),
            "__confidence": _value(_get(v, "$.confidence")),
            "__raw_prediction": _get(v, "$.prediction", "string"),
            "__raw_confidence": _get(v, "$.confidence", "string"),
            "__summary": _value(_get(v, "$.summary")),
            "__limitations": _value(_get(v, "$.limitations")),
            "__checks": _items(_get(v, "$.recommended_operator_checks")),
            "__causes_kind": F.schema_of_variant(_get(v, "$.likely_causes")),
            "__causes": F.transform(_get(v, "$.likely_causes", ARRAY), _cause),
        }
    )
    causes = F.col("__causes")
    whole, sized = _list_errors(_head("likely_causes"), F.col("__causes_kind"), F.size(causes), 0)
    per_cause = t.flat(F.transform(causes, _cause_errors))
    fields = F.concat(
        t.messages(
            *_choice_errors(_head("prediction"), F.col("__prediction"), F.col("__raw_prediction"), t.DECISIONS)
        ),
        t.messages(
            *_choice_errors(_head("confidence"), F.col("__confidence"), F.col("__raw_confidence"), t.LEVELS)
        ),
        t.messages(*_text_errors(_head("summary"), F.col("__summary"), TEXT_LIMITS["summary"])),
        t.messages(*whole),
        F.coalesce(F.when(sized, per_cause), _nothing()),
        _string_list_errors(
            _head("recommended_operator_checks"), F.lit("recommended_operator_checks"), F.col("__checks"),
            "At least one non-empty item is required.", None,
        ),
        t.messages(*_text_errors(_head("limitations"), F.col("__limitations"), TEXT_LIMITS["limitations"])),
        _extra_errors(F.lit(""), F.col("__extra")),
    )
    said = F.lower(F.concat_ws(" ", "__summary.text", "__limitations.text")).contains(NO_EVIDENCE)
    closing = t.message_if(
        (F.size("__fields") == 0) & (F.size(causes) == 0) & ~said,
        "Schema validation: Value error, Empty likely_causes requires an explicit "
        "'insufficient evidence' statement.",
    )
    not_object = F.array(
        F.lit("Schema validation: Input should be a valid dictionary or instance of Explanation")
    )
    checked = parts.withColumn("__fields", fields).withColumn(
        "schema_errors",
        F.when(F.col("__kind").startswith("OBJECT"), F.concat(F.col("__fields"), t.messages(closing)))
        .otherwise(not_object),
    )
    cleaned = F.struct(
        F.col("__raw_prediction").alias("prediction"),
        F.col("__raw_confidence").alias("confidence"),
        F.col("__summary.text").alias("summary"),
        F.transform(
            causes,
            lambda c: F.struct(
                c["statement"]["text"].alias("statement"),
                without_blanks(c["evidence_keys"]["items"]).alias("evidence_keys"),
            ),
        ).alias("likely_causes"),
        without_blanks(F.col("__checks.items")).alias("recommended_operator_checks"),
        F.col("__limitations.text").alias("limitations"),
    )
    return checked.withColumn("__x", F.when(F.size("schema_errors") == 0, cleaned)).drop(
        "__v", "__kind", "__extra", "__prediction", "__confidence", "__raw_prediction",
        "__raw_confidence", "__summary", "__limitations", "__checks", "__causes_kind", "__causes",
        "__fields",
    )


# ---- grounding ------------------------------------------------------------------------


def narrative(x: Column) -> Column:
    """Summary, statements, checks and limitations as one text."""
    statements = F.transform(x["likely_causes"], lambda c: c["statement"])
    return F.concat_ws(" ", x["summary"], statements, x["recommended_operator_checks"], x["limitations"])


def evidence_numbers(e: Column) -> Column:
    """Numeric evidence as a map of exact decimals, null values left out."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = []
    for f in NUMERIC_FIELDS:
        value = t.exact_decimal(e[f].cast(t.EVIDENCE))
        entries.append(F.when(value.isNotNull(), F.array(F.struct(F.lit(f).alias("key"), value.alias("value")))).otherwise(none))
    return F.map_from_entries(F.concat(none, *entries))


def content_errors(x: Column) -> Column:
    """Blank parts, and no causes without saying that evidence is insufficient."""
    said = F.lower(F.concat_ws(" ", x["summary"], x["limitations"])).contains(NO_EVIDENCE)
    return t.messages(
        *[t.message_if(t.trimmed(x[n]) == "", f"Missing {n}") for n in ("summary", "confidence", "prediction")],
        t.message_if(
            (F.size(x["likely_causes"]) == 0) & ~said,
            "Empty likely_causes requires an explicit insufficient-evidence statement.",
        ),
    )


def decision_errors(x: Column, e: Column, text: Column) -> Column:
    """Agreement of decision, confidence, wording and abstention rules."""
    decision, level = e["prediction"], e["trust_level"]
    known = t.contains_any(decision, t.DECISIONS)
    levelled = t.contains_any(level, t.LEVELS)
    upper = F.upper(text)
    negated = t.holds(upper, ("NOT", "'T", "’T"))
    polarity = F.when(negated, F.regexp_replace(text, t.ANY_CASE + t.NEGATED_FORECAST, "")).otherwise(text)
    forecast = t.holds(upper, ("QOE", "DEGRADATION"))
    decided = decision != "abstain"
    checks = t.messages(
        t.message_if(
            x["prediction"] != decision,
            "Explanation prediction contradicts evidence prediction: ",
            t.quoted(x["prediction"]), " != ", t.quoted(decision), ".",
        ),
        t.message_if(decided & ~levelled, "Invalid or missing evidence trust_level: ", t.quoted(level)),
        t.message_if(
            decided & levelled & (x["confidence"] != level),
            "Explanation confidence contradicts evidence trust_level: ",
            t.quoted(x["confidence"]), " != ", t.quoted(level), ".",
        ),
        t.message_if(
            (decision == "future_acceptable_qoe") & forecast & polarity.rlike(t.ANY_CASE + t.SAYS_POOR),
            "Acceptable-QoE prediction is described as a degradation forecast.",
        ),
        t.message_if(
            (decision == "future_poor_qoe") & forecast & polarity.rlike(t.ANY_CASE + t.SAYS_ACCEPTABLE),
            "Poor-QoE prediction is described as acceptable QoE.",
        ),
        t.message_if(~decided & (x["confidence"] != "low"), "Abstention explanation confidence must be low."),
        t.message_if(
            ~decided & (F.size(x["likely_causes"]) > 0),
            "Abstention explanation must not contain likely causes.",
        ),
    )
    unknown = F.array(F.concat(F.lit("Invalid or missing evidence prediction: "), t.quoted(decision)))
    return F.when(known, checks).otherwise(unknown)


def number_errors(numbers: Column, text: Column) -> Column:
    """Numbers of the text that equal no evidence number: once each, by value."""
    known = F.map_values(numbers)
    found = F.transform(
        t.all_matches(text, t.NUMBER_TOKEN, 1),
        lambda s: F.struct(t.exact_number(s).alias("v"), s.alias("s")),
    )
    stray = F.filter(found, lambda p: ~F.coalesce(F.array_contains(known, p["v"]), F.lit(False)))
    values = F.transform(stray, lambda p: p["v"])
    once = F.filter(
        stray, lambda p, i: F.coalesce(F.array_position(values, p["v"]), F.lit(0)) == i + 1
    )
    return F.transform(F.array_sort(once), lambda p: F.concat(F.lit("Unsupported number: "), p["s"]))


def _claim_check(pair: Column, field: str, expected: Column) -> Column:
    value = t.exact_number(pair["n"])
    return t.messages(
        t.message_if(expected.isNull(), f"Claim cites unavailable evidence field: {field}"),
        t.message_if(
            expected.isNotNull() & ~value.eqNullSafe(expected),
            "Claimed value ", pair["n"], f" is not the value of {field}.",
        ),
        t.message_if(
            (pair["u"] != "") & ~t.contains_any(t.normal_unit(pair["u"]), t.FIELD_UNITS[field]),
            f"Wrong unit for {field}: ", pair["u"],
        ),
    )


def _number_unit_pairs(text: Column, pattern: str) -> Column:
    """Number and unit of every match: the text is searched once per pattern."""
    whole = t.all_matches(text, pattern, 0)
    return F.transform(
        whole,
        lambda m: F.struct(
            F.regexp_extract(m, t.LAST_NUMBER, 1).alias("n"), F.regexp_extract(m, t.LAST_NUMBER, 2).alias("u")
        ),
    )


def claim_errors(numbers: Column, text: Column) -> Column:
    """'<field> is <number> <unit>' must give the evidence value and an allowed unit."""
    found = []
    for field in t.FIELD_UNITS:
        pairs = F.when(
            t.holds(F.upper(text), t.FIELD_WORDS[field]), _number_unit_pairs(text, t.claim_pattern(field))
        )
        found.append(t.flat(F.transform(pairs, lambda p: _claim_check(p, field, numbers[field]))))
    return t.joined(found)


def cause_errors(x: Column, numbers: Column) -> Column:
    """Citations, mentions, numbers and units of every cause."""
    causal = F.array(*[F.lit(f) for f in t.FIELD_UNITS])
    every = F.array(*[F.lit(f) for f in EVIDENCE_FIELDS])
    unit_pairs = [(f, u) for f, units in t.FIELD_UNITS.items() for u in units]
    fitting = F.array(*[F.lit(f"{f}|{u}") for f, u in unit_pairs])

    def check(cause: Column, i: Column) -> Column:
        head = F.concat(F.lit("Cause "), (i + 1).cast("string"))
        keys, statement = cause["evidence_keys"], cause["statement"]
        cited = F.map_filter(numbers, lambda k, v: F.array_contains(keys, k))

        def listed(found: Column, words: str) -> Column:
            return F.transform(F.array_sort(F.array_distinct(found)), lambda k: F.concat(head, F.lit(words), k))

        mentions = t.messages(
            *[
                t.message_if(
                    t.holds(F.upper(statement), t.FIELD_WORDS[field])
                    & statement.rlike(t.ANY_CASE + pattern) & ~F.array_contains(keys, field),
                    head, f" attributes a claim to {field} without citing it.",
                )
                for field, pattern in t.FIELD_MENTIONS.items()
            ]
        )
        stray = F.filter(
            t.all_matches(statement, t.NUMBER_TOKEN, 1),
            lambda s: ~F.coalesce(F.array_contains(F.map_values(cited), t.exact_number(s)), F.lit(False)),
        )
        pairs = _number_unit_pairs(statement, t.NUMBER_UNIT)

        def misfit(p: Column) -> Column:
            holders = F.map_keys(F.map_filter(cited, lambda k, v: v == t.exact_number(p["n"])))
            fits = F.exists(
                holders,
                lambda k: F.array_contains(fitting, F.concat(k, F.lit("|"), t.normal_unit(p["u"]))),
            )
            return (F.size(holders) > 0) & ~fits

        units = F.transform(
            F.filter(pairs, misfit),
            lambda p: F.concat(head, F.lit(" uses unit "), p["u"], F.lit(" for incompatible cited evidence.")),
        )
        return F.concat(
            listed(F.array_except(keys, every), " cites unknown evidence key: "),
            listed(F.array_except(keys, causal), " cites non-causal evidence key: "),
            mentions,
            F.transform(
                stray,
                lambda s: F.concat(head, F.lit(" number "), s, F.lit(" is not supported by its cited evidence keys.")),
            ),
            units,
        )

    return t.flat(F.transform(x["likely_causes"], check))


def validate(df: DataFrame, explanation: str = "explanation", evidence_column: str = "evidence") -> DataFrame:
    """Add schema and grounding verdicts and all messages to a batch of cases.

    Adds ``schema_valid``, ``grounded`` (null when the schema failed) and ``errors``.
    """
    e = F.col(evidence_column)
    out = with_schema_check(df, explanation)
    out = out.withColumn("schema_valid", F.size("schema_errors") == 0)
    out = out.withColumns({"__text": narrative(F.col("__x")), "__numbers": evidence_numbers(e)})
    x, text, numbers = F.col("__x"), F.col("__text"), F.col("__numbers")
    grounding = F.concat(
        content_errors(x),
        decision_errors(x, e, text),
        number_errors(numbers, text),
        claim_errors(numbers, text),
        cause_errors(x, numbers),
    )
    out = out.withColumn("errors", F.when(F.col("schema_valid"), grounding).otherwise(F.col("schema_errors")))
    out = out.withColumn("grounded", F.when(F.col("schema_valid"), F.size("errors") == 0))
    return out.drop("schema_errors", "__x", "__text", "__numbers")


def explanation_log(validated: DataFrame) -> DataFrame:
    """Flat log: one row per case with JSON columns and a status."""
    accepted = F.coalesce(F.col("grounded"), F.lit(False))
    return validated.select(
        "case_id", F.to_json("evidence").alias("evidence_json"),
        F.col("explanation").alias("explanation_json"),
        F.to_json("errors").alias("validation_errors"),
        F.when(accepted, "accepted").otherwise("rejected").alias("status"),
    )


def batch_metrics(validated: DataFrame, latency: str | None = None) -> DataFrame:
    """Schema, grounding and acceptance counts and rates, and latency."""
    accepted = F.coalesce(F.col("grounded"), F.lit(False))
    columns = [
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if("schema_valid").alias("schema_valid_cases"),
        F.count_if(accepted).alias("grounding_valid_cases"),
        F.count_if(~accepted).alias("rejected_cases"),
        F.avg(F.col("schema_valid").cast("double")).alias("schema_valid_rate"),
        F.avg(accepted.cast("double")).alias("grounding_valid_rate"),
    ]
    if latency:
        columns.append(F.avg(latency).alias("mean_latency_seconds"))
    stats = validated.agg(*columns)
    if not latency:
        return stats
    from steadycast.operators.profiles import with_quantiles

    return with_quantiles(stats, validated, latency, {"median_latency_seconds": 0.5})
