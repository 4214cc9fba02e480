"""Contracts, reconciliation, lineage, sources and hooks on small damaged inputs."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from steadycast.operators import hooks, lineage, quality, reconcile, reshape, reviews
from steadycast.operators.metrics import assert_empty
from steadycast.sources import records, scenario, tables

T0 = datetime(2024, 1, 1)


def sample(spark, drop=(), repeat=()):
    rows = []
    for i, mos in enumerate([4.0, 2.999, 3.0, 3.001]):
        for bitrate, resolution in ((2000, "720p"), (4000, "1080p")):
            row = (1, "Driver", 5, 7, T0 + timedelta(seconds=10 * i), bitrate, resolution, 10.0 + i, i + bitrate / 1000, mos)
            if (i, bitrate) in drop:
                continue
            rows += [row] * (2 if (i, bitrate) in repeat else 1)
    return spark.createDataFrame(
        rows,
        "base_station long, mobility string, prb long, user_id long, timestamp timestamp_ntz, bitrate_kbps long, "
        "resolution string, throughput_mbps double, plr_percent double, current_mos double",
    )


KEY = ["base_station", "mobility", "prb", "user_id", "timestamp", "bitrate_kbps"]


def test_key_contract(spark):
    clean = quality.key_contract(sample(spark), KEY).first()
    assert (clean.rows, clean.duplicate_keys, clean.null_key_rows) == (8, 0, 0)
    bad = quality.key_contract(sample(spark, repeat=[(1, 2000)]), KEY).first()
    assert (bad.duplicate_keys, bad.surplus_rows) == (1, 1)
    with pytest.raises(ValueError, match="repeated"):
        assert_empty(quality.duplicate_keys(sample(spark, repeat=[(1, 2000)]), KEY), "repeated")


def test_siblings_and_domain(spark):
    assert quality.missing_siblings(sample(spark), 2).isEmpty()
    assert quality.missing_siblings(sample(spark, drop=[(2, 4000)]), 2).count() == 1
    wrong = sample(spark).withColumn("resolution", F.lit("720p"))
    got = {r.bitrate_kbps: r.outside_domain for r in quality.bitrate_domain(wrong).collect()}
    assert got == {2000: 0, 4000: 4}


def test_boundary_values(spark):
    r = quality.boundary_values(sample(spark), "current_mos", [2.999, 3.0, 3.001]).first()
    assert (r.equal_2_999, r.equal_3_000, r.equal_3_001) == (2, 2, 2)


def test_schema_differences(spark):
    df = sample(spark)
    assert quality.schema_differences(df, df.schema) == []
    changed = StructType([StructField("prb", StringType()) if f.name == "prb" else f for f in df.schema])
    assert len(quality.schema_differences(df, changed)) == 1


def test_source_reconciliation(spark):
    rows = sample(spark)
    source = sample(spark, drop=[(0, 2000)], repeat=[(1, 2000)]).withColumn(
        "plr_percent", F.when(F.col("throughput_mbps") == 13.0, 99.0).otherwise(F.col("plr_percent"))
    )
    r = reconcile.source_reconciliation(rows, source, KEY, ["throughput_mbps", "plr_percent"]).first()
    assert (r.rows, r.missing, r.ambiguous, r.throughput_mbps_mismatches, r.plr_percent_mismatches) == (8, 1, 1, 0, 2)


def test_one_to_one(spark):
    df = sample(spark)
    assert reconcile.join_one_to_one(df.select(*KEY), df, KEY).count() == 8
    with pytest.raises(ValueError, match="one to one"):
        reconcile.join_one_to_one(df, sample(spark, drop=[(0, 2000)]), KEY)
    with pytest.raises(ValueError, match="one to one"):
        reconcile.join_one_to_one(df, sample(spark, repeat=[(0, 2000)]), KEY)


def test_wide_and_long(spark):
    df = sample(spark)
    keys = [c for c in KEY if c != "bitrate_kbps"] + ["throughput_mbps"]
    wide = reshape.long_to_wide(df, keys, [2000, 4000])
    assert wide.count() == 4
    back = reshape.wide_to_long(wide, [2000, 4000]).select(df.columns)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    with pytest.raises(ValueError, match="MOS_8000kbps"):
        reshape.wide_to_long(wide, [8000])


def test_path_status(spark):
    rows = [
        ("a", "x", "1", True), ("a", "y", "2", True), ("b", "x", "1", True), ("b", "y", "1", True),
        ("c", "x", "1", True), ("d", "x", "1", True), ("d", "y", None, False),
        ("e", "x", "1", True), ("e", "z", "2", True),
    ]
    df = spark.createDataFrame(rows, "path string, source string, value string, available boolean")
    got = {r.path: (r.status, r.missing_sources) for r in lineage.path_status(df, ["x", "y"]).collect()}
    assert got == {
        "a": ("CONFLICT", []), "b": ("CONSISTENT", []), "c": ("BLOCKED_PENDING_ARTIFACTS", ["y"]),
        "d": ("BLOCKED_PENDING_ARTIFACTS", []), "e": ("CONFLICT", ["y"]),
    }


def test_fingerprint(spark):
    df = sample(spark)
    one = lineage.fingerprint(df).first()
    assert one == lineage.fingerprint(df.orderBy(F.rand(1)).repartition(5)).first()
    assert one.content != lineage.fingerprint(df.withColumn("prb", F.lit(6).cast("long"))).first().content


def test_manifest(spark, tmp_path):
    for name, text in (("a.bin", "1"), ("b.bin", "2"), ("c.bin", "3")):
        (tmp_path / name).write_text(text)
    known = lineage.file_manifest(spark, str(tmp_path)).collect()
    expected = spark.createDataFrame([*known[:3], ("d.bin", 1, "x")], "file string, bytes long, sha256 string")
    (tmp_path / "b.bin").write_text("changed")
    (tmp_path / "e.bin").write_text("new")
    got = lineage.manifest_differences(lineage.file_manifest(spark, str(tmp_path)), expected)
    assert {r.file: r.status for r in got.collect()} == {"b.bin": "changed", "d.bin": "missing", "e.bin": "unexpected"}


def scenario_file(folder, name="MOS_BS_3_Driver_PRB_15.tsv", drop=None, time="2024-01-01 00:00:00.5"):
    columns = {
        "User_ID": [7, 8], "Timestamp": [time, "2024-01-01 00:00:08"], "Tput": [12.5, 8.0],
        "Latitude": [44.0, 44.1], "Longitude": [12.0, 12.1], "unused_column": ["a", "b"],
    }
    for b, res in ((2000, "720p"), (4000, "1080p"), (6000, "1080p"), (8000, "1080p")):
        columns[f"{res}_{b}kbps"] = [1.0, "NaN"]
        columns[f"MOS_{b}kbps"] = [2.8, 2.2]
    columns.pop(drop, None)
    lines = ["\t".join(columns)] + ["\t".join(str(v[i]) for v in columns.values()) for i in range(2)]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_scenario_files(spark, tmp_path):
    scenario_file(tmp_path)
    scenario_file(tmp_path, "MOS_BS_1_Driver_PRB_5.tsv")
    df = scenario.read_scenarios(spark, str(tmp_path))
    assert "unused_column" not in df.columns and df.count() == 4
    r = df.where("prb = 15 and User_ID = 7").first()
    assert (r.base_station, r.mobility, r.prb, r.Tput, r.MOS_8000kbps) == (3, "Driver", 15, 12.5, 2.8)
    # NaN is missing, not a large number.
    assert df.where(F.col("1080p_4000kbps").isNull()).count() == 2


def test_scenario_files_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scenario.read_scenarios(spark, str(tmp_path))
    scenario_file(tmp_path, drop="Tput")
    with pytest.raises(ValueError, match="Tput"):
        scenario.read_scenarios(spark, str(tmp_path))
    (tmp_path / "other").mkdir()
    scenario_file(tmp_path / "other", "notes.tsv")
    with pytest.raises(Exception, match="unexpected scenario file name"):
        scenario.read_scenarios(spark, str(tmp_path / "other")).collect()
    (tmp_path / "bad").mkdir()
    scenario_file(tmp_path / "bad", time="soon")
    with pytest.raises(Exception, match="soon"):
        scenario.read_scenarios(spark, str(tmp_path / "bad")).collect()


def test_jsonl(spark, tmp_path):
    schema = StructType([StructField("case_id", StringType()), StructField("n", LongType())])
    path = tmp_path / "r.jsonl"
    path.write_text('{"case_id": "a", "n": 1}\n\n{broken\n[1]\n{"case_id": "b"}\n')
    good, bad = records.read_jsonl_with_rejects(spark, str(path), schema)
    assert sorted((r.case_id, r.n) for r in good.collect()) == [("a", 1), ("b", None)]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "{broken"]
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(path), schema).collect()
    df = spark.createDataFrame([("a", None)], schema)
    records.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert json.loads(text) == {"case_id": "a", "n": None}


def test_review_csv_requires_columns(spark, tmp_path):
    (tmp_path / "s.csv").write_text("case_id,prediction\n1,abstain\n")
    with pytest.raises(ValueError, match="correctness"):
        records.read_review_csv(spark, str(tmp_path / "s.csv"))


def test_feature_table_is_pruned(spark, tmp_path):
    df = sample(spark).withColumns({"split": F.lit("train"), "session_id": F.lit("s")})
    df = df.unionByName(df.withColumn("split", F.lit("test")))
    tables.write_feature_table(df, str(tmp_path / "f"))
    got = tables.read_split(spark, str(tmp_path / "f"), "test", ["session_id", "prb"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 8
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<prb:bigint,session_id:string>" in plan


def reviews_batch(spark, **changes):
    rows, sheet = [], []
    for i in range(30):
        category = ["accepted_poor_qoe", "accepted_acceptable_qoe", "abstention"][i % 3]
        prediction = reviews.CATEGORY_PREDICTION[category]
        evidence, text = json.dumps({"a": i, "b": 2}), json.dumps({"x": 1.0})
        rows.append((f"case_{i:03d}", category, prediction, evidence, "p", text))
        cells = dict(
            case_id=f"case_{i:03d}", prediction=prediction, evidence_json=json.dumps({"b": 2.0, "a": i}), prompt="p",
            explanation_json='{"x":1}', automatic_validation_errors="[]", reviewer_id="r", correctness="1",
            completeness=" TRUE", unsupported_statement_present="0", contradiction_present="false", review_notes="",
        )
        if i == 0:
            cells.update(changes)
        sheet.append(tuple(cells[c] for c in reviews.REVIEW_COLUMNS))
    left = spark.createDataFrame(rows, "case_id string, category string, prediction string, evidence_json string, prompt string, explanation string")
    right = spark.createDataFrame(sheet, ", ".join(f"{c} string" for c in reviews.REVIEW_COLUMNS))
    return left, right


@pytest.mark.parametrize(
    "changes, problem",
    [
        ({}, None),
        ({"correctness": " "}, "correctness is empty"),
        ({"correctness": "yes"}, "correctness is not 0/1 or false/true"),
        ({"prediction": "abstain"}, "review prediction does not match category"),
        ({"evidence_json": "{}"}, "review evidence differs"),
        ({"evidence_json": "{"}, "review evidence differs"),
        ({"prompt": "q"}, "review prompt differs"),
        ({"automatic_validation_errors": '["e"]'}, "review keeps automatic validation errors"),
    ],
)
def test_review_problems(spark, changes, problem):
    got = reviews.review_problems(*reviews_batch(spark, **changes)).collect()
    assert [(r.case_id, r.problems) for r in got] == ([] if problem is None else [("case_000", [problem])])


def test_review_rates(spark):
    left, right = reviews_batch(spark, correctness="0")
    joined = right.join(left.select("case_id", "category"), "case_id")
    got = {r.prediction_category: r for r in reviews.review_table(reviews.review_rates(joined)).collect()}
    assert got["overall"].reviewed_cases == 30 and got["overall"].factual_correctness_rate == "0.9667"
    assert got["accepted_poor_qoe"].factual_correct_cases == 9


def test_user_model_is_checked(spark):
    class Wrong:
        def predict_proba(self, frame):
            return np.full((len(frame), 2), 1.5)

    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(Exception, match="outside"):
        hooks.score_with(df, Wrong(), ["a"], "p").collect()
    with pytest.raises(ValueError, match="missing"):
        hooks.score_with(df, Wrong(), ["b"], "p")


def test_stored_versus_recomputed_reports_one_sided_and_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (5, "x"), (5, "x")], "k int, v string")
    rebuilt = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d"), (5, "x")], "k int, v string")
    r = reconcile.stored_versus_recomputed(stored, rebuilt, ["k"], ["v"]).first()
    assert (r.rows, r.stored_only, r.rebuilt_only, r.repeated, r.v_mismatches) == (3, 0, 1, 1, 1)
    r = reconcile.stored_versus_recomputed(stored.where("k < 3"), rebuilt.where("k = 1"), ["k"], ["v"]).first()
    assert (r.rows, r.stored_only, r.v_mismatches) == (1, 1, 0)


def test_one_to_one_join_rejects_null_keys(spark):
    side = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    with pytest.raises(ValueError, match="null in a key"):
        reconcile.join_one_to_one(side, side.withColumnRenamed("v", "w"), ["k"])


def test_repeated_cases_are_reported_once(spark):
    export = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "case_id string, v int")
    done = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("c", 4), ("d", 5)], "case_id string, v int")
    got = {r.case_id: r.problems for r in reviews.changed_records(export, done, ["v"]).collect()}
    assert got == {
        "b": ["repeated in the export"], "c": ["repeated among the completed", "changed v"], "d": ["not exported"],
    }


def test_failed_calls_keep_their_reason(spark):
    def answer(prompt):
        if prompt == "bad":
            raise KeyError("no answer")
        return prompt.upper()

    df = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    got = {r.prompt: (r.explanation, r.explanation_error) for r in hooks.complete_with(df, answer).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "KeyError: 'no answer'")}


def test_missing_decisions_are_an_error(spark):
    df = spark.createDataFrame([(None, 1), (False, 0)], "abstain boolean, predicted_poor_qoe int")
    with pytest.raises(Exception, match="a decision is missing"):
        df.select(reshape.decision_label()).collect()


def test_comparison_of_large_tables_gets_more_partitions(spark):
    """More rows than the session's shuffle partitions can take are dealt to partitions by their number, with the same result."""
    from steadycast.plans import views

    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert views.tasks_for(spark, at * 100, 100) is None and views.tasks_for(spark, at * 100 + 1, 100) == at + 1
    stored = spark.range(40).selectExpr("id AS k", "CAST(id % 3 AS STRING) AS v", "IF(id = 7, NULL, id) AS w").where("k <> 5")
    rebuilt = spark.range(40).selectExpr("id AS k", "CAST(id % 3 AS STRING) AS v", "IF(id = 9, -1, id) AS w").where("k <> 6")
    rebuilt = rebuilt.unionByName(rebuilt.where("k = 11"))
    few, many = (reconcile.stored_versus_recomputed(stored, rebuilt, ["k"], ["v", "w"], n) for n in (None, at + 1))
    assert few.collect() == many.collect()
    row = many.first()
    assert (row.rows, row.stored_only, row.rebuilt_only, row.repeated, row.v_mismatches, row.w_mismatches) == (37, 1, 1, 1, 0, 2)
    assert f"hashpartitioning(k#" in many._jdf.queryExecution().toString() and f", {at + 1})" in many._jdf.queryExecution().toString()


def test_windows_of_large_tables_get_more_partitions(spark, tmp_path, monkeypatch):
    from steadycast.plans import views

    spark.sql("SELECT id AS event_id, id % 50 AS user_id, timestamp_seconds(id * 1000) AS ts, 1.0D AS value FROM range(2000)").write.parquet(str(tmp_path / "events.parquet"))
    plain = views.labelled(spark, str(tmp_path)).frame.orderBy("event_id", "bitrate_kbps").collect()
    monkeypatch.setattr(views, "tasks_for", lambda spark, rows: rows // 100)
    large = views.labelled(spark, str(tmp_path)).frame
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 20)" in plan
    assert large.orderBy("event_id", "bitrate_kbps").collect() == plain


@pytest.mark.parametrize("whole", [3, 1 << 25])
def test_manifest_holds_no_file_whole(spark, tmp_path, monkeypatch, whole):
    """Files above the bound are hashed as they are read, whatever their ends, marks, names and bytes."""
    import hashlib
    import os

    monkeypatch.setattr(lineage, "WHOLE_BYTES", whole)
    mark = b"\xef\xbb\xbf"
    files = {
        "b": b"x", "c": b"\n", "d": b"one\ntwo", "e": b"one\r\ntwo\n\n", "f": mark + b"text", "g": mark + b"text\n", "h": mark,
        "sub/i j%20+.bin": os.urandom(300_000), "sub/k.bin": os.urandom(70_000) + b"\n", "l.gz": b"not packed\n", "m": b"\xff\x00\r" * 5000, "n": b"\n" * 9,
    }
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {r.file: (r.bytes, r.sha256) for r in lineage.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_cells_of_equal_text_are_not_compared_again(spark):
    cells = ['{"a": 1.0, "b": "x"}', '{"b":"x","a":1}', '{"a": 2}', "[ ]", "[]", "not json", "", "null", None]
    df = spark.createDataFrame([(a, b) for a in cells for b in cells], "l string, r string")
    out = df.select("l", "r", reviews.same_json(F.col("l"), F.col("r")).alias("same"))
    assert "CASE WHEN (l#" in out._jdf.queryExecution().optimizedPlan().toString()
    alike = [{0, 1}, {3, 4}]

    def expected(i, j):
        return cells[i] not in ("not json", "", None) and (i == j or {i, j} in alike)

    got = {(cells.index(r.l), cells.index(r.r)): r.same for r in out.collect()}
    assert got == {(i, j): expected(i, j) for i in range(len(cells)) for j in range(len(cells))}
