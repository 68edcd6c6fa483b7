"""Error paths and edge rows of records, tools, reports, scores and the simulator."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contract, drift, evaluation, inspection, merge, modelling, profile, records, reports, sequence, serving, tools
from tidemark.plans import audits, catalogue
from tidemark.sources import scratch, simulator, tables


def test_mapping_names_what_is_missing(spark):
    rows = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    got = records.mapped(rows, {"b": "y", "a": "x", "c": "z"}, ["x", "y", "z"])
    assert got.columns == ["x", "y", "z"] and tuple(got.first()) == (1, "x", None)
    for mapping, targets, lost in (({"a": "x"}, ["x", "y"], "y"), ({"q": "x"}, ["x"], "q")):
        with pytest.raises(records.MissingField, match=lost):
            records.mapped(rows, mapping, targets)


def test_feature_policy(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, 1)], "id int, f double, leak double, y int")
    assert records.modelling_rows(rows, "id", "source_id", ["f"], "y", ["leak"]).columns == ["source_id", "f", "y"]
    for features in (["f", "leak"], ["y"], ["id"]):
        with pytest.raises(ValueError):
            records.modelling_rows(rows, "id", "source_id", features, "y", ["leak"])
    with pytest.raises(records.MissingField):
        records.modelling_rows(rows, "id", "source_id", ["gone"], "y", [])


def test_writes_refuse_conflicts_and_write_once(spark):
    path = scratch.fresh_path(spark, "records")
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert records.written_once(spark, path, rows, ["k"]) == {"new": 2, "reused": 0}
    assert records.written_once(spark, path, rows, ["k"]) == {"new": 0, "reused": 2}
    for bad in ([(2, "b")], [(7, "x"), (7, "y")]):
        with pytest.raises(merge.MergeConflict):
            records.written_once(spark, path, spark.createDataFrame(bad, "k int, v string"), ["k"])
    assert records.written_once(spark, path, rows.where("false"), ["k"]) == {"new": 0, "reused": 0}
    assert spark.read.parquet(path).count() == 2


def test_concatenation_refuses_repeated_ids(spark):
    rows = spark.range(4)
    assert records.concatenated([rows.where("id < 2"), rows.where("id >= 2")], "id").count() == 4
    with pytest.raises(ValueError):
        records.concatenated([rows, rows.limit(1)], "id")


def test_ids_in_two_splits_are_found(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train"), (3, None)], "id int, split string")
    assert [tuple(r) for r in evaluation.shared_ids(rows, "id").collect()] == [(1, "test,train")]
    split = spark.createDataFrame([(i, "train" if i < 7 else "test") for i in range(10)] + [(0, "test")], "id int, split string")
    got = inspection.split_integrity(split, "id", F.col("id") % 2 == 0, {"train": 0.7, "test": 0.3}, 1.0).collect()
    assert not any(r.holds for r in got)


@pytest.mark.parametrize(("name", "arguments"), [("drop_tables", {}), ("list_machines", {"sql": "x"}), ("list_machines", {"limit": 51}), ("list_machines", {"limit": True}), ("list_machines", {"c_mktsegment": "x' OR 1"}), ("machine_detail", {}), ("machine_detail", {"c_custkey": "7"})])
def test_tools_refuse(name, arguments):
    with pytest.raises(tools.ToolError):
        tools.call(audits.TOOLS, name, {}, arguments)


def test_tools_of_unknown_entities(spark):
    rows = spark.createDataFrame([(1, "a", 2.0)], "c_custkey int, c_name string, c_acctbal double")
    assert tools.call(audits.TOOLS, "machine_detail", {"customer": rows}, {"c_custkey": 1}).first().c_name == "a"
    with pytest.raises(serving.NotFound):
        tools.call(audits.TOOLS, "machine_detail", {"customer": rows}, {"c_custkey": 9})


def test_scores_without_value(spark):
    rows = spark.createDataFrame([(1, 0.14), (1, 0.1399999), (0, None), (0, float("nan")), (0, 0.3), (None, 0.9), (1, 1.0)], "y int, s double")
    at = {r.threshold: r for r in evaluation.threshold_sweep(rows, "y", "s").collect()}
    one = evaluation.confusion(rows.where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL"), "y", "s", 0.14).first()
    assert (at[0.14].tp, at[0.14].fp, at[0.14].fn, at[0.14].tn) == (one.tp, one.fp, one.fn, one.tn) == (2, 1, 1, 0)
    assert at[0.99].tp == 1 and at[0.01].tp == 3
    got = evaluation.normalised_scores(spark.createDataFrame([(None,), (0.0,), (9.0,)], "x double"), "x", 1.0, 5.0)
    assert [r.anomaly_score for r in got.collect()] == [None, 1.0, 0.0]
    for low, high in ((1.0, 1.0), (2.0, 1.0), (float("nan"), 1.0)):
        with pytest.raises(ValueError):
            evaluation.normalised_scores(got, "x", low, high)


def test_stop_words():
    assert len(sequence.STOPWORDS) == 19 and not {"in", "that", "this", "was", "which"} & set(sequence.STOPWORDS)


def test_a_contract_is_judged_once(spark):
    rows = spark.createDataFrame([("MCH-0001", "{}")], "kafka_key string, raw_value string")
    judged = contract.TELEMETRY.validate(rows)
    for part in (contract.valid_rows(judged), contract.quarantine(judged)):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 2


def test_simulated_events_keep_the_contract(spark):
    got = simulator.events(spark, 3, 50).collect()
    assert got == simulator.events(spark.newSession(), 3, 50).collect() and got != simulator.events(spark, 3, 50, seed=1).collect()
    assert all(r.event_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"1.0|{r.machine_code}|{r.sequence_number}|{r.event_time}")) for r in got)
    sent = simulator.as_json(simulator.events(spark, 3, 50))
    judged = contract.TELEMETRY.validate(sent.select(F.col("key").alias("kafka_key"), F.col("value").alias("raw_value")))
    assert contract.quarantine(judged).isEmpty()
    assert simulator.field_order(sent.first().value) == simulator.FIELDS
    for bad in ((0, 1), (101, 1), (1, 0)):
        with pytest.raises(ValueError):
            simulator.events(spark, *bad)


def test_reports_of_empty_tables(spark):
    rows = spark.createDataFrame([], "id int, e int, t timestamp, k string, p int, reasons array<string>, duplicate_rank int")
    got = reports.canonical_report(rows, rows, rows, rows, "id", "e", "t", "k", ["p"], "reasons").first()
    assert got.raw_rows == got.canonical_rows == got.max_duplicate_rank == 0 and got.holds and got.kind_counts == ""
    assert reports.null_counts(rows).count() == 7


def test_scratch_refuses_a_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with scratch.cleared(spark):
        gone = scratch.fresh_path(spark, "gone")
        spark.range(3).write.parquet(gone)
    assert not scratch.exists(spark, gone)
    name = f"test-{uuid.uuid4().hex}"
    assert scratch.kept(spark, name, lambda: [(1,)], "x int").count() == 1
    assert scratch.kept(spark, name, lambda: 1 / 0, "x int").first().x == 1


def test_a_query_name_used_twice_is_an_error():
    with pytest.raises(ValueError):
        catalogue._merged([{"a": 1}, {"a": 2}])
    assert catalogue._merged([{"a": 1}, {"b": 2}]) == {"a": 1, "b": 2}


def test_raw_fields_and_header(spark):
    rows = spark.createDataFrame([("1", "0", "x"), ("007", "2", "NaN"), ("1.0", None, "-3e2"), (" ", "1 ", "Infinity"), (None, "", "5")], "i string, b string, v string")
    got = {r.feature: tuple(r)[1:] for r in profile.raw_fields(rows, {"i": ("integer", 2, 9), "b": ("binary", 0, 1), "v": ("number", 0, 9)}).collect()}
    assert got == {"i": (2, 1, 1.0, 7.0, 1), "b": (2, 1, 0.0, 1.0, 0), "v": (0, 3, -300.0, 5.0, 1)}
    none = profile.raw_fields(rows.limit(0), {"i": ("integer", 0, 1)}).first()
    assert tuple(none) == ("i", 0, 0, None, None, 0)
    assert profile.header_faults(["a", "c", "b", "a", "z"], ["a", "b", "c", "d"]) == {"missing": ["d"], "unexpected": ["z"], "repeated": ["a"], "misplaced": ["c", "b"]}


def test_differing_values_counts_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "y"), (5, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "z")], "k int, v string")
    assert sorted(tuple(r) for r in inspection.differing_values(a, b, "k", "v").collect()) == [(2, None, "x"), (4, "y", "z")]


def test_documents_with_repeated_ids_are_refused(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('[{"i": 1, "t": "a"}, {"i": 1, "t": "b"}]')
    with pytest.raises(ValueError):
        tables.read_documents(spark, str(path), "i int, t string", "i")


def test_a_candidate_is_promoted_on_the_unrounded_gain(spark):
    one = lambda m, p, t: spark.createDataFrame([(m, p, t)], "model string, ap double, threshold double")
    standing = one("fixed", 0.8, 0.3)
    picked = lambda p: evaluation.promoted(standing, one("tuned", p, 0.6), "ap").first()
    assert (picked(0.8051).selected, picked(0.8051).selected_threshold) == ("tuned", 0.6)
    assert (picked(0.8049).selected, picked(0.8049).promoted) == ("fixed", False)
    assert (picked(None).selected, picked(None).promoted) == ("fixed", False)


def test_irregularities_of_missing_values(spark):
    rows = [("a", 1, 1, "2024-01-01 00:00:00", 5), ("a", 2, 2, "2024-01-01 00:00:05", None), ("a", 3, None, None, 4), ("a", 4, 4, "2024-01-01 00:00:15", 3), ("b", 1, 2, "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame(rows, "m string, o int, n int, t string, wear int")
    got = {r.m: tuple(r)[1:] for r in sequence.irregularities(df, "m", ["o"], "n", "t", 5, "wear").collect()}
    assert got == {"a": (4, 1, 1, 1), "b": (1, 1, 0, 0)}


def test_input_faults_of_odd_payloads(spark):
    texts = ['{"k":"a","x":1e999}', '{"k":"a","x":0}', "{}", "null", "", '{"k":"a","k":"b","x":1}', '{"k":"a","x":[1]}', '{"k":{"x":1},"x":123456789012345678901234567890}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    got = {r.i: r.faults for r in records.input_faults(rows, "p", {"k": ("a",)}, ["x"], []).collect()}
    assert got[0] in (["not_a_number:x"], ["not_an_object"])
    assert got[1] == [] and got[2] == ["missing:k", "missing:x"] and got[3] == got[4] == ["not_an_object"]
    assert got[6] == ["not_a_number:x"] and got[7] == ["not_text:k"] and got[5]


def test_a_batch_of_records_must_be_one(spark):
    df = lambda rows: spark.createDataFrame(rows, "e string, m string")
    holds = lambda rows: records.batch_faults(df(rows), ["e", "m"], "e", ["m"]).first()
    assert holds([("1", "a"), ("2", "a")]).holds
    assert (holds([]).records, holds([]).holds) == (0, False)
    assert (holds([("1", "a"), ("1", "b")]).repeated_ids, holds([("1", "a"), ("1", "b")]).models) == (1, 2)
    assert holds([("1", "a"), ("1", "a")]).repeated_identities == 1


def test_the_decision_is_on_the_unrounded_probability(spark):
    rows = spark.createDataFrame([(1, 0.1399999), (2, 0.14), (3, None)], "i int, probability double")
    got = [tuple(r) for r in modelling.inference_outputs(rows, 0.14).orderBy("i").collect()]
    assert got == [(1, 0.14, 0, 0.14), (2, 0.14, 1, 0.14), (3, None, None, 0.14)]


def test_drift_state_without_rows(spark):
    s = spark.createDataFrame([], "snapshot_id int, h string")
    m = spark.createDataFrame([(1, "x", "f", 0.5, "drift")], "snapshot_id int, scope string, feature_name string, psi double, status string")
    got = drift.state_summary(s, m, ["h"], ["x"]).first()
    assert (got.snapshot_count, got.feature_metric_count, got.drift, got.highest_x_feature_name, got.repeated_metrics) == (0, 0, 0, None, 0)


def test_run_conflicts_name_each_key(spark):
    schema = "run int, key string, value string"
    stored = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], schema)
    prepared = spark.createDataFrame([(1, "a", "z"), (1, "c", "y"), (3, "a", "x")], schema)
    got = sorted(tuple(r) for r in records.run_conflicts(stored, prepared, ["run"]).collect())
    assert got == [(1, "a", "x", "z"), (1, "b", "y", None), (1, "c", None, "y")]


def test_rows_that_do_not_change_keep_their_time(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    target = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "c", None), (4, "d", None)], "k int, v string, updated_at timestamp")
    staged = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (9, "x")], "k int, v string")
    got = {r.k: (r.v, r.updated_at is not None) for r in merge.touched(target, staged, ["k"], ["v"], at).collect()}
    assert got == {1: ("a", False), 2: ("b", True), 3: (None, True), 4: ("d", False)}
    assert merge.touched(target, staged, ["k"], ["v"]).where("k = 2").first().updated_at is not None
