import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import contract, dedup, drift, evaluation, inspection, merge, modelling, ordered, sequence, serving, summary
from tidemark.sources import simulator, tables
from tidemark.streaming import bronze

GOOD = {"schema_version": "1.0", "event_id": "11111111-1111-4111-8111-111111111111", "machine_code": "MCH-0001", "sequence_number": 1, "event_time": "2024-01-01T00:00:00Z", "source": "synthetic_simulator", "product_quality_type": "M", "air_temperature_k": 300.0, "process_temperature_k": 310.0, "rotational_speed_rpm": 1500, "torque_nm": 40.0, "tool_wear_min": 10, "vibration_mm_s": 2.0, "pressure_bar": 6.0}


def reasons(spark, *payloads, key="MCH-0001"):
    rows = [(i, key, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    got = contract.TELEMETRY.validate(spark.createDataFrame(rows, "i int, kafka_key string, raw_value string")).orderBy("i").collect()
    return [list(r.rejection_reasons) for r in got]


def test_contract_reasons(spark):
    changed = lambda **k: GOOD | k
    without = {k: v for k, v in GOOD.items() if k != "pressure_bar"}
    got = reasons(spark, GOOD, '{"schema_version":"1.0"', changed(machine_code="MCH-0002"), changed(torque_nm=99.0), changed(rotational_speed_rpm="1500"), changed(tool_wear_min=1.5), without, changed(extra=1), changed(process_temperature_k=304.0, air_temperature_k=305.0), None, "[]", "", "null", changed(torque_nm=80.0, tool_wear_min=300), changed(event_time="2024-02-30T00:00:00Z"))
    assert got[0] == got[13] == []
    assert got[1] == got[9] == got[10] == got[11] == got[12] == ["malformed_json"]
    assert got[2] == ["kafka_key_machine_code_mismatch"] and got[3] == ["invalid_torque_nm"] and got[4] == ["invalid_rotational_speed_rpm"] and got[5] == ["invalid_tool_wear_min"]
    assert got[6] == ["invalid_pressure_bar", "missing_required_field"] and got[7] == ["unexpected_field"] and got[8] == ["process_temperature_not_above_air_temperature"] and got[14] == ["invalid_event_time"]
    assert reasons(spark, GOOD, key=None) == [["kafka_key_machine_code_mismatch"]]


def test_dedup_and_accounts(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 2, None), ("b", 1, 1), ("c", 9, 9)], "k string, o int, s int")
    order = [F.col("o"), F.col("s").asc_nulls_last()]
    assert sorted((r.k, r.s) for r in dedup.canonical(rows, ["k"], order).collect()) == [("a", 5), ("b", 1), ("c", 9)]
    assert sorted((r.duplicate_rank, r.s, r.canonical_o) for r in dedup.audit(rows, ["k"], order, ["o"]).collect()) == [(2, 4, 1), (3, None, 1)]
    one = dedup.accounting(rows, ["k"], F.col("o") > 5).first()
    assert (one.bronze_rows, one.quarantined_rows, one.valid_rows, one.canonical_rows, one.duplicate_rows, one.holds) == (5, 1, 4, 2, 2, True)


def test_summaries_reconcile(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [("e1", "m1", t(5), "L", 1.0), ("e2", "m1", t(55), "H", 2.0), ("e3", "m1", t(65), "M", 3.0), ("e4", "m2", t(60), "H", 4.0), ("e5", "m2", t(60), "H", 5.0), ("e6", None, t(60), "H", 9.0)]
    ev = spark.createDataFrame(rows, "id string, machine string, at timestamp, type string, x double")
    s = {r.machine: r for r in summary.entity_summary(ev, "machine", "at", "id", "type", "HLM", ["x"], ["at", "id"], ["type", "x"]).collect()}
    assert set(s) == {"m1", "m2"} and s["m1"].latest_type == "M" and (s["m1"].n_H, s["m1"].n_L, s["m1"].n_M) == (1, 1, 1) and s["m2"].latest_x == 5.0
    w = summary.entity_windows(ev.where("machine IS NOT NULL"), "machine", "at", "1 minute", "type", "HLM", ["x"])
    assert sorted(r.event_count for r in w.collect()) == [1, 2, 2]
    f = summary.fleet_summary(ev.where("false"), "all", "machine", "id", "at", "type", "HLM", ["x"]).first()
    assert f.event_count == f.n_H == 0 and f.avg_x is None
    a, b = summary.additive_digest(ev, ev.columns).first(), summary.additive_digest(ev.repartition(7), ev.columns).first()
    assert a == b != summary.additive_digest(ev.limit(5), ev.columns).first()


def test_merge(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    staged = spark.createDataFrame([(2, None), (3, "c"), (3, "c")], "k int, v string")
    once = merge.merge_idempotent(target, staged, ["k"])
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "a"), (2, None), (3, "c")]
    assert merge.merge_idempotent(once, staged, ["k"]).count() == 3
    with pytest.raises(merge.MergeConflict):
        merge.merge_idempotent(target, spark.createDataFrame([(2, "x")], "k int, v string"), ["k"])
    newer = merge.upsert_latest(spark.createDataFrame([(1, 5, "old")], "k int, t int, v string"), spark.createDataFrame([(1, 4, "late"), (2, 1, "new")], "k int, t int, v string"), ["k"], ["t"])
    assert sorted((r.k, r.v) for r in newer.collect()) == [(1, "old"), (2, "new")]


def test_drift_bounds(spark):
    ref = spark.createDataFrame([(float(i % 50),) for i in range(1000)], "x double")
    same = drift.numeric_drift(ref, ref, ["x"]).first()
    moved = drift.numeric_drift(ref, ref.select((F.col("x") + 40).alias("x")), ["x"]).first()
    assert same.psi == 0 and same.status == "stable" and moved.psi > 0.25 and moved.status == "drift" and moved.outside_count == 800
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert drift.numeric_drift(flat, flat, ["x"]).first().mean_shift is None
    assert [r.s for r in spark.createDataFrame([(0.0999,), (0.1,), (0.25,)], "p double").select(drift.status(F.col("p")).alias("s")).collect()] == ["stable", "watch", "drift"]
    cat = spark.createDataFrame([("L",), ("M",), ("X",), (None,)], "t string")
    got = drift.categorical_drift(cat, cat, "t", ["L", "M", "H"]).first()
    assert got.psi == 0 and got.unexpected_count == 2


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.29), (0, 0.29), (0, 0.1), (1, 1.0), (0, 0.0)], "y int, s double")
    sweep = {r.threshold: r for r in evaluation.threshold_sweep(rows, "y", "s").collect()}
    assert len(sweep) == 99
    for t in (0.01, 0.29, 0.3, 0.9, 0.99):
        c = evaluation.confusion(rows, "y", "s", t).first()
        assert (sweep[t].tp, sweep[t].fp, sweep[t].fn, sweep[t].tn, sweep[t].f2) == (c.tp, c.fp, c.fn, c.tn, c.f2)
    assert evaluation.ranking_metrics(rows, "y", "s").first().roc_auc == round(8.5 / 9, 6)
    assert evaluation.ranking_metrics(rows.where("y = 1"), "y", "s").first().roc_auc is None
    split = evaluation.stratified_split(spark.range(1000).withColumn("y", F.col("id") % 2), "y", [F.xxhash64("id"), F.col("id")], [("train", 0.7), ("validation", 0.15), ("test", 0.15)])
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 700, "validation": 150, "test": 150}


def test_serving(spark):
    rows = spark.range(10)
    assert [r.id for r in serving.page(rows, [F.desc("id")], 3, 2).collect()] == [7, 6, 5]
    for bad in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            serving.page(rows, [F.desc("id")], *bad)
    with pytest.raises(serving.NotFound):
        serving.require(rows, "id", 77)
    assert serving.filtered(rows, {"id": None}).count() == 10 and serving.filtered(rows, {"id": 3}).count() == 1


def test_sequences_and_retrieval(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("a", 4, 5), ("b", 1, 1)], "e string, n int, v int")
    assert sorted((r.e, r.out_of_sequence) for r in sequence.sequence_gaps(rows, "e", "n").collect()) == [("a", 1), ("b", 0)]
    assert sorted((r.e, r.violations) for r in sequence.order_violations(rows, "e", ["n"], "v").collect()) == [("a", 1), ("b", 0)]
    docs = spark.createDataFrame([("1", "the pump", "wear of a pump"), ("2", "heat", "pump heat"), ("3", None, None)], "id string, title string, content string")
    assert [(r.id, r.score) for r in sequence.retrieve(docs, ["pump", "the"], "title", "content", "id", 5).collect()] == [("1", 2.5), ("2", 1.0)]


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    spark.range(3).write.parquet(f"{p}/a")
    assert tables.read_snapshot(spark, f"{p}/a", "id bigint").count() == 3
    for wrong in ("id int", "id bigint, x int"):
        with pytest.raises(tables.SchemaMismatch):
            tables.read_snapshot(spark, f"{p}/a", wrong)
    tables.write_single_jsonl(spark.createDataFrame([(2, None), (1, "x")], "k int, v string"), f"{p}/j", ["k"])
    assert [r.raw_value for r in tables.read_lines(spark, f"{p}/j").collect()] == ['{"k":1,"v":"x"}', '{"k":2,"v":null}']
    with pytest.raises(ValueError):
        tables.read_csv(spark, [f"{p}/test.csv"], "a int", forbidden=["test.csv"])
    with pytest.raises(ValueError):
        tables.write_snapshots({"a": (spark.range(1), f"{p}/never")}, False)
    assert tables.read_query(spark, "SELECT * FROM t WHERE id = :i", {"t": spark.range(5)}, i=3).count() == 1


def test_streaming_appends_once(spark, tmp_path):
    p = str(tmp_path)
    schema = "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary"
    log = lambda a, b: spark.range(a, b).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.current_timestamp().alias("timestamp"), F.encode(F.lit("k"), "UTF-8").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"))
    for a, b, total in ((0, 10, 10), (10, 15, 15), (15, 15, 15)):
        log(a, b).write.mode("append").parquet(f"{p}/in")
        bronze.append(bronze.bronze(bronze.file_stream(spark, f"{p}/in", schema)), f"{p}/out", f"{p}/cp").awaitTermination()
        got = spark.read.parquet(f"{p}/out")
        assert got.count() == got.select("kafka_offset").distinct().count() == total and len(got.columns) == 8


def test_streamed_windows_of_many_unordered_files(spark, tmp_path):
    from tidemark.plans import catalogue

    at = F.col("id") * 1237 % 2000
    events = spark.range(0, 2000, 1, 160).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + at * 30).cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), at.cast("double").alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert len(list(tmp_path.glob("events.parquet/*.parquet"))) == 160
    got = catalogue.queries()["streaming_windows_1m"](spark, str(tmp_path)).select("user_id", "window_start", "event_count")
    want = events.groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("event_count"))
    want = want.where(F.col("window_start") + F.expr("INTERVAL '11' MINUTE") <= F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_simulator_and_uuid(spark):
    a, b = simulator.events(spark, 3, 20), simulator.events(spark, 3, 20).repartition(5)
    assert a.exceptAll(b).count() == 0 and a.select("event_id").distinct().count() == 60 and a.where("torque_nm NOT BETWEEN 0 AND 80").count() == 0
    name = "1.0|MCH-0001|1"
    assert spark.range(1).select(scalars.uuid5(scalars.URL_NAMESPACE, F.lit(name)).alias("u")).first().u == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_out_of_fold_scores_every_row_once(spark):
    rows = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), F.when(F.col("id") % 4 == 0, 5.0).otherwise(1.0).alias("x"), F.lit("L").alias("t"))
    got = modelling.out_of_fold(rows, lambda: modelling.pipeline("logistic", ["t"], ["x"], "y"), "y", [F.col("id")], ["id"], 3)
    assert got.count() == got.select("id").distinct().count() == 200
    assert modelling.predictions(got, 0.5).where("failure_prediction <> y").count() == 0


def test_isolation_finds_the_odd_row(spark):
    import numpy as np

    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    got = modelling.isolation_scores(df, modelling.fit_isolation(x, 60), ["a", "b"]).orderBy(F.desc("isolation_score")).first()
    assert got.i == 500


def test_path_lengths_are_those_of_a_walk():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)), np.zeros((40, 3)), [[np.nan, 1.0, np.nan]]])
    forest = modelling.fit_isolation(x[:340], 20)

    def walk(row):
        total = 0.0
        for nodes in forest:
            at, depth = 0, 0
            while nodes[at][0] is not None:
                f, cut, left, right = nodes[at]
                at, depth = (left if row[f] < cut else right), depth + 1
            total += depth + modelling._expected(nodes[at][1])
        return total

    got = modelling.path_lengths(x, [modelling._flat(nodes) for nodes in forest])
    assert np.allclose(got, [walk(row) for row in x], rtol=0, atol=1e-9)
    assert len(modelling.path_lengths(x[:0], [modelling._flat(nodes) for nodes in forest])) == 0


def test_isolation_trees_draw_from_all_rows(spark):
    # a third of the rows hold one value tuple; half of these are also exact copies of one row
    third = F.col("id") % 3 == 0
    rows = spark.range(30_000).select(F.when(third & (F.col("id") % 2 == 0), -1).otherwise(F.col("id")).alias("k"), F.when(third, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = modelling.tree_samples(rows, ["k"], ["x"], 40)
    assert len(got) == 40 and all(len(x) == 256 for x in got)
    shares = [(x == 0).mean() for x in got]
    assert abs(sum(shares) / 40 - 1 / 3) < 0.02 and min(shares) > 0.2 and max(shares) < 0.47
    assert len({v for x in got for v in x[:, 0]}) > 5_000
    again = modelling.tree_samples(rows.repartition(7), ["k"], ["x"], 40)
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
    few = modelling.tree_samples(rows.limit(9), ["k"], ["x"], 3)
    assert [len(x) for x in few] == [9] * 3


def test_isolation_query_samples_beyond_its_first_rows(spark, tmp_path, monkeypatch):
    from tidemark.plans import catalogue

    seen = []
    for name in ("fit_isolation", "fit_trees"):
        fit = getattr(modelling, name, None)
        if fit:
            monkeypatch.setattr(modelling, name, lambda given, *a, _f=fit: (seen.extend(given if isinstance(given, list) else [given]), _f(given, *a))[1])
    rows = spark.range(60_000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") + 2.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalogue.queries()["isolation_scores"](spark, str(tmp_path)).count() == 60_000
    held = [v for x in seen for v in x[:, 0]]
    assert len(set(held)) > 4_096 and 0.25 < sum(v == 1.0 for v in held) / len(held) < 0.42


def test_core_does_not_need_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "tidemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidemark.llm" not in f.read_text(), f


def test_ordered_work_is_the_same_in_one_task_and_in_ranges(spark):
    import numpy as np

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 50 == 1, "b").otherwise("a").alias("g"), (F.col("id") * 7919 % 101).cast("double").alias("x"))
    order = [F.col("x").desc(), F.col("id")]
    one, many = (sorted(map(tuple, ordered.running(rows, ["g"], order, {"r": F.lit(1), "s": F.col("x")}, n).collect()), key=lambda r: r[0]) for n in (10_000, 100))
    assert one == many and len(one) == 3000 and max(r[3] for r in one if r[1] is None) == 1000
    at = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    data = rows.withColumn("x", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("x") ** 2))
    one, many = ({r.g: r.q for r in ordered.quantiles(data, ["g"], "x", at, n).collect()} for n in (10_000, 100))
    want = data.where("x IS NOT NULL").toPandas()
    for g in (None, "a", "b"):
        mine = want[want.g.isna() if g is None else want.g == g].x
        assert np.allclose(one[g], np.quantile(mine, at)) and np.allclose(many[g], np.quantile(mine, at))
    assert np.allclose(ordered.quantiles(data, [], "x", at, 100).first().q, np.quantile(want.x, at))
    assert ordered.quantiles(data.where("false"), [], "x", at).count() == ordered.quantiles(data.where("false"), ["g"], "x", at, -1).count() == 0
    split = lambda n: evaluation.stratified_split(rows, "g", order, [("a", 0.7), ("b", 0.3)], n)
    assert split(10_000).exceptAll(split(100)).count() == 0 and evaluation.folds(rows, "g", order, 5, 100).exceptAll(evaluation.folds(rows, "g", order, 5)).count() == 0
    assert evaluation.seeded_sample(rows, ["id"], 10).exceptAll(evaluation.seeded_sample(rows.repartition(7), ["id"], 10)).count() == 0


def test_inspection_is_null_safe(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 1.0), (None, "z", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 3.0), (2, None, 1.0), (None, "y", 2.0)], "k int, s string, v double")
    assert sorted(((r.k or 0), r.differing) for r in inspection.mismatches(a, b, ["k"], ["s", "v"]).collect()) == [(0, ["s"]), (1, ["v"])]
    log = spark.createDataFrame([(1, 5, "x"), (1, 4, "first"), (9, 1, "extra")], "k int, at int, s string")
    got = {r.k: (r.state, r.arrivals) for r in inspection.delivery(a.where("k IS NOT NULL"), log, ["k"], ["at"], "s").collect()}
    assert got == {1: ("differs", 2), 2: ("missing", 0)}
    one = inspection.table_report(a, "k", ["k", "s"], ["v"], ["s"]).first()
    assert (one.n_rows, one.repeated_ids, one.null_k, one.null_s, one.bad_numbers) == (3, 0, 1, 1, 1)
    empty = inspection.table_report(a.where("false"), "k", ["k"], ["v"], ["s"]).first()
    assert (empty.n_rows, empty.bad_numbers) == (0, 0)
    assert inspection.export_parity(a, a.drop("v"), "s", ["v"]).first().leaked_fields == "" and not inspection.export_parity(a, a, "s", ["v"]).first().holds
    assert [(r.name, r.place) for r in inspection.grid_ranking(spark.createDataFrame([("b", 1.0), ("a", 1.0)], "name string, s double"), "s", "name").orderBy("place").collect()] == [("a", 1), ("b", 2)]
    assert {(r.key, r.value) for r in inspection.ledger(a.where("k = 2"), ["k"], ["s", "v"]).collect()} == {("v", "1.0")}
