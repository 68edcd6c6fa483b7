"""Inputs and records of models, sweeps of several models, promotion, drift state, regularity (on the driver's tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import contract, drift, evaluation, merge, modelling, records, sequence
from tidemark.plans.ingestion import _CHECKED, _validated
from tidemark.plans.registry import registry

QUERIES, SQL, query = registry()

_TWO = "s AS (SELECT quality, (n_chars % 1000) / 1000.0::DOUBLE AS a, CASE WHEN doc_id % 13 <> 0 THEN (n_chars % 777) / 777.0::DOUBLE END AS b FROM labels JOIN documents USING (doc_id)), l AS (SELECT quality, 'a' AS model, a AS score FROM s UNION ALL SELECT quality, 'b', b FROM s)"


@query(f"""WITH {_TWO}, k AS (SELECT model, t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE quality = 1 AND score >= t / 100.0::DOUBLE) AS tp, count(*) FILTER (WHERE quality <> 1 AND score >= t / 100.0::DOUBLE) AS fp,
count(*) FILTER (WHERE quality = 1 AND score < t / 100.0::DOUBLE) AS fn, count(*) FILTER (WHERE quality <> 1 AND score < t / 100.0::DOUBLE) AS tn FROM l, range(1, 100) g(t) GROUP BY 1, 2)
SELECT model, threshold, tp, fp, fn, tn, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(CAST(5 * tp AS DOUBLE) / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2 FROM k""")
def model_sweeps(labels: DataFrame, documents: DataFrame) -> DataFrame:
    rows = labels.join(documents.select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("quality", ((F.col("n_chars") % 1000) / 1000).alias("a"), F.when(F.col("doc_id") % 13 != 0, (F.col("n_chars") % 777) / 777).alias("b"))
    return evaluation.model_sweeps(rows, "quality", ["a", "b"]).select("model", "threshold", "tp", "fp", "fn", "tn", "precision", "f2")


_PAIR = "m AS (SELECT o_orderpriority AS model, avg(o_totalprice) / 1000000 AS metric, min(o_totalprice) / 1000000 AS threshold FROM orders GROUP BY 1)"
_PROMOTED = "SELECT round(s.metric, 6) AS standing_metric, round(c.metric, 6) AS candidate_metric, round(c.metric - s.metric, 6) AS gain, c.metric - s.metric >= 0.0005 AS promoted, CASE WHEN c.metric - s.metric >= 0.0005 THEN c.model ELSE s.model END AS selected, round(CASE WHEN c.metric - s.metric >= 0.0005 THEN c.threshold ELSE s.threshold END, 6) AS selected_threshold FROM m s JOIN m c ON s.model = '{a}' AND c.model = '{b}'"


@query(f"WITH {_PAIR} {_PROMOTED.format(a='5-LOW', b='1-URGENT')} UNION ALL {_PROMOTED.format(a='1-URGENT', b='5-LOW')}")
def promotion(orders: DataFrame) -> DataFrame:
    """One of two models against the other, both ways."""
    m = orders.groupBy(F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 1000000).alias("metric"), (F.min("o_totalprice") / 1000000).alias("threshold"))
    low, urgent = m.where("model = '5-LOW'"), m.where("model = '1-URGENT'")
    return evaluation.promoted(low, urgent, "metric", 0.0005).unionByName(evaluation.promoted(urgent, low, "metric", 0.0005))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, row_number() OVER o AS i, epoch_us(l_shipdate) - first_value(epoch_us(l_shipdate)) OVER o AS t, l_quantity < lag(l_quantity) OVER o AS down FROM lineitem
WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_quantity, l_partkey, l_suppkey))
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber IS DISTINCT FROM i) AS out_of_sequence, count(*) FILTER (WHERE t IS DISTINCT FROM (i - 1) * 86400000000) AS off_schedule, count(*) FILTER (WHERE down) AS falls FROM w GROUP BY 1""")
def irregularities(lineitem: DataFrame) -> DataFrame:
    return sequence.irregularities(lineitem, "l_orderkey", ["l_linenumber", "l_shipdate", "l_quantity", "l_partkey", "l_suppkey"], "l_linenumber", "l_shipdate", 86400, "l_quantity")


@query(_CHECKED + " SELECT source_offset, kafka_key, raw_value, json_extract_string(safe, '$.event_id') AS event_id, json_extract_string(safe, '$.machine_code') AS machine_code, list_aggregate(rejection_reasons, 'string_agg', ',') AS rejection_reasons FROM v WHERE len(rejection_reasons) > 0")
def quarantine_records(events: DataFrame) -> DataFrame:
    """Rejected events as they are kept."""
    kept = contract.quarantine_records(_validated(events), ["source_offset", "kafka_key"], ["event_id", "machine_code"])
    return kept.withColumn("rejection_reasons", F.concat_ws(",", "rejection_reasons"))


_STATE = """s AS (SELECT n_nationkey AS snapshot_id, n_regionkey % 2 AS h, n_nationkey % 3 AS v FROM nation WHERE n_regionkey < 3),
m AS (SELECT c_nationkey AS snapshot_id, CASE WHEN c_custkey % 2 = 0 THEN 'inputs' ELSE 'sensors' END AS scope, 'f' || c_custkey % 5 AS feature_name, CASE WHEN c_custkey % 10 < 8 THEN floor(c_acctbal / 1000) / 30 END AS psi, CASE WHEN c_acctbal >= 7500 THEN 'drift' WHEN c_acctbal >= 3000 THEN 'watch' ELSE 'stable' END AS status FROM customer),
r AS (SELECT * FROM m WHERE snapshot_id IN (SELECT snapshot_id FROM s))"""
_TOP = "(SELECT min({c}) FROM r WHERE scope = '{s}' AND psi = (SELECT max(psi) FROM r WHERE scope = '{s}') AND feature_name = (SELECT min(feature_name) FROM r WHERE scope = '{s}' AND psi = (SELECT max(psi) FROM r WHERE scope = '{s}'))) AS highest_{s}_{c}"


@query(f"""WITH {_STATE} SELECT (SELECT count(*) FROM s) AS snapshot_count, (SELECT count(*) FROM r) AS feature_metric_count, (SELECT count(*) FROM r WHERE status = 'stable') AS stable, (SELECT count(*) FROM r WHERE status = 'watch') AS watch, (SELECT count(*) FROM r WHERE status = 'drift') AS drift,
{", ".join(_TOP.format(s=s, c=c) for s in ("inputs", "sensors") for c in ("feature_name", "psi", "status"))},
(SELECT count(*) FROM (SELECT h, v FROM s GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_snapshots, (SELECT count(*) FROM (SELECT snapshot_id, scope, feature_name FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1)) AS repeated_metrics""")
def drift_state(nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Metrics of customers as if of drift snapshots; some have no PSI."""
    snapshots = nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("snapshot_id"), (F.col("n_regionkey") % 2).alias("h"), (F.col("n_nationkey") % 3).alias("v"))
    status = F.when(F.col("c_acctbal") >= 7500, "drift").when(F.col("c_acctbal") >= 3000, "watch").otherwise("stable")
    psi = F.when(F.col("c_custkey") % 10 < 8, F.floor(F.col("c_acctbal") / 1000) / 30)
    scope = F.when(F.col("c_custkey") % 2 == 0, "inputs").otherwise("sensors")
    metrics = customer.select(F.col("c_nationkey").alias("snapshot_id"), scope.alias("scope"), F.concat(F.lit("f"), F.col("c_custkey") % 5).alias("feature_name"), psi.alias("psi"), status.alias("status"))
    return drift.state_summary(snapshots, metrics, ["h", "v"], ["inputs", "sensors"])


#: The same text in both engines: model inputs, spoilt in one way for most remainders of the key, with the faults to be found.
_INPUTS = {
    1: ("'{\"kind\":\"L\",\"torque\":1.5}'", "missing:speed"),
    2: ("'{\"kind\":\"L\",\"torque\":1.5,\"speed\":7,\"failed\":1,\"note\":2}'", "forbidden:failed,unexpected:note"),
    3: ("'{\"kind\":5,\"torque\":1.5,\"speed\":7}'", "not_text:kind"),
    4: ("'{\"kind\":\"X\",\"torque\":1.5,\"speed\":7}'", "not_allowed:kind"),
    5: ("'{\"kind\":\"M\",\"torque\":null,\"speed\":true}'", "not_a_number:torque,not_a_number:speed"),
    6: ("'{\"kind\":\"M\",\"torque\":\"1.5\",\"speed\":7}'", "not_a_number:torque"),
    7: ("'[1]'", "not_an_object"),
    8: ("'{\"kind\":'", "not_an_object"),
    9: ("'{\"kind\":null,\"torque\":1e3,\"speed\":7}'", "not_text:kind"),
}


@query("SELECT o_orderkey, CASE o_orderkey % 11 " + " ".join(f"WHEN {k} THEN '{faults}'" for k, (_, faults) in _INPUTS.items()) + " WHEN 10 THEN 'not_an_object' ELSE '' END AS faults FROM orders")
def inference_inputs(orders: DataFrame) -> DataFrame:
    """What a strict input contract finds; the SQL states what was planted."""
    spoilt = " ".join(f"WHEN {k} THEN {text}" for k, (text, _) in _INPUTS.items())
    payload = f"CASE o_orderkey % 11 {spoilt} WHEN 10 THEN NULL ELSE concat('{{\"kind\":\"H\",\"torque\":', o_totalprice, ',\"speed\":', o_custkey, '}}') END"
    found = records.input_faults(orders.select("o_orderkey", F.expr(payload).alias("payload")), "payload", {"kind": ("L", "M", "H")}, ["torque", "speed"], ["failed"])
    return found.select("o_orderkey", F.concat_ws(",", "faults").alias("faults"))


@query("SELECT o_orderkey, round(o_totalprice / 1000000, 6) AS failure_probability, CAST(o_totalprice / 1000000 >= 0.14 AS INTEGER) AS failure_prediction, CAST(0.14 AS DOUBLE) AS decision_threshold, 'baseline' AS model_name FROM orders")
def inference_outputs(orders: DataFrame) -> DataFrame:
    scored = orders.select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("probability"))
    return modelling.inference_outputs(scored, 0.14, model_name="baseline")


#: Record columns as SQL that both engines read; the second half of each rule is what breaks it.
_RECORD = """SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 1 THEN 'x' ELSE '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS STRING), 12, '0') END AS event_id, CASE WHEN o_orderkey % 23 = 2 THEN 'soon' ELSE '2024-01-01T00:00:00Z' END AS event_time, CASE WHEN o_orderkey % 23 = 3 THEN 1.5 ELSE 0.2 END AS failure_probability, CAST(0.14 AS DOUBLE) AS frozen_threshold,
CASE WHEN o_orderkey % 23 = 4 THEN 0 WHEN o_orderkey % 23 = 5 THEN NULL ELSE 1 END AS failure_prediction, CASE WHEN o_orderkey % 23 = 6 THEN 'ABC' ELSE repeat('a', 64) END AS final_config_hash, repeat('b', 64) AS model_input_sha256, CASE WHEN o_orderkey % 23 = 7 THEN NULL ELSE repeat('c', 64) END AS payload_sha256, 'v1' AS adapter_version,
CASE WHEN o_orderkey % 23 = 8 THEN ' ' ELSE 'MCH-0001' END AS machine_code, 'MCH-0001' AS source_kafka_key, 'telemetry' AS source_kafka_topic, CASE WHEN o_orderkey % 23 = 9 THEN -1 ELSE o_orderkey END AS source_kafka_offset, 0 AS source_kafka_partition, CASE WHEN o_orderkey % 23 = 10 THEN 'other' ELSE 'baseline' END AS model_name, '1' AS model_version FROM orders"""
_BROKEN = ("event_id", "event_time", "failure_probability", "decision", "decision", "final_config_hash", "payload_sha256", "machine_code", "source_kafka_offset", "model_name")


def _records(orders: DataFrame) -> DataFrame:
    return orders.sparkSession.sql(_RECORD.replace("FROM orders", "FROM {orders}"), orders=orders)


@query("SELECT o_orderkey, CASE o_orderkey % 23 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(_BROKEN, 1)) + " END AS violations FROM orders WHERE o_orderkey % 23 BETWEEN 1 AND 10")
def prediction_faults(orders: DataFrame) -> DataFrame:
    """What the record rules find; the SQL states what was planted."""
    found = records.prediction_faults(_records(orders), "baseline", "1").where(F.size("violations") > 0)
    return found.select("o_orderkey", F.concat_ws(",", "violations").alias("violations"))


@query(f"WITH r AS ({_RECORD}) SELECT count(*) AS records, (SELECT count(*) FROM (SELECT event_id, model_name FROM r GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_identities, (SELECT count(*) FROM (SELECT event_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM (SELECT DISTINCT model_name, model_version FROM r)) AS models, false AS holds FROM r")
def record_batch(orders: DataFrame) -> DataFrame:
    return records.batch_faults(_records(orders), ["event_id", "model_name"], "event_id", ["model_name", "model_version"])


_LEDGERS = "a AS (SELECT o_custkey AS run, 'k' || o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey % 7 <> 1), b AS (SELECT o_custkey AS run, 'k' || o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 7 <> 2 AND o_custkey % 3 <> 0)"


@query(f"WITH {_LEDGERS} SELECT run, key, a.value AS stored, b.value AS prepared FROM (SELECT * FROM a WHERE run IN (SELECT run FROM b)) a FULL JOIN (SELECT * FROM b WHERE run IN (SELECT run FROM a)) b USING (run, key) WHERE a.value IS DISTINCT FROM b.value")
def run_conflicts(orders: DataFrame) -> DataFrame:
    """Runs of customers, found again with some values changed, lost or added."""
    named = orders.select(F.col("o_custkey").alias("run"), F.concat(F.lit("k"), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), "o_orderkey")
    stored = named.where("o_orderkey % 7 <> 1").drop("o_orderkey")
    changed = named.withColumn("value", F.when(F.col("o_orderkey") % 5 == 0, "Z").otherwise(F.col("value")))
    return records.run_conflicts(stored, changed.where("o_orderkey % 7 <> 2 AND run % 3 <> 0").drop("o_orderkey"), ["run"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'F' END ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'F' END THEN TIMESTAMP '2024-01-01 00:00:00' ELSE o_orderdate END AS updated_at FROM orders")
def touched_rows(orders: DataFrame) -> DataFrame:
    """Statuses set for some orders: only those that change get a new time."""
    target = orders.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("updated_at"))
    staged = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, "F").alias("o_orderstatus"))
    return merge.touched(target, staged, ["o_orderkey"], ["o_orderstatus"], F.lit("2024-01-01 00:00:00").cast("timestamp"))
