"""Reports, gates, sinks read back, streams and record assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import contract, drift, evaluation, inspection, serving, summary
from tidemark.plans.registry import registry
from tidemark.sources import tables
from tidemark.sources.scratch import fresh_path
from tidemark.streaming import bronze

QUERIES, SQL, query = registry()

_TYPES = ("click", "error", "purchase", "signup", "view")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in _TYPES)


@query("SELECT count(*) AS records, count(DISTINCT event_id) AS distinct_records, count(DISTINCT user_id) AS entities, count(*) FILTER (WHERE value >= 100) AS positives, count(*) FILTER (WHERE NOT value >= 100) AS negatives, round(min(value), 6) AS min_score, round(max(value), 6) AS max_score, round(avg(value), 6) AS mean_score FROM events")
def prediction_summary(events: DataFrame) -> DataFrame:
    return inspection.score_summary(events, "event_id", "user_id", F.col("value"), F.col("value") >= 100)


_SCORE = "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (150.0::DOUBLE - value) / 145.0::DOUBLE)), 5)"


@query(f"SELECT count(*) AS records, count(DISTINCT event_id) AS distinct_records, count(DISTINCT user_id) AS entities, count(*) FILTER (WHERE s >= 0.9) AS positives, count(*) FILTER (WHERE s < 0.9) AS negatives, round(min(s), 5) AS min_score, round(max(s), 5) AS max_score, round(avg(s), 5) AS mean_score FROM (SELECT *, {_SCORE} AS s FROM events)")
def anomaly_summary(events: DataFrame) -> DataFrame:
    scored = evaluation.normalised_scores(events, "value", 5.0, 150.0)
    return inspection.score_summary(scored, "event_id", "user_id", F.col("anomaly_score"), F.col("anomaly_score") >= 0.9, 5)


@query("SELECT count(*) AS n_rows, count(event_id) - count(DISTINCT event_id) AS repeated_ids, count(*) FILTER (WHERE user_id IS NULL) AS null_user_id, count(*) FILTER (WHERE nullif(event_type, 'view') IS NULL) AS null_event_type, count(*) FILTER (WHERE event_id % 10 = 0) AS bad_numbers, count(DISTINCT user_id % 3) AS partitions FROM events")
def table_report(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("event_id") % 20 == 0, None).when(F.col("event_id") % 20 == 10, float("nan")).otherwise(F.col("value")).alias("value"), (F.col("user_id") % 3).alias("p"))
    return inspection.table_report(rows, "event_id", ["user_id", "event_type"], ["value"], ["p"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_linenumber")))
def numeric_ranges(lineitem: DataFrame) -> DataFrame:
    return inspection.numeric_ranges(lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"])


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS n, nullif(max(o_orderkey), 7) AS last FROM orders GROUP BY 1)
SELECT o_custkey, concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.last IS DISTINCT FROM b.last THEN 'last' END) AS differing FROM a JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n OR a.last IS DISTINCT FROM b.last""")
def summary_mismatches(orders: DataFrame) -> DataFrame:
    a = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    b = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderkey") % 50 != 0).alias("n"), F.nullif(F.max("o_orderkey"), F.lit(7)).alias("last"))
    return inspection.mismatches(a, b, ["o_custkey"], ["n", "last"]).withColumn("differing", F.concat_ws(",", "differing"))


@query("""WITH got AS (SELECT o_orderkey, count(*) AS arrivals, min_by(s, o_orderdate) AS s FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL '1 day', 'Z' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0) GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN arrivals IS NULL THEN 'missing' WHEN o.o_orderstatus = s THEN 'matched' ELSE 'differs' END AS state, coalesce(arrivals, 0) AS arrivals FROM orders o LEFT JOIN got USING (o_orderkey)""")
def delivery_check(orders: DataFrame) -> DataFrame:
    log = orders.where("o_orderkey % 5 <> 0")
    sent = log.select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    again = log.where("o_orderkey % 7 = 0").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL '1' DAY")).alias("o_orderdate"), F.lit("Z").alias("o_orderstatus"))
    return inspection.delivery(orders, sent.unionByName(again), ["o_orderkey"], ["o_orderdate"], "o_orderstatus")


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS s, count(*) AS c FROM events GROUP BY 1, 2)
SELECT count(*) AS entity_rows, count(DISTINCT user_id) AS entities, CAST(sum(n) AS BIGINT) AS entity_events, (SELECT count(*) FROM w) AS window_rows, (SELECT count(*) FROM (SELECT user_id, s FROM w GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_windows, (SELECT CAST(sum(c) AS BIGINT) FROM w) AS window_events, (SELECT count(*) FROM (SELECT count(*) FROM events)) AS fleet_rows, (SELECT count(*) FROM events) AS fleet_events, sum(n) = (SELECT count(*) FROM events) AND (SELECT sum(c) FROM w) = (SELECT count(*) FROM events) AS holds FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def summary_invariants(events: DataFrame) -> DataFrame:
    entities = summary.entity_summary(events, "user_id", "ts", "event_id", "event_type", _TYPES, ["value"], ["ts", "event_id"], ["event_id"])
    windows = summary.entity_windows(events, "user_id", "ts", "1 minute", "event_type", _TYPES, ["value"])
    return inspection.summary_invariants(entities, windows, summary.fleet_summary(events, "all", "user_id", "event_id", "ts", "event_type", _TYPES, ["value"]), "user_id")


_EXPORT = "SELECT event_id // 2 AS event_id, value FROM events WHERE event_id % 50 <> 0"


@query(f"SELECT (SELECT count(*) FROM events) AS source_rows, count(*) AS export_rows, count(DISTINCT event_id) AS export_ids, 'value' AS leaked_fields, (SELECT count(*) FROM events) = count(*) AND count(DISTINCT event_id) = count(*) AND false AS holds FROM ({_EXPORT})")
def export_parity(events: DataFrame) -> DataFrame:
    """An export with missing rows, repeated ids and a field that it must not have."""
    export = events.where("event_id % 50 <> 0").select(F.floor(F.col("event_id") / 2).alias("event_id"), "value")
    return inspection.export_parity(events, export, "event_id", ["user_id", "value", "event_type"])


_MIX = "(doc_id * 7919) % 10007, doc_id"


@query(f"""WITH s AS (SELECT doc_id, quality, CASE WHEN r <= floor(round(n * 0.7, 6)) THEN 'train' WHEN r <= floor(round(n * 0.85, 6)) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_MIX}) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)),
t AS (SELECT count(*) AS a, count(*) FILTER (WHERE quality = 1) AS p FROM s), g AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positives FROM s GROUP BY 1)
SELECT split, n, positives, round(positives / n::DOUBLE, 6) AS rate, abs(n - a * CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) <= 2 AND abs(positives / n::DOUBLE - p / a::DOUBLE) <= 0.05 AS holds FROM g, t""")
def split_integrity(labels: DataFrame) -> DataFrame:
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    split = evaluation.stratified_split(labels.select("doc_id", "quality"), "quality", [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")], list(shares.items()))
    return inspection.split_integrity(split, "doc_id", F.col("quality") == 1, shares, 0.05)


@query("SELECT vec_id, round(s, 6) AS contribution_sum, vec_id % 4 <> 0 AS additive FROM (SELECT vec_id, (SELECT sum(CAST(x AS DOUBLE)) FROM (SELECT unnest(embedding) AS x)) AS s FROM embeddings)")
def explanation_additivity(embeddings: DataFrame) -> DataFrame:
    parts = embeddings.select("vec_id", F.explode("embedding").alias("x"))
    whole = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    outputs = embeddings.select("vec_id", F.lit(0.5).alias("base"), (whole + 0.5 + F.when(F.col("vec_id") % 4 == 0, 0.01).otherwise(0.0)).alias("output"))
    return inspection.additivity(parts, "vec_id", "x", outputs, "base", "output")


@query("SELECT o_orderkey, o_custkey, v.key, v.value FROM orders, LATERAL (VALUES ('status', o_orderstatus), ('priority', nullif(o_orderpriority, '5-LOW'))) v(key, value) WHERE v.value IS NOT NULL")
def run_ledger(orders: DataFrame) -> DataFrame:
    runs = orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return inspection.ledger(runs, ["o_orderkey", "o_custkey"], ["status", "priority"])


@query("SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 5")
def top_per_group(events: DataFrame) -> DataFrame:
    return inspection.top_per_group(events.select("event_type", "event_id", "value"), "event_type", [F.desc("value"), F.col("event_id")], 5)


_TRIALS = "SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS trial, round(avg(l_discount), 3) AS score FROM lineitem GROUP BY 1"


@query(f"SELECT trial, score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY score DESC, trial) AS INTEGER) AS place FROM ({_TRIALS})")
def grid_ranking(lineitem: DataFrame) -> DataFrame:
    trials = lineitem.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("trial")).agg(F.round(F.avg("l_discount"), 3).alias("score"))
    return inspection.grid_ranking(trials, "score", "trial")


@query("SELECT epoch_us(ts) // 1000 AS at_ms, value, coalesce(event_type = 'error', false) AS flagged FROM events WHERE event_id % 9 <> 0")
def chart_series(events: DataFrame) -> DataFrame:
    return inspection.chart_series(events.withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value"))), "ts", "value", F.col("event_type") == "error")


@query("SELECT 'orders' AS table_name, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def status_counts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return inspection.status_counts({"orders": (orders, "o_orderstatus"), "lineitem": (lineitem, "l_linestatus")})


_INPUT = """'{"custkey":' || o_custkey || ',"status":"' || o_orderstatus || '","note":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"n"' END || '}'"""


@query(f"SELECT o_orderkey AS event_id, sha256({_INPUT}) AS model_input_sha256, round(o_totalprice / 1000000, 6) AS failure_probability, CAST(round(o_totalprice / 1000000, 6) >= 0.14 AS INTEGER) AS failure_prediction, CAST(0.14 AS DOUBLE) AS frozen_threshold FROM orders")
def prediction_records(orders: DataFrame) -> DataFrame:
    rows = orders.select("*", F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, "n").alias("note"))
    p = F.round(F.col("o_totalprice") / 1000000, 6)
    return rows.select(F.col("o_orderkey").alias("event_id"), scalars.canonical_sha256(["custkey", "status", "note"]).alias("model_input_sha256"), p.alias("failure_probability"), (p >= 0.14).cast("int").alias("failure_prediction"), F.lit(0.14).alias("frozen_threshold"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'p' || event_id END AS prediction, CASE WHEN event_id % 4 <> 0 THEN event_type END AS model_name FROM events")
def nested_documents(events: DataFrame) -> DataFrame:
    model = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    nested = serving.nested_when(model, name=model, prediction=F.concat(F.lit("p"), F.col("event_id").cast("string")))
    docs = events.select("event_id", nested.alias("latest"))
    return docs.select("event_id", "latest.prediction", F.col("latest.name").alias("model_name"))


_BAD = "list_filter([CASE WHEN NOT (o_totalprice <= 400000) THEN 'ck_price' END, CASE WHEN NOT (o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT') THEN 'ck_state' END], lambda x: x IS NOT NULL)"


@query(f"SELECT v.violation, count(*) AS n FROM (SELECT unnest({_BAD}) AS violation FROM orders) v GROUP BY 1")
def record_violations(orders: DataFrame) -> DataFrame:
    got = contract.check_columns(orders, [("ck_price", F.col("o_totalprice") <= 400000), ("ck_state", (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "1-URGENT"))])
    return got.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT l_orderkey, l_shipdate FROM lineitem), p AS (SELECT o_orderkey, o_orderdate FROM orders) SELECT l_orderkey, count(*) AS early FROM c JOIN p ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1")
def foreign_key_theta(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    pairs = lineitem.select("l_orderkey", "l_shipdate").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.where(F.col("l_shipdate") < F.col("o_orderdate")).groupBy("l_orderkey").agg(F.count("*").alias("early"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus = 'O'")
def parameterised_query(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return tables.read_query(spark, "SELECT o_orderkey, o_custkey FROM q_orders WHERE o_totalprice >= :least AND o_orderstatus = :status", {"q_orders": orders}, least=300000.0, status="O")


@query("SELECT * FROM (VALUES ('n_name', 'string', true), ('n_nationkey', 'int', true), ('n_regionkey', 'int', true)) v(name, type, nullable)")
def catalogue_introspection(spark: SparkSession, nation: DataFrame) -> DataFrame:
    nation.createOrReplaceTempView("q_nation")
    return spark.createDataFrame(tables.catalogue_columns(spark, "q_nation"), "name string, type string, nullable boolean")


_EVENT = "event_id bigint, user_id bigint, event_type string, value double"


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_parts(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Ordered JSON lines written and read back under an enforced schema."""
    path = fresh_path(spark, "json")
    tables.write_json_ordered(events.select("event_id", "user_id", "event_type", "value"), path, ["user_id", "event_id"])
    return tables.read_json_parts(spark, path, _EVENT)


@query("SELECT user_id, value FROM events")
def csv_subset(spark: SparkSession, events: DataFrame) -> DataFrame:
    path = fresh_path(spark, "csv")
    tables.write_csv(events.select("event_id", "user_id", "event_type", "value"), path)
    return tables.read_csv(spark, path, _EVENT, ["user_id", "value"], forbidden=["test.csv"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_outputs(spark: SparkSession, nation: DataFrame) -> DataFrame:
    path = fresh_path(spark, "snapshot")
    tables.write_snapshots({"nation": (nation, path)}, True)
    return tables.read_snapshot(spark, path, "n_nationkey int, n_name string, n_regionkey int", exact=True)


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS raw_value FROM nation")
def single_jsonl(spark: SparkSession, nation: DataFrame) -> DataFrame:
    path = fresh_path(spark, "jsonl")
    tables.write_single_jsonl(nation.select("n_nationkey", "n_name"), path, ["n_nationkey"])
    return tables.read_lines(spark, path)


_REF, _CUR = "event_id % 2 = 0", "event_id % 2 = 1"
_DOMAIN = ("click", "error", "purchase", "view")


@query()
def drift_report(events: DataFrame) -> DataFrame:
    """Numeric and categorical metrics of one snapshot with the identity of the data they were worked out on."""
    ref, cur = events.where(_REF), events.where(_CUR)
    cols = ["feature", "reference_count", "current_count", "psi", "status"]
    metrics = drift.numeric_drift(ref.select("value"), cur.select((F.col("value") * 1.1).alias("value")), ["value"]).select(cols).unionByName(drift.categorical_drift(ref, cur, "event_type", _DOMAIN).select(cols))
    identity = summary.additive_digest(cur, cur.columns).select(F.sha2(F.concat_ws("|", "n", "xor", "sum"), 256).alias("current_data_sha256"))
    return metrics.join(F.broadcast(identity))


@query("SELECT CAST(user_id AS VARCHAR) AS kafka_key, event_id AS kafka_offset, props AS raw_value, sha256(props) AS payload_sha256 FROM events")
def streaming_bronze(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The raw layer as a stream: everything that has arrived is appended once, under a checkpoint, then read."""
    log = bronze.file_stream(spark, f"{sf_dir}/events.parquet*", events.schema).select(F.lit("telemetry").alias("topic"), (F.col("user_id") % 3).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"))
    path = fresh_path(spark, "bronze")
    bronze.append(bronze.bronze(log), path, fresh_path(spark, "bronze-checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("kafka_key", "kafka_offset", "raw_value", "payload_sha256")


@query(f"""SELECT * FROM (SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end, count(*) AS event_count, {_COUNTS}, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""")
def streaming_windows_1m(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The same windows from a stream: a window is written once, when the watermark (10 minutes) has passed its end."""
    rows = bronze.file_stream(spark, f"{sf_dir}/events.parquet*", events.schema, None).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    path = fresh_path(spark, "windows")
    bronze.append(summary.entity_windows(rows, "user_id", "ts", "1 minute", "event_type", _TYPES, ["value"]), path, fresh_path(spark, "windows-checkpoint")).awaitTermination()
    got = spark.read.parquet(path)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
