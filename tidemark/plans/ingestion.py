"""Ingestion queries: validation, quarantine, deduplication, summaries and their accounts (on events and lineitem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import contract, dedup, summary
from tidemark.plans.registry import registry
from tidemark.sources import simulator
from tidemark.streaming import bronze

QUERIES, SQL, query = registry()

_TYPES = ("click", "error", "purchase", "signup", "view")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in _TYPES)
_MEASURES = "round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value"


@query(f"""WITH last AS (SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
g AS (SELECT user_id, count(*) AS event_count, count(DISTINCT event_id) AS distinct_events, min(ts) AS first_time, max(ts) AS last_time, {_COUNTS}, {_MEASURES} FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT g.*, last.event_type AS latest_event_type, last.value AS latest_value, last.event_id AS latest_event_id FROM g JOIN last USING (user_id)""")
def entity_summary(events: DataFrame) -> DataFrame:
    return summary.entity_summary(events, "user_id", "ts", "event_id", "event_type", _TYPES, ["value"], ["ts", "event_id"], ["event_type", "value", "event_id"])


@query(f"SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS window_start, time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute' AS window_end, count(*) AS event_count, {_COUNTS}, {_MEASURES} FROM events GROUP BY 1, 2, 3")
def entity_windows_1m(events: DataFrame) -> DataFrame:
    return summary.entity_windows(events, "user_id", "ts", "1 minute", "event_type", _TYPES, ["value"])


@query(f"SELECT 'all_machines' AS fleet_scope, count(*) AS event_count, count(DISTINCT event_id) AS distinct_events, count(DISTINCT user_id) AS entities, min(ts) AS first_time, max(ts) AS last_time, {_COUNTS}, {_MEASURES} FROM events")
def fleet_summary(events: DataFrame) -> DataFrame:
    return summary.fleet_summary(events, "all_machines", "user_id", "event_id", "ts", "event_type", _TYPES, ["value"])


@query(f"SELECT 'none' AS fleet_scope, count(*) AS event_count, count(DISTINCT event_id) AS distinct_events, count(DISTINCT user_id) AS entities, min(ts) AS first_time, max(ts) AS last_time, {_COUNTS}, {_MEASURES} FROM events WHERE event_id < 0")
def fleet_summary_empty(events: DataFrame) -> DataFrame:
    return summary.fleet_summary(events.where("event_id < 0"), "none", "user_id", "event_id", "ts", "event_type", _TYPES, ["value"])


@query("SELECT v.category, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('never')) v(category) LEFT JOIN events e ON e.event_type = v.category GROUP BY 1")
def category_counts_zero_filled(events: DataFrame) -> DataFrame:
    return summary.zero_filled_counts(events, "event_type", [*_TYPES, "never"])


@query("SELECT user_id, count(DISTINCT event_type) AS categories FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def mixed_category_entities(events: DataFrame) -> DataFrame:
    return summary.mixed_category_entities(events, "user_id", "event_type")


@query("SELECT count(*) AS duplicate_groups FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_grain(lineitem: DataFrame) -> DataFrame:
    return summary.duplicate_grain(lineitem, ["l_orderkey", "l_linenumber"])


_KEYS = ["l_orderkey", "l_linenumber"]
_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_RANK = f"row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' ASC NULLS LAST' for c in _ORDER)})"


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in _ORDER]


@query(f"SELECT * FROM lineitem QUALIFY {_RANK} = 1")
def dedup_canonical(lineitem: DataFrame) -> DataFrame:
    return dedup.canonical(lineitem, _KEYS, _order())


@query(f"""WITH r AS (SELECT *, {_RANK} AS duplicate_rank FROM lineitem)
SELECT d.*, c.l_shipdate AS canonical_l_shipdate, c.l_partkey AS canonical_l_partkey FROM r d JOIN r c ON c.l_orderkey = d.l_orderkey AND c.l_linenumber = d.l_linenumber AND c.duplicate_rank = 1 WHERE d.duplicate_rank > 1""")
def dedup_audit(lineitem: DataFrame) -> DataFrame:
    out = dedup.audit(lineitem, _KEYS, _order(), ["l_shipdate", "l_partkey"])
    return out.withColumn("duplicate_rank", F.col("duplicate_rank").cast("bigint"))


@query("""WITH k AS (SELECT count(*) AS c FROM (SELECT 1 FROM lineitem WHERE NOT l_quantity > 45 GROUP BY l_orderkey, l_linenumber)),
n AS (SELECT count(*) AS b, count(*) FILTER (WHERE l_quantity > 45) AS q FROM lineitem)
SELECT b AS bronze_rows, q AS quarantined_rows, b - q AS valid_rows, c AS canonical_rows, b - q - c AS duplicate_rows, true AS holds FROM n, k""")
def accounting(lineitem: DataFrame) -> DataFrame:
    return dedup.accounting(lineitem, _KEYS, F.col("l_quantity") > 45)


@query("SELECT count(*) AS overlapping FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 30) a JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 20) b USING (l_orderkey, l_linenumber, l_partkey)")
def coordinate_overlap(lineitem: DataFrame) -> DataFrame:
    return dedup.overlap(lineitem.where("l_quantity < 30"), lineitem.where("l_quantity > 20"), [*_KEYS, "l_partkey"])


@query("WITH s AS (SELECT user_id, count(*) AS event_count, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS a, count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS b FROM events GROUP BY 1) SELECT * FROM s WHERE event_count IS DISTINCT FROM a + b")
def reconciliation_gaps(events: DataFrame) -> DataFrame:
    s = events.groupBy("user_id").agg(F.count("*").alias("event_count"), F.count_if(F.col("event_type").isin("click", "view")).alias("a"), F.count_if(F.col("event_type").isin("error", "purchase")).alias("b"))
    return summary.reconciliation_gaps(s, "event_count", ["a", "b"])


#: The same text in both engines: an event as a telemetry payload, spoilt in one way for most remainders of its id.
_BASE = (
    "'{\"schema_version\":\"1.0\",\"event_id\":\"00000000-0000-4000-8000-' || lpad(cast(event_id as string), 12, '0') || '\",\"machine_code\":\"MCH-' || lpad(cast(user_id % 100 + 1 as string), 4, '0') || '\",\"sequence_number\":7,"
    '"event_time":"2024-01-01T00:00:00.25Z","source":"synthetic_simulator","product_quality_type":"M","air_temperature_k":300.0,"process_temperature_k":310.0,"rotational_speed_rpm":1500,"torque_nm":40.0,"tool_wear_min":10,"vibration_mm_s":2.0,"pressure_bar":6.0}\''
)
_SPOILT = {
    1: "'{\"schema_version\":\"1.0\"'",
    2: "replace({b}, '\"machine_code\":\"MCH-', '\"machine_code\":\"MCX-')",
    3: "replace({b}, '\"torque_nm\":40.0', '\"torque_nm\":99.0')",
    4: "replace({b}, ':1500', ':\"1500\"')",
    5: "replace({b}, '\"tool_wear_min\":10', '\"tool_wear_min\":10.5')",
    6: "replace({b}, ',\"pressure_bar\":6.0', '')",
    7: "replace({b}, '\"torque_nm\"', '\"extra\":1,\"torque_nm\"')",
    8: "replace(replace({b}, '300.0', '305.5'), '310.0', '305.0')",
    10: "replace({b}, '.25Z', '.25')",
    11: "replace({b}, '\"M\"', '\"X\"')",
    12: "'[1]'",
    13: "replace({b}, '\"sequence_number\":7', '\"sequence_number\":0')",
    14: "CAST(NULL AS string)",
    15: "replace({b}, '\"1.0\"', '\"2.0\"')",
}
_RAW = "CASE event_id % 17 " + " ".join(f"WHEN {k} THEN {v.replace("{b}", _BASE)}" for k, v in _SPOILT.items()) + f" ELSE {_BASE} END"
_KEY = "CASE WHEN event_id % 17 = 9 THEN 'MCH-0000' ELSE 'MCH-' || lpad(cast(user_id % 100 + 1 as string), 4, '0') END"


def _oracle_reasons(c: contract.Contract) -> str:
    """The contract's rules as DuckDB SQL over columns raw_value and the key columns."""
    quote = lambda s: s.replace("'", "''")
    got = lambda f: f"json_extract_string(safe, '$.{f}')"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}
    fields = {f.name: f for f in c.fields}

    def ok(f: contract.Field) -> str:
        token = f"trim(regexp_extract(raw_value, '\"{f.name}\"\\s*:\\s*([^,}}\\r\\n]+)', 1))"
        value = f"try_cast({got(f.name)} AS {kinds[f.type]})"
        parts = [f"regexp_matches({token}, '{quote(contract._TOKENS[f.kind])}')", f"{value} IS NOT NULL"]
        if f.pattern:
            parts.append(f"regexp_matches({got(f.name)}, '{quote(f.pattern)}')")
        if f.choices:
            parts.append(f"{got(f.name)} IN ({', '.join(map(repr, f.choices))})")
        if f.least is not None:
            parts.append(f"{value} >= {f.least}")
        if f.most is not None:
            parts.append(f"{value} <= {f.most}")
        if f.is_time:
            parts.append(f"try_cast(replace({got(f.name)}, 'Z', '') AS TIMESTAMP) IS NOT NULL")
        return "coalesce(" + " AND ".join(parts) + ", false)"

    names = "[" + ", ".join(map(repr, fields)) + "]"
    rules = [("missing_required_field", f"NOT list_has_all(json_keys(safe), {names})"), ("unexpected_field", f"NOT list_has_all({names}, json_keys(safe))")]
    rules += [(f"invalid_{n}", f"NOT {ok(f)}") for n, f in fields.items()]
    rules += [(n, f"{ok(fields[lo])} AND {ok(fields[hi])} AND CAST({got(hi)} AS DOUBLE) <= CAST({got(lo)} AS DOUBLE)") for n, lo, hi in c.above]
    rules += [(n, f"{ok(fields[f])} AND {key} IS DISTINCT FROM {got(f)}") for n, key, f in c.keyed]
    found = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules)
    return f"CASE WHEN NOT coalesce(json_valid(raw_value) AND json_type(safe) = 'OBJECT', false) THEN ['malformed_json'] ELSE list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))) END"


_CHECKED = f"WITH b AS (SELECT event_id AS source_offset, {_KEY} AS kafka_key, {_RAW} AS raw_value FROM events), w AS (SELECT *, CASE WHEN json_valid(raw_value) THEN raw_value ELSE '{{}}' END AS safe FROM b), v AS (SELECT *, {_oracle_reasons(contract.TELEMETRY)} AS rejection_reasons FROM w)"


def _validated(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("event_id").alias("source_offset"), F.expr(_KEY).alias("kafka_key"), F.expr(_RAW).alias("raw_value"))
    return contract.TELEMETRY.validate(rows)


@query(_CHECKED + " SELECT source_offset, list_aggregate(rejection_reasons, 'string_agg', ',') AS reasons FROM v WHERE len(rejection_reasons) > 0")
def contract_quarantine(events: DataFrame) -> DataFrame:
    return contract.quarantine(_validated(events)).select("source_offset", F.concat_ws(",", "rejection_reasons").alias("reasons"))


@query(_CHECKED + " SELECT source_offset, json_extract_string(safe, '$.machine_code') AS machine_code, CAST(json_extract_string(safe, '$.torque_nm') AS DOUBLE) AS torque_nm, CAST(json_extract_string(safe, '$.tool_wear_min') AS INTEGER) AS tool_wear_min FROM v WHERE len(rejection_reasons) = 0")
def contract_valid(events: DataFrame) -> DataFrame:
    return contract.valid_rows(_validated(events)).select("source_offset", "parsed.machine_code", "parsed.torque_nm", "parsed.tool_wear_min")


@query(_CHECKED + " SELECT reason, count(*) AS n FROM (SELECT unnest(rejection_reasons) AS reason FROM v) GROUP BY 1")
def quarantine_counts(events: DataFrame) -> DataFrame:
    return summary.exploded_counts(_validated(events), "rejection_reasons")


@query("SELECT event_id AS source_offset, CAST(user_id % 3 AS INTEGER) AS source_partition, props AS raw_value, sha256(props) AS payload_sha256 FROM events")
def lineage_projection(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("source_offset"), (F.col("user_id") % 3).cast("int").alias("source_partition"), F.col("props").alias("raw_value"), F.sha2("props", 256).alias("payload_sha256"))


@query("SELECT event_id, event_type AS category, value AS reading, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 'v1' AS adapter_version, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS event_time FROM events")
def nested_export(events: DataFrame) -> DataFrame:
    nested = events.select("event_id", "ts", F.struct(F.col("event_type").alias("Type"), F.col("value").alias("Value [u]"), F.from_json("props", "k int")["k"].cast("double").alias("K [n]")).alias("model_input"), F.lit("v1").alias("adapter_version"))
    return nested.select("event_id", F.col("model_input.Type").alias("category"), F.col("model_input.`Value [u]`").alias("reading"), F.col("model_input.`K [n]`").alias("k"), "adapter_version", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"))


@query("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (SELECT concat_ws('|', n_nationkey, n_name, n_regionkey) AS line FROM nation)")
def table_digest(nation: DataFrame) -> DataFrame:
    return summary.table_digest(nation, ["n_nationkey", "n_name", "n_regionkey"])


@query("SELECT CAST(user_id % 3 AS INTEGER) AS source_partition, count(*) AS n, min(event_id) AS first_offset, max(event_id) AS last_offset, count(DISTINCT sha256(props)) AS distinct_payloads, count(DISTINCT user_id) AS entities FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def bronze_inspect(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("event_type").isin("click", "view"))
    return rows.groupBy((F.col("user_id") % 3).cast("int").alias("source_partition")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_offset"), F.max("event_id").alias("last_offset"), F.count_distinct(F.sha2("props", 256)).alias("distinct_payloads"), F.count_distinct("user_id").alias("entities"))


@query("SELECT e.event_id, e.value FROM events e JOIN (VALUES (CAST(5 AS BIGINT), 'view'), (17, 'click'), (400, 'error'), (401, 'purchase')) w(event_id, event_type) ON e.event_id = w.event_id AND e.event_type = w.event_type")
def coordinates_semi(spark, events: DataFrame) -> DataFrame:
    wanted = spark.createDataFrame([(5, "view"), (17, "click"), (400, "error"), (401, "purchase")], "event_id bigint, event_type string")
    return events.join(F.broadcast(wanted), ["event_id", "event_type"], "left_semi").select("event_id", "value")


@query("SELECT feature, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1")
def feature_statistics(lineitem: DataFrame) -> DataFrame:
    return summary.feature_statistics(lineitem, ["l_quantity", "l_discount"])


@query("SELECT l_orderkey, l_linenumber, list_aggregate(list_filter([CASE WHEN l_discount > 0.08 THEN 'ck_discount' END, CASE WHEN l_quantity < 3 THEN 'ck_quantity' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS violations, l_partkey FROM lineitem WHERE l_discount > 0.08 OR l_quantity < 3")
def check_constraints(lineitem: DataFrame) -> DataFrame:
    got = contract.check_columns(lineitem, [("ck_discount", F.col("l_discount") <= 0.08), ("ck_quantity", F.col("l_quantity") >= 3)])
    return got.where(F.size("violations") > 0).select("l_orderkey", "l_linenumber", F.concat_ws(",", "violations").alias("violations"), "l_partkey")


@query("SELECT 'MCH-' || lpad(CAST(id AS VARCHAR), 4, '0') AS machine_code, CASE WHEN id % 10 = 0 THEN 'maintenance' WHEN id > 95 THEN 'inactive' ELSE 'active' END AS status, CASE id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'H' END AS quality, CAST(DATE '2020-01-01' + CAST(id * 7 AS INTEGER) AS VARCHAR) AS installed_on FROM range(1, 101) t(id)")
def seed_fleet(spark) -> DataFrame:
    i = F.col("id")
    status = F.when(i % 10 == 0, "maintenance").when(i > 95, "inactive").otherwise("active")
    quality = F.when(i % 3 == 0, "L").when(i % 3 == 1, "M").otherwise("H")
    return spark.range(1, 101).select(F.concat(F.lit("MCH-"), F.lpad(i.cast("string"), 4, "0")).alias("machine_code"), status.alias("status"), quality.alias("quality"), F.date_add(F.lit("2020-01-01").cast("date"), (i * 7).cast("int")).cast("string").alias("installed_on"))


@query(f"SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_entity(events: DataFrame) -> DataFrame:
    return dedup.latest(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type", "value")


@query("SELECT 'MCH-' || lpad(CAST(m AS VARCHAR), 4, '0') AS machine_code, CAST(100 AS BIGINT) AS events, CAST(1 AS BIGINT) AS first_number, CAST(100 AS BIGINT) AS last_number, CAST(0 AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS foreign_ids, '2024-01-01T00:08:15.000Z' AS last_time FROM range(1, 11) t(m)")
def simulated_telemetry(spark) -> DataFrame:
    """What the contract and the recomputed ids say about simulated events, per machine."""
    sent = simulator.as_json(simulator.events(spark, 10, 100)).select(F.col("key").alias("kafka_key"), F.col("value").alias("raw_value"))
    judged = contract.TELEMETRY.validate(sent)
    p = lambda c: F.col(f"parsed.{c}")
    own = simulator.event_id(p("machine_code"), p("sequence_number"), p("event_time"))
    return judged.groupBy(p("machine_code").alias("machine_code")).agg(
        F.count("*").alias("events"), F.min(p("sequence_number")).alias("first_number"), F.max(p("sequence_number")).alias("last_number"),
        F.count_if(F.size("rejection_reasons") > 0).alias("rejected"), F.count_if(~p("event_id").eqNullSafe(own)).alias("foreign_ids"), F.max(p("event_time")).alias("last_time"),
    )


_NAME = "'1.0|MCH-' || lpad(CAST(user_id % 100 + 1 AS VARCHAR), 4, '0') || '|' || event_id || '|2024-01-01T00:00:00.000Z'"


@query(f"""WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({_NAME})) AS d FROM events)
SELECT event_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || CASE CAST('0x' || substr(d, 17, 1) AS INTEGER) & 3 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS uuid FROM h""")
def event_identity(events: DataFrame) -> DataFrame:
    code = F.concat(F.lit("MCH-"), F.lpad((F.col("user_id") % 100 + 1).cast("string"), 4, "0"))
    return events.select("event_id", simulator.event_id(code, F.col("event_id"), F.lit("2024-01-01T00:00:00.000Z")).alias("uuid"))


@query("SELECT event_id AS kafka_offset, CAST(user_id AS VARCHAR) AS kafka_key, props AS raw_value, sha256(props) AS payload_sha256 FROM events")
def bronze_projection(events: DataFrame) -> DataFrame:
    log = events.select(F.lit("telemetry").alias("topic"), (F.col("user_id") % 3).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"))
    return bronze.bronze(log).select("kafka_offset", "kafka_key", "raw_value", "payload_sha256")
