"""Reports, records and tools: whole layer reports, writes that refuse conflicts, bounded tools (on the driver's tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import dedup, drift, evaluation, inspection, profile, records, reports, summary, tools
from tidemark.plans.registry import registry
from tidemark.sources import tables
from tidemark.sources.scratch import fresh_path
from tidemark.streaming import bronze

QUERIES, SQL, query = registry()

_LAYER = """r AS (SELECT *, CASE WHEN l_quantity > 45 THEN 'too_many' END AS a, CASE WHEN l_discount > 0.09 THEN 'too_cheap' END AS b FROM lineitem),
q AS (SELECT *, list_filter([a, b], lambda x: x IS NOT NULL) AS reasons FROM r WHERE a IS NOT NULL OR b IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS duplicate_rank FROM r WHERE a IS NULL AND b IS NULL),
c AS (SELECT * FROM k WHERE duplicate_rank = 1), d AS (SELECT * FROM k WHERE duplicate_rank > 1)"""
_SAME = "JOIN {t} ON q.l_partkey IS NOT DISTINCT FROM {t}.l_partkey AND q.l_suppkey IS NOT DISTINCT FROM {t}.l_suppkey"


@query(f"""WITH {_LAYER} SELECT (SELECT count(*) FROM lineitem) AS raw_rows, (SELECT count(*) FROM c) AS canonical_rows, (SELECT count(DISTINCT l_orderkey) FROM c) AS distinct_ids, (SELECT count(*) FROM c WHERE l_orderkey IS NULL) AS null_ids,
(SELECT count(*) FROM c WHERE l_suppkey IS NULL) AS null_entities, (SELECT count(DISTINCT l_suppkey) FROM c) AS entities, (SELECT min(l_shipdate) FROM c) AS first_time, (SELECT max(l_shipdate) FROM c) AS last_time, (SELECT count(*) FROM c WHERE l_partkey IS NULL) AS null_l_partkey, (SELECT count(*) FROM c WHERE l_suppkey IS NULL) AS null_l_suppkey,
(SELECT count(*) FROM (SELECT l_orderkey FROM c GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM d) AS duplicate_rows, (SELECT coalesce(max(duplicate_rank), 0) FROM d) AS max_duplicate_rank, (SELECT count(*) FROM q) AS quarantined_rows,
(SELECT coalesce(string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag), '') FROM (SELECT l_returnflag, count(*) AS n FROM c GROUP BY 1)) AS kind_counts, (SELECT coalesce(string_agg(x || '=' || n, ',' ORDER BY x), '') FROM (SELECT x, count(*) AS n FROM (SELECT unnest(reasons) AS x FROM q) GROUP BY 1)) AS reason_counts,
(SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM q) q {_SAME.format(t='cc')}) AS quarantined_and_canonical, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM q) q {_SAME.format(t='dd')}) AS quarantined_and_duplicate,
(SELECT count(*) FROM k) AS valid_rows, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM k) + (SELECT count(*) FROM q) AS holds FROM (SELECT 1)""".replace("JOIN cc ON", "JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM c) cc ON").replace("JOIN dd ON", "JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM d) dd ON"))
def canonical_report(lineitem: DataFrame) -> DataFrame:
    why = F.filter(F.array(F.when(F.col("l_quantity") > 45, "too_many"), F.when(F.col("l_discount") > 0.09, "too_cheap")), lambda x: x.isNotNull())
    rows = lineitem.withColumn("reasons", why)
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    ranked = dedup.ranked(rows.where(F.size("reasons") == 0), ["l_orderkey"], order)
    out = reports.canonical_report(lineitem, ranked.where("duplicate_rank = 1"), ranked.where("duplicate_rank > 1"), rows.where(F.size("reasons") > 0), "l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", ["l_partkey", "l_suppkey"], "reasons")
    return out.drop("field_types")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("""WITH s AS (SELECT * FROM events), w AS (SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS b, count(*) AS n FROM s GROUP BY 1, 2), e AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s WHERE user_id IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(DISTINCT user_id) FROM s) AS source_entities, (SELECT min(ts) FROM s) AS first_time, (SELECT max(ts) FROM s) AS last_time, (SELECT count(*) FROM e) AS entity_rows, (SELECT count(DISTINCT user_id) FROM e) AS distinct_entities, (SELECT CAST(sum(n) AS BIGINT) FROM e) AS entity_events,
(SELECT count(*) FROM e JOIN (SELECT user_id, count(*) AS k FROM s WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1) t USING (user_id) WHERE k <> n) AS entity_kind_mismatches, (SELECT count(*) FROM s WHERE isnan(value)) AS odd_entity_numbers, (SELECT count(*) FROM w) AS window_rows, (SELECT CAST(sum(n) AS BIGINT) FROM w) AS window_events,
(SELECT count(*) FROM s WHERE event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')) AS window_kind_mismatches, (SELECT count(*) FROM s WHERE isnan(value)) AS odd_window_numbers, (SELECT count(*) FROM (SELECT count(*) FROM s)) AS fleet_rows, (SELECT count(*) FROM s) AS fleet_events, (SELECT count(DISTINCT user_id) FROM s) AS fleet_entities,
(SELECT count(*) FROM s WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view')) AS fleet_kind_sum, (SELECT count(*) FROM s WHERE isnan(value)) AS odd_fleet_numbers, (SELECT count(*) FROM e WHERE user_id % 7 = 0) AS entity_count_mismatches,
(SELECT count(*) FROM e WHERE user_id % 5 = 0) AS latest_mismatches, (SELECT count(*) FROM e WHERE kinds > 1) AS entities_of_several_kinds, (SELECT count(*) FROM (SELECT user_id FROM e GROUP BY 1 HAVING count(*) > 1)) AS repeated_entities, (SELECT count(*) FROM (SELECT user_id, b FROM w GROUP BY 1, 2 HAVING count(*) > 1)) AS repeated_windows,
(SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM s GROUP BY 1)) AS kind_counts, (SELECT sum(n) FROM w) <> (SELECT count(*) FROM s) AS window_event_mismatch, CAST(1 AS INTEGER) AS excluded_fields""")
def summary_report(events: DataFrame) -> DataFrame:
    """Summaries, some of whose counts and latest ids were spoilt, against the events."""
    entities = summary.entity_summary(events, "user_id", "ts", "event_id", "event_type", _TYPES, ["value"], ["ts", "event_id"], ["event_id"])
    spoilt = entities.withColumn("latest_event_id", F.when(F.col("user_id") % 5 == 0, -1).otherwise(F.col("latest_event_id")))
    windows = summary.entity_windows(events, "user_id", "ts", "1 minute", "event_type", _TYPES, ["value"])
    fleet = summary.fleet_summary(events, "all", "user_id", "event_id", "ts", "event_type", _TYPES, ["value"])
    truth = events.unionByName(events.where("user_id % 7 = 0").groupBy("user_id").agg(*(F.min(c).alias(c) for c in events.columns if c != "user_id")).select(events.columns))
    out = reports.summary_report(truth, spoilt, windows, fleet, "user_id", "ts", "event_type", _TYPES, "event_id", ["ts", "event_id"], ["latest_event_id", "value"])
    plain = reports.summary_report(events, spoilt, windows, fleet, "user_id", "ts", "event_type", _TYPES, "event_id", ["ts", "event_id"], ["latest_event_id", "value"])
    changed = out.select("entity_count_mismatches")
    return plain.drop("entity_count_mismatches", "fleet_event_mismatch", "fleet_entity_mismatch", "fleet_kind_mismatch").join(changed)


_NULLED = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'nan'::DOUBLE ELSE value END AS value FROM events"


def _nulled(events: DataFrame) -> DataFrame:
    value = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, float("nan")).otherwise(F.col("value"))
    return events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), value.alias("value"))


_NULLS = f"SELECT 'event_id' AS feature, 'bigint' AS type, count(*) FILTER (WHERE event_id IS NULL) AS nulls, CAST(0 AS BIGINT) AS nans FROM t UNION ALL SELECT 'event_type', 'string', count(*) FILTER (WHERE event_type IS NULL), CAST(0 AS BIGINT) FROM t UNION ALL SELECT 'value', 'double', count(*) FILTER (WHERE value IS NULL), count(*) FILTER (WHERE isnan(value)) FROM t"


@query(f"WITH t AS ({_NULLED}) {_NULLS}")
def null_counts(events: DataFrame) -> DataFrame:
    return reports.null_counts(_nulled(events))


@query(f"WITH t AS ({_NULLED}), n AS ({_NULLS}) SELECT 'nulls' AS section, feature AS name, CAST(nulls AS VARCHAR) AS value FROM n UNION ALL SELECT 'kinds', event_type, CAST(count(*) AS VARCHAR) FROM t GROUP BY 2")
def stacked_report(events: DataFrame) -> DataFrame:
    rows = _nulled(events)
    kinds = rows.groupBy("event_type").agg(F.count("*").alias("nulls")).withColumnRenamed("event_type", "feature")
    return reports.stacked({"nulls": reports.null_counts(rows), "kinds": kinds}, "feature", "nulls")


@query("SELECT count(*) AS n, sha256('[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_regionkey, n_nationkey) || ']') AS ids_sha256, sha256('[' || string_agg('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}', ',' ORDER BY n_regionkey, n_nationkey) || ']') AS features_sha256 FROM nation")
def identity_hashes(nation: DataFrame) -> DataFrame:
    return reports.identity_hashes(nation, "n_nationkey", ["n_regionkey", "n_nationkey"], ["n_name"])


@query("SELECT l_returnflag AS scope, 'line' || l_linenumber AS feature, round(avg(l_discount), 3) AS psi, CAST(row_number() OVER (ORDER BY l_returnflag, round(avg(l_discount), 3) DESC, 'line' || l_linenumber) AS INTEGER) AS place FROM lineitem GROUP BY 1, 2")
def drift_latest(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.groupBy(F.col("l_returnflag").alias("scope"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("feature")).agg(F.round(F.avg("l_discount"), 3).alias("psi"))
    return reports.worst_first(rows, "scope", "psi", "feature")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-01-01'")
def future_dates(orders: DataFrame) -> DataFrame:
    return reports.in_future(orders, "o_orderdate", F.lit("1997-01-01").cast("date")).select("o_orderkey")


@query("SELECT event_id AS id, value AS reading, event_type AS kind FROM events")
def mapped_fields(events: DataFrame) -> DataFrame:
    return records.mapped(events, {"event_id": "id", "event_type": "kind", "value": "reading"}, ["id", "reading", "kind"])


@query("SELECT l_orderkey AS source_id, l_quantity, l_discount, l_returnflag FROM lineitem")
def modelling_rows(lineitem: DataFrame) -> DataFrame:
    return records.modelling_rows(lineitem, "l_orderkey", "source_id", ["l_quantity", "l_discount"], "l_returnflag", ["l_tax", "l_linestatus"])


@query("SELECT doc_id, quality FROM labels")
def concatenated_splits(labels: DataFrame) -> DataFrame:
    rows = labels.select("doc_id", "quality").dropDuplicates(["doc_id"])
    split = evaluation.stratified_split(rows, "quality", [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")], [("train", 0.7), ("validation", 0.15), ("test", 0.15)])
    return records.concatenated([split.where(F.col("split") == s).select("doc_id", "quality") for s in ("train", "validation", "test")], "doc_id")


@query("SELECT step, CASE step WHEN 1 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) WHEN 2 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0) ELSE 0 END AS new, CASE step WHEN 1 THEN 0 WHEN 2 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0) WHEN 3 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) ELSE 0 END AS reused, step = 4 AS refused, CASE step WHEN 1 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) ELSE (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) END AS table_rows FROM range(1, 5) t(step)")
def written_once(spark, orders: DataFrame) -> DataFrame:
    """Four writes to one table: new rows, an overlap, the same again, and one that contradicts it."""
    path = fresh_path(spark, "orders")
    rows = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    some, half = rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0")
    done = []
    for step, staged in enumerate((some, half, half, half.withColumn("o_totalprice", F.col("o_totalprice") + 1)), 1):
        try:
            counts = records.written_once(spark, path, staged, ["o_orderkey"])
            refused = False
        except records.MergeConflict:
            counts, refused = {"new": 0, "reused": 0}, True
        done.append((step, counts["new"], counts["reused"], refused, spark.read.parquet(path).count()))
    return spark.createDataFrame(done, "step bigint, new bigint, reused bigint, refused boolean, table_rows bigint")


@query("""WITH a AS (SELECT event_id AS source_id, CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'warning' END AS severity, 'high value' AS title FROM events WHERE event_id % 2 = 0), c AS (SELECT event_id AS source_id, 'warning' AS severity, 'high value' AS title FROM events WHERE event_id % 3 = 0)
SELECT c.source_id, CASE WHEN a.source_id IS NULL THEN 'create' WHEN a.severity = c.severity AND a.title = c.title THEN 'reuse' ELSE 'conflict' END AS action FROM c LEFT JOIN a USING (source_id)""")
def alert_actions(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("event_id") % 5 == 0, "critical").otherwise("warning")
    made = lambda rows, s: rows.select(F.col("event_id").alias("source_id"), s.alias("severity"), F.lit("high value").alias("title"))
    return records.alert_actions(made(events.where("event_id % 2 = 0"), severity), made(events.where("event_id % 3 = 0"), F.lit("warning")), ["source_id"], ["severity", "title"])


_ALERTS = """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'fatal' WHEN event_id % 13 = 1 THEN NULL ELSE 'info' END AS severity, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE 'model' END AS alert_type, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'title' END AS title, CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' WHEN 3 THEN 'closed' ELSE 'open' END AS status,
ts AS created_at, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN ts + INTERVAL 1 HOUR ELSE ts - INTERVAL 1 HOUR END AS acknowledged_at, CASE WHEN event_id % 4 < 2 THEN NULL WHEN event_id % 4 = 2 THEN ts + INTERVAL 30 MINUTE ELSE ts - INTERVAL 2 HOUR END AS resolved_at FROM events"""
_RULES = {
    "ck_alerts_severity": "severity IN ('info', 'warning', 'critical')",
    "ck_alerts_type_not_blank": "trim(alert_type) <> ''",
    "ck_alerts_title_not_blank": "trim(title) <> ''",
    "ck_alerts_status": "status IN ('open', 'acknowledged', 'resolved')",
    "ck_alerts_acknowledged_after_created": "acknowledged_at IS NULL OR acknowledged_at >= created_at",
    "ck_alerts_resolved_after_created": "resolved_at IS NULL OR resolved_at >= created_at",
    "ck_alerts_resolved_after_acknowledged": "acknowledged_at IS NULL OR resolved_at IS NULL OR resolved_at >= acknowledged_at",
    "ck_alerts_status_timestamp_consistency": "(status = 'open' AND acknowledged_at IS NULL AND resolved_at IS NULL) OR (status = 'acknowledged' AND acknowledged_at IS NOT NULL AND resolved_at IS NULL) OR (status = 'resolved' AND resolved_at IS NOT NULL)",
}


@query(f"WITH a AS ({_ALERTS}) SELECT event_id, list_aggregate(list_sort(list_filter([{', '.join(f'CASE WHEN NOT ({c}) THEN {n!r} END' for n, c in _RULES.items())}], lambda x: x IS NOT NULL)), 'string_agg', ',') AS violations FROM a WHERE {' OR '.join(f'NOT ({c})' for c in _RULES.values())}")
def alert_violations(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    at = lambda **k: F.col("ts") + F.make_dt_interval(**{n: F.lit(v) for n, v in k.items()})
    rows = events.select(
        "event_id",
        F.when(e % 13 == 0, "fatal").when(e % 13 != 1, "info").alias("severity"),
        F.when(e % 17 == 0, "  ").otherwise("model").alias("alert_type"),
        F.when(e % 19 == 0, "").otherwise("title").alias("title"),
        F.when(e % 5 == 1, "acknowledged").when(e % 5 == 2, "resolved").when(e % 5 == 3, "closed").otherwise("open").alias("status"),
        F.col("ts").alias("created_at"),
        F.when(e % 3 == 1, at(hours=1)).when(e % 3 == 2, at(hours=-1)).alias("acknowledged_at"),
        F.when(e % 4 == 2, at(mins=30)).when(e % 4 == 3, at(hours=-2)).alias("resolved_at"),
    )
    found = records.alert_violations(rows).where(F.size("violations") > 0)
    return found.select("event_id", F.concat_ws(",", "violations").alias("violations"))


TOOLS = {
    "list_machines": tools.Tool(tools.listing("customer", ("c_custkey", "c_name", "c_mktsegment"), ("c_custkey",), ("c_mktsegment",)), {"limit": tools.limit, "c_mktsegment": tools.one_of("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")}),
    "machine_detail": tools.Tool(tools.detail("customer", "c_custkey", ("c_custkey", "c_name", "c_acctbal")), {"c_custkey": tools.whole}, ("c_custkey",)),
    "machine_history": tools.Tool(tools.listing("orders", ("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), ("o_orderdate", "o_orderkey"), ("o_custkey", "o_orderstatus")), {"limit": tools.limit, "o_custkey": tools.whole, "o_orderstatus": tools.one_of("O", "F", "P")}, ("o_custkey",)),
    "machine_snapshot": tools.Tool(
        tools.snapshot("customer", "c_custkey", ("c_custkey", "c_name"), {
            "latest_orders": ("orders", "o_custkey", ("o_orderkey", "o_orderstatus"), ("o_orderkey",), None, tools.SNAPSHOT_ROWS),
            "open_orders": ("orders", "o_custkey", ("o_orderkey",), ("o_orderkey",), "o_orderstatus = 'O'", tools.SNAPSHOT_ROWS),
        }), {"c_custkey": tools.whole}, ("c_custkey",)),
}


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20")
def tool_list(customer: DataFrame) -> DataFrame:
    return tools.call(TOOLS, "list_machines", {"customer": customer}, {"limit": 20, "c_mktsegment": "BUILDING"})


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey LIMIT 10")
def tool_history(orders: DataFrame) -> DataFrame:
    return tools.call(TOOLS, "machine_history", {"orders": orders}, {"o_custkey": 7})


@query("""SELECT c_custkey, c_name, (SELECT '[' || coalesce(string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey), '') || ']' FROM (SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 3)) AS latest_orders,
(SELECT '[' || coalesce(string_agg('{"o_orderkey":' || o_orderkey || '}', ',' ORDER BY o_orderkey), '') || ']' FROM (SELECT * FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 3)) AS open_orders FROM customer WHERE c_custkey = 7""")
def tool_snapshot(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return tools.call(TOOLS, "machine_snapshot", {"customer": customer, "orders": orders}, {"c_custkey": 7})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def tool_detail(customer: DataFrame) -> DataFrame:
    return tools.call(TOOLS, "machine_detail", {"customer": customer}, {"c_custkey": 7})


_EDGES = "(SELECT count(*) FROM events WHERE event_type = '{k}' AND event_id % 2 = {m}) / (SELECT count(*) FROM events WHERE event_id % 2 = {m})::DOUBLE"


@query(" UNION ALL ".join(f"SELECT '{k}' AS category, round({_EDGES.format(k=k, m=0)}, 6) AS reference, round({_EDGES.format(k=k, m=1)}, 6) AS current" for k in _TYPES))
def category_proportions(events: DataFrame) -> DataFrame:
    return drift.category_shares(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "event_type", _TYPES)


@query("SELECT a.o_orderkey, a.v AS adapted_value, s.o_orderstatus AS source_value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'O' WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS v FROM orders) a JOIN orders s USING (o_orderkey) WHERE a.v IS DISTINCT FROM s.o_orderstatus")
def type_mismatches(orders: DataFrame) -> DataFrame:
    """An adapter's rows whose kind is no longer the source's."""
    status = F.when(F.col("o_orderkey") % 11 == 0, "O").when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus"))
    return inspection.differing_values(orders.withColumn("o_orderstatus", status), orders, "o_orderkey", "o_orderstatus")


@query("""WITH t AS (SELECT o_custkey, o_orderdate AS d, o_totalprice AS p, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) = 1)
SELECT o.o_orderkey FROM orders o JOIN t USING (o_custkey) WHERE o.o_orderkey % 2 = 1 AND (o.o_orderdate > d OR (o.o_orderdate = d AND (o.o_totalprice > p OR (o.o_totalprice = p AND o.o_orderkey > k))))""")
def newer_rows(orders: DataFrame) -> DataFrame:
    """Staged rows that are newer than their entity's latest one by (date, price, key)."""
    order = ("o_orderdate", "o_totalprice", "o_orderkey")
    latest = orders.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.max(F.struct(*order)).alias("latest"))
    staged = orders.where("o_orderkey % 2 = 1").join(latest, "o_custkey")
    return staged.where(scalars.tuple_newer([F.col(c) for c in order], [F.col(f"latest.{c}") for c in order])).select("o_orderkey")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def document_array(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """A JSON array of documents with unique ids, written by one task (a table of fixed size) and read back."""
    path = fresh_path(spark, "documents")
    nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))).alias("value")).write.text(path)
    return tables.read_documents(spark, path, "n_nationkey int, n_name string, n_regionkey int", "n_nationkey")


@query("SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS input_rows FROM events")
def stream_progress(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """What a finished stream says of its batches."""
    rows = bronze.file_stream(spark, f"{sf_dir}/events.parquet*", events.schema, None)
    run = bronze.append(rows.select("event_id"), fresh_path(spark, "progress"), fresh_path(spark, "progress-checkpoint"))
    run.awaitTermination()
    return spark.createDataFrame(bronze.progress(run), "batch_id bigint, input_rows bigint")


_RAW = "SELECT CASE WHEN event_id % 17 = 0 THEN '1.5' ELSE CAST(event_id AS VARCHAR) END AS i, CASE event_id % 7 WHEN 0 THEN '2' WHEN 1 THEN ' ' ELSE CAST(event_id % 2 AS VARCHAR) END AS b, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS v FROM events"
_FIELD = "SELECT '{c}' AS feature, count(*) FILTER (WHERE coalesce(trim({c}), '') = '') AS empty, count(*) FILTER (WHERE trim({c}) <> '' AND NOT ({ok})) AS not_of_kind, min(try_cast({c} AS DOUBLE)) FILTER (WHERE {ok}) AS least, max(try_cast({c} AS DOUBLE)) FILTER (WHERE {ok}) AS greatest, count(*) FILTER (WHERE {ok} AND try_cast({c} AS DOUBLE) NOT BETWEEN {low} AND {high}) AS out_of_range FROM t"
_KINDS = (("i", "regexp_full_match(i, '[0-9]+')", 100, 5000), ("b", "b IN ('0', '1')", 0, 0), ("v", "try_cast(v AS DOUBLE) IS NOT NULL", 10, 90))


@query(f"WITH t AS ({_RAW}) " + " UNION ALL ".join(_FIELD.format(c=c, ok=ok, low=low, high=high) for c, ok, low, high in _KINDS))
def raw_fields(events: DataFrame) -> DataFrame:
    """Text fields that are empty, not of their kind or out of range."""
    n = F.col("event_id")
    rows = events.select(
        F.when(n % 17 == 0, "1.5").otherwise(n.cast("string")).alias("i"),
        F.when(n % 7 == 0, "2").when(n % 7 == 1, " ").otherwise((n % 2).cast("string")).alias("b"),
        F.when(n % 5 == 0, "n/a").when(n % 5 > 1, F.col("value").cast("string")).alias("v"),
    )
    return profile.raw_fields(rows, {"i": ("integer", 100, 5000), "b": ("binary", 0, 0), "v": ("number", 10, 90)})
