"""Serving, merge and alert queries (customers as machines, orders as their history, line items as findings)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import dedup, merge
from tidemark.operators import serving as s
from tidemark.plans.registry import registry

QUERIES, SQL, query = registry()


@query("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 25 OFFSET 50")
def page_history(orders: DataFrame) -> DataFrame:
    rows = s.filtered(orders, {"o_orderstatus": "F", "o_orderpriority": None}, [F.col("o_totalprice") > 100000])
    return s.page(rows.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), [F.desc_nulls_last("o_orderdate"), F.desc_nulls_last("o_totalprice"), F.desc("o_orderkey")], 25, 50)


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def page_total(orders: DataFrame) -> DataFrame:
    return s.filtered(orders, {"o_orderstatus": "F"}, [F.col("o_totalprice") > 100000]).agg(F.count("*").alias("total"))


@query("SELECT c_custkey, c_name, n_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def entity_detail_counts(customer: DataFrame, nation: DataFrame, orders: DataFrame) -> DataFrame:
    rows = customer.join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"], "left").select("c_custkey", "c_name", "n_name")
    return s.detail_counts(rows, "c_custkey", {"n_orders": (orders, "o_custkey"), "n_open": (orders.where("o_orderstatus = 'O'"), "o_custkey")})


@query("""SELECT (SELECT count(*) FROM customer) AS machines, (SELECT count(*) FROM customer WHERE (c_acctbal > 0) IS TRUE) AS healthy, (SELECT count(*) FROM customer WHERE (c_acctbal > 0) IS FALSE) AS unhealthy,
(SELECT count(*) FROM orders) AS predictions, (SELECT round(avg(o_totalprice), 4) FROM orders) AS avg_price, (SELECT max(o_totalprice) FROM orders) AS max_price, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS flagged, (SELECT max(o_orderstatus) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)) AS latest_status""")
def overview_scalars(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    good = F.col("c_acctbal") > 0
    a = customer.agg(F.count("*").alias("machines"), F.count_if(good.eqNullSafe(True)).alias("healthy"), F.count_if(good.eqNullSafe(False)).alias("unhealthy"))
    b = orders.agg(F.count("*").alias("predictions"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.max("o_totalprice").alias("max_price"), F.max_by("o_orderstatus", "o_orderkey").alias("latest_status"))
    c = lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("flagged"))
    return a.join(b).join(c)  # one row each


@query("""SELECT o_orderkey, c_name, CASE WHEN o_orderstatus = 'F' THEN 'prediction' WHEN s_suppkey IS NOT NULL THEN 'anomaly' ELSE 'unknown' END AS source_kind, coalesce(CAST(s_suppkey AS BIGINT), o_custkey) AS source_id, coalesce(shipped, o_orderdate) AS seen_at
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s, max(l_shipdate) AS shipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = s
ORDER BY coalesce(shipped, o_orderdate) DESC, o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def alert_listing(orders: DataFrame, customer: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    found = lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.max("l_shipdate").alias("shipped"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(found, orders["o_orderkey"] == found["l_orderkey"], "left").join(supplier, F.col("s") == supplier["s_suppkey"], "left")
    kind = F.when(F.col("o_orderstatus") == "F", "prediction").when(F.col("s_suppkey").isNotNull(), "anomaly").otherwise("unknown")
    seen = F.coalesce("shipped", "o_orderdate")
    out = rows.select("o_orderkey", "c_name", kind.alias("source_kind"), F.coalesce("s_suppkey", "o_custkey").alias("source_id"), seen.alias("seen_at"), "o_orderdate")
    return out.orderBy(F.desc("seen_at"), F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).drop("o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderstatus, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 7 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC LIMIT 1")
def explanation_lookup(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    rows = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).join(customer.where("c_custkey = 7"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice")).limit(1).select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderstatus", "c_name")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def orphans(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return dedup.orphans(orders.select("o_custkey", "o_orderkey"), customer.where("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, n_name FROM nation n WHERE n_regionkey > 1 AND NOT EXISTS (SELECT 1 FROM nation t WHERE t.n_regionkey < 3 AND t.n_nationkey = n.n_nationkey)")
def insert_if_absent(nation: DataFrame) -> DataFrame:
    cols = ["n_nationkey", "n_name"]
    return merge.merged(nation.where("n_regionkey < 3").select(cols), nation.where("n_regionkey > 1").select(cols), ["n_nationkey"])


_STAGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0"
_TARGET = "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0"


def _target(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "o_totalprice", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus")


def _staged(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus")


@query(f"WITH t AS ({_TARGET}), s AS ({_STAGED}) SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'new' WHEN s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus THEN 'reused' ELSE 'conflict' END AS state FROM s LEFT JOIN t USING (o_orderkey)")
def merge_classify(orders: DataFrame) -> DataFrame:
    return merge.classify(_target(orders), _staged(orders), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query(f"WITH t AS ({_TARGET}), s AS ({_STAGED}) SELECT * FROM t UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey)")
def merge_result(orders: DataFrame) -> DataFrame:
    return merge.merged(_target(orders), _staged(orders), ["o_orderkey"])


@query("SELECT user_id, ts, event_id, value FROM (SELECT * FROM (SELECT * FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) UNION ALL SELECT * FROM events WHERE event_id % 2 = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_upsert(events: DataFrame) -> DataFrame:
    cols, order = ["user_id", "ts", "event_id", "value"], ["ts", "event_id"]
    target = dedup.latest(events.where("event_id % 2 = 0").select(cols), ["user_id"], order)
    return merge.upsert_latest(target, events.where("event_id % 2 = 1").select(cols), ["user_id"], order)


@query("SELECT 'model' AS alert_type, o_orderkey AS source_id, 'open' AS status FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT 'anomaly', event_id, 'open' FROM events WHERE event_type = 'error'")
def alert_materialise(orders: DataFrame, events: DataFrame) -> DataFrame:
    return merge.alerts([("model", orders.withColumn("flag", F.when(F.col("o_totalprice") > 450000, "t").otherwise("f")), "o_orderkey", "flag"), ("anomaly", events.withColumn("flag", F.col("event_type") == "error"), "event_id", "flag")])


@query("SELECT o_custkey, to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderdate, o_orderkey))::VARCHAR AS items FROM orders GROUP BY 1")
def ordered_json_agg(orders: DataFrame) -> DataFrame:
    got = s.ordered_lists(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return got.select("o_custkey", F.coalesce(F.to_json("items"), F.lit("[]")).alias("items"))


@query("SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def cardinalities(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, events: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in (("customer", customer), ("orders", orders), ("lineitem", lineitem), ("events", events))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT c_custkey, c_name, max(CASE WHEN r = 1 THEN o_orderkey END) AS latest_order, count(*) FILTER (WHERE r <= 3 AND o_orderstatus = 'O') AS recent_open FROM customer JOIN o ON o_custkey = c_custkey GROUP BY 1, 2""")
def entity_snapshot(customer: DataFrame, orders: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    top = orders.withColumn("r", r).where("r <= 3").groupBy("o_custkey").agg(F.max(F.when(F.col("r") == 1, F.col("o_orderkey"))).alias("latest_order"), F.count_if(F.col("o_orderstatus") == "O").alias("recent_open"))
    return customer.join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "latest_order", "recent_open")


@query("SELECT n_nationkey, 'missing' AS side FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, 'unexpected' FROM nation WHERE n_regionkey = 4")
def key_alignment(nation: DataFrame) -> DataFrame:
    return dedup.key_alignment(nation.where("n_regionkey < 4"), nation.where("n_regionkey > 0"), "n_nationkey")
