"""Profiling, drift, evaluation, sequence and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import drift, evaluation, modelling, profile, sequence
from tidemark.plans.registry import registry

QUERIES, SQL, query = registry()


@query("SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns, CAST(count(*) FILTER (WHERE o_orderkey IS NULL OR o_custkey IS NULL) AS BIGINT) AS n_nulls, count(DISTINCT o_orderkey) AS n_ids, CAST(0 AS BIGINT) AS duplicate_rows FROM orders")
def quality_profile(orders: DataFrame) -> DataFrame:
    return profile.quality(orders, "o_orderkey")


@query("SELECT v.value, count(o_orderkey) AS n, round(100.0 * count(o_orderkey) / (SELECT count(*) FROM orders), 6) AS percentage FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(value) LEFT JOIN orders ON o_orderstatus = v.value GROUP BY 1")
def value_distribution(orders: DataFrame) -> DataFrame:
    return profile.distribution(orders, "o_orderstatus", ["F", "O", "P", "X"])


@query("SELECT p AS positives, n AS negatives, round(100.0 * p / (p + n), 6) AS positive_percentage, round(CAST(p AS DOUBLE) / nullif(n, 0), 6) AS ratio, 100.0 * p / (p + n) < 10 AS imbalanced FROM (SELECT count(*) FILTER (WHERE quality = 0) AS p, count(*) FILTER (WHERE quality <> 0) AS n FROM labels)")
def class_balance(labels: DataFrame) -> DataFrame:
    return profile.class_balance(labels, F.col("quality") == 0)


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS positives, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS share, round(100.0 * count(*) FILTER (WHERE l_quantity > 40) / count(*), 6) AS rate FROM lineitem GROUP BY 1")
def type_rates(lineitem: DataFrame) -> DataFrame:
    return profile.group_rates(lineitem, "l_returnflag", F.col("l_quantity") > 40)


_FLAGS = (("hdf", "l_quantity > 40", lambda: F.col("l_quantity") > 40), ("pwf", "l_discount > 0.07", lambda: F.col("l_discount") > 0.07), ("osf", "l_tax < 0.02", lambda: F.col("l_tax") < 0.02))
_SUM = " + ".join(f"CAST({c} AS INTEGER)" for _, c, _ in _FLAGS)


@query(f"SELECT count(*) FILTER (WHERE a = 0) AS none, count(*) FILTER (WHERE a = 1) AS one, count(*) FILTER (WHERE a > 1) AS several FROM (SELECT {_SUM} AS a FROM lineitem)")
def flag_overlap(lineitem: DataFrame) -> DataFrame:
    return profile.flag_overlap(lineitem, [f() for _, _, f in _FLAGS])


@query(" UNION ALL ".join(f"SELECT '{n}' AS mode, count(*) FILTER (WHERE {c}) AS positives, round(100.0 * count(*) FILTER (WHERE {c}) / count(*), 6) AS of_rows, round(100.0 * count(*) FILTER (WHERE {c}) / count(*) FILTER (WHERE l_returnflag = 'R'), 6) AS of_target FROM lineitem" for n, c, _ in _FLAGS))
def failure_modes(lineitem: DataFrame) -> DataFrame:
    return profile.mode_counts(lineitem, F.col("l_returnflag") == "R", {n: f() for n, _, f in _FLAGS})


@query(f"SELECT count(*) FILTER (WHERE t AND f) AS both, count(*) FILTER (WHERE t AND NOT f) AS only_a, count(*) FILTER (WHERE NOT t AND f) AS only_b, count(*) FILTER (WHERE NOT t AND NOT f) AS neither FROM (SELECT l_returnflag = 'R' AS t, {_SUM} > 0 AS f FROM lineitem)")
def crosstab(lineitem: DataFrame) -> DataFrame:
    active = sum((f().cast("int") for _, _, f in _FLAGS), F.lit(0)) > 0
    return profile.crosstab(lineitem, F.col("l_returnflag") == "R", active)


_STATS = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max"
_LONG = "(SELECT 'l_quantity' AS feature, l_quantity AS x, l_returnflag FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice, l_returnflag FROM lineitem)"


@query(f"SELECT feature, {_STATS} FROM {_LONG} GROUP BY 1")
def describe(lineitem: DataFrame) -> DataFrame:
    return profile.describe(lineitem, ["l_quantity", "l_extendedprice"])


@query(f"SELECT l_returnflag, feature, {_STATS} FROM {_LONG} GROUP BY 1, 2")
def describe_by_target(lineitem: DataFrame) -> DataFrame:
    return profile.describe(lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :])


@query(_CORR)
def correlation_matrix(lineitem: DataFrame) -> DataFrame:
    return profile.correlations(lineitem, _NUM)


@query(f"SELECT CASE WHEN a = 'l_extendedprice' THEN b ELSE a END AS feature, r FROM ({_CORR}) WHERE a = 'l_extendedprice' OR b = 'l_extendedprice' ORDER BY abs(r) DESC, feature LIMIT 3")
def top_correlations(lineitem: DataFrame) -> DataFrame:
    return profile.strongest(profile.correlations(lineitem, _NUM), "l_extendedprice")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(coalesce(i, '')) = '') + count(*) FILTER (WHERE trim(coalesce(v, '')) = '') AS n_empty, count(i) - count(DISTINCT i) AS repeated_ids, count(*) FILTER (WHERE i IS NOT NULL AND try_cast(i AS BIGINT) IS NULL) AS bad_i, count(*) FILTER (WHERE v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS bad_v FROM (SELECT CAST(event_id AS VARCHAR) AS i, CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 9 = 1 THEN ' ' WHEN event_id % 9 > 2 THEN CAST(value AS VARCHAR) END AS v FROM events)")
def raw_contract(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("event_id").cast("string").alias("i"), F.when(F.col("event_id") % 9 == 0, "n/a").when(F.col("event_id") % 9 == 1, " ").when(F.col("event_id") % 9 > 2, F.col("value").cast("string")).alias("v"))
    return profile.raw_contract(rows, "i", {"i": "bigint", "v": "double"})


@query("SELECT id AS o_custkey FROM (SELECT unnest(range((SELECT min(c_custkey) FROM customer), (SELECT max(c_custkey) + 1 FROM customer))) AS id) WHERE id NOT IN (SELECT o_custkey FROM orders)")
def id_coverage(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Ids of the customers' whole range that no order has."""
    first, last = customer.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return profile.id_gaps(orders, "o_custkey", first if first is not None else 0, last if last is not None else -1)


_REF, _CUR = "event_id % 2 = 0", "event_id % 2 = 1"
_Q = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
_SIDES = f"r AS (SELECT value AS x FROM events WHERE {_REF}), c AS (SELECT value * 1.1 AS x FROM events WHERE {_CUR})"
_PSI = f"""WITH {_SIDES}, e AS (SELECT list_sort(list_distinct(quantile_cont(x, {_Q}))) AS edges FROM r), i AS (SELECT edges[2:len(edges) - 1] AS inner_edges FROM e),
rb AS (SELECT len(list_filter(inner_edges, lambda k: k <= x)) AS bin, count(*) / (SELECT count(*) FROM r)::DOUBLE AS p FROM r, i GROUP BY 1),
cb AS (SELECT len(list_filter(inner_edges, lambda k: k <= x)) AS bin, count(*) / (SELECT count(*) FROM c)::DOUBLE AS p FROM c, i GROUP BY 1),
m AS (SELECT greatest(0, sum((coalesce(cb.p, 0) - coalesce(rb.p, 0)) * ln((coalesce(cb.p, 0) + 1e-6) / (coalesce(rb.p, 0) + 1e-6)))) AS psi FROM rb FULL JOIN cb USING (bin)),
a AS (SELECT count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM r), b AS (SELECT count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM c), o AS (SELECT count(*) FILTER (WHERE x < lo OR x > hi) AS n FROM c, a)"""
_STATUS = "CASE WHEN psi >= 0.25 THEN 'drift' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END"


def _drift(events: DataFrame) -> DataFrame:
    return drift.numeric_drift(events.where(_REF).select("value"), events.where(_CUR).select((F.col("value") * 1.1).alias("value")), ["value"])


@query(f"{_PSI} SELECT 'value' AS feature, a.n AS reference_count, b.n AS current_count, o.n AS outside_count, round(psi, 6) AS psi, round(a.mean, 6) AS reference_mean, round(a.std, 6) AS reference_std, round(b.mean, 6) AS current_mean, round(b.std, 6) AS current_std, round(CASE WHEN a.std > 0 THEN (b.mean - a.mean) / a.std END, 6) AS mean_shift, round(o.n / b.n::DOUBLE, 6) AS outside_rate, {_STATUS} AS status FROM m, a, b, o")
def drift_numeric(events: DataFrame) -> DataFrame:
    return _drift(events)


_DOMAIN = ("click", "error", "purchase", "view")
_SHARES = "SELECT t.v, (SELECT count(*) FROM events WHERE {w} AND event_type = t.v) / (SELECT count(*) FROM events WHERE {w})::DOUBLE AS p FROM (VALUES ('click'), ('error'), ('purchase'), ('view')) t(v)"
_CAT_PSI = f"(SELECT greatest(0, sum((c.p - r.p) * ln((c.p + 1e-6) / (r.p + 1e-6)))) FROM ({_SHARES.format(w=_REF)}) r JOIN ({_SHARES.format(w=_CUR)}) c USING (v))"


@query(f"SELECT 'event_type' AS feature, (SELECT count(*) FROM events WHERE {_REF}) AS reference_count, (SELECT count(*) FROM events WHERE {_CUR}) AS current_count, (SELECT count(*) FROM events WHERE {_CUR} AND event_type = 'signup') AS unexpected_count, round(psi, 6) AS psi, {_STATUS} AS status FROM (SELECT {_CAT_PSI} AS psi)")
def drift_categorical(events: DataFrame) -> DataFrame:
    return drift.categorical_drift(events.where(_REF), events.where(_CUR), "event_type", _DOMAIN)


@query(f"{_PSI}, k AS (SELECT 'value' AS feature, round(psi, 6) AS psi FROM m UNION ALL SELECT 'event_type', round({_CAT_PSI}, 6)), t AS (SELECT *, {_STATUS} AS status FROM k) SELECT CASE max(CASE status WHEN 'drift' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END) WHEN 2 THEN 'drift' WHEN 1 THEN 'watch' ELSE 'stable' END AS overall_status, count(*) FILTER (WHERE status = 'stable') AS n_stable, count(*) FILTER (WHERE status = 'watch') AS n_watch, count(*) FILTER (WHERE status = 'drift') AS n_drift, (SELECT feature FROM t ORDER BY psi DESC, feature LIMIT 1) AS highest_psi_feature, max(psi) AS highest_psi FROM t")
def drift_overall(events: DataFrame) -> DataFrame:
    cols = ["feature", "psi", "status"]
    return drift.overall(_drift(events).select(cols).unionByName(drift.categorical_drift(events.where(_REF), events.where(_CUR), "event_type", _DOMAIN).select(cols)))


def _scored(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", ((F.col("n_chars") % 1000) / 1000).alias("score"))


_SCORED = "s AS (SELECT doc_id, quality, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_RATES = """round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round((coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS "precision",
round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fn + fp, 0), 0), 6) AS f1, round(coalesce(CAST(5 * tp AS DOUBLE) / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2"""
_SWEEP = f"{_SCORED}, k AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE quality = 1 AND score >= t / 100.0::DOUBLE) AS tp, count(*) FILTER (WHERE quality <> 1 AND score >= t / 100.0::DOUBLE) AS fp, count(*) FILTER (WHERE quality = 1 AND score < t / 100.0::DOUBLE) AS fn, count(*) FILTER (WHERE quality <> 1 AND score < t / 100.0::DOUBLE) AS tn FROM s, range(1, 100) g(t) GROUP BY 1), w AS (SELECT *, {_RATES} FROM k)"


@query(f"WITH {_SWEEP} SELECT * FROM w")
def threshold_sweep(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return evaluation.threshold_sweep(_scored(labels, documents), "quality", "score")


_ODD = "s AS (SELECT quality, CASE WHEN doc_id % 11 <> 0 THEN (n_chars % 100) / 100.0::DOUBLE - 0.000000001::DOUBLE * (doc_id % 2) END AS score FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_SWEEP.replace(_SCORED, _ODD)} SELECT * FROM w")
def threshold_sweep_odd(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Scores on and just below thresholds, and missing ones."""
    score = F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") % 100) / 100 - F.lit(1e-9) * (F.col("doc_id") % 2))
    rows = labels.join(documents.select("doc_id", "n_chars"), "doc_id").select("quality", score.alias("score"))
    return evaluation.threshold_sweep(rows, "quality", "score")


@query(f"WITH {_SCORED}, k AS (SELECT count(*) FILTER (WHERE quality = 1 AND score >= 0.14) AS tp, count(*) FILTER (WHERE quality <> 1 AND score >= 0.14) AS fp, count(*) FILTER (WHERE quality = 1 AND score < 0.14) AS fn, count(*) FILTER (WHERE quality <> 1 AND score < 0.14) AS tn FROM s) SELECT *, {_RATES} FROM k")
def confusion(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return evaluation.confusion(_scored(labels, documents), "quality", "score", 0.14)


@query(f"""WITH {_SCORED}, a AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), n AS (SELECT sum(quality) AS p, count(*) - sum(quality) AS q FROM s),
g AS (SELECT score, sum(quality) AS p, count(*) AS n FROM s GROUP BY 1), u AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM g)
SELECT round((SELECT (sum(r) FILTER (WHERE quality = 1) - max(n.p) * (max(n.p) + 1) / 2.0) / (max(n.p) * max(n.q)) FROM a, n), 6) AS roc_auc, round((SELECT sum(u.p * u.tp / u.k::DOUBLE) / max(n.p) FROM u, n), 6) AS average_precision""")
def ranking_metrics(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return evaluation.ranking_metrics(_scored(labels, documents), "quality", "score")


@query(f"WITH {_SWEEP} SELECT 'max_f2' AS rule, (SELECT threshold FROM w ORDER BY f2 DESC, threshold DESC LIMIT 1) AS threshold UNION ALL SELECT 'precision_at_recall', (SELECT threshold FROM w WHERE recall >= 0.7 ORDER BY \"precision\" DESC, threshold DESC LIMIT 1)")
def best_thresholds(labels: DataFrame, documents: DataFrame) -> DataFrame:
    return evaluation.best_thresholds(evaluation.threshold_sweep(_scored(labels, documents), "quality", "score"))


@query("WITH m AS (SELECT o_orderpriority AS model, round(avg(o_totalprice), 6) AS metric FROM orders GROUP BY 1) SELECT model AS selected FROM m WHERE metric >= (SELECT max(metric) FROM m) - 5000 ORDER BY list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], model) LIMIT 1")
def model_select(orders: DataFrame) -> DataFrame:
    models = orders.groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), 6).alias("metric"))
    return evaluation.simplest_within(models, "model", "metric", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], 5000.0)


_MIX = "(doc_id * 7919) % 10007, doc_id"


def _mix() -> list:
    return [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")]


@query(f"SELECT doc_id, quality, CASE WHEN r <= floor(round(n * 0.7, 6)) THEN 'train' WHEN r <= floor(round(n * 0.85, 6)) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_MIX}) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def stratified_split(labels: DataFrame) -> DataFrame:
    return evaluation.stratified_split(labels.select("doc_id", "quality"), "quality", _mix(), [("train", 0.7), ("validation", 0.15), ("test", 0.15)])


@query(f"SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_MIX}) - 1) % 5 AS INTEGER) AS fold FROM labels")
def fold_assign(labels: DataFrame) -> DataFrame:
    return evaluation.folds(labels.select("doc_id", "quality"), "quality", _mix(), 5)


@query("SELECT o_custkey, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT o_custkey, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'validation' ELSE 'test' END AS split FROM orders) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_disjoint(orders: DataFrame) -> DataFrame:
    """Customers whose orders stand in more than one split; orders are split, so many do."""
    m = F.col("o_orderkey") % 10
    split = F.when(m < 7, "train").when(m < 9, "validation").otherwise("test")
    return evaluation.shared_ids(orders.select("o_custkey", split.alias("split")), "o_custkey")


_PARTS = "(SELECT vec_id, label, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(0, 64) t(i))"


def _contributions(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", "label", F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"), F.col("x").cast("double").alias("x"))


@query(f"SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM (SELECT feature, round(avg(abs(x)), 6) AS importance FROM {_PARTS} GROUP BY 1)")
def importance_rank(embeddings: DataFrame) -> DataFrame:
    return evaluation.mean_absolute(_contributions(embeddings), "feature", "x")


@query(f"SELECT vec_id, substr(feature, 1, 2) AS feature_group, round(sum(x), 6) AS contribution FROM {_PARTS} GROUP BY 1, 2")
def grouped_contributions(embeddings: DataFrame) -> DataFrame:
    return evaluation.grouped(_contributions(embeddings), "vec_id", F.substring("feature", 1, 2), "x")


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 AND value IS NOT NULL THEN round(greatest(0.0, least(1.0, (150.0 - value) / (150.0 - 5.0))), 5) END AS anomaly_score FROM events")
def score_normalise(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))
    return evaluation.normalised_scores(rows, "value", 5.0, 150.0).select("event_id", "anomaly_score")


@query("SELECT (SELECT event_id FROM events ORDER BY value, event_id LIMIT 1) AS lowest, (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 1) AS highest, (SELECT event_id FROM events ORDER BY abs(value - 50), event_id LIMIT 1) AS closest")
def representatives(events: DataFrame) -> DataFrame:
    return evaluation.representatives(events, "value", "event_id", 50.0)


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE r <> turn) AS out_of_sequence FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) GROUP BY 1")
def sequence_gaps(conversations: DataFrame) -> DataFrame:
    return sequence.sequence_gaps(conversations, "conv_id", "turn", 0)


@query("SELECT user_id, count(*) FILTER (WHERE value < p) AS violations FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def order_check(events: DataFrame) -> DataFrame:
    return sequence.order_violations(events, "user_id", ["ts", "event_id"], "value")


@query("SELECT user_id, count(DISTINCT event_id % 3) AS partitions FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 3) > 1")
def partition_check(events: DataFrame) -> DataFrame:
    return sequence.partition_inconsistencies(events.withColumn("p", F.col("event_id") % 3), "user_id", "p")


_STOP = "['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'what', 'with']"
_QUERY = ("erly", "on", "anre", "src3", "tion", "in", "this")
_ASKED = f"list_filter({list(_QUERY)!r}, lambda q: NOT list_contains({_STOP}, q))"
_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]+')), lambda x: NOT list_contains(" + _STOP + ", x))"


@query(f"WITH d AS (SELECT doc_id, {_TOKENS.format(c='source')} AS t, {_TOKENS.format(c='text')} AS c FROM documents) SELECT doc_id, len(list_intersect({_ASKED}, list_distinct(list_concat(t, c)))) + 1.5 * len(list_intersect({_ASKED}, t))::DOUBLE AS score FROM d WHERE len(list_intersect({_ASKED}, list_distinct(list_concat(t, c)))) > 0 ORDER BY score DESC, doc_id LIMIT 10")
def lexical_retrieval(documents: DataFrame) -> DataFrame:
    return sequence.retrieve(documents, _QUERY, "source", "text", "doc_id", 10)


@query("SELECT a.avg_b - a.avg_a AS delta_avg FROM (SELECT round(avg(value) FILTER (WHERE event_id % 2 = 0), 4) AS avg_a, round(avg(value) FILTER (WHERE event_id % 2 = 1), 4) AS avg_b FROM events) a WHERE false UNION ALL SELECT round(round(avg(value) FILTER (WHERE event_id % 2 = 1), 4) - round(avg(value) FILTER (WHERE event_id % 2 = 0), 4), 6) FROM events")
def metric_deltas(events: DataFrame) -> DataFrame:
    side = lambda w: events.where(w).agg(F.round(F.avg("value"), 4).alias("avg"))
    return evaluation.metric_deltas(side(_REF), side(_CUR), ["avg"])


@query("SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS prior_probability, round(count(*) FILTER (WHERE quality <> 1) / nullif(count(*) FILTER (WHERE quality = 1), 0)::DOUBLE, 6) AS positive_weight FROM labels")
def class_prior(labels: DataFrame) -> DataFrame:
    return modelling.prior(labels, "quality")


def _training(labels: DataFrame, documents: DataFrame) -> DataFrame:
    rows = labels.join(documents.select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.log1p("n_chars").alias("log_chars"))


@query()
def out_of_fold_scores(labels: DataFrame, documents: DataFrame) -> DataFrame:
    make = lambda: modelling.pipeline("logistic", ["lang"], ["n_chars", "log_chars"], "quality")
    scored = modelling.out_of_fold(_training(labels, documents), make, "quality", _mix(), ["doc_id"], 3)
    return modelling.predictions(scored, 0.5)


@query()
def isolation_scores(lineitem: DataFrame) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    keys = ["l_orderkey", "l_linenumber"]
    forest = modelling.fit_trees(modelling.tree_samples(lineitem, keys, cols))
    return modelling.isolation_scores(lineitem.select(*keys, *cols), forest, cols)
