"""Records on their way into tables and models: mappings, feature policies, writes that refuse conflicts, alert reuse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contract import check_columns
from tidemark.operators.merge import MergeConflict, classify
from tidemark.sources.scratch import exists


class MissingField(KeyError):
    """A mapping or policy names a field that is not there."""


def mapped(rows: DataFrame, mapping: Mapping[str, str], targets: Sequence[str]) -> DataFrame:
    """``targets`` in order, each from the source column that ``mapping`` (source to target) gives it; what is missing on either side is an error."""
    source = {t: s for s, t in mapping.items()}
    lost = sorted(set(targets) - set(source)) + sorted({source[t] for t in targets if t in source} - set(rows.columns))
    if lost:
        raise MissingField(", ".join(lost))
    return rows.select(*(F.col(source[t]).alias(t) for t in targets))


def modelling_rows(rows: DataFrame, trace: str, trace_as: str, features: Sequence[str], target: str, forbidden: Sequence[str]) -> DataFrame:
    """The trace column under its new name, the features and the target; a forbidden or missing column is an error."""
    wrong = sorted(set(features) & {*forbidden, target, trace})
    if wrong:
        raise ValueError(f"not allowed as features: {', '.join(wrong)}")
    lost = [c for c in (trace, *features, target) if c not in rows.columns]
    if lost:
        raise MissingField(", ".join(lost))
    return rows.select(F.col(trace).alias(trace_as), *features, target)


def concatenated(parts: Sequence[DataFrame], unique: str) -> DataFrame:
    """All rows of the parts; an id that two rows share is an error."""
    rows = reduce(DataFrame.unionByName, parts)
    if not rows.groupBy(unique).count().where("count > 1").isEmpty():
        raise ValueError(f"{unique} is repeated")
    return rows


def written_once(spark: SparkSession, path: str, staged: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """Append the staged rows whose identity the table at ``path`` lacks. Known rows of equal payload are reused; one of another payload, or two
    staged rows of one identity that differ, raise MergeConflict before anything is written. One writer at a time.

    Returns how many rows were new and reused. Writing the same rows again writes nothing.
    """
    payload = [c for c in staged.columns if c not in keys]
    once = staged.distinct()
    if not once.groupBy(*keys).count().where("count > 1").isEmpty():
        raise MergeConflict("staged rows contradict one another")
    if exists(spark, path):
        target = spark.read.schema(staged.schema).parquet(path)
        states = classify(target, once, keys, payload)
        counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if counts.get("conflict"):
            raise MergeConflict(f"{counts['conflict']} staged rows contradict the table")
        fresh = once.join(target.select(*keys), list(keys), "left_anti").select(staged.columns)
    else:
        counts, fresh = {"new": once.count()}, once
    if counts.get("new"):
        fresh.write.mode("append").parquet(path)
    return {k: counts.get(k, 0) for k in ("new", "reused")}


def input_faults(rows: DataFrame, payload: str, words: Mapping[str, Sequence[str]], numbers: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """``faults`` of a JSON payload that must be an object of just these fields: one of the given words each, or a finite number.

    In order: not_an_object; missing, forbidden and unexpected fields; not_text, not_allowed, not_a_number (null, true and text are none). An empty list is a valid input.
    """
    expected = [*words, *numbers]
    fields = F.json_object_keys(payload)
    value = F.try_parse_json(F.col(payload))
    at = lambda c, kind: F.try_variant_get(value, f"$['{c}']", kind)
    kind = lambda c: F.schema_of_variant(at(c, "variant"))
    there = lambda c: F.array_contains(fields, c)
    named = lambda what, names: F.transform(F.array_sort(names), lambda c: F.concat(F.lit(what + ":"), c))
    fault = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(text))
    wrong = [fault(there(c) & (kind(c) != "STRING"), f"not_text:{c}") for c in words]
    wrong += [fault((kind(c) == "STRING") & ~at(c, "string").isin(list(allowed)), f"not_allowed:{c}") for c, allowed in words.items()]
    number = lambda c: F.coalesce(kind(c).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False)) & ~F.coalesce(F.abs(at(c, "double")) == float("inf"), F.lit(False))
    wrong += [fault(there(c) & ~number(c), f"not_a_number:{c}") for c in numbers]
    lit = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    extra = F.array_except(fields, lit(expected))
    every = F.concat(named("missing", F.array_except(lit(expected), fields)), named("forbidden", F.array_intersect(extra, lit(forbidden))), named("unexpected", F.array_except(extra, lit(forbidden))), F.filter(F.array(*wrong), lambda x: x.isNotNull()))
    return rows.withColumn("faults", F.when(fields.isNull(), lit(["not_an_object"])).otherwise(every))


def prediction_faults(rows: DataFrame, model: str, version: str) -> DataFrame:
    """``violations`` of prediction records: ids, hashes, probabilities, the decision at the record's own threshold, lineage, model. Here what is missing is a fault."""
    c = F.col
    share = lambda n: c(n).between(0.0, 1.0)
    sha = lambda n: c(n).rlike("^[0-9a-f]{64}$")
    filled = lambda n: F.trim(n) != ""
    rules = [
        ("event_id", c("event_id").rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        ("event_time", F.try_to_timestamp("event_time").isNotNull()),
        *((n, share(n)) for n in ("failure_probability", "frozen_threshold")),
        ("decision", (c("failure_prediction") == 1) == (c("failure_probability") >= c("frozen_threshold"))),
        *((n, sha(n)) for n in ("final_config_hash", "model_input_sha256", "payload_sha256")),
        *((n, filled(n)) for n in ("adapter_version", "machine_code", "source_kafka_key", "source_kafka_topic")),
        *((n, c(n) >= 0) for n in ("source_kafka_offset", "source_kafka_partition")),
        ("model_name", c("model_name") == model),
        ("model_version", c("model_version") == version),
    ]
    return check_columns(rows, [(name, F.coalesce(ok, F.lit(False))) for name, ok in rules])


def batch_faults(rows: DataFrame, identity: Sequence[str], unique: str, model: Sequence[str]) -> DataFrame:
    """One row: identities and ids that occur more than once, how many models the records name, and whether they make one batch (not empty, one model)."""
    twice = lambda keys, name: rows.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias(name))
    parts = [rows.agg(F.count("*").alias("records")), twice(identity, "repeated_identities"), twice([unique], "repeated_ids"), rows.select(*model).distinct().agg(F.count("*").alias("models"))]
    return reduce(DataFrame.join, parts).withColumn("holds", F.expr("records > 0 AND repeated_identities = 0 AND repeated_ids = 0 AND models = 1"))


def run_conflicts(stored: DataFrame, prepared: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run and key, of ledgers (run, key, value): where a run that is stored has another value, lacks the key, or has one more."""
    known = prepared.join(stored.select(*run).distinct(), list(run), "left_semi").withColumnRenamed("value", "prepared")
    own = stored.join(prepared.select(*run).distinct(), list(run), "left_semi").withColumnRenamed("value", "stored")
    both = own.join(known, [*run, "key"], "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("prepared"))).select(*run, "key", "stored", "prepared")


def alert_actions(existing: DataFrame, candidates: DataFrame, keys: Sequence[str], immutable: Sequence[str]) -> DataFrame:
    """Candidates with ``action``: create, reuse (an alert of the same source and provenance stands, in whatever state) or conflict."""
    state = classify(existing, candidates, keys, immutable)
    return state.select(*keys, F.when(F.col("state") == "new", "create").when(F.col("state") == "reused", "reuse").otherwise("conflict").alias("action"))


def alert_violations(alerts: DataFrame) -> DataFrame:
    """``violations``: the named constraints that an alert breaks, its state and times among them; what is unknown passes, as in SQL."""
    c = F.col
    opened = (c("status") == "open") & c("acknowledged_at").isNull() & c("resolved_at").isNull()
    seen = (c("status") == "acknowledged") & c("acknowledged_at").isNotNull() & c("resolved_at").isNull()
    closed = (c("status") == "resolved") & c("resolved_at").isNotNull()
    # The constraints' names and the words they allow.
    rules: list[tuple[str, Column]] = [
        ("ck_alerts_severity", c("severity").isin("info", "warning", "critical")),
        ("ck_alerts_type_not_blank", F.trim("alert_type") != ""),
        ("ck_alerts_title_not_blank", F.trim("title") != ""),
        ("ck_alerts_status", c("status").isin("open", "acknowledged", "resolved")),
        ("ck_alerts_acknowledged_after_created", c("acknowledged_at").isNull() | (c("acknowledged_at") >= c("created_at"))),
        ("ck_alerts_resolved_after_created", c("resolved_at").isNull() | (c("resolved_at") >= c("created_at"))),
        ("ck_alerts_resolved_after_acknowledged", c("acknowledged_at").isNull() | c("resolved_at").isNull() | (c("resolved_at") >= c("acknowledged_at"))),
        ("ck_alerts_status_timestamp_consistency", opened | seen | closed),
    ]
    return check_columns(alerts, rules)
