"""Idempotent merges: classify staged rows against a target, refuse conflicts, append what is new."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import latest


class MergeConflict(ValueError):
    """A staged row has a known identity and a different payload."""


def classify(target: DataFrame, staged: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Staged keys with ``state``: new, reused (payload equal, nulls equal) or conflict."""
    old = target.select(*keys, *(F.col(c).alias(f"_t_{c}") for c in payload), F.lit(True).alias("_known"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in payload])
    joined = staged.join(old, list(keys), "left")
    return joined.select(*keys, F.when(F.col("_known").isNull(), F.lit("new")).when(same, F.lit("reused")).otherwise(F.lit("conflict")).alias("state"))


def merged(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the staged rows of unknown identity."""
    return target.unionByName(staged.join(target.select(*keys), list(keys), "left_anti").select(target.columns))


def merge_idempotent(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``merged``, or MergeConflict; merging the same rows again changes nothing."""
    payload = [c for c in target.columns if c not in keys]
    if not classify(target, staged, keys, payload).where("state = 'conflict'").isEmpty():
        raise MergeConflict("staged rows contradict the target")
    return merged(target, staged.dropDuplicates(list(keys)), keys)


def upsert_latest(target: DataFrame, staged: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: whichever of target and staged is newer by ``order``."""
    return latest(target.unionByName(staged), keys, order)


def touched(target: DataFrame, staged: DataFrame, keys: Sequence[str], payload: Sequence[str], at: Column | None = None, column: str = "updated_at") -> DataFrame:
    """``target`` with the staged payload of its keys; ``column`` becomes ``at`` (now) where that changes a row and stays where nothing does. Staged keys are unique; those that the target lacks are left out."""
    new = staged.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in payload), F.lit(True).alias("_staged"))
    rows = target.join(new, list(keys), "left")
    differs = F.coalesce("_staged", F.lit(False)) & F.array_contains(F.array(*(~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in payload)), True)
    changed = {c: F.when(F.col("_staged"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in payload}
    changed[column] = F.when(differs, F.current_timestamp() if at is None else at).otherwise(F.col(column))
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in target.columns))


def alerts(flagged: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(alert_type, rows, id column, flag column) to alert rows; a flag may be a boolean or one of true, t, 1 as text."""
    parts = [rows.where(F.lower(F.col(flag).cast("string")).isin("true", "t", "1")).select(F.lit(kind).alias("alert_type"), F.col(key).alias("source_id"), F.lit("open").alias("status")) for kind, rows, key, flag in flagged]
    return reduce(DataFrame.unionByName, parts)
