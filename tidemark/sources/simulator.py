"""Deterministic telemetry for tests and demonstrations: one bounded random walk per machine, all seven sensors.

Each machine is one row that a task turns into its events, step after step; its numbers come from the seed and its code
alone, so they are the same in any partitioning. The numbers are this module's own: they keep the contract's
bounds and relations, not another generator's digits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import URL_NAMESPACE, uuid5

# The event's fields in order, and each walking sensor's bounds.
FIELDS = ("schema_version", "event_id", "machine_code", "sequence_number", "event_time", "source", "product_quality_type", "air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min", "vibration_mm_s", "pressure_bar")
BOUNDS = {"air_temperature_k": (294.0, 306.0), "process_temperature_k": (304.0, 315.0), "rotational_speed_rpm": (1000, 3000), "torque_nm": (0.0, 80.0), "tool_wear_min": (0, 300), "vibration_mm_s": (0.0, 15.0), "pressure_bar": (1.0, 12.0)}
_STEP = {"air_temperature_k": 0.12, "process_temperature_k": 0.12, "rotational_speed_rpm": 28, "torque_nm": 0.65, "vibration_mm_s": 0.09, "pressure_bar": 0.05}
MAX_MACHINES = 100
_SCHEMA = "schema_version string, event_id string, machine_code string, sequence_number bigint, event_time string, source string, product_quality_type string, air_temperature_k double, process_temperature_k double, rotational_speed_rpm int, torque_nm double, tool_wear_min int, vibration_mm_s double, pressure_bar double"


def event_id(machine_code: Column, sequence_number: Column, event_time: Column) -> Column:
    """The id that follows from an event's identity: a name-based UUID in the URL namespace."""
    return uuid5(URL_NAMESPACE, F.concat_ws("|", F.lit("1.0"), machine_code, sequence_number.cast("string"), event_time))


def _walk(rng: np.random.Generator, n: int, name: str) -> np.ndarray:
    lo, hi = BOUNDS[name]
    at = lo + (hi - lo) * rng.uniform(0.3, 0.7)
    steps = rng.uniform(-_STEP[name], _STEP[name], n)
    out = np.empty(n)
    for i, s in enumerate(steps.tolist()):
        at = min(hi, max(lo, at + s))
        out[i] = at
    return out


def _machine(number: int, n: int, seed: int, interval: float, start: datetime) -> pd.DataFrame:
    code = f"MCH-{number:04d}"
    rng = np.random.default_rng([seed & 0xFFFFFFFF, number])
    air = _walk(rng, n, "air_temperature_k")
    walks = {k: _walk(rng, n, k) for k in ("process_temperature_k", "rotational_speed_rpm", "torque_nm", "vibration_mm_s", "pressure_bar")}
    wear = np.minimum(BOUNDS["tool_wear_min"][1], rng.integers(0, 91) + np.cumsum(rng.choice([0, 0, 1, 1, 2], n) + (walks["torque_nm"] > 55) + (walks["vibration_mm_s"] > 7)))
    times = [(start + timedelta(seconds=interval * i)).isoformat(timespec="milliseconds") + "Z" for i in range(n)]
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"1.0|{code}|{i + 1}|{t}")) for i, t in enumerate(times)]
    # the process stays above the air around it
    process = np.minimum(BOUNDS["process_temperature_k"][1], np.maximum(walks["process_temperature_k"], air + 0.5))
    return pd.DataFrame({
        "schema_version": "1.0", "event_id": ids, "machine_code": code, "sequence_number": np.arange(1, n + 1), "event_time": times, "source": "synthetic_simulator",
        "product_quality_type": "LMH"[rng.integers(0, 3)], "air_temperature_k": air.round(3), "process_temperature_k": process.round(3),
        "rotational_speed_rpm": walks["rotational_speed_rpm"].astype("int32"), "torque_nm": walks["torque_nm"].round(3), "tool_wear_min": wear.astype("int32"),
        "vibration_mm_s": walks["vibration_mm_s"].round(3), "pressure_bar": walks["pressure_bar"].round(3),
    })[list(FIELDS)]


def events(spark: SparkSession, machines: int, per_machine: int, seed: int = 42, interval_s: float = 5, start: str = "2024-01-01T00:00:00") -> DataFrame:
    """Events of machines 1 to ``machines`` (at most 100), in the contract's fields; the same for the same arguments."""
    if not 1 <= machines <= MAX_MACHINES or per_machine < 1 or not interval_s > 0:
        raise ValueError("machines must be 1 to 100, events at least 1, the interval positive")
    begin = datetime.fromisoformat(start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                yield _machine(int(number), per_machine, seed, float(interval_s), begin)

    return spark.range(1, machines + 1).mapInPandas(run, _SCHEMA)


def as_json(rows: DataFrame) -> DataFrame:
    """The events as the text that a producer sends: the key (the machine's code) and the payload, fields in order."""
    return rows.select(F.col("machine_code").alias("key"), F.to_json(F.struct(*FIELDS)).alias("value"))


def field_order(payload: str) -> tuple[str, ...]:
    return tuple(json.loads(payload))
