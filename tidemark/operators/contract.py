"""Declarative record contracts: a list of fields and cross-field rules compiled to one array expression.

Each row gets the sorted distinct identifiers of the rules it breaks; an empty array is a valid row. Raw
tokens are read from the payload text, so that a quoted number or a fractional integer is caught even
where a parser would coerce it. A token is the text after the first ``"name":`` up to a comma, a closing
brace or a line end: string values that hold a comma or brace are judged invalid, as the contract states.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import once

# What a JSON token of each kind looks like, and (below, in ``Field.valid``) where a field's token stands in the payload.
_TOKENS = {"text": r'^"(?:[^"\\]|\\.)*"$', "integer": r"^-?(?:0|[1-9][0-9]*)$", "number": r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"}


@dataclass(frozen=True)
class Field:
    """A payload field: its kind, Spark type and what its value must satisfy."""

    name: str
    kind: str
    type: str = "string"
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    is_time: bool = False

    def valid(self, raw: Column, parsed: Column) -> Column:
        token = F.trim(F.regexp_extract(raw, rf'"{re.escape(self.name)}"\s*:\s*([^,}}\r\n]+)', 1))
        checks = [token.rlike(_TOKENS[self.kind]), parsed.isNotNull()]
        if self.kind == "number":
            checks.append(~F.isnan(parsed.cast("double")))
        if self.pattern:
            checks.append(parsed.rlike(self.pattern))
        if self.choices:
            checks.append(parsed.isin(*self.choices))
        if self.least is not None:
            checks.append(parsed >= self.least)
        if self.most is not None:
            checks.append(parsed <= self.most)
        if self.is_time:
            checks.append(F.try_to_timestamp(parsed).isNotNull())
        ok = checks[0]
        for c in checks[1:]:
            ok = ok & c
        return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    #: (identifier, lower field, upper field): upper must exceed lower where both are valid.
    above: tuple[tuple[str, str, str], ...] = ()
    #: (identifier, key column, field): the key must equal the field where the field is valid.
    keyed: tuple[tuple[str, str, str], ...] = ()

    def validate(self, rows: DataFrame, raw: str = "raw_value") -> DataFrame:
        """``rows`` with ``parsed`` (a struct) and ``rejection_reasons``."""
        names = [f.name for f in self.fields]
        ddl = ", ".join(f"{f.name} {f.type}" for f in self.fields)
        expected = F.array(*map(F.lit, names))

        def judged(text: Column) -> Column:
            read = F.struct(F.map_keys(F.from_json(text, "map<string,string>")).alias("keys"), F.from_json(text, ddl).alias("parsed"))

            def fields(p: Column) -> Column:
                ok = F.struct(*(f.valid(text, p["parsed"][f.name]).alias(f.name) for f in self.fields))
                return once(ok, lambda ok: F.struct(p["parsed"].alias("parsed"), self._reasons(p["keys"], p["parsed"], ok, expected).alias("reasons")))

            return once(read, fields)

        # the payload is parsed once and every field is judged once; the rules read the results. A generator of one row keeps
        # a later filter on them from being pushed below, where it would judge everything again
        rows = rows.select("*", F.call_function("stack", F.lit(1), once(F.col(raw), judged)).alias("_judged"))
        return rows.withColumns({"parsed": F.col("_judged.parsed"), "rejection_reasons": F.col("_judged.reasons")}).drop("_judged")

    def _reasons(self, keys: Column, parsed: Column, ok: Column, expected: Column) -> Column:
        is_object = keys.isNotNull()
        broken = [("malformed_json", ~is_object), ("missing_required_field", F.size(F.array_except(expected, keys)) > 0), ("unexpected_field", F.size(F.array_except(keys, expected)) > 0)]
        broken += [(f"invalid_{f.name}", ~ok[f.name]) for f in self.fields]
        broken += [(name, ok[lo] & ok[hi] & (parsed[hi] <= parsed[lo])) for name, lo, hi in self.above]
        broken += [(name, ok[f] & ~F.col(key).eqNullSafe(parsed[f])) for name, key, f in self.keyed]
        reasons = F.array(*(F.when(F.coalesce(c if i == 0 else is_object & c, F.lit(False)), F.lit(name)) for i, (name, c) in enumerate(broken)))
        return F.sort_array(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())))


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("rejection_reasons") == 0)


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("rejection_reasons") > 0)


def quarantine_records(validated: DataFrame, lineage: Sequence[str], named: Sequence[str], raw: str = "raw_value") -> DataFrame:
    """What is kept of a rejected row: where it came from, its raw payload, the ids that could be read, and why."""
    return quarantine(validated).select(*lineage, raw, *(F.col(f"parsed.{c}").alias(c) for c in named), "rejection_reasons")


def check_columns(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Table constraints by the same scheme: ``violations`` lists every rule that is not true (null passes, as in SQL CHECK)."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules))
    return rows.withColumn("violations", F.array_sort(F.filter(found, lambda x: x.isNotNull())))


# The telemetry event contract.
TELEMETRY = Contract(
    (
        Field("schema_version", "text", choices=("1.0",)),
        Field("event_id", "text", pattern=r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        Field("machine_code", "text", pattern=r"^MCH-(?:000[1-9]|00[1-9][0-9]|0100)$"),
        Field("sequence_number", "integer", "bigint", least=1),
        Field("event_time", "text", pattern=r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$", is_time=True),
        Field("source", "text", choices=("synthetic_simulator",)),
        Field("product_quality_type", "text", choices=("L", "M", "H")),
        Field("air_temperature_k", "number", "double", least=294.0, most=306.0),
        Field("process_temperature_k", "number", "double", least=304.0, most=315.0),
        Field("rotational_speed_rpm", "integer", "int", least=1000, most=3000),
        Field("torque_nm", "number", "double", least=0.0, most=80.0),
        Field("tool_wear_min", "integer", "int", least=0, most=300),
        Field("vibration_mm_s", "number", "double", least=0.0, most=15.0),
        Field("pressure_bar", "number", "double", least=1.0, most=12.0),
    ),
    above=(("process_temperature_not_above_air_temperature", "air_temperature_k", "process_temperature_k"),),
    keyed=(("kafka_key_machine_code_mismatch", "kafka_key", "machine_code"),),
)
