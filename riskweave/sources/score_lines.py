"""Snippets and scores as JSON lines, with camelCase or snake_case keys.

A line is taken or rejected as a whole; a rejected one says which fields are wrong and why.
Unknown keys are ignored, and of both spellings of a field the camelCase one counts.
Numbers may be written as text. The key of a line is the file's id, a number or text as
``scan_corpus`` makes it, and the number of the method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, WHOLE, NUMBER, KEY = "string", "int", "double", "key"
#: Reasons why a field is refused; a line that is no JSON object has NOT_JSON and no field.
NOT_JSON, MISSING, IS_NULL, WRONG_TYPE, EMPTY, TOO_SMALL, TOO_LARGE = (
    "NOT_JSON", "MISSING", "NULL", "WRONG_TYPE", "EMPTY", "TOO_SMALL", "TOO_LARGE")


@dataclass(frozen=True)
class Field:
    """What a field may hold. One without a default is required, one whose default is None may be null."""

    kind: str
    required: bool = False
    default: object = None
    low: float | None = None
    high: float | None = None
    filled: bool = False


KEY_FIELDS = {"file_id": Field(KEY, required=True), "method_seq": Field(WHOLE, required=True)}
SCORE_FIELDS = KEY_FIELDS | {
    "vulnerability_type": Field(TEXT, required=True), "severity_score": Field(NUMBER, required=True, low=0.0, high=10.0),
    "issue_description": Field(TEXT, required=True), "suggested_fix": Field(TEXT), "owasp_category": Field(TEXT),
    "confidence": Field(NUMBER, default=0.0, low=0.0, high=1.0), "model_version": Field(TEXT, default="unknown"),
}
SNIPPET_FIELDS = KEY_FIELDS | {
    "class_name": Field(TEXT), "method_name": Field(TEXT), "code_snippet": Field(TEXT, required=True, filled=True),
    "start_line": Field(WHOLE, default=0, low=0), "static_analysis_hint": Field(TEXT),
}


def _camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m.group(1).upper(), name)


def _given(name: str) -> Column:
    """The field as it is written; SQL null if it is not there, a JSON null is a value."""
    return F.coalesce(*[F.try_variant_get("j", f"$.{key}", "variant") for key in dict.fromkeys([_camel(name), name])])


def _value(given: Column, kind: Column, field: Field, key_type: str) -> Column:
    """The field's value, null if it has none of its kind."""
    text = F.when(kind == "STRING", F.try_variant_get(given, "$", "string"))
    plain = ~kind.rlike("^(OBJECT|ARRAY)")
    number = F.when(plain, F.try_variant_get(given, "$", "double"))
    if field.kind == TEXT:
        return text
    if field.kind == NUMBER:
        return number
    if field.kind == WHOLE:
        return F.when((number == F.floor(number)) & (F.abs(number) < 2.0**31), number.cast("int"))
    return F.coalesce(text, F.when(kind == "BIGINT", F.try_variant_get(given, "$", "string"))).try_cast(key_type)


def _reason(given: Column, value: Column, field: Field) -> Column:
    """Why the field is refused, null if it is not."""
    reason = F.when(given.isNull(), F.lit(MISSING if field.required else None))
    if field.required or field.default is not None:
        reason = reason.when(F.is_variant_null(given), IS_NULL)
    reason = reason.when(~F.is_variant_null(given) & value.isNull(), WRONG_TYPE)
    if field.filled:
        reason = reason.when(F.length(value) == 0, EMPTY)
    if field.low is not None:
        reason = reason.when(~(value >= field.low) | F.isnan(value.cast("double")), TOO_SMALL)
    if field.high is not None:
        reason = reason.when(value > field.high, TOO_LARGE)
    return reason


def _judged(lines: DataFrame, line: str, fields: dict[str, Field], key_type: str) -> DataFrame:
    """The line, its values, and the fields that are refused with their reasons."""
    parsed = lines.select(F.col(line).alias("line"), F.try_parse_json(line).alias("j"))
    is_object = F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False))
    given = parsed.select("line", is_object.alias("is_object"), *[_given(name).alias(f"g_{name}") for name in fields])
    kinds = given.select("*", *[F.schema_of_variant(f"g_{name}").alias(f"k_{name}") for name in fields])
    values = kinds.select("*", *[_value(F.col(f"g_{n}"), F.col(f"k_{n}"), f, key_type).alias(f"v_{n}") for n, f in fields.items()])
    reasons = F.array_compact(F.array(*[
        F.when(_reason(F.col(f"g_{n}"), F.col(f"v_{n}"), f).isNotNull(),
               F.struct(F.lit(n).alias("field"), _reason(F.col(f"g_{n}"), F.col(f"v_{n}"), f).alias("reason")))
        for n, f in fields.items()]))
    not_json = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(NOT_JSON).alias("reason")))
    return values.select(
        "line", F.when(F.col("is_object"), reasons).otherwise(not_json).alias("reasons"),
        *[(F.col(f"v_{n}") if f.default is None else F.coalesce(f"v_{n}", F.lit(f.default))).alias(n) for n, f in fields.items()])


def _split(lines: DataFrame, line: str, fields: dict[str, Field], key_type: str) -> tuple[DataFrame, DataFrame]:
    judged = _judged(lines, line, fields, key_type)
    taken = F.size("reasons") == 0
    return judged.where(taken).select(*fields), judged.where(~taken).select(F.col("line").alias(line), "reasons")


def scores_json_in(lines: DataFrame, line: str = "value", key_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """(valid score rows, rejected lines with the reasons per field).

    A score needs the key of its snippet; ``key_type`` is the type of the files' ids. A missing
    confidence counts as 0; one that is given as null is refused.
    """
    return _split(lines, line, SCORE_FIELDS, key_type)


def snippets_json_in(lines: DataFrame, line: str = "value", key_type: str = "string") -> tuple[DataFrame, DataFrame]:
    """(valid snippet rows, rejected lines with the reasons per field)."""
    return _split(lines, line, SNIPPET_FIELDS, key_type)


def refused_fields(rejected: DataFrame) -> DataFrame:
    """One row per rejected line and field: the line, field, reason."""
    return rejected.select("*", F.inline("reasons")).drop("reasons")
