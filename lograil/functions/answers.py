"""Fields of a model's answer, from the free JSON of a response, by Spark's variant type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternative names of each field, and what it is where none is present.
FIELDS: dict[str, tuple[tuple[str, ...], str]] = {
    "risk_level": (("risk_level", "threat_level"), "unknown"),
    "risk_score": (("risk_score", "score"), "0"),
    "attack_type_ai": (("attack_type", "attack_category"), ""),
    "summary": (("summary", "event_summary", "analysis_summary"), ""),
    "reasoning": (("reasoning", "analysis_reasoning"), "[]"),
    "recommendations": (("recommendations", "suggestions", "mitigation_steps"), "[]"),
}


def _at(v: Column, name: str) -> Column:
    """A member of an object as a variant: SQL null if it is missing, a variant null if it is null."""
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _given(v: Column) -> Column:
    """A variant, or SQL null where it is null."""
    return F.when(~F.coalesce(F.is_variant_null(v), F.lit(True)), v)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def _answer(v: Column) -> Column:
    """Where the fields stand in a response: data.outputs or outputs (or structured_output in it), result, or answer, which may
    be JSON in a text; the first place that is not null. An object `data` without outputs is an empty answer."""
    empty = F.parse_json(F.lit("{}"))

    def outputs(holder: Column) -> Column:
        inner = lambda out: F.when(_is(out, "OBJECT"), F.when(_at(out, "structured_output").isNotNull(), _given(_at(out, "structured_output"))).otherwise(out))
        return _let(_at(holder, "outputs"), inner)

    data = _let(_at(v, "data"), lambda d: F.when(_is(d, "OBJECT"), F.when(_at(d, "outputs").isNull(), empty).otherwise(outputs(d))))
    text = F.try_variant_get(v, "$.answer", "string")
    said = _let(_at(v, "answer"), lambda a: F.when(_is(a, "OBJECT"), a).when(_is(a, "STRING"), _given(F.try_parse_json(text))))
    return F.coalesce(data, outputs(v), _given(_at(v, "result")), said, empty)


def answer_fields(col: Column, fields: dict[str, tuple[tuple[str, ...], str]] = FIELDS) -> Column:
    """A struct of the fields as texts: the first of its names that is present, null where it is present and null, lists as JSON.

    Text that is no JSON has no field, nor has an answer that is a list, a number or a text without an object in it.
    """

    def named(v: Column) -> Column:
        out = []
        for field, (names, default) in fields.items():
            value = F.lit(default)
            for name in reversed(names):
                value = F.when(_at(v, name).isNotNull(), F.try_variant_get(v, f"$['{name}']", "string")).otherwise(value)
            out.append(value.alias(field))
        return F.struct(*out)

    return _let(_let(F.try_parse_json(col), _answer), named)
