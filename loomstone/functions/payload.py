"""JSON payload filters compiled to Columns, and facet values.

A filter is ``{"must": [...], "should": [...], "must_not": [...]}``; a condition is ``{"key": "a.b", "match": {...}}``,
``{"key": ..., "range": {...}}``, ``{"has_id": [...]}`` or ``{"is_empty": {"key": ...}}``. A dotted path fans out over
arrays of objects on its way; an array at its end matches no scalar. Types are not coerced. A path's values are read by
``get_json_object`` with ``[*]`` at each step that may be an array, so the whole predicate stays inside one projection.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = ("value", "keyword", "text", "integer", "any")


class FilterError(ValueError):
    pass


def values(doc: Column, path: str) -> Column:
    """``array<variant>`` of the scalars that the path reaches."""
    found = F.array(F.try_parse_json(doc))
    for step in path.split("."):

        def item(v: Column) -> Column:
            return F.try_variant_get(v, f"$['{step}']", "variant")

        spread = F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
        found = F.filter(F.transform(F.flatten(spread), item), lambda v: v.isNotNull())
    return found


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _equals(v: Column, wanted: Any) -> Column:
    if isinstance(wanted, bool):
        return (_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return _kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & (F.abs(F.try_variant_get(v, "$", "double") - float(wanted)) < 1e-9)
    if isinstance(wanted, str):
        return (_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    raise FilterError(f"cannot match {wanted!r}")


def _condition(c: dict, doc: Column, ident: Column) -> Column:
    if "has_id" in c:
        return ident.isin([int(x) for x in c["has_id"]])
    if "is_empty" in c:
        path = c["is_empty"]["key"] if isinstance(c["is_empty"], dict) else c["is_empty"]
        full = F.filter(values(doc, path), lambda v: ~F.is_variant_null(v) & (F.to_json(v) != "[]"))
        return F.size(full) == 0
    if "key" not in c:
        raise FilterError(f"no condition: {c!r}")
    reached = values(doc, c["key"])
    if "match" in c:
        kinds = [k for k in MATCHES if k in c["match"]]
        if len(kinds) != 1:
            raise FilterError(f"no match: {c!r}")
        wanted = c["match"][kinds[0]]
        wanted = wanted if isinstance(wanted, list) else [wanted]
        return F.exists(reached, lambda v: reduce(Column.__or__, [_equals(v, w) for w in wanted], F.lit(False)))
    if "range" in c:
        bounds = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
        if not c["range"] or set(c["range"]) - set(bounds):
            raise FilterError(f"no range: {c!r}")

        def inside(v: Column) -> Column:
            x = F.when(_kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))
            return F.coalesce(reduce(Column.__and__, [getattr(x, bounds[k])(F.lit(float(b))) for k, b in c["range"].items()]), F.lit(False))

        return F.exists(reached, inside)
    raise FilterError(f"no condition: {c!r}")


def compile_filter(spec: str | dict, doc: Column, ident: Column) -> Column:
    """The predicate of a filter over a JSON column and an id column; never null."""
    try:
        spec = json.loads(spec) if isinstance(spec, str) else spec
    except ValueError as e:
        raise FilterError(str(e)) from e
    parts = {k: spec.get(k) or [] for k in ("must", "should", "must_not")}
    if not any(parts.values()):
        raise FilterError("empty filter")
    made = {k: [F.coalesce(_condition(c, doc, ident), F.lit(False)) for c in v] for k, v in parts.items()}
    out = reduce(Column.__and__, made["must"], F.lit(True))
    out = out & ~reduce(Column.__or__, made["must_not"], F.lit(False))
    return out & reduce(Column.__or__, made["should"]) if made["should"] else out


def labels(doc: Column, path: str) -> Column:
    """Facet labels of the scalars at a path: whole numbers without a fraction, booleans as words."""
    scalar = F.filter(values(doc, path), lambda v: ~F.is_variant_null(v) & ~_kind(v).rlike("^(ARRAY|OBJECT)"))

    def label(v: Column) -> Column:
        x = F.try_variant_get(v, "$", "double")
        whole = _kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("bigint").cast("string")).otherwise(F.try_variant_get(v, "$", "string"))

    return F.transform(scalar, label)
