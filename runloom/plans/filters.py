"""The filter language: a mapping from dotted path to condition becomes one Column."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.plans.paths import (field, in_text_document, numeric_field, parse_once, path_segments, text_field, variant_boolean,
                                 variant_number, variant_text)

# Comparison prefixes, the two-character ones first.
COMPARISONS = {
    ">=": Column.__ge__,
    "<=": Column.__le__,
    ">": Column.__gt__,
    "<": Column.__lt__,
}


def all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(Column.__and__, conditions, F.lit(True))


def condition(df: DataFrame, path: str, wanted: Any, doc: str = "doc", exact: bool = False, value: Column | None = None) -> Column:
    """One field condition. A missing or NULL field never matches.

    ``'>=x' '<=x' '>x' '<x'`` compare numbers, ``'==s'`` is string equality, any other string is
    a case-insensitive literal substring test (equality with ``exact``), on text alone; any other value
    is compared with its own type. ``value`` is the field's VARIANT where it has been parsed already.
    """
    def number() -> Column:
        return numeric_field(df, path, doc) if value is None else variant_number(value)

    if isinstance(wanted, str):
        for prefix, compare in COMPARISONS.items():
            if wanted.startswith(prefix):
                return compare(number(), F.lit(float(wanted[len(prefix):])))
        text = text_field(df, path, doc) if value is None else variant_text(value)
        if wanted.startswith("=="):
            return text == F.lit(wanted[2:])
        if exact:
            return text == F.lit(wanted)
        return F.contains(F.lower(text), F.lit(wanted.lower()))
    if isinstance(wanted, bool):
        return (field(df, path, "boolean", doc) if value is None else variant_boolean(value)) == F.lit(wanted)
    if isinstance(wanted, (int, float)):
        return number() == F.lit(float(wanted))
    if isinstance(wanted, (dt.date, dt.datetime)):
        return field(df, path, "timestamp", doc) == F.lit(wanted)
    raise TypeError(f"no filter for a value of type {type(wanted).__name__}")


def matches(df: DataFrame, filters: Mapping[str, Any] | Sequence[tuple[str, Any]] | None, doc: str = "doc",
            exact: bool = False) -> Column:
    """Conjunction over all fields; unsafe paths are rejected here, before any job runs.

    Conditions on columns stay apart, so that they reach the file scan. Several conditions on JSON text share one parse.
    """
    pairs = list(filters.items()) if isinstance(filters, Mapping) else list(filters or [])
    for path, _ in pairs:
        path_segments(path)
    inside = [(p, w) for p, w in pairs if in_text_document(df, p, doc) and isinstance(w, (str, bool, int, float))]
    if len(inside) < 2:
        return all_of([condition(df, path, wanted, doc, exact) for path, wanted in pairs])
    parsed, value = parse_once(F.col(doc), [p for p, _ in inside], T.VariantType())
    # The array binds the parsed document, so that all conditions read the same one.
    together = F.exists(F.array(parsed), lambda d: all_of([condition(df, p, w, doc, exact, value(d, p)) for p, w in inside]))
    return all_of([*[condition(df, p, w, doc, exact) for p, w in pairs if (p, w) not in inside], together])


def created_between(df: DataFrame, column: str, after: str | None, before: str | None) -> Column:
    """Inclusive date window; rows without a readable date drop out.

    Bounds are compared in the column's own timestamp type, so that they reach the file scan.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        stamp, bound_type = F.col(column), kind.simpleString()
    else:
        stamp, bound_type = F.try_to_timestamp(F.col(column)), "timestamp"
    bounds = []
    if after is not None:
        bounds.append(stamp >= F.lit(after).cast(bound_type))
    if before is not None:
        bounds.append(stamp <= F.lit(before).cast(bound_type))
    return all_of(bounds)
