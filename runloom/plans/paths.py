"""Dotted field paths over documents kept as JSON text, VARIANT, struct or real columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a path segment or table name may look like.
SAFE_IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]{0,62}$"


def safe_identifier(name: str) -> str:
    """Return ``name`` if it is a plain identifier, else raise before any job is planned."""
    if not isinstance(name, str) or not re.fullmatch(SAFE_IDENTIFIER[1:-1], name):
        raise ValueError(f"unsafe identifier {name!r}")
    return name


def path_segments(path: str) -> list[str]:
    return [safe_identifier(part) for part in path.split(".")]


def field(df: DataFrame, path: str, as_type: str = "string", doc: str = "doc") -> Column:
    """Value of a dotted path, NULL when any step is missing.

    A promoted column (or struct field) of that name wins, so that the predicate reaches the
    file scan. Otherwise the path is looked up in the document column ``doc``, which may be a
    VARIANT or JSON text.
    """
    segments = path_segments(path)
    if segments[0] in df.columns:
        column, kind = F.col(segments[0]), df.schema[segments[0]].dataType
        for position, segment in enumerate(segments[1:], start=1):
            if isinstance(kind, T.StructType):
                if segment not in kind.fieldNames():
                    return F.lit(None).cast(as_type)
                column, kind = column[segment], kind[segment].dataType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(segment)), kind.valueType
            elif isinstance(kind, T.VariantType):
                rest = "$." + ".".join(segments[position:])
                return F.try_variant_get(column, rest, as_type)
            else:
                return F.lit(None).cast(as_type)
        return column if kind.simpleString() == as_type else column.try_cast(as_type)
    if doc not in df.columns:
        return F.lit(None).cast(as_type)
    if isinstance(df.schema[doc].dataType, T.StringType):
        return _json_text_field(doc, segments, as_type)
    return F.try_variant_get(F.col(doc), "$." + ".".join(segments), as_type)


def _json_text_field(doc: str, segments: list[str], as_type: str) -> Column:
    """Parse only the wanted path out of JSON text.

    The parser skips all other fields and is strict: "3" or true is not a number.
    """
    kind: T.DataType = T.DataType.fromDDL(as_type)
    for segment in reversed(segments):
        kind = T.StructType([T.StructField(segment, kind)])
    column = F.from_json(F.col(doc), kind)
    for segment in segments:
        column = column[segment]
    return column


def in_text_document(df: DataFrame, path: str, doc: str = "doc") -> bool:
    """Whether a path has to be parsed out of JSON text."""
    return (path_segments(path)[0] not in df.columns and doc in df.columns
            and isinstance(df.schema[doc].dataType, T.StringType))


#: With an option set, Catalyst keeps a shared parse whole; without one it is repeated for every field taken out of it.
ONE_PARSE = {"mode": "PERMISSIVE"}


def parse_once(document: Column, paths: Sequence[str], leaf: T.DataType) -> tuple[Column, Callable[[Column, str], Column]]:
    """One parse of JSON text for several paths, and a function that takes a path's value out of the result.

    The paths make a tree, and the tree the schema: fields that no path names are skipped. A path below another wanted one
    is looked up in that one's value, as VARIANT.
    """
    wanted = {tuple(path_segments(p)) for p in paths}
    tops = sorted(s for s in wanted if not any(s[:n] in wanted for n in range(1, len(s))))
    tree: dict = {}
    for segments in tops:
        node = tree
        for segment in segments:
            node = node.setdefault(segment, {})

    def schema(node: dict) -> T.DataType:
        return T.StructType([T.StructField(name, schema(below)) for name, below in node.items()]) if node else leaf

    def value(parsed: Column, path: str) -> Column:
        segments = tuple(path_segments(path))
        top = next(s for s in tops if segments[:len(s)] == s)
        for segment in top:
            parsed = parsed[segment]
        if segments == top:
            return parsed
        inner = parsed if isinstance(leaf, T.VariantType) else F.try_parse_json(parsed)
        kind = "variant" if isinstance(leaf, T.VariantType) else leaf.simpleString()
        return F.try_variant_get(inner, ".".join(["$", *segments[len(top):]]), kind)

    return F.from_json(document, schema(tree), ONE_PARSE), value


def with_parsed(df: DataFrame, paths: Sequence[str], doc: str = "doc",
                name: str = "_parsed") -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with its document parsed once for all ``paths``, and a reader of these as text.

    Paths that are columns of their own are read there.
    """
    inside = {p for p in paths if in_text_document(df, p, doc)}
    if len(inside) < 2:
        return df, lambda path: field(df, path, "string", doc)
    parsed, value = parse_once(F.col(doc), sorted(inside), T.StringType())
    return df.withColumn(name, parsed), lambda path: (
        value(F.col(name), path) if path in inside else field(df, path, "string", doc))


def variant_number(value: Column) -> Column:
    """A VARIANT as DOUBLE, NULL unless it is a number."""
    is_number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(is_number, F.try_variant_get(value, "$", "double"))


def variant_boolean(value: Column) -> Column:
    """A VARIANT as BOOLEAN, NULL unless it is one."""
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def numeric_field(df: DataFrame, path: str, doc: str = "doc") -> Column:
    """Like :func:`field` as DOUBLE, but NULL unless the stored value is itself a number.

    A plain cast would turn the JSON text "3" and the JSON value true into numbers.
    """
    segments = path_segments(path)
    if segments[0] in df.columns:
        kind = df.schema[segments[0]].dataType
        if len(segments) == 1 and not isinstance(kind, (T.NumericType, T.VariantType)):
            return F.lit(None).cast("double")
        return field(df, path, "double", doc)
    if doc not in df.columns:
        return F.lit(None).cast("double")
    if isinstance(df.schema[doc].dataType, T.StringType):
        return _json_text_field(doc, segments, "double")
    return variant_number(F.try_variant_get(F.col(doc), "$." + ".".join(segments), "variant"))


def text_field(df: DataFrame, path: str, doc: str = "doc") -> Column:
    """Like :func:`field` as text, but NULL unless the stored value is itself text."""
    segments = path_segments(path)
    if segments[0] in df.columns:
        column, kind = F.col(segments[0]), df.schema[segments[0]].dataType
        for position, segment in enumerate(segments[1:], start=1):
            if isinstance(kind, T.StructType) and segment in kind.fieldNames():
                column, kind = column[segment], kind[segment].dataType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(segment)), kind.valueType
            elif isinstance(kind, T.VariantType):
                return variant_text(column, segments[position:])
            else:
                return F.lit(None).cast("string")
        if isinstance(kind, T.VariantType):
            return variant_text(column, [])
        return column if isinstance(kind, T.StringType) else F.lit(None).cast("string")
    if doc not in df.columns:
        return F.lit(None).cast("string")
    if isinstance(df.schema[doc].dataType, T.StringType):
        parsed, value = parse_once(F.col(doc), [path], T.VariantType())
        return variant_text(value(parsed, path), [])
    return variant_text(F.col(doc), segments)


def variant_text(column: Column, segments: Sequence[str] = ()) -> Column:
    """Text at a place of a VARIANT, NULL unless the value there is text."""
    at = ".".join(["$", *segments])
    value = F.try_variant_get(column, at, "string")
    return F.when(F.schema_of_variant(F.try_variant_get(column, at, "variant")) == "STRING", value)
