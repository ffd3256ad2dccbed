"""User rules over rows: a plain Python function of a row's fields becomes columns, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Rule = Callable[[dict[str, Any]], Any]


def with_rule(df: DataFrame, rule: Rule, inputs: Sequence[str], returns: str, error: str = "rule_error") -> DataFrame:
    """``df`` with the fields that ``rule`` gives for each row, and the text of its failure.

    The rule gets a dictionary of the ``inputs`` (maps as dictionaries, NULL as None) and gives a dictionary of the fields
    named in ``returns`` (DDL); absent ones are NULL. A row whose rule raises, or gives values of other types, has NULL
    fields and a failure; other rows have none. Rows stay in their tasks. Existing columns of these names are replaced.
    """
    declared = T._parse_datatype_string(returns) if not isinstance(returns, T.StructType) else returns
    names = declared.fieldNames()
    kinds = {f.name: to_arrow_type(f.dataType) for f in declared.fields}
    schema = T.StructType([*declared.fields, T.StructField(error, T.StringType())])
    whole = to_arrow_type(schema)

    def one(row: dict[str, Any]) -> dict[str, Any]:
        try:
            given = rule(row)
            if not isinstance(given, dict):
                raise TypeError(f"a rule gives a dictionary, not {type(given).__name__}")
            return {n: pa.scalar(given.get(n), kinds[n]).as_py() for n in names} | {error: None}
        except Exception as problem:  # the row's own failure, reported as data
            return dict.fromkeys(names) | {error: str(problem)}

    @F.arrow_udf(schema)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([one(row) for row in rows.to_pylist(maps_as_pydicts="lossy")], type=whole)

    made = df.withColumn("_made", run(F.struct(*inputs)))
    return made.withColumns({n: F.col("_made")[n] for n in [*names, error]}).drop("_made")


def name_points(points: DataFrame, rule: Callable[[dict[str, Any]], str], axes: Sequence[str], exp_id: str = "exp_id",
                error: str = "rule_error") -> DataFrame:
    """Grid points with the id that a naming rule gives for their axis values; a rule that gives no text is a failure."""

    def named(row: dict[str, Any]) -> dict[str, Any]:
        name = rule(row)
        if not isinstance(name, str) or not name:
            raise TypeError(f"no name for {row}")
        return {exp_id: name}

    return with_rule(points, named, axes, f"`{exp_id}` string", error)


def recommend_resources(configs: DataFrame, advisor: Rule, config: str = "config", error: str = "rule_error") -> DataFrame:
    """Configurations (a map column, or the row's other columns) with the workers, memory and time an advisor gives them."""
    if config in configs.columns:
        return with_rule(configs, lambda row: advisor(row[config] or {}), [config], "workers bigint, mem string, time string", error)
    return with_rule(configs, advisor, configs.columns, "workers bigint, mem string, time string", error)
