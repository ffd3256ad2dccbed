"""Writers: filtered documents, field tables, expanded grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.analysis import metadata_keys, summary_table
from runloom.operators.documents import project_fields, query
from runloom.operators.records import scope_table
from runloom.sources.readers import written

#: Folders that one task writes, about.
FOLDERS_PER_TASK = 500
DEFAULT_FIELDS = ("exp_id", "status", "created_at")


def export_json(df: DataFrame, path: str, filters: Mapping[str, Any] | None = None, doc: str = "doc") -> None:
    query(df, filters, doc).write.mode("error").json(path)


def export_csv(df: DataFrame, path: str, fields: Sequence[str] = DEFAULT_FIELDS,
               filters: Mapping[str, Any] | None = None, doc: str = "doc") -> bool:
    """Dotted fields as CSV; without any row nothing is written and the result is False."""
    rows = project_fields(query(df, filters, doc), fields, doc)
    if rows.isEmpty():
        return False
    rows.write.mode("error").option("header", "true").csv(path)
    return True


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A flat result table as CSV (with header) or JSON lines."""
    writer = df.write.mode("error")
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}: csv or json")


def export_analysis(results: DataFrame, path: str, fmt: str = "csv", position: str = "name") -> list[str]:
    """The results of an analysis, written as CSV or JSON lines; the metadata keys, in order of first appearance.

    The CSV has five fixed columns and one for each metadata key that any row has; JSON keeps the map. Results are written
    once before, so that handlers are not called again for the keys. The keys become columns, of which a table has few.
    """
    own = written(results, "analysis", results.sparkSession)
    keys = metadata_keys(own, position)
    write_table(summary_table(own, keys) if fmt == "csv" else own, path, fmt)
    return keys


def export_scopes(results: DataFrame, path: str, key: str = "exp_id",
                  metrics: Sequence[str] = ("NC", "DAC", "EP", "TTC", "C")) -> None:
    """Per-scope results as CSV files with header, in a folder ``key=value`` for each experiment.

    An experiment has few rows, so opening files takes the time: tasks are dealt by the number of folders, not by bytes.
    """
    flat = written(scope_table(results, metrics, [key]), "scope-rows", results.sparkSession)
    tasks = -(-flat.select(key).distinct().count() // FOLDERS_PER_TASK) or 1
    flat.repartition(tasks, key).write.mode("error").partitionBy(key).option("header", "true").csv(path)


def write_grid(points: DataFrame, path: str, existing: DataFrame | None = None, exp_id: str = "exp_id",
               overwrite: bool = False) -> None:
    """Expanded configurations as JSON lines.

    Those that exist are left out and the others appended. With ``overwrite`` a new version of the whole grid is written to
    ``path``, a folder that must not exist yet: all points, and the existing ones that are no points.
    """
    if existing is None:
        points.write.mode("append").json(path)
    elif overwrite:
        kept = existing.join(points.select(exp_id), exp_id, "left_anti")
        points.unionByName(kept, allowMissingColumns=True).write.mode("error").json(path)
    else:
        points.join(existing.select(exp_id), exp_id, "left_anti").write.mode("append").json(path)


def write_document_table(df: DataFrame, path: str, day: str = "created_at") -> None:
    """Documents partitioned by creation month, so date filters prune folders; large months are split by size."""
    (df.withColumn("created_month", F.date_format(day, "yyyy-MM")).hint("rebalance", "created_month")
     .write.mode("append").partitionBy("created_month").parquet(path))
