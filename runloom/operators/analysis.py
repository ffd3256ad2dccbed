"""User code per row with captured failures: analysis handlers, file parsers, harvesters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.names import slug

#: Rows that are turned into a handler's arguments, and its results into a frame, at once.
ROWS_AT_ONCE = 500
RESULT_SCHEMA = ("name string, success boolean, checkpoint_path string, output_dir string, error string, "
                 "metadata map<string,string>")


def run_handler(experiments: DataFrame, handler: Callable[[dict[str, Any]], dict[str, Any] | None],
                output_root: str, skip_invalid: bool = True) -> DataFrame:
    """Call ``handler`` for every experiment row; a failure becomes that row's error text.

    Rows need name, checkpoint, resolved_checkpoint, config_found; other columns reach the
    handler too. An unresolved row is reported, or fails the query without ``skip_invalid``.
    """
    if "output_subdir" not in experiments.columns:
        experiments = experiments.withColumn("output_subdir", F.col("name"))
    folder = F.concat(F.lit(output_root.rstrip("/") + "/"),
                      slug(F.coalesce(F.nullif("output_subdir", F.lit("")), F.col("name"))))

    def one(row: dict[str, Any]) -> dict[str, Any]:
        out = {"name": row["name"], "success": False, "checkpoint_path": row["checkpoint"], "output_dir": "",
               "error": None, "metadata": {}}
        resolved = row["resolved_checkpoint"]
        if resolved is None or not row["config_found"]:
            reason = "checkpoint not found" if resolved is None else "exp_config could not be loaded"
            if not skip_invalid:
                raise RuntimeError(f"cannot run {row['name']!r}: {reason}")
            return {**out, "error": reason}
        out.update(checkpoint_path=resolved, output_dir=row["output_dir"])
        try:
            details = handler(row) or {}
            out.update(success=True, metadata={k: str(v) for k, v in details.items()})
        except Exception as problem:  # the row's own failure, reported as data
            out["error"] = str(problem)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[begin:begin + ROWS_AT_ONCE]
                yield pd.DataFrame([one(row) for row in part.astype(object).where(part.notna(), None).to_dict("records")],
                                   columns=["name", "success", "checkpoint_path", "output_dir", "error", "metadata"])

    return experiments.withColumn("output_dir", folder).mapInPandas(run, RESULT_SCHEMA)


def summarise(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"),
                       F.count_if(~F.col("success")).alias("failed"))


def metadata_keys(results: DataFrame, position: str) -> list[str]:
    """Metadata keys in order of first appearance: the extra columns of the summary table."""
    first = (results.select(position, F.posexplode(F.map_keys("metadata")).alias("_i", "key"))
             .groupBy("key").agg(F.min(F.struct(position, "_i")).alias("_at")).orderBy("_at"))
    return [row["key"] for row in first.collect()]


def summary_table(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five fixed columns and one per metadata key."""
    return results.select("name", "success", "checkpoint_path", "output_dir",
                          F.coalesce("error", F.lit("")).alias("error"),
                          *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in keys])


def parse_files(files: DataFrame, parser: Callable[[str, bytes | str], list[dict[str, Any]]], schema: str,
                path: str = "path", content: str = "content") -> DataFrame:
    """A user's parser over whole files, batch by batch; a bad file gives one row with ``error``.

    ``schema`` names the parser's fields; ``path`` and ``error`` are added.
    """
    names = [part.split()[0].strip("`") for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict[str, Any]] = []
            for where, body in zip(batch[path], batch[content]):
                try:
                    rows += [{"path": where, "error": None, **parsed} for parsed in parser(where, body)]
                except Exception as problem:  # reported as data
                    rows.append({"path": where, "error": str(problem)})
            yield pd.DataFrame(rows, columns=["path", "error", *names])

    return files.select(path, content).mapInPandas(run, f"path string, error string, {schema}")


def harvest(df: DataFrame, harvester: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's harvester as a DataFrame transform giving (exp_id, metric, value)."""
    found = df.transform(harvester)
    missing = {"exp_id", "metric", "value"} - set(found.columns)
    if missing:
        raise ValueError(f"harvester result lacks {sorted(missing)}")
    return found
