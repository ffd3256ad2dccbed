"""Nested experiment records: sections, enrichment, flat exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions import labels
from runloom.plans.paths import with_parsed

Enricher = Callable[[DataFrame], DataFrame]


def build_record(df: DataFrame, core: Sequence[str], sections: dict[str, Sequence[str]]) -> DataFrame:
    """Flat columns as core fields plus named sections (structs), stamped with ``stored_at``."""
    parts = [F.struct(*[F.col(c) for c in columns]).alias(name) for name, columns in sections.items()]
    return df.select(*core, *parts).withColumn("stored_at", F.current_timestamp())


def enrich(df: DataFrame, *enrichers: Enricher) -> DataFrame:
    """Apply enrichers in order; with none the records stay as they are."""
    for enricher in enrichers:
        df = df.transform(enricher)
    return df


def config_reader(df: DataFrame, config: str = "config") -> labels.Config:
    """Access to configuration values by key: a map's entry, a struct's field or a plain column.

    A key the schema does not have reads as NULL.
    """
    if config in df.columns:
        kind = df.schema[config].dataType
        if hasattr(kind, "fieldNames"):
            return lambda key: F.col(f"{config}.{key}") if key in kind.fieldNames() else F.lit(None).cast("string")
        return lambda key: F.try_element_at(F.col(config), F.lit(key))
    return lambda key: F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")


def describe_architecture(df: DataFrame, exp_id: str = "exp_id", config: str = "config") -> DataFrame:
    """Phase, architecture, backbone, freeze share, batch size, resolution and weight source."""
    get = config_reader(df, config)
    res = labels.resolution(get)
    return df.withColumns({
        "phase": labels.phase(F.col(exp_id), get("phase")),
        "architecture_name": labels.architecture(get),
        "backbone_label": labels.backbone(get),
        "backbone_kind": labels.backbone_type(get),
        "freeze_percentage": labels.freeze_percent(get),
        "effective_batch_size": labels.effective_batch(get),
        "resolution_type": res["resolution_type"],
        "input_resolution": res["input_resolution"],
        "weight_source": labels.weight_source(get),
    })


# The spreadsheet's columns, each with its place in the record.
SPREADSHEET = {
    "Phase": "phase",
    "ID": "exp_id",
    "Architecture": "architecture.name",
    "Backbone": "architecture.backbone",
    "Backbone_Type": "architecture.backbone_type",
    "Train_City": "training.city",
    "Train_Data_%": "training.data_percentage",
    "Freeze_%": "architecture.freeze_percentage",
    "Epochs": "training.epochs",
    "Test_All": "evaluation.all.pdm_score",
    "Test_Boston": "evaluation.boston.pdm_score",
    "Test_Vegas": "evaluation.vegas.pdm_score",
    "Test_Pittsburgh": "evaluation.pittsburgh.pdm_score",
    "Test_Singapore": "evaluation.singapore.pdm_score",
    "Avg_PDMS": "evaluation.avg_pdm_score",
    "In_Dist_PDMS": "evaluation.in_dist_pdm_score",
    "Out_Dist_Avg": "evaluation.out_dist_avg",
    "Gen_Gap_%": "evaluation.generalization_gap_percent",
    "NC": "evaluation.avg_nc",
    "DAC": "evaluation.avg_dac",
    "EP": "evaluation.avg_ep",
    "TTC": "evaluation.avg_ttc",
    "C": "evaluation.avg_c",
    "Status": "status",
    "Priority": "priority",
    "Notes": "notes",
}


def spreadsheet(records: DataFrame, doc: str = "doc") -> DataFrame:
    """The 26 spreadsheet columns, sorted by phase and id; the document is parsed once for all of them."""
    records, value = with_parsed(records, list(SPREADSHEET.values()), doc)
    return records.select(*[value(path).alias(name) for name, path in SPREADSHEET.items()]).orderBy("Phase", "ID")


def scope_table(results: DataFrame, metrics: Sequence[str] = ("NC", "DAC", "EP", "TTC", "C"), keep: Sequence[str] = ()) -> DataFrame:
    """Per-scope results as the CSV columns City, Scenarios, PDMS, sub-metrics, Status, behind columns to ``keep``."""
    label = F.concat(F.upper(F.substring("scope", 1, 1)), F.lower(F.substring(F.col("scope"), F.lit(2), F.length("scope"))))
    return results.select(*keep, label.alias("City"), F.col("scenarios").alias("Scenarios"), F.col("score").alias("PDMS"),
                          *[F.col(m) for m in metrics], F.col("status").alias("Status"))


def wide_results(records: DataFrame, result_keys: Sequence[str], results: str = "results",
                 core: Sequence[str] = ("exp_id", "description", "status", "partition", "num_gpus", "created_at",
                                        "submitted_at", "completed_at")) -> DataFrame:
    """Core columns plus one column per result key (a map entry); missing columns are empty."""
    fixed = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in core]
    return records.select(*fixed, *[F.try_element_at(F.col(results), F.lit(k)).alias(k) for k in result_keys])


def result_keys(records: DataFrame, results: str = "results") -> list[str]:
    """All keys of a result map, sorted: the column list of a wide export (few distinct names)."""
    found = records.select(F.explode(F.map_keys(results)).alias("k")).distinct().orderBy("k")
    return [row["k"] for row in found.collect()]


def comparison_columns(records: DataFrame, key: str, kinds: Sequence[str], kind: str, value: str) -> DataFrame:
    """Side-by-side table: one column per named kind."""
    return records.groupBy(key).pivot(kind, list(kinds)).agg(F.max(value))
