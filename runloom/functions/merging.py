"""Layered configuration values: later layers win."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def override_map(base: Column, overrides: Column) -> Column:
    """Shallow merge of two maps; the override's value wins, also on repeated keys."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,string>")),
                          F.coalesce(overrides, F.create_map().cast("map<string,string>")),
                          lambda key, low, high: F.coalesce(high, low))


def layered(layers: Sequence[Column]) -> Column:
    """First non-NULL of the layers, given lowest priority first."""
    return F.coalesce(*reversed(list(layers)))


def layered_maps(layers: Sequence[Column]) -> Column:
    """Fold of :func:`override_map` over layers, lowest priority first."""
    merged = layers[0]
    for layer in layers[1:]:
        merged = override_map(merged, layer)
    return merged
