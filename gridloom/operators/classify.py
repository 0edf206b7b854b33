"""Which cells hold values, attributes or nothing. A classifier is any function from cells to cells with a type."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_kind
from ..schema import TYPES
from .blocks import components

Classifier = Callable[[DataFrame], DataFrame]


def basic(cells: DataFrame) -> DataFrame:
    """Numbers are values, all else attributes; types that are there stay."""
    return cells if "type" in cells.columns else cells.withColumn("type", F.when(F.col("data_type") == "numeric", "value").otherwise("attribute"))


def numeric_values(cells: DataFrame, allow_chars: list[str] | None = None, recovery: bool = False, share: float = 0.7) -> DataFrame:
    """By the text alone: what reads as a number is a value. recovery: rows and columns with more attributes than the share
    become attributes throughout."""
    out = cells.withColumn("type", number_kind(F.col("value"), allow_chars))
    return recovered(out, share) if recovery else out


def recovered(cells: DataFrame, share: float = 0.7) -> DataFrame:
    is_attribute = (F.col("type") == "attribute").cast("double")
    by_row, by_col = (F.avg(is_attribute).over(Window.partitionBy("sheet_id", axis)) for axis in ("row", "col"))
    out = cells.withColumn("_row", by_row).withColumn("_col", by_col)
    return out.withColumn("type", F.when(F.greatest("_row", "_col") > share, "attribute").otherwise(F.col("type"))).drop("_row", "_col")


def _matches(samples: list[str], partial_match: bool, case_insensitive: bool) -> Column:
    value = F.lower("value") if case_insensitive else F.col("value")
    found = [s.lower() if case_insensitive else s for s in samples]
    if not partial_match:
        return value.isin(*found) if found else F.lit(False)
    out = F.lit(False)
    for s in found:
        out = out | value.rlike(s)
    return out


def sample_based(cells: DataFrame, value_sample: list[str] = (), attribute_sample: list[str] = (), empty_sample: list[str] = (), partial_match: bool = False, case_insensitive: bool = False) -> DataFrame:
    """Cells that match a sample take its type, and so do the cells of their row, else column, in the same block of cells
    with one type. A later kind overrides: value, attribute, empty."""
    start = basic(cells)
    kinds = start.select("type").distinct().collect()
    labelled = None
    for (kind,) in kinds:
        own = components(start.where(F.col("type") == kind))
        labelled = own if labelled is None else labelled.unionByName(own)
    if labelled is None:
        return start
    labelled = labelled.withColumn("gid", F.concat_ws(":", "type", "gid"))
    by_row, by_col = (Window.partitionBy("sheet_id", "gid", axis) for axis in ("row", "col"))
    out = labelled
    for kind, samples in zip(TYPES, (value_sample, attribute_sample, empty_sample), strict=True):
        hit = F.max(F.when(_matches(list(samples), partial_match, case_insensitive), F.lit(kind)))
        out = out.withColumn(f"_{kind}", F.coalesce(hit.over(by_row), hit.over(by_col)) if samples else F.lit(None).cast("string"))
    return out.withColumn("type", F.coalesce("_empty", "_attribute", "_value", "type")).select(*cells.columns, *([] if "type" in cells.columns else ["type"]))


def basic_classifier() -> Classifier:
    return basic


def numeric_values_classifier(allow_chars: list[str] | None = None, recovery: bool = False) -> Classifier:
    return partial(numeric_values, allow_chars=allow_chars, recovery=recovery)


def sample_based_classifier(**samples: object) -> Classifier:
    return partial(sample_based, **samples)


def classify(cells: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    out = (classifier or basic)(cells)
    if "type" not in out.columns:
        raise ValueError("the classifier gives no type column")
    return out
