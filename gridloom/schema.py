"""The cells relation and what is derived from it. Every relation leads with sheet_id, so many sheets are one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = "sheet_id string, row int, col int, data_type string, value string"
TYPED = CELLS + ", type string"
GIDMAP = "sheet_id string, row int, col int, gid string"
BBOX = "sheet_id string, gid string, r_min int, c_min int, r_max int, c_max int"
LONG = "sheet_id string, data_block string, row int, col int, value string, attr_name string, attr_value string, attr_row int, attr_col int"

KEY = ["sheet_id", "row", "col"]
DATA_TYPES = ("numeric", "character")
TYPES = ("value", "attribute", "empty")


def sheet() -> Window:
    return Window.partitionBy("sheet_id")


@dataclass(frozen=True)
class ValidationReport:
    """Violations by name; a report without any is true."""

    violations: dict[str, int] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return not self.violations

    def messages(self) -> list[str]:
        return [f"{n} {'cell' if n == 1 else 'cells'}: {what}" for what, n in self.violations.items()]


def coordinate_checks(cells: DataFrame) -> DataFrame:
    """One row per sheet with counts of cells that break a (row, col) key: null, not positive, not whole, repeated."""
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    keyed = cells.groupBy(*KEY).agg(F.count("*").alias("n"))
    return keyed.groupBy("sheet_id").agg(
        F.coalesce(F.sum(F.when(row.isNull() | col.isNull(), F.col("n"))), F.lit(0)).alias("null_position"),
        F.coalesce(F.sum(F.when((row < 1) | (col < 1), F.col("n"))), F.lit(0)).alias("not_positive"),
        F.coalesce(F.sum(F.when((row != F.floor(row)) | (col != F.floor(col)), F.col("n"))), F.lit(0)).alias("not_whole"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"),
    )


def value_checks(cells: DataFrame) -> DataFrame:
    """One row per sheet with counts of cells whose data_type, value or type is not allowed."""
    kind = ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)) if "type" in cells.columns else F.lit(False)
    return cells.groupBy("sheet_id").agg(
        F.count_if(~F.coalesce(F.col("data_type").isin(*DATA_TYPES), F.lit(False))).alias("bad_data_type"),
        F.count_if(F.col("value").isNull()).alias("null_value"),
        F.count_if(kind).alias("bad_type"),
    )


def validate_cells(cells: DataFrame) -> ValidationReport:
    missing = [c for c in ("sheet_id", "row", "col", "data_type", "value") if c not in cells.columns]
    if missing:
        return ValidationReport({f"columns missing: {', '.join(missing)}": 1})
    kinds = dict(cells.dtypes)
    if kinds["value"] != "string":
        return ValidationReport({f"value must be a string, not {kinds['value']}": 1})
    both = coordinate_checks(cells).join(value_checks(cells), "sheet_id")
    totals = both.agg(*[F.sum(c).alias(c) for c in both.columns if c != "sheet_id"]).first().asDict()
    return ValidationReport({k: v for k, v in totals.items() if v})
