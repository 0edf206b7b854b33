"""Tidy rows from an analysis, and back from tidy rows to cells."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import kept
from ..schema import LONG
from .analyze import CellAnalysis, Place, header_of

ROW = ["sheet_id", "data_block", "row", "col", "value"]


def compose_long(ca: CellAnalysis, major_only: bool = False) -> DataFrame:
    """One row per value and header line: (sheet_id, data_block, row, col, value, attr_name, attr_value, attr_row, attr_col).

    The analysis as it stands decides: its data cells, header lines, their names and tags, edited or not. All of it is dealt
    by sheet once, and each sheet's rows come out whole. For sheets beyond a task's memory, headers.attach() gives the same
    rows for one line and tag."""
    none = F.lit(None).cast("string")

    def part(df: DataFrame, kind: str, *texts: str) -> DataFrame:
        at = [F.col(c) if c in df.columns else F.lit(0).alias(c) for c in ("row", "col")]
        return df.select("sheet_id", F.lit(kind).alias("kind"), *at, *[(F.col(texts[k]) if k < len(texts) else none).alias(f"t{k}") for k in range(5)])

    rows = part(ca.cells, "cell", "value").unionAll(part(ca.data, "data", "gid", "data_block")).unionAll(part(ca.line_cells, "at", "data_gid", "line"))
    rows = rows.unionAll(part(ca.lines.drop("row", "col"), "line", "data_gid", "line", "attr_name", "attr_group", "tag"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        text: dict[Place, str] = {}
        data: dict[str, list[Place]] = defaultdict(list)
        block: dict[str, str] = {}
        heads: dict[tuple[str, str], list[Place]] = defaultdict(list)
        lines: list[tuple[str, str, str, str, str]] = []
        for kind, r, c, *t in own[["kind", "row", "col", "t0", "t1", "t2", "t3", "t4"]].itertuples(index=False, name=None):
            if kind == "cell":
                text[r, c] = t[0]
            elif kind == "data":
                data[t[0]].append((r, c))
                block[t[0]] = t[1]
            elif kind == "at":
                heads[t[0], t[1]].append((r, c))
            else:
                lines.append(tuple(t))
        found = []
        for d, line, name, role, tag in lines:
            if role == "major" or not major_only:
                place = header_of(tag, sorted(heads[d, line]))
                found += [(block[d], *p, text[p], name, text[h], *h) for p in data[d] if (h := place(p)) is not None]
        out = pd.DataFrame(found, columns=["data_block", "row", "col", "value", "attr_name", "attr_value", "attr_row", "attr_col"])
        out.insert(0, "sheet_id", own["sheet_id"].iloc[0])
        return out.astype({c: "int32" for c in ("row", "col", "attr_row", "attr_col")})

    return rows.groupBy("sheet_id").applyInPandas(run, LONG)


def compose_wide(long: DataFrame, names: list[str] | None = None, traceback: bool = False) -> DataFrame:
    """One row per value, one column per header name. names: the columns; searched for (one small job) if not given.
    traceback: cellAddress_<name> tells the header cell as row_col."""
    if names is None:
        names = sorted(r[0] for r in long.select("attr_name").distinct().collect())
    aggregates = [F.min("attr_value").alias("v")]
    if traceback:
        aggregates.append(F.min(F.concat_ws("_", F.col("attr_row").cast("string"), F.col("attr_col").cast("string"))).alias("a"))
    wide = long.groupBy(*ROW).pivot("attr_name", names).agg(*aggregates)
    if traceback:
        return wide.select(*ROW, *[F.col(f"{n}_v").alias(n) for n in names], *[F.col(f"{n}_a").alias(f"cellAddress_{n}") for n in names])
    return wide


def compose_cells(ca: CellAnalysis, wide: bool = True, discard_raw_cols: bool = False, traceback: bool = False) -> DataFrame:
    long = compose_long(ca, major_only=discard_raw_cols)
    return compose_wide(long, traceback=traceback) if wide else long


def compose_blocks(ca: CellAnalysis) -> dict[tuple[str, str], DataFrame]:
    """The wide form of each (sheet, data block), with its own columns alone."""
    long = kept(compose_long(ca))
    found = long.groupBy("sheet_id", "data_block").agg(F.sort_array(F.collect_set("attr_name")).alias("names")).orderBy("sheet_id", "data_block").collect()
    return {(r[0], r[1]): compose_wide(long.where((F.col("sheet_id") == r[0]) & (F.col("data_block") == r[1])), r[2]) for r in found}


def traceback(ca: CellAnalysis, sheet_id: str, row: int, col: int) -> DataFrame:
    """The header cells behind one value."""
    return compose_long(ca).where((F.col("sheet_id") == sheet_id) & (F.col("row") == row) & (F.col("col") == col)).select("attr_name", "attr_value", "attr_row", "attr_col")


def traceback_external(cells: DataFrame, operation, on: list[str]) -> DataFrame:
    """What a tidying function makes of the cells, with the address of each cell that it used: it runs once on the values and
    once on their addresses, and both results meet on the columns `on`."""
    addressed = cells.withColumn("value", F.concat_ws("_", F.col("row").cast("string"), F.col("col").cast("string")))
    first, second = operation(cells), operation(addressed)
    return first.join(second.select(*on, *[F.col(c).alias(f"cellAddress_{c}") for c in second.columns if c not in on]), on)


def attribute_overview(long: DataFrame, most: int = 4) -> DataFrame:
    return long.groupBy("data_block", "attr_name").agg(F.slice(F.array_sort(F.collect_set("attr_value")), 1, most).alias("examples"))
