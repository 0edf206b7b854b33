"""Tables into cells and back, and what rearranges or picks cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decimal_text, name_suffixes
from ..schema import KEY, sheet

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Names of types in the layouts that carry one column per type.
_NUMERIC_TAGS = ("numeric", "integer", "double", "dbl", "int", "cplx")


def _is_number(kind: str) -> bool:
    return kind.split("(")[0] in _NUMBERS


def as_text(c: Column, kind: str) -> Column:
    """Numbers without exponents; all else as Spark writes it."""
    if kind.split("(")[0] in ("float", "double", "decimal"):
        return decimal_text(c)
    return c.cast("string")


def melt(df: DataFrame, order_by: list[str], sheet_id: str | Column = "sheet_1", columns: list[str] | None = None, take_col_names: bool = True, take_row_names: str | None = None) -> DataFrame:
    """A table's cells, null ones left out. Rows are numbered within the sheet in the given order; a header row comes first.

    sheet_id: a name, or a column that tells the rows of several sheets apart; numbering is per sheet, so sheets are
    dealt over the cluster and one sort per sheet is all that is shuffled."""
    kinds = dict(df.dtypes)
    names = [c for c in columns or df.columns if c != take_row_names]
    names = [take_row_names, *names] if take_row_names else names
    bad = [c for c in names if kinds[c].startswith(("array", "map", "struct", "binary"))]
    names = [c for c in names if c not in bad]
    own = F.lit(sheet_id) if isinstance(sheet_id, str) else sheet_id
    head = int(take_col_names)
    rows = df.select(own.alias("sheet_id"), *[F.col(c) for c in dict.fromkeys([*names, *order_by])])
    rows = rows.withColumn("row", (F.row_number().over(sheet().orderBy(*order_by)) + head).cast("int"))
    cells = [
        F.struct(F.lit(k).alias("col"), F.lit("numeric" if _is_number(kinds[c]) else "character").alias("data_type"), as_text(F.col(c), kinds[c]).alias("value"))
        for k, c in enumerate(names, 1)
    ]
    out = rows.select("sheet_id", "row", F.explode(F.array(*cells)).alias("c")).select("sheet_id", "row", "c.col", "c.data_type", "c.value").where("value is not null")
    if take_col_names:
        header = F.array(*[F.struct(F.lit(k).alias("col"), F.lit(c).alias("value")) for k, c in enumerate(names, 1) if c != take_row_names])
        top = rows.select("sheet_id").distinct().select("sheet_id", F.lit(1).alias("row"), F.explode(header).alias("c")).select("sheet_id", "row", "c.col", F.lit("character").alias("data_type"), "c.value")
        out = top.unionByName(out)
    return out


def from_coordinates(df: DataFrame, sheet_id: str | Column = "sheet_1", value: str = "value") -> DataFrame:
    """(row, col, value) rows."""
    kind = dict(df.dtypes)[value]
    own = F.lit(sheet_id) if isinstance(sheet_id, str) else sheet_id
    return df.select(own.alias("sheet_id"), F.col("row").cast("int"), F.col("col").cast("int"), F.lit("numeric" if _is_number(kind) else "character").alias("data_type"), as_text(F.col(value), kind).alias("value")).where("value is not null")


def from_typed(df: DataFrame, tag: str, sheet_id: str | Column = "sheet_1") -> DataFrame:
    """(row, col, tag, one column per type) rows, the tag naming the column that holds the value."""
    kinds = dict(df.dtypes)
    parts = [c for c in df.columns if c not in ("row", "col", tag, "sheet_id")]
    own = F.lit(sheet_id) if isinstance(sheet_id, str) else sheet_id
    numeric = F.col(tag).isin(*_NUMERIC_TAGS)
    return df.select(own.alias("sheet_id"), F.col("row").cast("int"), F.col("col").cast("int"), F.when(numeric, "numeric").otherwise("character").alias("data_type"), F.coalesce(*[as_text(F.col(c), kinds[c]) for c in parts]).alias("value")).where("value is not null")


def from_spreadsheet(df: DataFrame) -> DataFrame:
    """Rows with sheet, row, col, data_type, is_blank and numeric, date, logical, character columns; blanks and errors go."""
    value = F.when(F.col("data_type") == "numeric", decimal_text(F.col("numeric"))).when(F.col("data_type") == "date", F.col("date").cast("string"))
    value = value.when(F.col("data_type") == "logical", F.upper(F.col("logical").cast("string"))).when(F.col("data_type") == "character", F.col("character"))
    kind = F.when(F.col("data_type") == "numeric", "numeric").otherwise("character")
    found = df.where("not is_blank and data_type <> 'error'")
    return found.select(F.col("sheet").alias("sheet_id"), F.col("row").cast("int"), F.col("col").cast("int"), kind.alias("data_type"), value.alias("value")).where("value is not null").distinct()


def from_melted_text(df: DataFrame, sheet_id: str | Column = "sheet_1") -> DataFrame:
    """(row, col, data_type, value) rows of a text reader; missing values go."""
    own = F.lit(sheet_id) if isinstance(sheet_id, str) else sheet_id
    kind = F.when(F.col("data_type").isin("integer", "double"), "numeric").otherwise("character")
    return df.where("data_type <> 'missing' and value is not null").select(own.alias("sheet_id"), F.col("row").cast("int"), F.col("col").cast("int"), kind.alias("data_type"), F.col("value").cast("string")).distinct()


def detect_layout(df: DataFrame) -> tuple[str, str | None]:
    """(layout, its tag column): cells, spreadsheet, melted_text, typed, coordinates or table."""
    names = set(df.columns)
    if not {"row", "col"} <= names:
        return "table", None
    if {"sheet", "is_blank", "data_type", "numeric", "character"} <= names:
        return "spreadsheet", "data_type"
    if {"data_type", "value"} <= names:
        kinds = {r[0] for r in df.select("data_type").distinct().limit(20).collect()}
        return ("cells" if kinds <= {"numeric", "character"} and "sheet_id" in names else "melted_text"), "data_type"
    rest = [c for c in df.columns if c not in ("row", "col", "sheet_id")]
    for tag in (c for c, k in df.dtypes if k == "string" and c in rest):
        found = {r[0] for r in df.select(tag).limit(50).distinct().collect()}
        if found and found <= names - {tag}:
            return "typed", tag
    if "value" in names or len(rest) == 1:
        return "coordinates", "value" if "value" in names else rest[0]
    return "table", None


def as_cells(df: DataFrame, sheet_id: str | Column = "sheet_1", order_by: list[str] | None = None, take_col_names: bool = True, take_row_names: str | None = None) -> DataFrame:
    """Cells of any layout that detect_layout() knows; cells pass through."""
    layout, tag = detect_layout(df)
    if layout == "cells":
        return df
    if layout == "spreadsheet":
        return from_spreadsheet(df)
    if layout == "melted_text":
        return from_melted_text(df, sheet_id)
    if layout == "typed":
        return from_typed(df, tag, sheet_id)
    if layout == "coordinates":
        return from_coordinates(df, sheet_id, tag)
    if order_by is None:  # the order in which rows arrive; Spark keeps it for local data and single files
        return melt(df.withColumn("_at", F.monotonically_increasing_id()), ["_at"], sheet_id, df.columns, take_col_names, take_row_names)
    return melt(df, order_by, sheet_id, None, take_col_names, take_row_names)


def from_rows(spark: SparkSession, rows: list[list[object]], sheet_id: str = "sheet_1") -> DataFrame:
    """A matrix as cells; None and empty strings are no cells."""
    found = [
        (sheet_id, r, c, "numeric" if isinstance(v, int | float) and not isinstance(v, bool) else "character", (f"{v:.10f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)))
        for r, row in enumerate(rows, 1)
        for c, v in enumerate(row, 1)
        if v is not None and v != ""
    ]
    return spark.createDataFrame(found, "sheet_id string, row int, col int, data_type string, value string")


def densify(cells: DataFrame, columns: list[int]) -> DataFrame:
    """One row per sheet row, one column per given sheet column (named by its number); columns are given, not searched for."""
    return cells.groupBy("sheet_id", "row").pivot("col", columns).agg(F.first("value"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(*[F.col({"row": "col", "col": "row"}.get(c, c)).alias(c) for c in cells.columns])


def flip(cells: DataFrame, by_row: bool = True) -> DataFrame:
    axis = "row" if by_row else "col"
    return cells.withColumn(axis, (F.max(axis).over(sheet()) + 1 - F.col(axis)).cast("int"))


def rotate(cells: DataFrame, clockwise: bool = False) -> DataFrame:
    return flip(transpose(cells), by_row=not clockwise)


def mask(cells: DataFrame) -> DataFrame:
    """Values by what they are alone, to share a sheet's form without its content."""
    return cells.withColumn("value", F.when(F.col("type") == "attribute", "A").when(F.col("type") == "value", "0").otherwise(""))


def summary(cells: DataFrame) -> DataFrame:
    """One row per sheet: extent, density and cells by data type."""
    size = (F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)
    return cells.groupBy("sheet_id").agg(
        (F.max("row") - F.min("row") + 1).alias("n_rows"),
        (F.max("col") - F.min("col") + 1).alias("n_cols"),
        F.count("*").alias("n_cells"),
        F.count_if(F.col("data_type") == "numeric").alias("n_numeric"),
        F.count_if(F.col("data_type") == "character").alias("n_character"),
        (F.count("*") / size).alias("density"),
    )


def nearest(cells: DataFrame, row: int | None = None, col: int | None = None, relative: bool = False) -> DataFrame:
    """Per sheet the cells closest to a place, all of them at a tie; relative: the place counts from the sheet's first cell."""
    at = lambda axis, n: F.col(axis) - (F.lit(n) + (F.min(axis).over(sheet()) - 1 if relative else 0))
    if row is not None and col is not None:
        far = at("row", row) * at("row", row) + at("col", col) * at("col", col)
    else:
        far = F.abs(at("row", row) if row is not None else at("col", col))
    out = cells.withColumn("_far", far)
    return out.withColumn("_least", F.min("_far").over(sheet())).where("_far = _least").drop("_far", "_least")


def top_left(cells: DataFrame, n: int = 1000) -> DataFrame:
    """The first n rows and columns of each sheet."""
    low = cells.withColumn("_r", F.min("row").over(sheet())).withColumn("_c", F.min("col").over(sheet()))
    return low.where((F.col("row") < F.col("_r") + n) & (F.col("col") < F.col("_c") + n)).drop("_r", "_c")


def keep_cells(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    return cells.join(wanted.select(*KEY), KEY, "left_semi")


def drop_cells(cells: DataFrame, unwanted: DataFrame) -> DataFrame:
    return cells.join(unwanted.select(*KEY), KEY, "left_anti")


def retype(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with the types that (sheet_id, row, col, type) rows give them."""
    return cells.join(changes.select(*KEY, F.col("type").alias("_type")), KEY, "left").withColumn("type", F.coalesce("_type", "type")).drop("_type")


def prune(df: DataFrame, most: int = 1, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, object]]:
    """Drops columns with at most `most` distinct values; returns the rest and the smallest value of each dropped column."""
    names = [c for c in df.columns if c not in (keep or [])]
    found = df.agg(*[F.count_distinct(c).alias(f"n{k}") for k, c in enumerate(names)], *[F.min(c).alias(f"v{k}") for k, c in enumerate(names)]).first()
    gone = {c: found[f"v{k}"] for k, c in enumerate(names) if found[f"n{k}"] <= most}
    return df.drop(*gone), gone


def container_meta(cells: DataFrame) -> DataFrame:
    """(sheet_id, content, nrow, ncol, size): the sheet's distinct lower-case attribute texts and its extent."""
    text = F.when(F.col("type") == "attribute", F.lower(F.trim("value")))
    return cells.groupBy("sheet_id").agg(
        F.array_join(F.array_sort(F.collect_set(text)), " ").alias("content"),
        (F.max("row") - F.min("row") + 1).alias("nrow"),
        (F.max("col") - F.min("col") + 1).alias("ncol"),
        F.count("*").alias("size"),
    )


def filter_sheets(cells: DataFrame, condition: Column | str) -> DataFrame:
    """The cells of sheets whose container meta (content, nrow, ncol, size) meets a condition."""
    return cells.join(container_meta(cells).where(condition).select("sheet_id"), "sheet_id", "left_semi")


def container(tables: dict[str, DataFrame]) -> DataFrame:
    """Cells of several sheets as one relation, each under its name; blank names and repeats are made unique."""
    out = None
    for name, own in zip(name_suffixes(list(tables)), tables.values(), strict=True):
        own = own.select(F.lit(name).alias("sheet_id"), *[c for c in own.columns if c != "sheet_id"])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("a container needs a sheet")
    return out


def pull(df: DataFrame, column: str | int = 1) -> DataFrame:
    """One column, by name or by place; places count from 1, negative ones from the end."""
    return df.select(df.columns[column - (column > 0)] if isinstance(column, int) else column)


def typed_table(cells: DataFrame, columns: list[int]) -> DataFrame:
    """One sheet as a table: its first row names the columns, and each column is a bigint, a double or a string, whichever
    all of its texts can be read as. One small job looks at the names and texts."""
    top = cells.agg(F.min("row")).first()[0]
    body = cells.where(F.col("row") > top)
    number = lambda kind: F.bool_and(F.expr(f"try_cast(trim(value) as {kind}) is not null"))
    kinds = {r["col"]: "bigint" if r["whole"] else "double" if r["real"] else "string" for r in body.groupBy("col").agg(number("bigint").alias("whole"), number("double").alias("real")).collect()}
    names = {r["col"]: r["value"] for r in cells.where(F.col("row") == top).select("col", "value").collect()}
    shown = name_suffixes([names.get(c, f"col_{c}") for c in columns])
    wide = densify(body, columns)
    return wide.select(*[F.trim(F.col(str(c))).cast(kinds.get(c, "string")).alias(n) for c, n in zip(columns, shown, strict=True)])


def content_variation(texts: DataFrame, sheet_col: str = "sheet_id", text_col: str = "content") -> DataFrame:
    """1 - (words in every sheet) / (words in any): one row with n_common, n_words and variation."""
    words = texts.select(sheet_col, F.explode(F.split(F.lower(text_col), r"\s+")).alias("word")).where("word <> ''").distinct()
    sheets = texts.agg(F.count_distinct(sheet_col).alias("sheets"))
    by = words.groupBy("word").agg(F.count("*").alias("n")).crossJoin(sheets)  # one row on the other side
    return by.agg(F.count_if(F.col("n") == F.col("sheets")).alias("n_common"), F.count("*").alias("n_words")).select("n_common", "n_words", (1 - F.col("n_common") / F.col("n_words")).alias("variation"))


def ranked(df: DataFrame, key: str, within: list[str] | None = None) -> Column:
    return F.dense_rank().over(Window.partitionBy(*(within or ["sheet_id"])).orderBy(key))
