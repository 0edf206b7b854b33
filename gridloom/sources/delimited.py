"""Delimited text whose separator is not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: The dialects tried, as (name, separator pattern).
DIALECTS = (("comma", ","), ("semicolon", ";"), ("space", r"[ \t]+"), ("tab", r"\t"))
PREVIEW = 100


def fields(line: Column, name: str, pattern: str) -> Column:
    """A line's fields; a separator between double quotes doesn't count, and quotes around a field go."""
    if name == "space":
        line = trimmed(line)
    parts = F.split(line, pattern + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"(.*)"\s*$', "$1"), '""', '"'))


def dialects(lines: DataFrame) -> DataFrame:
    """(sheet_id, dialect) of (sheet_id, line_no, line) rows, from the first PREVIEW lines of each file.

    Each dialect is scored by its lines, its columns, how even its lines are, how few different characters the columns hold
    below the first line, and how narrow its fields are; each score is scaled to 0..1 over the dialects of a file, and the
    highest mean of those that there are wins, the first of equals."""
    head = lines.where(F.col("line_no") <= PREVIEW).where(F.length(trimmed(F.col("line"))) > 0)
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("dialect"), fields(F.col("line"), n, p).alias("f")) for k, (n, p) in enumerate(DIALECTS)])
    each = head.select("sheet_id", "line_no", F.explode(tried).alias("t")).select("sheet_id", "line_no", "t.*")
    shape = each.groupBy("sheet_id", "k", "dialect").agg(F.count("*").alias("rows"), F.max(F.size("f")).alias("cols"), F.stddev_samp(F.size("f")).alias("uneven"))
    first = F.min("line_no").over(Window.partitionBy("sheet_id"))
    cells = each.withColumn("first", first).select("sheet_id", "k", (F.col("line_no") > F.col("first")).alias("below"), F.posexplode("f").alias("c", "v"))
    wide = cells.groupBy("sheet_id", "k").agg(F.max(F.length("v")).alias("wide"))
    signs = cells.where("below").select("sheet_id", "k", "c", F.explode(F.split("v", "")).alias("s")).where("s <> ''")
    kinds = signs.groupBy("sheet_id", "k", "c").agg(F.count_distinct("s").alias("kinds")).groupBy("sheet_id", "k").agg(F.max("kinds").alias("kinds"))
    all_ = shape.join(wide, ["sheet_id", "k"]).join(kinds, ["sheet_id", "k"], "left")
    w = Window.partitionBy("sheet_id")

    def scaled(c: Column) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (c - lo) / (hi - lo)).when(c.isNotNull(), 0.0)

    parts = [F.col("rows").cast("double"), F.col("cols").cast("double"), -F.col("uneven"), -F.col("kinds").cast("double"), -F.col("wide").cast("double")]
    known = F.array_compact(F.array(*map(scaled, parts)))
    score = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return all_.withColumn("score", score).groupBy("sheet_id").agg(F.max_by("dialect", F.struct("score", -F.col("k"))).alias("dialect"))


def text_cells(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Cells of (sheet_id, line_no, line) rows, each file in its own dialect. Empty fields are no cells."""
    found = dialects(lines) if found is None else found
    pick = F.lit(None).cast("array<string>")
    for n, p in reversed(DIALECTS):
        pick = F.when(F.col("dialect") == n, fields(F.col("line"), n, p)).otherwise(pick)
    cells = lines.join(found, "sheet_id").select("sheet_id", F.col("line_no").cast("int").alias("row"), F.posexplode(pick).alias("c", "value"))
    cells = cells.select("sheet_id", "row", (F.col("c") + 1).cast("int").alias("col"), trimmed(F.col("value")).alias("value")).where("value <> ''")
    return cells.select("sheet_id", "row", "col", F.when(F.col("value").rlike(r"^[+-]?\d+(\.\d+)?$"), "numeric").otherwise("character").alias("data_type"), "value")


def csv_cells(lines: DataFrame) -> DataFrame:
    """Cells of (sheet_id, line_no, line) rows with commas between fields, without a look at the dialect."""
    return text_cells(lines, lines.select("sheet_id", F.lit("comma").alias("dialect")).distinct())


def text_lines(contents: DataFrame) -> DataFrame:
    """(sheet_id, line_no, line) of (sheet_id, content) rows with bytes."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return contents.select("sheet_id", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("k", "line")).select("sheet_id", (F.col("k") + 1).alias("line_no"), "line")
