"""Files, folders and archives as a relation of findings, and their sheets as cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import kept
from .archive import DECOMPRESSORS
from .delimited import text_cells, text_lines
from .magic import extension, file_type
from .registry import readers

FINDINGS = "root string, path string, name string, depth int, file_type string, size bigint, is_empty boolean, is_readable boolean, is_explored boolean, content binary"
#: Bytes above which a file counts as large; such files are read, but one task holds all of one.
LARGE = 1 << 30


def _found(files: DataFrame, root: F.Column, depth: int) -> DataFrame:
    kind = file_type(F.col("content"))
    kind = F.when((kind == "txt") & F.decode(F.substring("content", 1, 4096), "ISO-8859-1").rlike("(?i)<(html|table|!doctype html)"), "html").otherwise(kind)
    kind = F.when((kind == "txt") & extension(F.col("path")).isin("csv", "tsv"), extension(F.col("path"))).otherwise(kind)
    known = ("txt", "csv", "tsv", "html", "xml", "xlsx", "docx", "pptx", "sas7bdat", "xpt", "dta")
    out = files.select(root.alias("root"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit(depth).alias("depth"), kind.alias("file_type"), F.length("content").cast("bigint").alias("size"), "content")
    return out.select("root", "path", "name", "depth", "file_type", "size", (F.col("size") == 0).alias("is_empty"), F.col("file_type").isin(*known).alias("is_readable"), (~F.col("file_type").isin(*DECOMPRESSORS)).alias("is_explored"), "content")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, kind, raw in zip(batch["path"], batch["file_type"], batch["content"], strict=True):
            try:
                found = DECOMPRESSORS[kind](bytes(raw), path)
            except Exception:  # a broken archive has no members; the finding itself stays
                found = []
            if found:
                yield pd.DataFrame({"parent": path, "path": [f"{path}/{n}" for n, _ in found], "content": [b for _, b in found]})


def explore(spark: SparkSession, path: str, max_depth: float = math.inf) -> DataFrame:
    """One row per file below a path, members of archives included, each archive one level deeper; at max_depth archives stay
    closed (is_explored false). The bytes travel with the findings, so nothing is unpacked to a disk; each level of archives is
    kept as it is opened, so that no level is opened twice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    level = _found(files, F.lit("<root>"), 0)
    out, depth = level, 0
    while depth < max_depth:
        depth += 1
        packed = level.where(F.col("file_type").isin(*DECOMPRESSORS)).select("path", "file_type", "content")
        if packed.isEmpty():
            break
        inner = packed.mapInPandas(_members, "parent string, path string, content binary")
        level = kept(_found(inner, F.col("parent"), depth))
        out = out.unionByName(level)
    opened = out.select(F.col("root").alias("path")).distinct().withColumn("opened", F.lit(True))
    return out.join(opened, "path", "left").withColumn("is_explored", F.col("is_explored") | F.coalesce("opened", F.lit(False))).drop("opened")


def well_names(findings: DataFrame) -> DataFrame:
    """Adds well_name: the path below the folder that all findings share, archive members after their archive."""
    parts = findings.select(F.split("path", "/").alias("p"))
    shared = parts.agg(F.min(F.size("p")).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    n = 0
    while shared and shared["lo"] and n < min(shared["n"], len(shared["lo"]), len(shared["hi"])) - 1 and shared["lo"][n] == shared["hi"][n]:
        n += 1
    return findings.withColumn("well_name", F.array_join(F.slice(F.split("path", "/"), n + 1, 1000), "/"))


def finding_edges(findings: DataFrame) -> DataFrame:
    """(root, path, name, parent_name): each finding under the one that holds it; parent_name is null for what lies in folders."""
    held = findings.select(F.col("path").alias("root"), F.col("name").alias("parent_name")).distinct()
    return findings.select("root", "path", "name").join(held, "root", "left").distinct()


def check_files(findings: DataFrame) -> DataFrame:
    """(path, problem) of the findings that can't be read as they are: empty, unknown, without a reader, or large."""
    problem = F.when(F.col("is_empty"), "empty").when(F.col("file_type") == "unknown", "unknown").when(~F.col("is_readable") & ~F.col("file_type").isin(*DECOMPRESSORS), "no reader").when(F.col("size") > LARGE, "large")
    return findings.select("path", problem.alias("problem")).where("problem is not null")


def finding_stats(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.array_sort(F.collect_set("file_type")).alias("types"), F.count_if(F.col("is_readable")).alias("readable"))


def _sheets(omit: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, kind, raw in zip(batch["well_name"], batch["file_type"], batch["content"], strict=True):
                error = ""
                for _, read in readers("xml" if kind == "html" else kind, omit):
                    try:
                        rows = [(f"{name}/{sheet}", *cell, "") for sheet, cells in read(bytes(raw)) for cell in cells]
                    except Exception as e:  # the next reader may know better; the last error is reported
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if rows:
                        yield pd.DataFrame(rows, columns=["sheet_id", "row", "col", "data_type", "value", "error"])
                        error = ""
                        break
                if error:
                    yield pd.DataFrame([(name, 0, 0, None, None, error)], columns=["sheet_id", "row", "col", "data_type", "value", "error"])

    return run


def read_findings(findings: DataFrame, omit: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(cells, errors): cells of all readable findings, one sheet per table, and (sheet_id, error) of files that no reader
    could read. omit: formats or readers to leave out."""
    own = well_names(findings.where("is_readable and not is_empty"))
    text = own.where(F.col("file_type").isin(*[k for k in ("txt", "csv", "tsv") if k not in omit]))
    lines = text_lines(text.select(F.col("well_name").alias("sheet_id"), "content"))
    rest = own.where(~F.col("file_type").isin("txt", "csv", "tsv")).select("well_name", "file_type", "content")
    found = rest.mapInPandas(_sheets(tuple(omit)), "sheet_id string, row int, col int, data_type string, value string, error string")
    cells = text_cells(lines).unionByName(found.where("error = ''").drop("error"))
    return cells, found.where("error <> ''").select("sheet_id", "error")
