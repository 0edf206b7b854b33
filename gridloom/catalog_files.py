"""More registered queries: file types, office packages, archives and findings, built from the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .catalog import query, table
from .catalog_tables import _values
from .functions.store import shared_path
from .sources import explore, registry
from .sources.delimited import csv_cells, dialects
from .sources.magic import extension, file_type

OLE_HEAD = "D0CF11E0A1B11AE1" + "00" * 504
PACKAGE = "504B0304" + "00" * 26 + b"[Content_Types].xml".hex()
#: (type, bytes in hex): the families that need more than their first bytes, and texts.
FAMILIES = (
    ("doc", OLE_HEAD + "ECA5C100"),
    ("xls", OLE_HEAD + "0908100000060500"),
    ("xls", OLE_HEAD + "FDFFFFFF22"),
    ("ppt", OLE_HEAD + "FDFFFFFF0E"),
    ("ppt", OLE_HEAD + "A0461DF0"),
    ("ole", OLE_HEAD + "00000000"),
    ("docx", PACKAGE + b"word/document.xml".hex()),
    ("pptx", PACKAGE + b"ppt/presentation.xml".hex()),
    ("xlsx", PACKAGE + b"xl/workbook.xml".hex()),
    ("zip", "504B0304" + b"xl/workbook.xml".hex()),
    ("tar", "00" * 257 + "7573746172"),
    ("txt", "EFBBBF41" + "00" * 4),
    ("unknown", "41420043"),
    ("sav", "24464C3240"),
    ("xml", "EFBBBF3C3F786D6C"),
)


@query("SELECT o_orderkey, (['" + "', '".join(t for t, _ in FAMILIES) + f"'])[o_custkey % {len(FAMILIES)} + 1] AS file_type FROM orders")
def magic_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per order, of a family by customer, with the order's key behind its bytes where its family has no end."""
    raw = F.array(*[F.lit(h) for _, h in FAMILIES])
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.element_at(raw, (F.col("o_custkey") % len(FAMILIES) + 1).cast("int"))).alias("content"))
    return own.select("o_orderkey", file_type(F.col("content")).alias("file_type"))


@query(r"""SELECT p_partkey, lower(regexp_extract(p_name || (['.CSV', '.tar.gz', '', '.d/x', '.x\y.Txt'])[p_partkey % 5 + 1], '\.([^./\\]+)$', 1)) AS extension FROM part""")
def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ends = F.array(*map(F.lit, (".CSV", ".tar.gz", "", ".d/x", ".x\\y.Txt")))
    return p.select("p_partkey", extension(F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % 5 + 1).cast("int")))).alias("extension"))


READERS = {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "html": "html", "xml": "html", "xlsx": "xlsx", "docx": "docx", "pptx": "pptx", "sas7bdat": "sas", "xpt": "sas", "dta": "stata", "zip": "archive", "tar": "archive", "gz": "archive", "bz2": "archive", "xz": "archive"}


@query(_values([(f[0], f[1], f[2], f[3], READERS.get(f[0], "")) for f in registry.FORMATS], "type, kind, compressed, archived, reader"))
def supported_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(registry.supported_formats(), "type string, kind string, compressed boolean, archived boolean, reader string")


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _office(kind: str, rows: list[list[object]]) -> bytes:
    """A package of one table."""
    if kind == "xlsx":
        cell = lambda r, c, v: f'<c r="{chr(64 + c)}{r}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        return _package({
            "[Content_Types].xml": "<Types/>",
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="one" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>",
        })
    body = "<tbl>" + "".join("<tr>" + "".join(f"<tc><p><r><t>{v}</t></r></p></tc>" for v in row) + "</tr>" for row in rows) + "</tbl>"
    name = {"docx": "word/document.xml", "pptx": "ppt/slides/slide1.xml"}[kind]
    return _package({"[Content_Types].xml": "<Types/>", name: f"<document><body>{body}</body></document>"})


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS INTEGER) AS r FROM nation),
c AS (SELECT n_regionkey AS region, r AS "row", 1 AS col, CAST(n_nationkey AS VARCHAR) AS value, true AS number FROM r UNION ALL SELECT n_regionkey, r, 2, n_name, false FROM r UNION ALL SELECT DISTINCT n_regionkey, 1, 1, 'key', false FROM r UNION ALL SELECT DISTINCT n_regionkey, 1, 2, 'name', false FROM r)
SELECT k.kind, region, "row", col, CASE WHEN number AND k.kind = 'xlsx' THEN 'numeric' ELSE 'character' END AS data_type, value FROM c, (VALUES ('xlsx'), ('docx'), ('pptx')) AS k(kind)""")
def office_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook, a document and a presentation per region with its nations, typed by their bytes and read by their readers."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    files = n.crossJoin(spark.createDataFrame([("xlsx",), ("docx",), ("pptx",)], "kind string"))  # three rows on the other side

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[["key", "name"], *([int(x["n_nationkey"]), x["n_name"]] for x in own)] for own in batch["rows"]]
            yield pd.DataFrame({"kind": batch["kind"], "region": batch["n_regionkey"], "content": [_office(k, x) for k, x in zip(batch["kind"], rows, strict=True)]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, r, *cell) for k, r, raw in zip(batch["kind"], batch["region"], batch["content"], strict=True) for _, reader in registry.readers(k) for _, sheet in reader(bytes(raw)) for cell in sheet]
            yield pd.DataFrame(found, columns=["kind", "region", "row", "col", "data_type", "value"])

    packed = files.mapInPandas(write, "kind string, region int, content binary")
    typed = packed.select(file_type(F.col("content")).alias("kind"), "region", "content")
    return typed.mapInPandas(read, "kind string, region int, row int, col int, data_type string, value string")


def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a folder that holds the nations as text and as compressed text."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    own = spark.createDataFrame([(-1, "key,name,region")], "n_nationkey int, line string").unionByName(n).repartition(1).sortWithinPartitions("n_nationkey").select("line")
    path = shared_path(spark, "folder")
    own.write.mode("overwrite").text(f"{path}/plain")
    own.write.mode("overwrite").option("compression", "gzip").text(f"{path}/packed")
    return explore.explore(spark, path)


@query(_values([(0, "txt", True, True, 1, None), (0, "gz", False, True, 1, None), (1, "txt", True, True, 1, "gz")], "depth, file_type, is_readable, is_explored, n, held_in"))
def explore_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a text and a compressed one: the member is a finding one level deeper, under its archive."""
    found = _folder(spark, sf_dir)
    held = explore.finding_edges(found).select("path", extension(F.col("parent_name")).alias("held_in"))
    return found.join(held, "path").groupBy("depth", "file_type", "is_readable", "is_explored", "held_in").agg(F.count("*").alias("n")).select(F.col("depth"), "file_type", "is_readable", "is_explored", F.col("n").cast("int"), "held_in")


@query("""WITH r AS (SELECT n_nationkey, n_name, n_regionkey, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INTEGER) AS r FROM nation)
SELECT "row", col, value, CAST(2 AS BIGINT) AS sheets FROM (SELECT r AS "row", 1 AS col, CAST(n_nationkey AS VARCHAR) AS value FROM r UNION ALL SELECT r, 2, n_name FROM r UNION ALL SELECT r, 3, CAST(n_regionkey AS VARCHAR) FROM r UNION ALL SELECT 1, 1, 'key' UNION ALL SELECT 1, 2, 'name' UNION ALL SELECT 1, 3, 'region')""")
def read_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of both files."""
    found, errors = explore.read_findings(_folder(spark, sf_dir))
    return found.groupBy("row", "col", "value").agg(F.count_distinct("sheet_id").alias("sheets"))


@query("SELECT count(*) AS files, count(*) AS different, count(*) FILTER (readable) AS readable, sum(size) AS size FROM (SELECT s_suppkey % 2 = 0 AS readable, s_nationkey AS size FROM supplier)")
def finding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/data/a/"), "s_name").alias("path"), (F.col("s_suppkey") % 2 == 0).alias("is_readable"), F.col("s_nationkey").cast("bigint").alias("size"), F.lit("txt").alias("file_type"))
    names = explore.well_names(s).agg(F.count_distinct("well_name").alias("different"))
    return explore.finding_stats(s).select("files", "readable", "size").join(names).select("files", "different", "readable", "size")


@query("SELECT s_name || '/' || s_suppkey % 7 AS well_name FROM supplier")
def well_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/data/a/"), "s_name", F.lit("/"), (F.col("s_suppkey") % 7).cast("string")).alias("path"))
    return explore.well_names(s).select("well_name")


@query("""SELECT s_suppkey, (['empty', 'unknown', 'no reader', 'large'])[s_suppkey % 6 + 1] AS problem FROM supplier WHERE s_suppkey % 6 < 4""")
def file_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), (F.col("s_suppkey") % 6).alias("k"))
    kind = F.when(F.col("k") == 1, "unknown").when(F.col("k") == 2, "pdf").when(F.col("k") == 4, "zip").otherwise("txt")
    size = F.when(F.col("k") == 0, 0).when(F.col("k") == 3, explore.LARGE + 1).otherwise(5).cast("bigint")
    own = s.select("path", kind.alias("file_type"), size.alias("size"), (F.col("k") == 0).alias("is_empty"), (kind == "txt").alias("is_readable"))
    return explore.check_files(own).select(F.col("path").cast("int").alias("s_suppkey"), "problem")


@query(_values([("decimal comma", "semicolon"), ("quoted comma", "comma"), ("ragged tab", "tab")], "sheet_id, dialect"))
def dialect_detect_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with decimal commas between semicolons, with quoted commas, and with ragged tabs."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey <= 60").withColumn("line_no", F.row_number().over(cells_order()))
    money = F.replace(F.format_string("%.2f", F.col("s_acctbal").cast("double")), F.lit("."), F.lit(","))
    key = F.col("s_suppkey").cast("string")
    parts = {
        "decimal comma": F.concat_ws(";", key, "s_name", money, F.col("s_nationkey").cast("string")),
        "quoted comma": F.concat_ws(",", key, F.concat(F.lit('"'), "s_name", F.lit(', '), key, F.lit('"')), F.col("s_nationkey").cast("string")),
        "ragged tab": F.when(F.col("s_suppkey") % 5 == 0, key).otherwise(F.concat_ws("\t", key, F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")), F.col("s_nationkey").cast("string"))),
    }
    out = None
    for name, line in parts.items():
        own = s.select(F.lit(name).alias("sheet_id"), "line_no", line.alias("line"))
        out = own if out is None else out.unionAll(own)
    return dialects(out)


def cells_order() -> WindowSpec:
    return Window.partitionBy(F.lit(1)).orderBy("s_suppkey")


@query("""WITH s AS (SELECT *, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS r FROM supplier)
SELECT r AS "row", 1 AS col, s_name || ';' || s_suppkey AS value FROM s UNION ALL SELECT r, 2, 'a, "b" ' || s_nationkey FROM s UNION ALL SELECT r, 4, CAST(s_nationkey AS VARCHAR) FROM s""")
def csv_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as comma-separated whatever else they hold: quoted commas, doubled quotes, an empty field."""
    s = table(spark, sf_dir, "supplier").withColumn("line_no", F.row_number().over(cells_order()))
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    line = F.concat_ws(",", F.concat_ws(";", "s_name", key), F.concat(F.lit('"a, ""b"" '), nation, F.lit('"')), F.lit(""), nation)
    return csv_cells(s.select(F.lit("s").alias("sheet_id"), "line_no", line.alias("line"))).select("row", "col", "value")
