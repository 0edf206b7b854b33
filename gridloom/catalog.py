"""The registered queries over the engine's own operators, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import decimal_text, number_kind
from .operators import blocks, cells, classify, collate, headers, mapping, stacking
from .plans.analyze import analyze_cells
from .plans.compose import compose_long, compose_wide
from .schema import coordinate_checks, value_checks
from .sources.delimited import dialects, text_cells
from .sources.html import tables as html_tables_of
from .sources.magic import file_type

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sheets that the queries share ---------------------------------------------------------------------------------------


def crosstab(counts: DataFrame, sheet: str, row: str, col: str, value: str, corner: str) -> DataFrame:
    """Cells of one crosstab per sheet: labels in the first row and column, a corner label, values."""
    r, c = (cells.ranked(counts, x) + 1 for x in (row, col))  # numbered within the sheet
    at = counts.select(F.col(sheet).alias("sheet_id"), row, col, value)
    at = at.withColumn("r", r.cast("int")).withColumn("c", c.cast("int"))
    one, text = F.lit(1), F.lit("character")
    parts = [
        at.select("sheet_id", F.col("r").alias("row"), F.col("c").alias("col"), F.lit("numeric").alias("data_type"), F.col(value).cast("string").alias("value")),
        at.select("sheet_id", one.alias("row"), F.col("c").alias("col"), text.alias("data_type"), F.col(col).cast("string").alias("value")).distinct(),
        at.select("sheet_id", F.col("r").alias("row"), one.alias("col"), text.alias("data_type"), F.col(row).cast("string").alias("value")).distinct(),
        at.select("sheet_id", one.alias("row"), one.alias("col"), text.alias("data_type"), F.lit(corner).alias("value")).distinct(),
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def flag_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).withColumn("sheet", F.lit("flags"))
    return crosstab(counts, "sheet", "l_returnflag", "l_linestatus", "n", "flag")


def nation_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per nation: order priorities against market segments."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = joined.groupBy(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("sheet"), "o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"))
    return crosstab(counts.withColumn("priority", F.concat(F.lit("p"), "o_orderpriority")), "sheet", "priority", "c_mktsegment", "n", "priority")


NATION_COUNTS = """SELECT 'nation ' || c_nationkey AS sheet, 'p' || o_orderpriority AS priority, c_mktsegment, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def grid(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Sparse sheets of orders: a sheet per priority and 2000 order keys, a place by customer and order, the order as value.
    dealt: by sheet, for operators that take whole sheets."""
    o = table(spark, sf_dir, "orders")
    at = o.select(
        F.concat_ws(":", "o_orderpriority", F.expr("cast(o_orderkey div 2000 as string)")).alias("sheet_id"),
        (F.col("o_custkey") % 61 + 1).cast("int").alias("row"),
        (F.col("o_orderkey") % 73 + 1).cast("int").alias("col"),
        "o_orderkey",
    )
    at = (at.repartition("sheet_id") if dealt else at).groupBy("sheet_id", "row", "col").agg(F.min("o_orderkey").alias("k"))
    kind = F.when(F.col("k") % 3 == 0, "attribute").otherwise("value")
    return at.select("sheet_id", "row", "col", F.lit("numeric").alias("data_type"), F.col("k").cast("string").alias("value"), kind.alias("type"))


GRID = """grid AS (SELECT sheet_id, "row", col, CAST(k AS VARCHAR) AS value, CASE WHEN k % 3 = 0 THEN 'attribute' ELSE 'value' END AS type
FROM (SELECT o_orderpriority || ':' || (o_orderkey // 2000) AS sheet_id, CAST(o_custkey % 61 + 1 AS INTEGER) AS "row", CAST(o_orderkey % 73 + 1 AS INTEGER) AS col, min(o_orderkey) AS k FROM orders GROUP BY ALL))"""

FOUR = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(dr, dc)"
EIGHT = "(VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS s(dr, dc)"


def component_sql(name: str, source: str, prefix: str, steps: str = FOUR) -> str:
    """CTEs that end in `name` (sheet_id, row, col, gid, f): f numbers a component's first cell."""
    return f"""{name}_s AS ({source}),
{name}_e AS (SELECT a.sheet_id, a."row", a.col, b."row" AS r, b.col AS c FROM {name}_s a CROSS JOIN {steps} JOIN {name}_s b ON a.sheet_id = b.sheet_id AND b."row" = a."row" + dr AND b.col = a.col + dc),
{name}_r(sheet_id, "row", col, r, c) AS (SELECT sheet_id, "row", col, "row", col FROM {name}_s UNION SELECT x.sheet_id, x."row", x.col, e.r, e.c FROM {name}_r x JOIN {name}_e e ON x.sheet_id = e.sheet_id AND x.r = e."row" AND x.c = e.col),
{name}_f AS (SELECT sheet_id, "row", col, min(r * 1000 + c) AS f FROM {name}_r GROUP BY ALL),
{name} AS (SELECT sheet_id, "row", col, f, '{prefix}' || dense_rank() OVER (PARTITION BY sheet_id ORDER BY f) AS gid FROM {name}_f)"""


BOXES = 'min("row") AS r_min, min(col) AS c_min, max("row") AS r_max, max(col) AS c_max'
DIRECTION = """CASE WHEN "row" < r_min THEN 'N' WHEN "row" > r_max THEN 'S' ELSE '' END || CASE WHEN col < c_min THEN 'W' WHEN col > c_max THEN 'E' ELSE '' END"""
GROUP = "CASE WHEN direction IN ('N', 'S') THEN 'NS' WHEN direction IN ('W', 'E') THEN 'WE' ELSE 'corner' END"
SQUARE = 'greatest(r_min - "row", "row" - r_max, 0) * greatest(r_min - "row", "row" - r_max, 0) + greatest(c_min - col, col - c_max, 0) * greatest(c_min - col, col - c_max, 0)'
PLAIN = r"regexp_replace(CAST(CAST({} AS DECIMAL(38, 10)) AS VARCHAR), '\.?0+$', '')"


# Round trips ---------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY ALL")
def roundtrip_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = compose_long(analyze_cells(classify.numeric_values(flag_sheet(spark, sf_dir))))
    return compose_wide(long, ["N_1", "W_1"]).select(F.col("W_1").alias("flag"), F.col("N_1").alias("status"), F.col("value").alias("n"))


@query(f"SELECT sheet AS sheet_id, priority, c_mktsegment AS segment, CAST(n AS VARCHAR) AS n FROM ({NATION_COUNTS})")
def roundtrip_multi_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = compose_long(analyze_cells(classify.numeric_values(nation_sheets(spark, sf_dir))))
    return compose_wide(long, ["N_1", "W_1"]).select("sheet_id", F.col("W_1").alias("priority"), F.col("N_1").alias("segment"), F.col("value").alias("n"))


@query("SELECT o_orderpriority AS priority, 'Y' || year(o_orderdate) AS year, o_orderstatus AS status, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY ALL")
def roundtrip_two_level_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("Y"), F.year("o_orderdate").cast("string")).alias("y"), "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).withColumn("sheet_id", F.lit("two"))
    at = counts.withColumn("row", (cells.ranked(counts, "o_orderpriority") + 2).cast("int")).withColumn("col", (F.dense_rank().over(cells.Window.partitionBy("sheet_id").orderBy("y", "o_orderstatus")) + 1).cast("int"))
    values = at.select("sheet_id", "row", "col", F.col("n").cast("string").alias("n"))
    top = at.groupBy("sheet_id", F.col("y").alias("year")).agg(F.lit(1).alias("row"), F.min("col").alias("col"))
    second = at.select("sheet_id", F.lit(2).alias("row"), "col", F.col("o_orderstatus").alias("status")).distinct()
    left = at.select("sheet_id", "row", F.lit(1).alias("col"), F.col("o_orderpriority").alias("priority")).distinct()
    out = values
    for head, tag in ((top, "vl"), (second, "v"), (left, "h")):
        out = headers.attach(out, head, tag).drop("header_row", "header_col")
    return out.select("priority", "year", "status", "n")


# Cells ---------------------------------------------------------------------------------------------------------------


def _melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"))
    found = [cells.melt(table(spark, sf_dir, t), [k], t) for t, k in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _melt_sql(t: str, key: str, columns: list[tuple[str, str, str]]) -> str:
    out = []
    for k, (c, kind, text) in enumerate(columns, 1):
        out.append(f"""SELECT '{t}' AS sheet_id, 1 AS "row", {k} AS col, 'character' AS data_type, '{c}' AS value""")
        out.append(f"SELECT '{t}', CAST(row_number() OVER (ORDER BY {key}) + 1 AS INTEGER), {k}, '{kind}', {text} FROM {t}")
    return " UNION ALL ".join(out)


MELT_NATION = _melt_sql("nation", "n_nationkey", [("n_nationkey", "numeric", "CAST(n_nationkey AS VARCHAR)"), ("n_name", "character", "n_name"), ("n_regionkey", "numeric", "CAST(n_regionkey AS VARCHAR)")])
MELTED = " UNION ALL ".join(
    [
        _melt_sql("region", "r_regionkey", [("r_regionkey", "numeric", "CAST(r_regionkey AS VARCHAR)"), ("r_name", "character", "r_name")]),
        MELT_NATION,
        _melt_sql("supplier", "s_suppkey", [("s_suppkey", "numeric", "CAST(s_suppkey AS VARCHAR)"), ("s_name", "character", "s_name"), ("s_nationkey", "numeric", "CAST(s_nationkey AS VARCHAR)"), ("s_acctbal", "numeric", PLAIN.format("s_acctbal"))]),
    ]
)


@query(f"SELECT * FROM ({MELTED}) WHERE value IS NOT NULL")
def cells_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _melted(spark, sf_dir)


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.melt(table(spark, sf_dir, "nation"), ["n_nationkey"], "nation")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def cells_pivot_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = cells.densify(_nation(spark, sf_dir), [1, 2, 3]).where(F.col("row") > 1)
    return wide.select(F.col("1").alias("n_nationkey"), F.col("2").alias("n_name"), F.col("3").alias("n_regionkey"))


@query(f'SELECT sheet_id, col AS "row", "row" AS col, data_type, value FROM ({MELT_NATION})')
def cells_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.transpose(_nation(spark, sf_dir))


@query(f'SELECT sheet_id, max("row") OVER () + 1 - "row" AS "row", col, data_type, value FROM ({MELT_NATION})')
def cells_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.flip(_nation(spark, sf_dir))


@query(f'SELECT sheet_id, max(col) OVER () + 1 - col AS "row", "row" AS col, data_type, value FROM ({MELT_NATION})')
def cells_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.rotate(_nation(spark, sf_dir))


@query(f"""WITH {GRID} SELECT sheet_id, max("row") - min("row") + 1 AS n_rows, max(col) - min(col) + 1 AS n_cols, count(*) AS n_cells,
count(*) AS n_numeric, 0 AS n_character, count(*) / ((max("row") - min("row") + 1) * (max(col) - min(col) + 1)) AS density FROM grid GROUP BY ALL""")
def cells_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cells.summary(grid(spark, sf_dir))
    return out.withColumn("n_character", F.col("n_character").cast("int"))


@query("""SELECT sheet_id, CAST(coalesce(sum(n) FILTER ("row" < 1 OR col < 1), 0) AS BIGINT) AS not_positive, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated,
CAST(sum(bad) AS BIGINT) AS bad_data_type, CAST(0 AS BIGINT) AS null_value
FROM (SELECT o_orderpriority AS sheet_id, o_custkey % 61 AS "row", o_orderkey % 73 AS col, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS bad FROM orders GROUP BY ALL) GROUP BY sheet_id""")
def cells_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    faulty = o.select(F.col("o_orderpriority").alias("sheet_id"), (F.col("o_custkey") % 61).cast("int").alias("row"), (F.col("o_orderkey") % 73).cast("int").alias("col"), F.when(F.col("o_orderstatus") == "P", "date").otherwise("numeric").alias("data_type"), F.col("o_orderstatus").alias("value"))
    return coordinate_checks(faulty).join(value_checks(faulty), "sheet_id").select("sheet_id", "not_positive", "repeated", "bad_data_type", "null_value")


@query(f"""WITH {GRID}, d AS (SELECT *, ("row" - 30) * ("row" - 30) + (col - 30) * (col - 30) AS far FROM grid)
SELECT sheet_id, "row", col, value FROM d QUALIFY far = min(far) OVER (PARTITION BY sheet_id)""")
def filter_nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.nearest(grid(spark, sf_dir), row=30, col=30).select("sheet_id", "row", "col", "value")


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", 'SELECT sheet_id, "row", col FROM grid', "g")},
near AS (SELECT sheet_id, "row", col FROM grid QUALIFY ("row" - 30) * ("row" - 30) + (col - 30) * (col - 30) = min(("row" - 30) * ("row" - 30) + (col - 30) * (col - 30)) OVER (PARTITION BY sheet_id)),
hits AS (SELECT DISTINCT sheet_id, gid FROM g JOIN near USING (sheet_id, "row", col)),
own AS (SELECT sheet_id, "row", col FROM g JOIN hits USING (sheet_id, gid)),
box AS (SELECT sheet_id, gid, {BOXES} FROM g GROUP BY ALL),
pairs AS (SELECT x.sheet_id, x.gid AS hit, y.gid, power(greatest(x.r_min - y.r_max, y.r_min - x.r_max, 0), 2) + power(greatest(x.c_min - y.c_max, y.c_min - x.c_max, 0), 2) AS d FROM box x JOIN hits h USING (sheet_id, gid) JOIN box y ON x.sheet_id = y.sheet_id),
exact AS (SELECT p.sheet_id, p.gid, min(power(a."row" - b."row", 2) + power(a.col - b.col, 2)) AS d FROM pairs p JOIN g a ON a.sheet_id = p.sheet_id AND a.gid = p.hit JOIN g b ON b.sheet_id = p.sheet_id AND b.gid = p.gid WHERE p.d <= 3.61 GROUP BY p.sheet_id, p.hit, p.gid),
kept AS (SELECT DISTINCT sheet_id, gid FROM (SELECT sheet_id, gid FROM exact WHERE d <= 4 UNION ALL SELECT sheet_id, gid FROM pairs WHERE d > 3.61 AND d <= 4 UNION ALL SELECT * FROM hits))
SELECT sheet_id, "row", col FROM g JOIN kept USING (sheet_id, gid)""")
def filter_keep_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks.components(grid(spark, sf_dir)).persist()
    return blocks.keep_around(own, cells.nearest(own, row=30, col=30), keep=2).select("sheet_id", "row", "col")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def prune_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.prune(table(spark, sf_dir, "orders").drop("o_orderdate").withColumn("source", F.lit("erp")).withColumn("nothing", F.lit(None).cast("string")))[0]


# Classification ------------------------------------------------------------------------------------------------------

SAMPLES = ["12", "1.5", "-3", "1,000", "-.5", "5-", "1.2.3", "10%", "$5", "(5)", "abc", "1 2", "1e5", "2001-02", "+-5", "", " ", "-", "..", "--"]


@query(r"""WITH v AS (SELECT p_name AS value FROM part UNION ALL SELECT """ + PLAIN.format("c_acctbal") + r""" FROM customer UNION ALL SELECT props FROM events UNION ALL SELECT s_name FROM supplier UNION ALL
SELECT unnest([""" + ", ".join(f"'{s}'" for s in SAMPLES) + r"""])),
t AS (SELECT value, regexp_replace(value, '^\s+|\s+$', '', 'g') AS t FROM v),
m AS (SELECT value, regexp_extract_all(t, '((?:(?:\+)?(?:-)?(?:\.)?(?:,)?[0-9])+)', 1) AS m, regexp_replace(t, '(?:(?:\+)?(?:-)?(?:\.)?(?:,)?[0-9])+', '', 'g') AS rest FROM t),
k AS (SELECT value, len(m) AS n, regexp_replace(regexp_replace(rest, '[+\-.,]+', '', 'g'), '^\s+|\s+$', '', 'g') = '' AS bare, regexp_replace(m[1], '[.,]+', '', 'g') AS digits FROM m)
SELECT value, CASE WHEN n = 0 AND bare THEN 'empty' WHEN n = 1 AND bare AND regexp_matches(digits, '^[+-]?[0-9]+$') THEN 'value' ELSE 'attribute' END AS kind, count(*) AS n FROM k GROUP BY ALL""")
def va_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "part").select(F.col("p_name").alias("value")), table(spark, sf_dir, "customer").select(decimal_text(F.col("c_acctbal"))), table(spark, sf_dir, "events").select("props"), table(spark, sf_dir, "supplier").select("s_name"), spark.createDataFrame([(s,) for s in SAMPLES], "value string")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("value", number_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT * EXCLUDE data_type, CASE WHEN data_type = 'numeric' THEN 'value' ELSE 'attribute' END AS type FROM ({MELTED}) WHERE value IS NOT NULL")
def va_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.basic(_melted(spark, sf_dir)).drop("data_type")


@query(f"""WITH {GRID}, a AS (SELECT *, CAST(type = 'attribute' AS INTEGER) AS a FROM grid)
SELECT sheet_id, "row", col, CASE WHEN greatest(avg(a) OVER (PARTITION BY sheet_id, "row"), avg(a) OVER (PARTITION BY sheet_id, col)) > 0.7 THEN 'attribute' ELSE type END AS type FROM a""")
def va_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.recovered(grid(spark, sf_dir)).select("sheet_id", "row", "col", "type")


@query("""WITH u AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem), c AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) + 1 AS r, dense_rank() OVER (ORDER BY l_linestatus) + 1 AS c FROM u)
SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, type FROM (SELECT r AS "row", c AS col, 'value' AS type FROM c UNION SELECT 1, c, 'attribute' FROM c UNION SELECT r, 1, 'empty' FROM c UNION SELECT 1, 1, 'empty')""")
def va_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.sample_based(flag_sheet(spark, sf_dir), empty_sample=["N"]).select("row", "col", "type")


# Blocks --------------------------------------------------------------------------------------------------------------

ALL_CELLS = 'SELECT sheet_id, "row", col FROM grid'


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g")} SELECT sheet_id, "row", col, gid FROM g""")
def blocks_components4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.components(grid(spark, sf_dir)).select("sheet_id", "row", "col", "gid")


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g", EIGHT)} SELECT sheet_id, "row", col, gid FROM g""")
def blocks_components8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.components(grid(spark, sf_dir), corners=True).select("sheet_id", "row", "col", "gid")


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g")} SELECT sheet_id, gid, {BOXES} FROM g GROUP BY ALL""")
def blocks_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.boundaries(blocks.components(grid(spark, sf_dir)))


PAIR_DISTANCE = f"""box AS (SELECT sheet_id, gid, {BOXES} FROM g GROUP BY ALL),
pairs AS (SELECT x.sheet_id, x.gid AS gid_1, y.gid AS gid_2, power(greatest(x.r_min - y.r_max, y.r_min - x.r_max, 0), 2) + power(greatest(x.c_min - y.c_max, y.c_min - x.c_max, 0), 2) AS d FROM box x JOIN box y ON x.sheet_id = y.sheet_id AND x.gid < y.gid),
near AS (SELECT p.sheet_id, p.gid_1, p.gid_2, min(power(a."row" - b."row", 2) + power(a.col - b.col, 2)) AS d FROM pairs p JOIN g a ON a.sheet_id = p.sheet_id AND a.gid = p.gid_1 JOIN g b ON b.sheet_id = p.sheet_id AND b.gid = p.gid_2 WHERE p.d <= {{}} GROUP BY ALL),
dist AS (SELECT sheet_id, gid_1, gid_2, sqrt(d) AS dist FROM near UNION ALL SELECT sheet_id, gid_1, gid_2, sqrt(d) FROM pairs WHERE d > {{}})"""


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g")}, {PAIR_DISTANCE.format(3.61, 3.61)} SELECT sheet_id, gid_1, gid_2, dist FROM dist WHERE dist <= 3""")
def blocks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.distances(blocks.components(grid(spark, sf_dir)).persist()).where(F.col("dist") <= 3)


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g")}, {PAIR_DISTANCE.format(3.61, 3.61)},
links AS (SELECT sheet_id, gid_1 AS a, gid_2 AS b FROM dist WHERE dist <= 1.5 UNION ALL SELECT sheet_id, gid_2, gid_1 FROM dist WHERE dist <= 1.5),
reach(sheet_id, a, b) AS (SELECT sheet_id, a, a FROM links UNION SELECT r.sheet_id, r.a, l.b FROM reach r JOIN links l ON r.sheet_id = l.sheet_id AND r.b = l.a),
names AS (SELECT sheet_id, a AS gid, min(b) AS new_gid FROM reach GROUP BY ALL)
SELECT g.sheet_id, g."row", g.col, coalesce(n.new_gid, g.gid) AS gid FROM g LEFT JOIN names n USING (sheet_id, gid)""")
def blocks_merge_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.merge_within(blocks.components(grid(spark, sf_dir)).persist(), corner_join=True).select("sheet_id", "row", "col", "gid")


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g")}, box AS (SELECT sheet_id, gid, {BOXES} FROM g GROUP BY ALL),
w AS (SELECT *, CASE WHEN max(r_max) OVER (PARTITION BY sheet_id ORDER BY r_min, r_max, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= r_min THEN 0 ELSE 1 END AS n FROM box),
e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sheet_id ORDER BY r_min, r_max, gid ROWS UNBOUNDED PRECEDING) AS INTEGER) AS enclosure FROM w)
SELECT sheet_id, gid, enclosure, min(r_min) OVER (PARTITION BY sheet_id, enclosure) AS e_min, max(r_max) OVER (PARTITION BY sheet_id, enclosure) AS e_max FROM e""")
def blocks_row_enclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.enclosure(blocks.boundaries(blocks.components(grid(spark, sf_dir)))).select("sheet_id", "gid", "enclosure", "e_min", "e_max")


# Geometry and headers ------------------------------------------------------------------------------------------------


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    data = blocks.components(g.where("type = 'value'"), prefix="d")
    attributes = blocks.components(g.where("type = 'attribute'"), prefix="a")
    return headers.direction_map(attributes, blocks.boundaries(data))


SEEN = f"""{GRID}, {component_sql("d", "SELECT sheet_id, row, col FROM grid WHERE type = 'value'".replace("row", '"row"'), "d")}, {component_sql("a", "SELECT sheet_id, row, col FROM grid WHERE type = 'attribute'".replace("row", '"row"'), "a")},
box AS (SELECT sheet_id, gid AS data_gid, {BOXES} FROM d GROUP BY ALL),
seen AS (SELECT *, {GROUP} AS direction_group FROM (SELECT a.sheet_id, a.gid AS attr_gid, data_gid, "row", col, {DIRECTION} AS direction, {SQUARE} AS sq FROM a JOIN box USING (sheet_id)) WHERE direction <> '')"""


@query(f"WITH RECURSIVE {SEEN} SELECT sheet_id, direction, direction_group, count(*) AS n, CAST(sum(sq) AS BIGINT) AS squares FROM seen GROUP BY ALL")
def direction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).groupBy("sheet_id", "direction", "direction_group").agg(F.count("*").alias("n"), F.sum(F.round(F.col("dist") * F.col("dist")).cast("bigint")).alias("squares"))


@query(f"""WITH RECURSIVE {SEEN}, e AS (SELECT sheet_id, attr_gid, data_gid, direction, direction_group, sqrt(min(sq)) AS dist, count(*) AS n_cells FROM seen GROUP BY ALL)
SELECT * FROM e QUALIFY dist = min(dist) OVER (PARTITION BY sheet_id, data_gid, direction_group)""")
def nearest_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.nearest_attributes(_seen(spark, sf_dir))


def _header_query(tag: str) -> None:
    vertical = tag[0] == "v" or tag == "direct"
    axis, at = ("col", "col") if vertical else ("row", '"row"')
    source = f"SELECT DISTINCT sheet_id, {at} AS h, 'H' || {at} AS label FROM grid WHERE {at} % 5 = 2"
    condition = {
        "": f"d.{at} = h.h",
        "l": f"h.h = (SELECT max(x.h) FROM hdr x WHERE x.sheet_id = d.sheet_id AND x.h <= d.{at})",
        "r": f"h.h = (SELECT min(x.h) FROM hdr x WHERE x.sheet_id = d.sheet_id AND x.h >= d.{at})",
        "m": f"(lo IS NULL OR d.{at} >= lo) AND (hi IS NULL OR d.{at} < hi)",
    }
    kind = {"u": "l", "d": "r"}.get(tag[1:], tag[1:])
    if tag == "direct":
        body = "FROM grid d JOIN hdr h ON d.sheet_id = h.sheet_id"
    elif kind in ("l", "r"):
        body = f"FROM grid d ASOF JOIN hdr h ON d.sheet_id = h.sheet_id AND d.{at} {'>=' if kind == 'l' else '<='} h.h"
    else:
        body = f"FROM grid d JOIN hdr h ON d.sheet_id = h.sheet_id AND {condition[kind]}"
    sql = f"""WITH {GRID}, h0 AS ({source}), hdr AS (SELECT *, (lag(h) OVER w + h) / 2.0 AS lo, (lead(h) OVER w + h) / 2.0 AS hi FROM h0 WINDOW w AS (PARTITION BY sheet_id ORDER BY h))
SELECT d.sheet_id, d."row", d.col, h.label {body}"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = grid(spark, sf_dir)
        other = "row" if axis == "col" else "col"
        head = g.where(F.col(axis) % 5 == 2).select("sheet_id", F.lit(0).alias(other), axis, F.concat(F.lit("H"), F.col(axis).cast("string")).alias("label")).distinct()
        return headers.attach(g.select("sheet_id", "row", "col"), head, tag).select("sheet_id", "row", "col", "label")

    run.__name__ = f"hdr_{tag}"
    query(sql)(run)


for _tag in ("v", "h", "vl", "vr", "vm", "hu", "hd", "hm", "direct"):
    _header_query(_tag)


@query(f"""WITH {GRID}, hdr AS (SELECT DISTINCT sheet_id, col AS h FROM grid WHERE col % 5 = 2), lim AS (SELECT sheet_id, min(h) AS lo, max(h) AS hi FROM hdr GROUP BY ALL),
rep AS (SELECT sheet_id, "row", min(col) AS col FROM grid GROUP BY ALL UNION SELECT sheet_id, min("row"), col FROM grid GROUP BY sheet_id, col),
c AS (SELECT r.sheet_id, count(*) AS n, count(*) FILTER (r.col >= lo) AS vl, count(*) FILTER (r.col <= hi) AS vr, count(*) AS vm, count(*) FILTER (h IS NOT NULL) AS v FROM rep r JOIN lim USING (sheet_id) LEFT JOIN hdr ON hdr.sheet_id = r.sheet_id AND hdr.h = r.col GROUP BY ALL),
t AS (SELECT sheet_id, 'vl' AS tag, 0 AS k, vl / n AS coverage FROM c UNION ALL SELECT sheet_id, 'vr', 1, vr / n FROM c UNION ALL SELECT sheet_id, 'vm', 2, vm / n FROM c UNION ALL SELECT sheet_id, 'v', 3, v / n FROM c)
SELECT sheet_id, tag, coverage FROM t QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY coverage DESC, k) = 1""")
def hdr_coverage_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    head = g.where(F.col("col") % 5 == 2).select("sheet_id", F.lit(0).alias("row"), "col").distinct()
    return headers.best_tag(headers.coverage(g.select("sheet_id", "row", "col"), head, headers.TAGS["N"]))


# The attribute map ---------------------------------------------------------------------------------------------------

ROLES = """CASE WHEN "row" <= 6 AND col > 6 THEN 'top' WHEN "row" > 6 AND col <= 6 THEN 'left' WHEN "row" > 6 AND col > 6 THEN 'data' END"""


@query(f"""WITH {GRID}, r AS (SELECT *, {ROLES} AS role FROM grid),
side AS (SELECT DISTINCT sheet_id, role FROM r WHERE role IN ('top', 'left')),
need AS (SELECT s.sheet_id, s.role, CASE WHEN s.role = 'top' THEN r.col ELSE r."row" END AS x, bool_or(false) AS f FROM side s JOIN r ON r.sheet_id = s.sheet_id AND r.role = 'data' GROUP BY ALL),
have AS (SELECT DISTINCT sheet_id, role, CASE WHEN role = 'top' THEN col ELSE "row" END AS x FROM r WHERE role IN ('top', 'left'))
SELECT n.sheet_id, 'a_' || n.role AS attr_gid, 'd1' AS data_gid, count(h.x) / count(*) AS rel_dim, CASE WHEN count(h.x) = count(*) THEN 'major' ELSE 'minor' END AS attr_group
FROM need n LEFT JOIN have h ON h.sheet_id = n.sheet_id AND h.role = n.role AND h.x = n.x GROUP BY ALL""")
def dimension_major_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("role", F.expr(ROLES.replace('"row"', "`row`")))
    data = g.where("role = 'data'").withColumn("gid", F.lit("d1"))
    attributes = g.where("role in ('top', 'left')").withColumn("gid", F.concat(F.lit("a_"), "role"))
    edges = attributes.select("sheet_id", F.col("gid").alias("attr_gid"), F.lit("d1").alias("data_gid"), F.when(F.col("role") == "top", "NS").otherwise("WE").alias("direction_group")).distinct()
    return mapping.dimensions(edges, data, attributes).select("sheet_id", "attr_gid", "data_gid", "rel_dim", "attr_group")


@query("""WITH f AS (SELECT l_returnflag AS sheet_id, 'a' || l_orderkey AS gid, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ';' ORDER BY CAST(l_linenumber AS VARCHAR)) AS f FROM lineitem GROUP BY ALL)
SELECT sheet_id, gid, min(gid) OVER (PARTITION BY sheet_id, f) AS new_gid FROM f""")
def footprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return mapping.footprints(l.select(F.col("l_returnflag").alias("sheet_id"), F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("gid"), F.lit(1).alias("row"), F.col("l_linenumber").alias("col")))


@query(f"""WITH RECURSIVE {GRID}, n AS (SELECT DISTINCT sheet_id, 'd' || "row" AS d, col FROM grid), e AS (SELECT DISTINCT x.sheet_id, x.d AS a, y.d AS b FROM n x JOIN n y USING (sheet_id, col)),
reach(sheet_id, a, b) AS (SELECT sheet_id, a, b FROM e UNION SELECT r.sheet_id, r.a, e.b FROM reach r JOIN e ON r.sheet_id = e.sheet_id AND r.b = e.a)
SELECT sheet_id, a AS data_gid, min(b) AS info_gid FROM reach GROUP BY ALL""")
def info_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    edges = g.select("sheet_id", F.concat(F.lit("a"), F.col("col").cast("string")).alias("attr_gid"), F.concat(F.lit("d"), F.col("row").cast("string")).alias("data_gid"), F.lit("major").alias("attr_group")).distinct()
    attributes = g.select("sheet_id", F.lit(0).alias("row"), "col", F.concat(F.lit("a"), F.col("col").cast("string")).alias("gid")).distinct()
    return mapping.information_blocks(edges, attributes)


@query(f"""WITH RECURSIVE {GRID}, {component_sql("g", ALL_CELLS, "g")}, box AS (SELECT sheet_id, gid AS data_gid, min("row") AS pos FROM g GROUP BY ALL),
h AS (SELECT DISTINCT sheet_id, 'L' || (col % 3) AS layer, "row" AS f FROM grid WHERE "row" % 7 = 1), r AS (SELECT *, lead(f) OVER (PARTITION BY sheet_id, layer ORDER BY f) AS t FROM h),
m AS (SELECT r.sheet_id, layer, 'h' || f AS header, data_gid, t IS NULL OR pos < t AS b FROM r JOIN box USING (sheet_id) WHERE pos >= f),
k AS (SELECT *, bool_or(b) OVER (PARTITION BY sheet_id, layer, header) AS is_bounded FROM m)
SELECT sheet_id, layer, header, data_gid, is_bounded FROM k WHERE b OR NOT is_bounded""")
def hier_realloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    layered = g.where(F.col("row") % 7 == 1).select("sheet_id", F.concat(F.lit("L"), (F.col("col") % 3).cast("string")).alias("layer"), F.concat(F.lit("h"), F.col("row").cast("string")).alias("header"), "row", F.lit(0).alias("col")).distinct()
    return mapping.layer_claims(layered, blocks.boundaries(blocks.components(g)))


@query("""WITH l AS (SELECT DISTINCT c_mktsegment AS sheet_id, 'd' || c_nationkey AS data_gid, CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'W' END AS direction, c_custkey % 7 AS dist FROM customer)
SELECT *, direction || '_' || dense_rank() OVER (PARTITION BY sheet_id, data_gid, direction ORDER BY dist) AS attr_name FROM l""")
def sync_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return mapping.sync_names(c.select(F.col("c_mktsegment").alias("sheet_id"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("data_gid"), F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("W").alias("direction"), (F.col("c_custkey") % 7).alias("dist")).distinct())


# Composition ---------------------------------------------------------------------------------------------------------

PLACED = f"""c AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY priority) + 1 AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY c_mktsegment) + 1 AS INTEGER) AS k FROM ({NATION_COUNTS}))"""


@query(f"""WITH {PLACED} SELECT sheet AS sheet_id, 'd1' AS data_block, r AS "row", k AS col, CAST(n AS VARCHAR) AS value, 'N_1' AS attr_name, c_mktsegment AS attr_value, 1 AS attr_row, k AS attr_col FROM c
UNION ALL SELECT sheet, 'd1', r, k, CAST(n AS VARCHAR), 'W_1', priority, r, 1 FROM c UNION ALL SELECT sheet, 'd1', r, k, CAST(n AS VARCHAR), 'NW_WE_1', 'priority', 1, 1 FROM c""")
def compose_long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose_long(analyze_cells(classify.numeric_values(nation_sheets(spark, sf_dir))))


@query(f"""WITH {PLACED} SELECT sheet AS sheet_id, 'd1' AS data_block, r AS "row", k AS col, CAST(n AS VARCHAR) AS value, c_mktsegment AS "N_1", priority AS "W_1", 'priority' AS "NW_WE_1" FROM c""")
def compose_wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose_wide(compose_long(analyze_cells(classify.numeric_values(nation_sheets(spark, sf_dir)))))


@query(f"""WITH {PLACED} SELECT sheet AS sheet_id, r AS "row", k AS col, '1_' || k AS n_address, r || '_1' AS w_address, '1_1' AS corner_address FROM c""")
def traceback_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = compose_wide(compose_long(analyze_cells(classify.numeric_values(nation_sheets(spark, sf_dir)))), ["N_1", "NW_WE_1", "W_1"], traceback=True)
    return wide.select("sheet_id", "row", "col", F.col("cellAddress_N_1").alias("n_address"), F.col("cellAddress_W_1").alias("w_address"), F.col("cellAddress_NW_WE_1").alias("corner_address"))


# Collation, names, stacking ------------------------------------------------------------------------------------------


def _profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return collate.representatives(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"]), collate.representatives(table(spark, sf_dir, "region"), ["r_name", "r_regionkey"])


CLEAN = "trim(regexp_replace(regexp_replace(lower(CAST({} AS VARCHAR)), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH x AS (SELECT DISTINCT 'n_name' AS name_1, {CLEAN.format("n_name")} AS x FROM nation UNION ALL SELECT DISTINCT 'n_regionkey', {CLEAN.format("n_regionkey")} FROM nation),
y AS (SELECT DISTINCT 'r_name' AS name_2, {CLEAN.format("r_name")} AS y FROM region UNION ALL SELECT DISTINCT 'r_regionkey', {CLEAN.format("r_regionkey")} FROM region),
l AS (SELECT name_1, name_2, (12 * median(d) + 6 * avg(d) + min(d) + max(d)) / 20 AS levenshtein FROM (SELECT name_1, name_2, levenshtein(x, y) AS d FROM x, y) GROUP BY ALL),
xc AS (SELECT DISTINCT name_1, unnest(string_split(x, '')) AS c FROM x), yc AS (SELECT DISTINCT name_2, unnest(string_split(y, '')) AS c FROM y),
v AS (SELECT a.name_1, b.name_2, 1 - (SELECT count(*) FROM x JOIN y ON x.x = y.y WHERE x.name_1 = a.name_1 AND y.name_2 = b.name_2) / (SELECT count(*) FROM x WHERE x.name_1 = a.name_1) AS overlap,
1 - (SELECT count(*) FROM xc JOIN yc USING (c) WHERE xc.name_1 = a.name_1 AND yc.name_2 = b.name_2) / (SELECT count(*) FROM xc WHERE xc.name_1 = a.name_1) AS charset
FROM (SELECT DISTINCT name_1 FROM x) a, (SELECT DISTINCT name_2 FROM y) b)
SELECT name_1, name_2, round(levenshtein, 6) AS levenshtein, round(overlap, 6) AS overlap, round(charset, 6) AS charset FROM l JOIN v USING (name_1, name_2)""")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collate.similarity(*_profiles(spark, sf_dir))
    return out.select("name_1", "name_2", *[F.round(c, 6).alias(c) for c in ("levenshtein", "overlap", "charset")])


@query("SELECT CAST(n_regionkey AS VARCHAR) AS collated_1, n_name AS collated_2 FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR), n_name FROM nation")
def collate_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    x = n.select(F.col("n_name").alias("country"), F.col("n_regionkey").cast("string").alias("part"))
    y = n.select(F.col("n_regionkey").cast("string").alias("area"), F.col("n_name").alias("state"))
    return collate.collate_columns([x, y]).frame.select("collated_1", "collated_2")


@query("SELECT n_name AS uncollated_1, NULL::VARCHAR AS uncollated_2 FROM nation UNION ALL SELECT NULL, r_name FROM region")
def collate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collate.collate_columns([table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name")], threshold=-1.0).frame


@query(f"SELECT {CLEAN.format('p_name')} AS signature, max(p_name) AS value FROM part GROUP BY ALL")
def string_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collate.string_signatures(table(spark, sf_dir, "part"), "p_name")


@query("""WITH p AS (SELECT n_nationkey AS k, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT k, a, b, i, unnest(range(1, len(a) - i + 2)) AS n FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM p)),
c AS (SELECT k, substr(a, i, n) AS common, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS o FROM s WHERE contains(b, substr(a, i, n)))
SELECT p.k AS n_nationkey, p.a AS n_name, coalesce(c.common, '') AS common FROM p LEFT JOIN c ON c.k = p.k AND o = 1""")
def lcs_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", "n_name", collate.longest_common_substring("n_name", "r_name").alias("common"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def stack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    first = cells.melt(n.where("n_nationkey % 2 = 0"), ["n_nationkey"], "s").withColumn("gid", F.lit("g1"))
    second = cells.transpose(cells.melt(n.where("n_nationkey % 2 = 1"), ["n_nationkey"], "s")).withColumn("gid", F.lit("g2"))
    both = first.unionByName(second)
    found = stacking.mergeable(stacking.side_headers(both)).first()
    labels = ["n_nationkey", "n_name", "n_regionkey"]
    return stacking.stack(both, [(found["gid_1"], found["side_1"]), (found["gid_2"], found["side_2"])], labels).select(*labels)


@query(r"""WITH w AS (SELECT DISTINCT lang, unnest(string_split_regex(lower(text), '\s+')) AS word FROM documents), n AS (SELECT count(DISTINCT lang) AS n FROM documents),
k AS (SELECT word, count(*) AS c FROM w WHERE word <> '' GROUP BY ALL)
SELECT count(*) FILTER (c = n) AS n_common, count(*) AS n_words, 1 - count(*) FILTER (c = n) / count(*) AS variation FROM k, n""")
def content_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.content_variation(table(spark, sf_dir, "documents"), "lang", "text")


# Sources -------------------------------------------------------------------------------------------------------------


@query("""SELECT 'region ' || n_regionkey AS sheet_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS INTEGER) AS "row", c.col, CASE c.col WHEN 1 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS value
FROM nation, (VALUES (1), (2)) AS c(col) WHERE c.col = 1 UNION ALL SELECT 'region ' || n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS INTEGER), 2, n_name FROM nation
UNION ALL SELECT DISTINCT 'region ' || n_regionkey, 1, 1, 'key' FROM nation UNION ALL SELECT DISTINCT 'region ' || n_regionkey, 1, 2, 'name' FROM nation""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per region with its nations in a table, read back."""
    n = table(spark, sf_dir, "nation")
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("<tr><td><b>"), F.col("n_nationkey").cast("string"), F.lit("</b></td><td>"), "n_name", F.lit("</td></tr>")).alias("h")))).alias("r"))
    pages = rows.select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("sheet_id"), F.concat(F.lit("<html><script>var t='<table>';</script><table><tr><th>key<th>name</tr>"), F.array_join("r.h", ""), F.lit("</table></html>")).alias("html"))

    def read(batches):
        import pandas as pd

        for batch in batches:
            found = [(s, r, c, v) for s, page in zip(batch["sheet_id"], batch["html"], strict=True) for t in html_tables_of(page) for r, row in enumerate(t, 1) for c, v in enumerate(row, 1) if v]
            yield pd.DataFrame(found, columns=["sheet_id", "row", "col", "value"])

    return pages.mapInPandas(read, "sheet_id string, row int, col int, value string")


@query("SELECT * FROM (VALUES ('comma', 'comma'), ('semicolon', 'semicolon'), ('tab', 'tab'), ('space', 'space')) AS t(sheet_id, dialect)")
def dialect_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations written with four separators; each file's dialect is found again."""
    n = table(spark, sf_dir, "nation").withColumn("name", F.replace("n_name", F.lit("_"), F.lit("")))
    w = cells.Window.orderBy("n_nationkey")
    lines = n.withColumn("line_no", F.row_number().over(w))
    out = None
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("space", " ")):
        word = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("name")) if name == "tab" else F.col("name")
        own = lines.select(F.lit(name).alias("sheet_id"), "line_no", F.concat_ws(sep, F.col("n_nationkey").cast("string"), word, F.col("n_regionkey").cast("string")).alias("line"))
        out = own if out is None else out.unionAll(own)
    return dialects(out)


MAGIC = {"pdf": "255044462D312E37", "gz": "1F8B0800", "bz2": "425A6839", "xz": "FD377A585A0000", "7z": "377ABCAF271C0004", "rar": "526172211A0700", "txt": "6E616D652C616765", "unknown": "0001020300", "zip": "504B030414000000", "xml": "3C3F786D6C20"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{k}')" for k in MAGIC) + ") AS t(name, file_type)")
def magic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(list(MAGIC.items()), "name string, h string")
    return files.select("name", file_type(F.unhex("h")).alias("file_type"))


@query("""SELECT * FROM (VALUES (2, 2, '12', 'Weight', 'Mira', 'Child'), (2, 3, '1.5', 'Age', 'Mira', 'Child'), (3, 2, '16', 'Weight', 'Otto', 'Child'), (3, 3, '6', 'Age', 'Otto', 'Child')) AS t("row", col, value, "N_1", "W_1", "NW_WE_1")""")
def read_cells_csv_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("kids", 1, "Child,Weight,Age"), ("kids", 2, "Mira,12,1.5"), ("kids", 3, "Otto,16,6")], "sheet_id string, line_no int, line string")
    wide = compose_wide(compose_long(analyze_cells(classify.numeric_values(text_cells(lines)))))
    return wide.select("row", "col", "value", "N_1", "W_1", "NW_WE_1")
