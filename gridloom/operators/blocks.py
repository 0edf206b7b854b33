"""Blocks of touching cells: connected components, boundaries, distances, merging and enclosure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import kept
from ..schema import GIDMAP, KEY, sheet


def label(rows: np.ndarray, cols: np.ndarray, corners: bool = False) -> np.ndarray:
    """Component numbers from 1 in order of each component's first cell by (row, col): union-find over the cells' neighbours."""
    n = len(rows)
    order = np.lexsort((cols, rows))
    at = {p: k for k, p in enumerate(zip(rows[order].tolist(), cols[order].tolist(), strict=True))}
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    steps = ((0, 1), (1, 0), (1, 1), (1, -1)) if corners else ((0, 1), (1, 0))
    for (r, c), k in at.items():
        for dr, dc in steps:
            j = at.get((r + dr, c + dc))
            if j is not None:
                a, b = root(k), root(j)
                parent[max(a, b)] = min(a, b)
    roots = [root(k) for k in range(n)]
    number = {r: i for i, r in enumerate(sorted(set(roots)), 1)}
    out = np.empty(n, np.int64)
    out[order] = [number[r] for r in roots]
    return out


def components(cells: DataFrame, corners: bool = False, prefix: str = "g") -> DataFrame:
    """Adds gid, the cell's block in its sheet. One shuffle deals sheets over the tasks, and each sheet is labelled in one
    pass; only coordinates travel. For sheets that don't fit a task there is components_by_rounds()."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        found = label(own["row"].to_numpy(), own["col"].to_numpy(), corners)
        return own.assign(gid=[f"{prefix}{k}" for k in found])[["sheet_id", "row", "col", "gid"]]

    gids = cells.select(*KEY).distinct().groupBy("sheet_id").applyInPandas(run, GIDMAP)
    return cells.drop("gid").join(gids, KEY)


def components_by_rounds(cells: DataFrame, corners: bool = False, prefix: str = "g", max_rounds: int = 200) -> DataFrame:
    """The same blocks by joins and windows alone: runs of cells in a row are the nodes, and the smallest cell number moves
    along runs and columns until nothing changes. Numbers follow each block's first cell."""
    width = F.max("col").over(sheet()) + 1
    now = cells.select(*KEY).distinct().withColumn("low", F.col("row").cast("bigint") * width + F.col("col"))
    for axis, other in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("sheet_id", axis).orderBy(other)
        start = F.when(F.col(other) - F.lag(other).over(w) == 1, 0).otherwise(1)
        now = now.withColumn("_s", start).withColumn(f"run_{axis}", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    now = kept(now)
    for _ in range(max_rounds):
        nxt = now.withColumn("new", F.min("low").over(Window.partitionBy("sheet_id", "row", "run_row")))
        nxt = nxt.withColumn("new", F.min("new").over(Window.partitionBy("sheet_id", "col", "run_col")))
        if corners:
            near = nxt.select("sheet_id", "new", F.explode(F.expr("array(struct(row + 1 as r, col + 1 as c), struct(row + 1 as r, col - 1 as c), struct(row - 1 as r, col + 1 as c), struct(row - 1 as r, col - 1 as c))")).alias("p"))
            near = near.groupBy("sheet_id", F.col("p.r").alias("row"), F.col("p.c").alias("col")).agg(F.min("new").alias("near"))
            nxt = nxt.join(near, KEY, "left").withColumn("new", F.least("new", F.coalesce("near", "new"))).drop("near")
        nxt = kept(nxt)
        changed = not nxt.where("new <> low").isEmpty()
        now = nxt.withColumn("low", F.col("new")).drop("new")
        if not changed:
            break
    else:
        raise RuntimeError(f"components_by_rounds: not settled after {max_rounds} rounds")
    gids = now.select(*KEY, F.concat(F.lit(prefix), F.dense_rank().over(sheet().orderBy("low")).cast("string")).alias("gid"))
    return cells.drop("gid").join(gids, KEY)


def boundaries(gids: DataFrame) -> DataFrame:
    return gids.groupBy("sheet_id", "gid").agg(F.min("row").alias("r_min"), F.min("col").alias("c_min"), F.max("row").alias("r_max"), F.max("col").alias("c_max"))


def corners_of(boxes: DataFrame) -> DataFrame:
    """The four corner cells of each boundary."""
    at = F.expr("array(struct(r_min as row, c_min as col), struct(r_min as row, c_max as col), struct(r_max as row, c_min as col), struct(r_max as row, c_max as col))")
    return boxes.select("sheet_id", "gid", F.explode(at).alias("p")).select("sheet_id", F.col("p.row").alias("row"), F.col("p.col").alias("col"), "gid").distinct()


def _pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of blocks of one sheet with the distance of their boundaries."""
    a = boxes.select("sheet_id", *[F.col(c).alias(f"{c}_1") for c in ("gid", "r_min", "c_min", "r_max", "c_max")])
    b = boxes.select("sheet_id", *[F.col(c).alias(f"{c}_2") for c in ("gid", "r_min", "c_min", "r_max", "c_max")])
    dr = F.greatest(F.col("r_min_1") - F.col("r_max_2"), F.col("r_min_2") - F.col("r_max_1"), F.lit(0))
    dc = F.greatest(F.col("c_min_1") - F.col("c_max_2"), F.col("c_min_2") - F.col("c_max_1"), F.lit(0))
    return a.join(b, "sheet_id").where("gid_1 < gid_2").withColumn("box_dist", F.sqrt((dr * dr + dc * dc).cast("double")))


def distances(cells: DataFrame, nearby: float | None = 1.9) -> DataFrame:
    """(sheet_id, gid_1, gid_2, dist) of block pairs: the distance of their closest cells where the boundaries are within
    `nearby`, else that of the boundaries; None measures all pairs by their cells."""
    pairs = _pairs(boundaries(cells))
    near = pairs if nearby is None else pairs.where(F.col("box_dist") <= nearby)
    a = cells.select("sheet_id", F.col("gid").alias("gid_1"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    b = cells.select("sheet_id", F.col("gid").alias("gid_2"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    d = F.sqrt(((F.col("r1") - F.col("r2")) * (F.col("r1") - F.col("r2")) + (F.col("c1") - F.col("c2")) * (F.col("c1") - F.col("c2"))).cast("double"))
    exact = near.select("sheet_id", "gid_1", "gid_2").join(a, ["sheet_id", "gid_1"]).join(b, ["sheet_id", "gid_2"]).groupBy("sheet_id", "gid_1", "gid_2").agg(F.min(d).alias("dist"))
    if nearby is None:
        return exact
    return exact.unionByName(pairs.where(F.col("box_dist") > nearby).select("sheet_id", "gid_1", "gid_2", F.col("box_dist").alias("dist")))


def approximate_distances(cells: DataFrame) -> DataFrame:
    """(sheet_id, gid_1, gid_2, dist) of block pairs: the least distance of a cell of either block from the other's boundary."""
    boxes = boundaries(cells).withColumnRenamed("gid", "other")
    own = cells.select("sheet_id", "gid", "row", "col").join(boxes, "sheet_id").where("gid <> other")
    dr = F.greatest(F.col("r_min") - F.col("row"), F.col("row") - F.col("r_max"), F.lit(0))
    dc = F.greatest(F.col("c_min") - F.col("col"), F.col("col") - F.col("c_max"), F.lit(0))
    pair = [F.least("gid", "other").alias("gid_1"), F.greatest("gid", "other").alias("gid_2")]
    return own.groupBy("sheet_id", *pair).agg(F.sqrt(F.min(dr * dr + dc * dc).cast("double")).alias("dist"))


def closure(links: DataFrame) -> DataFrame:
    """(sheet_id, gid, new_gid): blocks that links (sheet_id, gid_1, gid_2) join get the smallest of their names."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(own["gid_1"], own["gid_2"], strict=True):
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)
        names = sorted(parent)
        return pd.DataFrame({"sheet_id": own["sheet_id"].iloc[0], "gid": names, "new_gid": [root(x) for x in names]})

    return links.select("sheet_id", "gid_1", "gid_2").distinct().groupBy("sheet_id").applyInPandas(run, "sheet_id string, gid string, new_gid string")


def renamed(cells: DataFrame, names: DataFrame) -> DataFrame:
    return cells.join(names, ["sheet_id", "gid"], "left").withColumn("gid", F.coalesce("new_gid", "gid")).drop("new_gid")


def merge_within(cells: DataFrame, join: float = 0, corner_join: bool = False) -> DataFrame:
    """Blocks closer than `join` become one; corner_join: those that touch at corners."""
    near = 1.5 if corner_join else join
    links = distances(cells, max(near, 1.9)).where(F.col("dist") <= near)
    return renamed(cells, closure(links))


def merge_named(cells: DataFrame, pairs: list[tuple[str, str]], sheet_id: str) -> DataFrame:
    links = cells.sparkSession.createDataFrame([(sheet_id, a, b) for a, b in pairs], "sheet_id string, gid_1 string, gid_2 string")
    return renamed(cells, closure(links))


def keep_around(cells: DataFrame, hits: DataFrame, keep: float = 0) -> DataFrame:
    """The blocks that hold hits, and those within `keep` of them."""
    own = hits.select("sheet_id", "gid").distinct()
    if keep:
        near = distances(cells).where(F.col("dist") <= keep)
        both = near.select("sheet_id", F.col("gid_1").alias("gid"), F.col("gid_2").alias("other")).unionAll(near.select("sheet_id", F.col("gid_2").alias("gid"), F.col("gid_1").alias("other")))
        own = own.unionAll(both.join(own, ["sheet_id", "gid"], "left_semi").select("sheet_id", F.col("other").alias("gid"))).distinct()
    return cells.join(own, ["sheet_id", "gid"], "left_semi")


def enclosure(boxes: DataFrame, axis: str = "row") -> DataFrame:
    """Adds enclosure, e_min, e_max: blocks whose row (col) ranges overlap, directly or through others, share one range.
    Interval islands: a block starts one where it begins after all blocks before it have ended."""
    lo, hi = ("r_min", "r_max") if axis == "row" else ("c_min", "c_max")
    w = sheet().orderBy(lo, hi, "gid")
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = boxes.withColumn("_new", F.when(reach.isNull() | (reach < F.col(lo)), 1).otherwise(0))
    out = out.withColumn("enclosure", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")
    own = Window.partitionBy("sheet_id", "enclosure")
    return out.withColumn("e_min", F.min(lo).over(own)).withColumn("e_max", F.max(hi).over(own))


def meta(cells: DataFrame) -> DataFrame:
    """(sheet_id, gid, content, nrow, ncol, size) of each block."""
    text = F.when(F.col("type") == "attribute", F.lower(F.trim("value")))
    return cells.groupBy("sheet_id", "gid").agg(
        F.array_join(F.array_sort(F.collect_set(text)), " ").alias("content"),
        (F.max("row") - F.min("row") + 1).alias("nrow"),
        (F.max("col") - F.min("col") + 1).alias("ncol"),
        F.count("*").alias("size"),
    )


def attributes_inside(cells: DataFrame) -> DataFrame:
    """(sheet_id, inside, rect): attributes within the box of all values; rect: they are under one in a hundred of the cells
    there, and there are cells outside."""
    value = F.col("type") == "value"
    box = {f"{n}_{axis}": f(F.when(value, F.col(axis))).over(sheet()) for axis in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))}
    out = cells.where("type <> 'empty'").withColumns(box)
    within = F.coalesce(F.col("row").between(F.col("lo_row"), F.col("hi_row")) & F.col("col").between(F.col("lo_col"), F.col("hi_col")), F.lit(False))
    inside = F.count_if(within & (F.col("type") == "attribute"))
    share = inside / F.greatest(F.count_if(within), F.lit(1))
    return out.groupBy("sheet_id").agg(inside.alias("inside"), ((share < 0.01) & (F.count_if(~within) > 0)).alias("rect"))


def angular_sides(cells: DataFrame, tolerance: float = 0.8, margin: float = 0) -> DataFrame:
    """(sheet_id, well_sided, dimension_ok, sides): whether of opposite sides, as the sheet's diagonals cut it, one holds nearly
    all attributes; whether these reach over 0.7 of the data there; and how many of the two pairs have attributes. Cells
    no farther from a diagonal than `margin` don't count."""
    out = cells.where("type <> 'empty'").withColumns({f"{n}{axis[0]}": f(axis).over(sheet()) for axis in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))})
    r, c = F.col("row") - F.col("lor"), F.col("col") - F.col("loc")
    height, wide = F.col("hir") - F.col("lor"), F.col("hic") - F.col("loc")
    out = out.withColumn("falling", r * wide - height * c).withColumn("rising", height * wide - (r * wide + height * c))
    out = out.where((F.abs("falling") > margin * margin) & (F.abs("rising") > margin * margin))
    side = F.when(F.col("falling") > 0, F.when(F.col("rising") > 0, "W").otherwise("S")).otherwise(F.when(F.col("rising") > 0, "N").otherwise("E"))
    out = out.withColumn("side", side).withColumn("pair", F.when(F.col("side").isin("N", "S"), "NS").otherwise("WE"))
    out = out.withColumn("place", F.when(F.col("pair") == "NS", F.col("col")).otherwise(F.col("row")))
    reach = lambda kind: F.when(F.count_if(F.col("type") == kind) <= 1, 1).otherwise(F.max(F.when(F.col("type") == kind, F.col("place"))) - F.min(F.when(F.col("type") == kind, F.col("place"))))
    by = out.groupBy("sheet_id", "pair", "side").agg(F.count_if(F.col("type") == "attribute").alias("n"), F.count_if(F.col("type") == "value").alias("values"), reach("attribute").alias("reach"), reach("value").alias("data")).where("n > 0")
    by = by.withColumn("part", F.try_divide(F.col("reach"), F.when(F.col("values") > 0, F.col("data")).otherwise(F.col("reach"))))
    share = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sheet_id", "pair")))
    spread = share.groupBy("sheet_id", "pair").agg(F.when(F.count("*") == 1, 1.0).otherwise(F.max("share") - F.min("share")).alias("spread"), F.max_by("part", F.struct("share", F.col("side"))).alias("part"))
    return spread.groupBy("sheet_id").agg(F.bool_and(F.col("spread") > tolerance).alias("well_sided"), F.bool_and(F.coalesce(F.col("part") > 0.7, F.lit(True))).alias("dimension_ok"), F.count("*").alias("sides"))


def overview(cells: DataFrame) -> DataFrame:
    """(sheet_id, inside, rect, well_sided, dimension_ok, well_shaped): a sheet is well shaped if next to no attributes lie among
    its values, or if either pair of opposite sides has attributes, nearly all on one side and along most of the data."""
    out = attributes_inside(cells).join(angular_sides(cells), "sheet_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("well_sided", "dimension_ok")})
    return out.withColumn("well_shaped", F.col("rect") | (F.col("well_sided") & F.col("dimension_ok") & (F.col("sides") == 2))).drop("sides")


def filter_blocks(cells: DataFrame, condition: Column | str) -> DataFrame:
    """The cells of blocks whose meta (content, nrow, ncol, size) meets a condition."""
    return cells.join(meta(cells).where(condition).select("sheet_id", "gid"), ["sheet_id", "gid"], "left_semi")


def detect_table_blocks(cells: DataFrame, corners: bool = False) -> DataFrame:
    return components(cells, corners)
