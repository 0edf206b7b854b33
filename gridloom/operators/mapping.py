"""The attribute-to-data map: dimensions, names, duplicates, information blocks and reallocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import kept
from .blocks import closure, corners_of, enclosure
from .headers import direction_map, distance, nearest_attributes

EDGE = ["sheet_id", "attr_gid", "data_gid"]


def cell_map(edges: DataFrame, data: DataFrame, attributes: DataFrame) -> DataFrame:
    """Edges times their cells: one row per (edge, data cell, attribute cell). For traceback; the other operators do without."""
    d = data.select("sheet_id", F.col("gid").alias("data_gid"), F.col("row").alias("row_d"), F.col("col").alias("col_d"))
    a = attributes.select("sheet_id", F.col("gid").alias("attr_gid"), F.col("row").alias("row_a"), F.col("col").alias("col_a"))
    return edges.join(d, ["sheet_id", "data_gid"]).join(a, ["sheet_id", "attr_gid"])


def dimensions(edges: DataFrame, data: DataFrame, attributes: DataFrame, relax: bool = False) -> DataFrame:
    """Adds rel_dim, full and attr_group: the share of a data block's rows (columns) that an attribute block's cells cover.
    A full one is major; relax: where a block's side has none, its best ones count as full."""
    d = data.groupBy("sheet_id", F.col("gid").alias("data_gid")).agg(F.collect_set("row").alias("rows_d"), F.collect_set("col").alias("cols_d"))
    a = attributes.groupBy("sheet_id", F.col("gid").alias("attr_gid")).agg(F.collect_set("row").alias("rows_a"), F.collect_set("col").alias("cols_a"))
    out = edges.join(d, ["sheet_id", "data_gid"]).join(a, ["sheet_id", "attr_gid"])
    part = lambda x: F.size(F.array_intersect(f"{x}_d", f"{x}_a")) / F.size(f"{x}_d")
    rel = F.when(F.col("direction_group") == "NS", part("cols")).when(F.col("direction_group") == "WE", part("rows")).otherwise(F.lit(0.0))
    out = out.withColumn("rel_dim", rel).withColumn("full", F.col("rel_dim") >= 1).drop("rows_d", "cols_d", "rows_a", "cols_a")
    if relax:
        side = Window.partitionBy("sheet_id", "data_gid", "direction_group")
        lacking = (F.col("direction_group").isin("NS", "WE")) & ~F.max("full").over(side) & (F.col("rel_dim") == F.max("rel_dim").over(side)) & (F.col("rel_dim") > 0)
        out = out.withColumn("_l", lacking).withColumn("full", F.col("full") | F.col("_l")).drop("_l")
    return out.withColumn("attr_group", F.when(F.col("full"), "major").otherwise("minor"))


def footprints(attributes: DataFrame) -> DataFrame:
    """(sheet_id, gid, new_gid): attribute blocks of the same cells get the smallest of their names."""
    cells = attributes.groupBy("sheet_id", "gid").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("row", "col"))), lambda p: F.concat_ws(",", p.row.cast("string"), p.col.cast("string"))), ";").alias("footprint"))
    return cells.withColumn("new_gid", F.min("gid").over(Window.partitionBy("sheet_id", "footprint"))).select("sheet_id", "gid", "new_gid")


def information_blocks(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """(sheet_id, data_gid, info_gid): data blocks that share a major attribute cell, directly or through others."""
    cells = edges.where("attr_group = 'major'").join(attributes.withColumnRenamed("gid", "attr_gid"), ["sheet_id", "attr_gid"]).select("sheet_id", "data_gid", "row", "col").distinct()
    first = F.min("data_gid").over(Window.partitionBy("sheet_id", "row", "col"))
    links = cells.select("sheet_id", F.col("data_gid").alias("gid_1"), first.alias("gid_2")).distinct()
    return closure(links).select("sheet_id", F.col("gid").alias("data_gid"), F.col("new_gid").alias("info_gid"))


def sync_names(lines: DataFrame) -> DataFrame:
    """Adds attr_name, direction[_side]_k, to (sheet_id, data_gid, direction, dist) rows: k ranks the distances of a direction,
    side is a column that corners may have."""
    k = F.dense_rank().over(Window.partitionBy("sheet_id", "data_gid", "direction").orderBy("dist"))
    side = [F.col("side")] if "side" in lines.columns else []
    return lines.withColumn("attr_name", F.concat_ws("_", "direction", *side, k.cast("string")))


def layer_claims(headers: DataFrame, boxes: DataFrame, axis: str = "row", by_band: bool = False) -> DataFrame:
    """Layered headers claim data blocks: each from its own place up to the next header of its layer. headers: (sheet_id,
    layer, header, row, col); boxes: data blocks. A header whose range holds no block keeps all from its place on. by_band:
    blocks whose ranges overlap along the axis are claimed together, by where the first of them begins."""
    lo = "r_min" if axis == "row" else "c_min"
    if by_band:
        boxes, lo = enclosure(boxes, axis), "e_min"
    w = Window.partitionBy("sheet_id", "layer").orderBy(axis)
    at = headers.withColumn("to", F.lead(axis).over(w)).select("sheet_id", "layer", "header", F.col(axis).alias("from"), "to")
    met = at.join(boxes.select("sheet_id", F.col("gid").alias("data_gid"), F.col(lo).alias("at")), "sheet_id").where("`at` >= `from`")
    bounded = F.col("to").isNull() | (F.col("at") < F.col("to"))
    met = met.withColumn("is_bounded", bounded).withColumn("any_bounded", F.max(bounded).over(Window.partitionBy("sheet_id", "layer", "header")))
    return met.where("is_bounded or not any_bounded").select("sheet_id", "layer", "header", "data_gid", F.col("any_bounded").alias("is_bounded"))


def relative_sides(seen: DataFrame) -> DataFrame:
    """(sheet_id, attr_gid, row, col, side) of attribute blocks that data blocks see from above or below and from beside: WE
    for cells in the columns of those seen from beside (corners among them), else NS for cells in the rows of those seen
    from above or below, else null. A cell seen both ways counts for the way in which more data blocks see it."""
    cell = ["sheet_id", "attr_gid", "row", "col"]
    by = seen.where("direction_group in ('NS', 'WE')").groupBy(*cell, "direction_group").agg(F.count_distinct("data_gid").alias("n"))
    most = by.withColumn("_m", F.max("n").over(Window.partitionBy(*cell))).where("n = _m")
    ns, we = F.col("direction_group") == "NS", F.col("direction_group") == "WE"
    ranges = most.groupBy("sheet_id", "attr_gid").agg(F.min(F.when(ns, F.col("row"))).alias("r0"), F.max(F.when(ns, F.col("row"))).alias("r1"), F.min(F.when(we, F.col("col"))).alias("c0"), F.max(F.when(we, F.col("col"))).alias("c1"))
    both = ranges.where("r0 is not null and c0 is not null")
    side = F.when(F.col("col").between(F.col("c0"), F.col("c1")), "WE").when(F.col("row").between(F.col("r0"), F.col("r1")), "NS")
    return seen.select(*cell).distinct().join(both, ["sheet_id", "attr_gid"]).select(*cell, side.alias("side"))


def enclosed_allocation(attributes: DataFrame, boxes: DataFrame, axis: str = "row") -> DataFrame:
    """Attribute cells as the bands of data blocks (blocks whose ranges overlap along the axis, each band as wide as all of
    them) see them, allocated to bands, and then to every block of their band, at the distance from the block itself."""
    across = ("c_min", "c_max") if axis == "row" else ("r_min", "r_max")
    along = ("r_min", "r_max") if axis == "row" else ("c_min", "c_max")
    member = enclosure(boxes, axis)
    band = member.groupBy("sheet_id", F.col("enclosure").cast("string").alias("gid")).agg(F.min("e_min").alias(along[0]), F.max("e_max").alias(along[1]), F.min(across[0]).alias(across[0]), F.max(across[1]).alias(across[1]))
    every = Window.partitionBy("sheet_id")
    band = band.withColumns({across[0]: F.min(across[0]).over(every), across[1]: F.max(across[1]).over(every)})
    dealt = central(direction_map(attributes, band)).select("sheet_id", "attr_gid", F.col("data_gid").alias("band"), "row", "col", "direction", "direction_group")
    own = member.select("sheet_id", F.col("enclosure").cast("string").alias("band"), F.col("gid").alias("data_gid"), "r_min", "r_max", "c_min", "c_max")
    far = distance(F.col("row"), F.col("col"))
    return dealt.join(own, ["sheet_id", "band"]).select("sheet_id", "attr_gid", "data_gid", "row", "col", "direction", "direction_group", far.alias("dist"))


def allocation_variation(allocation: DataFrame) -> DataFrame:
    """(sheet_id, variation) of an allocation's mean distances: the sum over directions of the variance over data blocks, a
    missing distance counting as 0; 0 for one block. Smaller means more regular."""
    names = ("N", "S", "W", "E", "NW", "NE", "SW", "SE")
    wide = allocation.groupBy("sheet_id", "data_gid").pivot("direction", names).agg(F.avg("dist")).na.fill(0.0, list(names))
    return wide.groupBy("sheet_id").agg(sum((F.var_pop(c) for c in names[1:]), F.var_pop(names[0])).alias("variation"))


def allocations(seen: DataFrame) -> DataFrame:
    """(sheet_id, without, fit, variation): the best of five allocations of attribute cells per sheet, those without one of the
    sides S, E, W, N (corners on that side included) and the one with all. One that gives each cell to one data block and
    loses none goes first (fit 0), then one that gives no cell twice (1), then others (2); then the one with the least
    variation, then the first in the order named."""
    cell, seen = ["sheet_id", "row", "col"], kept(seen)  # read once for each allocation
    total = seen.select(*cell).distinct().groupBy("sheet_id").agg(F.count("*").alias("n"))
    out = None
    for k, name in enumerate(("S", "E", "W", "N", "none")):
        own = central(seen if name == "none" else seen.where(~F.contains("direction", F.lit(name))))
        uses = own.select(*cell, "attr_gid", "data_gid", "direction").distinct().groupBy(*cell).agg(F.count("*").alias("uses"))
        fit = uses.groupBy("sheet_id").agg(F.count("*").alias("m"), F.max("uses").alias("most")).join(total, "sheet_id")
        fit = fit.select("sheet_id", F.when(F.col("most") > 1, 2).when(F.col("m") < F.col("n"), 1).otherwise(0).alias("fit"))
        score = allocation_variation(own).join(fit, "sheet_id").select("sheet_id", "fit", F.round("variation", 9).alias("variation"), F.lit(k).alias("order"), F.lit(name).alias("without"))
        out = score if out is None else out.unionAll(score)
    return out.groupBy("sheet_id").agg(F.min(F.struct("fit", "variation", "order", "without")).alias("b")).select("sheet_id", "b.without", "b.fit", "b.variation")


def central(seen: DataFrame) -> DataFrame:
    """The nearest edges of each (data block, direction), and for attribute cells that none of them uses their nearest block."""
    w = Window.partitionBy("sheet_id", "data_gid", "direction")
    first = seen.withColumn("_m", F.min("dist").over(w)).where("dist = _m").drop("_m")
    left = seen.join(first.select("sheet_id", "row", "col").distinct(), ["sheet_id", "row", "col"], "left_anti")
    left = left.withColumn("_m", F.min("dist").over(Window.partitionBy("sheet_id", "row", "col"))).where("dist = _m").drop("_m")
    return first.unionByName(left)


def definiteness(edges: DataFrame, attribute_gids: DataFrame) -> dict[str, DataFrame]:
    """What looks indefinite: attributes of several blocks, blocks that lack a side, attributes without a block."""
    shared = edges.groupBy("sheet_id", "attr_gid").agg(F.count_distinct("data_gid").alias("n_blocks")).where("n_blocks > 1")
    sides = edges.groupBy("sheet_id", "data_gid").agg(F.bool_or(F.col("direction_group") == "NS").alias("ns"), F.bool_or(F.col("direction_group") == "WE").alias("we"))
    unmapped = attribute_gids.select("sheet_id", F.col("gid").alias("attr_gid")).distinct().join(edges, ["sheet_id", "attr_gid"], "left_anti")
    return {"shared": shared, "one_sided": sides.where("not ns or not we"), "unmapped": unmapped}


def joined_attributes(edges: DataFrame) -> DataFrame:
    """Edges in which the attribute blocks that one data block sees on one side, in one group, are one: its name is the least
    of theirs with the data block and the direction, its distance the least."""
    side = Window.partitionBy("sheet_id", "data_gid", "direction", "attr_group")
    out = edges.withColumn("_n", F.size(F.collect_set("attr_gid").over(side))).withColumn("_least", F.min("attr_gid").over(side)).withColumn("_near", F.min("dist").over(side))
    several = F.col("_n") > 1
    out = out.withColumn("attr_gid", F.when(several, F.concat_ws("_", "_least", "data_gid", "direction")).otherwise(F.col("attr_gid"))).withColumn("dist", F.when(several, F.col("_near")).otherwise(F.col("dist")))
    return out.select(edges.columns).distinct()


def merged_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges after data blocks were joined (sheet_id, gid, new_gid): one per attribute and data block, at the least distance,
    with the direction and group of the nearest."""
    own = edges.join(names.withColumnRenamed("gid", "data_gid"), ["sheet_id", "data_gid"], "left").withColumn("data_gid", F.coalesce("new_gid", "data_gid")).drop("new_gid")
    rest = [c for c in own.columns if c not in (*EDGE, "dist")]
    near = F.min(F.struct("dist", *sorted(rest)))
    return own.groupBy(*EDGE).agg(near.alias("e")).select(*EDGE, "e.dist", *[F.col(f"e.{c}") for c in rest])


def redirected(edges: DataFrame, attributes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Edges whose direction and distance are those of the attribute block's cell that is nearest to the data block's box,
    the most frequent direction of several that are as near, then the first by name."""
    seen = direction_map(attributes, boxes).join(edges.select(*EDGE).distinct(), EDGE, "left_semi")
    by = seen.groupBy(*EDGE, "direction", "direction_group", "dist").agg(F.count("*").alias("n"))
    best = by.groupBy(*EDGE).agg(F.min(F.struct("dist", (-F.col("n")).alias("n"), "direction", "direction_group")).alias("e")).select(*EDGE, "e.direction", "e.direction_group", "e.dist")
    return edges.drop("direction", "direction_group", "dist").distinct().join(best, EDGE)


def nearest_blocks(boxes: DataFrame) -> DataFrame:
    """(sheet_id, gid_1, gid_2): pairs of data blocks of which one is the nearest to the other on some side."""
    corners = corners_of(boxes)
    seen = direction_map(corners, boxes).where("attr_gid <> data_gid")
    near = nearest_attributes(seen)
    return near.select("sheet_id", F.least("attr_gid", "data_gid").alias("gid_1"), F.greatest("attr_gid", "data_gid").alias("gid_2")).distinct()


def unique_names(lines: DataFrame) -> DataFrame:
    """Header names of (sheet_id, data_gid, attr_gid, attr_name) rows without conflicts: a header with several names gets the
    largest of them with G_ before it, and headers that share a name in a data block get _1, _2 after it, in their order."""
    every = Window.partitionBy("sheet_id", "attr_gid")
    out = lines.withColumn("attr_name", F.when(F.min("attr_name").over(every) < F.max("attr_name").over(every), F.concat(F.lit("G_"), F.max("attr_name").over(every))).otherwise(F.col("attr_name"))).distinct()
    block = Window.partitionBy("sheet_id", "data_gid", "attr_name")
    place = F.row_number().over(block.orderBy("attr_gid"))
    return out.withColumn("_n", F.count("*").over(block)).withColumn("_k", place).withColumn("attr_name", F.when(F.col("_n") > 1, F.concat_ws("_", "attr_name", F.col("_k").cast("string"))).otherwise(F.col("attr_name"))).drop("_n", "_k")


def united(x: DataFrame, y: DataFrame) -> DataFrame:
    """Edges of either map, once each."""
    return x.unionByName(y).distinct()
