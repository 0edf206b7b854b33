"""Where headers lie as seen from data, and the joins that attach them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import sheet

#: The header tags that may serve each direction, in order of preference.
TAGS = {"N": ("vl", "vr", "vm", "v"), "S": ("vl", "vr", "vm", "v"), "W": ("hu", "hd", "hm", "h"), "E": ("hu", "hd", "hm", "h")} | {
    d: ("vl", "vr", "vm", "v", "hu", "hd", "hm", "h") for d in ("NW", "NE", "SW", "SE")
}
OPPOSITE = {"N": "S", "S": "N", "W": "E", "E": "W", "NW": "SE", "SE": "NW", "NE": "SW", "SW": "NE"}


def group_of(direction: Column) -> Column:
    return F.when(direction.isin("N", "S"), "NS").when(direction.isin("W", "E"), "WE").when(direction == "INSIDE", "inside").otherwise("corner")


def _seen(row: Column, col: Column) -> tuple[Column, Column]:
    """(direction, squared distance) of a cell from the box r_min..c_max beside it."""
    up, down = F.col("r_min") - row, row - F.col("r_max")
    left, right = F.col("c_min") - col, col - F.col("c_max")
    v = F.when(up > 0, "N").when(down > 0, "S").otherwise("")
    h = F.when(left > 0, "W").when(right > 0, "E").otherwise("")
    both = F.concat(v, h)
    dr, dc = F.greatest(up, down, F.lit(0)), F.greatest(left, right, F.lit(0))
    return F.when(both == "", "INSIDE").otherwise(both), dr * dr + dc * dc


def distance(row: Column, col: Column) -> Column:
    """The distance of a cell from the box r_min..c_max beside it."""
    return F.sqrt(_seen(row, col)[1].cast("double"))


def direction_map(attributes: DataFrame, boxes: DataFrame, inside: bool = False) -> DataFrame:
    """Every attribute cell as seen from every data box of its sheet: direction, its group and the distance. Boxes are few
    beside cells, so the join is on the sheet with one row per box."""
    a = attributes.select("sheet_id", F.col("gid").alias("attr_gid"), "row", "col")
    b = boxes.withColumnRenamed("gid", "data_gid")
    direction, far = _seen(F.col("row"), F.col("col"))
    out = a.join(b, "sheet_id").withColumn("direction", direction).withColumn("dist", F.sqrt(far.cast("double")))
    out = out if inside else out.where("direction <> 'INSIDE'")
    return out.select("sheet_id", "attr_gid", "data_gid", "row", "col", "direction", group_of(F.col("direction")).alias("direction_group"), "dist")


def nearest_attributes(seen: DataFrame, attribute_to_nearest_data: bool = False) -> DataFrame:
    """Edges (attr_gid, data_gid, direction) at their smallest distance, only the nearest of a data block's direction group;
    attribute_to_nearest_data: first each attribute block keeps its nearest data blocks."""
    edges = seen.groupBy("sheet_id", "attr_gid", "data_gid", "direction", "direction_group").agg(F.min("dist").alias("dist"), F.count("*").alias("n_cells"))
    if attribute_to_nearest_data:
        edges = edges.withColumn("_m", F.min("dist").over(Window.partitionBy("sheet_id", "attr_gid"))).where("dist = _m").drop("_m")
    return edges.withColumn("_m", F.min("dist").over(Window.partitionBy("sheet_id", "data_gid", "direction_group"))).where("dist = _m").drop("_m")


def _as_of(data: DataFrame, header: DataFrame, axis: str, last: bool) -> DataFrame:
    """As-of join on an axis: the last header place at or before a data cell's, or the first at or after it. Places are
    located in the union of both sides by a window, then joined on equality."""
    at = header.select("sheet_id", F.col(axis).alias("_h")).distinct()
    need = data.select("sheet_id", F.col(axis).alias("_d")).distinct()
    places = need.select("sheet_id", F.col("_d").alias("p"), F.lit(None).cast("int").alias("h")).unionAll(at.select("sheet_id", F.col("_h").alias("p"), F.col("_h").alias("h")))
    own = places.groupBy("sheet_id", "p").agg(F.max("h").alias("h"))
    w = sheet().orderBy("p" if last else F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    found = own.withColumn("_h", F.last("h", ignorenulls=True).over(w)).where("_h is not null").select("sheet_id", F.col("p").alias(axis), "_h")
    return data.join(found, ["sheet_id", axis])


def _nearest(data: DataFrame, header: DataFrame, axis: str) -> DataFrame:
    """The nearest header place, the larger of two: half-open ranges between middles."""
    w = sheet().orderBy("_h")
    at = header.select("sheet_id", F.col(axis).alias("_h")).distinct()
    ranges = at.withColumn("_lo", (F.lag("_h").over(w) + F.col("_h")) / 2).withColumn("_hi", (F.lead("_h").over(w) + F.col("_h")) / 2)
    need = data.select("sheet_id", F.col(axis)).distinct()
    found = need.join(ranges, "sheet_id").where((F.col("_lo").isNull() | (F.col(axis) >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(axis) < F.col("_hi"))))
    return data.join(found.select("sheet_id", axis, "_h"), ["sheet_id", axis])


def attach(data: DataFrame, header: DataFrame, tag: str) -> DataFrame:
    """Data cells with the headers that a tag gives them; header columns besides sheet_id, row and col are added, and
    header_row, header_col. v, h: same column, row; vl, vr, hu, hd: the last one before, the first one after; vm, hm: the
    nearest; direct: every header for every cell."""
    extra = [c for c in header.columns if c not in ("sheet_id", "row", "col")]
    h = header.select("sheet_id", F.col("row").alias("header_row"), F.col("col").alias("header_col"), *extra)
    if tag == "direct":
        return data.join(h, "sheet_id")
    axis = "col" if tag[0] == "v" else "row"
    if len(tag) == 1:
        return data.join(h.withColumn(axis, F.col(f"header_{axis}")), ["sheet_id", axis])
    placed = _nearest(data, header, axis) if tag[1] == "m" else _as_of(data, header, axis, last=tag in ("vl", "hu"))
    return placed.join(h.withColumn("_h", F.col(f"header_{axis}")), ["sheet_id", "_h"]).drop("_h")


def bind(data: DataFrame, header: DataFrame, tag: str, binder: Callable[[DataFrame, DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """attach(), but a header of one cell goes to every cell of its sheet. binder: does what attach() does otherwise."""
    n = header.groupBy("sheet_id").agg(F.count("*").alias("_n"))
    one = header.join(n.where("_n = 1"), "sheet_id", "left_semi")
    more = header.join(n.where("_n > 1"), "sheet_id", "left_semi")
    return (binder or attach)(data, more, tag).unionByName(attach(data, one, "direct"))


def representatives(data: DataFrame) -> DataFrame:
    """The first cell of each row and of each column of a data block."""
    keys = [c for c in ("sheet_id", "gid") if c in data.columns]
    by_row = data.groupBy(*keys, "row").agg(F.min("col").alias("col"))
    by_col = data.groupBy(*keys, "col").agg(F.min("row").alias("row"))
    return by_row.select(*keys, "row", "col").unionByName(by_col.select(*keys, "row", "col")).distinct()


def coverage(data: DataFrame, header: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(sheet_id, tag, coverage): the share of representative cells that each tag gives a header."""
    rep = representatives(data)
    total = rep.groupBy("sheet_id").agg(F.count("*").alias("n"))
    out = None
    for k, tag in enumerate(tags):
        hit = attach(rep, header.select("sheet_id", "row", "col").distinct(), tag).select("sheet_id", "row", "col").distinct().groupBy("sheet_id").agg(F.count("*").alias("m"))
        own = total.join(hit, "sheet_id", "left").select("sheet_id", F.lit(tag).alias("tag"), F.lit(k).alias("preference"), (F.coalesce("m", F.lit(0)) / F.col("n")).alias("coverage"))
        out = own if out is None else out.unionAll(own)
    return out


def best_tag(measured: DataFrame) -> DataFrame:
    """The tag of the highest coverage, the preferred one of equals."""
    return measured.groupBy("sheet_id").agg(F.max_by("tag", F.struct("coverage", -F.col("preference"))).alias("tag"), F.max("coverage").alias("coverage"))


def full_join(x: DataFrame, y: DataFrame, on: list[str], unique: bool = False) -> DataFrame:
    """Full join in which columns that both sides have are coalesced; unique: the smallest row per key."""
    both = [c for c in x.columns if c in y.columns and c not in on]
    out = x.join(y.select(*on, *[F.col(c).alias(f"_{c}") if c in both else F.col(c) for c in y.columns if c not in on]), on, "full")
    for c in both:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    if unique:
        rest = [c for c in out.columns if c not in on]
        out = out.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_r")).select(*on, *[F.col(f"_r.{c}") for c in rest])
    return out
