"""Table blocks that share a header, on any side, bound under it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import transpose

SIDES = ("top", "left", "bottom", "right")


def side_headers(cells: DataFrame) -> DataFrame:
    """(sheet_id, gid, side, labels): the trimmed lower-case texts along each side of each block, in order."""
    box = Window.partitionBy("sheet_id", "gid")
    at = cells.withColumns({"r0": F.min("row").over(box), "r1": F.max("row").over(box), "c0": F.min("col").over(box), "c1": F.max("col").over(box)})
    on = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(side).alias("side"), F.col(axis).alias("k"))) for side, test, axis in (("top", F.expr("row = r0"), "col"), ("left", F.expr("col = c0"), "row"), ("bottom", F.expr("row = r1"), "col"), ("right", F.expr("col = c1"), "row"))]))
    each = at.select("sheet_id", "gid", F.lower(F.trim("value")).alias("v"), F.explode(on).alias("s"))
    return each.groupBy("sheet_id", "gid", "s.side").agg(F.transform(F.array_sort(F.collect_list(F.struct("s.k", "v"))), lambda x: x.v).alias("labels"))


def mergeable(headers: DataFrame) -> DataFrame:
    """(sheet_id, gid_1, side_1, gid_2, side_2) of blocks whose header on one side holds all labels of the other's."""
    a = headers.select("sheet_id", *[F.col(c).alias(f"{c}_1") for c in ("gid", "side", "labels")])
    b = headers.select("sheet_id", *[F.col(c).alias(f"{c}_2") for c in ("gid", "side", "labels")])
    shared = F.size(F.array_intersect("labels_1", "labels_2"))
    found = a.join(b, "sheet_id").where("gid_1 < gid_2").where((shared > 0) & (shared == F.least(F.size(F.array_distinct("labels_1")), F.size(F.array_distinct("labels_2")))))
    order = [F.array_position(F.array(*map(F.lit, SIDES)), F.col(c)) for c in ("side_1", "side_2")]
    first = Window.partitionBy("sheet_id", "gid_1", "gid_2").orderBy(*order)
    return found.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("sheet_id", "gid_1", "side_1", "gid_2", "side_2")


def oriented(cells: DataFrame, side: str) -> DataFrame:
    """A block with its header on the given side as (sheet_id, gid, record, label, value) rows."""
    own = transpose(cells) if side in ("left", "right") else cells
    box = Window.partitionBy("sheet_id", "gid")
    head = F.min("row").over(box) if side in ("top", "left") else F.max("row").over(box)
    own = own.withColumn("head", head)
    labels = own.where("row = head").select("sheet_id", "gid", "col", F.lower(F.trim("value")).alias("label"))
    return own.where("row <> head").select("sheet_id", "gid", F.col("row").alias("record"), "col", "value").join(labels, ["sheet_id", "gid", "col"]).select("sheet_id", "gid", "record", "label", "value")


def stack_all(cells: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """By first block, the (gid, side) of blocks that a fold joins: blocks in order of name, each to the first stack whose
    first block it shares a header with. Blocks are few, so the fold runs on their pairs alone."""
    pairs = {(r["gid_1"], r["gid_2"]): (r["side_1"], r["side_2"]) for r in mergeable(side_headers(cells)).collect()}
    out: dict[str, list[tuple[str, str]]] = {}
    for (gid,) in cells.select("gid").distinct().orderBy("gid").collect():
        home = next((h for h in out if (h, gid) in pairs and out[h][0][1] in ("", pairs[h, gid][0])), None)
        if home is None:
            out[gid] = [(gid, "")]
        else:
            out[home][0] = (home, pairs[home, gid][0])
            out[home].append((gid, pairs[home, gid][1]))
    return out


def stack(cells: DataFrame, sides: list[tuple[str, str]], labels: list[str]) -> DataFrame:
    """Blocks (gid, side of the header) bound by label: one row per record, one column per label."""
    out = None
    for gid, side in sides:
        own = oriented(cells.where(F.col("gid") == gid), side)
        out = own if out is None else out.unionByName(own)
    return out.groupBy("sheet_id", "gid", "record").pivot("label", labels).agg(F.first("value"))
