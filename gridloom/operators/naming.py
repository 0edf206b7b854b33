"""Names for composed columns from the header texts around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_substring


def common_name(texts: list[str]) -> str:
    """The longest string that all texts hold; without one of two characters, the distinct texts joined."""
    found = list(dict.fromkeys(t for t in texts if t))
    if not found:
        return ""
    out = found[0]
    for t in found[1:]:
        out = common_substring(out, t)
    return out.strip() if len(out.strip()) > 1 else "_".join(found)


def suggestions(lines: DataFrame, line_cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(sheet_id, data_block, attr_name, suggestion, score): header cells near a header line name its column, best first.

    The score adds four times the share of the candidate's direction among all, two for cells of the line's own block, one
    over the distance plus one, one for cells that are no corner, and one over the number of the candidate's uses plus one."""
    own = line_cells.select("sheet_id", "data_gid", "line", F.col("attr_gid").alias("own_gid"), F.col("row").alias("r"), F.col("col").alias("c"))
    near = line_cells.select("sheet_id", "data_gid", F.col("line").alias("other"), "attr_gid", "row", "col", "direction_group").distinct()
    pairs = own.join(near, ["sheet_id", "data_gid"]).where("line <> other and (r = row or c = col)")
    far = F.sqrt(((F.col("r") - F.col("row")) * (F.col("r") - F.col("row")) + (F.col("c") - F.col("col")) * (F.col("c") - F.col("col"))).cast("double"))
    best = pairs.groupBy("sheet_id", "data_gid", "line", "row", "col").agg(F.min(far).alias("dist"), F.max((F.col("own_gid") == F.col("attr_gid")).cast("int")).alias("same"), F.min((F.col("direction_group") == "corner").cast("int")).alias("corner"), F.count("*").alias("n"))
    share = F.count("*").over(Window.partitionBy("sheet_id", "data_gid", "line", "corner")) / F.count("*").over(Window.partitionBy("sheet_id", "data_gid", "line"))
    score = 4 * share + 2 * F.col("same") + 1 / (F.col("dist") + 1) + (1 - F.col("corner")) + 1 / (F.col("n") + 1)
    named = best.withColumn("score", score).join(texts.select("sheet_id", "row", "col", F.col("value").alias("suggestion")), ["sheet_id", "row", "col"])
    return named.join(lines.select("sheet_id", "data_gid", "line", "data_block", "attr_name"), ["sheet_id", "data_gid", "line"]).groupBy("sheet_id", "data_block", "attr_name").agg(F.max_by("suggestion", F.struct("score", "suggestion")).alias("suggestion"), F.max("score").alias("score"))


def suggestions_after(column_map: list[tuple[str, str, str, bool, int]], found: DataFrame) -> dict[str, str]:
    """Names for collated columns: of the suggestions for the columns that became one, the best by score, then by name."""
    first = {r["attr_name"]: (r["score"], r["suggestion"]) for r in found.groupBy("attr_name").agg(F.max(F.struct("score", "suggestion")).alias("b")).select("attr_name", "b.score", "b.suggestion").collect()}
    came: dict[str, set[str]] = {}
    for new, old, _, _, _ in column_map:  # in the order of the steps, so an earlier step's names are known
        came.setdefault(new, set()).update(came.get(old, {old}) if old.startswith(("collated_", "uncollated_")) else {old})
    best = {new: max(first[o] for o in olds if o in first)[1] for new, olds in came.items() if any(o in first for o in olds)}
    return {new: name for k, (new, name) in enumerate(sorted(best.items())) if name not in [n for _, n in sorted(best.items())[:k]]}


def rename_columns(wide: DataFrame, found: DataFrame, sheet_id: str, data_block: str) -> DataFrame:
    """One block's wide table with suggested names; a name that is taken is left alone."""
    names = {r["attr_name"]: r["suggestion"] for r in found.where((F.col("sheet_id") == sheet_id) & (F.col("data_block") == data_block)).collect()}
    out: dict[str, str] = {}
    for old, new in sorted(names.items()):
        if old in wide.columns and new not in wide.columns and new not in out.values():
            out[old] = new
    return wide.withColumnsRenamed(out)
