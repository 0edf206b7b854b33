"""From classified cells to data blocks, their headers and the way each header is attached.

A sheet's analysis decides step by step on few blocks and lines, so each sheet is analysed in one task: one shuffle deals
the coordinates and types (not the texts) by sheet, and thousands of sheets are one job. The relational operators in
gridloom.operators do single steps on sheets of any size.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import kept
from ..operators.blocks import label
from ..operators.headers import TAGS
from ..schema import KEY, validate_cells

Place = tuple[int, int]
Box = tuple[int, int, int, int]
LINE = ["sheet_id", "data_gid", "line"]


@dataclass(frozen=True)
class AnalyzeOptions:
    """join_blocks: attachable data blocks become one. table_blocks: sheets whose attributes lie on no clear side are cut
    into table blocks no closer than `table_distance`, and no header crosses them. reallocation: where several blocks could
    take a header, the most regular allocation is chosen. check: validate the cells first (one more job)."""

    join_blocks: bool = True
    table_blocks: bool = True
    table_distance: float = 5
    reallocation: bool = True
    check: bool = False


@dataclass(frozen=True)
class CellAnalysis:
    """cells: all cells that aren't empty; data: (sheet_id, row, col, gid, data_block); attributes: (sheet_id, row, col, gid);
    line_cells: the cells of header lines with the line's direction, name and tag; lines: one row per header line of a data
    block; edges: attribute blocks of data blocks; sections and sections_full: boxes of data blocks without and with headers."""

    cells: DataFrame
    data: DataFrame
    attributes: DataFrame
    line_cells: DataFrame
    lines: DataFrame
    edges: DataFrame
    sections: DataFrame
    sections_full: DataFrame
    options: AnalyzeOptions = AnalyzeOptions()


def group_of(direction: str) -> str:
    return {"N": "NS", "S": "NS", "W": "WE", "E": "WE", "INSIDE": "inside"}.get(direction, "corner")


def seen_from(box: Box, r: int, c: int) -> tuple[str, float]:
    """Direction and distance of a cell from a box."""
    dr, dc = max(box[0] - r, r - box[2], 0), max(box[1] - c, c - box[3], 0)
    v = "N" if r < box[0] else "S" if r > box[2] else ""
    h = "W" if c < box[1] else "E" if c > box[3] else ""
    return v + h or "INSIDE", math.hypot(dr, dc)


def _box(cells: list[Place]) -> Box:
    rows, cols = zip(*cells, strict=True)
    return min(rows), min(cols), max(rows), max(cols)


def _within(p: Place, b: Box) -> bool:
    return b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]


def _gids(cells: list[Place], prefix: str) -> dict[str, list[Place]]:
    out: dict[str, list[Place]] = defaultdict(list)
    if cells:
        for p, k in zip(cells, label(np.array([r for r, _ in cells]), np.array([c for _, c in cells])), strict=True):
            out[f"{prefix}{k}"].append(p)
    return dict(out)


def well_sided(attributes: list[Place], box: Box, tolerance: float = 0.8) -> bool:
    """Whether, of opposite sides that the box's diagonals cut, one holds nearly all attributes."""
    count = dict.fromkeys("NSWE", 0)
    height, wide = box[2] - box[0], box[3] - box[1]
    for r, c in attributes:
        a = (r - box[0]) * wide - height * (c - box[1])
        b = height * wide - (r - box[0]) * wide - height * (c - box[1])
        if a and b:
            count[("W" if b > 0 else "S") if a > 0 else ("N" if b > 0 else "E")] += 1
    for x, y in ("NS", "WE"):
        if count[x] and count[y] and abs(count[x] - count[y]) / (count[x] + count[y]) <= tolerance:
            return False
    return True


def _tables(cells: list[Place], distance: float) -> dict[Place, int]:
    """Table blocks: touching cells, and blocks whose boxes are within the distance."""
    found = list(_gids(cells, "t").values())
    parent = list(range(len(found)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    boxes = [_box(x) for x in found]
    for i in range(len(found)):
        for j in range(i):
            a, b = boxes[i], boxes[j]
            if root(i) != root(j) and math.hypot(max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0)) <= distance:
                parent[root(i)] = root(j)
    return {p: root(k) for k, cells_ in enumerate(found) for p in cells_}


class Line(NamedTuple):
    line: str
    direction: str
    dist: float
    role: str
    name: str
    tag: str
    cells: list[tuple[Place, str]]


class Sheet:
    """The analysis of one sheet."""

    def __init__(self, values: list[Place], attributes: list[Place], options: AnalyzeOptions) -> None:
        self.options, self.attributes = options, attributes
        self.data = _gids(values, "d")
        self.attr = _gids(attributes, "a")
        everything = values + attributes
        cut = options.table_blocks and not well_sided(attributes, _box(everything))
        self.table = _tables(everything, options.table_distance) if cut else dict.fromkeys(everything, 0)
        self.look()
        if options.join_blocks and self.join():
            self.look()
        if options.reallocation:
            self.reallocate()
        self.adopt()

    def look(self) -> None:
        """Sees all attribute cells from all data blocks, and takes the nearest attribute blocks of each side."""
        self.box = {g: _box(cells) for g, cells in self.data.items()}
        self.seen: dict[tuple[str, str, str], list[tuple[Place, float]]] = defaultdict(list)
        for d, box in self.box.items():
            own = self.table[self.data[d][0]]
            for a, cells in self.attr.items():
                for p in cells:
                    if self.table[p] == own:
                        direction, far = seen_from(box, *p)
                        if direction != "INSIDE":
                            self.seen[a, d, direction].append((p, far))
        least: dict[tuple[str, str], float] = {}
        for (_, d, direction), found in self.seen.items():
            key = d, group_of(direction)
            least[key] = min(least.get(key, math.inf), min(x[1] for x in found))
        self.edges = {k for k, found in self.seen.items() if min(x[1] for x in found) == least[k[1], group_of(k[2])]}

    def share(self, a: str, d: str, direction: str) -> float:
        """The share of a data block's columns (rows) that the attribute block's cells on this side cover."""
        axis = {"NS": 1, "WE": 0}.get(group_of(direction))
        if axis is None:
            return 0.0
        need = {p[axis] for p in self.data[d]}
        return len(need & {p[axis] for p, _ in self.seen[a, d, direction]}) / len(need)

    def join(self) -> bool:
        """Joins attachable data blocks: headers on the same sides, no other cell in their common box, and no other attribute
        in the box of blocks and headers of any side."""
        head: dict[str, dict[str, set[Place]]] = {d: defaultdict(set) for d in self.data}
        for a, d, direction in self.edges:
            if group_of(direction) != "corner":
                head[d][direction].update(p for p, _ in self.seen[a, d, direction])
        owner = {p: g for g, cells in self.data.items() for p in cells} | dict.fromkeys(self.attributes)
        changed = moved = True
        changed = False
        while moved:
            moved = False
            names = sorted(self.data, key=lambda g: int(g[1:]))
            for a, b in ((a, b) for i, a in enumerate(names) for b in names[i + 1 :]):
                if a not in self.data or b not in self.data or not head[a] or set(head[a]) != set(head[b]):
                    continue
                both = _box([*self.data[a], *self.data[b]])
                if any(g not in (a, b) and _within(p, both) for p, g in owner.items()):
                    continue
                sides = [(wide, own) for d in head[a] for own in [head[a][d] | head[b][d]] for wide in [_box([*own, both[:2], both[2:]])]]
                if any(p not in own and _within(p, wide) for wide, own in sides for p in self.attributes):
                    continue
                for d, own in head.pop(b).items():
                    head[a][d] |= own
                owner.update(dict.fromkeys(self.data[b], a))
                self.data[a] += self.data.pop(b)
                moved = changed = True
        return changed

    def reallocate(self) -> None:
        """Where a header serves several data blocks from opposite sides, tries to do without one side: an allocation that gives
        each header cell to one block and loses none goes first, then one that gives none twice, then others; of equals
        the one with the smallest spread of distances, then the first of S, E, W, N and all sides."""
        by_attr: dict[str, set[str]] = defaultdict(set)
        for a, _, direction in self.edges:
            by_attr[a].add(direction)
        torn = {a for a, found in by_attr.items() if {"N", "S"} <= found or {"W", "E"} <= found}
        if not torn or len(self.data) < 2:
            return

        cells = {p for a in torn for p in self.attr[a]}

        def worth(without: str, order: int) -> tuple[int, float, int]:
            kept = [k for k in self.edges if k[0] not in torn or not without or without not in k[2]]
            uses: dict[Place, int] = defaultdict(int)
            for k in kept:
                if k[0] in torn:
                    for p, _ in self.seen[k]:
                        uses[p] += 1
            fit = 2 if any(n > 1 for n in uses.values()) else 1 if len(uses) < len(cells) else 0
            spread = 0.0
            for direction in {k[2] for k in kept}:
                far = [min((x[1] for k in kept if k[1] == d and k[2] == direction for x in self.seen[k]), default=0.0) for d in self.data]
                spread += float(np.var(far))
            return fit, round(spread, 9), order

        sides = ("S", "E", "W", "N", "")
        best = min(sides, key=lambda s: worth(s, sides.index(s)))
        if worth(best, 0)[0] < 2:  # where every one gives some cell twice, all of them stay
            self.edges = {k for k in self.edges if k[0] not in torn or not best or best not in k[2]}

    def adopt(self) -> None:
        """Attribute blocks that no data block took go to the nearest one, as minor headers."""
        used = {a for a, _, _ in self.edges}
        least: dict[str, float] = {}
        for (a, _, _), found in self.seen.items():
            if a not in used:
                least[a] = min(least.get(a, math.inf), min(x[1] for x in found))
        self.adopted = {k for k, found in self.seen.items() if k[0] in least and min(x[1] for x in found) == least[k[0]]}

    def blocks(self) -> dict[str, str]:
        """Names of the data blocks from left to right, then down."""
        mean = lambda cells, k: round(sum(p[k] for p in cells) / len(cells))
        order = sorted(self.data, key=lambda d: (mean(self.data[d], 1), mean(self.data[d], 0), int(d[1:])))
        return {d: f"d{k}" for k, d in enumerate(order, 1)}

    def lines(self, d: str) -> list[Line]:
        """The header lines of a data block: rows above and below, columns beside, single cells at its corners."""
        found: dict[tuple[str, str], list[tuple[Place, float, str]]] = defaultdict(list)
        role: dict[tuple[str, str], str] = {}
        best: dict[str, float] = {}
        own = sorted(k for k in self.edges | self.adopted if k[1] == d)
        for a, _, direction in own:
            if (a, d, direction) in self.edges and group_of(direction) != "corner":
                best[group_of(direction)] = max(best.get(group_of(direction), 0.0), self.share(a, d, direction))
        for a, _, direction in own:
            group, share = group_of(direction), self.share(a, d, direction)
            major = (a, d, direction) in self.edges and share > 0 and share >= min(1.0, best.get(group, 1.0))
            for p, far in self.seen[a, d, direction]:
                key = direction, f"{direction}:" + (f"r{p[0]}" if group == "NS" else f"c{p[1]}" if group == "WE" else f"{p[0]},{p[1]}")
                found[key].append((p, far, a))
                role[key] = "major" if major or role.get(key) == "major" else "minor"
        columns = {p[1] for (direction, _), cells in found.items() if group_of(direction) == "WE" for p, _, _ in cells}
        rows = {p[0] for (direction, _), cells in found.items() if group_of(direction) == "NS" for p, _, _ in cells}
        far = {key: min(x[1] for x in cells) for key, cells in found.items()}
        rank = {direction: sorted({far[k] for k in found if k[0] == direction}) for direction, _ in found}
        out = []
        for key, cells in found.items():
            direction, name = key
            side = ""
            if group_of(direction) == "corner":
                r, c = cells[0][0]
                side = "WE_" if c in columns else "NS_" if r in rows else ""
            tag = best_tag(self.data[d], [p for p, _, _ in cells], direction)
            out.append(Line(name, direction, far[key], role[key], f"{direction}_{side}{rank[direction].index(far[key]) + 1}", tag, [(p, a) for p, _, a in cells]))
        named: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(out):
            named[x.name].append(k)
        for name, own in named.items():  # corner cells may be equally far: _1, _2 in order of place
            if len(own) > 1:
                for i, k in enumerate(sorted(own, key=lambda k: out[k].cells[0][0]), 1):
                    out[k] = out[k]._replace(name=f"{name}_{i}")
        return out

    def rows(self) -> list[tuple]:
        """(kind, row, col, gid, block, line, direction, dist, role, name, tag): data cells, attribute cells, line cells."""
        block = self.blocks()
        nothing = (None,) * 6
        out: list[tuple] = [("data", *p, d, block[d], *nothing) for d, cells in self.data.items() for p in cells]
        out += [("attribute", *p, a, None, *nothing) for a, cells in self.attr.items() for p in cells]
        for d in self.data:
            out += [("line", *p, d, block[d], x.line, x.direction, x.dist, x.role, x.name, f"{x.tag}|{a}") for x in self.lines(d) for p, a in x.cells]
        return out


def best_tag(data: list[Place], header: list[Place], direction: str) -> str:
    """One cell goes to all; else the tag that gives most representative cells a header, v and h first if they give all."""
    if len(header) == 1:
        return "direct"
    first_in_row: dict[int, int] = {}
    first_in_col: dict[int, int] = {}
    for r, c in data:
        first_in_row[r] = min(first_in_row.get(r, c), c)
        first_in_col[c] = min(first_in_col.get(c, r), r)
    rep = {*first_in_row.items(), *((r, c) for c, r in first_in_col.items())}
    axis = 0 if group_of(direction) == "WE" else 1
    at = sorted({p[axis] for p in header})
    need = [p[axis] for p in rep]
    exact = sum(x in at for x in need) / len(need)
    tags = [t for t in TAGS[direction] if (t[0] == "h") == (axis == 0)]
    if exact == 1:
        return "h" if axis == 0 else "v"
    got = {"l": sum(bisect_right(at, x) > 0 for x in need), "u": sum(bisect_right(at, x) > 0 for x in need)}
    got["r"] = got["d"] = sum(bisect_left(at, x) < len(at) for x in need)
    got["m"] = len(need)
    return max(tags, key=lambda t: (got[t[1]] / len(need) if len(t) == 2 else exact, -tags.index(t)))


def header_of(tag: str, header: list[Place]) -> Callable[[Place], Place | None]:
    """The header cell that a tag gives a data cell, as headers.attach() does: the first of several in one place."""
    if tag == "direct":
        return lambda p: header[0]
    axis = 1 if tag[0] == "v" else 0
    by = {p[axis]: p for p in sorted(header, reverse=True)}
    at = sorted(by)
    if len(tag) == 1:
        return lambda p: by.get(p[axis])
    if tag[1] == "m":
        middles = [(x + y) / 2 for x, y in zip(at, at[1:], strict=False)]
        return lambda p: by[at[bisect_right(middles, p[axis])]]
    if tag[1] in "lu":
        return lambda p: by[at[k - 1]] if (k := bisect_right(at, p[axis])) else None
    return lambda p: by[at[k]] if (k := bisect_left(at, p[axis])) < len(at) else None


def places(own: pd.DataFrame) -> dict[str, list[Place]]:
    """The cells of one sheet by type."""
    return {t: [(int(r), int(c)) for r, c in zip(x["row"], x["col"], strict=True)] for t, x in own.groupby("type")}


_FOUND = "sheet_id string, kind string, row int, col int, gid string, data_block string, line string, direction string, dist double, attr_group string, attr_name string, tag string"


def analyze_cells(cells: DataFrame, options: AnalyzeOptions | None = None) -> CellAnalysis:
    """cells: with type. Sheets without values or without attributes give no blocks."""
    options = options or AnalyzeOptions()
    if "type" not in cells.columns:
        raise ValueError("the type column is missing: classify the cells first")
    if options.check and not (report := validate_cells(cells)):
        raise ValueError("; ".join(report.messages()))
    cells = cells.where("type <> 'empty'")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        at = places(own)
        rows = Sheet(at["value"], at["attribute"], options).rows() if {"value", "attribute"} <= set(at) else []
        out = pd.DataFrame(rows, columns=["kind", "row", "col", "gid", "data_block", "line", "direction", "dist", "attr_group", "attr_name", "tag"])
        out.insert(0, "sheet_id", own["sheet_id"].iloc[0])
        return out.astype({"row": "int32", "col": "int32", "dist": "float64"})

    found = cells.select(*KEY, "type").distinct().groupBy("sheet_id").applyInPandas(run, _FOUND)
    found = kept(found)  # several relations read it
    data = found.where("kind = 'data'").select(*KEY, "gid", "data_block")
    attributes = found.where("kind = 'attribute'").select(*KEY, "gid")
    group = F.when(F.col("direction").isin("N", "S"), "NS").when(F.col("direction").isin("W", "E"), "WE").otherwise("corner")
    line_cells = found.where("kind = 'line'").select("sheet_id", F.col("gid").alias("data_gid"), "data_block", "line", "row", "col", "direction", group.alias("direction_group"), "dist", "attr_group", "attr_name", F.substring_index("tag", "|", 1).alias("tag"), F.substring_index("tag", "|", -1).alias("attr_gid"))
    lines = line_cells.groupBy(*LINE, "data_block", "direction", "direction_group", "attr_group", "attr_name", "tag").agg(F.min("dist").alias("dist"), F.count("*").alias("n_cells"))
    edges = line_cells.groupBy("sheet_id", "attr_gid", "data_gid", "direction", "direction_group").agg(F.min("dist").alias("dist"), F.min("attr_group").alias("attr_group"))
    boxes = [F.min("row").alias("r_min"), F.min("col").alias("c_min"), F.max("row").alias("r_max"), F.max("col").alias("c_max")]
    sections = data.groupBy("sheet_id", "data_block").agg(*boxes)
    near = line_cells.where("attr_group = 'major' or dist < 3").select("sheet_id", "data_block", "row", "col")
    full = data.select("sheet_id", "data_block", "row", "col").unionAll(near).groupBy("sheet_id", "data_block").agg(*boxes)
    return CellAnalysis(cells, data, attributes, line_cells, lines, edges, sections, full, options)


analyse_cells = analyze_cells


def with_tags(ca: CellAnalysis, changes: DataFrame) -> CellAnalysis:
    """The analysis with other orientations: (sheet_id, data_block, attr_name, tag) rows say which lines get which tag."""
    new = changes.select("sheet_id", "data_block", "attr_name", F.col("tag").alias("_tag"))
    turned = lambda df: df.join(new, ["sheet_id", "data_block", "attr_name"], "left").withColumn("tag", F.coalesce("_tag", "tag")).select(df.columns)
    return replace(ca, lines=turned(ca.lines), line_cells=turned(ca.line_cells))


def roles(ca: CellAnalysis) -> DataFrame:
    """(sheet_id, row, col, role) of data, major and minor attribute cells; one that is both is major."""
    heads = ca.line_cells.groupBy(*KEY).agg(F.when(F.max((F.col("attr_group") == "major").cast("int")) == 1, "major_attr").otherwise("minor_attr").alias("role"))
    return ca.data.select(*KEY, F.lit("data").alias("role")).distinct().unionByName(heads)
