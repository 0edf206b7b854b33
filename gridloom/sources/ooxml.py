"""Tables of xlsx, docx and pptx packages, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime, timedelta
from xml.etree import ElementTree as ET

#: Number formats of the file format that show dates.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))

Cell = tuple[int, int, str, str]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ET.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _number(x: float) -> str:
    return f"{x:.10f}".rstrip("0").rstrip(".")


def _serial(n: float) -> str:
    at = datetime(1970, 1, 1) + timedelta(days=n - 25569)
    return str(date(at.year, at.month, at.day)) if n == int(n) else str(at.replace(microsecond=0))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter() if _local(x.tag) == "numFmt"}
    shown = {k for k, code in own.items() if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)}
    for node in root:
        if _local(node.tag) == "cellXfs":
            return [int(x.get("numFmtId", 0)) in DATE_FORMATS or int(x.get("numFmtId", 0)) in shown for x in node]
    return []


def xlsx(raw: bytes) -> list[tuple[str, list[Cell]]]:
    """(sheet name, (row, col, data_type, value) cells) of a workbook; blank and error cells are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = [_texts(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)
        target = {x.get("Id"): x.get("Target") for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for node in ET.fromstring(book.read("xl/workbook.xml")).iter():
            if _local(node.tag) != "sheet":
                continue
            path = target[next(v for k, v in node.attrib.items() if _local(k) == "id")].lstrip("/")
            cells: list[Cell] = []
            for c in ET.fromstring(book.read(path if path.startswith("xl/") else f"xl/{path}")).iter():
                if _local(c.tag) != "c" or c.get("t") == "e":
                    continue
                v = next((x.text for x in c if _local(x.tag) == "v"), None)
                kind, style = c.get("t", "n"), int(c.get("s", 0))
                at = int(re.search(r"\d+", c.get("r"))[0]), _column(c.get("r"))
                if kind == "inlineStr":
                    cells.append((*at, "character", _texts(c)))
                elif v is None:
                    continue
                elif kind == "s":
                    cells.append((*at, "character", shared[int(v)]))
                elif kind == "b":
                    cells.append((*at, "character", "TRUE" if v == "1" else "FALSE"))
                elif kind == "n" and style < len(dates) and dates[style]:
                    cells.append((*at, "character", _serial(float(v))))
                elif kind == "n":
                    cells.append((*at, "numeric", _number(float(v))))
                else:
                    cells.append((*at, "character", v))
            out.append((node.get("name"), [x for x in cells if x[3] != ""]))
        return out


def _tables(root: ET.Element, table: str, row: str, cell: str) -> list[list[list[str]]]:
    out = []
    for t in (x for x in root.iter() if _local(x.tag) == table):
        rows = [[" ".join(filter(None, (_texts(p) for p in c.iter() if _local(p.tag) == "p"))).strip() for c in r if _local(c.tag) == cell] for r in t if _local(r.tag) == row]
        out.append(rows)
    return out


def docx(raw: bytes) -> list[list[list[str]]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        return _tables(ET.fromstring(book.read("word/document.xml")), "tbl", "tr", "tc")


def pptx(raw: bytes) -> list[list[list[str]]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        slides = sorted((n for n in book.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        return [t for n in slides for t in _tables(ET.fromstring(book.read(n)), "tbl", "tr", "tc")]
