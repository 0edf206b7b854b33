"""The formats, their readers, and which readers are at hand."""

from __future__ import annotations

import importlib.util
import io
import shutil
from collections.abc import Callable

from . import html, ooxml

Cell = tuple[int, int, str, str]
Sheets = list[tuple[str, list[Cell]]]

#: Formats as (type, kind, compressed, archived). Formats without a reader here can be given one by register().
FORMATS = tuple(
    (name, kind, kind == "archive" or name in ("gz", "bz2", "xz"), kind == "archive")
    for kind, names in (
        ("text", "csv tsv txt html xml"),
        ("spreadsheet", "xlsx xls"),
        ("document", "docx doc pptx ppt pdf"),
        ("statistics", "sas7bdat xpt sav zsav por dta"),
        ("archive", "zip tar rar 7z"),
        ("compressed", "gz bz2 xz"),
    )
    for name in names.split()
)


def _matrix(rows: list[list[str]]) -> list[Cell]:
    return [(r, c, "character", v) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v != ""]


def _numbered(found: list[list[list[str]]]) -> Sheets:
    return [(f"table_{k}", _matrix(t)) for k, t in enumerate(found, 1)]


def _frame(read: Callable[[io.BytesIO], object]) -> Callable[[bytes], Sheets]:
    def run(raw: bytes) -> Sheets:
        df = read(io.BytesIO(raw))
        head = [(1, c, "character", str(n)) for c, n in enumerate(df.columns, 1)]
        body = []
        for r, row in enumerate(df.itertuples(index=False), 2):
            for c, v in enumerate(row, 1):
                if v is not None and v == v:
                    number = isinstance(v, int | float) and not isinstance(v, bool)
                    body.append((r, c, "numeric" if number else "character", f"{v:.10f}".rstrip("0").rstrip(".") if number else (v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v))))
        return [("table_1", head + body)]

    return run


def _pandas(name: str, **options: object) -> Callable[[io.BytesIO], object]:
    def read(f: io.BytesIO) -> object:
        import pandas as pd

        return getattr(pd, name)(f, **options)

    return read


def _html(raw: bytes) -> Sheets:
    return _numbered(html.tables(raw.decode("utf-8", "replace")))


READERS: dict[str, list[tuple[str, Callable[[bytes], Sheets]]]] = {
    "xml": [("html", _html)],
    "xlsx": [("xlsx", ooxml.xlsx)],
    "docx": [("docx", lambda raw: _numbered(ooxml.docx(raw)))],
    "pptx": [("pptx", lambda raw: _numbered(ooxml.pptx(raw)))],
    "sas7bdat": [("sas", _frame(_pandas("read_sas", format="sas7bdat")))],
    "xpt": [("sas", _frame(_pandas("read_sas", format="xport")))],
    "dta": [("stata", _frame(_pandas("read_stata")))],
}


def register(kind: str, name: str, reader: Callable[[bytes], Sheets], first: bool = False) -> None:
    """Adds a reader, such as one for xls, doc, pdf or ppt, which need programs that are not part of this package."""
    own = READERS.setdefault(kind, [])
    own.insert(0, (name, reader)) if first else own.append((name, reader))


def readers(kind: str, omit: tuple[str, ...] = ()) -> list[tuple[str, Callable[[bytes], Sheets]]]:
    return [(n, f) for n, f in READERS.get(kind, []) if n not in omit and kind not in omit]


def is_available(module: str, pretend_missing: tuple[str, ...] = ()) -> bool:
    return module not in pretend_missing and importlib.util.find_spec(module) is not None


def office_converter() -> str | None:
    """The path of an office program that converts old formats, if there is one."""
    return shutil.which("soffice") or shutil.which("libreoffice")


def supported_formats() -> list[tuple[str, str, bool, bool, str]]:
    """(type, kind, compressed, archived, reader): reader is empty where one has to be registered."""
    from .archive import DECOMPRESSORS

    own = {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "html": "html"} | {k: v[0][0] for k, v in READERS.items() if v} | {k: "archive" for k in DECOMPRESSORS}
    return [(*f, own.get(f[0], "")) for f in FORMATS]
