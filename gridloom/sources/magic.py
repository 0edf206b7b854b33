"""File types by content, as column expressions over a prefix of the bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signatures as (type, offset from 1, bytes in hex).
SIGNATURES = (
    ("ole", 1, "D0CF11E0A1B11AE1"),
    ("zip", 1, "504B0304"),
    ("pdf", 1, "25504446"),
    ("sas7bdat", 1, "000000000000000000000000C2EA8160"),
    ("xpt", 1, "484541444552205245434F52442A2A2A2A2A2A2A"),
    ("sav", 1, "24464C32"),
    ("zsav", 1, "24464C33"),
    ("por", 1, "41534349492053505353"),
    ("dta", 1, "3C73746174615F6474613E"),
    ("rar", 1, "526172211A07"),
    ("gz", 1, "1F8B"),
    ("xz", 1, "FD377A585A00"),
    ("bz2", 1, "425A68"),
    ("7z", 1, "377ABCAF271C"),
    ("tar", 258, "7573746172"),
    ("xml", 1, "3C3F786D6C"),
    ("xml", 4, "3C3F786D6C"),
)

#: Bytes at 513 of an OLE file by application.
OLE = (("doc", "ECA5C100"), ("xls", "0908100000060500"), *[("xls", f"FDFFFFFF{x}") for x in ("10", "1F", "22", "23", "28", "29")], ("ppt", "FDFFFFFF"), ("ppt", "A0461DF0"), ("ppt", "006E1EF0"), ("ppt", "0F00E803"))

#: Folders of an OOXML package by application.
PACKAGES = (("docx", "word/"), ("pptx", "ppt/"), ("xlsx", "xl/"))


def file_type(content: Column) -> Column:
    """ole and zip families are refined; what has no signature is txt unless a NUL stands in its first 512 bytes, which a byte
    order mark excuses; else unknown."""
    out = F.lit(None).cast("string")
    for name, at, raw in reversed(SIGNATURES):
        found = F.hex(F.substring(content, at, len(raw) // 2)) == raw
        kind: Column | str = name
        if name == "ole":
            kind = F.lit("ole")
            for app, mark in reversed(OLE):
                kind = F.when(F.hex(F.substring(content, 513, len(mark) // 2)) == mark, app).otherwise(kind)
        elif name == "zip":
            head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
            package = F.contains(head, F.lit("[Content_Types].xml")) | F.contains(head, F.lit("_rels/.rels"))
            kind = F.lit("zip")
            for app, folder in reversed(PACKAGES):
                kind = F.when(package & F.contains(head, F.lit(folder)), app).otherwise(kind)
        out = F.when(found, kind).otherwise(out)
    mark = F.hex(F.substring(content, 1, 3)).isin("EFBBBF") | F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    text = mark | ~F.contains(F.hex(F.substring(content, 1, 512)), F.lit("00")) | (F.instr(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), "\0") == 0)
    return F.coalesce(out, F.when(text, "txt").otherwise("unknown"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
