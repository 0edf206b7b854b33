"""Tables of HTML and XML pages as cells."""

from __future__ import annotations

from html.parser import HTMLParser

Table = list[list[str]]


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Table] = []
        self.open: list[tuple[Table, dict[tuple[int, int], str]]] = []
        self.cell: list[list[str]] = []
        self.span: list[tuple[int, int]] = []
        self.mute = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            self.open.append(([], {}))
        elif self.open and tag == "tr":
            self._end_cell()
            self.open[-1][0].append([])
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            if not self.open[-1][0]:
                self.open[-1][0].append([])
            at = dict(attrs)
            self.span.append((_number(at.get("rowspan")), _number(at.get("colspan"))))
            self.cell.append([])
        elif tag == "br" and self.cell:
            self.cell[-1].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.found.append(self.open.pop()[0])

    def handle_data(self, data: str) -> None:
        if self.cell and not self.mute:
            self.cell[-1].append(data)

    def _end_cell(self) -> None:
        if len(self.cell) < len(self.open) or not self.cell or not self.open:
            return
        text = " ".join("".join(self.cell.pop()).split())
        rows, held = self.open[-1]
        height, wide = self.span.pop()
        row = rows[-1]
        r = len(rows) - 1
        while (r, len(row)) in held:
            row.append(held.pop((r, len(row))))
        at = len(row)
        row.append(text)
        row += [""] * (wide - 1)
        held.update({(r + i, at + j): "" for i in range(1, height) for j in range(wide)})

    def close(self) -> None:
        super().close()
        while self.open:
            self._end_cell()
            self.found.append(self.open.pop()[0])


def _number(x: str | None) -> int:
    return max(1, int(x)) if x and x.isdigit() else 1


def tables(page: str) -> list[Table]:
    """The tables of a page in the order in which they end; spanned places are empty."""
    reader = _Tables()
    reader.feed(page)
    reader.close()
    return [t for t in reader.found if any(any(row) for row in t)]
