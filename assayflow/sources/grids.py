"""HTML tables as grids (O-S9)."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column

from ..functions.text import python


class _Grid(HTMLParser):
    """Rows of the first table's cells; a spanning cell repeats its text."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict[int, str | None]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)
        self.done = False
        self.line = self.next_line = self.at = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.done:
            return
        if tag == "tr":
            self.at, self.line = 0, self.next_line
            while len(self.rows) <= self.line:
                self.rows.append({})
            self.next_line += 1
        elif tag in ("td", "th") and self.next_line:
            self.cell = []
            a = dict(attrs)
            self.span = tuple(int(a.get(k) or 1) if str(a.get(k) or 1).isdigit() else 1 for k in ("rowspan", "colspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).split()) or None
            while self.at in self.rows[self.line]:
                self.at += 1
            for dy in range(max(1, self.span[0])):
                while len(self.rows) <= self.line + dy:
                    self.rows.append({})
                for dx in range(max(1, self.span[1])):
                    self.rows[self.line + dy].setdefault(self.at + dx, text)
            self.cell = None
        elif tag == "table" and self.next_line:
            self.done = True

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def read_grid(html: str | None) -> list[list[str | None]]:
    """Cells of the first table, rows padded to one width; the html may lack the table tag."""
    if not html:
        return []
    grid = _Grid()
    grid.feed(html)
    rows = grid.rows[: max(grid.next_line, 0)]
    width = max((max(r) + 1 for r in rows if r), default=0)
    return [[r.get(i) for i in range(width)] for r in rows]


def _ok(html: str | None) -> bool:
    rows = read_grid(html)[1:]
    cells = [c for r in rows for c in r]
    return bool(cells) and sum(c is None for c in cells) <= 0.5 * len(cells)


def _markdown(html: str | None) -> str | None:
    if html is None:
        return None
    rows = read_grid(html)
    if not rows or not rows[0]:
        return f"[unparsed] {html[:1000]}"
    lines = ["| " + " | ".join(c or "" for c in r) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]])


def grid_rows(html: Column) -> Column:
    return python(read_grid, "array<array<string>>", html)


def grid_ok(html: Column) -> Column:
    """Whether a grid with data can be read, at most half of it empty."""
    return python(_ok, "boolean", html)


def grid_markdown(html: Column) -> Column:
    return python(_markdown, "string", html)
