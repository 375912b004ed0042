"""Tables of HTML pages as cell grids: one pass with a stack of open tables.

A nested table is a table of its own and leaves its text out of the cell
around it.  Cells that span columns or rows fill every place they cover, as in
a data frame of the table; short rows are filled up with empty cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

# Greatest column and row span of HTML.
MOST_COLSPAN = 1000
MOST_ROWSPAN = 65534
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9-]*")
_SPAN = re.compile(r"""(?i)(?<![\w-])(col|row)span\s*=\s*["']?\s*(\d{1,9})""")


class _Table:
    """An open table: finished rows as (row group, in a thead, cells), a cell as (text, columns, rows, is header)."""

    def __init__(self, number: int):
        self.number, self.caption, self.rows = number, "", []
        self.group, self.head = 0, False
        self.row = self.cell = self.into = None

    def text(self, s: str) -> None:
        if self.into is not None:
            self.into.append(s)

    def end_cell(self) -> None:
        if self.cell is not None:
            text, columns, rows, header = self.cell
            self.row.append(("".join(text), columns, rows, header))
            self.cell = self.into = None

    def end_caption(self) -> None:
        if self.cell is None and self.into is not None:
            self.caption, self.into = self.caption or "".join(self.into), None

    def end_row(self) -> None:
        self.end_caption()
        self.end_cell()
        if self.row is not None:
            self.rows.append((self.group, self.head, self.row))
            self.row = None

    def tag(self, name: str, attributes: str) -> None:
        if name in ("td", "th"):
            self.end_caption()
            self.end_cell()
            if self.row is None:
                self.row = []
            span = {k.lower(): int(n) for k, n in reversed(_SPAN.findall(attributes))}  # the first of a name counts
            self.cell = ([], min(max(span.get("col", 1), 1), MOST_COLSPAN), min(span.get("row", 1), MOST_ROWSPAN), name == "th")
            self.into = self.cell[0]
        elif name in ("/td", "/th"):
            self.end_cell()
        elif name in ("tr", "/tr"):
            self.end_row()
            if name == "tr":
                self.row = []
        elif name in ("thead", "tbody", "tfoot", "/thead", "/tbody", "/tfoot"):
            self.end_row()
            self.group, self.head = self.group + 1, name == "thead"
        elif name == "caption":
            self.end_row()
            self.into = []
        elif name == "/caption":
            self.end_caption()
        else:
            self.text(" ")

    def end(self) -> tuple[int, str, list[list[str]], int]:
        """(number, caption, grid, header rows at the top)."""
        self.end_row()
        return self.number, self.caption, _grid(self.rows), _headers(self.rows)


def _headers(rows: list) -> int:
    n = 0
    for _, head, cells in rows:
        if not (head or cells and all(c[3] for c in cells)):
            break
        n += 1
    return n


def _grid(rows: list) -> list[list[str]]:
    """Rows of equal length; a row span ends with its row group (0: reaches to it)."""
    out, above, last = [], {}, None
    for group, _, cells in rows:
        above = above if group == last else {}  # column -> (text, rows left; -1: all)
        last = group
        line = {c: text for c, (text, _) in above.items()}
        above = {c: (text, left - 1 if left > 0 else left) for c, (text, left) in above.items() if left != 1}
        at = 0
        for text, columns, span, _ in cells:
            while at in line:
                at += 1
            for c in range(at, at + columns):
                if c in line:  # a column span stops at a cell from above
                    break
                line[c] = text
                if span != 1:
                    above[c] = (text, span - 1)
                at = c + 1
        out.append(line)
    width = max((max(line, default=-1) + 1 for line in out), default=0)
    return [[line.get(c, "") for c in range(width)] for line in out]


def tables_of(html: str) -> list[tuple[int, str, list[list[str]], int]]:
    """Tables in the order they begin, also those never closed: (number, caption, grid, header rows)."""
    open_, done, number, i = [], [], 0, 0
    while True:
        lo = html.find("<", i)
        hi = html.find(">", lo) if lo >= 0 else -1
        if open_:
            open_[-1].text(html[i:lo] if hi >= 0 else html[i:])
        if hi < 0:
            break
        found = _NAME.match(html, lo + 1, hi)
        name = found.group().lower() if found else ""
        if name == "table":
            if open_:
                open_[-1].text(" ")
            open_.append(_Table(number))
            number += 1
        elif name == "/table":
            if open_:
                done.append(open_.pop().end())
        elif open_:
            open_[-1].tag(name, html[found.end() if found else hi:hi])
        i = hi + 1
    return sorted(done + [t.end() for t in open_], key=lambda t: t[0])


def read_tables(id_col: str, html_col: str):
    """Batches of (id, html) to batches of (id, table_no, caption, grid, n_header), one page after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, html in enumerate(b.column(html_col)):
                tables = tables_of(html.as_py())
                if tables:
                    number, caption, grid, header = zip(*tables, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(id_col).take(pa.array([i] * len(tables))), pa.array(number, pa.int32()),
                         pa.array(caption, pa.string()), pa.array(grid, pa.list_(pa.list_(pa.string()))),
                         pa.array(header, pa.int32())], names=[id_col, "table_no", "caption", "grid", "n_header"])
    return run
