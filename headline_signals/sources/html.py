"""HTML extraction (S1, S2): tables and lists from an HTML column, as a Spark job.

Each page is parsed once by the standard library's ``html.parser`` inside
``mapInPandas`` (Arrow batches, one parser per page, no per-row UDF calls). The output
is long: one row per table row (``<tr>``) or list item (``<li>``), with the cell texts
as an array, so that picking tables, checking shapes and reshaping are ordinary
DataFrame filters and projections afterwards.

Tables are numbered from 0 in document order, nested ones included, like the usual
HTML table readers; lists (``<ul>``/``<ol>``) are numbered separately.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.partitioning import spread

# The parser runs in Python workers: ship this module's code with the task (pickled by
# value) so that workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW_SCHEMA = "page_id long, kind string, table_idx int, row_idx int, cells array<string>"
HEADING_SCHEMA = "page_id long, title string, h1 string"

_WS = re.compile(r"[ \t\n\r\f\v]+")


def _clean(text: str) -> str:
    return _WS.sub(" ", text).strip(" ")


class _Table:
    """An open table: its row and cell so far, and the cells that reach down into its next rows."""

    def __init__(self, index: int):
        self.index, self.n_rows = index, 0
        self.row: list[tuple[str, int, int]] | None = None
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.reaching: dict[int, tuple[int, str]] = {}  # column -> (rows left, text)

    def close_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row.append((_clean("".join(self.cell)), *self.spans))
        self.cell = None

    def close_row(self) -> list[str] | None:
        """The finished row's cells, one per column it covers; null if no row was open."""
        self.close_cell()
        if self.row is None:
            return None
        cells: list[str] = []
        below: dict[int, tuple[int, str]] = {}

        def from_above() -> None:
            while len(cells) in self.reaching:
                left, text = self.reaching.pop(len(cells))
                if left > 1:
                    below[len(cells)] = (left - 1, text)
                cells.append(text)

        for text, across, down in self.row:
            from_above()
            for _ in range(across):
                if down > 1:
                    below[len(cells)] = (down - 1, text)
                cells.append(text)
        from_above()
        self.reaching = self.reaching | below
        self.row = None
        self.n_rows += 1
        return cells


#: HTML lets a cell cover at most so many columns; rows below are counted, so they need no bound.
MOST_COLUMNS = 1000


def _span(attrs, name: str, most: int | None = None) -> int:
    """A span of at least 1; what is no plain decimal number is 1."""
    value = (dict(attrs).get(name) or "").strip()
    if not (value.isascii() and value.isdecimal()):
        return 1
    span = max(1, int(value[-4000:] if len(value) > 4000 else value))
    return span if most is None else min(most, span)


class _RowCollector(HTMLParser):
    """Collects rows of tables (``tr`` -> ``td``/``th`` cells) and of lists (``li``).

    Every open table keeps its own row and cell, and every open list its own item, so that
    an inner one leaves the outer one as it was. Text counts for the innermost only.
    ``colspan`` and ``rowspan`` repeat a cell's text in every column and row it covers.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, int, int, list[str]]] = []
        self.tables: list[_Table] = []
        self.lists: list[list] = []   # stack of [list_idx, next_row_idx, open item or None]
        self.open: list[str] = []     # kinds of the open tables and lists, outermost first
        self.n_tables = self.n_lists = 0
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.tables.append(_Table(self.n_tables))
            self.open.append("table")
            self.n_tables += 1
        elif tag == "tr" and self.tables:
            self._close_row()
            self.tables[-1].row = []
        elif tag in ("td", "th") and self.tables and self.tables[-1].row is not None:
            self.tables[-1].close_cell()
            self.tables[-1].cell = []
            self.tables[-1].spans = (_span(attrs, "colspan", MOST_COLUMNS), _span(attrs, "rowspan"))
        elif tag in ("ul", "ol"):
            self.lists.append([self.n_lists, 0, None])
            self.open.append("list")
            self.n_lists += 1
        elif tag == "li" and self.lists:
            self._close_item()
            self.lists[-1][2] = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.tables:
            self.tables[-1].close_cell()
        elif tag == "tr" and self.tables:
            self._close_row()
        elif tag == "table" and self.tables:
            self._close("table")
        elif tag == "li" and self.lists:
            self._close_item()
        elif tag in ("ul", "ol") and self.lists:
            self._close("list")

    def handle_data(self, data):
        if self.skip or not self.open:
            return
        buf = self.tables[-1].cell if self.open[-1] == "table" else self.lists[-1][2]
        if buf is not None:
            buf.append(data)

    def _close(self, kind):
        """Closes the innermost open table or list, and what is open inside it."""
        while self.open:
            closed = self.open.pop()
            if closed == "table":
                self._close_row()
                self.tables.pop()
            else:
                self._close_item()
                self.lists.pop()
            if closed == kind:
                return

    def _close_row(self):
        table = self.tables[-1]
        cells = table.close_row()
        if cells is not None:
            self.rows.append(("table", table.index, table.n_rows - 1, cells))

    def _close_item(self):
        lst = self.lists[-1]
        if lst[2] is not None:
            self.rows.append(("list", lst[0], lst[1], [_clean("".join(lst[2]))]))
            lst[1] += 1
            lst[2] = None

    def close(self):
        super().close()
        while self.open:
            self._close(self.open[-1])


class _HeadingCollector(HTMLParser):
    """First ``<title>`` and first ``<h1>`` text of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.open: str | None = None
        self.buf: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "h1") and tag not in self.found and self.open is None:
            self.open, self.buf = tag, []

    def handle_endtag(self, tag):
        if tag == self.open:
            self.found[tag] = _clean("".join(self.buf))
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.buf.append(data)


def _rows_of(batches, id_col, html_col):
    import pandas as pd
    for pdf in batches:
        out = {"page_id": [], "kind": [], "table_idx": [], "row_idx": [], "cells": []}
        for pid, html in zip(pdf[id_col], pdf[html_col]):
            if html is None:
                continue
            p = _RowCollector()
            p.feed(html)
            p.close()
            for kind, t, r, cells in p.rows:
                out["page_id"].append(pid)
                out["kind"].append(kind)
                out["table_idx"].append(t)
                out["row_idx"].append(r)
                out["cells"].append(cells)
        if out["page_id"]:  # an empty frame cannot carry the array column type
            yield pd.DataFrame(out)


def _headings_of(batches, id_col, html_col):
    import pandas as pd
    for pdf in batches:
        titles, h1s = [], []
        for html in pdf[html_col]:
            p = _HeadingCollector()
            if html is not None:
                p.feed(html)
                p.close()
            titles.append(p.found.get("title"))
            h1s.append(p.found.get("h1"))
        yield pd.DataFrame({"page_id": pdf[id_col], "title": titles, "h1": h1s})


def html_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
              kind: str | None = "table") -> DataFrame:
    """One row per table row or list item: ``(page_id, kind, table_idx, row_idx, cells)``.

    ``kind`` keeps ``"table"`` rows, ``"list"`` rows, or both (``None``).
    """
    src = spread(pages.select(F.col(id_col).cast("long"), html_col))
    rows = src.mapInPandas(lambda it: _rows_of(it, id_col, html_col), ROW_SCHEMA)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S1 for ``<table>`` markup: ``(page_id, table_idx, row_idx, cells)``."""
    return html_rows(pages, id_col, html_col, "table").drop("kind")


def page_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Title and first ``<h1>`` of each page, entities decoded, whitespace collapsed."""
    src = spread(pages.select(F.col(id_col).cast("long"), html_col))
    return src.mapInPandas(lambda it: _headings_of(it, id_col, html_col), HEADING_SCHEMA)
