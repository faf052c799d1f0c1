"""Tables in captured HTML files as rows of cells: a table function, joined laterally, reads each page once and gives one row per
table row, with cells that span rows and columns repeated wherever they reach and nested tables as tables of their own."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Limits of the HTML standard for spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
ROW = "table_no int, parent string, row int, cells array<string>, spanned array<boolean>, links array<string>, header boolean"


def is_number(col: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(col), F.lit(r"^\d+\.?$")), F.lit(False))


class _Table:
    """An open table: its rows so far, each of cells (text parts, rows and columns that they span), and where groups begin."""

    def __init__(self, number: int, parent: str | None):
        self.number, self.parent = number, parent
        self.rows: list[list] = []
        self.links: list[list[str]] = []
        self.headers: list[bool] = []
        self.groups: set[int] = set()
        self.cell: list | None = None

    def begin_row(self) -> None:
        self.cell = None
        self.rows.append([])
        self.links.append([])
        self.headers.append(False)

    def grid(self) -> Iterator[tuple]:
        """Rows with the spans laid out: a cell that spans none (0) goes on to the end of its group of rows."""
        reaching: dict[int, list] = {}  # by column: cell text and rows still to come
        for r, row in enumerate(self.rows):
            if r in self.groups:
                reaching.clear()
            laid = {c: (text, True) for c, (text, _) in reaching.items()}
            reaching = {c: [text, left - 1] for c, (text, left) in reaching.items() if left > 1}
            at = 0
            for parts, down, across in row:
                while at in laid:
                    at += 1
                text = " ".join("".join(parts).split())
                for c in range(at, at + across):
                    if c not in laid:
                        laid[c] = (text, c > at)
                        if down != 1:
                            reaching[c] = [text, (down or MOST_ROWS) - 1]
                at += across
            width = max(laid, default=-1) + 1
            cells = [laid.get(c, ("", False)) for c in range(width)]
            yield self.number, self.parent, r, [t for t, _ in cells], [s for _, s in cells], self.links[r], self.headers[r]


class _Reader(HTMLParser):
    """Events of one page to tables; those that are closed wait in ``done``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.done: list[_Table] = []
        self.count = 0
        self.silent = 0

    @staticmethod
    def _span(value: str | None, most: int, none: int) -> int:
        digits = (value or "").strip()
        n = int(digits) if digits.isascii() and digits.isdigit() else 1
        return none if n == 0 else min(n, most)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        table = self.open[-1] if self.open else None
        if tag == "table":
            parent = f"{table.number}:{len(table.rows) - 1}" if table and table.cell else None
            self.open.append(_Table(self.count, parent))
            self.count += 1
        elif table is None:
            return
        elif tag == "tr":
            table.begin_row()
        elif tag in ("thead", "tbody", "tfoot"):
            table.cell = None
            table.groups.add(len(table.rows))
        elif tag in ("td", "th"):
            if not table.rows:
                table.begin_row()
            told = dict(attrs)
            table.cell = [[], self._span(told.get("rowspan"), MOST_ROWS, 0), self._span(told.get("colspan"), MOST_COLUMNS, 1)]
            table.rows[-1].append(table.cell)
            table.headers[-1] |= tag == "th"
        else:
            self.silent += tag in ("script", "style")
            if tag == "a" and table.rows:
                table.links[-1] += [v for k, v in attrs if k == "href" and v]
            if table.cell:
                table.cell[0].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag == "table":
            self.done.append(self.open.pop())
        elif tag in ("td", "th", "tr"):
            self.open[-1].cell = None
        else:
            self.silent = max(0, self.silent - (tag in ("script", "style")))
            if self.open[-1].cell:
                self.open[-1].cell[0].append(" ")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell and not self.silent:
            self.open[-1].cell[0].append(data)


class TableRows:
    """Rows of all tables of one page: table (in the order in which they open), the table and row that hold it, row, cells,
    whether each cell is repeated from its first place, links of the row, and whether it has header cells."""

    def eval(self, html: str) -> Iterator[tuple]:
        reader = _Reader()
        for at in range(0, len(html or ""), 1 << 16):
            reader.feed(html[at : at + (1 << 16)])
            for table in reader.done:
                yield from table.grid()
            reader.done.clear()
        reader.close()
        for table in reader.done + reader.open[::-1]:  # a page may end inside a table
            yield from table.grid()


def expand_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` beside the rows of their tables (``table_no``, ``parent``, ``row``, ``cells``, ``spanned``, ``links``,
    ``header``). Pages without tables, null ones too, give no row; cells of a nested table are not text of the cell that
    holds it."""
    ship(pages.sparkSession)
    return pages.lateralJoin(F.udtf(TableRows, returnType=ROW)(F.col(html).outer()))


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tables in all files under a path. ``file`` and ``row``, the place of the row in its file, order them."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return expand_tables(files, "value").select("file", F.struct("table_no", "row").alias("row"), "cells", "spanned", "links", "header")
