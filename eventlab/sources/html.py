"""Tables out of HTML pages, found by their column names.

Pages are parsed once, by the standard library's parser on Arrow batches: nested tables, cells
that span rows or columns, and headers of several rows are beyond regular expressions. The
parser only turns one page into rows of cells; all that follows is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_ticker

#: Cells that one span may cover, as browsers limit them.
MAX_SPAN = 1000


class _Tables(HTMLParser):
    """Collects the tables of a page in the order in which they begin.

    A cell is (text, is a header, rows, columns). Rows of an inner table do not count for the
    outer one, but its text is part of the outer cell.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.open: list[tuple[list, list]] = []  # rows of the table, and the cell that is open
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            rows: list[list[list]] = []
            self.tables.append(rows)
            self.open.append((rows, []))
        elif tag == "tr" and self.open:
            self.open[-1] = (self.open[-1][0], [])
            self.open[-1][0].append([])
        elif tag in ("td", "th") and self.open:
            rows = self.open[-1][0]
            if not rows:
                rows.append([])
            given = dict(attrs)
            cell = [[], tag == "th", _span(given.get("rowspan")), _span(given.get("colspan"))]
            rows[-1].append(cell)
            self.open[-1] = (rows, cell)
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.open[-1] = (self.open[-1][0], [])

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for _, cell in self.open:
                if cell:
                    cell[0].append(data)


def _span(written: str | None) -> int:
    return min(max(int(written), 1), MAX_SPAN) if written and written.strip().isdigit() else 1


def _grid(rows: list[list[list]]) -> tuple[list[str], list[list[str | None]]]:
    """Column names and data rows, with every span written out.

    The header is the rows at the top that hold only header cells, or the first row where there
    is none; names of several header rows are joined, each said once.
    """
    grid: list[list[str | None]] = []
    heads: list[bool] = []
    below: dict[int, list] = {}  # column: [text, rows left]
    for cells in rows:
        line: list[str | None] = []
        queue = list(cells)
        while queue or any(c >= len(line) for c in below):
            column = len(line)
            if column in below:
                text, left = below[column]
                line.append(text)
                if left > 1:
                    below[column] = [text, left - 1]
                else:
                    del below[column]
            elif queue:
                words, _, down, across = queue.pop(0)
                text = " ".join("".join(words).split())
                for i in range(across):
                    if column + i in below:
                        break
                    line.append(text)
                    if down > 1:
                        below[column + i] = [text, down - 1]
            else:
                line.append(None)
        grid.append(line)
        heads.append(bool(cells) and all(is_header for _, is_header, _, _ in cells))
    n = next((i for i, head in enumerate(heads) if not head), len(heads)) or min(1, len(grid))
    names = []
    for column in range(max((len(line) for line in grid[:n]), default=0)):
        parts = [line[column] for line in grid[:n] if column < len(line) and line[column]]
        names.append(" ".join(dict.fromkeys(parts)))
    return names, grid[n:]


def _find(html: str | None, needles: Sequence[str]) -> tuple[list[str], list[list[str | None]]] | None:
    """The first table whose column names mention all needles."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    for rows in parser.tables:
        names, lines = _grid(rows)
        if names and all(any(needle in name for name in names) for needle in needles):
            return names, lines
    return None


def with_table(pages: DataFrame, needles: Sequence[str]) -> DataFrame:
    """The pages with ``found``: the header and rows of their first table that mentions all ``needles``, or NULL."""
    needles = list(needles)

    @F.pandas_udf("header array<string>, lines array<array<string>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_find(html, needles) or (None, None) for html in batch]
            yield pd.DataFrame(found, columns=["header", "lines"])

    parsed = pages.withColumn("_parsed", parse("html"))
    return parsed.withColumn("found", F.when(F.col("_parsed.header").isNotNull(), F.col("_parsed"))).drop("_parsed")


def html_table_rows(pages: DataFrame, needles: Sequence[str], key: str = "url") -> DataFrame:
    """Rows of each page's first table whose header mentions all ``needles``.

    Gives ``(key, header, row_number, cells)``. Pages without such a table give none;
    `pages_without_table` lists them.
    """
    tables = with_table(pages.select(key, "html"), needles).where(F.col("found").isNotNull())
    rows = tables.select(key, F.col("found.header").alias("header"), F.posexplode("found.lines").alias("row_number", "cells"))
    return rows.withColumn("row_number", F.col("row_number") + 1)


def pages_without_table(pages: DataFrame, needles: Sequence[str], key: str = "url") -> DataFrame:
    """Pages that lack the table, which must not be read as if they had none of its rows."""
    return with_table(pages.select(key, "html"), needles).where(F.col("found").isNull()).select(key)


def require_table(pages: DataFrame, needles: Sequence[str], key: str = "url") -> DataFrame:
    """The table's rows, or an error if any page lacks it."""
    missing = pages_without_table(pages, needles, key).limit(3).collect()
    if missing:
        raise ValueError(f"no table with columns {list(needles)} in: {[r[key] for r in missing]}")
    return html_table_rows(pages, needles, key)


def quality_gate(pages: DataFrame, needles: Sequence[str], key: str = "url") -> DataFrame:
    """How many pages may be accepted. Every page counts by itself, also if urls repeat."""
    good = F.col("found").isNotNull()
    return with_table(pages.select(key, "html"), needles).agg(
        F.count("*").alias("pages"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected")
    )


def _cell(name: str) -> Column:
    """The cell below the header with this exact name."""
    place = F.array_position("header", F.lit(name))
    return F.when(place > 0, F.get("cells", (place - 1).cast("int")))


def current_constituents(pages: DataFrame, key: str = "url") -> DataFrame:
    """Tickers with sector, industry and name from the constituents table."""
    rows = html_table_rows(pages, ["Symbol"], key)
    return rows.select(
        key,
        clean_ticker(_cell("Symbol")).alias("symbol"),
        _cell("GICS Sector").alias("sector"),
        _cell("GICS Sub-Industry").alias("industry"),
        _cell("Security").alias("name"),
    ).where(F.col("symbol").isNotNull())


def _named(*names: str) -> Column:
    """The cell below the first header that any of the names equals."""
    return F.coalesce(*[_cell(n) for n in names])


def changes_with_errors(pages: DataFrame, key: str = "url") -> DataFrame:
    """Dated additions and removals with the row as it was written, and whether its date was read.

    Columns go by name, in one header row ("Added Ticker") or in two ("Added" above "Ticker");
    ``seq`` is the row's place, newest first on such pages.
    """
    rows = html_table_rows(pages, ["Ticker", "Date"], key)
    written = _named("Date", "Effective Date", "Date Effective")
    day = F.coalesce(F.try_to_date(written, "MMMM d, yyyy"), F.try_to_date(written, "yyyy-MM-dd"))
    return rows.select(
        key,
        F.col("row_number").cast("bigint").alias("seq"),
        day.alias("date"),
        clean_ticker(_named("Added Ticker", "Ticker Added")).alias("added_ticker"),
        clean_ticker(_named("Removed Ticker", "Ticker Removed")).alias("removed_ticker"),
        "cells",
        day.isNull().alias("unreadable"),
    )


def membership_changes(pages: DataFrame, key: str = "url") -> DataFrame:
    """The rows of `changes_with_errors` whose date can be read."""
    return changes_with_errors(pages, key).where("NOT unreadable").drop("cells", "unreadable")
