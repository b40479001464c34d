"""Tables from the boxes of words: rows by height, columns by the gutters between them, records by a header.

A page's words are gathered in one row, so a page is the most that a task holds of one key.  Many pages are then swept at once as
arrays of edges (:func:`grids`): sorted within their page, with the furthest edge so far as a running maximum.

1. Words whose tops are no more than ``tolerance`` below the one before are a row.
2. In a row, words no more than ``space`` apart are a cell's text.
3. The number of cells that most rows have (the larger of equals) says which rows show the columns: a sweep over their
   x-intervals, from left to right, ends a column where nothing reaches on for more than ``space``.  Cells of other rows that meet no column make columns
   of their own; a cell that meets several, a title over them say, belongs to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AREA = ("doc_id", "page_id", "table_id")


#: Pages that are swept at once.
PAGES = 2_000


def _opens(group: np.ndarray, left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Whether intervals, sorted by group and left edge, begin more than ``gap`` after all before them in their group."""
    if not len(group):
        return np.zeros(0, bool)
    low = right.min()
    lift = group * (right.max() - low + 1) - low
    reach = np.maximum.accumulate(right + lift) - lift
    return np.r_[True, (group[1:] != group[:-1]) | (left[1:] - reach[:-1] > gap)]


def _swept(page: np.ndarray, left: np.ndarray, right: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, left, right) of a page's intervals, joined from left to right where no more than ``gap`` is between one and all before it."""
    order = np.lexsort((right, left, page))
    page, left, right = page[order], left[order], right[order]
    at = np.flatnonzero(_opens(page, left, right, gap))
    return page[at], left[at], np.maximum.reduceat(right, at) if len(at) else right


def _first_met(columns: tuple[np.ndarray, np.ndarray, np.ndarray], page: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first column of its page that each interval meets, or -1.  Columns lie apart, so it is the first that doesn't end before it."""
    of, begins, ends = columns
    low = min(left.min(), ends.min())
    wide = max(left.max(), ends.max()) - low + 1
    at = np.searchsorted(of * wide + ends - low, page * wide + left - low)
    near = np.minimum(at, len(of) - 1)
    return np.where((at < len(of)) & (of[near] == page) & (begins[near] <= right), at, -1)


def _lines(words: pa.ListArray, tolerance: int, space: int) -> tuple[pa.Array, pa.Array]:
    """Of pages with words (top, left, right, text): their numbers of columns, and their lines of cells, null where there is none."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    flat = words.flatten()
    top, left, right = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    right, page = np.maximum(left, right), np.repeat(np.arange(len(sizes)), sizes)
    down = np.lexsort((top, page))
    page, top, left, right = page[down], top[down], left[down], right[down]
    row = np.cumsum(np.r_[True, (page[1:] != page[:-1]) | (np.diff(top) > tolerance)]) - 1
    along = np.lexsort((right, left, row))
    if ((np.diff(row[along]) == 0) & (np.diff(left[along]) == 0) & (np.diff(right[along]) == 0)).any():
        said = pc.rank(flat.field(3).cast(pa.binary()), tiebreaker="dense").to_numpy()[down]
        along = np.lexsort((said, right, left, row))
    page, left, right, row = page[along], left[along], right[along], row[along]
    text = flat.field(3).take(pa.array(down[along]))
    parts = np.flatnonzero(_opens(row, left, right, space))
    page, row, left, right = page[parts], row[parts], left[parts], np.maximum.reduceat(right, parts)
    widths, begins = np.bincount(row), np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    kinds, rows = np.unique(page[begins] * (widths.max() + 1) + widths, return_counts=True)
    kinds = kinds[np.lexsort((kinds, rows, kinds // (widths.max() + 1)))]
    usual = kinds[np.r_[np.diff(kinds // (widths.max() + 1)) > 0, True]] % (widths.max() + 1)
    shows = widths[row] == usual[page]
    shows |= _first_met(_swept(page[shows], left[shows], right[shows], space), page, left, right) < 0
    columns = _swept(page[shows], left[shows], right[shows], space)
    many = np.bincount(columns[0], minlength=len(sizes))
    column = _first_met(columns, page, left, right) - (np.cumsum(many) - many)[page]
    cells = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1])])
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[parts[cells], len(text)], pa.int32()), text), " ")
    ends = np.r_[0, np.cumsum(many[page[begins]])]
    place = np.full(ends[-1], -1)
    place[ends[row[cells]] + column[cells]] = np.arange(len(cells))
    lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), said.take(pa.array(place, mask=place < 0)))
    return pa.array(many, pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(page[begins], minlength=len(sizes)))], pa.int32()), lines)


def grids(words: DataFrame, *, by: tuple[str, ...] = AREA, text: str = "text", box: str = "box", tolerance: int = 15, space: int = 8) -> DataFrame:
    """(by, n_columns, lines) of words with a box (x0, y0, x1, y1): a page's lines as arrays of cells, null where there is none.

    Words without text or box are left out; a box that ends before it begins has no width.  Cells that two parts of a row share have
    them in order, parted by a blank.
    """
    keys, edge = list(by), lambda i: F.get(F.col(box), F.lit(i))
    placed = words.select(*keys, F.col(text).alias("text"), edge(0).alias("left"), edge(1).alias("top"), edge(2).alias("right")).where("text is not null and left is not null and top is not null and right is not null")
    pages = placed.groupBy(*keys).agg(F.collect_list(F.struct("top", "left", "right", "text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES):
                some = batch.slice(a, PAGES)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *_lines(some.column(some.num_columns - 1), tolerance, space)], [*keys, "n_columns", "lines"])

    kinds = ", ".join(f"`{k}` {words.schema[k].dataType.simpleString()}" for k in keys)
    return pages.mapInArrow(run, f"{kinds}, n_columns int, lines array<array<string>>")


def cells(words: DataFrame, *, by: tuple[str, ...] = AREA, text: str = "text", box: str = "box", tolerance: int = 15, space: int = 8) -> DataFrame:
    """(by, n_columns, row, column, text) of the cells of :func:`grids`, both numbers from 0."""
    found = grids(words, by=by, text=text, box=box, tolerance=tolerance, space=space)
    rows = found.select(*by, "n_columns", F.posexplode("lines").alias("row", "line"))
    return rows.select(*by, "n_columns", "row", F.posexplode("line").alias("column", "text")).where("text is not null")


def tables(cells_: DataFrame, *, by: tuple[str, ...] = AREA, document: tuple[str, ...] = ("doc_id",), compat: bool = True) -> DataFrame:
    """(by, header, lines, records): a table's header, its other rows, and these as maps from the header's names.

    The header is the first row.  If a name in it is empty, that of the document's last table with a whole header takes its place,
    as a table that goes on over pages has it once.  A header of another width, one with a name twice, or none at all
    gives null records with compat, as it leaves the table as text there; strict uses the columns' numbers as names.
    """
    keys = list(by)
    rows = cells_.groupBy(*keys, "n_columns", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda c: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, _: k == c)), F.lit(0)), F.lit("")))
    rows = rows.select(*keys, "n_columns", "row", filled.alias("cells"))
    whole = rows.groupBy(*keys, "n_columns").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("all"))
    return named_tables(whole.select(*keys, "n_columns", F.transform("all", lambda x: x["cells"]).alias("lines")), by=by, document=document, compat=compat)


def named_tables(grids_: DataFrame, *, by: tuple[str, ...] = AREA, document: tuple[str, ...] = ("doc_id",), compat: bool = True) -> DataFrame:
    """What :func:`tables` gives, from lines of cells as :func:`grids` has them; where there is no cell, its text is empty."""
    keys = list(by)
    whole = grids_.withColumn("lines", F.transform("lines", lambda line: F.transform(line, lambda x: F.coalesce(x, F.lit("")))))
    own = F.get("lines", F.lit(0))
    named = whole.withColumn("own", F.when(~F.exists(own, lambda x: F.trim(x) == ""), own))
    order = Window.partitionBy(*document).orderBy(*(k for k in keys if k not in document)).rowsBetween(Window.unboundedPreceding, 0)
    # a header is carried on only if it could name its own table
    usable = F.when(F.size(F.array_distinct("own")) == F.col("n_columns"), F.col("own"))
    named = named.withColumn("header", F.coalesce("own", F.last(usable, ignorenulls=True).over(order)))
    fits = (F.size("header") == F.col("n_columns")) & (F.size(F.array_distinct("header")) == F.col("n_columns"))
    numbers = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda c: c.cast("string"))
    names = F.when(fits, F.col("header")) if compat else F.when(fits, F.col("header")).otherwise(numbers)
    body = F.slice("lines", 2, F.size("lines"))
    named = named.withColumns({"header": names, "lines": body})
    records = F.when(F.col("header").isNotNull(), F.transform("lines", lambda line: F.map_from_arrays("header", line)))
    return named.select(*keys, "header", "lines", records.alias("records"))
