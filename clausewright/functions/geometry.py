"""Boxes on a page as Column expressions: arrays (x0, y0, x1, y1) on a grid of 0 to 1000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRID = 1000


def normalise_box(box: Column, width: Column, height: Column) -> Column:
    """Page units to the grid, cut toward zero and clamped."""
    edge = lambda i, size: F.least(F.lit(GRID), F.greatest(F.lit(0), (F.get(box, F.lit(i)).cast("double") / size * GRID).cast("int")))
    return F.array(edge(0, width), edge(1, height), edge(2, width), edge(3, height))


def denormalise_box(box: Column, width: Column, height: Column) -> Column:
    edge = lambda i, size: (F.get(box, F.lit(i)).cast("double") * size / GRID).cast("int")
    return F.array(edge(0, width), edge(1, height), edge(2, width), edge(3, height))


def outline_of(boxes: Column) -> Column:
    """The least box around an array of boxes."""
    edge = lambda i: F.transform(boxes, lambda b: b[i])
    return F.array(F.array_min(edge(0)), F.array_min(edge(1)), F.array_max(edge(2)), F.array_max(edge(3)))


def outline(box: str) -> Column:
    """The same as an aggregate over rows."""
    at = lambda i: F.get(F.col(box), F.lit(i))
    return F.array(F.min(at(0)), F.min(at(1)), F.max(at(2)), F.max(at(3)))


def least_offset(a: Column, b: Column, axis: int) -> Column:
    """The least distance between edges of two boxes along an axis (0: x, 1: y)."""
    pairs = ((axis, axis + 2), (axis, axis), (axis + 2, axis), (axis + 2, axis + 2))
    return F.least(*(F.abs(a[i] - b[j]) for i, j in pairs))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts."""
    return ~((a[0] > b[2]) | (b[0] > a[2]) | (a[1] > b[3]) | (b[1] > a[3]))


def boxes_adjacent(a: Column, b: Column, most_x: Column | int = GRID, most_y: Column | int = GRID) -> Column:
    return (least_offset(a, b, 0) <= most_x) & (least_offset(a, b, 1) <= most_y)


def box_inside(inner: Column, outer: Column) -> Column:
    return (inner[0] >= outer[0]) & (inner[1] >= outer[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def font_flags(name: Column) -> Column:
    """Style bits from a font's name: what stands after its last dash."""
    parts = F.split(name, "-")
    last = F.element_at(parts, -1)
    out = F.lit(0)
    for word, bit in (("Superscripted", 1), ("Italic", 2), ("Serifed", 4), ("Monospaced", 8), ("Bold", 16)):
        out = F.when(last.contains(word), bit).otherwise(out)
    return F.when(F.size(parts) > 1, out).otherwise(0)


def neighbours(df: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """``prev_`` and ``next_`` of columns within a group, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})


def text_by_box(words: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text): words (doc_id, page_id, pos, word, box) wholly in a query's box (doc_id, page_id, query_id, query_box).

    An equi join on the page, so a page's words meet that page's queries only.
    """
    found = queries.join(words, ["doc_id", "page_id"], "left").withColumn("hit", box_inside(F.col("box"), F.col("query_box")))
    item = F.when(F.col("hit"), F.struct("pos", "word"))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["word"]), " ").alias("text"))
