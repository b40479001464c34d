"""From page tokens to ordered text blocks.

Rows are (doc_id, page_id, pos, text, box, tag) and the like.  What depends on neighbours alone is a window; font ranks,
which step a counter along a short list per document, and blocks, whose membership depends on the block so far, fold
one document's rows in an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import geometry as G
from clausewright.functions.headings import sub_section_kind

FOOTER_BAND = 80
STYLE = ["size", "flags", "font", "color"]


def font_census(spans: DataFrame, *, by: list[str], style: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """How often each style occurs, and its rank by count (the first seen of equals first)."""
    style = style or STYLE
    counted = spans.groupBy(*by, *style).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first_pos")))


def _mode(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of a group; the least of several."""
    n = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"))


def line_spacing(spans: DataFrame, *, by: list[str], pos: str = "pos", box: str = "box") -> DataFrame:
    """Mode, upper quartile and maximum of the offset between neighbouring spans of a page; 0 with fewer than two."""
    near = spans.withColumn("gap", G.least_offset(F.col(box), F.lag(box).over(Window.partitionBy(*by).orderBy(pos)), 1))
    stats = near.groupBy(*by).agg(F.count("gap").alias("n"), F.percentile("gap", F.lit(0.75)).alias("upper"), F.max("gap").alias("most"))
    out = stats.join(_mode(near.where("gap is not null"), by, "gap"), by, "left")
    enough = F.col("n") > 1
    return out.select(*by, *(F.when(enough, F.col(c)).otherwise(0).alias(f"line_{c}") for c in ("mode", "upper", "most")))


def word_spacing(words: DataFrame, lines: DataFrame, *, by: list[str], pos: str = "pos", box: str = "box") -> DataFrame:
    """Mode, maximum and minimum of the x-offset between neighbouring words that are within a line's spacing."""
    w = Window.partitionBy(*by).orderBy(pos)
    near = words.withColumns({"dx": G.least_offset(F.col(box), F.lag(box).over(w), 0), "dy": G.least_offset(F.col(box), F.lag(box).over(w), 1)})
    near = near.join(lines.select(*by, "line_most"), by, "left").withColumn("dx", F.when(F.col("dy") <= F.col("line_most"), F.col("dx")))
    stats = near.groupBy(*by).agg(F.count("dx").alias("n"), F.max("dx").alias("most"), F.min("dx").alias("least"))
    out = stats.join(_mode(near.where("dx is not null"), by, "dx"), by, "left")
    return out.select(*by, *(F.when(F.col("n") > 1, F.col(c)).otherwise(0).alias(f"word_{c}") for c in ("mode", "most", "least")))


def font_tags(census: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """heading<n>, paragraph or subscript<n> for each style, against the document's most used one.

    Styles are taken from large to small, bold before plain.  A style differs from the one before only by colour when
    size and font are equal, and then shares its number; numbers of headings go on after a paragraph style.
    """
    kind = dict(census.dtypes)

    def tag(pdf: pd.DataFrame) -> pd.DataFrame:
        main = pdf.sort_values(["n", "first_pos"], ascending=[False, True]).iloc[0]
        own = (pdf[STYLE] == main[STYLE]).all(axis=1)
        pdf = pdf.assign(style=pdf["flags"].where(~own, -1)).sort_values(["size", "style", "n", "first_pos"], ascending=[False, False, False, True])
        number = resume = 0
        last, tags = None, []
        for r in pdf.itertuples():
            if last is not None and (last.size, last.font) == (r.size, r.font):
                number -= 1
            level, colour, bold = r.size == main["size"], r.color == main["color"], r.style >= 16
            if r.size > main["size"] or level and (not colour or bold):
                if tags and tags[-1] == "paragraph":
                    number = resume
                tags.append(f"heading{number}")
                number = resume = number + 1
            elif level:
                tags.append("paragraph")
                number = 0
            else:
                tags.append(f"subscript{number}")
                number += 1
            last = r
        return pdf.assign(font_tag=tags)[[doc, *STYLE, "n", "font_tag"]]

    schema = f"{doc} {kind[doc]}, " + ", ".join(f"{c} {kind[c]}" for c in STYLE) + ", n bigint, font_tag string"
    return census.groupBy(doc).applyInPandas(tag, schema)


def style_to_tag(style: Column, headings: Column, subscripts: Column) -> Column:
    """General element of a font tag, by where its number lies among the document's."""
    n = F.regexp_extract(style, r"(\d+)", 1).try_cast("int")
    small = F.when(n <= headings / 2, "title").when(n <= headings * 2 / 3, "section").otherwise("caption")
    large = F.when(n <= headings * 0.3, "title").when(n <= headings * 0.4, "section").when(n <= headings * 0.6, "caption").otherwise("paragraph")
    sub_small = F.when(n <= subscripts / 2, "list").otherwise("footer")
    sub_large = F.when(n <= subscripts * 0.6, "paragraph").when(n <= subscripts * 0.8, "list").otherwise("footer")
    return F.when(style.contains("heading"), F.when(headings < 20, small).otherwise(large)).when(style.contains("subscript"), F.when(subscripts < 20, sub_small).otherwise(sub_large)).otherwise("paragraph")


def mark_footers(tokens: DataFrame, *, box: str = "box", page: str = "page_id", tag: str = "tag", band: int = FOOTER_BAND) -> DataFrame:
    """Tokens in the outer bands of a page other than the first are footers; tokens off the page go."""
    on_page = (F.col(box)[0] >= 0) & (F.col(box)[1] >= 0) & (F.col(box)[2] <= G.GRID) & (F.col(box)[3] <= G.GRID)
    in_band = (F.col(page) != 1) & ((F.col(box)[3] <= band) | (F.col(box)[1] >= G.GRID - band))
    return tokens.where(on_page).withColumn(tag, F.when(in_band, "footer").otherwise(F.col(tag)))


def _merge_runs(df: DataFrame, starts: Column, by: list[str], order: list[str], text: str, carried: dict[str, Column]) -> DataFrame:
    """Rows of a run (each begins where ``starts`` holds) as one row: texts joined in order, boxes outlined."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("__start", F.when(starts, 1).otherwise(0))
    runs = flagged.withColumn("__run", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return runs.groupBy(*by, "__run").agg(joined.alias(text), G.outline("box").alias("box"), F.min(order[-1]).alias(order[-1]), *(c.alias(n) for n, c in carried.items())).drop("__run")


def merge_touching(spans: DataFrame, *, by: list[str], pos: str = "pos", most_x: int = 2, most_y: int = 2) -> DataFrame:
    """Spans that nearly touch the one before join it."""
    w = Window.partitionBy(*by).orderBy(pos)
    starts = ~F.coalesce(G.boxes_adjacent(F.col("box"), F.lag("box").over(w), most_x, most_y), F.lit(False))
    return _merge_runs(spans, starts, by, [pos], "text", {})


def classify_tokens(tokens: DataFrame, model=None, *, tag: str = "tag", rule_tag: str = "rule_tag") -> DataFrame:
    """Tags by a model, or the rule's where none is given.

    ``model`` takes an iterator of frames (doc_id, page_id, pos, text, box) and yields them with a tag, so that it is
    loaded once a task; tokens that it doesn't return are dropped.
    """
    if model is None:
        return tokens.withColumn(tag, F.col(rule_tag))
    kind = dict(tokens.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in ("doc_id", "page_id", "pos")) + f", {tag} string"
    found = tokens.select("doc_id", "page_id", "pos", "text", "box").mapInPandas(model, schema)
    return tokens.drop(tag).join(found, ["doc_id", "page_id", "pos"])


def token_windows(tokens: DataFrame, pieces: Column, *, size: int = 512, stride: int = 128, pos: str = "pos") -> DataFrame:
    """(doc_id, page_id, window, items) of overlapping windows: ``size`` pieces of words each, ``stride`` shared with the next.

    ``pieces`` says in how many pieces the model's tokenizer cuts a word.  A word is in each window that holds its first
    piece; the last window of a page is the first that reaches its end.  Items are (at, pos, text, box) in order of pos.
    """
    step = size - stride
    page = Window.partitionBy("doc_id", "page_id")
    n = F.greatest(pieces, F.lit(1)).cast("long")
    placed = tokens.select("doc_id", "page_id", F.col(pos).alias("pos"), "text", "box", n.alias("n"))
    order = page.orderBy("pos", "text", "box").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"at": F.coalesce(F.sum("n").over(order), F.lit(0)), "total": F.sum("n").over(page)})
    last = F.greatest(F.ceil((F.col("total") - size) / step), F.lit(0))
    first = F.greatest(F.floor((F.col("at") - size) / step) + 1, F.lit(0))
    ends = F.least(F.floor(F.col("at") / step), last)
    each = placed.withColumn("window", F.explode(F.sequence(first.cast("long"), ends.cast("long"))))
    return each.groupBy("doc_id", "page_id", "window").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "text", "box"))).alias("items"))


def classify_windows(
    tokens: DataFrame, make_model: Callable[[], Callable[[list[list[tuple[str, list[int]]]]], list[list[str | None]]]], *, pieces: Column | None = None, size: int = 512, stride: int = 128, batch: int = 16, tag: str = "tag", compat: bool = True,
) -> DataFrame:
    """Tokens with the tags that a model gives them in overlapping windows; tokens without one are dropped.

    ``make_model`` is called once in a task; the model takes up to ``batch`` windows, each a list of (text, box), and gives a
    tag or none for every token.  Windows are dealt over the tasks by page and number, so a long page keeps none busy alone.
    Of a token's predictions compat takes the last one for its page and box, in order of windows and places (tokens that
    share a box share a tag); strict takes the token's own from the window that shows most on both sides of it.
    """
    windows = token_windows(tokens, F.lit(1) if pieces is None else pieces, size=size, stride=stride)
    kind = dict(tokens.dtypes)
    page = f"doc_id {kind['doc_id']}, page_id {kind['page_id']}, window long"
    given = f"at long, pos {kind['pos']}, box {kind['box']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or make_model()
            for begin in range(0, b.num_rows, batch):
                some = b.slice(begin, batch)
                items, page_of = some.column("items"), some.select(["doc_id", "page_id", "window"])
                flat, sizes = items.flatten(), items.value_lengths().to_pylist()  # what the model doesn't see stays in Arrow
                shown, ends = list(zip(flat.field("text").to_pylist(), flat.field("box").to_pylist(), strict=True)), list(accumulate(sizes))
                said = model([shown[end - n : end] for n, end in zip(sizes, ends, strict=True)])
                if [len(x) for x in said] != sizes:
                    raise ValueError("a model must give a tag or None for every token of its windows")
                rows = page_of.take(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64()))
                room = [min(i, n - 1 - i) for n in sizes for i in range(n)]
                columns = [flat.field(c) for c in ("at", "pos", "box")]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns, pa.array([t for tags in said for t in tags], pa.string()), pa.array(room, pa.int32())], ["doc_id", "page_id", "window", "at", "pos", "box", "tag", "room"])

    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as bytes don't tell what a model costs
    found = windows.repartition(tasks, "doc_id", "page_id", "window").mapInArrow(run, f"{page}, {given}, tag string, room int").where("tag is not null")
    key, best = (["doc_id", "page_id", "box"], F.struct("window", "at")) if compat else (["doc_id", "page_id", "pos"], F.struct("room", F.negative("window")))
    chosen = found.groupBy(*key).agg(F.max_by("tag", best).alias("chosen"))
    same = [tokens[c].eqNullSafe(chosen[c]) for c in key]
    joined = tokens.join(chosen, same[0] & same[1] & same[2])
    return joined.select(*(tokens[c] for c in tokens.columns if c != tag), chosen["chosen"].alias(tag))


def group_elements(tokens: DataFrame, *, doc: str = "doc_id", order: str = "pos", term_sheet: Column | bool = False, line_most: str | Column = "line_most") -> DataFrame:
    """Neighbouring tokens of one tag as one element; footers and references after the first token go.

    A token joins its raw predecessor when the tags are equal and it is on the same page and near enough, or on the
    next page and no section.  The raw predecessor counts even if it is dropped, so a footer parts what it
    stands between; a second pass joins that again.
    """
    w = Window.partitionBy(doc).orderBy(order)
    sheet = F.lit(term_sheet) if isinstance(term_sheet, bool) else term_sheet
    near = F.when(F.col("tag") == "section", F.when(sheet, 15).otherwise(5)).when(F.col("tag") == "paragraph", F.when(sheet, 15).otherwise(10)).otherwise(F.col(line_most) if isinstance(line_most, str) else line_most)
    looked = tokens.withColumns({"__n": F.row_number().over(w), "__tag": F.lag("tag").over(w), "__page": F.lag("page_id").over(w), "__box": F.lag("box").over(w)})
    same_page = (F.col("page_id") == F.col("__page")) & G.boxes_adjacent(F.col("box"), F.col("__box"), G.GRID, near)
    joins = (F.col("tag") == F.col("__tag")) & (same_page | (F.col("page_id") != F.col("__page")) & (F.col("tag") != "section"))
    kept = looked.withColumn("__joins", F.coalesce(joins, F.lit(False))).where((F.col("__n") == 1) | ~F.col("tag").isin("footer", "reference")).where(~((F.col("tag") == "section") & (F.col("text") == ":")))
    last = {c: F.max_by(c, order) for c in ("page_id",)} | {"tag": F.min_by("tag", order), "n_tokens": F.count(F.lit(1)), "text_length": F.sum(F.length("text")) + F.count(F.lit(1)) - 1}
    if not isinstance(line_most, Column):
        last[line_most] = F.max(line_most)
    return _merge_runs(kept, ~F.col("__joins"), [doc], [order], "text", last)


def group_twice(tokens: DataFrame, **options) -> DataFrame:
    return group_elements(group_elements(tokens, **options), **options)


def promote_titles(elements: DataFrame, *, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """In a summary document, titles right after a section and titles of schedules are sections."""
    w = Window.partitionBy(doc).orderBy(order)
    run = F.sum(F.when(F.col("tag") == "title", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    looked = elements.withColumn("__run", run)
    head = F.first("tag").over(Window.partitionBy(doc, "__run").orderBy(order))
    named = F.col("text").rlike(r"(?i)^(?:Schedule|Appendix|Part)\b")
    return looked.withColumn("tag", F.when((F.col("tag") == "title") & ((head == "section") | named), "section").otherwise(F.col("tag"))).drop("__run")


def reading_order(rows: DataFrame, out: str = "page_order", *, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def rename_sections(elements: DataFrame) -> DataFrame:
    return elements.withColumn("tag", F.when(F.col("tag") == "section", sub_section_kind(F.col("text"))).otherwise(F.col("tag")))


# Which elements may stand in a block after which.
JOINS_AFTER = {
    "caption": ["figure", "list", "table", "paragraph"],
    "figure": ["caption", "paragraph", "reference"],
    "footer": [],
    "list": ["caption", "paragraph"],
    "paragraph": ["caption", "list", "paragraph", "reference", "table"],
    "reference": [],
    "section": ["caption", "figure", "list", "paragraph", "table", "sub_section"],
    "sub_section": ["caption", "figure", "list", "paragraph", "table", "sub_sub_section"],
    "sub_sub_section": ["caption", "figure", "list", "paragraph", "table"],
    "table": ["paragraph", "reference"],
    "title": ["figure", "list", "table"],
}
SECTION_TAGS = ["section", "sub_section", "sub_sub_section"]
STAND_ALONE = [*SECTION_TAGS, "title", "paragraph"]


def segment_blocks(elements: DataFrame, *, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """(doc, block_id, key, n_in_block, text, page_ids, boxes, box): elements in blocks.

    A block opens at a section-like element that the one before doesn't allow, and where a run of one style that isn't
    joined meets a new page.  Equal neighbouring lists, captions, tables and figures on a page are one element; lists
    also across a page.  All of this looks at neighbours alone, so it is three windows: element runs, then blocks.
    """
    w = Window.partitionBy(doc).orderBy(order)
    allowed = F.create_map(*(x for k, v in JOINS_AFTER.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    looked = elements.withColumns({"__tag": F.lag("tag").over(w), "__page": F.lag("page_id").over(w)})
    same_page = F.col("page_id") == F.col("__page")
    equal = (F.col("tag") == F.col("__tag")) & ~F.col("tag").isin(STAND_ALONE)
    merges = equal & (same_page | F.col("tag").isin("list", "paragraph"))
    opens_equal = equal & ~merges
    joins = (same_page & F.array_contains(F.coalesce(allowed[F.col("__tag")], F.array().cast("array<string>")), F.col("tag"))) | ~F.col("tag").isin(SECTION_TAGS)
    first = F.col("__tag").isNull()
    opens = first | opens_equal | (~equal & ~joins)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = looked.withColumns({"__block": F.sum(F.when(opens, 1).otherwise(0)).over(up_to) - 1, "__run": F.sum(F.when(F.coalesce(merges, F.lit(False)) & ~opens, 0).otherwise(1)).over(up_to)})
    item = F.struct(F.col(order).alias("k"), F.col("text").alias("t"), F.col("page_id").alias("p"), F.col("box").alias("b"))
    grouped = runs.groupBy(doc, F.col("__block").alias("block_id"), "__run").agg(F.min(order).alias(order), F.first("tag").alias("element"), F.array_sort(F.collect_list(item)).alias("i"), G.outline("box").alias("box"))
    nth = F.row_number().over(Window.partitionBy(doc, "block_id", "element").orderBy(order)) - 1
    named = grouped.withColumn("n_in_block", nth)
    key = F.when(F.col("n_in_block") == 0, F.col("element")).otherwise(F.concat_ws("_", "element", "n_in_block"))
    return named.select(
        doc, "block_id", order, key.alias("key"), "element", "n_in_block", F.array_join(F.transform("i", lambda x: x["t"]), " ").alias("text"),
        F.array_distinct(F.transform("i", lambda x: x["p"])).alias("page_ids"), F.transform("i", lambda x: x["b"]).alias("boxes"), "box",
    )


def split_section_values(blocks: DataFrame, *, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """In a summary document, ``Section: value`` parts at its last colon.

    The value goes before the text of the block's next element; where the block has none it is a paragraph of its own.
    """
    w = Window.partitionBy(doc, "block_id").orderBy(order)
    value = F.trim(F.regexp_extract("text", r"(?s)^(.*:)(.*)$", 2))
    splits = (F.col("element") == "section") & F.col("text").rlike(r"(?s)^.*:.*$") & (value != "")
    looked = blocks.withColumn("__value", F.when(splits, value))
    given, alone = F.lag("__value").over(w), F.col("__value").isNotNull() & F.lead("text").over(w).isNull()
    head = F.when(splits, F.trim(F.regexp_extract("text", r"(?s)^(.*:)(.*)$", 1))).otherwise(F.concat_ws(" ", given, "text"))
    rows = looked.withColumn("__rows", F.when(alone, F.array(F.struct(F.col("element").alias("e"), head.alias("t")), F.struct(F.lit("paragraph").alias("e"), F.col("__value").alias("t")))).otherwise(F.array(F.struct(F.col("element").alias("e"), head.alias("t")))))
    out = rows.select("*", F.posexplode("__rows").alias("part", "__r"))
    return out.withColumns({"element": F.col("__r.e"), "text": F.col("__r.t"), "key": F.when(F.col("part") == 1, "paragraph").otherwise(F.col("key"))}).drop("__rows", "__r", "__value")
