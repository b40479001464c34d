"""From blocks to clause rows: agreements and summaries.

All steps keep (doc_id, pos) and order by it.  A document that can't be read gives a row of (doc_id, stage, message)
and no clause rows; it never fails the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from clausewright.functions import headings as H
from clausewright.functions import identifiers as I
from clausewright.functions import patterns as P
from clausewright.functions import text as X
from clausewright.operators import rows as R
from clausewright.operators import tokenise as K

DOC = "doc_id"


def stack_elements(parsed: DataFrame, *, doc: str = DOC, content: str = "content") -> DataFrame:
    """(doc, text_block_id, text_element, list_id, text, bbox, page_id, pos) of parsed documents with arrays of blocks.

    Positions are made of block, element and item numbers, so no window is needed to number rows: ``place`` is an
    array of the three, and ``pos`` a number for blocks of at most a thousand elements.
    """
    blocks = parsed.select(doc, F.explode(content).alias("b")).select(doc, F.col("b.id").alias("text_block_id"), F.explode("b.elements").alias("e"))
    kind = F.when(F.col("e.is_table"), F.array("e.table_json")).otherwise(F.col("e.text"))
    each = blocks.select(doc, "text_block_id", F.col("e.key").alias("key"), F.col("e.order").alias("order"), F.col("e.list_id").alias("own_id"), F.col("e.bbox").alias("bbox"), F.concat_ws(",", F.transform("e.page_id", lambda p: p.cast("string"))).alias("page_id"), F.posexplode_outer(kind).alias("item", "text"))
    pos = F.col("text_block_id").cast("long") * 1_000_000_000 + F.col("order") * 1_000_000 + F.coalesce("item", F.lit(0))
    place = F.array(F.col("text_block_id").cast("long"), F.col("order").cast("long"), F.coalesce("item", F.lit(0)).cast("long"))
    out = each.withColumns({"pos": pos, "place": place})
    return out.select(doc, "text_block_id", "pos", "place", element_name(F.col("key")).alias("text_element"), F.coalesce("own_id", list_id_of(F.col("key"))).alias("list_id"), "text", "bbox", "page_id")


def list_id_of(key: Column) -> Column:
    """The list id at the end of an element's key (``list_(a)(i)``); a plain number only tells keys apart."""
    last = F.trim(F.element_at(F.split(key, "_"), -1))
    return F.when(key.rlike("^(list|paragraph)_") & ~last.rlike(r"^\d+$"), last)


def element_name(key: Column) -> Column:
    return F.when(key.rlike("^(list|paragraph)"), F.regexp_extract(key, "^(list|paragraph)", 1)).otherwise(F.regexp_replace(key, r"_\d+$", ""))


def from_blocks(blocks: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Rows of extraction from segment_blocks(), with numbered items where list_items_in_blocks() gives them."""
    rows = blocks.select(DOC, F.col("block_id").alias("text_block_id"), "pos", F.col("element").alias("text_element"), "text", F.col("box").alias("bbox"), F.concat_ws(",", F.transform("page_ids", lambda p: p.cast("string"))).alias("page_id"))
    if items is None:
        return rows.withColumn("list_id", F.lit(None).cast("string"))
    joined = rows.join(items.select(DOC, "pos", "items"), [DOC, "pos"], "left")
    each = joined.select("*", F.posexplode_outer("items").alias("n", "i"))
    return each.select(DOC, "text_block_id", F.array(F.col("pos").cast("long"), F.coalesce("n", F.lit(0)).cast("long")).alias("pos"), "text_element", F.coalesce("i.text", "text").alias("text"), "bbox", "page_id", F.col("i.list_id").alias("list_id"))


def tidy(rows: DataFrame) -> DataFrame:
    """Rows of pure punctuation or digits go; bulleted texts have no list id.

    From here on a position is a path of numbers: parts of a row stand under it, in order, however many they are.
    """
    pure = r"^\p{Punct}+$|^\d+$"
    bullet = "^(?:" + "|".join(f"\\Q{s}\\E" for s in P.SYMBOLS) + ")"
    return _paths(rows).where(F.col("text").isNotNull() & ~F.col("text").rlike(pure)).withColumn("list_id", F.when(~F.col("text").rlike(bullet), F.col("list_id")))


def _paths(rows: DataFrame) -> DataFrame:
    if "place" in rows.columns:
        return rows.withColumn("pos", F.col("place")).drop("place")
    if rows.schema["pos"].dataType.typeName() == "array":
        return rows
    return rows.withColumn("pos", F.array(F.col("pos").cast("long")))


def _renumber(rows: DataFrame, texts: str) -> DataFrame:
    """Parts of a text as rows of their own, in order; positions stay unique."""
    each = R.explode_texts(_paths(rows), texts)
    return each.withColumn("pos", _below(F.coalesce("sub_pos", F.lit(0)))).drop("sub_pos")


def _below(n: Column) -> Column:
    return F.concat("pos", F.array(n.cast("long")))


def split_section_and_sub(rows: DataFrame) -> DataFrame:
    """``1. Title 1.1 Text`` as a section and a sub-section."""
    hit = F.col("text").rlike(P.SECTION_AND_SUB)
    part = lambda n, e: F.struct(F.lit(e).alias("e"), F.trim(F.regexp_extract("text", P.SECTION_AND_SUB, n)).alias("t"))
    whole = F.struct(F.col("text_element").alias("e"), F.col("text").alias("t"))
    each = _paths(rows).select("*", F.posexplode(F.when(hit, F.array(part(1, "section"), part(2, "sub_section"))).otherwise(F.array(whole))).alias("sub_pos", "p"))
    split = each.withColumns({"text_element": F.col("p.e"), "text": F.col("p.t"), "pos": _below(F.col("sub_pos"))}).drop("p", "sub_pos")
    return R.keep_first(split, [DOC, "text_block_id", "text_element", "list_id", "text"], [F.col("pos")], within=[DOC])


def split_embedded_sections(rows: DataFrame) -> DataFrame:
    """List items that run into a sub-clause (``... end. 12.3 Next``) part into their sentences."""
    runs_on = F.col("text_element").startswith("list") & F.col("text").rlike(P.EMBEDDED_SECTION)
    return _renumber(rows.withColumn("texts", F.when(runs_on, F.split("text", r"(?<=\.)\s+(?=\d{1,2}[a-zA-Z]*\.\d)")).otherwise(F.array("text"))), "texts")


def find_zones(rows: DataFrame) -> DataFrame:
    """Places where the contents, the parties, what ends them, and the first schedule begin, on every row."""
    # all windows of a document are over one order, so that its rows are sorted once
    order = Window.partitionBy(DOC).orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda p: F.min(F.when(F.col("text").rlike(f"(?i){p}"), F.col("pos"))).over(whole)
    rows = rows.withColumns({"contents_at": first(P.CONTENTS_BEGIN), "parties_at": first(P.PARTIES_BEGIN), "parties_end": first(P.PARTIES_END), "__element": F.lag("text_element").over(order), "__text": F.lag("text").over(order)})
    rows = rows.withColumn("contents_at", F.coalesce("contents_at", F.array(F.lit(0).cast("long"))))
    title, under = _schedule_title(whole)
    rows = rows.withColumn("__under", F.coalesce(under, F.lit(False))).withColumn("schedule_title", title).drop("__under", "__element", "__text")
    named = F.lower(F.trim("text")) == F.lower("schedule_title")
    starts = F.col("text_element").contains("section") & (F.col("text").rlike(f"(?i){P.FIRST_SCHEDULE}") | F.coalesce(named, F.lit(False))) & ~F.col("text").rlike(f"(?i){P.SECOND_SCHEDULE}") & (F.col("pos") >= F.col("parties_end"))
    rows = rows.withColumn("schedule_at", F.min(F.when(starts, F.col("pos"))).over(whole))
    return rows.withColumn("zone", F.when(F.col("pos") >= F.col("schedule_at"), "schedule").when(F.col("pos") >= F.col("parties_end"), "clause").when(F.col("pos") >= F.col("parties_at"), "parties").when(F.col("pos") >= F.col("contents_at"), "contents").otherwise("front"))


def _schedule_title(whole: WindowSpec) -> tuple[Column, Column]:
    """The first schedule's title in the table of contents: from the last table, from the last one under a heading of
    schedules (what that is, as a column to be called ``__under``), or from the last table in its other wording."""
    a_table = (F.col("text_element") == "table") & (F.col("pos") >= F.col("contents_at")) & (F.col("pos") < F.col("parties_at"))
    under = a_table & (F.col("__element") == "section") & F.col("__text").rlike("(?i)schedule[s]*")
    last = lambda which: F.max(F.when(which, F.struct("pos", "text"))).over(whole)["text"]
    found = lambda which, p: F.when(last(which).rlike(f"(?i){p}"), F.trim(F.regexp_extract(last(which), f"(?i){p}", 1)))
    title = F.coalesce(found(a_table, P.CONTENTS_SCHEDULE_1), found(F.col("__under"), P.CONTENTS_SCHEDULE_1_BELOW), found(a_table, P.CONTENTS_SCHEDULE_1B))
    return F.nullif(title, F.lit("")), under


# What is said of a document whose zones can't be found.
ZONE_ERRORS = [("parties_at", "the opening of the parties clauses couldn't be found"), ("parties_end", "the end of the parties clauses couldn't be found"), ("schedule_at", "the heading of the first schedule couldn't be found")]


def zone_errors(rows: DataFrame) -> DataFrame:
    """(doc, stage, message) of documents without one of their zones; the first that is missing."""
    first = rows.groupBy(DOC).agg(*(F.max(c).alias(c) for c, _ in ZONE_ERRORS))
    message = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(m)) for c, m in ZONE_ERRORS))
    return first.select(DOC, F.lit("zones").alias("stage"), message.alias("message")).where("message is not null")


def promote_headings(rows: DataFrame) -> DataFrame:
    """Texts of other elements that begin with X.Y are sub-sections; schedule-like titles aren't clauses' sections."""
    guard = "".join(f"(?!{p})" for p in P.PERCENTAGES)
    numbered = F.col("text").rlike(rf"^[1-9]\d*[a-zA-Z]*\.{guard}\d+") & F.col("text_element").rlike("^(list|section|sub_section|caption|paragraph|table)") & (F.col("zone") == "clause")
    return rows.withColumn("text_element", F.when(numbered, "sub_section").otherwise(F.col("text_element")))


def heading_guard(col: Column) -> Column:
    """A heading is in capitals, has at most ten words, or is in heading case; otherwise it is no heading."""
    return F.when((col == F.upper(col)) | (F.size(F.split(F.trim(col), r"\s+")) <= 10) | X.is_heading_case(col), col)


def _together(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Documents' rows dealt again: Spark doesn't know what a Python function leaves in place, and would else shuffle by each window's own keys."""
    return rows.repartition(DOC) if partitions is None else rows.repartition(partitions, DOC)


def fill_hierarchy(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ids and headings of the clause or schedule that each row is in.

    Headings are read once per row; then schedules fill down, parts and sections within a schedule, sections within the
    clauses, sub-sections within a section.
    """
    w = Window.partitionBy(DOC).orderBy("pos")
    near = rows.withColumns({"next_text": F.lead("text").over(w), "next_element": F.lead("text_element").over(w), "last_element": F.lag("text_element").over(w)})
    is_head = F.col("text_element").rlike("section") & F.col("zone").isin("clause", "schedule")
    near = near.withColumn("opens_parties", F.coalesce(F.col("pos") == F.col("parties_at"), F.lit(False)))
    given = (F.when(is_head, F.col(c)) for c in ("text", "next_text", "next_element"))
    near = near.withColumn("h", F.when(is_head, H.read_heading(*given)))
    read = _together(near.drop("contents_at", "parties_at", "parties_end", "schedule_at", "schedule_title", "next_text"), partitions)
    sched = F.col("zone") == "schedule"
    out = read.withColumns({f: F.col(f"h.{f}") for f in H.FIELDS}).drop("h")
    out = out.withColumns({f: F.when(sched, F.col(f)) for f in ("schedule_id", "schedule", "part_id", "part")} | {f: F.when(~sched, F.col(f)) for f in ("sub_section_id", "sub_section")})
    out = out.withColumn("__sub", F.trim(X.clean_heading(F.col("sub_section")))).withColumn("sub_section", F.nullif("__sub", F.lit(""))).drop("__sub")
    out = out.withColumns({
        "section_id": F.when(F.col("opens_parties"), "0").when(F.col("zone").isin("contents", "front"), None).otherwise(F.col("section_id")),
        "section": F.when(F.col("zone") == "parties", "PARTIES").when(F.col("zone") == "contents", "TABLE OF CONTENTS").otherwise(heading_guard(F.col("section"))),
        "sub_section": heading_guard(F.col("sub_section")),
    })
    # a row is in a schedule or in the body, so what fills both is filled in one pass over the document and one over its schedules and sections
    body = F.col("zone").isin("parties", "clause")
    out = R.forward_fills(out, {"schedule_id": sched, "schedule": sched, "section_id": body}, by=[DOC], order=["pos"])
    in_sched, in_body = sched & F.col("schedule_id").isNotNull(), body & F.col("section_id").isNotNull()
    out = out.withColumns({"__sched": F.coalesce(in_sched, F.lit(False)), "__body": F.coalesce(in_body, F.lit(False)), "__in": F.when(in_sched, F.col("schedule_id")).when(in_body, F.col("section_id"))})
    in_sched, in_body = F.col("__sched"), F.col("__body")
    out = R.forward_fills(out, {"part_id": in_sched, "part": in_sched, "section_id": in_sched, "section": in_sched | in_body, "sub_section_id": in_body, "sub_section": in_body}, by=[DOC, "__sched", "__body", "__in"], order=["pos"]).drop("__sched", "__body", "__in")
    lone = (F.col("text_element") == "section") | (F.coalesce(F.col("next_element") == "sub_section", F.lit(False)) & F.coalesce(F.col("last_element") == "section", F.lit(False)))
    return out.withColumns({f: F.when(~lone, F.col(f)) for f in ("sub_section_id", "sub_section")}).drop("next_element", "last_element", "opens_parties")


def read_definitions(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of definition sections part into phrases; their terms fill down within a sub-section.  Parties name theirs."""
    defining = (I.is_definition_row(F.col("section"), F.col("sub_section"), F.col("text")) | F.coalesce(F.col("text").rlike(P.DEFINES), F.lit(False))) & (F.col("zone") == "clause")
    marked = rows.withColumn("defining", F.coalesce(defining, F.lit(False)))
    cleaned = F.when(F.col("defining"), X.clean_defined_text(F.col("text")))
    marked = marked.withColumn("texts", F.when(F.col("defining"), K.phrase_column(cleaned)).otherwise(F.array("text")))
    each = _renumber(_together(marked, partitions), "texts")
    each = each.withColumn("definition", F.when(F.col("defining"), H.read_definition(F.col("text"))["definition"]).when(F.col("zone") == "parties", H.read_party(F.col("text"))))
    return R.forward_fill(each, ["definition"], by=[DOC, "section_id", "sub_section_id"], order=["pos"], where=F.col("defining") & F.col("section_id").isNotNull() & F.col("sub_section_id").isNotNull())


def with_identifiers(rows: DataFrame) -> DataFrame:
    ident = I.clause_identifier(*(F.col(c) for c in ("section_id", "sub_section_id", "schedule_id", "part_id", "list_id", "definition", "text_element", "section", "sub_section", "text")))
    plain = F.col("zone").isin("contents", "front") | F.col("text").rlike(P.SECTION_WORD)
    return rows.withColumn("identifier", F.when(~F.coalesce(plain, F.lit(False)), X.bound(ident, lambda x: F.nullif(x, F.lit("")))))


def finish(rows: DataFrame) -> DataFrame:
    """Trim texts, drop empty ones, number runs and phrases, and add ancestors and captions."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "^:+", ""), "^•+", ""))
    kept = rows.withColumn("text", text).where((F.col("text") != "") & ~F.col("text").rlike(r"^[^\p{L}\p{N}_]+$"))
    w = Window.partitionBy(DOC).orderBy("pos")
    kept = kept.withColumn("row", F.row_number().over(w))
    # from here on a row's number is its place, and what nobody asks for needn't be carried to its ancestors
    out = R.nearest_ancestors(kept.drop("pos"), by=[DOC, "text_block_id"], pos="row")
    out = R.run_index(out, "text_element", "index", by=[DOC], order=["row"])
    out = R.parent_caption(out, by=[DOC], order=["row"])
    out = R.run_index(out, "section", "section_run", by=[DOC], order=["row"])
    return out.withColumn("phrase_id", F.row_number().over(Window.partitionBy(DOC, "index").orderBy("row")) - 1)


TS_COLUMNS = ["index", "text_block_id", "page_id", "phrase_id", "section", "text_element", "list_id", "parent_caption", "parent_list_ids", "parent_list", "text"]
FA_COLUMNS = ["index", "text_block_id", "phrase_id", "page_id", "bbox", "section_id", "section", "sub_section_id", "sub_section", "schedule_id", "schedule", "part_id", "part", "text_element", "list_id", "definition", "identifier", "text", "parent_caption", "parent_list_ids", "parent_list"]


def project(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Output columns; blocks are renumbered by changes of section, rows from 1 in each document."""
    out = X.without_sentinels(rows.drop("text_block_id").withColumnRenamed("section_run", "text_block_id"))
    out = out.withColumn("pos", F.col("row").cast("long"))
    return out.select(DOC, "pos", *columns)


def camel_case(df: DataFrame) -> DataFrame:
    """Names as the boundary has them: ``text_block_id`` to ``textBlockId``."""
    return df.withColumnsRenamed({c: c.split("_")[0] + "".join(p.title() for p in c.split("_")[1:]) for c in df.columns})


def extract_agreement(rows: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(clause rows, errors) of an agreement's stacked rows, dealt by document over so many partitions (the session's number)."""
    zoned = find_zones(split_embedded_sections(split_section_and_sub(tidy(rows))))
    errors = zone_errors(zoned)
    good = zoned.where("parties_at is not null and parties_end is not null and schedule_at is not null")
    out = with_identifiers(read_definitions(fill_hierarchy(promote_headings(good), partitions), partitions))
    return project(finish(out.drop("zone", "defining")), FA_COLUMNS), errors


def repair_colons(rows: DataFrame) -> DataFrame:
    """A section that is a lone colon belongs to the one before: that one gets the colon, and stands for it."""
    w = Window.partitionBy(DOC).orderBy("pos")
    lone = F.trim("section") == ":"
    with_colon = F.when((F.trim(F.lead("section").over(w)) == ":") & ~lone, F.concat_ws(" ", "section", F.lit(":"))).when(~F.coalesce(lone, F.lit(False)), F.col("section"))
    marked = rows.withColumns({"__s": with_colon, "__lone": F.coalesce(lone, F.lit(False))})
    filled = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("section", F.when(F.col("__lone"), filled).otherwise(F.col("__s"))).drop("__s", "__lone")


def extract_summary(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Clause rows of a summary's stacked rows; ``bank`` has the known section names (``name``).

    Names are met by equality after numbering, blanks and colons are trimmed.
    """
    base = tidy(rows).withColumn("section", F.when(F.col("text_element") == "section", F.col("text")))
    base = repair_colons(base)
    item = F.lower(F.trim("text")) == "items"
    preposition = F.lower(F.regexp_replace(F.trim("text"), r"\s*:*$", "")).isin([p.lower() for p in P.PREPOSITION_HEADINGS])
    base = base.withColumns({"text_element": F.when(item, "reference").when(preposition, "caption").otherwise(F.col("text_element")), "section": F.when(~item & ~preposition, F.col("section"))})
    bulleted = F.col("text_element").contains("caption") & F.col("text").rlike("(?:" + "|".join(f"\\Q{s}\\E" for s in P.SYMBOLS) + ").*:")
    base = base.withColumn("text_element", F.when(bulleted, "list").otherwise(F.col("text_element")))
    is_section = F.col("text_element").contains("section")
    keyed, dotted = is_section & F.coalesce(F.col("section").rlike(P.KEY_AND_VALUE), F.lit(False)), is_section & F.col("text").contains(".")
    given = lambda which: F.when(which, F.col("text"))  # noqa: E731  (Python functions see every row: those that aren't theirs as null)
    parts = F.when(F.col("text_element").contains("list"), K.split_bullets(F.col("text"))).when(keyed, K.separator_column(given(keyed))).when(dotted, K.phrase_column(given(~keyed & dotted))).otherwise(F.array("text"))
    each = _renumber(base.withColumn("texts", parts), "texts")
    named = in_bank(each, bank)
    w = Window.partitionBy(DOC, "text_block_id").orderBy("pos")
    first = F.row_number().over(w) == 1
    stays = (F.col("text_element") == "section") & (first | F.col("in_bank")) & ~F.trim("text").startswith("Tranche")
    out = named.withColumns({"text_element": F.when((F.col("text_element") == "section") & ~stays, "paragraph").otherwise(F.col("text_element")), "section": F.when(stays, F.replace("text", F.lit(":"), F.lit("")))})
    out = promote_list_items(out.drop("in_bank"), bank)
    own = F.regexp_replace("section", r"^\d{1,2}[a-zA-Z]*\.\d{0,2}\.*\s*", "")
    out = out.withColumn("section", F.nullif(F.trim(F.regexp_replace(own, ":+$", "")), F.lit("")))
    out = R.forward_fill(out.withColumn("section", X.join_separated_letters(F.col("section"))), ["section"], by=[DOC], order=["pos"])
    out = out.withColumn("section", X.trim_heading(X.ordinals_to_words(F.col("section"))))
    out = _renumber(out.withColumn("texts", K.split_commas(F.col("text"), F.col("section"))), "texts")
    out = R.run_index(out, "section", "text_block_id_", by=[DOC], order=["pos"])
    return project(finish(out.drop("text_block_id").withColumnRenamed("text_block_id_", "text_block_id")), TS_COLUMNS)


def bank_key(text: Column) -> Column:
    """A section's name without numbering, blanks and colons around it."""
    return F.regexp_replace(F.regexp_replace(text, r"^\d*\.*\s*", ""), r"\s*:*\s*$", "")


def in_bank(rows: DataFrame, bank: DataFrame, text: str = "text") -> DataFrame:
    """``in_bank``: whether a text is a known section name.  The bank is a dimension; it is joined by equality."""
    names = bank.select(bank_key(F.col("name")).alias("__key"), F.lit(True).alias("in_bank")).distinct()
    return rows.withColumn("__key", bank_key(F.col(text))).join(names, "__key", "left").withColumn("in_bank", F.coalesce("in_bank", F.lit(False))).drop("__key")


def promote_list_items(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """List items that are section names: short numbered ones, capitals, and ``name: value`` with a known name."""
    w = Window.partitionBy(DOC).orderBy("pos")
    key = F.trim(F.regexp_extract("text", r"^•*\s*([^:]*):", 1))
    looked = rows.withColumns({"__key_text": F.when(key != "", key).otherwise(F.col("text")), "__after_section": F.coalesce(F.lag("text_element").over(w) == "section", F.lit(False))})
    looked = in_bank(looked, bank, "__key_text")
    a_list = F.col("text_element").contains("list")
    numbered = a_list & (F.coalesce(F.col("list_id").rlike(r"\d+\.$"), F.lit(False)) | F.col("text").rlike(r"^\d+\.")) & ~F.col("text").rlike(P.NOT_A_KEY) & (F.size(F.split("text", " ")) <= 5) & F.col("in_bank")
    capitals = a_list & F.col("text").rlike("^[A-Z ]+$")
    keyed = F.col("section").isNull() & ~F.coalesce(F.col("list_id").rlike(r"\)$"), F.lit(False)) & a_list & ~F.col("__after_section") & F.col("text").rlike("^" + P.KEY_AND_VALUE) & ~F.col("text").rlike(P.NOT_A_KEY) & (F.size(F.split(F.trim("__key_text"), r"\s+")) <= 7) & F.col("in_bank")
    value = F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))
    out = looked.withColumns({
        "text_element": F.when(numbered, "section").otherwise(F.col("text_element")),
        "section": F.when(numbered, F.replace("text", F.lit(":"), F.lit(""))).when(capitals, F.col("text")).when(keyed, F.col("__key_text")).otherwise(F.col("section")),
        "text": F.when(keyed & (value != ""), value).otherwise(F.col("text")),
    })
    return out.drop("__key_text", "__after_section", "in_bank")
