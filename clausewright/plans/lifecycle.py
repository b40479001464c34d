"""The engine's three ways through: documents to rows, rows to matches, feedback to figures.

Each takes and gives frames and stays lazy.  Documents that can't be read come out as error rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import patterns as P
from clausewright.operators import export, extract, feedback, layout, match, tokenise
from clausewright.operators.match import HIT


@dataclass(frozen=True)
class Read:
    rows: DataFrame
    errors: DataFrame


def parse(tokens: DataFrame, *, term_sheet: bool, model=None) -> DataFrame:
    """Page tokens to blocks: tags, footers, elements (twice), sections by number, blocks."""
    tagged = layout.mark_footers(layout.classify_tokens(tokens, model))
    spacing = layout.line_spacing(tagged.where(F.col("box").isNotNull()), by=["doc_id", "page_id"])
    ready = tagged.join(spacing.select("doc_id", "page_id", "line_most"), ["doc_id", "page_id"], "left")
    ready = ready.withColumn("pos", F.col("page_id").cast("long") * 1_000_000 + F.col("pos"))
    elements = layout.group_twice(ready, term_sheet=term_sheet)
    elements = layout.promote_titles(elements) if term_sheet else layout.rename_sections(elements)
    blocks = layout.segment_blocks(elements)
    return layout.split_section_values(blocks) if term_sheet else blocks


def agreement_rows(blocks: DataFrame) -> Read:
    """Blocks of agreements to clause rows."""
    marked = blocks.withColumn("is_definition", F.col("text").rlike("(?i)Definitions|Interpretations"))
    items = tokenise.list_items_in_blocks(marked.where(F.col("element") == "list"))
    rows, errors = extract.extract_agreement(extract.from_blocks(blocks, items))
    return Read(rows, errors)


def summary_rows(blocks: DataFrame, bank: DataFrame) -> Read:
    if "part" not in blocks.columns:
        blocks = blocks.withColumn("part", F.lit(0))
    blocks = blocks.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_id", "pos", "part")).cast("long"))
    rows = extract.extract_summary(extract.from_blocks(blocks, tokenise.phrase_items(blocks)), bank)
    return Read(rows, rows.sparkSession.createDataFrame([], "doc_id string, stage string, message string"))


def match_rows(ts: DataFrame, fa: DataFrame, *, task: str = "file_id", pos: str = "pos", embed=None, top: int = match.TOP_N, compat: bool = True) -> DataFrame:
    """Summary rows with their best clauses.

    ``ts`` and ``fa`` hold rows of pairs that share ``task``; both have ``pos``.  They are read several times: give stored rows,
    not the plan that extracts them.  Texts are embedded once each; similar
    texts are found by exact cosine within a task, fan out to identifiers, are reduced to one hit per identifier, merged
    (outside sections that list terms), extended by rules, re-ranked, cut to ``top`` and decorated.
    """
    rows = ts.withColumns({"row_id": F.concat_ws(":", task, pos), "processed": match.feature_text("TS")}).where("processed is not null")
    cands = match.candidates(fa, doc=task, pos=pos)
    vectors = match.embed_distinct(rows.select(F.col("processed").alias("text")).unionByName(cands.select("text")), embed=embed)
    q = rows.select(task, F.col("processed").alias("text")).distinct().join(vectors, "text").select(task, F.col("text").alias("asked"), "embedding")
    r = cands.select(task, "text").distinct().join(vectors, "text").select(task, F.col("text").alias("term"), "embedding")
    near = match.cosine_top_k(q, r, match.PER_TYPE, query_id="asked", row_id="term", by=[task])
    hits = match.fan_out(near, cands.select(task, F.col("text").alias("term"), "identifier"), on=[task, "term"]).withColumn("match_type", F.lit("content"))
    listing = F.col("section").rlike(f"(?i){P.TERM_SECTIONS}") & (F.col("text_element") != "section")
    clauses = match.partition_clauses(fa)["clauses"]
    names = clauses.select(task, F.explode(F.array(F.struct("section", "identifier"), F.struct(F.col("sub_section").alias("section"), "identifier"))).alias("n")).select(task, F.col("n.section").alias("text"), "n.identifier").where("text is not null")
    names = names.groupBy(task, "text").agg(F.min("identifier").alias("identifier"))
    name_vectors = match.embed_distinct(names, embed=embed)
    s = rows.where(listing).select(task, F.col("processed").alias("asked")).distinct().join(q, [task, "asked"])
    by_name = match.cosine_top_k(s, names.join(name_vectors, "text").select(task, F.col("text").alias("term"), "embedding"), match.PER_SECTION, query_id="asked", row_id="term", by=[task])
    by_name = by_name.join(names.withColumnRenamed("text", "term"), [task, "term"]).withColumn("match_type", F.lit("section"))
    cols = [task, "asked", "term", "identifier", "similarity", "match_type"]
    raw = fa.select(task, match.feature_text("FA").alias("term"), "text", pos).groupBy(task, "term").agg(F.max_by("text", pos).alias("raw"))
    best = match.best_per_identifier(hits.select(*cols).unionByName(by_name.select(*cols)), [task, "asked"])
    best = best.join(raw, [task, "term"], "left").withColumn("term", F.coalesce("raw", "term")).drop("raw")
    lists = match.assemble(best, [task, "asked"])
    out = rows.join(lists.withColumnRenamed("asked", "processed"), [task, "processed"], "left")
    out = out.withColumns({"ts_term": F.col("section"), "ts_text": F.col("text"), "hits": F.coalesce("hits", F.array().cast(f"array<{HIT}>"))})
    out = out.withColumn("hits", F.when(F.coalesce(listing, F.lit(False)), F.col("hits")).otherwise(match.merge_identifiers(F.col("hits"), compat)))
    out = match.inject_rules(out, fa, doc=task, pos=pos, top=top)
    out = match.schedule_priority(out, fa, doc=task, compat=compat)
    out = out.withColumn("hits", match.trim(F.col("hits"), top))
    out = match.decorated(out, match.heading_by_identifier(fa, doc=task, pos=pos, compat=compat), doc=task)
    return match.in_order(out, by=[task], order=[pos])


def figures(fb: DataFrame, *, by: str = "task_id", compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row per task, the same in long form for a report)."""
    kpi = feedback.kpis(fb, by=by, compat=compat)
    return kpi, export.long_form(kpi, by=by)


def in_tasks(df: DataFrame, tasks: Column) -> DataFrame:
    """Rows of given tasks; a filter on the partition column, so that other tasks' files aren't read."""
    return df.where(tasks)
