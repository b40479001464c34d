"""Matching summary rows with clauses: features, exact cosine top-k, rules, merging and re-ranking.

Matches of a row are an array of structs in rank order, ``array<struct<term, identifier, similarity, match_type>>``;
parallel arrays are made at the edge by to_arrays().
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clausewright.functions import identifiers as I
from clausewright.functions import patterns as P
from clausewright.functions.text import drop_clause_number

TOP_N, PER_TYPE, PER_SECTION, LONGEST = 5, 40, 10, 80
HIT = "struct<term:string,identifier:string,similarity:double,match_type:string>"


def _some(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def feature_text(doc_type: str, *, parents: bool = False) -> Column:
    """``section - sub-section: [caption] [list: ]text`` of a row; null for a row without text.

    Heading rows stand alone, without their number.  Sections called definitions or interpretation say nothing in an
    agreement, and neither do those called documentation in a summary.
    """
    heading = F.col("text_element").contains("section")
    none = F.lit(None).cast("string")
    text = _some(F.col("text"))
    if doc_type == "FA":
        text = F.when(heading, drop_clause_number(text)).otherwise(text)
        useful = lambda c: F.when(~F.coalesce(c.rlike("(?i)definition|interpretation"), F.lit(False)), c)
        sub_row = F.col("text_element").contains("sub_section")
        section = useful(F.when(~heading | sub_row, _some(F.col("section"))))
        sub = useful(F.when(~heading, _some(F.col("sub_section"))))
    else:
        section = F.when(~heading, _some(F.col("section")))
        section = F.when(~F.coalesce(section.rlike("(?i)documentation"), F.lit(False)), section)
        sub = none
    caption, parent = (F.when(~heading, _some(F.col(c))) if parents else none for c in ("parent_caption", "parent_list"))
    head = _some(F.concat_ws(" - ", section, sub))
    body = F.concat_ws(" ", caption, F.concat_ws(": ", parent, text))
    return F.when(text.isNotNull(), F.concat_ws(": ", head, body))


def heading_by_identifier(fa: DataFrame, *, doc: str = "file_id", pos: str = "pos", compat: bool = False) -> DataFrame:
    """(doc, identifier, heading) of every identifier: the heading of its first row.

    With compat the first row whose identifier *contains* it counts, so ``Cl_1`` may take the heading of ``Cl_10``: a
    join of a document's identifiers with themselves, quadratic in one document.
    """
    rows = fa.where(F.col("identifier").isNotNull()).select(doc, pos, "identifier", I.heading_of(*(F.col(c) for c in ("schedule", "section", "sub_section"))).alias("heading"))
    first = rows.groupBy(doc, "identifier").agg(F.min_by(F.struct("heading"), pos).alias("h"), F.min(pos).alias("at"))
    if not compat:
        return first.select(doc, "identifier", F.col("h.heading").alias("heading"))
    other = first.select(doc, F.col("identifier").alias("longer"), "h", "at")
    pairs = first.select(doc, "identifier").join(other, doc).where(F.col("longer").contains(F.col("identifier")))
    return pairs.groupBy(doc, "identifier").agg(F.min_by("h", "at").alias("h")).select(doc, "identifier", F.col("h.heading").alias("heading"))


def definition_texts(fa: DataFrame, *, doc: str = "file_id", pos: str = "pos") -> DataFrame:
    """(doc, definition, text): all texts of a definition, one to a line; of several places that define it, the last."""
    keys = ["section_id", "sub_section_id", "definition"]
    rows = fa.where(F.col("definition").isNotNull() & F.col("text").isNotNull())
    whole = rows.groupBy(doc, *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.groupBy(doc, "definition").agg(F.max_by("text", F.struct("section_id", "sub_section_id")).alias("text"))


def partition_clauses(fa: DataFrame) -> dict[str, DataFrame]:
    """parties, definitions, schedules and clauses of an agreement's rows."""
    meaning = F.coalesce(F.col("section").rlike("(?i)DEFINITION|INTERPRETATION"), F.lit(False))
    other = fa.where(~meaning & F.coalesce(F.col("section_id") != "0", F.lit(True)) & ~F.coalesce(F.col("section").isin("PARTIES", "TABLE OF CONTENTS"), F.lit(False)))
    return {
        "parties": fa.where((F.col("section") == "PARTIES") & F.col("definition").isNotNull()),
        "definitions": fa.where(F.col("definition").isNotNull()),
        "schedules": other.where(F.col("schedule").isNotNull()),
        "clauses": other.where(F.col("schedule").isNull() & F.col("section").isNotNull()),
    }


def candidates(fa: DataFrame, *, doc: str = "file_id", pos: str = "pos") -> DataFrame:
    """Distinct (doc, text, identifier) that a summary row may match: feature texts, and terms of definitions and parties."""
    content = fa.select(doc, feature_text("FA").alias("text"), "identifier")
    parts = partition_clauses(fa)
    w = Window.partitionBy(doc, "section_id", "sub_section_id", "definition").orderBy(pos)
    terms = parts["definitions"].withColumn("n", F.row_number().over(w)).where("n = 1").select(doc, F.col("definition").alias("text"), "identifier")
    parties = parts["parties"].select(doc, F.col("definition").alias("text"), "identifier")
    return content.unionByName(terms).unionByName(parties).where("text is not null and text != ''").distinct()


def hashed_embedding(size: int = 256) -> Callable[[pd.Series], pd.Series]:
    """A stand-in for a sentence encoder: signed hashed counts of words and word pairs, at unit length."""

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v, words = np.zeros(size), (t or "").lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return pd.Series(out)

    return embed


def embed_distinct(df: DataFrame, text: str = "text", *, embed: Callable[[pd.Series], pd.Series] | None = None, out: str = "embedding") -> DataFrame:
    """(text, embedding) of each distinct text: a model sees a text once."""
    run = F.pandas_udf(embed or hashed_embedding(), T.ArrayType(T.DoubleType()))
    return df.select(text).where(F.col(text).isNotNull()).distinct().withColumn(out, run(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one of them has no length."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def _unit(vector: str) -> Column:
    """A vector at unit length; one without length stays as it is, so that it is as near to all others as 0."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.sqrt(dot(F.col(vector), F.col(vector)))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _best_of_block(k: int, digits: int | None, keys: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``k`` rows of a block for each query of a block, by matrix products of some queries at a time."""
    some = 256

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        form = {c: left.schema.field(c).type for c in keys} | {"__qid": left.schema.field("__qid").type, "__rid": right.schema.field("__rid").type, "similarity": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in form.items()})
        right = right.sort_by("__rid")
        q, r = (np.asarray(t.column("v").combine_chunks().flatten(), float).reshape(t.num_rows, -1) for t in (left, right))
        few, at, best, found = min(k, len(r)), [], [], []
        for begin in range(0, len(q), some):
            sim = q[begin : begin + some] @ r.T
            if digits is not None:
                sim = np.trunc(sim * 10**digits + np.copysign(0.5, sim)) / 10**digits
            least = np.partition(sim, len(r) - few, axis=1)[:, len(r) - few]
            for i, row in enumerate(sim):
                near = np.flatnonzero(row >= least[i])
                near = near[np.argsort(-row[near], kind="stable")[:few]]  # rows stand by id, so ties go to the lesser
                at.append(np.full(len(near), begin + i))
                best.append(near)
                found.append(row[near])
        at, best = pa.array(np.concatenate(at)), pa.array(np.concatenate(best))
        return pa.table({**{c: left.column(c).take(at) for c in keys}, "__qid": left.column("__qid").take(at), "__rid": right.column("__rid").take(best), "similarity": np.concatenate(found)})

    return run


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, *, query_id: str, row_id: str, by: list[str] | None = None, vector: str = "embedding", query_block: int = 4096, row_block: int = 8192, digits: int | None = None) -> DataFrame:
    """(by, query_id, row_id, similarity, rank): the exact ``k`` nearest rows of each query.

    Vectors are scaled once.  Every query meets every row of its ``by`` (a document or task; without it, of all): both are cut
    into blocks of about ``query_block`` and ``row_block``, a block of queries meets a block of rows in matrix products, and only
    the best ``k`` of a block leave it, so a large group is dealt over tasks as all rows are.  How many blocks a group has is
    counted in the plan itself.  Queries are copied to each block of rows; rows are copied only if there are more queries than
    one block holds.  Ties go to the lesser row id, after rounding to ``digits``; a vector without length is as near as 0; rows
    without a vector, or without one of ``by``, are left out.
    """
    keys = [f"__by{i}" for i in range(max(1, len(by or [])))]  # columns of their own, as both sides may come from one table
    groups = [F.col(c).alias(k_) for c, k_ in zip(by, keys, strict=True)] if by else [F.lit(0).alias(keys[0])]
    norm = lambda df, i, name: df.where(F.col(vector).isNotNull()).select(*groups, F.col(i).alias(name), _unit(vector).alias("v")).dropna(subset=keys)
    q, r = norm(queries, query_id, "__qid"), norm(rows, row_id, "__rid")
    counted = lambda df, size, out: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(out))
    sizes = counted(q, query_block, "__nq").join(counted(r, row_block, "__nr"), keys)
    if not by:
        sizes = F.broadcast(sizes)  # a single row
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes, keys).select(*keys, "__qid", "v", F.pmod(F.xxhash64("__qid"), F.col("__nq")).cast("int").alias("__i"), others("__nr").alias("__j"))
    right = r.join(sizes, keys).select(*keys, "__rid", "v", others("__nq").alias("__i"), F.pmod(F.xxhash64("__rid"), F.col("__nr")).cast("int").alias("__j"))
    form = ", ".join([*(f"`{c}` {q.schema[c].dataType.simpleString()}" for c in [*keys, "__qid"]), f"`__rid` {r.schema['__rid'].dataType.simpleString()}", "similarity double"])
    block = [*keys, "__i", "__j"]
    scored = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_best_of_block(k, digits, keys), form)
    w = Window.partitionBy(*keys, "__qid").orderBy(F.desc("similarity"), "__rid")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*(F.col(k_).alias(c) for c, k_ in zip(by or [], keys, strict=False)), F.col("__qid").alias(query_id), F.col("__rid").alias(row_id), "similarity", "rank")


def fan_out(hits: DataFrame, lookup: DataFrame, *, on: list[str]) -> DataFrame:
    """Each matched text with every identifier that has it; a text without one keeps its row."""
    return hits.join(lookup, on, "left")


def best_per_identifier(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of hits that repeat an identifier the most similar; hits without an identifier go."""
    w = Window.partitionBy(*keys, "identifier").orderBy(F.desc("similarity"), "term", "match_type")
    return hits.where(F.col("identifier").isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def assemble(hits: DataFrame, keys: list[str], most: int = LONGEST) -> DataFrame:
    """(keys, hits): each row's hits in rank order, at most ``most``."""
    item = F.struct((-F.col("similarity")).alias("s"), "identifier", "term", "match_type")
    ranked = F.slice(F.array_sort(F.collect_list(item)), 1, most)
    out = F.transform(ranked, lambda x: F.struct(x["term"].alias("term"), x["identifier"].alias("identifier"), (-x["s"]).alias("similarity"), x["match_type"].alias("match_type")))
    return hits.groupBy(*keys).agg(out.alias("hits"))


def merge_identifiers(hits: Column, compat: bool = True) -> Column:
    """Consolidate parent and child identifiers by a fold over hits in rank order.

    A slot's identifier that a later hit extends is replaced in place, keeping the slot's similarity; a later hit that
    a slot already extends is dropped.  Of definitions (with a dash) the terms must be equal, and the suffixes tell
    which extends which.  With compat, extending is containing, so ``Cl_2.1`` yields to ``Cl_2.10``; strict asks for the
    whole identifier up to a mark.
    """
    term = lambda c: F.split_part(F.element_at(F.split(c, "-"), -1), F.lit("_"), F.lit(1))
    suffix = lambda c: F.regexp_extract(F.element_at(F.split(c, "-"), -1), r"^[^_]*_(.*)$", 1)
    key = I.merge_key
    def within(short: Column, long: Column) -> Column:
        if compat:
            return F.contains(key(long), key(short))
        return F.startswith(long, short) & ~F.substring(long, F.length(short) + 1, F.lit(1)).rlike(r"[\dA-Za-z]")

    def extends(slot: Column, hit: Column) -> Column:
        both, neither = slot.contains("-") & hit.contains("-"), ~hit.contains("-")
        s, h = suffix(slot), suffix(hit)
        defined = (term(slot) == term(hit)) & ((s == "") | ((h != "") & within(s, h)))
        return (both & defined) | (neither & within(slot, hit))

    def covered(slot: Column, hit: Column) -> Column:
        both = slot.contains("-") & hit.contains("-")
        return (both & (term(slot) == term(hit)) & within(suffix(hit), suffix(slot))) | (~hit.contains("-") & within(hit, slot))

    def swap(slot: Column, hit: Column) -> Column:
        return F.when(extends(slot["identifier"], hit["identifier"]), F.struct(hit["term"].alias("term"), hit["identifier"].alias("identifier"), slot["similarity"].alias("similarity"), hit["match_type"].alias("match_type"))).otherwise(slot)

    def step(acc: Column, hit: Column) -> Column:
        taken = F.exists(acc, lambda s: extends(s["identifier"], hit["identifier"]))
        known = F.exists(acc, lambda s: covered(s["identifier"], hit["identifier"]))
        return F.when(taken, F.transform(acc, lambda s: swap(s, hit))).when(known, acc).otherwise(F.concat(acc, F.array(hit)))

    kept = F.filter(hits, lambda h: h["identifier"].isNotNull() & (h["identifier"] != ""))
    return F.array_distinct(F.aggregate(kept, F.array().cast(f"array<{HIT}>"), step))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]], names: tuple[str, str, str]) -> DataFrame:
    """Rules as rows, in order; their number is fixed in the library, so they may be broadcast."""
    rows = [(i, *r) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, " + ", ".join(f"{n} string" for n in names))


def _finds(pattern: str, text: str) -> Column:
    return F.expr(f"{text} RLIKE concat('(?i)', {pattern})")


def inject_rules(matches: DataFrame, fa: DataFrame, *, doc: str = "file_id", pos: str = "pos", rules: list | None = None, top: int = TOP_N) -> DataFrame:
    """Rule hits before the others, with similarity 1.

    A rule hits a row (not a section, with term and text) and a definition of its document if its three patterns are
    found in the row's term, its text and the definition.  A hit that is among the row's first ``top`` already isn't
    added.  A definition stands for its last row (the identifier a lookup by term gives).
    """
    spark = matches.sparkSession
    table = F.broadcast(rule_table(spark, rules or P.DEFINITION_RULES, ("section_rx", "text_rx", "definition_rx")))
    terms = fa.where(_some(F.col("definition")).isNotNull()).groupBy(doc, "definition").agg(F.max_by("identifier", pos).alias("identifier"))
    texts = definition_texts(fa, doc=doc, pos=pos).withColumnRenamed("text", "meaning")
    named = terms.join(table, _finds("definition_rx", "definition")).join(texts, [doc, "definition"], "left")
    rows = matches.where((F.col("text_element") != "section") & _some(F.col("ts_term")).isNotNull() & _some(F.col("ts_text")).isNotNull())
    asked = rows.select("row_id", doc, "ts_term", "ts_text").join(table, _finds("section_rx", "ts_term") & _finds("text_rx", "ts_text"))
    hits = asked.select("row_id", doc, "rule").join(named.select(doc, "rule", "definition", "identifier", "meaning"), [doc, "rule"])
    first = hits.groupBy("row_id", "identifier").agg(F.min(F.struct("rule", "definition", "meaning")).alias("h"))
    added = first.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("h.rule", "h.definition", "identifier", "h.meaning"))).alias("__added"))
    out = matches.join(added, "row_id", "left")
    have = F.transform(F.slice(F.coalesce("hits", F.array().cast(f"array<{HIT}>")), 1, top), lambda h: h["identifier"])
    out = out.withColumn("__have", have)
    fresh = F.filter(F.coalesce("__added", F.array().cast("array<struct<rule:int,definition:string,identifier:string,meaning:string>>")), lambda a: ~F.array_contains("__have", a["identifier"]))
    made = F.transform(fresh, lambda a: F.struct(a["meaning"].alias("term"), a["identifier"].alias("identifier"), F.lit(1.0).alias("similarity"), F.lit("rule").alias("match_type")))
    return out.withColumn("hits", F.concat(made, F.coalesce("hits", F.array().cast(f"array<{HIT}>")))).drop("__added", "__have")


def schedule_priority(matches: DataFrame, fa: DataFrame, *, doc: str = "file_id", first: int = 4, rules: list | None = None, compat: bool = True) -> DataFrame:
    """Hits in a schedule that a rule names for the row's section come first, up to ``first`` of them.

    The first rule whose section is found and that resolves to identifiers counts: those of matching schedules or,
    where there are none, of matching definitions.  With compat similarities stay in place while the rest moves.
    """
    table = F.broadcast(rule_table(matches.sparkSession, rules or P.SCHEDULE_RULES, ("section_rx", "text_rx", "schedule_rx")))
    in_sched = fa.where(_some(F.col("schedule")).isNotNull()).join(table, _finds("schedule_rx", "schedule")).select(doc, "rule", "identifier", F.lit(0).alias("kind"))
    in_defs = fa.where(_some(F.col("definition")).isNotNull()).join(table, _finds("schedule_rx", "definition")).select(doc, "rule", "identifier", F.lit(1).alias("kind"))
    ids = in_sched.unionByName(in_defs).groupBy(doc, "rule", "kind").agg(F.collect_set("identifier").alias("ids")).groupBy(doc, "rule").agg(F.min_by("ids", "kind").alias("ids"))
    rows = matches.where((F.col("text_element") != "section") & _some(F.col("ts_term")).isNotNull() & _some(F.col("ts_text")).isNotNull())
    named = rows.select("row_id", doc, "ts_term").join(table, _finds("section_rx", "ts_term")).join(ids, [doc, "rule"]).groupBy("row_id").agg(F.min_by("ids", "rule").alias("__ids"))
    out = matches.join(named, "row_id", "left")
    return out.withColumn("hits", F.when(F.col("__ids").isNull(), F.col("hits")).otherwise(move_first(F.col("hits"), lambda h: F.array_contains("__ids", h["identifier"]), first, compat))).drop("__ids")


def move_first(hits: Column, wanted: Callable[[Column], Column], first: int = 4, compat: bool = True) -> Column:
    """Up to ``first`` wanted hits, then the unwanted, then the other wanted ones."""
    yes, no = F.filter(hits, wanted), F.filter(hits, lambda h: ~wanted(h))
    moved = F.concat(F.slice(yes, 1, first), no, F.slice(yes, first + 1, F.greatest(F.size(yes), F.lit(1))))
    if not compat:
        return moved
    return F.zip_with(moved, hits, lambda m, h: F.struct(m["term"].alias("term"), m["identifier"].alias("identifier"), h["similarity"].alias("similarity"), m["match_type"].alias("match_type")))


def trim(hits: Column, n: int = TOP_N) -> Column:
    return F.slice(hits, 1, n)


def decorated(matches: DataFrame, headings: DataFrame, *, doc: str = "file_id") -> DataFrame:
    """Identifiers with their headings: hits are parted, joined with (doc, identifier, heading) and put together again."""
    each = matches.select("row_id", doc, F.posexplode("hits").alias("n", "h")).withColumn("identifier", F.col("h.identifier"))
    named = each.join(headings, [doc, "identifier"], "left")
    hit = F.struct(F.col("h.term").alias("term"), I.decorate(F.col("identifier"), F.col("heading")).alias("identifier"), F.col("h.similarity").alias("similarity"), F.col("h.match_type").alias("match_type"))
    back = named.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", hit.alias("hit")))), lambda x: x["hit"]).alias("__hits"))
    return matches.join(back, "row_id", "left").withColumn("hits", F.coalesce("__hits", "hits")).drop("__hits")


def to_arrays(matches: DataFrame) -> DataFrame:
    """Parallel arrays in place of structs, for readers that want those."""
    names = {"match_term_list": "term", "identifier_list": "identifier", "similarity_list": "similarity", "match_type_list": "match_type"}
    field = lambda f: F.transform("hits", lambda h: h[f])
    return matches.withColumns({n: field(f) for n, f in names.items()}).drop("hits")


def in_order(matches: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Matches as they are read: by task, then in the order of the summary's rows."""
    return matches.orderBy(*by, *order)


def api_rows(matches: DataFrame, task: Column, *, by: list[str], order: list[str], top: int = TOP_N) -> DataFrame:
    """Rows as they are stored: a running id from 0, the task, and a judgement of all false where there are hits."""
    w = Window.partitionBy(*by).orderBy(*order)
    has = F.size(F.coalesce("hits", F.array().cast(f"array<{HIT}>"))) > 0
    return to_arrays(matches.withColumns({"id": F.row_number().over(w) - 1, "task_id": task, "result": F.when(has & (F.col("text_element") != "section"), F.array_repeat(F.lit(False), top))}))


def child_texts(fa: DataFrame, *, doc: str = "file_id", pos: str = "pos") -> DataFrame:
    """(doc, identifier, text): a row's text with those of all rows below it, in order.

    Rows give their text to every prefix of their identifier that ends before a bracket or a dot, so parents are met
    by an equi join and not by comparing all pairs.
    """
    cuts = F.filter(F.sequence(F.lit(1), F.length("identifier")), lambda n: F.substring("identifier", n + 1, F.lit(1)).isin("(", ".", "_", "-", ""))
    rows = fa.where("identifier is not null and identifier != '' and text is not null").select(doc, pos, "text", F.explode(F.transform(cuts, lambda n: F.substring("identifier", F.lit(1), n))).alias("identifier"))
    own = fa.where("identifier is not null").select(doc, "identifier").distinct()
    return rows.join(own, [doc, "identifier"]).groupBy(doc, "identifier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), " ").alias("text"))


def distinct_in_order(items: Column) -> Column:
    """Distinct items, each at its first place."""
    return F.array_distinct(items)
