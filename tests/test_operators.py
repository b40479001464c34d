"""Stateful operators against plain versions, and the ways through from end to end."""

import io
import json
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.operators import export as X
from clausewright.operators import extract as E
from clausewright.operators import feedback as A
from clausewright.operators import layout as L
from clausewright.operators import lookup as Q
from clausewright.operators import match as M
from clausewright.operators import pairs as N
from clausewright.operators import rows as R
from clausewright.operators import validate as V
from clausewright.plans import lifecycle
from clausewright.queries import clauses, layout
from clausewright.sources import documents, sinks

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def naive_groups(tokens, near=30):
    """One pass with a buffer: what the windows must give."""
    out, last = [], None
    for i, (tag, page, text, y) in enumerate(tokens):
        box = [0, y, 10, y + 5]
        keep = i == 0 or tag not in ("footer", "reference")
        if keep and not (tag == "section" and text == ":"):
            limit = {"section": 5, "paragraph": 10}.get(tag, near)
            joins = False
            if last is not None:
                ltag, lpage, lbox = last
                gap = min(abs(a - b) for a in (box[1], box[3]) for b in (lbox[1], lbox[3]))
                joins = tag == ltag and (page == lpage and gap <= limit or page != lpage and tag != "section")
            if joins and out:
                out[-1][1] += " " + text
            else:
                out.append([tag, text])
        last = (tag, page, box)
    return [tuple(x) for x in out]


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["section", "paragraph", "list", "footer"]), st.integers(1, 2), st.sampled_from(["a", "b", ":"]), st.integers(0, 60)), min_size=1, max_size=12))
def test_grouping_equals_one_pass(spark, tokens):
    tokens = sorted(tokens, key=lambda t: t[1])
    rows = [("d", p, i, t, [0, y, 10, y + 5], g) for i, (g, p, t, y) in enumerate(tokens)]
    df = spark.createDataFrame(rows, "doc_id string, page_id int, pos int, text string, box array<int>, tag string")
    got = [(r.tag, r.text) for r in L.group_elements(df, line_most=F.lit(30)).orderBy("pos").collect()]
    assert got == naive_groups(tokens)


def naive_merge(ids):
    key = lambda s: __import__("re").sub(r'[()_\[\].%"]', "TEST", s)
    slots = []
    for i in ids:
        if "-" in i:
            t, _, s = i.split("-")[-1].partition("_")
            hit = False
            for n, m in enumerate(slots):
                if "-" in m:
                    mt, _, ms = m.split("-")[-1].partition("_")
                    if mt == t and (not ms or s and key(ms) in key(s)):
                        slots[n], hit = i, True
            if not hit and not any("-" in m and m.split("-")[-1].partition("_")[0] == t and key(s) in key(m.split("-")[-1].partition("_")[2]) for m in slots):
                slots.append(i)
        else:
            hit = False
            for n, m in enumerate(slots):
                if key(m) in key(i):
                    slots[n], hit = i, True
            if not hit and not any(key(i) in key(m) for m in slots):
                slots.append(i)
    return list(dict.fromkeys(slots))


@SLOW
@given(st.lists(st.sampled_from(["Cl_2.1", "Cl_2.1(a)", "Cl_2.10", "Cl_20.1", "Cl_1.1-Borrower", "Cl_1.1-Borrower_(a)", "Cl_1.1-Security_(b)", "Parties", "Sched_1.A"]), max_size=7, unique=True))
def test_merge_equals_fold(spark, ids):
    hits = [("t" + i, i, 1.0 - n / 10, "content") for n, i in enumerate(ids)]
    df = spark.createDataFrame([(hits,)], f"hits array<{M.HIT}>")
    got = [h.identifier for h in df.select(M.merge_identifiers(F.col("hits")).alias("h")).first().h]
    assert list(dict.fromkeys(got)) == naive_merge(ids)


def test_merge_strict_asks_for_a_whole_number(spark):
    df = spark.createDataFrame([([("a", "Cl_2.1", 0.9, "content"), ("b", "Cl_2.10", 0.8, "content")],)], f"hits array<{M.HIT}>")
    ids = lambda c: [h.identifier for h in df.select(M.merge_identifiers(F.col("hits"), c).alias("h")).first().h]
    assert ids(True) == ["Cl_2.10"] and ids(False) == ["Cl_2.1", "Cl_2.10"]


FEEDBACK = "task_id int, pos int, ts_term string, ts_text string, identifier_list array<string>, match_term_list array<string>, result array<boolean>, is_irrelevant boolean, manual_identifier array<string>, manual_content array<string>"
RECORDS = [
    (1, 0, "T", "x", ["Cl_1", "Parties-A"], ["a", "b"], None, False, None, None),  # accepted by default
    (1, 1, "T", "x", None, None, None, False, None, None),  # nothing found
    (1, 2, "U", "x", ["Cl_1"], ["a"], None, True, None, None),  # marked irrelevant
    (1, 3, "U", "x", ["Cl_1", "Sched_1"], ["a", "b"], [False, False], False, None, None),  # all wrong
    (1, 4, "V", "x", ["Cl_1", "Sched_1"], ["a", "b"], [False, False], False, ["Cl_9", "", "Cl_8-X", "Cl_7"], ["m", "n", "o", "p"]),
    (1, 5, "W", "x", ["Cl_1", "Sched_1", "Cl_2-D"], ["a", "b", "c"], [True, True, False], False, ["Cl_3"], ["q"]),
]


def test_kpis(spark):
    k = A.kpis(spark.createDataFrame(RECORDS, FEEDBACK)).first()
    assert (k.hit_count, k.miss_count, k.term_count, k.term_content_count, k.irrelevant_content_count, k.hit_instance_count) == (3, 3, 4, 6, 1, 2)
    assert (k.manual_count, k.manual_instance_count, k.avg_accuracy, k.top1_hit_count, k.up_to_top2_hit_count, k.top1_hit_rate) == (4, 2, 50.0, 2, 3, 33.33)
    assert (k.clause_hit_count, k.schedule_hit_count, k.definitionClause_miss_count, k.clause_miss_count, k.top_miss_term) == (1, 1, 1, 3, "W")
    assert A.top_miss(spark.createDataFrame(RECORDS, FEEDBACK), compat=False).first().top_miss_term == "V"


def test_kpis_of_nothing(spark):
    nothing = spark.createDataFrame([RECORDS[1]], FEEDBACK)
    assert A.kpis(nothing).first().avg_accuracy is None
    with pytest.raises(Exception, match="neither hits nor misses"):
        A.checked(A.kpis(nothing)).collect()
    assert A.kpis(spark.createDataFrame([], FEEDBACK)).count() == 0


def test_pairs(spark):
    p = N.sentence_pairs(spark.createDataFrame(RECORDS, FEEDBACK)).collect()
    assert sorted((r.label, r.is_manual_content) for r in p).count(("entailment", True)) == 5
    assert sum(r.label == "contradiction" for r in p) == 5 and sum(r.label == "entailment" and not r.is_manual_content for r in p) == 4


def test_judgements(spark):
    got = {r.pos: r.o for r in spark.createDataFrame(RECORDS, FEEDBACK).select("pos", X.overall(F.col("result"), F.col("is_irrelevant"), F.col("manual_identifier")).alias("o")).collect()}
    assert got == {0: "N/A", 1: "N/A", 2: "N/A", 3: "N/A", 4: "All Not Matched", 5: "Partially Matched"}


def test_nearest_ancestor(spark):
    rows = [("d", 0, 1, "(a)", "A1"), ("d", 0, 2, "(a)(i)", "x"), ("d", 0, 3, "(a)", "A2"), ("d", 0, 9, "(b)(i)(x)", "y"), ("d", 0, 8, "(b)(i)", "B"), ("d", 0, 4, None, "n")]
    df = spark.createDataFrame(rows, "doc_id string, text_block_id int, pos int, list_id string, text string")
    got = {r.pos: (r.parent_list_ids, r.parent_list) for r in R.nearest_ancestors(df, by=["doc_id", "text_block_id"]).collect()}
    assert got == {1: (None, None), 2: (["(a)"], "A1"), 3: (None, None), 4: (None, None), 8: (None, None), 9: (["(b)(i)"], "B")}


AGREEMENT = [
    ("section", None, "CONTENTS"), ("paragraph", None, "THIS AGREEMENT is dated 1 May 2024"), ("paragraph", None, 'ALPHA LIMITED as borrower (the "Borrower")'), ("paragraph", None, "IT IS AGREED as follows"),
    ("section", None, "1. DEFINITIONS AND INTERPRETATION"), ("sub_section", None, "1.1 Definitions"), ("paragraph", None, '"Margin" means two per cent.'), ("section", None, "2. PREPAYMENT"), ("sub_section", None, "2.1 Voluntary prepayment"),
    ("list", "(a)", "first limb"), ("list", "(a)(i)", "detail"), ("list", "(b)", "second limb"), ("section", None, "SCHEDULE 1 THE ORIGINAL LENDERS"), ("section", None, "PART A lenders"), ("paragraph", None, "names of lenders"),
]


def stacked(spark, docs):
    rows = [(d, 0, i * 10, e, l, t, None, "1") for d, lines in docs.items() for i, (e, l, t) in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, text_block_id int, pos long, text_element string, list_id string, text string, bbox array<int>, page_id string")


def test_agreement(spark):
    rows, errors = E.extract_agreement(stacked(spark, {"d": AGREEMENT, "bad": AGREEMENT[:3], "none": AGREEMENT[:12]}))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    found = {r.text: r for r in rows.where("doc_id = 'd'").collect()}
    assert found['"Margin" means two per cent.'].identifier == "Cl_1.1-Margin"
    assert found["first limb"].identifier == "Cl_2.1(a)" and found["detail"].identifier == "Cl_2.1(a)(i)" and found["detail"].parent_list == "first limb"
    assert found['ALPHA LIMITED as borrower (the "Borrower")'].identifier == "Parties-Borrower"
    assert E.split_embedded_sections(stacked(spark, {"d": [("list", None, "the end. 12.3 Next clause"), ("list", None, "one. two")]})).orderBy("pos").select("text").collect() == [("the end.",), ("12.3 Next clause",), ("one. two",)]
    assert found["PART A lenders"].identifier == "Sched_1.A" and found["first limb"].section == "PREPAYMENT"
    assert {(r.doc_id, r.message.split()[-1]) for r in errors.collect()} == {("bad", "found"), ("none", "found")}
    assert rows.where("doc_id != 'd'").count() == 0
    assert "parentListIds" in E.camel_case(rows).columns


def test_summary(spark):
    ts = [("section", None, "Borrower:"), ("paragraph", None, "Alpha Limited"), ("section", None, "Security:"), ("list", None, "• charge over shares • account charge"), ("section", None, "Documentation:"), ("paragraph", None, "terms, including A, B and C"), ("section", None, "to"), ("section", None, "Items")]
    rows = [("t", i // 2, i * 10, e, l, t, None, "1") for i, (e, l, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id string, text_block_id int, pos long, text_element string, list_id string, text string, bbox array<int>, page_id string")
    bank = spark.createDataFrame([("Borrower",), ("Security",), ("Documentation",)], "name string")
    got = [(r.section, r.text_element, r.text) for r in E.extract_summary(df, bank).orderBy("pos").collect()]
    assert ("Security", "list", "charge over shares") in got and ("Security", "list", "account charge") in got
    assert ("Documentation", "paragraph", "terms") in got and ("Borrower", "paragraph", "Alpha Limited") in got


def test_match_from_end_to_end(spark, tmp_path):
    E.extract_agreement(stacked(spark, {"d": AGREEMENT}))[0].withColumnRenamed("doc_id", "file_id").write.parquet(str(tmp_path / "fa"))
    fa = spark.read.parquet(str(tmp_path / "fa"))  # matching reads the rows of agreements several times, so they are stored first
    ts = spark.createDataFrame([("d", 0, "Margin", "section", "Margin"), ("d", 1, "Margin", "paragraph", "two per cent margin"), ("d", 2, "Prepayment", "paragraph", "voluntary prepayment first limb"), ("d", 3, "Events of Default", "paragraph", "prepayment")], "file_id string, pos int, section string, text_element string, text string")
    lifecycle.match_rows(ts, fa).write.parquet(str(tmp_path / "m"))
    found = spark.read.parquet(str(tmp_path / "m"))
    got = {r.pos: r.hits for r in found.collect()}
    assert any(h.identifier.startswith("Cl_1.1-Margin") for h in got[1])
    assert any(h.identifier.startswith("Cl_2.1") for h in got[2]) and all(len(h) <= 5 for h in got.values())
    assert any(h.match_type == "section" for h in got[3])
    api = M.api_rows(found, F.lit(9), by=["file_id"], order=["pos"]).orderBy("id").collect()
    assert api[0].result is None and api[1].result == [False] * 5 and [r.id for r in api] == [0, 1, 2, 3]


def test_schedule_priority(spark):
    hits = [("a", "Cl_1", 0.9, "content"), ("b", "Sched_2", 0.8, "content"), ("c", "Cl_3", 0.7, "content")]
    m = spark.createDataFrame([("r", "d", "Security", "x", "paragraph", hits)], f"row_id string, file_id string, ts_term string, ts_text string, text_element string, hits array<{M.HIT}>")
    fa = spark.createDataFrame([("d", "Security Documents", None, "Sched_2")], "file_id string, schedule string, definition string, identifier string")
    compat = M.schedule_priority(m, fa).first().hits
    assert [(h.identifier, h.similarity) for h in compat] == [("Sched_2", 0.9), ("Cl_1", 0.8), ("Cl_3", 0.7)]
    assert M.schedule_priority(m, fa, compat=False).first().hits[0].similarity == 0.8


def test_lookup(spark):
    cl = spark.createDataFrame([("f", 1, 0, [0, 0, 10, 10], "Cl_1", "The Agent shall act"), ("f", 1, 1, [5, 5, 20, 20], "Cl_2", "other words entirely"), ("f", 1, 2, [500, 500, 510, 510], "Cl_3", "the agent")], "file_id string, page_id int, pos int, box array<int>, identifier string, text string")
    ask = spark.createDataFrame([(1, "f", 1, [8, 8, 9, 9], "other WORDS entirely"), (2, "f", 1, [8, 8, 9, 9], "agent shall"), (3, "f", 2, [8, 8, 9, 9], "x"), (4, "f", 1, [8, 8, 9, 9], None)], "id int, file_id string, page_id int, box array<int>, text string")
    got = {r.id: r.identifier for r in Q.find_clause(ask, cl).collect()}
    assert got == {1: "Cl_2", 2: "Cl_1", 3: None, 4: "Cl_1"}


def test_heading_guard_of_long_lines(spark, tmp_path):
    """Lines of over ten words that aren't in capitals: in heading case they are kept, otherwise they get null."""
    kept, prose = "Right of Prepayment and Cancellation of the Facility by Each Original Borrower or Guarantor", "the Borrower shall repay each loan in full on the last day of its interest period"
    spark.createDataFrame([(1, f"{kept}\n{prose}\n\nshort line")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.pos: r.heading for r in clauses.QUERIES["heading_guard_lines"](spark, str(tmp_path)).collect()}
    assert len(kept.split()) > 10 and got == {0: kept, 1: None, 3: "short line"}


def _box_rows(spark, tmp_path):
    """Lines of one supplier's page; by hand: box i is at x = price % 900 and y = orderkey % 950."""
    at = [(0, 0), (300, 300), (1, 1), (600, 600)] + [(20 + i * 3 % 700, 10 + i * 7 % 900) for i in range(60)]
    rows = [(950 * i + y, 7, 7, 1 + i % 4, 40.0, float(x), "A", "F") for i, (x, y) in enumerate(at)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    return {i + 1: (x, y, x + 40, y + (1 + i % 4) * 5) for i, (x, y) in enumerate(at)}


def test_overlaps_of_boxes_that_are_not_neighbours(spark, tmp_path):
    box = _box_rows(spark, tmp_path)
    hit = lambda a, b: not (a[0] > b[2] or b[0] > a[2] or a[1] > b[3] or b[1] > a[3])
    stated = [p for p in box if (7 * 7 + 0 + p) % 50 == 0]
    want = {(p, o) for p in stated for o in box if o != p and hit(box[p], box[o])}
    got = [(r.pos, r.other_pos) for r in layout.QUERIES["bbox_overlaps_on_page"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (1, 3) in want


def test_lookup_of_stated_rows(spark, tmp_path):
    """More than the first box of a page is looked up, each with its own box."""
    box = _box_rows(spark, tmp_path)
    got = {r.id for r in layout.QUERIES["clause_lookup_stated"](spark, str(tmp_path)).collect()}
    assert got == {f"7.0.{p}" for p in box if (7 * 7 + 0 + p) % 50 == 0} == {"7.0.1", "7.0.51"}


def test_validation(spark):
    df = spark.createDataFrame([("f", 1, 0, None, "1", "x" * 600, None), ("f", 2, 0, 1, "2", "ok", None)], "file_id string, index int, text_block_id int, phrase_id int, page_id string, text_element string, list_id string")
    got = {r.field: (r.broken, r.examples) for r in V.violations(df, V.TS_RULES, by=["file_id"]).collect()}
    assert got["phrase_id"] == (1, [1]) and got["text_element"] == (1, [1]) and got["page_id"] == (0, [])
    good, bad = V.split_valid(df, V.TS_RULES)
    assert good.count() == 1 and bad.first().broken_fields == ["phrase_id", "text_element"]


def test_broken_positions_are_all_there(spark):
    df = spark.range(60).select(F.lit("hot").alias("source"), F.col("id").alias("index"), F.when(F.col("id") % 2 == 0, F.lit("x" * 3)).alias("text"))
    rules = [V.Rule("text", False, 2), V.Rule("index", False)]
    got = sorted(tuple(r) for r in V.broken_positions(df, rules, by=["source"]).collect())
    assert got == [("hot", "text", i) for i in range(60)]
    assert {r.field: r.broken for r in V.violations(df, rules, by=["source"]).collect()} == {"text": 60, "index": 0}


def test_sources_and_sinks(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", "<w><w14:scene3d><x/></w14:scene3d>kept</w>")
    (tmp_path / "My TS.DOCX").write_bytes(docx.getvalue())
    (tmp_path / "agreements.pdf").write_bytes(b"x")
    f = {r.path.rsplit("/", 1)[1]: (r.file_type, r.extension) for r in documents.files(spark, str(tmp_path)).collect()}
    assert f["agreements.pdf"] == ("TS", "pdf") and list(f.values()).count(("TS", "docx")) == 1
    assert documents.files(spark, str(tmp_path), compat=False).where("path like '%agreements%'").first().file_type == "other"
    raw = documents.clean_docx(documents.files(spark, str(tmp_path), content=True).where("extension = 'docx'")).first().content
    assert zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml") == b"<w>kept</w>"
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.jsonl").write_text(json.dumps({"doc_id": "d", "page_id": 1, "width": 600, "height": 800, "spans": [{"text": "two words", "box": [0, 0, 300, 10], "tag": "section"}]}) + "\n")
    documents.register(spark)
    assert [r.text for r in spark.read.format("page_tokens").option("granularity", "word").load(str(pages)).collect()] == ["two", "words"]
    assert spark.read.format("page_tokens").load(str(pages)).first().box == [0, 0, 500, 12]
    csv = spark.createDataFrame([("a", ["x", "y"]), (None, None)], "k string, v array<string>")
    sinks.write_csv(csv, str(tmp_path / "csv"))
    assert sorted(documents.read_rows(spark, str(tmp_path / "csv"), "k string, v array<string>").collect(), key=str) == sorted(csv.collect(), key=str)
    book = zipfile.ZipFile(io.BytesIO(sinks.xlsx({"s": csv.select("k")})))
    assert b"<t xml:space=\"preserve\">a</t>" in book.read("xl/worksheets/sheet1.xml")
    assert b"kept" not in sinks.bundle({"a": b"z"}) and b"w:tbl" in zipfile.ZipFile(io.BytesIO(sinks.docx("T", {"t": csv.select("k")}))).read("word/document.xml")
    sinks.update_status(spark, str(tmp_path / "status"), kind="doc", key=1, status="done")
    assert sinks.latest_status(spark.read.parquet(str(tmp_path / "status"))).first().status == "done"
    assert [r.reachable for r in sinks.health(spark, [str(tmp_path), str(tmp_path / "nowhere")]).collect()] == [True, False]


def test_parse_tokens(spark):
    rows = [("d", 1, i, t, [0, y, 900, y + 10], g, "x") for i, (t, y, g) in enumerate([("1. TITLE", 100, "section"), ("first", 130, "paragraph"), ("line", 142, "paragraph"), ("2. NEXT", 300, "section"), ("• item", 330, "list")])]
    tokens = spark.createDataFrame(rows, "doc_id string, page_id int, pos int, text string, box array<int>, rule_tag string, font string")
    blocks = lifecycle.parse(tokens, term_sheet=False).orderBy("block_id", "pos").collect()
    assert [(b.block_id, b.key, b.text) for b in blocks] == [(0, "section", "1. TITLE"), (0, "paragraph", "first line"), (1, "section", "2. NEXT"), (1, "list", "• item")]


def test_streaming_figures(spark, tmp_path):
    from clausewright.streaming import feedback as S

    src = spark.createDataFrame(RECORDS, FEEDBACK)
    src.write.parquet(str(tmp_path / "in"))
    q = S.keep_figures(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    t = S.totals(spark.read.parquet(str(tmp_path / "out"))).first()
    assert (t.hit_count, t.miss_count, t.avg_accuracy) == (3, 3, 50.0)


def test_vectors_without_length_and_blocks(spark):
    """A vector of zeros is as near as 0 and fails nothing; small blocks give the rows that one block gives."""
    import random

    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(3)]) for i in range(60)] + [(60, [0.0] * 3), (61, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.where("id % 7 = 0 or id = 60").withColumnRenamed("id", "q")
    got = [{tuple(r) for r in M.cosine_top_k(q, df, 5, query_id="q", row_id="id", digits=6, query_block=a, row_block=b).collect()} for a, b in ((4096, 8192), (3, 7))]
    by = M.cosine_top_k(q.withColumn("g", F.lit(1)), df.withColumn("g", F.lit(1)), 5, query_id="q", row_id="id", by=["g"], digits=6)
    assert got[0] == got[1] == {tuple(r)[1:] for r in by.collect()} and len(got[0]) == 5 * q.where("embedding is not null").count()
    assert {(r[1], r[2]) for r in got[0] if r[0] == 60} == {(i, 0.0) for i in range(5)}
    assert spark.sql("select array(0d, 0d) a, array(1d, 0d) b").select(M.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_parts_keep_their_order_however_many(spark):
    """A text of a hundred parts, and a block of more than a thousand elements."""
    text = " ".join(f"x{i}. 12.{i} Next" for i in range(100))
    got = E.split_embedded_sections(stacked(spark, {"d": [("list", None, text), ("list", None, "last")]}))
    assert got.select("pos").distinct().count() == got.count() == 102
    order = [r.text for r in got.orderBy("pos").collect()]
    assert order[0] == "x0." and order[-1] == "last" and [t.split()[0] for t in order[1:-1]] == [f"12.{i}" for i in range(100)]
    element = "struct<key:string,order:int,list_id:string,text:array<string>,is_table:boolean,table_json:string,bbox:array<int>,page_id:array<int>>"
    block = lambda b: (b, [("paragraph", i, None, [f"{b}:{i}"], False, None, None, None) for i in range(1200)])
    parsed = spark.createDataFrame([("d", [block(0), block(1)])], f"doc_id string, content array<struct<id:int,elements:array<{element}>>>")
    assert [r.text for r in E.tidy(E.stack_elements(parsed)).orderBy("pos").collect()] == [f"{b}:{i}" for b in (0, 1) for i in range(1200)]


def test_summary_lifecycle_splits_long_lists(spark):
    blocks = [("t", 0, 0, "section", "Covenants:"), ("t", 0, 1, "paragraph", "rent, rates, water, gas, power"), ("t", 1, 2, "section", "Borrower:"), ("t", 1, 3, "paragraph", "rent, rates, water, gas, power")]
    rows = [(*b, [0, 0, 1, 1], [1], 0) for b in blocks]
    df = spark.createDataFrame(rows, "doc_id string, block_id int, pos long, element string, text string, box array<int>, page_ids array<int>, n_in_block int")
    bank = spark.createDataFrame([("Borrower",), ("Covenants",)], "name string")
    got = [(r.section, r.text) for r in lifecycle.summary_rows(df, bank).rows.orderBy("pos").collect()]
    assert got.count(("Borrower", "rent, rates, water, gas, power")) == 1 and sum(s == "Covenants" for s, _ in got) > 3


def test_package_is_sent_to_other_machines():
    from clausewright import shipping

    class Context:
        applicationId, sent = "app-test", []

        def __init__(self, master):
            self.master = master

        def addPyFile(self, path):
            self.sent.append(path)

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    shipping.ship(Session("spark://host:7077"))
    assert len(Context.sent) == 1
    with zipfile.ZipFile(Context.sent[0]) as z:
        assert "clausewright/operators/match.py" in z.namelist()
    shipping.ship(Session("spark://host:7077"))
    assert len(Context.sent) == 1
