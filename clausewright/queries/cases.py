"""Queries that give operators rows of a closed grammar, made of whole driver tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import headings as H
from clausewright.functions import text as X
from clausewright.functions.geometry import font_flags as flags_of_font
from clausewright.operators import export as O
from clausewright.operators import extract as E
from clausewright.operators import layout as L
from clausewright.operators import lookup as Q
from clausewright.operators import match as M
from clausewright.operators import pairs as N
from clausewright.operators import tokenise as K
from clausewright.queries.tables import BOXES, LINES, boxes, lines, parted, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(None).cast("string") if x is None else F.lit(x)


def _each(df: DataFrame, names: str, rows: list[tuple]) -> DataFrame:
    """Every row of ``df`` with each of some rows, whose values may be its columns; ``n`` is their number."""
    fields = names.split()
    item = F.array(*(F.struct(*(_value(v).alias(f) for f, v in zip(fields, r, strict=True))) for r in rows))
    return df.select("*", F.posexplode(item).alias("n", "__t")).select("*", "__t.*").drop("__t")


def _nations(spark, sf_dir) -> DataFrame:
    """(doc_id, name): NATION 0, NATION 1, ..."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"))


NATIONS = "d AS (SELECT n_nationkey::BIGINT AS doc_id, replace(n_name, '_', ' ') AS name FROM nation)"


# -- text


@query(f"WITH {LINES} SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), ' ([.,;]) ', '\\1 ', 'g'), ' ([)\\]])', '\\1', 'g'), ' ([(\\[]) ', ' \\1', 'g'), '[“”]', '\"', 'g'), '’', '''', 'g')) AS cleaned FROM lines")
def short_clean(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", X.clean_spacing(F.col("text")).alias("cleaned"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, len(p_name)), lambda i: trim(p_name[1:i] || ' ' || p_name[i + 1:])), '|') AS variants FROM part")
def spaced_variants(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.spaced_variants(F.col("p_name")), "|").alias("variants"))


@query("SELECT s_suppkey, s_name AS heading FROM supplier")
def trim_heading(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", X.trim_heading(F.concat(F.col("s_suppkey") % 30, F.lit(". - "), "s_name", F.lit(" :;"))).alias("heading"))


WORDS = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
TENS = "['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


@query(f"""WITH k AS (SELECT o_orderkey, (o_custkey % 100)::INT AS k FROM orders)
SELECT o_orderkey, 'pay ' || CASE WHEN k < 20 THEN {WORDS}[k + 1] ELSE {TENS}[k // 10 - 1] || CASE WHEN k % 10 > 0 THEN '-' || {WORDS}[k % 10 + 1] ELSE '' END END || ' days, 3.5 or x7' AS said FROM k""")
def digits_to_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.digits_to_words(F.concat(F.lit("pay "), F.col("o_custkey") % 100, F.lit(" days, 3.5 or x7"))).alias("said"))


@query("SELECT p_partkey, p_name || '  ' AS heading FROM part")
def clean_heading(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_heading(F.concat("p_name", F.lit(" ["), "p_brand", F.lit("] (x) ("), "p_type")).alias("heading"))


@query("SELECT n_nationkey, to_json([{'k': n_nationkey, 'v': n_name}])::VARCHAR AS rows FROM nation")
def table_json(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.table_to_text(F.array(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))).alias("rows"))


WIDE = """t AS (SELECT s_nationkey AS doc_id, s_suppkey AS pos, CASE s_suppkey % 5 WHEN 0 THEN '日本' WHEN 1 THEN '12.5' WHEN 2 THEN '１２ 中' WHEN 3 THEN s_name ELSE '!!' END AS text FROM supplier)"""


@query(f"""WITH {WIDE}, n AS (SELECT *, regexp_matches(text, '^[一-鿿！-～\\s]+$') AS wide, regexp_matches(lag(text) OVER w, '^[一-鿿！-～\\s]+$') AND regexp_matches(lead(text) OVER w, '^[一-鿿！-～\\s]+$') AS amid FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CASE WHEN wide OR coalesce(amid, false) AND NOT regexp_matches(text, '[A-Za-z]') THEN '' ELSE text END AS text FROM n""")
def wide_runs(spark, sf_dir):
    kind = F.col("s_suppkey") % 5
    text = F.when(kind == 0, "日本").when(kind == 1, "12.5").when(kind == 2, "１２ 中").when(kind == 3, F.col("s_name")).otherwise("!!")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("pos"), text.alias("text"))
    return X.suppress_wide_runs(rows, "text", ["doc_id"], ["pos"])


@query("SELECT s_suppkey, 'fi ' || s_name || ' 1⁄2 A' || chr(776) AS text FROM supplier")
def unicode_forms(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.unicode_normalise(F.concat(F.lit("ﬁ\t\t"), "s_name", F.lit(" ½ Ä"))).alias("text"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'FORM OF ' || s_name WHEN 1 THEN 'SCHEDULE A Form ' || s_name WHEN 2 THEN 'NON-RECOURSE ' || s_name ELSE s_name END AS heading FROM supplier")
def separated_letters(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, F.concat(F.lit("F ORM OF "), "s_name")).when(k == 1, F.concat(F.lit("SCHEDULE A F orm "), "s_name")).when(k == 2, F.concat(F.lit("N ON-RECOURSE "), "s_name")).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.join_separated_letters(text).alias("heading"))


# -- headings, parties, definitions


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'borrower' WHEN 1 THEN 'Lender' WHEN 2 THEN 'Obligors' ELSE 'agent' END AS party FROM supplier""")
def parties_unquoted(spark, sf_dir):
    """Parties clauses without quotes: after ``as``, in a bracket, after ``together``, and ``as`` before a bracket."""
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, F.concat("s_name", F.lit(" as borrower"))).when(k == 1, F.concat("s_name", F.lit(" (the Lender)"))).when(k == 2, F.concat("s_name", F.lit(" and others (together, the Obligors)"))).otherwise(F.concat("s_name", F.lit(" as agent (in its capacity)")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", H.read_party(text).alias("party"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'Basel II' ELSE 'Bank' END AS definition,
  CASE s_suppkey % 3 WHEN 0 THEN 'has the meaning given to it by ' || s_name WHEN 1 THEN 'shall be construed as ' || s_name ELSE 'the accord of ' || s_name END AS description FROM supplier""")
def definitions_unquoted(spark, sf_dir):
    """Definitions without quotes: the term stands before the defining key, after the last comma."""
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Bank has the meaning given to it by "), "s_name")).when(k == 1, F.concat(F.lit("in this deed, Bank shall be construed as "), "s_name")).otherwise(F.concat(F.lit('"Basel II" means the accord of '), "s_name"))
    d = H.read_definition(text)
    return table(spark, sf_dir, "supplier").select("s_suppkey", d["definition"].alias("definition"), d["description"].alias("description"))


# -- layout


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 16 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 8 ELSE 16 END AS flags FROM part")
def font_flags(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("Arial-Bold", "Times-Italic", "Plain", "Courier-Monospaced", "A-B-BoldItalic"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", flags_of_font(name).alias("flags"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 10 <= 5 THEN 'title' WHEN p_size % 10 <= 6 THEN 'section' ELSE 'caption' END
  WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size % 10 <= 12 THEN 'paragraph' WHEN p_size % 10 <= 16 THEN 'list' ELSE 'footer' END ELSE 'paragraph' END AS tag FROM part""")
def style_tags(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_size") % 10
    style = F.when(k == 0, F.concat(F.lit("heading"), n)).when(k == 1, F.concat(F.lit("subscript"), n)).otherwise("paragraph")
    return table(spark, sf_dir, "part").select("p_partkey", L.style_to_tag(style, F.lit(10), F.lit(20)).alias("tag"))


@query(f"""WITH {BOXES}, f AS (SELECT *, CASE WHEN least(abs(x0 - lag(x1) OVER w), abs(x0 - lag(x0) OVER w), abs(x1 - lag(x0) OVER w), abs(x1 - lag(x1) OVER w)) <= 300
    AND least(abs(y0 - lag(y1) OVER w), abs(y0 - lag(y0) OVER w), abs(y1 - lag(y0) OVER w), abs(y1 - lag(y1) OVER w)) <= 400 THEN 0 ELSE 1 END AS s FROM boxes WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY pos)),
r AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page_id ORDER BY pos) AS run FROM f)
SELECT doc_id, page_id, min(pos)::BIGINT AS pos, string_agg(text, ' ' ORDER BY pos) AS text, min(x0)::BIGINT AS x0, min(y0)::BIGINT AS y0, max(x1)::BIGINT AS x1, max(y1)::BIGINT AS y1 FROM r GROUP BY doc_id, page_id, run""")
def touching_spans(spark, sf_dir):
    out = L.merge_touching(boxes(spark, sf_dir), by=["doc_id", "page_id"], most_x=300, most_y=400)
    return out.select("doc_id", "page_id", F.col("pos").cast("long").alias("pos"), "text", *(F.col("box")[i].cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


TITLES = f"""{LINES}, t AS (SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN 'section' WHEN 3 THEN 'paragraph' ELSE 'title' END AS tag, CASE WHEN pos % 7 = 4 THEN 'Schedule ' || text ELSE text END AS text FROM lines)"""


@query(f"""WITH {TITLES}, h AS (SELECT *, last_value(CASE WHEN tag <> 'title' THEN tag END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM t)
SELECT doc_id, pos, CASE WHEN tag = 'title' AND (head = 'section' OR regexp_matches(text, '(?i)^(Schedule|Appendix|Part)\\b')) THEN 'section' ELSE tag END AS tag FROM h""")
def title_promotion(spark, sf_dir):
    tag = F.when(F.col("pos") % 5 == 0, "section").when(F.col("pos") % 5 == 3, "paragraph").otherwise("title")
    rows = lines(spark, sf_dir).withColumns({"tag": tag, "text": F.when(F.col("pos") % 7 == 4, F.concat(F.lit("Schedule "), "text")).otherwise(F.col("text"))})
    return L.promote_titles(rows).select("doc_id", "pos", "tag")


@query("SELECT s_suppkey, ['section', 'sub_section', 'sub_sub_section', 'section', 'section', 'paragraph'][(s_suppkey % 6 + 1)::INT] AS tag FROM supplier")
def section_kinds(spark, sf_dir):
    """X, X.Y, X.Y.Z, a percentage, words, and an element that isn't a section."""
    head = F.get(F.array(*map(F.lit, ("7 ", "7.2 ", "7.2.1 ", "2.5% ", "", "7.2 "))), (F.col("s_suppkey") % 6).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(head, "s_name").alias("text"), F.when(F.col("s_suppkey") % 6 == 5, "paragraph").otherwise("section").alias("tag"))
    return L.rename_sections(rows).select("s_suppkey", "tag")


@query(f"""WITH {NATIONS} SELECT doc_id, 0 AS block_id, 0 AS part, 'section' AS key, name || ':' AS text FROM d UNION ALL SELECT doc_id, 0, 0, 'paragraph', 'value ' || name || ' and more' FROM d
UNION ALL SELECT doc_id, 1, 0, 'section', name || ': Fees:' FROM d UNION ALL SELECT doc_id, 1, 1, 'paragraph', 'two per cent' FROM d UNION ALL SELECT doc_id, 2, 0, 'section', 'Security:' FROM d""")
def section_values(spark, sf_dir):
    name = F.col("name")
    rows = [(0, "section", "section", F.concat(name, F.lit(": value "), name)), (0, "paragraph", "paragraph", F.lit("and more")), (1, "section", "section", F.concat(name, F.lit(": Fees: two per cent"))), (2, "section", "section", F.lit("Security:"))]
    blocks = _each(_nations(spark, sf_dir), "block_id key element text", rows).withColumnRenamed("n", "pos")
    return L.split_section_values(blocks).select("doc_id", "block_id", "part", "key", "text")


@query(f"""WITH {NATIONS} SELECT doc_id, b::BIGINT AS block_id, key, text || ' ' || name AS text, pages FROM d, (VALUES (0, 'section', 'A', '1'), (0, 'paragraph', 'b', '1'), (0, 'list', 'c', '1'), (0, 'table', 'e', '2'), (1, 'section', 'F', '2'), (1, 'paragraph', 'g', '2'), (1, 'paragraph_1', 'h', '2')) AS t(b, key, text, pages) WHERE key <> 'list'
UNION ALL SELECT doc_id, 0, 'list', 'c ' || name || ' d ' || name, '1,2' FROM d""")
def block_rows(spark, sf_dir):
    """Elements in blocks: a list goes on over a page, a section opens a block, a second paragraph gets a number."""
    t = [("section", 1, "A"), ("paragraph", 1, "b"), ("list", 1, "c"), ("list", 2, "d"), ("table", 2, "e"), ("section", 2, "F"), ("paragraph", 2, "g"), ("paragraph", 2, "h")]
    rows = _each(_nations(spark, sf_dir), "tag page_id text", t).withColumnRenamed("n", "pos")
    rows = rows.withColumns({"text": F.concat_ws(" ", "text", "name"), "box": F.array(F.lit(0), F.col("pos") * 10, F.lit(50), F.col("pos") * 10 + 5)})
    return L.segment_blocks(rows).select("doc_id", F.col("block_id").cast("long").alias("block_id"), "key", "text", F.array_join(F.transform("page_ids", lambda p: p.cast("string")), ",").alias("pages"))


# -- splitting


@query("""SELECT c_custkey, u.list_id, replace(u.text, '$', c_name) AS text FROM customer, (VALUES ('(a)', '$ pays;'), ('(a)(i)', 'fees;'), ('(a)(ii)', 'costs under Clause (b) and section 4. of it;'), ('(b)', '$ repays'), ('1.', 'red'), ('2.', 'blue $'), ('2.(a)', 'green (see (c) and (d))'), ('2.(b)', 'at least 5. years')) AS u(list_id, text)""")
def numbered_items(spark, sf_dir):
    """Numbers of three forms, references that aren't items, and a second list that starts over."""
    text = F.concat(F.lit("(a) "), "c_name", F.lit(" pays; (i) fees; (ii) costs under Clause (b) and section 4. of it; (b) "), "c_name", F.lit(" repays 1. red 2. blue "), "c_name", F.lit(" (a) green (see (c) and (d)) (b) at least 5. years"))
    rows = parted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), rows=20_000).select("c_custkey", text.alias("text"))
    return rows.select("c_custkey", F.explode(K.list_item_column("text")).alias("i")).select("c_custkey", "i.list_id", "i.text")


@query(f"""WITH {NATIONS} SELECT doc_id, pos::BIGINT AS pos, list_id, text FROM d, (VALUES (0, '(a)', 'first'), (0, '(a)(i)', 'detail'), (1, '(a)(ii)', 'goes on'), (2, NULL, 'no number'), (3, '(b)', 'alone')) AS t(pos, list_id, text)""")
def lists_across_texts(spark, sf_dir):
    """A list goes on in the next text of its block, until a text without numbers."""
    rows = _each(_nations(spark, sf_dir), "text", [("(a) first (i) detail",), ("(ii) goes on",), ("no number",), ("(b) alone",)]).withColumns({"block_id": F.lit(0), "is_definition": F.lit(False), "pos": F.col("n").cast("long")})
    out = K.list_items_in_blocks(rows)
    return out.select("doc_id", "pos", F.explode("items").alias("i")).select("doc_id", "pos", "i.list_id", "i.text")


@query(f"WITH {NATIONS} SELECT doc_id, '(a)' AS list_id, n, replace(phrase, '$', name) AS phrase FROM d, (VALUES (0, '$ pays;'), (1, 'repays; and'), (2, 'waits.')) AS t(n, phrase)")
def item_phrases(spark, sf_dir):
    items = F.array(F.struct(F.lit("(a)").alias("list_id"), F.concat("name", F.lit(" pays; repays; and waits.")).alias("text")))
    return K.item_phrases(_nations(spark, sf_dir).select("doc_id", items.alias("items")), ["doc_id"]).select("doc_id", "list_id", "n", "phrase")


@query(f"WITH {NATIONS} SELECT doc_id, n, replace(part, '$', name) AS part FROM d, (VALUES (0, '$:'), (1, 'Alpha.'), (2, 'Next $')) AS t(n, part)")
def separator_parts(spark, sf_dir):
    text = F.concat("name", F.lit(": Alpha. Next "), "name")
    return _nations(spark, sf_dir).select("doc_id", F.posexplode(K.separator_column(text)).alias("n", "part"))


@query("SELECT n_nationkey, n_name || '_' || k AS path, v FROM nation, (VALUES ('key'), ('region')) AS t(k), LATERAL (SELECT CASE k WHEN 'key' THEN n_nationkey ELSE n_regionkey END::VARCHAR AS v)")
def map_paths(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    nested = F.create_map(F.col("n_name"), F.create_map(F.lit("key"), text("n_nationkey"), F.lit("region"), text("n_regionkey")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(K.flatten_map(nested)).alias("e")).select("n_nationkey", F.col("e.key").alias("path"), F.col("e.value").alias("v"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS w FROM part) SELECT p_partkey, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w")
def word_ngrams(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(K.ngrams(words, 2)).alias("gram"))


# -- extraction


def _stacked(rows: DataFrame) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("doc_id", F.lit(0).alias("text_block_id"), F.col("n").cast("long").alias("pos"), "text_element", "list_id", "text", none("array<int>").alias("bbox"), F.lit("1").alias("page_id"))


@query(f"WITH {NATIONS} SELECT doc_id, text_element, replace(text, '$', name) AS text FROM d, (VALUES ('section', '3. TITLE'), ('sub_section', '3.1 Text of $'), ('paragraph', 'See 3.1 of $')) AS t(text_element, text)")
def sections_in_one(spark, sf_dir):
    """``3. TITLE 3.1 Text`` is a section and a sub-section."""
    rows = _each(_nations(spark, sf_dir), "text_element list_id text", [("section", None, F.concat(F.lit("3. TITLE 3.1 Text of "), "name")), ("paragraph", None, F.concat(F.lit("See 3.1 of "), "name"))])
    return E.split_section_and_sub(_stacked(rows)).select("doc_id", "text_element", "text")


@query(f"WITH {NATIONS} SELECT doc_id, replace(text, '$', name) AS text, first FROM d, (VALUES ('the end of $.', true), ('12.3 Next clause', false), ('13.1 And one', false), ('one. two', true)) AS t(text, first)")
def embedded_sections(spark, sf_dir):
    rows = _each(_nations(spark, sf_dir), "text_element list_id text", [("list", None, F.concat(F.lit("the end of "), "name", F.lit(". 12.3 Next clause. 13.1 And one"))), ("list", None, "one. two")])
    out = E.split_embedded_sections(_stacked(rows))
    return out.select("doc_id", F.regexp_replace("text", r"clause\.$", "clause").alias("text"), (F.element_at("pos", -1) == 0).alias("first"))


@query(f"WITH {NATIONS} SELECT doc_id, n, replace(section, '$', name) AS section FROM d, (VALUES (0, '$ :'), (1, '$ :'), (2, NULL), (3, 'Fees')) AS t(n, section)")
def colon_repair(spark, sf_dir):
    rows = _each(_nations(spark, sf_dir), "section", [(F.col("name"),), (":",), (None,), ("Fees",)]).withColumn("pos", F.col("n"))
    return E.repair_colons(rows).select("doc_id", "n", "section")


_AGREEMENT = [
    ("section", None, "CONTENTS"), ("table", None, "Schedule 1 The Banks of $....12"), ("paragraph", None, "THIS AGREEMENT is dated today"), ("paragraph", None, '$ LIMITED as borrower (the "Borrower")'), ("paragraph", None, "IT IS AGREED as follows"),
    ("section", None, "1. DEFINITIONS AND INTERPRETATION"), ("sub_section", None, "1.1 Definitions"), ("paragraph", None, '"Margin" means two per cent.'), ("section", None, "2. PREPAYMENT 2.1 Voluntary prepayment"),
    ("list", "(a)", "first limb of $"), ("list", "(a)(i)", "detail"), ("list", "(b)", "second limb"), ("paragraph", None, "2.2 Mandatory prepayment"), ("paragraph", None, "at once"), ("paragraph", None, "12"),
    ("section", None, "The Banks of $"), ("section", None, "SCHEDULE 1 THE BANKS"), ("section", None, "PART A lenders"), ("paragraph", None, "names of lenders"),
]


def _agreements(spark, sf_dir) -> DataFrame:
    text = lambda t: F.replace(F.lit(t), F.lit("$"), F.translate("name", "0123456789", "ABCDEFGHIJ"))
    return _stacked(_each(_nations(spark, sf_dir), "text_element list_id text", [(e, i, text(t)) for e, i, t in _AGREEMENT]))


@query(f"""WITH {NATIONS}, l AS (SELECT doc_id, translate(name, '0123456789', 'ABCDEFGHIJ') AS name FROM d)
SELECT doc_id, pos::BIGINT AS pos, section_id, replace(section, '$', name) AS section, sub_section_id, sub_section, schedule_id, replace(schedule, '$', name) AS schedule, part_id, definition, identifier, replace(text, '$', name) AS text, text_element, list_id, replace(parent_list, '$', name) AS parent_list FROM l, (VALUES
  (1, NULL, 'TABLE OF CONTENTS', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'CONTENTS', 'section', NULL, NULL),
  (2, NULL, 'TABLE OF CONTENTS', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Schedule 1 The Banks of $....12', 'table', NULL, NULL),
  (3, '0', 'PARTIES', NULL, NULL, NULL, NULL, NULL, NULL, 'Parties', 'THIS AGREEMENT is dated today', 'paragraph', NULL, NULL),
  (4, '0', 'PARTIES', NULL, NULL, NULL, NULL, NULL, 'Borrower', 'Parties-Borrower', '$ LIMITED as borrower (the "Borrower")', 'paragraph', NULL, NULL),
  (5, '0', 'PARTIES', NULL, NULL, NULL, NULL, NULL, NULL, 'Parties', 'IT IS AGREED as follows', 'paragraph', NULL, NULL),
  (6, '1', 'DEFINITIONS AND INTERPRETATION', NULL, NULL, NULL, NULL, NULL, NULL, 'Cl_1', '1. DEFINITIONS AND INTERPRETATION', 'section', NULL, NULL),
  (7, '1', 'DEFINITIONS AND INTERPRETATION', '1', 'Definitions', NULL, NULL, NULL, NULL, 'Cl_1.1', '1.1 Definitions', 'sub_section', NULL, NULL),
  (8, '1', 'DEFINITIONS AND INTERPRETATION', '1', 'Definitions', NULL, NULL, NULL, 'Margin', 'Cl_1.1-Margin', '"Margin" means two per cent.', 'paragraph', NULL, NULL),
  (9, '2', 'PREPAYMENT', NULL, NULL, NULL, NULL, NULL, NULL, 'Cl_2', '2. PREPAYMENT', 'section', NULL, NULL),
  (10, '2', 'PREPAYMENT', '1', 'Voluntary prepayment', NULL, NULL, NULL, NULL, 'Cl_2.1', '2.1 Voluntary prepayment', 'sub_section', NULL, NULL),
  (11, '2', 'PREPAYMENT', '1', 'Voluntary prepayment', NULL, NULL, NULL, NULL, 'Cl_2.1(a)', 'first limb of $', 'list', '(a)', NULL),
  (12, '2', 'PREPAYMENT', '1', 'Voluntary prepayment', NULL, NULL, NULL, NULL, 'Cl_2.1(a)(i)', 'detail', 'list', '(a)(i)', 'first limb of $'),
  (13, '2', 'PREPAYMENT', '1', 'Voluntary prepayment', NULL, NULL, NULL, NULL, 'Cl_2.1(b)', 'second limb', 'list', '(b)', NULL),
  (14, '2', 'PREPAYMENT', '2', 'Mandatory prepayment', NULL, NULL, NULL, NULL, 'Cl_2.2', '2.2 Mandatory prepayment', 'sub_section', NULL, NULL),
  (15, '2', 'PREPAYMENT', '2', 'Mandatory prepayment', NULL, NULL, NULL, NULL, 'Cl_2.2', 'at once', 'paragraph', NULL, NULL),
  (16, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'The Banks of $', 'section', NULL, NULL),
  (17, NULL, NULL, NULL, NULL, '1', 'THE BANKS', NULL, NULL, 'Sched_1', 'SCHEDULE 1 THE BANKS', 'section', NULL, NULL),
  (18, NULL, NULL, NULL, NULL, '1', 'THE BANKS', 'A', NULL, 'Sched_1.A', 'PART A lenders', 'section', NULL, NULL),
  (19, NULL, NULL, NULL, NULL, '1', 'THE BANKS', 'A', NULL, 'Sched_1.A', 'names of lenders', 'paragraph', NULL, NULL)
) AS t(pos, section_id, section, sub_section_id, sub_section, schedule_id, schedule, part_id, definition, identifier, text, text_element, list_id, parent_list)""")
def agreement_fixture(spark, sf_dir):
    """A small agreement for each nation, from stacked rows to clause rows; the first schedule is found by its title in the contents."""
    return E.extract_agreement(_agreements(spark, sf_dir))[0].select("doc_id", "pos", "section_id", "section", "sub_section_id", "sub_section", "schedule_id", "schedule", "part_id", "definition", "identifier", "text", "text_element", "list_id", "parent_list")


@query("SELECT n_nationkey::BIGINT AS doc_id, 'zones' AS stage, CASE n_nationkey % 3 WHEN 0 THEN 'the opening of the parties clauses couldn''t be found' WHEN 1 THEN 'the end of the parties clauses couldn''t be found' ELSE 'the heading of the first schedule couldn''t be found' END AS message FROM nation")
def agreement_errors(spark, sf_dir):
    """Agreements of which the opening, the end of the parties or the schedules are missing give an error row, and no clause rows."""
    rows = _agreements(spark, sf_dir)
    gone = F.when(F.col("doc_id") % 3 == 0, F.col("text").startswith("THIS AGREEMENT")).when(F.col("doc_id") % 3 == 1, F.col("text").startswith("IT IS AGREED")).otherwise(F.col("text").rlike("^The Banks|^SCHEDULE 1|^PART A"))
    found, errors = E.extract_agreement(rows.where(~gone))
    return errors.unionByName(found.groupBy("doc_id").agg(F.lit("rows").alias("stage"), F.count(F.lit(1)).cast("string").alias("message")))


@query(f"""WITH {NATIONS} SELECT doc_id, pos::BIGINT AS pos, section, text_element, replace(text, '$', name) AS text, block::BIGINT AS text_block_id FROM d, (VALUES
  (1, 'Borrower', 'section', 'Borrower:', 0), (2, 'Borrower', 'paragraph', '$', 0), (3, 'Security', 'section', 'Security:', 1), (4, 'Security', 'list', 'charge over shares', 1), (5, 'Security', 'list', 'account charge', 1),
  (6, 'Documentation', 'section', 'Documentation:', 2), (7, 'Documentation', 'paragraph', 'terms', 2), (8, 'Documentation', 'paragraph', 'including $', 2), (9, 'Documentation', 'caption', 'to', 2), (10, 'Documentation', 'reference', 'Items', 2),
  (11, 'First Fee', 'section', '1st Fee', 3), (12, 'First Fee', 'paragraph', 'not known', 3), (13, 'First Fee', 'paragraph', 'two per cent', 3)) AS t(pos, section, text_element, text, block)""")
def summary_fixture(spark, sf_dir):
    """A small summary for each nation: a bank of names, bullets, comma sections, prepositions, items and ordinals."""
    rows = [(0, "section", "Borrower:"), (0, "paragraph", F.col("name")), (1, "section", "Security:"), (1, "list", "• charge over shares • account charge"), (2, "section", "Documentation:"), (2, "paragraph", F.concat(F.lit("terms,including "), "name")), (2, "section", "to"), (2, "section", "Items"), (3, "section", "1st Fee"), (3, "section", "not known"), (3, "paragraph", "two per cent")]
    given = _each(_nations(spark, sf_dir), "block text_element text", rows).withColumn("list_id", F.lit(None).cast("string"))
    bank = table(spark, sf_dir, "region").select(F.explode(F.array(*map(F.lit, ("Borrower", "Security", "Documentation")))).alias("name")).distinct()
    stacked = _stacked(given.withColumn("list_id", F.lit(None).cast("string"))).join(given.select("doc_id", F.col("n").cast("long").alias("pos"), "block"), ["doc_id", "pos"]).withColumn("text_block_id", F.col("block")).drop("block")
    return E.extract_summary(stacked, bank).select("doc_id", "pos", "section", "text_element", "text", F.col("text_block_id").cast("long").alias("text_block_id"))


# -- matching


def _clauses(spark, sf_dir) -> DataFrame:
    """Clause rows made of parts: sections by size, a definition for every third, schedules for every seventh."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    section = F.get(F.array(*map(F.lit, ("PARTIES", "Definitions", "TABLE OF CONTENTS", "Fees", "Costs"))), (k % 5).cast("int"))
    return table(spark, sf_dir, "part").select(
        (k % 4).alias("file_id"), k.alias("pos"), F.when(k % 5 == 0, "0").otherwise((k % 5).cast("string")).alias("section_id"), F.when(k % 11 != 0, section).alias("section"), F.lit("1").alias("sub_section_id"), none.alias("sub_section"),
        F.when(k % 7 == 0, F.concat(F.lit("Form "), k % 3)).alias("schedule"), F.when(k % 3 == 0, F.col("p_brand")).alias("definition"), F.concat(F.lit("Cl_"), k % 50).alias("identifier"), F.lit("paragraph").alias("text_element"), F.col("p_name").alias("text"),
    )


CLAUSES = """fa AS (SELECT p_partkey % 4 AS file_id, p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE (p_partkey % 5)::VARCHAR END AS section_id, CASE WHEN p_partkey % 11 <> 0 THEN ['PARTIES', 'Definitions', 'TABLE OF CONTENTS', 'Fees', 'Costs'][(p_partkey % 5 + 1)::INT] END AS section,
  CASE WHEN p_partkey % 7 = 0 THEN 'Form ' || (p_partkey % 3) END AS schedule, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS definition, 'Cl_' || (p_partkey % 50) AS identifier, p_name AS text FROM part)"""


@query(f"""WITH {CLAUSES}, o AS (SELECT * FROM fa WHERE NOT coalesce(regexp_matches(section, '(?i)DEFINITION|INTERPRETATION'), false) AND section_id <> '0' AND coalesce(section, '') NOT IN ('PARTIES', 'TABLE OF CONTENTS'))
SELECT 'parties' AS kind, pos FROM fa WHERE section = 'PARTIES' AND definition IS NOT NULL UNION ALL SELECT 'definitions', pos FROM fa WHERE definition IS NOT NULL UNION ALL SELECT 'schedules', pos FROM o WHERE schedule IS NOT NULL UNION ALL SELECT 'clauses', pos FROM o WHERE schedule IS NULL AND section IS NOT NULL""")
def clause_partitions(spark, sf_dir):
    parts = [df.select(F.lit(kind).alias("kind"), "pos") for kind, df in M.partition_clauses(_clauses(spark, sf_dir)).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {CLAUSES}, f AS (SELECT file_id, identifier, CASE WHEN section IS NULL OR section = 'Definitions' THEN text ELSE section || ': ' || text END AS text FROM fa),
t AS (SELECT file_id, definition AS text, identifier FROM (SELECT *, row_number() OVER (PARTITION BY file_id, section_id, definition ORDER BY pos) AS n FROM fa WHERE definition IS NOT NULL) WHERE n = 1),
p AS (SELECT file_id, definition AS text, identifier FROM fa WHERE section = 'PARTIES' AND definition IS NOT NULL)
SELECT file_id, text, identifier FROM f UNION SELECT file_id, text, identifier FROM t UNION SELECT file_id, text, identifier FROM p""")
def match_candidates(spark, sf_dir):
    return M.candidates(_clauses(spark, sf_dir)).select("file_id", "text", "identifier")


@query(f"WITH {CLAUSES} SELECT text, 1.0::DOUBLE AS norm FROM (SELECT DISTINCT text FROM fa)")
def embed_once(spark, sf_dir):
    """Each distinct text is embedded once, at unit length."""
    return M.embed_distinct(_clauses(spark, sf_dir)).select("text", F.round(M.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query(f"""WITH {CLAUSES}, first AS (SELECT file_id, identifier, arg_min({{'h': coalesce(schedule, section)}}, pos).h AS heading, min(pos) AS first_pos FROM fa GROUP BY file_id, identifier)
SELECT a.file_id, a.identifier, arg_min({{'h': b.heading}}, b.first_pos).h AS heading FROM first a JOIN first b ON a.file_id = b.file_id AND contains(b.identifier, a.identifier) GROUP BY a.file_id, a.identifier""")
def heading_by_identifier_compat(spark, sf_dir):
    """With compat an identifier may take the heading of a longer one that contains it and comes earlier."""
    return M.heading_by_identifier(_clauses(spark, sf_dir), compat=True)


@query("""SELECT o_orderkey AS pos, replace(CASE o_orderkey % 6 WHEN 0 THEN 'Cl_$.1(a)=0.9;Cl_9$=0.7' WHEN 1 THEN 'Cl_$.1(a)=0.9' WHEN 2 THEN 'Cl_$-Term_(a)=0.9;Cl_9$.2=0.7' WHEN 3 THEN 'Parties-Term_(b)=0.9;Cl_$-Other=0.8' WHEN 4 THEN 'Cl_$.1(a)(i)=0.9' ELSE 'Sched_$=0.9;Parties-A=0.8' END, '$', (o_custkey % 9)::VARCHAR) AS merged FROM orders""")
def merge_identifier_cases(spark, sf_dir):
    """Parents and children, definitions of one and of several terms, and identifiers that have nothing in common."""
    k = (F.col("o_custkey") % 9).cast("string")
    cases = [("Cl_$.1", "Cl_$.1(a)", "Cl_9$"), ("Cl_$.1(a)", "Cl_$.1", "Cl_$.1(a)"), ("Cl_$-Term", "Cl_$-Term_(a)", "Cl_9$.2"), ("Cl_$-Term", "Cl_$-Other", "Parties-Term_(b)"), ("Cl_$.1", "Cl_$.1(a)", "Cl_$.1(a)(i)"), ("Sched_$", "Parties-A", "")]
    hit = lambda i, s: F.struct(F.lit("t").alias("term"), F.replace(F.lit(i), F.lit("$"), k).alias("identifier"), F.lit(s).alias("similarity"), F.lit("content").alias("match_type"))
    lists = F.array(*(F.array(*(hit(i, s) for i, s in zip(c, (0.9, 0.8, 0.7), strict=True))) for c in cases))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.get(lists, (F.col("o_orderkey") % 6).cast("int")).alias("hits"))
    return rows.select("pos", F.array_join(F.transform(M.merge_identifiers(F.col("hits")), lambda h: F.concat(h["identifier"], F.lit("="), h["similarity"].cast("string"))), ";").alias("merged"))


def _matches(spark, sf_dir) -> DataFrame:
    """Summary rows of nations with two hits each; regions are the documents."""
    n = table(spark, sf_dir, "nation")
    hit = lambda i, s: F.struct(F.lit("t").alias("term"), i.alias("identifier"), F.lit(s).alias("similarity"), F.lit("content").alias("match_type"))
    key = F.col("n_nationkey")
    term = F.get(F.array(*map(F.lit, ("Interest Rate", "Security", "Margin", "Facility"))), (key % 4).cast("int"))
    hits = F.array(hit(F.concat(F.lit("Cl_"), key), 0.9), hit(F.concat(F.lit("Sched_"), key % 3), 0.8))
    return n.select(key.cast("string").alias("row_id"), F.col("n_regionkey").alias("file_id"), term.alias("ts_term"), F.when(key % 5 == 0, "up to HIBOR").otherwise("two per cent").alias("ts_text"), F.when(key % 6 == 0, "section").otherwise("paragraph").alias("text_element"), hits.alias("hits"))


def _agreement_terms(spark, sf_dir) -> DataFrame:
    """Two definitions and two schedules for each region."""
    rows = [("HIBOR", None, "Cl_1.1-HIBOR", "the rate"), ("Margin", None, "Cl_1.1-Margin", "two per cent"), (None, "Security Documents", "Sched_1", "deeds"), (None, "Conditions Precedent", "Sched_2", "papers")]
    out = _each(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file_id")), "definition schedule identifier text", rows)
    return out.withColumns({"pos": F.col("n"), "section_id": F.lit("1"), "sub_section_id": F.lit("1"), "section": F.col("schedule"), "sub_section": F.lit(None).cast("string")})


@query("""WITH r AS (SELECT n_nationkey::VARCHAR AS row_id, n_nationkey AS k, n_nationkey % 6 <> 0 AS live FROM nation)
SELECT row_id, CASE WHEN live AND k % 4 = 0 AND k % 5 = 0 THEN 'Cl_1.1-HIBOR/the rate/1.0;Cl_1.1-Margin/two per cent/1.0;' WHEN live AND k % 4 IN (0, 2) THEN 'Cl_1.1-Margin/two per cent/1.0;' ELSE '' END || 'Cl_' || k || '/t/0.9;Sched_' || (k % 3) || '/t/0.8' AS hits FROM r""")
def rule_hits(spark, sf_dir):
    """Rules on a row's term and text bring in definitions of its document; sections are left alone."""
    rules = [("^interest", "HIBOR", "^HIBOR$"), ("^interest|^margin", "", "^margin$")]
    out = M.inject_rules(_matches(spark, sf_dir), _agreement_terms(spark, sf_dir), rules=rules)
    return out.select("row_id", F.array_join(F.transform("hits", lambda h: F.concat_ws("/", h["identifier"], h["term"], h["similarity"].cast("string"))), ";").alias("hits"))


@query("""WITH r AS (SELECT n_nationkey::VARCHAR AS row_id, n_nationkey AS k, n_nationkey % 6 <> 0 AND n_nationkey % 4 = 1 AND n_nationkey % 3 = 1 AS moved FROM nation)
SELECT row_id, CASE WHEN moved THEN 'Sched_1/0.9;Cl_' || k || '/0.8' ELSE 'Cl_' || k || '/0.9;Sched_' || (k % 3) || '/0.8' END AS hits FROM r""")
def schedule_first(spark, sf_dir):
    """Hits in the schedules that a rule names for a row's section come first; similarities stay in place."""
    out = M.schedule_priority(_matches(spark, sf_dir), _agreement_terms(spark, sf_dir), rules=[("^security", "", "^security document")])
    return out.select("row_id", F.array_join(F.transform("hits", lambda h: F.concat_ws("/", h["identifier"], h["similarity"].cast("string"))), ";").alias("hits"))


@query("""SELECT (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS id, 9::BIGINT AS task_id, n_nationkey::VARCHAR AS row_id, 'Cl_' || n_nationkey || ';Sched_' || (n_nationkey % 3) AS identifiers, '0.9;0.8' AS similarities, CASE WHEN n_nationkey % 6 <> 0 THEN 'false,false,false,false,false' END AS result FROM nation""")
def stored_rows(spark, sf_dir):
    """Matches as they are stored: running ids, parallel arrays, and judgements of all false except for sections."""
    rows = _matches(spark, sf_dir).withColumn("place", F.col("row_id").cast("int"))
    out = M.api_rows(rows, F.lit(9).cast("long"), by=["file_id"], order=["place"])
    said = F.array_join(F.transform("result", lambda r: r.cast("string")), ",")
    return out.select(F.col("id").cast("long").alias("id"), "task_id", "row_id", F.array_join("identifier_list", ";").alias("identifiers"), F.array_join(F.transform("similarity_list", lambda s: s.cast("string")), ";").alias("similarities"), F.when(F.col("result").isNotNull(), said).alias("result"))


@query(f"""WITH {NATIONS} SELECT doc_id AS file_id, identifier, replace(text, '$', name) AS text FROM d, (VALUES ('Cl_2', '$ one two three four'), ('Cl_2.1', 'one two three'), ('Cl_2.1(a)', 'two three'), ('Cl_2.1(a)(i)', 'three'), ('Cl_20', 'four')) AS t(identifier, text) WHERE identifier <> 'Cl_2'
UNION ALL SELECT doc_id, 'Cl_2', name || ' one two three' FROM d""")
def child_texts(spark, sf_dir):
    """A clause's text with all below it; Cl_20 isn't below Cl_2."""
    rows = [("Cl_2", F.col("name")), ("Cl_2.1", "one"), ("Cl_2.1(a)", "two"), ("Cl_2.1(a)(i)", "three"), ("Cl_20", "four")]
    fa = _each(_nations(spark, sf_dir), "identifier text", rows).select(F.col("doc_id").alias("file_id"), F.col("n").alias("pos"), "identifier", "text")
    return M.child_texts(fa)


@query("""WITH o AS (SELECT l_orderkey, l_shipmode, l_linenumber FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 3)::VARCHAR AS l_shipmode FROM lineitem)),
f AS (SELECT l_orderkey, l_shipmode, min(l_linenumber) AS first_line FROM o GROUP BY l_orderkey, l_shipmode) SELECT l_orderkey, string_agg(l_shipmode, ',' ORDER BY first_line, l_shipmode) AS items FROM f GROUP BY l_orderkey""")
def ordered_distinct(spark, sf_dir):
    item = F.struct("l_linenumber", (F.col("l_partkey") % 3).cast("string").alias("v"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return rows.select("l_orderkey", F.array_join(M.distinct_in_order(F.transform("a", lambda x: x["v"])), ",").alias("items"))


@query("""SELECT n_nationkey::VARCHAR AS row_id, 'Cl_' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '【FEES - ' || n_name || '】' ELSE '' END AS first FROM nation""")
def decorated_hits(spark, sf_dir):
    """Identifiers with the headings of their document's rows; one without a heading stays bare."""
    n = table(spark, sf_dir, "nation")
    headings = n.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("file_id"), F.concat(F.lit("Cl_"), "n_nationkey").alias("identifier"), F.concat(F.lit("FEES - "), "n_name").alias("heading"))
    return M.decorated(_matches(spark, sf_dir), headings).select("row_id", F.col("hits")[0]["identifier"].alias("first"))


# -- lookup


PAIRED = """n AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_name AS a, lead(p_name || ' ' || p_type || ' ' || p_name) OVER (PARTITION BY p_size ORDER BY p_partkey) AS b FROM part), w AS (SELECT *, string_split(lower(a), ' ') AS wa, string_split(lower(b), ' ') AS wb FROM n WHERE b IS NOT NULL)"""


def _run(words: str, other: str) -> str:
    return f"coalesce(list_max(list_filter(range(2, len({words}) - 1), lambda n: len(list_filter(range(1, len({words}) - n + 2), lambda i: contains(lower({other}), array_to_string({words}[i:i + n - 1], ' ')))) > 0)), 0)"


@query(f"""WITH {PAIRED}, r AS (SELECT p_partkey, {_run('wa', 'b')} AS ra, {_run('wb', 'a')} AS rb, greatest(len(list_filter(wa, lambda x: list_contains(wb, x))), len(list_filter(wb, lambda x: list_contains(wa, x)))) AS shared FROM w)
SELECT p_partkey, CASE WHEN ra > 0 THEN ra ELSE rb END AS longest, shared FROM r""")
def shared_words(spark, sf_dir):
    """The longest run of words two texts share, and how many words of one are in the other, for neighbouring parts."""
    from pyspark.sql.window import Window

    a = F.concat_ws(" ", "p_name", "p_type", "p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), F.lead(a).over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("b")).where("b is not null")
    return rows.select("p_partkey", Q.longest_shared_run(F.col("a"), F.col("b")).cast("long").alias("longest"), Q.shared_words(F.col("a"), F.col("b")).cast("long").alias("shared"))


@query("""SELECT 'request' AS kind, o_orderkey AS id, o_custkey % 10 * 3 AS file_id FROM orders WHERE o_custkey % 10 < 8 UNION ALL SELECT 'clause', p_partkey, p_partkey % 40 FROM part WHERE p_partkey % 40 IN (SELECT o_custkey % 10 * 3 FROM orders WHERE o_custkey % 10 < 8)""")
def task_clauses(spark, sf_dir):
    """Requests with the agreement of their task, and only the clauses of those agreements."""
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("task_id"))
    tasks = table(spark, sf_dir, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").alias("task_id"), (F.col("n_nationkey") * 3).alias("fa_file_id"))
    clauses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("file_id"))
    asked, kept = Q.clauses_of_tasks(requests, tasks, clauses)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.col("file_id").cast("long").alias("file_id"))
    return named(asked, "request").unionByName(named(kept, "clause"))


# -- pairs and reports


@query("SELECT l_returnflag, count(*) AS n, true AS in_range FROM lineitem GROUP BY l_returnflag")
def pair_scores(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "A", "entailment").otherwise("contradiction")
    rows = table(spark, sf_dir, "lineitem").withColumn("score", N.scores(label))
    good = F.when(F.col("l_returnflag") == "A", F.col("score").between(0.999, 1.0)).otherwise(F.col("score") == 0.3)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("in_range"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'false,true' WHEN 1 THEN 'true,false,false,false,false' END AS result FROM orders")
def judgement_defaults(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    out = O.default_judgement(F.when(k == 0, F.array(F.lit(False), F.lit(True))), k == 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(out.isNotNull(), F.array_join(F.transform(out, lambda r: r.cast("string")), ",")).alias("result"))


@query("SELECT p_partkey, '1. ' || p_name || chr(10) || chr(10) || '2. ' || p_type || chr(10) || chr(10) AS note FROM part")
def numbered_notes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", O.numbered_lines(F.array("p_name", "p_type")).alias("note"))


@query("SELECT 'p_name' AS column, greatest(max(len(p_name)), 6)::BIGINT AS width FROM part UNION ALL SELECT 'p_partkey', greatest(max(len(p_partkey::VARCHAR)), 9) FROM part UNION ALL SELECT 'p_brand', greatest(max(len(p_brand)), 7) FROM part")
def report_widths(spark, sf_dir):
    return O.column_widths(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand")).select("column", F.col("width").cast("long").alias("width"))


@query("""WITH t AS (SELECT p_size AS doc_id, p_partkey AS pos, p_type AS text, CASE WHEN p_partkey % 9 > 0 THEN 'paragraph' END AS text_element, lag(p_type) OVER (PARTITION BY p_size ORDER BY p_partkey) AS last FROM part)
SELECT doc_id, pos, text FROM t WHERE text_element IS NOT NULL AND (last IS NULL OR last <> text)""")
def unrepeated_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("text"), F.when(F.col("p_partkey") % 9 > 0, "paragraph").alias("text_element"))
    return O.without_repeats(rows, by=["doc_id"], order=["pos"]).select("doc_id", "pos", "text")
