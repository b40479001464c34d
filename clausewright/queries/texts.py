"""Text queries over lines of documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import headings as H
from clausewright.functions import identifiers as I
from clausewright.functions import text as T
from clausewright.operators import tokenise as K
from clausewright.queries.tables import LINES, lines, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _clean(col: str) -> str:
    steps = [(" +", " "), (" / ", "/"), (r" ([.,;]) ", r"\1 "), (r" ([)\]])", r"\1"), (r" ([(\[]) ", r" \1"), ("[一-鿿]+", ""), ("[▀—▟]+", "•"), ("[■-◿]+", "•"), ("§+", "▪"), ("Ø+", "•"), ("[“”]", '"'), ("[’‘]", "''")]
    for a, b in steps:
        col = f"regexp_replace({col}, '{a}', '{b}', 'g')"
    return f"trim({col})"


@query(f"WITH {LINES} SELECT doc_id, pos, {_clean('text')} AS cleaned FROM lines")
def clean_text(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[一-鿿]') THEN md5(text) END AS kept FROM documents")
def drop_cjk(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(T.drop_cjk(F.col("text")), "UTF-8")).alias("kept"))


@query(f"WITH {LINES} SELECT doc_id, pos, trim(translate(text, '!\"#$%&''()*+,./:;<=>?@[\\]^_`{{|}}~', '')) AS bare FROM lines")
def strip_punct(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.strip_punctuation(F.col("text")).alias("bare"))


def _light(col: str) -> str:
    col = f"translate({col}, '!\"#%&''*+-/;<=>?@[]^_`{{|}}~', '')"
    for c in (r"\(", r"\)", ":", ",", r"\.", r"\\", r"\$"):
        col = f"regexp_replace({col}, '{c}{c}+', '{c if len(c) > 1 and c != r'\\\\' and False else c.replace(chr(92), '') if c != chr(92) * 2 else chr(92) * 2}', 'g')"
    return col


@query(f"WITH {LINES} SELECT doc_id, pos, {_light('text')} AS light FROM lines")
def collapse_repeats(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", T.light_punctuation(F.col("text")).alias("light"))


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '^\\d+\\.*\\d*\\.*\\d*', '') AS name FROM orders")
def strip_leading_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.drop_clause_number(F.col("o_orderpriority")).alias("name"))


@query("""WITH j AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '') AS joined FROM part)
SELECT p_partkey, regexp_replace(joined, '([a-z])([A-Z])', '\\1 \\2', 'g') AS name FROM j""")
def camel_split(spark, sf_dir):
    joined = F.regexp_replace(F.initcap("p_name"), " ", "")
    return table(spark, sf_dir, "part").select("p_partkey", T.split_camel_case(joined).alias("name"))


@query(f"WITH {LINES} SELECT doc_id, pos, unnest(list_filter(list_transform(regexp_split_to_array(text, '{K.PARAGRAPH}'), lambda x: trim(x)), lambda x: x <> '')) AS piece FROM (SELECT doc_id, pos, replace(text, ', ', ';') AS text FROM lines)")
def para_split(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit(", "), F.lit(";")))
    return rows.select("doc_id", "pos", F.explode(K.split_paragraph(F.col("text"), keep=False)).alias("piece"))


@query(f"WITH {LINES}, s AS (SELECT doc_id, pos, text, list_filter(string_split(replace(text, '|', '•'), '•'), lambda x: x NOT IN ('', ' ')) AS p FROM lines) SELECT doc_id, pos, unnest(CASE WHEN len(p) > 1 THEN list_transform(p, lambda x: '• ' || trim(x)) ELSE [replace(text, '|', '•')] END) AS item FROM s")
def bullet_split(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit("|"), F.lit("•")))
    return rows.select("doc_id", "pos", F.explode(K.split_bullets(F.col("text"))).alias("item"))


@query("SELECT doc_id, source, unnest(CASE WHEN source IN ('src0', 'src5') THEN string_split(text, ',') ELSE [text] END) AS piece FROM documents")
def comma_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    section = F.when(F.col("source").isin("src0", "src5"), "Documentation")
    return docs.select("doc_id", "source", F.explode(F.coalesce(F.when(section.isNotNull(), K.split_commas(F.col("text"), section)), F.array("text"))).alias("piece"))


@query()
def list_numbering(spark, sf_dir):
    rows = lines(spark, sf_dir, dealt=1_000).select("doc_id", F.concat(F.lit("(a) "), F.replace("text", F.lit(". "), F.lit("; (b) "))).alias("text"), "pos")
    return rows.select("doc_id", "pos", F.explode(K.list_item_column("text")).alias("i")).select("doc_id", "pos", "i.list_id", "i.text")


@query()
def phrase_tokens(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(K.phrase_column(F.col("text"))).alias("n", "phrase"))


@query("SELECT o_orderkey, n, r FROM (SELECT o_orderkey, o_custkey % 39 + 1 AS n FROM orders) JOIN (SELECT unnest(range(1, 40)) AS m, unnest(list_transform(range(1, 40), lambda x: repeat('x', (x // 10)::INT) || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][x % 10 + 1])) AS r) ON m = n")
def roman_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", (F.col("o_custkey") % 39 + 1).cast("int"))
    units = F.array(*(F.lit(x) for x in ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]))
    roman = F.concat(F.repeat(F.lit("x"), F.floor(F.col("k") / 10).cast("int")), F.get(units, F.col("k") % 10))
    return o.select("o_orderkey", T.roman_to_int(roman).cast("long").alias("n"), roman.alias("r"))


@query("SELECT s_suppkey, s_suppkey % 9 + 1 AS k, ['First', 'Second', 'Third', 'Fourth', 'Fifth', 'Sixth', 'Seventh', 'Eighth', 'Ninth'][(s_suppkey % 9 + 1)::INT] || ' Mortgage' AS heading FROM supplier")
def ordinal_words(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") % 9 + 1)
    ending = F.when(F.col("k") == 1, "st").when(F.col("k") == 2, "nd").when(F.col("k") == 3, "rd").otherwise("th")
    return s.select("s_suppkey", "k", T.ordinals_to_words(F.concat("k", ending, F.lit(" Mortgage"))).alias("heading"))


@query("SELECT o_orderkey, true AS day, try_cast(o_orderpriority AS DOUBLE) IS NOT NULL AS number FROM orders")
def date_and_number_tests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.is_date(F.date_format(F.col("o_orderdate").cast("timestamp"), "d MMMM yyyy")).alias("day"), T.is_float(F.col("o_orderpriority")).alias("number"))


@query("SELECT n_nationkey, CASE WHEN n_name NOT IN ('nan', 'None', '') AND n_nationkey % 3 > 0 THEN n_name END AS name FROM nation")
def sentinel_nulls(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "nan").otherwise(F.col("n_name")).alias("name"))
    return T.without_sentinels(n)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 20)::VARCHAR AS section_id, (l_suppkey % 7)::VARCHAR AS sub_section_id, 'Text ' || l_returnflag AS sub_section FROM lineitem")
def section_id_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.col("l_partkey") % 20, F.lit("."), F.col("l_suppkey") % 7, F.lit(" Text "), "l_returnflag")
    h = H.read_heading(text, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", h["section_id"].alias("section_id"), h["sub_section_id"].alias("sub_section_id"), h["sub_section"].alias("sub_section"))


@query("SELECT s_suppkey, 'SCHEDULE' AS kind, (s_suppkey % 30 + 1)::VARCHAR AS id, 'The ' || s_name AS title FROM supplier UNION ALL SELECT s_suppkey, 'PART', chr((65 + s_suppkey % 2)::INT), s_name FROM supplier")
def schedule_headings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    sched = H.read_heading(F.concat(F.lit("SCHEDULE "), F.col("s_suppkey") % 30 + 1, F.lit(" The "), "s_name"), none, none)
    part = H.read_heading(F.concat(F.lit("PART "), F.chr(65 + F.col("s_suppkey") % 2), F.lit(" - "), "s_name"), none, none)
    return s.select("s_suppkey", F.lit("SCHEDULE").alias("kind"), sched["schedule_id"].alias("id"), sched["schedule"].alias("title")).unionByName(s.select("s_suppkey", F.lit("PART").alias("kind"), part["part_id"].alias("id"), F.trim(part["part"]).alias("title")))


@query("SELECT c_custkey, c_name AS definition, '\"' || c_name || '\" means a customer of ' || c_mktsegment AS description FROM customer")
def definition_extract(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    d = H.read_definition(F.concat(F.lit('"'), "c_name", F.lit('" means a customer of '), "c_mktsegment"))
    return c.select("c_custkey", d["definition"].alias("definition"), d["description"].alias("description"))


@query("SELECT s_suppkey, replace(replace(s_name, '#', ''), '.', '') AS party FROM supplier")
def parties_extract(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", H.read_party(F.concat(F.lit('ALPHA LIMITED as borrower (the "'), "s_name", F.lit('")'))).alias("party"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE
  WHEN l_linestatus = 'O' THEN 'Sched_' || (l_suppkey % 9) || CASE WHEN l_returnflag = 'A' THEN '.A' ELSE '' END || '_' || (l_partkey % 20 + 1)
  ELSE 'Cl_' || (l_partkey % 20 + 1) || '.' || l_linenumber END || CASE WHEN l_returnflag = 'R' THEN '(' || chr((97 + l_suppkey % 5)::INT) || ')' ELSE '' END || CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN '-Term' ELSE '' END AS identifier FROM lineitem""")
def identifier_build(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    s = lambda c: c.cast("string")
    ident = I.clause_identifier(
        s(F.col("l_partkey") % 20 + 1), s(F.col("l_linenumber")), F.when(F.col("l_linestatus") == "O", s(F.col("l_suppkey") % 9)), F.when(F.col("l_returnflag") == "A", "A"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), F.chr(97 + F.col("l_suppkey") % 5), F.lit(")"))), F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "Term"), F.lit("paragraph"), none, none, F.lit("text"),
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ident.alias("identifier"))
