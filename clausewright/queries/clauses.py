"""Ordered-row, extraction and validation queries over lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import text as X
from clausewright.operators import extract as E
from clausewright.operators import match as M
from clausewright.operators import rows as R
from clausewright.operators import validate as V
from clausewright.queries.tables import LINES, lines, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ONE = dict(by=["doc_id"], order=["pos"])
RUNS = f"{LINES}, runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS run FROM (SELECT *, CASE WHEN text_element = lag(text_element) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM lines))"


@query(f"WITH {RUNS} SELECT doc_id, pos, run::BIGINT AS run FROM runs")
def run_index(spark, sf_dir):
    return R.run_index(lines(spark, sf_dir), "text_element", "run", **ONE).select("doc_id", "pos", "run")


@query(f"WITH {LINES} SELECT doc_id, pos, last_value(CASE WHEN text_element = 'section' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM lines")
def ffill_section(spark, sf_dir):
    marked = lines(spark, sf_dir).withColumn("section", F.when(F.col("text_element") == "section", F.col("text")))
    return R.forward_fill(marked, ["section"], **ONE).select("doc_id", "pos", "section")


@query(f"WITH {RUNS} SELECT doc_id, pos, run::BIGINT AS run, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1 AS phrase_id FROM runs")
def cumcount_phrase(spark, sf_dir):
    runs = R.run_index(lines(spark, sf_dir), "text_element", "run", **ONE)
    return R.count_in_run(runs, "phrase_id", by=["doc_id", "run"], order=["pos"]).select("doc_id", "pos", "run", F.col("phrase_id").cast("long").alias("phrase_id"))


@query(f"""WITH {RUNS}, c AS (SELECT *, CASE WHEN lag(text_element) OVER w = 'section' THEN lag(text) OVER w END AS c FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, first_value(c IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS caption FROM c""")
def lag_lead_caption(spark, sf_dir):
    runs = R.run_index(lines(spark, sf_dir), "text_element", "index", **ONE)
    rows = runs.withColumns({"text_element": F.when(F.col("text_element") == "section", "caption").otherwise(F.col("text_element")), "section": F.lit("s"), "text_block_id": F.lit(0)})
    return R.parent_caption(rows, **ONE).select("doc_id", "pos", F.col("parent_caption").alias("caption"))


@query(f"WITH {LINES} SELECT doc_id, pos, text AS heading FROM lines WHERE text = upper(text) OR len(regexp_split_to_array(trim(text), '\\s+')) <= 10")
def heading_guard(spark, sf_dir):
    rows = lines(spark, sf_dir)
    short = (F.col("text") == F.upper("text")) | (F.size(F.split(F.trim("text"), r"\s+")) <= 10)
    return rows.where(short).select("doc_id", "pos", E.heading_guard(F.col("text")).alias("heading"))


SMALL = ", ".join(f"'{w}'" for w in X.SMALL_WORDS)


@query(f"""WITH {LINES}, w AS (SELECT *, regexp_split_to_array(trim(text), '\\s+') AS ws FROM lines), h AS (SELECT *, list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]')) AS hs FROM w)
SELECT doc_id, pos, CASE WHEN text = upper(text) OR len(ws) <= 10 OR len(hs) > 0 AND len(list_filter(hs, lambda x: NOT (lower(x) IN ({SMALL}) OR regexp_matches(x, '^[^A-Za-z]*[A-Z]')))) = 0 THEN text END AS heading FROM h""")
def heading_guard_lines(spark, sf_dir):
    """heading_guard on every line, with null for those that are no heading."""
    return lines(spark, sf_dir).select("doc_id", "pos", E.heading_guard(F.col("text")).alias("heading"))


NEAR = """items AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos,
  CASE WHEN l_linenumber = 1 THEN '(a)' WHEN l_linenumber = 2 THEN '(a)(i)' WHEN l_linenumber = 3 THEN '(b)' WHEN l_linenumber = 4 THEN '(b)(i)' END AS list_id, 'o' || l_orderkey AS text FROM lineitem)"""


@query(f"""WITH {NEAR}, asked AS (SELECT doc_id, pos, list_id[1:3] AS prefix FROM items WHERE len(list_id) > 3),
n AS (SELECT a.doc_id, a.pos, arg_min(i.text, abs(a.pos - i.pos) * 1000000 + i.pos) AS parent_list FROM asked a JOIN items i ON i.doc_id = a.doc_id AND i.list_id = a.prefix GROUP BY a.doc_id, a.pos)
SELECT items.doc_id, items.pos, n.parent_list FROM items LEFT JOIN n USING (doc_id, pos)""")
def nearest_parent(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(w).alias("pos"), F.when(F.col("l_linenumber") <= 4, F.get(F.array(*map(F.lit, ("(a)", "(a)(i)", "(b)", "(b)(i)"))), F.col("l_linenumber") - 1)).alias("list_id"), F.concat(F.lit("o"), "l_orderkey").alias("text"))
    return R.nearest_ancestors(li, by=["doc_id"]).select("doc_id", "pos", "parent_list")


@query(f"WITH {LINES} SELECT doc_id, min(pos) FILTER (regexp_matches(text, '(?i)licen[cs]e')) AS licence_at, min(pos) FILTER (regexp_matches(text, '(?i)\\bthe\\b')) AS the_at FROM lines GROUP BY doc_id")
def zone_bounds(spark, sf_dir):
    rows = R.zone(R.zone(lines(spark, sf_dir), "licen[cs]e", "licence_at", by=["doc_id"], pos="pos"), r"\bthe\b", "the_at", by=["doc_id"], pos="pos")
    return rows.groupBy("doc_id").agg(F.max("licence_at").alias("licence_at"), F.max("the_at").alias("the_at"))


@query(f"WITH {LINES}, g AS (SELECT doc_id AS file_id, text_element AS definition, string_agg(text, chr(10) ORDER BY pos) AS text FROM lines GROUP BY doc_id, text_element) SELECT file_id, definition, md5(text) AS text FROM g")
def def2text_concat(spark, sf_dir):
    fa = lines(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "pos", "text", F.lit("1").alias("section_id"), F.lit("1").alias("sub_section_id"), F.col("text_element").alias("definition"))
    return M.definition_texts(fa).withColumn("text", F.md5(F.encode("text", "UTF-8")))


@query("""SELECT page_id AS doc_id, b AS text_block_id, CASE WHEN e = 0 THEN 'section' ELSE 'list' END AS text_element, CASE WHEN e = 1 THEN '(a)' END AS list_id, CASE WHEN e = 0 THEN url ELSE url || '/' || i END AS text, b * 1000000000 + e * 1000000 + i AS pos
FROM pages, (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1, 1]) AS e, unnest([0, 0, 1]) AS i)""")
def stack_elements(spark, sf_dir):
    none_i, none_s = F.lit(None).cast("array<int>"), F.lit(None).cast("string")
    elem = lambda key, order, text: F.struct(F.lit(key).alias("key"), F.lit(order).alias("order"), none_s.alias("list_id"), text.alias("text"), F.lit(False).alias("is_table"), none_s.alias("table_json"), none_i.alias("bbox"), none_i.alias("page_id"))
    block = lambda i: F.struct(F.lit(i).alias("id"), F.array(elem("section", 0, F.array("url")), elem("list_(a)", 1, F.array(F.concat("url", F.lit("/0")), F.concat("url", F.lit("/1"))))).alias("elements"))
    parsed = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.array(block(0), block(1)).alias("content"))
    return E.stack_elements(parsed).select("doc_id", F.col("text_block_id").cast("long").alias("text_block_id"), "text_element", "list_id", "text", "pos")


@query("""WITH m AS (SELECT n_nationkey, 'name' AS kind, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation)
SELECT kind, value, min(n_nationkey)::BIGINT AS first_key FROM m GROUP BY kind, value""")
def melt_dedupe(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    long_ = n.unpivot(["n_nationkey"], ["name", "region"], "kind", "value")
    return R.keep_first(long_, ["kind", "value"], [F.col("n_nationkey")]).select("kind", "value", F.col("n_nationkey").cast("long").alias("first_key"))


DOC_RULES = [V.Rule("text", False, 2000), V.Rule("lang", False), V.Rule("doc_id", False)]


def _checked(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("lang", F.when(~F.col("lang").isin("fr", "es"), F.col("lang")))


@query("""WITH c AS (SELECT source, doc_id, unnest(['text', 'lang', 'doc_id']) AS field, unnest([len(text) > 2000, lang = 'fr' OR len(lang) > 1 AND lang = 'es', false]) AS bad FROM documents)
SELECT source, field, count(*) FILTER (bad) AS broken, coalesce(array_to_string(list_sort(list(doc_id) FILTER (bad))[1:20], ','), '') AS examples FROM c GROUP BY source, field""")
def validate_rows(spark, sf_dir):
    found = V.violations(_checked(spark, sf_dir), DOC_RULES, by=["source"], pos="doc_id")
    return found.select("source", "field", "broken", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("""WITH c AS (SELECT source, doc_id, unnest(['text', 'lang', 'doc_id']) AS field, unnest([text IS NULL OR len(text) > 2000, lang IS NULL OR lang IN ('fr', 'es'), doc_id IS NULL]) AS bad FROM documents)
SELECT source, field, doc_id AS pos FROM c WHERE bad""")
def validate_positions(spark, sf_dir):
    """Every position that breaks a rule, where validate_rows has the counts and the least few."""
    return V.broken_positions(_checked(spark, sf_dir), DOC_RULES, by=["source"], pos="doc_id")


@query("""SELECT doc_id, CASE WHEN lang = 'es' THEN 'file_type is neither FA nor TS' WHEN doc_id % 7 = 0 THEN 'the file''s suffix isn''t known' END AS error FROM documents""")
def request_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    suffix = F.when((F.col("doc_id") % 7 == 0) & (F.col("lang") != "es"), ".xyz").otherwise(".pdf")
    req = docs.select("doc_id", F.col("doc_id").alias("file_id"), F.concat("source", suffix).alias("file_name"), F.concat(F.lit("/data/"), "source", suffix).alias("file_path"), F.when(F.col("lang") == "es", "XX").otherwise("FA").alias("file_type"))
    return V.request_errors(req).select("doc_id", "error")


@query()
def agreement_clauses(spark, sf_dir):
    """Documents read as agreements: every text gets the sentences that open its zones, so that all rows are extracted."""
    body = lines(spark, sf_dir).select("doc_id", (F.col("pos") + 10).alias("pos"), "text_element", "text")
    heads = [("section", "CONTENTS"), ("paragraph", "THIS AGREEMENT is dated today"), ("paragraph", 'ALPHA LIMITED as borrower (the "Borrower")'), ("paragraph", "IT IS AGREED as follows"), ("section", "1. DEFINITIONS"), ("paragraph", '"Margin" means two per cent.')]
    ids = body.select("doc_id").distinct()
    front = ids.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(a).alias("e"), F.lit(b).alias("t")) for a, b in heads))).alias("pos", "h")).select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("h.e").alias("text_element"), F.col("h.t").alias("text"))
    back = ids.select("doc_id", F.lit(1_000_000).alias("pos"), F.lit("section").alias("text_element"), F.lit("SCHEDULE 1 THE ORIGINAL LENDERS").alias("text"))
    rows = front.unionByName(body).unionByName(back).withColumns({"text_block_id": F.lit(0), "list_id": F.lit(None).cast("string"), "bbox": F.lit(None).cast("array<int>"), "page_id": F.lit("1"), "pos": F.col("pos").cast("long")})
    return E.extract_agreement(rows)[0].select("doc_id", "pos", "section_id", "section", "definition", "identifier", "text_element")
