"""Lists, phrases and sections whose number, levels, order and texts come from order lines and customers; SQL computes what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.operators import extract as E
from clausewright.operators import tokenise as K
from clausewright.queries.tables import parted, shares, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _letters(c: Column) -> Column:
    """A number as letters."""
    return F.translate(c.cast("string"), "0123456789", "abcdefghkm")


#: The lines of an order as list items: (a), (b) below (1), (2); lines with flag N go a level down unless they are every eighth or
#: come after a line without a number (``bare``; only lists over several texts have such).  Some bodies name other items.
ITEMS = """ordered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem),
marked AS (SELECT *, l_discount = 0.05 AND r > 1 AND {bare} AS bare, 'deliver ' || l_partkey || ' units' || CASE l_suppkey % 3 WHEN 0 THEN ' under Clause (b) and section 4. of it;' WHEN 1 THEN ' at once;' ELSE ';' END AS body FROM ordered),
levelled AS (SELECT *, CASE WHEN l_returnflag = 'N' AND r % 8 <> 1 AND NOT coalesce(lag(bare) OVER (PARTITION BY l_orderkey ORDER BY r), false) THEN 2 ELSE 1 END AS level FROM marked),
counted AS (SELECT *, count(*) FILTER (level = 1 AND NOT bare) OVER (PARTITION BY l_orderkey ORDER BY r) AS k FROM levelled),
items AS (SELECT *, count(*) FILTER (level = 2 AND NOT bare) OVER (PARTITION BY l_orderkey, k ORDER BY r) AS j FROM counted)"""


#: Lines of a partition.
LINES_EACH = 100_000


def items(spark, sf_dir, bare: bool) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy("r")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    rows = parted(lines, "l_orderkey", rows=LINES_EACH).withColumn("r", F.row_number().over(w))
    end = F.when(F.col("l_suppkey") % 3 == 0, " under Clause (b) and section 4. of it;").when(F.col("l_suppkey") % 3 == 1, " at once;").otherwise(";")
    rows = rows.withColumns({"bare": (F.col("l_discount") == 0.05) & (F.col("r") > 1) & F.lit(bare), "body": F.concat(F.lit("deliver "), "l_partkey", F.lit(" units"), end)})
    down = (F.col("l_returnflag") == "N") & (F.col("r") % 8 != 1) & ~F.coalesce(F.lag("bare").over(order), F.lit(False))
    rows = rows.withColumn("level", F.when(down, 2).otherwise(1))
    rows = rows.withColumn("k", F.count(F.when((F.col("level") == 1) & ~F.col("bare"), 1)).over(order))
    rows = rows.withColumn("j", F.count(F.when((F.col("level") == 2) & ~F.col("bare"), 1)).over(Window.partitionBy("l_orderkey", "k").orderBy("r")))
    number = F.when(F.col("level") == 1, F.concat(F.lit("("), "k", F.lit(") "))).otherwise(F.concat(F.lit("("), F.expr("chr(96 + j)"), F.lit(") ")))
    return rows.select("l_orderkey", "r", F.when(F.col("bare"), F.lit("no number here")).otherwise(F.concat(number, "body")).alias("text"))


ID = "'(' || k || ')' || CASE WHEN level = 2 THEN '(' || chr((96 + j)::INT) || ')' ELSE '' END"


@query(f"WITH {ITEMS.format(bare='false')} SELECT l_orderkey, r::INT AS r, {ID} AS list_id, body AS text FROM items")
def varied_lists(spark, sf_dir):
    """Every order as one text, a list of two levels with as many items as it has lines."""
    each = items(spark, sf_dir, False).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ").alias("text"))
    found = each.select("l_orderkey", F.posexplode(K.list_item_column("text")).alias("at", "i"))
    return found.select("l_orderkey", (F.col("at") + 1).alias("r"), "i.list_id", "i.text")


@query(f"WITH {ITEMS.format(bare='true')} SELECT l_orderkey, r::BIGINT AS r, CASE WHEN NOT bare THEN {ID} END AS list_id, CASE WHEN bare THEN 'no number here' ELSE body END AS text FROM items")
def varied_lists_across_texts(spark, sf_dir):
    """Every line a text of its own: lists go on over the texts of an order until one has no number."""
    rows = items(spark, sf_dir, True).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("block_id"), F.col("r").cast("long").alias("pos"), F.lit(False).alias("is_definition"), "text")
    found = K.list_items_in_blocks(rows, partitions=shares(table(spark, sf_dir, "lineitem"), LINES_EACH)).select("doc_id", "pos", F.explode("items").alias("i"))
    return found.select(F.col("doc_id").alias("l_orderkey"), F.col("pos").alias("r"), "i.list_id", "i.text")


@query("""WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, '(a)' AS list_id, (r - 1)::INT AS n, 'party ' || translate(l_partkey::VARCHAR, '0123456789', 'abcdefghkm') || ' pays' || CASE WHEN r = n THEN '.' WHEN r = n - 1 THEN '; and' ELSE ';' END AS phrase FROM ordered""")
def varied_phrases(spark, sf_dir):
    """Every order as an item with a phrase for each line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumns({"r": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))})
    end = F.when(F.col("r") == F.col("n"), ".").when(F.col("r") == F.col("n") - 1, "; and").otherwise(";")
    said = F.struct("r", F.concat(F.lit("party "), _letters(F.col("l_partkey")), F.lit(" pays"), end).alias("t"))
    each = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), " ").alias("text"))
    each = each.withColumn("items", F.array(F.struct(F.lit("(a)").alias("list_id"), "text")))
    return K.item_phrases(each, ["l_orderkey"]).select("l_orderkey", "list_id", "n", "phrase")


CUSTOMERS = "c AS (SELECT c_custkey AS doc_id, c_custkey % 37 + 1 AS a, c_custkey % 9 + 1 AS b, translate(c_custkey::VARCHAR, '0123456789', 'abcdefghkm') AS name FROM customer)"


def _customers(spark, sf_dir, element: str, text: Column) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 37 + 1).alias("a"), (F.col("c_custkey") % 9 + 1).alias("b"), _letters(F.col("c_custkey")).alias("name"))
    return c.select(F.col("doc").alias("doc_id"), F.lit(0).alias("text_block_id"), F.lit(0).cast("long").alias("pos"), F.lit(element).alias("text_element"), none("string").alias("list_id"), text.alias("text"), none("array<int>").alias("bbox"), F.lit("1").alias("page_id"))


@query(f"""WITH {CUSTOMERS} SELECT doc_id, 'section' AS text_element, a || '. TITLE ' || upper(name) || CASE WHEN doc_id % 3 = 0 THEN ' alone' ELSE '' END AS text FROM c
UNION ALL SELECT doc_id, 'sub_section', a || '.' || b || ' Text of ' || name FROM c WHERE doc_id % 3 <> 0""")
def varied_sections_in_one(spark, sf_dir):
    """Headings with a sub-section in the same line, numbered by customer; every third has none."""
    rest = F.when(F.col("doc") % 3 == 0, F.lit(" alone")).otherwise(F.concat(F.lit(" "), "a", F.lit("."), "b", F.lit(" Text of "), "name"))
    text = F.concat("a", F.lit(". TITLE "), F.upper("name"), rest)
    rows = _customers(spark, sf_dir, "section", text)
    return E.split_section_and_sub(rows).select("doc_id", "text_element", "text")


@query(f"""WITH {CUSTOMERS}, parts AS (SELECT *, 0 AS i, 'the end of ' || name || '.' AS text FROM c UNION ALL SELECT c.*, n, (a + n) || '.' || b || ' Next ' || name || CASE WHEN n < 1 + doc_id % 3 THEN '.' ELSE '' END FROM c, range(1, 4) AS t(n) WHERE n <= 1 + doc_id % 3)
SELECT doc_id, regexp_replace(text, '\\.$', '') AS text, i = 0 AS first FROM parts""")
def varied_embedded_sections(spark, sf_dir):
    """List items that one to three sub-sections follow in the same text."""
    many = (1 + F.col("doc") % 3).cast("int")
    tail = F.array_join(F.transform(F.sequence(F.lit(1), many), lambda n: F.concat((F.col("a") + n).cast("string"), F.lit("."), F.col("b").cast("string"), F.lit(" Next "), F.col("name"))), ". ")
    rows = _customers(spark, sf_dir, "list", F.concat(F.lit("the end of "), "name", F.lit(". "), tail))
    return E.split_embedded_sections(rows).select("doc_id", F.regexp_replace("text", r"\.$", "").alias("text"), (F.element_at("pos", -1) == 0).alias("first"))
