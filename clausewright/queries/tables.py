"""Stand-ins for the engine's inputs, derived from whole driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parted(df: DataFrame, *keys: str, rows: int = 100_000) -> DataFrame:
    """Rows dealt by keys (or in turn) over as many partitions as their number asks for: a partition's share, and with it what a
    task holds or has to compute, stays the same however long the table is.  Counting reads the files' footers alone.
    """
    return df.repartition(shares(df, rows), *keys)


def shares(df: DataFrame, rows: int) -> int:
    """Over how many partitions :func:`parted` deals."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def lines(spark: SparkSession, sf_dir: str, dealt: int | None = None) -> DataFrame:
    """Lines of documents that aren't blank: (doc_id, pos, text, text_element); ``dealt``: so many documents to a partition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs if dealt is None else parted(docs, rows=dealt)
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    return each.withColumn("text_element", F.when(F.size(F.split("text", " ")) <= 5, "section").otherwise("paragraph"))


LINES = """lines AS (
  SELECT doc_id, pos, text, CASE WHEN len(string_split(text, ' ')) <= 5 THEN 'section' ELSE 'paragraph' END AS text_element
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
  WHERE trim(text) <> '')"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records made of orders' lines: the first five lines are candidates, flag A judges them right, R adds one by hand."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 5")
    clause = F.concat(F.lit("Cl_"), F.col("l_partkey") % 30, F.lit("."), F.col("l_linenumber"))
    ident = F.when(F.col("l_linenumber") % 4 == 0, clause).when(F.col("l_linenumber") % 4 == 1, F.concat(clause, F.lit("-Def"), F.col("l_suppkey") % 10)).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("Parties-"), F.col("l_suppkey") % 10)).otherwise(F.concat(F.lit("Sched_"), F.col("l_partkey") % 9))
    item = F.struct("n", ident.alias("i"), F.col("l_returnflag").alias("f"))
    grouped = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("a"))
    manual = F.transform(F.filter("a", lambda x: x["f"] == "R"), lambda x: x["i"])
    return grouped.select(
        (F.col("l_orderkey") % 10).alias("task_id"), F.col("l_orderkey").alias("pos"), F.concat(F.lit("term"), F.col("l_orderkey") % 50).alias("ts_term"), F.concat(F.lit("text"), F.col("l_orderkey")).alias("ts_text"),
        F.transform("a", lambda x: x["i"]).alias("identifier_list"), F.transform("a", lambda x: F.concat(F.lit("t"), x["i"])).alias("match_term_list"),
        F.when(F.col("l_orderkey") % 5 != 0, F.transform("a", lambda x: x["f"] == "A")).alias("result"), (F.col("l_orderkey") % 17 == 0).alias("is_irrelevant"),
        F.when(F.size(manual) > 0, manual).alias("manual_identifier"), F.when(F.size(manual) > 0, F.transform(manual, lambda m: F.concat(F.lit("m"), m))).alias("manual_content"),
    )


FB = """cand AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS f,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n,
    CASE l_linenumber % 4 WHEN 0 THEN 'Cl_' || (l_partkey % 30) || '.' || l_linenumber WHEN 1 THEN 'Cl_' || (l_partkey % 30) || '.' || l_linenumber || '-Def' || (l_suppkey % 10)
      WHEN 2 THEN 'Parties-' || (l_suppkey % 10) ELSE 'Sched_' || (l_partkey % 9) END AS i
  FROM lineitem),
fb0 AS (
  SELECT l_orderkey, list(i ORDER BY n) AS ids, list(f = 'A' ORDER BY n) AS judge, list(i ORDER BY n) FILTER (f = 'R') AS manual
  FROM cand WHERE n <= 5 GROUP BY l_orderkey),
fb AS (
  SELECT l_orderkey % 10 AS task_id, l_orderkey AS pos, 'term' || (l_orderkey % 50) AS ts_term, 'text' || l_orderkey AS ts_text, ids,
    CASE WHEN l_orderkey % 5 <> 0 THEN judge END AS result, l_orderkey % 17 = 0 AS irr, manual
  FROM fb0),
judged AS (
  SELECT *, NOT irr AND result IS NOT NULL AS has, NOT irr AND result IS NULL AS dflt FROM fb),
rec AS (
  SELECT *, has OR dflt AS counted,
    CASE WHEN has THEN len(list_filter(result, lambda x: x)) WHEN dflt THEN 1 ELSE 0 END AS selected,
    CASE WHEN has THEN len(list_filter(result, lambda x: NOT x)) ELSE 0 END AS unselected,
    CASE WHEN has THEN list_transform(result, lambda x: x::INT) WHEN dflt THEN [1] ELSE []::INT[] END AS ranks,
    CASE WHEN has OR dflt THEN coalesce(manual, []::VARCHAR[]) ELSE []::VARCHAR[] END AS man
  FROM judged)"""

TYPE = "CASE WHEN regexp_matches({0}, '^Cl_.*-.*') THEN 'definitionClause' WHEN {0} LIKE 'Parties%' THEN 'partiesClause' WHEN {0} LIKE 'Cl\\_%' ESCAPE '\\' THEN 'clause' WHEN {0} LIKE 'Sched\\_%' ESCAPE '\\' THEN 'schedule' END"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of order lines: (doc_id, page_id, pos, text, box), a page for each supplier's lines of a part group."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    li = parted(li, "l_suppkey")
    w = Window.partitionBy("l_suppkey", F.col("l_partkey") % 7).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    x0, y0 = (F.col("l_extendedprice") % 900).cast("int"), (F.col("l_orderkey") % 950).cast("int")
    return li.select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 7).cast("int").alias("page_id"), F.row_number().over(w).alias("pos"), F.concat_ws("-", "l_returnflag", "l_linestatus", "l_linenumber").alias("text"),
        F.array(x0, y0, x0 + F.col("l_quantity").cast("int"), y0 + F.col("l_linenumber") * 5).alias("box"),
    )


BOXES = """boxes AS (
  SELECT l_suppkey AS doc_id, (l_partkey % 7)::INT AS page_id,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos,
    l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS text,
    trunc(l_extendedprice % 900)::INT AS x0, (l_orderkey % 950)::INT AS y0, trunc(l_extendedprice % 900)::INT + trunc(l_quantity)::INT AS x1, (l_orderkey % 950)::INT + l_linenumber * 5 AS y1
  FROM lineitem)"""
