"""Matching queries over embeddings, order lines and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators import match as M
from clausewright.queries.tables import FB, feedback, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: The queries of a search are the rows whose id divides by 50; they are held against all rows.
PAIRS = """pairs AS (
  SELECT q.vec_id AS ts_id, r.vec_id AS fa_id, q.label AS ts_label, r.label AS label,
    round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "ts_id"), e.withColumnRenamed("vec_id", "fa_id")


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    q, r = _sides(spark, sf_dir)
    return M.cosine_top_k(q, r, k, query_id="ts_id", row_id="fa_id", digits=6)


@query(f"WITH {PAIRS} SELECT ts_id, fa_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY similarity DESC, fa_id) AS rank FROM pairs) WHERE rank <= 5")
def match_topk(spark, sf_dir):
    return _top(spark, sf_dir, 5)


@query(f"WITH {PAIRS} SELECT label, ts_id, fa_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY similarity DESC, fa_id) AS rank FROM pairs WHERE ts_label = label) WHERE rank <= 40")
def match_topk_by_type(spark, sf_dir):
    q, r = _sides(spark, sf_dir)
    return M.cosine_top_k(q, r, 40, query_id="ts_id", row_id="fa_id", by=["label"], digits=6)


@query(f"WITH {PAIRS} SELECT ts_id, fa_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY similarity DESC, fa_id) AS rank FROM pairs) WHERE rank <= 10")
def match_section_top10(spark, sf_dir):
    return _top(spark, sf_dir, 10)


def _hits(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fa_id"), F.concat(F.lit("Cl_"), "label").alias("identifier"))
    hits = M.fan_out(_top(spark, sf_dir, M.PER_TYPE), labels, on=["fa_id"])
    return hits.withColumns({"term": F.lpad(F.col("fa_id").cast("string"), 12, "0"), "match_type": F.lit("content")})


HITS = f"""{PAIRS}, hits AS (
  SELECT ts_id, fa_id, 'Cl_' || label AS identifier, lpad(fa_id::VARCHAR, 12, '0') AS term, similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY similarity DESC, fa_id) AS rank FROM pairs) WHERE rank <= 40),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_id, identifier ORDER BY similarity DESC, term) AS n FROM hits) WHERE n = 1)"""


@query(f"WITH {HITS} SELECT ts_id, identifier, term, similarity FROM best")
def match_dedupe_first(spark, sf_dir):
    return M.best_per_identifier(_hits(spark, sf_dir), ["ts_id"]).select("ts_id", "identifier", "term", "similarity")


@query(f"WITH {HITS} SELECT ts_id, string_agg(identifier || '=' || term, ';' ORDER BY similarity DESC, identifier) AS matches, count(*) AS n FROM best GROUP BY ts_id")
def match_assemble_lists(spark, sf_dir):
    rows = M.assemble(M.best_per_identifier(_hits(spark, sf_dir), ["ts_id"]), ["ts_id"])
    return rows.select("ts_id", F.array_join(F.transform("hits", lambda h: F.concat(h["identifier"], F.lit("="), h["term"])), ";").alias("matches"), F.size("hits").cast("long").alias("n"))


@query("""WITH rules(rule, section_rx, text_rx, definition_rx) AS (VALUES (0, '^a', 'brass', ''), (1, '', 'steel|tin', '1$'), (2, 'e', '', '^brand#2'), (3, 'economy|standard', 'o', '[13579]$'))
SELECT rule, count(*) AS parts, sum(p_size)::BIGINT AS sizes FROM part, rules
WHERE regexp_matches(p_type, '(?i)' || section_rx) AND regexp_matches(p_name, '(?i)' || text_rx) AND regexp_matches(p_brand, '(?i)' || definition_rx) GROUP BY rule""")
def rule_injection_theta(spark, sf_dir):
    rules = M.rule_table(spark, [("^a", "brass", ""), ("", "steel|tin", "1$"), ("e", "", "^brand#2"), ("economy|standard", "o", "[13579]$")], ("section_rx", "text_rx", "definition_rx"))
    part = table(spark, sf_dir, "part")
    met = part.join(F.broadcast(rules), M._finds("section_rx", "p_type") & M._finds("text_rx", "p_name") & M._finds("definition_rx", "p_brand"))
    return met.groupBy("rule").agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").cast("long").alias("sizes"))


def _as_hits(fb: DataFrame) -> DataFrame:
    hit = lambda i, n: F.struct(F.concat(F.lit("t"), i).alias("term"), i.alias("identifier"), (1.0 - n / 10.0).cast("double").alias("similarity"), F.lit("content").alias("match_type"))
    return fb.withColumn("hits", F.transform("identifier_list", hit))


@query(f"""WITH {FB}, moved AS (SELECT pos, list_filter(ids, lambda x: x LIKE 'Sched%') AS yes, list_filter(ids, lambda x: x NOT LIKE 'Sched%') AS no FROM fb)
SELECT pos, array_to_string(list_concat(list_concat(yes[1:4], no), yes[5:]), ';') AS identifiers FROM moved""")
def schedule_rerank(spark, sf_dir):
    rows = _as_hits(feedback(spark, sf_dir))
    moved = M.move_first(F.col("hits"), lambda h: h["identifier"].startswith("Sched"))
    return rows.select("pos", F.array_join(F.transform(moved, lambda h: h["identifier"]), ";").alias("identifiers"))


@query()
def merge_identifiers(spark, sf_dir):
    rows = _as_hits(feedback(spark, sf_dir))
    return rows.select("pos", F.array_join(F.transform(M.merge_identifiers(F.col("hits")), lambda h: h["identifier"]), ";").alias("identifiers"))


@query(f"WITH {FB} SELECT pos, array_to_string(ids[1:3], ';') AS identifiers FROM fb")
def match_trim(spark, sf_dir):
    rows = _as_hits(feedback(spark, sf_dir))
    return rows.select("pos", F.array_join(F.transform(M.trim(F.col("hits"), 3), lambda h: h["identifier"]), ";").alias("identifiers"))


@query("""SELECT lower(name) AS text, id AS identifier FROM (SELECT n_name AS name, 'N' || n_nationkey AS id FROM nation UNION SELECT r_name, 'R' || r_regionkey FROM region UNION SELECT n_name, 'N' || n_regionkey FROM nation)""")
def candidate_union_distinct(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = lambda df, name, p, key: df.select(F.lower(name).alias("text"), F.concat(F.lit(p), key).alias("identifier"))
    return named(n, "n_name", "N", "n_nationkey").unionByName(named(r, "r_name", "R", "r_regionkey")).unionByName(named(n, "n_name", "N", "n_regionkey")).distinct()


@query("""SELECT file_id, identifier, count(*) AS n, max(heading) AS heading FROM (
  SELECT o_orderpriority AS file_id, o_orderstatus || '_' || (o_custkey % 20) AS identifier, first_value(floor(o_totalprice)::BIGINT::VARCHAR) OVER (PARTITION BY o_orderpriority, o_orderstatus || '_' || (o_custkey % 20) ORDER BY o_orderkey) AS heading FROM orders) GROUP BY file_id, identifier""")
def heading_by_identifier(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    fa = o.select(F.col("o_orderpriority").alias("file_id"), F.col("o_orderkey").alias("pos"), F.concat_ws("_", "o_orderstatus", F.col("o_custkey") % 20).alias("identifier"), none.alias("schedule"), F.floor("o_totalprice").cast("long").cast("string").alias("section"), none.alias("sub_section"))
    found = M.heading_by_identifier(fa)
    return fa.groupBy("file_id", "identifier").agg(F.count(F.lit(1)).alias("n")).join(found, ["file_id", "identifier"])


@query("""SELECT o_orderpriority AS ts_term, o_orderkey AS row_id, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority || ': ' || o_orderstatus || ' order' ELSE o_orderstatus || ' order' END AS processed_text FROM orders""")
def feature_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("section"), F.concat("o_orderstatus", F.lit(" order")).alias("text"), F.when(F.col("o_orderstatus") == "O", "paragraph").otherwise("section").alias("text_element"))
    return rows.select(F.col("section").alias("ts_term"), "row_id", M.feature_text("TS").alias("processed_text"))


@query("""SELECT c_custkey AS row_id, c_mktsegment AS section, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def semi_anti_sections(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    out = lambda df, yes: df.select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("section"), F.lit(yes).alias("has_orders"))
    return out(c.join(o, "c_custkey", "left_semi"), True).unionByName(out(c.join(o, "c_custkey", "left_anti"), False))
