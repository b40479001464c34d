"""Feedback queries: figures, judgements and sentence pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import patterns as P
from clausewright.functions.identifiers import identifier_type
from clausewright.operators import export as X
from clausewright.operators import feedback as A
from clausewright.operators import pairs as N
from clausewright.queries.tables import FB, TYPE, feedback, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _of(items: str, kind: str) -> str:
    return f"sum(len(list_filter({items}, lambda x: {TYPE.format('x')} = '{kind}')))::BIGINT"


HIT_IDS = "CASE WHEN has THEN list_filter(ids, lambda x, i: result[i]) ELSE []::VARCHAR[] END"
_COUNTS = ", ".join([f"{_of('hit_ids', t)} AS \"{t}_hit_count\", {_of('man', t)} AS \"{t}_miss_count\"" for t in P.CLAUSE_TYPES])
_RANKS = ", ".join(f"sum(coalesce(ranks[{k}], 0))::BIGINT AS top{k}_hit_count" for k in range(1, 6))
_UP = {k: " + ".join(f"top{i}_hit_count" for i in range(1, k + 1)) for k in range(1, 6)}
_RATES = ", ".join(f"round(CASE WHEN hit_count > 0 THEN top{k}_hit_count / w * 100 END, 2) AS top{k}_hit_rate, ({_UP[k]})::BIGINT AS up_to_top{k}_hit_count, round(CASE WHEN hit_count > 0 THEN ({_UP[k]}) / w * 100 END, 2) AS up_to_top{k}_hit_rate" for k in range(1, 6))
KPI = f"""{FB}, sums AS (
  SELECT task_id, count(DISTINCT ts_term) AS term_count, count(*) AS term_content_count,
    count(*) FILTER (has AND len(list_filter(result, lambda x: x)) = 0 AND manual IS NULL) AS irrelevant_content_count,
    sum(selected)::BIGINT AS hit_count, sum(least(unselected, len(man)))::BIGINT AS miss_count, count(*) FILTER (selected > 0) AS hit_instance_count,
    sum(len(man))::BIGINT AS manual_count, count(*) FILTER (len(man) > 0) AS manual_instance_count, {_COUNTS}, {_RANKS}
  FROM (SELECT *, {HIT_IDS} AS hit_ids FROM rec) GROUP BY task_id),
missed AS (SELECT task_id, ts_term, sum(len(man)) AS m, min(pos) AS first_pos FROM rec WHERE len(man) > 0 GROUP BY task_id, ts_term),
kpi AS (
  SELECT s.*, round(hit_count / w * 100, 2) AS avg_accuracy, round((term_content_count - irrelevant_content_count) / term_content_count * 100, 2) AS relevant_instance_rate,
    round(miss_count / w * 100, 2) AS miss_rate, hit_count / nullif(hit_instance_count, 0) AS avg_hit_per_hit_instance,
    round(CASE WHEN term_content_count > irrelevant_content_count THEN manual_instance_count / (term_content_count - irrelevant_content_count) * 100 END, 2) AS manual_instance_rate, {_RATES},
    (SELECT arg_min(ts_term, m * 1000000000000 + first_pos) FROM missed x WHERE x.task_id = s.task_id) AS top_miss_term
  FROM (SELECT *, nullif(hit_count + miss_count, 0) AS w FROM sums) s)"""


@query(f"WITH {KPI} SELECT * EXCLUDE (w) FROM kpi")
def feedback_kpi(spark, sf_dir):
    return A.kpis(feedback(spark, sf_dir))


@query(f"WITH {FB} SELECT task_id, rank, sum(hit)::BIGINT AS hits FROM (SELECT task_id, unnest(ranks) AS hit, unnest(range(1, len(ranks) + 1))::INT AS rank FROM rec) GROUP BY task_id, rank")
def feedback_rank_hist(spark, sf_dir):
    return A.rank_histogram(feedback(spark, sf_dir))


@query(f"""WITH {FB}, each AS (SELECT task_id, unnest({HIT_IDS}) AS i, 1 AS h, 0 AS m FROM rec UNION ALL SELECT task_id, unnest(man), 0, 1 FROM rec),
z AS (SELECT DISTINCT task_id, unnest(['definitionClause', 'partiesClause', 'clause', 'schedule']) AS clause_type FROM rec)
SELECT z.task_id, z.clause_type, coalesce(sum(h), 0)::BIGINT AS hits, coalesce(sum(m), 0)::BIGINT AS misses
FROM z LEFT JOIN each ON each.task_id = z.task_id AND {TYPE.format('each.i')} = z.clause_type GROUP BY z.task_id, z.clause_type""")
def feedback_type_counts(spark, sf_dir):
    return A.type_counts(feedback(spark, sf_dir))


@query(f"WITH {FB} SELECT task_id, ts_term, sum(len(man))::BIGINT AS misses, min(pos) AS first_pos FROM rec WHERE len(man) > 0 GROUP BY task_id, ts_term")
def feedback_miss(spark, sf_dir):
    return A.section_misses(feedback(spark, sf_dir))


@query(f"WITH {KPI} SELECT task_id, arg_min(ts_term, m * 1000000000000 + first_pos) AS fewest, arg_max(ts_term, m * 1000000000000 - first_pos) AS most FROM missed GROUP BY task_id")
def feedback_top_miss(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    return A.top_miss(fb).withColumnRenamed("top_miss_term", "fewest").join(A.top_miss(fb, compat=False).withColumnRenamed("top_miss_term", "most"), "task_id")


@query(f"WITH {KPI}, long AS (UNPIVOT (SELECT task_id, " + ", ".join(f"{m[0]}::DOUBLE AS {m[0]}" for m in X.FIGURES) + " FROM kpi) ON COLUMNS(* EXCLUDE (task_id)) INTO NAME metric VALUE value) SELECT task_id, metric, value FROM long")
def kpi_unpivot(spark, sf_dir):
    return X.long_form(A.kpis(feedback(spark, sf_dir))).where("value is not null").select("task_id", "metric", "value")


@query(f"SELECT i, {TYPE.format('i')} AS kind, n FROM (WITH {FB} SELECT i, count(*) AS n FROM (SELECT unnest(ids) AS i FROM fb) GROUP BY i)")
def identifier_types(spark, sf_dir):
    each = feedback(spark, sf_dir).select(F.explode("identifier_list").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return each.select("i", identifier_type(F.col("i")).alias("kind"), "n")


ANY, ALL, NONE = "len(list_filter(result, lambda x: x)) > 0", "len(list_filter(result, lambda x: NOT x)) = 0", "len(list_filter(result, lambda x: x)) = 0"


@query(f"""WITH {FB} SELECT pos, CASE WHEN irr OR (result IS NOT NULL AND {NONE} AND manual IS NULL) THEN 'N/A' WHEN result IS NULL AND manual IS NULL THEN 'N/A'
  WHEN result IS NOT NULL AND {ALL} AND manual IS NULL THEN 'All Matched' WHEN (result IS NULL OR {NONE}) AND manual IS NOT NULL THEN 'All Not Matched'
  WHEN {ANY} AND manual IS NULL THEN 'All Matched' ELSE 'Partially Matched' END AS overall,
  coalesce(len(list_filter(result, lambda x: x)), 0)::INT AS matched, coalesce(len(manual), 0)::INT AS added FROM fb""")
def judge_all(spark, sf_dir):
    fb = feedback(spark, sf_dir)
    return fb.select("pos", X.overall(F.col("result"), F.col("is_irrelevant"), F.col("manual_identifier")).alias("overall"), X.true_count(F.col("result")).alias("matched"), X.present_count(F.col("manual_identifier")).alias("added"))


@query("""WITH g AS (SELECT l_orderkey, l_suppkey % 5 AS grp, list(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'TP' WHEN l_returnflag = 'A' THEN 'FP' WHEN l_linestatus = 'O' THEN 'FN' ELSE 'TN' END) AS j FROM lineitem GROUP BY l_orderkey, l_suppkey % 5),
v AS (SELECT grp, CASE WHEN list_contains(j, 'TP') THEN 'TP' WHEN len(list_filter(j, lambda x: x <> 'TN')) = 0 THEN 'TN' WHEN list_contains(j, 'FN') THEN 'FN' WHEN len(list_filter(j, lambda x: x <> 'FP')) = 0 THEN 'FP' ELSE 'mixed' END AS v FROM g)
SELECT grp, count(*) FILTER (v = 'TP') AS tp, count(*) FILTER (v = 'TN') AS tn, count(*) FILTER (v = 'FN') AS fn, count(*) FILTER (v = 'FP') AS fp,
  round(count(*) FILTER (v = 'TP') / nullif(count(*) FILTER (v IN ('TP', 'FN')), 0), 6) AS hit_rate FROM v GROUP BY grp""")
def confusion_counts(spark, sf_dir):
    right, open_ = F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("grp"), F.when(right & open_, "TP").when(right, "FP").when(open_, "FN").otherwise("TN").alias("judge"))
    return X.confusion(X.group_judgement(rows, by=["l_orderkey", "grp"]), by=["grp"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount <> 0 THEN printf('%.2f%%', l_discount * 100) END AS shown FROM lineitem")
def similarity_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", X.percent(F.col("l_discount")).alias("shown"))


def _decorated(fb):
    named = lambda c: F.transform(c, lambda i: F.concat(i, F.lit("【"), F.upper(i), F.lit(" - sub】")))
    return fb.withColumns({"identifier_list": named("identifier_list"), "manual_identifier": named("manual_identifier")})


PAIRS = f"""{FB}, deco AS (SELECT *, list_transform(ids, lambda i: i || '【' || upper(i) || ' - sub】') AS dids, list_transform(manual, lambda i: i || '【' || upper(i) || ' - sub】') AS dman FROM fb),
j AS (SELECT *, unnest(range(1, (CASE WHEN result IS NULL THEN 1 ELSE len(result) END) + 1)) AS n FROM deco),
m AS (SELECT *, unnest(range(1, coalesce(len(manual), 0) + 1)) AS n FROM deco),
pairs AS (
  SELECT task_id, ts_term, ts_text, dids[n] AS identifier, upper(ids[n]) AS fa_section, 'sub' AS fa_sub_section, 't' || ids[n] AS fa_text, false AS is_manual_content, CASE WHEN result IS NULL OR result[n] THEN 'entailment' ELSE 'contradiction' END AS label FROM j
  UNION ALL SELECT task_id, ts_term, ts_text, dids[n], upper(manual[n]), 'sub', 'm' || manual[n], true, 'entailment' FROM m)"""


def _pairs(spark, sf_dir):
    return N.sentence_pairs(_decorated(feedback(spark, sf_dir)))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def sentence_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


ADJ = f"""{PAIRS}, w AS (SELECT ts_term || ': ' || ts_text AS a, fa_section || ' - ' || fa_sub_section || ': ' || fa_text AS b, label FROM pairs),
both_ways AS (SELECT a AS sentence, b AS other, label FROM w UNION SELECT b, a, label FROM w),
adj AS (SELECT sentence, count(DISTINCT other) FILTER (label = 'entailment') AS entailment, count(DISTINCT other) FILTER (label = 'contradiction') AS contradiction FROM both_ways GROUP BY sentence)"""


@query(f"WITH {ADJ} SELECT * FROM adj")
def pair_adjacency(spark, sf_dir):
    adj = N.adjacency(N.with_section(_pairs(spark, sf_dir)))
    return adj.select("sentence", F.size("entailment").cast("long").alias("entailment"), F.size("contradiction").cast("long").alias("contradiction"))


@query(f"WITH {ADJ} SELECT sentence FROM adj WHERE entailment > 0 AND contradiction > 0")
def pair_filter_both_labels(spark, sf_dir):
    return N.training_samples(N.adjacency(N.with_section(_pairs(spark, sf_dir))), copies=2).where("copy = 1").select(F.col("anchor").alias("sentence")).join(N.adjacency(N.with_section(_pairs(spark, sf_dir))).where("size(entailment) > 0 and size(contradiction) > 0").select("sentence"), "sentence", "left_semi").distinct()


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (label = 'entailment') AS entailment, count(*) FILTER (label = 'contradiction') AS contradiction FROM pairs")
def pair_label_counts(spark, sf_dir):
    return N.label_counts(_pairs(spark, sf_dir))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type")
def pairs_date_range(spark, sf_dir):
    e = N.in_dates(table(spark, sf_dir, "events"), F.expr("timestamp_ntz'2024-01-05 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'"), time="ts")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
