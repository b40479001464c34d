"""Reviewer feedback: hits, misses, ranks and clause types, as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import patterns as P
from clausewright.functions.identifiers import identifier_type

TOP_N = 5


def judged(fb: DataFrame, compat: bool = True) -> DataFrame:
    """Records with what they count for.

    A record with judgements counts them; one without, but with identifiers, accepts the first; all others are left out
    but still count as content.  ``irrelevant``: every judgement is false and nothing was added by hand.
    """
    has = F.coalesce(F.size("result") > 0, F.lit(False)) & ~F.coalesce("is_irrelevant", F.lit(False))
    default = F.col("result").isNull() & F.col("identifier_list").isNotNull() & ~F.coalesce("is_irrelevant", F.lit(False))
    selected = F.when(has, F.size(F.filter("result", lambda r: r))).when(default, 1).otherwise(0)
    manual = F.filter(F.coalesce("manual_identifier", F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")) != "")
    counted = has | default
    none = F.array().cast("array<string>")
    hit_types = F.when(has, F.filter(F.zip_with("identifier_list", "result", lambda i, r: F.when(r, identifier_type(i, compat))), lambda t: t.isNotNull())).otherwise(none)
    return fb.withColumns({
        "counted": counted, "selected": selected, "unselected": F.when(has, F.size("result") - selected).otherwise(0),
        "ranks": F.when(has, F.transform("result", lambda r: r.cast("int"))).when(default, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
        "irrelevant": has & F.forall("result", lambda r: ~r) & F.col("manual_identifier").isNull(),
        "manual": F.when(counted, manual).otherwise(none), "hit_types": F.coalesce(hit_types, none),
        "miss_types": F.when(counted, F.transform(manual, lambda m: identifier_type(m, compat))).otherwise(none),
    })


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part / whole * 100, 2)


def kpis(fb: DataFrame, *, by: str = "task_id", top: int = TOP_N, compat: bool = True) -> DataFrame:
    """One row per task.

    A miss is an unselected candidate that a manual one stands against: the lesser of the two counts of a record.  Rates
    are null where nothing hit or missed.  All is one pass with partial aggregation; ``top_miss_term`` alone needs a
    second, small one.
    """
    r = judged(fb, compat)
    of_type = lambda col, t: F.sum(F.size(F.filter(col, lambda x: x == t)))
    at = lambda k: F.sum(F.coalesce(F.get("ranks", F.lit(k - 1)), F.lit(0)))
    sums = {
        "term_count": F.count_distinct(F.nullif("ts_term", F.lit(""))), "term_content_count": F.count(F.lit(1)), "irrelevant_content_count": F.count_if("irrelevant"),
        "hit_count": F.sum("selected"), "miss_count": F.sum(F.least("unselected", F.size("manual"))), "hit_instance_count": F.count_if(F.col("selected") > 0),
        "manual_count": F.sum(F.size("manual")), "manual_instance_count": F.count_if(F.size("manual") > 0),
    }
    sums |= {f"{t}_hit_count": of_type("hit_types", t) for t in P.CLAUSE_TYPES} | {f"{t}_miss_count": of_type("miss_types", t) for t in P.CLAUSE_TYPES}
    sums |= {f"top{k}_hit_count": at(k) for k in range(1, top + 1)}
    out = r.groupBy(by).agg(*(c.alias(n) for n, c in sums.items()))
    whole, relevant = F.nullif(F.col("hit_count") + F.col("miss_count"), F.lit(0)), F.col("term_content_count") - F.col("irrelevant_content_count")
    hits = F.col("hit_count") > 0
    up_to = lambda k: sum((F.col(f"top{i}_hit_count") for i in range(2, k + 1)), F.col("top1_hit_count"))
    rates = {
        "avg_accuracy": _rate(F.col("hit_count"), whole), "relevant_instance_rate": _rate(relevant, F.col("term_content_count")), "miss_rate": _rate(F.col("miss_count"), whole),
        "avg_hit_per_hit_instance": F.col("hit_count") / F.nullif("hit_instance_count", F.lit(0)), "manual_instance_rate": F.when(relevant > 0, _rate(F.col("manual_instance_count"), relevant)),
    }
    for k in range(1, top + 1):
        rates |= {f"top{k}_hit_rate": F.when(hits, _rate(F.col(f"top{k}_hit_count"), whole)), f"up_to_top{k}_hit_count": up_to(k), f"up_to_top{k}_hit_rate": F.when(hits, _rate(up_to(k), whole))}
    return out.withColumns(rates).join(top_miss(fb, by=by, compat=compat), by, "left")


def rank_histogram(fb: DataFrame, *, by: str = "task_id", compat: bool = True) -> DataFrame:
    """(task, rank, hits) from the first rank on."""
    each = judged(fb, compat).select(by, F.posexplode("ranks").alias("rank", "hit"))
    return each.groupBy(by, (F.col("rank") + 1).alias("rank")).agg(F.sum("hit").alias("hits"))


def type_counts(fb: DataFrame, *, by: str = "task_id", compat: bool = True) -> DataFrame:
    """(task, clause_type, hits, misses), a row for every type."""
    r = judged(fb, compat)
    each = r.select(by, F.explode("hit_types").alias("clause_type"), F.lit(1).alias("h"), F.lit(0).alias("m")).unionByName(r.select(by, F.explode("miss_types").alias("clause_type"), F.lit(0).alias("h"), F.lit(1).alias("m")))
    zero = r.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, P.CLAUSE_TYPES))).alias("clause_type"), F.lit(0).alias("h"), F.lit(0).alias("m"))
    return each.unionByName(zero).where("clause_type is not null").groupBy(by, "clause_type").agg(F.sum("h").alias("hits"), F.sum("m").alias("misses"))


def section_misses(fb: DataFrame, *, by: str = "task_id", pos: str = "pos", compat: bool = True) -> DataFrame:
    """(task, ts_term, misses, first_pos) of terms that reviewers added to."""
    return judged(fb, compat).where(F.size("manual") > 0).groupBy(by, "ts_term").agg(F.sum(F.size("manual")).alias("misses"), F.min(pos).alias("first_pos"))


def top_miss(fb: DataFrame, *, by: str = "task_id", pos: str = "pos", compat: bool = True) -> DataFrame:
    """(task, top_miss_term): the term with the most misses; with compat the one with the fewest, as was reported.

    The first seen of equals counts."""
    rows = section_misses(fb, by=by, pos=pos, compat=compat)
    order = F.struct("misses", "first_pos")
    pick = F.min_by("ts_term", order) if compat else F.max_by("ts_term", F.struct("misses", -F.col("first_pos")))
    return rows.groupBy(by).agg(pick.alias("top_miss_term"))


def checked(kpi: DataFrame) -> DataFrame:
    """Fails on a task that has neither a hit nor a miss, as the strict report does."""
    ok = F.assert_true(F.col("hit_count") + F.col("miss_count") > 0, F.lit("a task has neither hits nor misses"))
    return kpi.withColumn("__ok", ok).where(F.col("__ok").isNull()).drop("__ok")
