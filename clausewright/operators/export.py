"""What reports show: judgements, percentages, confusion counts and a long form of the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_N = 5


def default_judgement(result: Column, has_matches: Column, top: int = TOP_N) -> Column:
    """The first match is taken as right where nobody judged."""
    return F.coalesce(result, F.when(has_matches, F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), top - 1))))


def overall(result: Column, is_irrelevant: Column, manual: Column) -> Column:
    """N/A, All Matched, All Not Matched or Partially Matched."""
    added = F.coalesce(F.size(manual) > 0, F.lit(False))
    all_false, all_true = F.forall(result, lambda r: ~r), F.forall(result, lambda r: r)
    return (
        F.when(F.coalesce(is_irrelevant, F.lit(False)) | (F.coalesce(all_false, F.lit(False)) & ~added), "N/A")
        .when(result.isNull() & ~added, "N/A")
        .when(F.coalesce(all_true, F.lit(False)) & ~added, "All Matched")
        .when(F.coalesce(all_false, F.lit(True)) & added, "All Not Matched")
        .when(F.exists(result, lambda r: r) & ~added, "All Matched")
        .otherwise("Partially Matched")
    )


def true_count(result: Column) -> Column:
    return F.size(F.filter(F.coalesce(result, F.array().cast("array<boolean>")), lambda r: r))


def present_count(items: Column) -> Column:
    return F.size(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")) != ""))


def percent(x: Column, digits: int = 2) -> Column:
    """``12.34%``; nothing for null and zero."""
    return F.when(F.coalesce(x, F.lit(0.0)) != 0, F.format_string(f"%.{digits}f%%", x * 100))


def numbered_lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n\n"))), "")


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width): the longest text of each column, its name included."""
    wide = df.agg(*(F.greatest(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(len(c))).alias(c) for c in df.columns))
    return wide.unpivot([], df.columns, "column", "width")


# Unit and meaning of each figure, in the order of the report.
FIGURES = [
    ("avg_accuracy", "%", "hits of all hits and misses"),
    ("term_count", "", "distinct terms of the summary"),
    ("term_content_count", "", "rows of the summary"),
    ("irrelevant_content_count", "", "rows where no match is right and none was added"),
    ("relevant_instance_rate", "%", "rows that aren't irrelevant"),
    ("hit_count", "", "matches that are right"),
    ("miss_count", "", "matches that a manual one replaces"),
    ("miss_rate", "%", "misses of all hits and misses"),
    ("hit_instance_count", "", "rows with a right match"),
    ("avg_hit_per_hit_instance", "", "right matches for each such row"),
    ("manual_count", "", "matches added by hand"),
    ("manual_instance_count", "", "rows with an added match"),
    ("manual_instance_rate", "%", "such rows of the relevant ones"),
]


def figure_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FIGURES)], "place int, metric string, unit string, explanation string")


def long_form(kpi: DataFrame, *, by: str = "task_id") -> DataFrame:
    """(task, metric, value, unit, explanation): a row per figure, in the report's order."""
    names = [f[0] for f in FIGURES]
    slim = kpi.select(by, *(F.col(n).cast("double").alias(n) for n in names))
    return slim.unpivot([by], names, "metric", "value").join(F.broadcast(figure_table(kpi.sparkSession)), "metric").select(by, "place", "metric", "value", "unit", "explanation")


def group_judgement(rows: DataFrame, *, by: list[str], judge: str = "judge") -> DataFrame:
    """TP, TN, FN or FP of a group of judgements, in this order of precedence; mixed for none of them."""
    any_ = lambda v: F.bool_or(F.col(judge) == v)
    all_ = lambda v: F.bool_and(F.col(judge) == v)
    return rows.groupBy(*by).agg(F.when(any_("TP"), "TP").when(all_("TN"), "TN").when(any_("FN"), "FN").when(all_("FP"), "FP").otherwise("mixed").alias("judge_group"))


def confusion(rows: DataFrame, *, by: list[str], judge: str = "judge_group") -> DataFrame:
    """Counts of TP, TN, FN and FP, zero where there are none, and TP of TP and FN."""
    counts = {v.lower(): F.count_if(F.col(judge) == v) for v in ("TP", "TN", "FN", "FP")}
    out = rows.groupBy(*by).agg(*(c.alias(n) for n, c in counts.items()))
    return out.withColumn("hit_rate", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


def without_repeats(rows: DataFrame, *, by: list[str], order: list[str], text: str = "text", element: str = "text_element") -> DataFrame:
    """Rows whose text repeats the one before, and rows without an element, go."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__last", F.lag(text).over(w)).where(F.col(element).isNotNull() & ~F.coalesce(F.col("__last") == F.col(text), F.lit(False))).drop("__last")
