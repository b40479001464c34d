"""Feedback figures kept up to date from a stream: an extension, as the reviewers' figures are otherwise a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewright.operators import feedback as A

ADDITIVE = ["hit_count", "miss_count", "manual_count", "term_content_count"]


def windowed_counts(events: DataFrame, *, time: str = "update_time", late: str = "1 hour", every: str = "1 day", by: str = "task_id", compat: bool = True) -> DataFrame:
    """Hits and misses per task and window; records later than ``late`` are dropped, windows are sent once they are final."""
    r = A.judged(events.withWatermark(time, late), compat)
    sums = {"hit_count": F.sum("selected"), "miss_count": F.sum(F.least("unselected", F.size("manual"))), "manual_count": F.sum(F.size("manual")), "term_content_count": F.count(F.lit(1))}
    out = r.groupBy(F.window(time, every), by).agg(*(c.alias(n) for n, c in sums.items()))
    return out.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *ADDITIVE)


def keep_figures(events: DataFrame, table: str, checkpoint: str, *, by: str = "task_id", compat: bool = True) -> StreamingQuery:
    """Each batch's counts are written under its number, so that a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        kpi = A.kpis(batch, by=by, compat=compat).select(by, *ADDITIVE)
        kpi.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def totals(rows: DataFrame, *, by: str = "task_id") -> DataFrame:
    out = rows.groupBy(by).agg(*(F.sum(c).alias(c) for c in ADDITIVE))
    whole = F.nullif(F.col("hit_count") + F.col("miss_count"), F.lit(0))
    return out.withColumn("avg_accuracy", F.round(F.col("hit_count") / whole * 100, 2))
