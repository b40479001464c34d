"""Operators over ordered rows: runs, fills, counters, nearest ancestors.

Order is a column, and every window is partitioned by a document's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def run_index(df: DataFrame, column: str, out: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Number of the run of equal neighbouring values a row is in, from 0; two nulls differ, as in a comparison of floats."""
    w = ordered(by, order)
    new = F.when(F.col(column) == F.lag(column).over(w), 0).otherwise(1)
    flagged = df.withColumn("__new", new)
    return flagged.withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def forward_fill(df: DataFrame, columns: list[str], *, by: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The last value that isn't null, up to and with this row; rows outside ``where`` neither give nor take."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    gate = F.lit(True) if where is None else where
    return df.withColumns({c: F.when(gate, F.last(F.when(gate, F.col(c)), ignorenulls=True).over(w)).otherwise(F.col(c)) for c in columns})


def forward_fills(df: DataFrame, gates: dict[str, Column], *, by: list[str], order: list[str]) -> DataFrame:
    """:func:`forward_fill` of several columns in one pass, each within its own rows."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.when(gate, F.last(F.when(gate, F.col(c)), ignorenulls=True).over(w)).otherwise(F.col(c)) for c, gate in gates.items()})


def count_in_run(df: DataFrame, out: str, *, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn(out, F.row_number().over(ordered(by, order)) - 1)


def keep_first(df: DataFrame, subset: list[str], order: list[Column], within: list[str] | None = None) -> DataFrame:
    """One row per ``subset``: the first in order (a dedupe that says which row stays).

    ``within`` names those of its columns by which rows lie together anyway, as they do for other steps: no shuffle by all of them then.
    """
    if within:
        key = F.struct(*(c for c in subset if c not in within))
        w = Window.partitionBy(*within).orderBy(*(c for c in subset if c not in within), *order)
        return df.withColumns({"__n": F.row_number().over(w), "__same": F.lag(key).over(w).eqNullSafe(key)}).where("__n = 1 or not __same").drop("__n", "__same")
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def parent_caption(df: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """The text of a caption right before, within a section, for all rows of the run that it heads."""
    w = ordered(by, order)
    own = F.when(F.lag("text_element").over(w).contains("caption") & (F.col("section") == F.lag("section").over(w)), F.lag("text").over(w))
    run = Window.partitionBy(*by, "index", "text_block_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("__c", own).withColumn("parent_caption", F.first("__c", ignorenulls=True).over(run)).drop("__c")


def nearest_ancestors(df: DataFrame, *, by: list[str], pos: str = "pos", list_id: str = "list_id", text: str = "text") -> DataFrame:
    """``parent_list_ids`` and ``parent_list``: for each proper prefix of a list id the row of the block nearest by place.

    Ids are paths such as ``(a)(i)``.  Each prefix becomes a row among those of its block with just that id, and sees the
    last one before it and the next one after it in one sorted pass, so ids that repeat cost no pairs.  The nearer of the
    two counts (the first if both are as far).  Missing prefixes are skipped; texts are root-first, with ``: `` between.
    """
    parts = F.regexp_extract_all(F.col(list_id), F.lit(r"(\(*\w+\)*\.*)"), F.lit(1))
    depth = F.sequence(F.lit(1), F.size(parts) - 1)
    placed = F.lit(True)
    for c in [*by, pos]:
        placed = placed & F.col(c).isNotNull()
    own = F.array(F.struct(F.lit(0).alias("depth"), F.col(list_id).alias("prefix")))
    asked = F.transform(depth, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "").alias("prefix")))
    # a row stands once for itself, with all its columns, and once for each prefix; it is computed once, and nothing is joined
    rest = [c for c in df.columns if c not in (*by, pos)]
    each = df.select(*by, pos, F.struct(*rest).alias("__r"), F.explode(F.when(placed & (F.size(parts) > 1), F.concat(own, asked)).otherwise(own)).alias("__x"))
    itself = F.col("__x.depth") == 0
    each = each.select(*by, pos, F.col("__x.depth").alias("__depth"), F.col("__x.prefix").alias("__prefix"), F.when(itself, F.col("__r")).alias("__r"), F.when(itself & F.col("__x.prefix").isNotNull(), F.struct(F.col(pos).cast("bigint").alias("at"), F.col(f"__r.{text}").alias("found"))).alias("__row"))
    w = Window.partitionBy(*by, "__prefix").orderBy(pos)
    before = F.last("__row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = each.withColumns({"__before": before, "__after": F.expr("lead(__row) ignore nulls").over(w)})
    at = F.col(pos).cast("bigint")
    nearer = F.when(F.col("__after").isNull() | (at - F.col("__before.at") <= F.col("__after.at") - at), F.col("__before")).otherwise(F.col("__after"))
    hit = F.when((F.col("__depth") > 0) & nearer.isNotNull(), F.struct(F.col("__depth").alias("depth"), F.col("__prefix").alias("prefix"), nearer["found"].alias("found")))
    here = F.collect_list(hit).over(Window.partitionBy(*by, pos))
    out = seen.withColumn("__p", here).where(F.col("__r").isNotNull())
    out = out.select(*by, pos, *(F.col(f"__r.{c}").alias(c) for c in rest), F.when(F.size("__p") > 0, F.array_sort("__p")).alias("__p"))
    line = F.regexp_replace(F.array_join(F.transform("__p", lambda p: p["found"]), ": "), "::", ":")
    return out.select(*df.columns, F.transform("__p", lambda p: p["prefix"]).alias("parent_list_ids"), F.when(F.col("__p").isNotNull(), line).alias("parent_list"))


def explode_texts(df: DataFrame, texts: str, text: str = "text", *, pos: str = "pos", sub: str = "sub_pos") -> DataFrame:
    """A row per item of an array; a null array gives a row with a null text.  ``sub`` keeps the order of items."""
    return df.select("*", F.posexplode_outer(texts).alias(sub, "__t")).withColumn(text, F.col("__t")).drop("__t", texts)


def zone(df: DataFrame, pattern: str, out: str, *, by: list[str], pos: str, text: str = "text") -> DataFrame:
    """The first place, within a document, of a text that matches (case ignored)."""
    return df.withColumn(out, F.min(F.when(F.col(text).rlike(f"(?i){pattern}"), F.col(pos))).over(Window.partitionBy(*by)))
