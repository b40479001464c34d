"""Checks of rows and requests: what fails is data, never an exception."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A field's rule: may it be null, how long may it be, how many items may it have."""

    field: str
    nullable: bool = True
    most_length: int | None = None
    most_items: int | None = None

    def broken(self) -> Column:
        c = F.col(self.field)
        out = F.lit(False) if self.nullable else c.isNull()
        if self.most_length is not None:
            out = out | F.coalesce(F.length(c.cast("string")) > self.most_length, F.lit(False))
        if self.most_items is not None:
            out = out | F.coalesce(F.size(c) > self.most_items, F.lit(False))
        return out


# Limits of stored rows.
TS_RULES = [Rule("index", False), Rule("text_block_id", False), Rule("phrase_id", False), Rule("page_id", False, 16), Rule("text_element", True, 512), Rule("list_id", True, 512)]
FA_RULES = [*TS_RULES, *(Rule(f, True, 512) for f in ("section_id", "sub_section_id", "schedule_id", "part_id")), Rule("bbox", True, None, 4)]
MATCH_RULES = [*TS_RULES, *(Rule(f, True, None, 5) for f in ("match_term_list", "identifier_list", "similarity_list", "match_type_list"))]


def _checks(df: DataFrame, rules: list[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(r.field).alias("field"), r.broken().alias("bad")) for r in rules if r.field in df.columns))


def violations(df: DataFrame, rules: list[Rule], *, by: list[str], pos: str = "index", examples: int = 20) -> DataFrame:
    """(by, field, broken, examples): how many rows break each field's rule, and the least few positions.

    Fields become rows before the aggregation, so all rules are one pass and one shuffle of counts.
    """
    each = df.select(*by, F.col(pos).alias("__at"), F.explode(_checks(df, rules)).alias("c"))
    return each.groupBy(*by, F.col("c.field").alias("field")).agg(F.count_if("c.bad").alias("broken"), F.slice(F.array_sort(F.collect_set(F.when(F.col("c.bad"), F.col("__at")))), 1, examples).alias("examples"))


def broken_positions(df: DataFrame, rules: list[Rule], *, by: list[str], pos: str = "index") -> DataFrame:
    """(by, field, pos): a row for each field's rule that a row breaks; all of them, and nothing is gathered."""
    bad = F.filter(_checks(df, rules), lambda c: c["bad"])
    return df.select(*by, F.explode(F.transform(bad, lambda c: c["field"])).alias("field"), F.col(pos).alias("pos"))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of the fields that break one."""
    names = F.filter(F.array(*(F.when(r.broken(), F.lit(r.field)) for r in rules if r.field in df.columns)), lambda x: x.isNotNull())
    checked = df.withColumn("broken_fields", names)
    return checked.where(F.size("broken_fields") == 0).drop("broken_fields"), checked.where(F.size("broken_fields") > 0)


SUFFIXES = ("pdf", "doc", "docx", "json")


def request_errors(requests: DataFrame, files: DataFrame | None = None, *, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Requests (file_id, file_name, file_path, file_type) with ``error``: the first thing that is wrong, or null."""
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    checks = [*((F.col(c).isNull(), f"{c} is missing") for c in ("file_id", "file_name", "file_path", "file_type"))]
    checks += [(~suffix.isin(*suffixes), "the file's suffix isn't known"), (~F.upper("file_type").isin("FA", "TS"), "file_type is neither FA nor TS"), (F.col("file_id").cast("string").try_cast("bigint").isNull(), "file_id isn't a whole number"), (~F.contains("file_path", "file_name"), "file_path doesn't hold file_name")]
    out = requests
    if files is not None:
        out = out.join(files.select(F.col("path").alias("file_path"), F.lit(True).alias("__there")).distinct(), "file_path", "left")
        checks.append((F.col("__there").isNull(), "the file doesn't exist"))
    out = out.withColumn("error", F.coalesce(*(F.when(bad, F.lit(text)) for bad, text in checks)))
    return out.drop("__there")


def split_requests(requests: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    checked = request_errors(requests, files)
    return checked.where("error is null").drop("error"), checked.where("error is not null")
