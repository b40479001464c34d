"""Clause identifiers: how they are built, classed and taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions import patterns as P
from clausewright.functions.text import bound


def _present(col: Column) -> Column:
    """Null for null and for the texts that stand for it."""
    return F.when(~col.isin(P.SENTINELS), col)


def _short(col: Column) -> Column:
    return F.regexp_replace(col, P.TRAILING_DOT_ZERO, "")


def is_definition_row(section: Column, sub_section: Column, text: Column) -> Column:
    begins = lambda c: F.coalesce(c.rlike(f"(?i)^(?:{P.DEFINITION_SECTION})"), F.lit(False))
    return begins(section) | (begins(sub_section) & section.isNotNull()) | F.coalesce(text.rlike("^" + P.DEFINES), F.lit(False))


def clause_identifier(
    section_id: Column, sub_section_id: Column, schedule_id: Column, part_id: Column, list_id: Column, definition: Column,
    text_element: Column, section: Column, sub_section: Column, text: Column,
) -> Column:
    """The identifier of a row.

    Parties, ``Cl_<section>[.<sub>][-<definition>]`` or ``Sched_<schedule>[.<part>][_<section>]``.  A list id follows: in a
    definition row after the definition, elsewhere before it; with an underscore where a digit would meet a digit,
    and in definition rows also in schedules and after definitions.  Parties have none.
    """
    sec, sub, sched, part, items, term = map(_present, (section_id, sub_section_id, schedule_id, part_id, list_id, definition))
    parties = sched.isNull() & (sec == "0")
    clause = F.concat(F.lit("Cl_"), F.concat_ws(".", _short(sec), F.when(text_element != "section", _short(sub))))
    schedule = F.concat(F.lit("Sched_"), F.concat_ws("_", F.concat_ws(".", _short(sched), _short(part)), _short(sec)))
    head = F.when(parties, F.lit("Parties")).when(sched.isNotNull(), schedule).when(sec.isNotNull(), clause).otherwise(F.lit(""))
    tail = F.when(sched.isNull() & sec.isNotNull(), F.concat(F.lit("-"), term))
    whole = F.concat(head, F.coalesce(tail, F.lit("")))
    meets = lambda c: c.rlike(r"\d$") & items.rlike(r"^\d")
    defining = is_definition_row(section, sub_section, text)
    not_parties = F.coalesce(sec != "0", F.lit(True))

    def listed(whole: Column) -> Column:
        after = F.when(sched.isNotNull() | (not_parties & term.isNotNull()) | meets(whole), F.concat(whole, F.lit("_"), items)).when(not_parties & term.isNull(), F.concat(whole, items)).otherwise(whole)
        stem = F.regexp_extract(whole, r"^([^-]*)", 1)
        rest = F.substring(whole, F.length(stem) + 1, F.length(whole))
        before = F.when((stem == "Parties") & (rest != ""), whole).otherwise(F.concat(stem, F.when(meets(stem), F.lit("_")).otherwise(F.lit("")), items, rest))
        return F.when(items.isNull(), whole).when(defining, after).otherwise(before)

    return bound(whole, listed)


def identifier_type(identifier: Column, compat: bool = True) -> Column:
    """definitionClause, partiesClause, clause or schedule; null for none of them.

    With compat the decoration after an identifier counts, so one with a dash in it makes a definition of a clause.
    """
    bare = identifier if compat else bare_identifier(identifier)
    return F.when(bare.rlike("^Cl_.*-.*"), "definitionClause").when(bare.rlike("^Parties"), "partiesClause").when(bare.rlike("^Cl_"), "clause").when(bare.rlike("^Sched_"), "schedule")


def bare_identifier(identifier: Column) -> Column:
    return F.regexp_replace(identifier, "【.*】$", "")


def decorate(identifier: Column, heading: Column) -> Column:
    """The identifier with its heading in lenticular brackets, where it has one."""
    return F.when(F.coalesce(heading, F.lit("")) == "", identifier).otherwise(F.concat(identifier, F.lit("【"), heading, F.lit("】")))


def decoration(identifier: Column) -> tuple[Column, Column]:
    """(section, sub-section) of a decorated identifier."""
    inside = F.regexp_extract(identifier, "【(.*)】", 1)
    parts = F.split(inside, " - ")
    return F.when(inside != "", F.get(parts, F.lit(0))), F.when(inside != "", F.get(parts, F.lit(1)))


def merge_key(identifier: Column) -> Column:
    """Identifiers are compared with their special characters all alike."""
    return F.regexp_replace(identifier, r'[()_\[\].%"]', "TEST")


def heading_of(schedule: Column, section: Column, sub_section: Column) -> Column:
    """A row's heading: its schedule, or section and sub-section."""
    both = F.concat(section, F.lit(" - "), sub_section)
    return F.coalesce(schedule, both, section)
