"""Splitting paragraphs into sentences, phrases, bullets and numbered items.

Sentences and phrases follow rules of this module (there is no language model behind them).  Numbered lists carry a
state along a text, so they are read in an Arrow function; results are arrays to be exploded, with their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions import patterns as P
from clausewright.functions.text import number_word, spaced_pattern
from clausewright.operators.sentences import Boundaries, split_sentences

SENTENCE_END = re.compile(r'(?<=[.!?])(?<!\A\d\.)(?<!\A\d\d\.)(?<!\bNo\.)(?<!\bno\.)(?<![A-Z]\.)(?<!\betc\.)(?<!\bi\.e\.)(?<!\be\.g\.)\s+(?=["“A-Z(\[])')
ITEMS = T.ArrayType(T.StructType([T.StructField("list_id", T.StringType()), T.StructField("text", T.StringType())]))


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in SENTENCE_END.split(text)) if s]


PARAGRAPH = P.PARA_SPLIT
PURE = re.compile(rf"^[{re.escape(P.PUNCTUATION)}]+$|^\d+$")


def phrases(text: str | None, pattern: str = PARAGRAPH, when_long: bool = False, compat: bool = True, known: Boundaries | None = None) -> list[str]:
    """Phrases of a text: sentences split after delimiters.

    ``when_long`` splits at commas from the first sentence on that has five comma parts or says ``but not limited
    to``; with compat the comma pattern then stays for the sentences after it.  At commas, a piece of more than four
    words joins one of more than four words before it.  If all phrases end with a colon they are one.  ``No.``
    doesn't end a sentence; with compat every ``number`` becomes ``No.``, as its stand-in can't be told from the word.
    With ``known``, what was learned of a corpus, sentences end where that says; without, where a fixed pattern does.
    """
    if not text:
        return []
    comma = P.COMMA_DELIMITERS
    out: list[str] = []
    now = pattern
    given = re.sub(r"No\.|no\.", "number", text) if compat else text
    for s in sentences(given) if known is None else split_sentences(given, known):
        if when_long and (len(s.split(",")) >= 5 or "but not limited to" in s):
            now = comma
        elif not compat:
            now = pattern
        pieces = [x for x in re.split(now, s) if x and x.strip()]
        for i, piece in enumerate(pieces):
            long_pair = i and now == comma and len(out[-1].split()) > 4 and len(piece.split()) > 4
            if (re.match(now, piece) and out) or long_pair:
                out[-1] = out[-1] + piece + " "
            else:
                out.append(piece)
    out = [re.sub(" +", " ", x).strip() for x in out]
    if compat:
        out = [x.replace("number", "No.") for x in out]
    if len(out) > 1 and all(x.endswith(":") for x in out):
        return [" ".join(out)]
    return [x for x in out if len(out) == 1 or not PURE.match(x)]


def phrase_column(text: Column, *, pattern: str = PARAGRAPH, when_long: Column | None = None, compat: bool = True, known: Boundaries | None = None) -> Column:
    """phrases() over a column; ``when_long`` may differ by row."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else phrases(x, pattern, bool(y), compat, known) for x, y in zip(s, w, strict=True)])

    return run(text, F.lit(False) if when_long is None else F.coalesce(when_long, F.lit(False)))


def split_paragraph(text: Column, keep: bool = True) -> Column:
    """The delimiter split alone, without a Python worker: pieces keep their delimiter, or lose it."""
    marked = F.regexp_replace(text, PARAGRAPH, ("$1" if keep else "") + "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def split_bullets(text: Column) -> Column:
    """Bulleted items, each with one bullet before it; a text without bullets stays whole."""
    symbols = "|".join(rf"(?<!\[)(?<!\(){re.escape(s)}(?!\))(?!\])" for s in P.SYMBOLS if s != "_")
    parts = F.filter(F.split(text, symbols), lambda x: ~x.isin("", " "))
    return F.when(F.size(parts) > 1, F.transform(parts, lambda x: F.concat(F.lit("• "), F.trim(x)))).otherwise(F.array(text))


def split_commas(text: Column, section: Column) -> Column:
    """Texts of the sections that list things part at commas."""
    return F.when(section.isin(P.SPLIT_AT_COMMA), F.split(text, ",")).otherwise(F.array(text))


@lru_cache(maxsize=4)
def separators(bank: tuple[str, ...] = ()) -> re.Pattern:
    dot = r"(?<!\d)(?<![a-zA-Z]\.)(?<!etc)\.(?!\d)(?![a-zA-Z]\.)"
    named = [re.escape(n) + " :" for n in sorted(bank, key=len, reverse=True)]
    return re.compile("(" + "|".join([r'(?<!")(?<!s)\)(?!\s/)', r'(?<!")\](?!\s/)', "XXX", dot, *named, ":"]) + ")")


def split_at_separators(text: str, bank: tuple[str, ...] = ()) -> list[str]:
    """A heading's parts: it is cut after brackets, full stops and colons; a separator stays with the part before it."""
    out: list[str] = []
    for piece in separators(bank).split(text):
        if not piece or not piece.strip():
            continue
        if separators().match(piece.strip()) and out:
            out[-1] += piece + " "
        elif not separators().match(piece):
            out.append(piece)
    return [x.strip() for x in out]


def separator_column(text: Column, bank: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else split_at_separators(x, bank))

    return run(text)


@lru_cache(maxsize=4096)
def number_kind(number: str) -> str | None:
    """Which of the numbering classes a bare number belongs to, in their order."""
    for name, pattern in P.NUMBERING:
        if number and re.fullmatch(pattern, number):
            return name
    return None


@lru_cache(maxsize=1)
def _number_rx() -> re.Pattern:
    """Numbers as they may open an item: ``(a)``, ``a)`` or ``1.``"""
    any_ = "|".join(p for _, p in P.NUMBERING)
    no_capital = "|".join(p for n, p in P.NUMBERING if n not in ("A", "XYZ"))
    bracketed, right = (rf"(?<![^\s\[]){mark}(?:{any_})\)(?!\()(?!:)" for mark in (r"\(", r"(?<!\()"))
    near = r"(?=\(?[\w.]{1,8}[).])"  # no number is longer; this rules most places out before the classes are tried
    return re.compile(rf"{near}(?:{bracketed}|{right}|(?<![a-zA-Z]\.)(?:{no_capital})\.(?!\d)(?![a-zA-Z]\.))")


class _Ends:
    """Whether a text ends with one of some patterns; those that are plain strings are compared as such."""

    def __init__(self, patterns: list[str]):
        plain = [p for p in patterns if not re.search(r"\\[a-zA-Z]|[\[{|]", p.replace(r"\[", ""))]
        self.plain = tuple(re.sub(r"\\(.)", r"\1", p) for p in plain)
        rest = [p for p in patterns if p not in plain]
        self.rest = re.compile(rf"(?:{'|'.join(rest)})$")

    def __call__(self, text: str) -> bool:
        return text.endswith(self.plain) or bool(self.rest.search(text[-24:]))


@lru_cache(maxsize=1)
def _neighbours() -> dict:
    """What shows a number to be a reference: right beside it (near), and in the texts before and after it."""
    words = [w for n in range(100) for w in (number_word(n), number_word(n).capitalize())]
    counted = [*words, *(rf"\[{w}\]" for w in words), r"\((?:[a-z]{1,5}|[A-Z]{1,5})\)(?: and|,| to| or)"]
    marks = [re.escape(c) for c in P.PUNCTUATION if c not in P.MAY_FOLLOW]
    alone = [rf"{m}$" for m in marks]
    listed = [r"\b\w\w?\), ", r"\b\w\w?\)"]
    return {
        "near_before": _Ends([*listed, *P.BEFORE_BRACKETS, *P.BEFORE_A_REFERENCE]), "near_after": re.compile("|".join(P.AFTER_BRACKETS + marks + P.PREPOSITIONS)),
        "before": {False: _Ends(P.BEFORE_BRACKETS + P.BEFORE_A_REFERENCE + counted), True: _Ends(P.BEFORE_A_DOT + P.BEFORE_A_REFERENCE + counted)},
        "after": {False: re.compile("|".join(alone + P.PREPOSITIONS + P.AFTER_BRACKETS)), True: re.compile("|".join(alone + P.AFTER_A_DOT))},
    }


def _may_open(text: str, m: re.Match) -> bool:
    """Whether nothing right beside a number speaks against it; full stops are judged by the pieces around them alone."""
    if number_kind(m[0].strip("().")) is None:
        return False
    if m[0].endswith("."):
        return True
    beside, before = _neighbours(), text[max(0, m.start() - 24) : m.start()]
    if not m[0].startswith("(") and before.endswith((") and ", ") or ")):
        return False
    return not beside["near_before"](before) and not beside["near_after"].match(text, m.end())


def numbered_pieces(text: str) -> list[tuple[str | None, str]]:
    """(number, text) pieces.  A number that the text before or after it shows to be a reference stays in its text."""
    beside = _neighbours()
    found = [m for m in _number_rx().finditer(text) if _may_open(text, m)]
    out: list[tuple[str | None, str]] = []
    at, number = 0, None
    for m, following in zip(found, [*found[1:], None], strict=False):
        said, goes_on = text[at : m.start()].strip(), text[m.end() : following.start() if following else len(text)].strip()
        dotted = m[0].endswith(".")
        if beside["before"][dotted](said) or (goes_on and beside["after"][dotted].match(goes_on)):
            continue
        if number is not None or said:
            out.append((number, said))
        at, number = m.end(), m[0]
    out.append((number, text[at:].strip()))
    return out


def roman_value(s: str) -> int | None:
    table = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    values = [table.get(c) for c in s.lower()]
    if not values or None in values:
        return None
    return sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))


@lru_cache(maxsize=65536)
def follows(last: str, now: str) -> bool:
    """Whether a number comes right after another: by value, by letter or as a numeral."""
    last, now = last.strip("()."), now.strip("().")
    if not last:
        return True
    if last.isdigit() and now.isdigit():
        return int(now) == int(last) + 1
    if len(last) == len(now) == 1 and ord(now) == ord(last) + 1:
        return True
    a, b = roman_value(last), roman_value(now)
    return bool(a and b and b == a + 1)


LEVELS = 5
_STARTS_OVER = re.compile(r"\d+\.")


@lru_cache(maxsize=4096)
def _form(number: str) -> str:
    """A number's class in its brackets or with its full stop."""
    return re.sub(r"\w+(?:\.\w+)*", number_kind(number.strip("().")) or "?", number, count=1)


@lru_cache(maxsize=4096)
def _shape(form: str) -> str:
    return re.sub(r"[A-Za-z0-9.]+(?=\)|\.?$)", "", form)


def list_items(text: str | None, carried: str | None = None) -> tuple[list[tuple[str | None, str]], str | None]:
    """Items (list id, text) of a numbered text, and the last id, under which a next text may go on.

    A list id is the path of numbers from the first level, such as ``(a)(i)``.  Levels are found as they appear: a number
    belongs to the level whose class and brackets it has, or that it follows in order; otherwise it opens the next
    level.  ``1.`` always starts over at the first.
    """
    pieces = numbered_pieces(text or "")
    if not any(n for n, _ in pieces):
        return [(None, text or "")], None
    levels: list[tuple[str, str]] = []  # the form of each level's numbers, and its last number
    for number in re.findall(r"\(*\w+\)*\.*", carried or "")[:LEVELS]:
        levels.append((_form(number), number))
    out: list[tuple[str | None, str]] = []
    for number, body in pieces:
        if number is None:
            out.append((None, body))
            continue
        own = _form(number)
        if _STARTS_OVER.match(number):
            levels = []
        depth = next((i for i in range(len(levels) - 1, -1, -1) if levels[i][0] == own and follows(levels[i][1], number)), None)
        if depth is None:  # a numeral or a letter that goes on under another class
            depth = next((i for i in range(len(levels) - 1, -1, -1) if _shape(levels[i][0]) == _shape(own) and follows(levels[i][1], number)), None)
        if depth is None:
            depth = next((i for i in range(len(levels)) if levels[i][0] == own), min(len(levels), LEVELS - 1))
        levels = [*levels[:depth], (own, number)]
        out.append(("".join(n for _, n in levels), body))
    return out, out[-1][0]


@F.pandas_udf(ITEMS)
def list_item_column(s: pd.Series) -> pd.Series:
    """list_items() of each text on its own."""
    return s.map(lambda x: None if x is None else [{"list_id": i, "text": t} for i, t in list_items(x)[0]])


def list_items_in_blocks(df: DataFrame, *, doc: str = "doc_id", pos: str = "pos", reset: str = "is_definition", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc, pos, items): numbered items where a list goes on from the text before it in its block.

    The last id of a text is carried to the next one of the same block, except under definitions.  Blocks are sorted within
    partitions (so many of them, or the session's number) and read as they stream by, so nothing but an id is held between texts.
    """
    kind = dict(df.dtypes)
    form = pa.list_(pa.struct([("list_id", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carried = None, None
        for batch in batches:
            rows = []
            for key, said, stop in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != now:
                    now, carried = key, None
                items, last = list_items(said, carried)
                carried = None if stop else last
                rows.append([{"list_id": i, "text": t} for i, t in items])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, form)], [doc, "block_id", pos, "items"])

    schema = f"{doc} {kind[doc]}, block_id {kind['block_id']}, {pos} {kind[pos]}, items array<struct<list_id:string,text:string>>"
    return df.select(doc, "block_id", pos, reset, text).repartition(*([] if partitions is None else [partitions]), doc, "block_id").sortWithinPartitions(doc, "block_id", pos).mapInArrow(run, schema)


def phrase_items(blocks: DataFrame, *, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(doc, pos, items): the phrases of a summary's lists and paragraphs, in order, without list ids.

    In blocks whose section is one of those that list things, long sentences part at commas too.
    """
    heads = F.max(F.when(F.col("element") == "section", F.col("text").rlike(spaced_pattern(P.SPLIT_WHEN_LONG))))
    listing = blocks.groupBy(doc, "block_id").agg(F.coalesce(heads, F.lit(False)).alias("__long"))
    some = blocks.where(F.col("element").isin("list", "paragraph")).join(listing, [doc, "block_id"])
    none = F.lit(None).cast("string")
    return some.select(doc, pos, F.transform(phrase_column(F.col("text"), when_long=F.col("__long")), lambda x: F.struct(none.alias("list_id"), x.alias("text"))).alias("items"))


def item_phrases(df: DataFrame, keys: list[str], items: str = "items") -> DataFrame:
    """(keys, list_id, n, phrase): the phrases of each numbered item, in order."""
    each = df.select(*keys, F.posexplode(items).alias("n_item", "i")).select(*keys, "n_item", "i.list_id", F.col("i.text").alias("text"))
    return each.select(*keys, "n_item", "list_id", F.posexplode(phrase_column(F.col("text"))).alias("n", "phrase"))


def flatten_map(col: Column) -> Column:
    """Key paths of a map of maps: ``a_b`` for b inside a."""
    return F.flatten(F.transform(F.map_entries(col), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat_ws("_", e["key"], x["key"]).alias("key"), x["value"].alias("value")))))


def ngrams(words: Column, n: Column | int) -> Column:
    """All runs of ``n`` words, joined by blanks."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
