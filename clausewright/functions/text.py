"""Normalising and splitting text as Column expressions; what the JVM can't express is an Arrow function."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions import patterns as P


def _chain(col: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        col = F.regexp_replace(col, pattern, to)
    return col


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; a lambda also keeps what stands in it out of generated code, which has a bound."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# The clean-up's passes, in order.  Three classes hold an em dash as a character of its own (compat);
# strict has the ranges that were meant.
_SPACING = [(r" +", " "), ("", ""), (r" / ", "/"), (r" ([.,;]) ", "$1 "), (r" ([)\]])", "$1"), (r" ([(\[]) ", " $1")]
_SHAPES_COMPAT = [(r"[一-鿿]+", ""), (r"[▀—▟]+", "•"), (r"[■-◿]+", "•"), (r"[—]+", "•"), (r"[§]+", "▪"), (r"[Ø]+", "•"), (r"[]+", "•")]
_SHAPES_STRICT = [(r"[一-鿿]+", ""), (r"[▀-▟]+", "•"), (r"[■-◿]+", "•"), (r"[-]+", "•"), (r"[§]+", "▪"), (r"[Ø]+", "•")]
_QUOTES = [("[“”]", '"'), ("[’‘]", "'")]


def clean_text(col: Column, compat: bool = True) -> Column:
    return F.trim(_chain(col, _SPACING + (_SHAPES_COMPAT if compat else _SHAPES_STRICT) + _QUOTES))


def clean_spacing(col: Column) -> Column:
    """The short clean-up: spacing and quotes."""
    return F.trim(_chain(col, [s for s in _SPACING if s[0] != " / "] + [("[“”]", '"'), ("’", "'")]))


def drop_cjk(col: Column) -> Column:
    return F.when(~col.rlike(P.CJK), col)


def suppress_wide_runs(df: DataFrame, text: str, by: list[str], order: list[str]) -> DataFrame:
    """Blank a span of CJK or full-width characters, and a span without letters between two such spans."""
    from clausewright.functions.geometry import neighbours

    wide = r"^[一-鿿！-～\s]+$"
    near = neighbours(df, [text], by, order)
    between = F.col(f"prev_{text}").rlike(wide) & F.col(f"next_{text}").rlike(wide) & ~F.col(text).rlike(r"[A-Za-z]")
    return near.withColumn(text, F.when(F.col(text).rlike(wide) | F.coalesce(between, F.lit(False)), F.lit("")).otherwise(F.col(text))).drop(f"prev_{text}", f"next_{text}")


@F.pandas_udf(T.StringType())
def unicode_normalise(s: pd.Series) -> pd.Series:
    """NFKD, tabs to one blank, no lone surrogates."""
    def one(x):
        if x is None:
            return None
        return re.sub("\t+", " ", unicodedata.normalize("NFKD", x)).encode("utf-8", "ignore").decode()

    return s.map(one)


def split_camel_case(col: Column) -> Column:
    """A blank before an upper-case letter that follows a lower-case one, or that starts a word in a run of letters."""
    not_after = "".join(f"(?<!{re.escape(c)})" for c in string.punctuation)
    return F.regexp_replace(col, rf"((?<=[a-z])[A-Z]|(?<!\A){not_after}[A-Z](?=[a-z]))", " $1")


def strip_punctuation(col: Column) -> Column:
    """No ASCII punctuation but the dash; null for an empty text."""
    return F.when(col != "", F.trim(F.translate(col, P.PUNCTUATION.replace("-", ""), "")))


def light_punctuation(col: Column) -> Column:
    """Punctuation apart from ``( ) : , . \\ $`` goes, repeats of what is left fold to one."""
    gone = "".join(c for c in P.PUNCTUATION if c not in P.KEPT_PUNCTUATION)
    return F.regexp_replace(F.translate(col, gone, ""), r"([():,.\\$])\1+", "$1")


def spaced_variants(col: Column) -> Column:
    """The text with a blank put in at each of its places."""
    cut = lambda i: F.trim(F.concat(F.substring(col, F.lit(1), i), F.lit(" "), F.substring(col, i + 1, F.length(col))))
    return F.when(F.length(col) > 0, F.transform(F.sequence(F.lit(0), F.length(col) - 1), cut)).otherwise(F.array().cast("array<string>"))


def spaced_pattern(names: list[str]) -> str:
    """One pattern for all spaced variants of all names: a blank may stand between any two characters."""
    return "|".join("^.*" + r"\s?".join(re.escape(c) for c in n) + r"\s*:*" for n in names)


def trim_heading(col: Column) -> Column:
    """No leading numbering and no trailing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"^[^A-Za-z(\[]+", ""), r"[^A-Za-z0-9)\]]+$", ""))


# Ordinal words below the hundredth, from their parts.
_UNITS = ["", "First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Twelfth", "Thirteenth", "Fourteenth", "Fifteenth", "Sixteenth", "Seventeenth", "Eighteenth", "Nineteenth"]
_TENS = ["", "", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety"]


def ordinal_word(n: int) -> str:
    if n < 20:
        return _UNITS[n]
    return f"{_TENS[n // 10]}-{_UNITS[n % 10].lower()}" if n % 10 else _TENS[n // 10][:-1] + "ieth"


def ordinals_to_words(col: Column) -> Column:
    """1st to First, for ordinals below the hundredth, wherever they stand as words."""
    words = F.create_map(*(F.lit(x) for n in range(1, 100) for x in (str(n), ordinal_word(n))))
    parts = F.split(col, " ")
    number = lambda w: F.regexp_extract(w, r"(?i)^(\d{1,2})(?:st|nd|rd|th)$", 1)
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(words, number(w)), w)), " ")


_ROMAN_PAIRS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_to_int(col: Column) -> Column:
    """A numeral's value, or null where a letter isn't one; a smaller letter before a larger one (of the six usual pairs) is taken away."""
    value = F.create_map(*(F.lit(x) for kv in _ROMAN_PAIRS.items() for x in kv))
    letters = F.split(F.upper(col), "")
    usual = F.array(*(F.lit(p) for p in ("IV", "IX", "XL", "XC", "CD", "CM")))
    digits = F.transform(letters, lambda c, i: F.when(F.array_contains(usual, F.concat(c, F.coalesce(F.get(letters, i + 1), F.lit("")))), -value[c]).otherwise(value[c]))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return F.when(F.upper(col).rlike("^[IVXLCDM]+$"), total)


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()


def number_word(n: int) -> str:
    if n < 20:
        return _SMALL[n]
    if n < 100:
        return _TENS[n // 10].lower() + (f"-{_SMALL[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_SMALL[n // 100]} hundred" + (f" and {number_word(n % 100)}" if n % 100 else "")
    for size, name in ((10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if n >= size:
            rest = n % size
            return f"{number_word(n // size)} {name}" + ((" and " if rest < 100 else ", ") + number_word(rest) if rest else "")
    return str(n)


@F.pandas_udf(T.StringType())
def digits_to_words(s: pd.Series) -> pd.Series:
    """Whole numbers that stand alone, in words."""
    return s.map(lambda x: None if x is None else re.sub(r"(?<![\w.,])\d{1,12}(?![\w.,]*\d)", lambda m: number_word(int(m[0])), x))


def is_date(col: Column) -> Column:
    """Whether a text is a date in one of the usual notations."""
    forms = ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "d/M/yyyy", "d MMM yyyy", "yyyy/M/d", "d.M.yyyy")
    return F.coalesce(*(F.try_to_timestamp(F.trim(col), F.lit(f)) for f in forms)).isNotNull()


def is_float(col: Column) -> Column:
    return F.expr("true") & col.try_cast("double").isNotNull()


# Words that a heading may leave in lower case.
SMALL_WORDS = "a an and as at but by for from if in into nor of on or per the to via with".split()


def is_heading_case(col: Column) -> Column:
    """Every word but the small ones starts with an upper-case letter; a plain stand-in for part-of-speech tags."""
    small = F.array(*(F.lit(w) for w in SMALL_WORDS))
    words = F.filter(F.split(F.trim(col), r"\s+"), lambda w: w.rlike("[A-Za-z]"))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(small, F.lower(w)) | w.rlike("^[^A-Za-z]*[A-Z]"))


def drop_clause_number(col: Column) -> Column:
    return F.regexp_replace(col, P.LEADING_CLAUSE_NUMBER, "")


def without_sentinels(df: DataFrame) -> DataFrame:
    """The texts nan, None and the empty one become null in every string column."""
    return df.select(*(F.when(~F.col(f"`{c}`").isin(P.SENTINELS), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def clean_heading(col: Column) -> Column:
    """What stands in or after a bracket goes."""
    return F.regexp_replace(F.regexp_replace(col, r"[\[|\(].*[\]|\)]", ""), r"[\[|\(].*", "")


def clean_defined_text(col: Column) -> Column:
    """Blanks inside opening quotes go: `" Term"` to `"Term"`."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r'(?<!\.) " ', '"'), r'\. " ', '. "'), r'^" ', '"')


def table_to_text(col: Column) -> Column:
    return F.to_json(col)


@F.pandas_udf(T.StringType())
def join_separated_letters(s: pd.Series) -> pd.Series:
    """``F ORM OF`` to ``FORM OF``: a lone capital joins the word after it, until none is left or six passes are done.

    A, I and a stay words, except I and A inside a heading after a word that takes no number; a word that ends with
    a dash joins the next one.
    """
    numbered = re.compile(r"(?i)^(part|schedule|tranche|appendix)")
    lone = lambda w: len(w) == 1 and w.isalpha() and w not in "aAI"
    never = {"and", "or", "only", "only)"}

    def once(words: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(words):
            w, nxt = words[i], words[i + 1] if i + 1 < len(words) else None
            after_number_word = bool(i and numbered.match(words[i - 1]))
            glue = (lone(w) and not (after_number_word and nxt is None)) or (w in ("A", "I") and i > 0 and not after_number_word) or (len(w) > 1 and w.endswith("-"))
            if nxt is not None and len(w) == 1 and len(nxt) == 1:
                out.append(w)
            elif glue and nxt is not None and nxt not in never:
                out.append(w + nxt)
                i += 1
            elif glue and nxt is None and out and words[i - 1] not in never and not numbered.match(words[i - 1]):
                out[-1] += w
            else:
                out.append(w)
            i += 1
        return out

    def one(x):
        if not x:
            return x
        words = x.split()
        for _ in range(6):
            if not any(map(lone, words)):
                break
            words = once(words)
        return " ".join(words)

    return s.map(one)
