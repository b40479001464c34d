"""Line-first cleaning: rules judge lines, then what a text has left judges the text.

Every line with a word is held against rules, each of which looks at that line (and the ones before it):

* ``symbols``: more than ``most_symbols`` marks of ``#*$%&|<>`` or ``!`` for each word;
* ``shouting``: at least five words, and upper-case letters more than ``most_upper`` of its letters;
* ``navigation``: at least two words and a separator ``|`` for each ``per_separator`` words;
* ``unfinished``: at least ``fewest_unfinished`` words, and no sentence mark at its end or at that of any of its words;
* ``boilerplate``: a known phrase of licences, cookies and notices;
* ``repeated``: an earlier line of the text is equal;
* ``stuttering``: at least ten words, most of which equal the word before.

Failing lines go.  A text is kept unless it fails the base rules (too few words, or too many of its words in
repeated three-word runs) or its lines lost more than ``most_lost`` of their characters.

Words are runs without blank, tab, line feed, vertical tab, form feed or carriage return.  Defined cases: a null or
empty text has no words, fails and is not kept; rows that repeat are each judged; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import mix64, small_batches, text_slices
from clausewright.llm.words import BASE_INVERSE, IS_BLANK, powers, prefix_hash, text_bytes, words

SYMBOLS = b"#*$%&|<>"
# Phrases that mark a line as boilerplate.
BOILERPLATE = re.compile(rb"(?i)licensed under|all rights reserved|terms of (?:use|service)|privacy policy|accept (?:all )?cookies|copyright \(c\)|lorem ipsum|javascript (?:is|must be) (?:enabled|disabled)")

# Marks that end a sentence, or close what a sentence may end with.
SENTENCE_ENDS = ".!?:;…。！？\"')]}”’»」』"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL, IS_NOISE, IS_START = _table(SYMBOLS), _table(SYMBOLS + b"!"), np.ones(256, bool)
IS_START[0x80:0xC0] = False  # bytes that go on a code point
IS_UPPER, IS_LOWER = _table(bytes(range(0x41, 0x5B))), _table(bytes(range(0x61, 0x7B)))


def _ends_sentence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words have a sentence mark as their last code point."""
    out = np.zeros(len(ends), bool)
    for mark in SENTENCE_ENDS:
        raw = mark.encode()
        at = ends - len(raw)
        same = at >= starts
        for i, b in enumerate(raw):
            same &= data[np.maximum(at + i, 0)] == b
        out |= same
    return out


def _sums(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags lie in each of the ranges between ``cuts``."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _seen_before(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which items equal an earlier one of their text."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    out = np.zeros(len(h), bool)
    out[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return out


def repeated_window_words(h: np.ndarray, doc: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a run of ``width`` words that their text has at least twice."""
    out = np.zeros(len(h), bool)
    n = len(h) - width + 1
    if n < 1:
        return out
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    acc, at = acc[whole], doc[whole]
    order = np.lexsort((acc, at))
    same = (acc[order][1:] == acc[order][:-1]) & (at[order][1:] == at[order][:-1])
    twice = np.zeros(len(whole), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for k in range(width):
        out[whole[twice] + k] = True
    return out


def judge(part: pa.RecordBatch, *, most_symbols: float, most_upper: float, per_separator: float, fewest_unfinished: int, most_lost: float) -> dict[str, np.ndarray]:
    """Counts and verdicts of the texts of a batch, and ``line`` arrays (first byte, end, fails) of their lines."""
    data, offsets = text_bytes(part.column("text"))
    n_docs = part.num_rows
    starts, ends, h, doc = words(data, offsets)
    inside = ~IS_BLANK[data]
    code_points = IS_START[data] & inside
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = data == 10
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    line_doc = np.searchsorted(offsets, cuts[:-1], "right") - 1
    n_words = np.diff(np.searchsorted(starts, cuts))
    full = n_words > 0
    # a line's bytes without its line feed decide whether it was there before
    last = cuts[1:] - (data[np.maximum(cuts[1:] - 1, 0)] == 10) if len(data) else cuts[1:]
    p = prefix_hash(data)
    line_hash = mix64((p[last] - p[cuts[:-1]]) * powers(BASE_INVERSE, len(data) + 1)[cuts[:-1]] + (last - cuts[:-1]).astype(np.uint64))
    repeated = np.zeros(len(full), bool)
    repeated[full] = _seen_before(line_doc[full], line_hash[full])
    size = _sums(code_points, cuts)
    upper = _sums(IS_UPPER[data], cuts) + _sums((data[1:] < 0x9F) & (data[1:] >= 0x80) & (data[:-1] == 0xC3), np.minimum(cuts, max(len(data) - 1, 0))) if len(data) else np.zeros(len(full), int)
    lower = _sums(IS_LOWER[data], cuts) + _sums((data[1:] >= 0x9F) & (data[:-1] == 0xC3), np.minimum(cuts, max(len(data) - 1, 0))) if len(data) else np.zeros(len(full), int)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    stutter = np.diff(np.concatenate([[0], np.cumsum(again)])[np.searchsorted(starts, cuts)])
    fails = repeated | (_sums(IS_NOISE[data], cuts) > most_symbols * n_words) | ((n_words >= 5) & (upper > most_upper * (upper + lower)))
    fails |= (n_words >= 2) & (_sums(data == 0x7C, cuts) * per_separator >= n_words) | (n_words >= 10) & (2 * stutter > n_words)
    finished = np.concatenate([[0], np.cumsum(_ends_sentence(data, starts, ends))])[np.searchsorted(starts, cuts)]
    fails |= (n_words >= fewest_unfinished) & (np.diff(finished) == 0)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):  # no match runs from one text into the next
        for m in BOILERPLATE.finditer(raw, a, b):
            fails[np.searchsorted(cuts, m.start(), "right") - 1] = True
    fails &= full
    per = lambda of, where: np.bincount(where, of, n_docs).astype(np.int64)
    counts = np.bincount(doc, minlength=n_docs)
    total = per(size, line_doc)
    lost = per(size * fails, line_doc)
    n_repeat = per(repeated_window_words(h, doc), doc)
    base_failed = (counts < 50) | (100 * n_repeat > 50 * counts)
    symbols = _sums(IS_SYMBOL[data], offsets)
    return {
        "n_words": counts, "word_chars": total, "n_symbols": symbols, "n_dup_lines": per(repeated, line_doc), "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (lost <= most_lost * total), "chars_lost": lost, "line": (data, cuts, line_doc, fails, full),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_lost"]


def clean_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most_symbols: float = 0.3, most_upper: float = 0.7, per_separator: float = 3.0, fewest_unfinished: int = 8, most_lost: float = 0.4, cleaned: bool = True) -> DataFrame:
    """Counts and verdicts of every text, and with ``cleaned`` the text without its failing lines.

    A narrow pass over the whole of each text; arrays hold about a megabyte of text at a time.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["key", *COUNTS, *["cleaned"] * cleaned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                found = judge(part, most_symbols=most_symbols, most_upper=most_upper, per_separator=per_separator, fewest_unfinished=fewest_unfinished, most_lost=most_lost)
                cols = [part.column(0), *(pa.array(found[c]) for c in COUNTS)]
                if cleaned:
                    data, cuts, line_doc, fails, _ = found["line"]
                    raw, parts = data.tobytes(), [[] for _ in range(part.num_rows)]
                    for i in np.flatnonzero(~fails):
                        parts[line_doc[i]].append(raw[cuts[i] : cuts[i + 1]])
                    cols.append(pa.array([b"".join(x).decode("utf-8", "replace") for x in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_lost long" + ", cleaned string" * cleaned
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
