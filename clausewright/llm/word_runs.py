"""Periodic runs of words, found by Kolpakov and Kucherov's method.

A run is a stretch with smallest period q, at least ``exponent`` * q and ``length`` words long, that no neighbouring word
extends with that period.  A suffix automaton gives the factors of a Lempel-Ziv factorisation (each the longest
stretch that also starts earlier, or a new word).  A run that starts before a factor and ends in it, or that ends with the
factor before it, is found by Main's algorithm around that factor's start; any other run lies inside one factor and is
copied from the factor's earlier occurrence.

Around a factor u after a factor t, a run reaches less than 2|t| + |u| words to the left and |u| to the right: if it covers t,
no more than a period of it lies before t, as t would be longer otherwise.  All of it takes time linear in the words and runs.

Texts are first cut where no wanted run can pass: three neighbouring words of a run of four periods occur three times at
least (:func:`stretches`).  What the cuts leave goes through the method as it is, so the runs are those of the whole text.

Defined cases: a null text has no words; repeated rows, null keys and ties each give a row of their own; other columns are left
behind; an empty table gives an empty result.  A text is one row and must fit a task; the automaton holds the longest stretch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausewright.llm.shared import small_batches, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Automaton:
    """The suffix automaton of a sequence: for each state its transitions and where its strings first end."""

    def __init__(self, items: list[int]) -> None:
        moves: list[dict[int, int]] = [{}]
        link, size, ends = [-1], [0], [0]
        last = 0
        for at, x in enumerate(items, 1):
            new = len(moves)
            moves.append({})
            size.append(at)
            ends.append(at)
            link.append(0)
            p = last
            while p >= 0 and x not in moves[p]:
                moves[p][x] = new
                p = link[p]
            if p >= 0:
                q = moves[p][x]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    copy = len(moves)
                    moves.append(moves[q].copy())
                    size.append(size[p] + 1)
                    ends.append(ends[q])
                    link.append(link[q])
                    while p >= 0 and moves[p].get(x) == q:
                        moves[p][x] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.moves, self.ends = moves, ends


def factors(items: list[int]) -> list[tuple[int, int]]:
    """(start, shift) of the Lempel-Ziv factors: a factor also starts ``shift`` places earlier; shift 0 is a new item."""
    automaton = Automaton(items)
    moves, ends = automaton.moves, automaton.ends
    out, at, n = [], 0, len(items)
    while at < n:
        state, to = 0, at
        while to < n:
            nxt = moves[state][items[to]]
            if ends[nxt] > to:  # its first occurrence ends here or later, so it doesn't start earlier
                break
            state, to = nxt, to + 1
        if to == at:
            out.append((at, 0))
            at += 1
        else:
            out.append((at, to - ends[state]))
            at = to
    return out


def prefix_lengths(x: list[int]) -> list[int]:
    """For each place, how many items from there on equal the first ones (the first entry is the whole length)."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(items: list[int], low: int, at: int, high: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions in [low, high) that cross or touch ``at``, for periods of at most ``most``."""
    left, right = items[low:at], items[at:high]
    nl, nr = len(left), len(right)
    # to the left of `at` and of places around it, read backwards; to the right of them, read forwards
    back = prefix_lengths([*reversed(left), -1, *reversed(left + right[:most])])
    fore = prefix_lengths([*right, -1, *left[max(nl - most, 0) :], *right])
    ahead, behind = min(most, nr), min(most, nl)
    for p in range(1, max(ahead, behind) + 1):
        if p <= ahead:  # a period to the right of `at`
            reach = fore[p] if p < nr else 0
            before = back[nl + 1 + ahead - p] if nl else 0
            if before + reach >= p:
                yield at - before, at + p + reach, p
        if p <= behind:  # a period to the left
            reach = fore[nr + 1 + behind - p] if nr else 0
            before = back[p] if p < nl else 0
            if before + reach >= p:
                yield at - p - before, at + reach, p


def runs(items: list[int], exponent: int = 2, length: int = 2) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of at least ``exponent`` periods and ``length`` items, by start and period."""
    n = len(items)
    if n < length:
        return []
    parts = factors(items)
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[int]] = {}

    def keep(a: int, b: int, p: int) -> None:
        if (a, b) not in found:
            starting.setdefault(a, []).append(b)
            found[a, b] = p
        elif p < found[a, b]:
            found[a, b] = p

    before = 0  # length of the factor before
    for (s, shift), (e, _) in zip([*parts, (n, 0)], [*parts[1:], (n, 0), (n, 0)], strict=True):
        u = e - s
        low = max(0, s - 2 * before - u)
        most = (e - low) // exponent
        if most and e - low >= length and s:
            for a, b, p in crossing(items, low, s, e, most):
                if b - a >= max(exponent * p, length) and (a == 0 or items[a - 1] != items[a - 1 + p]) and (b == n or items[b] != items[b - p]):
                    keep(a, b, p)
        if shift and u > length:
            for a in range(s + 1, e - length):
                for b in starting.get(a - shift, ()):
                    if b + shift < e:
                        keep(a, b + shift, found[a - shift, b])
        before = u
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, exponent: int, length: int) -> list[tuple[int, int]]:
    """[start, end) of the parts that can hold runs: all that neighbours (three, or two) of which recur as often as in a run.

    A run of at least E periods has each pair of neighbours E - 1 times, and each three if its period is over 1 or it has E + 1
    items.  Each wanted run lies in one part, and is a run there with the same bounds: an item that extends it would
    belong to a longer wanted run, which lies in the same part.
    """
    n, width = len(codes), 3 if length > exponent else 2
    if n < max(length, width):
        return []
    if exponent < 3:
        return [(0, n)]
    distinct, many = int(codes.max()) + 1, n - width + 1
    key = codes[:many] * distinct + codes[1 : many + 1]
    if width == 3:
        if distinct > 1 << 20:  # the product of three would not fit
            _, key = np.unique(key, return_inverse=True)
        key = key * distinct + codes[2 : many + 2]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.diff(np.concatenate([[0], (count[which] >= exponent - 1).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + width - 1
    return [(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if b - a >= length]


def runs_of_words(words: list[str], exponent: int = 4, length: int = 6) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the runs of a list of words."""
    code: dict[str, int] = {}
    items = [code.setdefault(w, len(code)) for w in words]
    out = []
    for a, b in stretches(np.array(items, np.int64), exponent, length):
        out += [(a + s, a + e, p) for s, e, p in runs(items[a:b], exponent, length)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_places(n: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """[start, end) of the words that no run holds after its first period."""
    out, at = [], 0
    for a, b in sorted((s + p, e) for s, e, p in found):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < n:
        out.append((at, n))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", *, exponent: int = 4, length: int = 6, change: Callable[[object, list[str]], list[str]] | None = None, digest: bool = False) -> DataFrame:
    """A row per document: key, n_words, runs (start, length, period), collapsed (the text without repeated periods).

    ``change`` gives other words in place of a document's own, from its key and words.  With ``digest``, runs and collapsed
    give way to the figures of the longest run and hashes.  One pass without a shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    tail = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def one(k, t: str | None) -> tuple:
        words = WORD.findall(t or "")
        if change:
            words = change(k, words)
        found = runs_of_words(words, exponent, length)
        collapsed = " ".join(w for a, b in kept_places(len(words), found) for w in words[a:b])
        if not digest:
            return len(words), [{"start": a, "length": b - a, "period": p} for a, b, p in found], collapsed
        a, b, p = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
        longest = (None,) * 4 if a is None else (a, b - a, p, 1000 * (b - a) // p)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        return len(words), len(found), *longest, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                keys = part.column("key")
                made = list(zip(*map(one, keys.to_pylist(), part.column("text").to_pylist()), strict=True))
                types = [pa.int64()] * 6 + [pa.string()] * 2 if digest else [pa.int64(), SPANS, pa.string()]
                names = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] if digest else ["n_words", "runs", "collapsed"]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, y) for x, y in zip(made, types, strict=True))], ["key", *names])

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(read, f"key {kind}, n_words long, {tail}").withColumnRenamed("key", key)
