"""Words of many texts at once: places and hashes, by NumPy over the bytes of an Arrow batch.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

from clausewright.llm.shared import mix64

BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
BASE = 0x9E3779B97F4A7C55  # odd, so that powers can be undone modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins and the last ends; null is empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(data[j]) * BASE**j for j < i; a run's hash is (P[e] - P[s]) * BASE**-s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and text number of every word, in order."""
    blank = IS_BLANK[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[offsets] = True  # a word ends with its text
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = ~blank[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    p = prefix_hash(data)
    h = mix64((p[ends] - p[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, h, np.searchsorted(offsets, starts, "right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all runs of ``width`` words; a shorter text with a word has one run, of all its words."""
    per = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(per) - per
    acc = np.zeros(len(h), np.uint64)
    for k in range(width):
        step = np.uint64(pow(BASE, k + 1, 1 << 64))
        acc[: len(h) - k] += h[k:] * step if k else h * step
    place = np.arange(len(h)) - first[doc] if len(h) else np.zeros(0, np.int64)
    whole = place + width <= per[doc]
    out, at = mix64(acc[whole]), doc[whole]
    short = np.flatnonzero((per > 0) & (per < width))
    if len(short):
        sums = np.array([mix64(np.array([sum(int(x) * pow(BASE, k + 1, 1 << 64) for k, x in enumerate(h[first[d] : first[d] + per[d]])) & (2**64 - 1)], np.uint64))[0] for d in short], np.uint64)
        out, at = np.concatenate([out, sums]), np.concatenate([at, short])
    return out, at


def elements(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted by text and hash; their text numbers; and how often the text has them."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(fresh)
    return h[fresh], doc[fresh], np.diff(np.append(run, len(h)))
