"""Byte-level BPE by tree reduction: token lists of neighbouring texts form a monoid.

Halves of a text are encoded on their own, down to leaves, and joined upwards.  A join encodes a window around the
seam anew and keeps all tokens outside it.  The window grows until its edges are proven:

* a *hard* edge is a place where a match of the splitting pattern starts whatever stands further off: white space
  after something else, or a change between letters, digits and other characters that isn't an apostrophe before a
  letter.  Tokens beyond a hard edge don't depend on the window at all;
* inside a long run of one class there is no hard edge.  There a window of tokens is merged anew as one piece, and
  it has grown enough when each of its end tokens and the kept token next to it encode to themselves as a pair: a
  list of BPE tokens is the encoding of its bytes exactly if each neighbouring pair is.

Decoding concatenates bytes up the same kind of tree.  Defined cases: a null text is the empty one and has no
tokens; special tokens are ordinary text; repeated rows are each encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import small_batches, text_slices


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BpeTree:
    """Encodes and decodes by halves.  ``leaf`` and ``window`` are code points; results don't depend on them."""

    def __init__(self, path: str, pattern: str, leaf: int = 256, window: int = 16):
        import regex
        import tiktoken

        ranks = ranks_of(path)
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {i: b for b, i in ranks.items()}
        self.bytes_of = {i: len(b) for b, i in ranks.items()}
        self.leaf, self.window = max(leaf, 1), max(window, 4)
        # where a piece starts whatever stands further off
        edge = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"
        self.hard, self.hard_from_end = regex.compile(edge), regex.compile("(?r)" + edge)
        self.known: dict[bytes, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encoder.encode_ordinary(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of bytes that lie in one piece."""
        return self.encoder._encode_single_piece(raw)

    def fits(self, a: int, b: int) -> bool:
        return self.piece(self.token[a] + self.token[b]) == [a, b]

    def last_hard(self, text: str, size: int) -> int | None:
        """The first hard edge in the last ``size`` code points of a text; its start counts as one."""
        if size >= len(text):
            return 0
        m = self.hard.search(text, max(1, len(text) - size), len(text) - 1)
        return m.start() if m and m.start() < len(text) else None

    def first_hard(self, text: str, size: int) -> int | None:
        """The last hard edge in the first ``size`` code points; the text's end counts as one."""
        if size >= len(text):
            return len(text)
        m = self.hard_from_end.search(text, 0, size + 1)
        return m.start() if m else None

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        if not left or not right:
            return a + b
        lo = hi = None
        size = self.window
        while size < 64 * self.window:
            lo, hi = self.last_hard(left, size), self.first_hard(right, size)
            if lo is not None and hi is not None:
                break
            size *= 2
        if lo is not None and hi is not None:
            return self.cut_end(a, left[lo:]) + self.encoder.encode_ordinary(left[lo:] + right[:hi]) + self.cut_start(b, right[:hi])
        if self.in_run(left[-1]) and self.in_run(left[-1]) == self.in_run(right[0]):
            return self.join_run(left, a, right, b, lo, hi)
        # a very long run of white space, or a run that only one side has: grow until both edges are hard
        while lo is None or hi is None:
            lo, hi = self.last_hard(left, size), self.first_hard(right, size)
            size *= 2
        return self.cut_end(a, left[lo:]) + self.encoder.encode_ordinary(left[lo:] + right[:hi]) + self.cut_start(b, right[:hi])

    @staticmethod
    def in_run(c: str) -> str:
        """The class of a character whose runs are pieces: letters or digits; nothing for others."""
        import unicodedata

        return (unicodedata.category(c)[0]) if unicodedata.category(c)[0] in "LN" else ""

    def join_run(self, left: str, a: list[int], right: str, b: list[int], lo: int | None, hi: int | None) -> list[int]:
        """Join where a piece of letters or digits goes on across the seam, and far beyond the window on a side."""
        kind = self.in_run(left[-1])
        end = next((i for i, c in enumerate(right) if self.in_run(c) != kind), len(right))
        # tokens of the piece on the right; what follows it is hard unless it is the right's end
        run = self.count_start(b, right[:end])
        begin = len(left) - next((i for i, c in enumerate(reversed(left)) if self.in_run(c) != kind), len(left))
        if begin < len(left) and begin > 0 and left[begin - 1] in "' \t\n" or begin == 0:
            begin_tokens = self.count_end(a, left[begin:])
            mine = begin_tokens - (begin_tokens > 8) * 4  # stay clear of a contraction or blank at the piece's start
        else:
            mine = self.count_end(a, left[begin:])
        i, j = min(8, mine), min(8, run)
        while True:
            merged = self.piece(b"".join(self.token[t] for t in a[len(a) - i :] + b[:j]))
            left_ok = i >= mine or self.fits(a[len(a) - i - 1], merged[0])
            right_ok = j >= run or self.fits(merged[-1], b[j])
            if left_ok and right_ok:
                break
            i, j = (min(2 * i, mine) if not left_ok else i), (min(2 * j, run) if not right_ok else j)
        if i >= mine:  # the piece's start is in the window: let the pattern decide there
            grown = self.last_hard(left, len(left) - begin + 64) or 0
            hi = self.first_hard(right, end + 64)
            if hi is None:
                hi = len(right)
            return self.cut_end(a, left[grown:]) + self.encoder.encode_ordinary(left[grown:] + right[:hi]) + self.cut_start(b, right[:hi])
        return a[: len(a) - i] + merged + b[j:]

    def count_start(self, ids: list[int], text: str) -> int:
        """How many tokens at the start of ``ids`` the text's bytes take."""
        left, n = len(text.encode("utf-8", "surrogatepass")), 0
        while left > 0:
            left -= self.bytes_of[ids[n]]
            n += 1
        return n

    def count_end(self, ids: list[int], text: str) -> int:
        """How many tokens at the end of ``ids`` the text's bytes take."""
        left, n = len(text.encode("utf-8", "surrogatepass")), 0
        while left > 0:
            n += 1
            left -= self.bytes_of[ids[-n]]
        return n

    def cut_end(self, ids: list[int], text: str) -> list[int]:
        return ids[: len(ids) - self.count_end(ids, text)]

    def cut_start(self, ids: list[int], text: str) -> list[int]:
        return ids[self.count_start(ids, text) :]

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        if len(ids) <= leaf:
            return b"".join([self.token[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def encode_column(docs: DataFrame, *, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", leaf: int = 256, window: int = 16, digests: bool = False) -> DataFrame:
    """(key, n_tokens, ids, decoded), or with ``digests`` (key, n_tokens, ids_sha256, decoded_sha256).

    A narrow pass: each text is encoded, and its ids decoded again, in the task that reads it.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["key", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BpeTree(ranks, pattern, leaf, window)
        for batch in batches:
            for part in text_slices(batch, "text"):
                sizes, first, second = [], [], []
                for t in part.column("text").to_pylist():
                    ids = tree.encode(t or "")
                    packed, back = np.array(ids, "<u4").tobytes(), tree.decode(ids)
                    sizes.append(len(ids))
                    first.append(hashlib.sha256(packed).hexdigest() if digests else packed)
                    second.append(hashlib.sha256(back).hexdigest() if digests else back)
                form = pa.string() if digests else pa.binary()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(first, form), pa.array(second, form)], names)

    form = "string" if digests else "binary"
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, {names[2]} {form}, {names[3]} {form}")
    return out.withColumnRenamed("key", key)
