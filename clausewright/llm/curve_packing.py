"""Packing along a space-filling curve.

A document's token counts are hashed into buckets, damped, scaled to unit length and projected to a few
dimensions.  The cell of the projection on a grid has a place on a Hilbert curve; documents are range-sorted by
that place (the key breaks ties, so equal documents spread over partitions) and packed in that order, so that
neighbours on the curve share sequences.  A partition's last, short sequence is cut at powers of two, which need
no padding.

Defined cases: a null text is the empty one, whose only id is the closing id; a null key sorts first and is kept;
repeated rows are packed each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import materialise, mix64, small_batches, text_slices


class CachedTokenizer:
    """Ids of many texts.  The vocabulary's rules never look across a blank, so each distinct run of other
    characters is encoded once and its ids are gathered; what is remembered is bounded by ``most`` runs."""

    MARK = "\x01"  # stands between runs that are encoded in one call; its id comes from nothing else

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.vocabulary = self.tokenizer.get_vocab_size()
        (self.mark_id,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Encode runs.  A run of Latin letters has the ids of its lower-case form, and one that a comma or full stop
        follows has those and the mark's: the vocabulary folds case and parts letters from other characters."""
        cores, tails = [], []
        for w in fresh:
            core, tail = (w[:-1], w[-1]) if w[-1] in ".," else (w, "")
            lower = core.lower()
            plain = core.isalpha() and lower.isalpha() and max(core) < "\u0250"  # a dotted capital I becomes a letter and a mark
            cores.append(lower if plain else w)
            tails.append(tail if plain else "")
        known = self.known
        self.encode([w for w in dict.fromkeys(cores + tails) if w not in known])
        made = [i for i, w in enumerate(fresh) if w not in known]
        a = np.array([known[cores[i]] for i in made], np.int64)
        b = np.array([known[tails[i]] for i in made], np.int64)
        at = np.column_stack([a, b]).reshape(-1)
        n = self.sizes[at]
        before = np.cumsum(n) - n
        size = len(known)
        known.update(zip([fresh[i] for i in made], range(size, size + len(made)), strict=True))
        self.flat = np.concatenate([self.flat, self.flat[np.repeat(self.starts[at] - before, n) + np.arange(n.sum())]])
        self.sizes = np.concatenate([self.sizes, self.sizes[a] + self.sizes[b]])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, fresh: list[str]) -> None:
        """Encode runs, a few thousand to a call, and keep their ids one after another."""
        plain = [w for w in fresh if self.MARK not in w]
        parts, sizes = [self.flat], [self.sizes]
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark_id)
            parts.append(np.delete(ids, marks))
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
        odd = [w for w in fresh if self.MARK in w]
        for w in odd:
            parts.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int32))
            sizes.append(np.array([len(parts[-1])]))
        n = len(self.known)
        self.known.update(zip(plain + odd, range(n, n + len(fresh)), strict=True))
        self.flat, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, texts: list[str], closing: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another and each closed by ``closing``; and the number of ids of each text."""
        lists = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        place: dict[str, int] = {}
        codes = np.array([place.setdefault(w, len(place)) for x in lists for w in x], np.int64)
        distinct = list(place)
        if len(self.known) > self.most:
            self.forget()
        self.learn([w for w in distinct if w not in self.known])
        known = self.known
        codes = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[codes]
        # the runs of a text, then its closing id, which is one more entry at the end
        flat, starts, sizes = np.append(self.flat, closing), np.append(self.starts, len(self.flat)), np.append(self.sizes, 1)
        codes = np.insert(codes, np.cumsum(counts), len(sizes) - 1)
        n = sizes[codes]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(starts[codes] - before, n) + np.arange(n.sum())]
        ends = np.cumsum(n)[np.cumsum(counts + 1) - 1]
        return ids, np.diff(ends, prepend=0)


class RankedTokenizer:
    """The same ids as a word-end BPE file's, by a faster merge loop, for texts of plain Latin-1 characters.

    A word's end is written as a blank after it, so that the file's tokens become byte strings whose ranks are the
    order of its merges.  Merging by the rank of the joined string is merging by the rank of the pair if each token's
    own string is encoded as that token; tokens for which the file's own model says otherwise can't come from any text,
    and are left out.  Other texts (apostrophes, other scripts, superscript digits, strings that the file names as tokens
    of their own, which it matches before anything else) go to CachedTokenizer.
    """

    LETTER, DIGIT, OTHER, BLANK = range(4)

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import models

        self.slow = CachedTokenizer(path)
        self.vocabulary = self.slow.vocabulary
        with open(path) as f:
            whole = json.load(f)
        spec, self.added = whole["model"], [t["content"] for t in whole.get("added_tokens", [])]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        end = spec["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in such files
        hidden = [b for b in range(256) if b not in shown]
        self.byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        inner, last = models.BPE(spec["vocab"], merges), self.slow.tokenizer.model
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = [spec["vocab"][c] for c, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        for c, b in sorted(self.byte_of.items(), key=lambda x: x[1]):
            ranks[bytes([b, 0x20])] = 256 + b
            ids.append(spec["vocab"][c + end])
        for a, b in merges:
            token = a + b
            whole = last.tokenize(token.removesuffix(end)) if token.endswith(end) else inner.tokenize(token)
            ids.append(spec["vocab"][token])
            if len(whole) == 1 and whole[0].id == ids[-1]:
                ranks[self.raw(token.removesuffix(end)) + b" " * token.endswith(end)] = len(ids) - 1
        self.ids = np.array(ids, np.int64)
        ordered = {t: i for i, t in enumerate(sorted(ranks, key=ranks.get))}
        self.ids = self.ids[[ranks[t] for t in ordered]]
        self.encoder = tiktoken.Encoding("ranked", pat_str="[^ ]+ ", mergeable_ranks=ordered, special_tokens={})
        kind = np.full(256, self.OTHER, np.uint8)
        for b in range(256):
            c = chr(b)
            kind[b] = self.BLANK if c in "\t\n\v\f\r \x85\xa0" else self.LETTER if c.isalpha() else self.DIGIT if c.isdigit() else self.OTHER
        self.kind = kind
        self.lower = np.array([ord(chr(b).lower()) if len(chr(b).lower()) == 1 else b for b in range(256)], np.uint8)
        self.lower[kind == self.BLANK] = 0x20

    def raw(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token)

    def spaced(self, text: str) -> str | None:
        """The text in lower case, each piece followed by a blank; None if it isn't plain."""
        try:
            data = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return None
        if "'" in text or any(c in text for c in "²³¹¼½¾") or any(t in text for t in self.added):
            return None
        kind = self.kind[data]
        digit = kind == self.DIGIT
        cut = np.zeros(len(data), np.int64)
        cut[:-1] = (kind[1:] != kind[:-1]) & (kind[1:] != self.BLANK) & (kind[:-1] != self.BLANK) | digit[1:] & digit[:-1]
        out = np.full(len(data) + int(cut.sum()) + 1, 0x20, np.uint8)
        out[np.arange(len(data)) + np.cumsum(cut) - cut] = self.lower[data]
        return out.tobytes().decode("latin-1")

    def __call__(self, texts: list[str], closing: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another and each closed by ``closing``; and the number of ids of each text."""
        parts, end = [], np.array([closing], np.int64)
        for t in texts:
            plain = self.spaced(t)
            if plain is None:
                parts.append(self.slow([t], closing)[0])
            else:
                parts += [self.ids[self.encoder.encode_to_numpy(plain, disallowed_special=())], end]
                parts[-2:] = [np.concatenate(parts[-2:])]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


@lru_cache(maxsize=2)
def shared_tokenizer(path: str) -> RankedTokenizer | CachedTokenizer:
    """One for all tasks of a worker process."""
    import json

    with open(path) as f:
        spec = json.load(f)
    words_end = spec["model"].get("end_of_word_suffix") and {n["type"] for n in spec["normalizer"].get("normalizers", [])} == {"NFC", "Replace", "Lowercase"}
    return RankedTokenizer(path) if words_end else CachedTokenizer(path)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of unsigned coordinates below 2**bits) on the Hilbert curve through the grid.

    Works from the coarsest bit down: at each level the cell is reflected and rotated into the frame of its
    part of the curve; the levels' bits, undone by a Gray code, interleave to the place.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (one << np.uint64(b))) != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_places(ids: np.ndarray, sizes: np.ndarray, *, buckets: int, dims: int, bits: int) -> np.ndarray:
    """Hilbert keys of documents given as their ids, one document after another."""
    out = np.empty(len(sizes), np.int64)
    bucket = (mix64(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    signs = (mix64(np.arange(buckets * dims, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(11)).astype(np.float64) / 2**53
    directions = (signs.reshape(buckets, dims) - 0.5) * np.sqrt(12)
    ends = np.cumsum(sizes)
    for a in range(0, len(sizes), 1024):
        n = sizes[a : a + 1024]
        flat = bucket[ends[a] - sizes[a] : ends[a + len(n) - 1]]
        counts = np.bincount(np.repeat(np.arange(len(n)) * buckets, n) + flat, minlength=len(n) * buckets).reshape(len(n), buckets)
        v = np.sqrt(counts)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        grid = np.clip((np.tanh(v @ directions) + 1) / 2 * 2**bits, 0, 2**bits - 1).astype(np.int64)
        out[a : a + len(n)] = hilbert_keys(grid, bits)
    return out


def tokenise(docs: DataFrame, *, key: str, text: str, tokenizer: str, closing: int, buckets: int = 256, dims: int = 4, bits: int = 12, segment: int = 4096) -> DataFrame:
    """(key, place, n, start, size, ids): ids as little-endian unsigned 16-bit integers, or 32-bit ones for large vocabularies.

    A document of more than ``segment`` ids has a row for each so many, so that the range sort, which balances rows,
    balances bytes as well.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_tokenizer(tokenizer)
        unit = np.dtype("<u2") if encoder.vocabulary <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                ids, sizes = encoder([t or "" for t in part.column("text").to_pylist()], closing)
                places = curve_places(ids, sizes, buckets=buckets, dims=dims, bits=bits)
                rows = -(-sizes // segment)
                doc = np.repeat(np.arange(len(sizes)), rows)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)) * segment
                size = np.minimum(segment, sizes[doc] - start)
                raw = ids.astype(unit)
                offsets = np.concatenate([[0], np.cumsum(size)]) * unit.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(places[doc]), pa.array(sizes[doc]), pa.array(start), pa.array(size), packed], ["key", "place", "n", "start", "size", "ids"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, f"key {kind}, place long, n long, start long, size long, ids binary")


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(tokens: DataFrame, *, key: str, length: int = 2048) -> DataFrame:
    """Pieces of documents in sequences of ``length``; see curve_packed()."""
    kind = tokens.schema["key"].dataType.simpleString()
    names = [key, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence, used, wide = 0, 0, None
        opened: list[tuple] = []  # pieces of the sequence that isn't full yet

        def batch(pieces: list[tuple], key_type) -> pa.RecordBatch:
            raw = [p[2].astype("<u4").tobytes() for p in pieces]
            cols = [pa.array([p[0] for p in pieces], key_type), pa.array([p[1] for p in pieces], pa.int64()), pa.array([len(p[2]) for p in pieces], pa.int64()), pa.array(raw, pa.binary())]
            cols += [pa.array([zlib.crc32(r) for r in raw], pa.int64())] + [pa.array([p[i] for p in pieces], pa.int64()) for i in (3, 4, 5)]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            full: list[tuple] = []
            wide = b.schema.field("key").type
            for k, n, start, size, raw in zip(*(b.column(c).to_pylist() for c in ("key", "n", "start", "size", "ids")), strict=True):
                ids, at = np.frombuffer(raw, f"<u{len(raw) // size}"), 0
                while at < size:
                    piece = ids[at : at + length - used]
                    opened.append((k, start + at, piece, n, base + sequence, used))
                    at += len(piece)
                    used += len(piece)
                    if used == length:
                        full += opened
                        opened, used, sequence = [], 0, sequence + 1
                if len(full) >= 4096:
                    yield batch(full, wide)
                    full = []
            if full:
                yield batch(full, wide)
        rest: list[tuple] = []
        for size in powers_of_two(used):
            left, at = size, 0
            while left:
                k, start, piece, n, _, _ = opened[0]
                take = piece[:left]
                rest.append((k, start, take, n, base + sequence, at))
                opened[0] = (k, start + len(take), piece[len(take) :], n, 0, 0)
                if not len(opened[0][2]):
                    opened.pop(0)
                left, at = left - len(take), at + len(take)
            sequence += 1
        if rest:
            yield batch(rest, wide)

    ordered = tokens.repartitionByRange("place", "key", "n", "start").sortWithinPartitions("place", "key", "n", "start", "ids")
    return ordered.select("key", "n", "start", "size", "ids").mapInArrow(fill, f"`{key}` {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def curve_packed(docs: DataFrame, *, tokenizer: str, key: str = "doc_id", text: str = "text", closing: int = 1, length: int = 2048, **curve) -> DataFrame:
    """Pieces: key, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    Every id of a document lies in one piece; a sequence has ``length`` ids, or a power of two at a partition's end.
    Ids are written once, before the range sort samples them, so no text is encoded twice.
    """
    tokens = materialise(tokenise(docs, key=key, text=text, tokenizer=tokenizer, closing=closing, **curve), "tokens")
    return pack(tokens, key=key, length=length)
