"""Removal of repeated byte strings by a range-partitioned, sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller key, or
earlier in the same one.  Sorting a suffix for every byte would move the corpus a hundred times over, so suffixes
are taken where they are needed:

1. Every string of ``length`` bytes has an anchor in it: of its runs of ``lead`` bytes the one with the least hash,
   the leftmost of several.  Equal strings have equal anchors at equal places, and neighbouring strings mostly
   share one, so anchors are few.  Only anchors whose leading bytes occur more than once can lead to a repeat;
   a shuffle of (hash, text) finds them.  Copies of a whole text count once; of texts that meet in a batch, hot
   anchors are settled there, so the shuffle has at most one row for each batch and anchor.
2. At repeated anchors, the suffix from the first string of the anchor to the end of its last one is taken.
   Spark's sampled splitters range-partition these suffixes by the bytes that lead from the anchor.  A splitter
   never parts suffixes with equal leading bytes.
3. Each bucket sorts its suffixes by a multikey quicksort: machine words take the place of characters, and all
   parts of a level are split at once.  Whole suffixes are sorted first, and of equal ones only the earliest goes
   on; then the strings at each distance from the anchor.  In a run of equal strings all but the earliest go.
4. Leading bytes that a sample of the suffixes shows to be hot, and any run of suffixes too large for a bucket, are
   not gathered.  Their strings go on as digests and are compared across buckets by a salted aggregation.

Defined cases: a null text is the empty one; texts under ``length`` bytes lose nothing; a null key comes after all
keys; rows with equal key and text are one document, and rows with equal key and other text are ordered by a hash
of the text; an empty table gives an empty result.  Keys of any kind go by their order (2**63 - 1 ties with a null one);
keys that aren't whole numbers are numbered in a range sort first.  Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.shared import discard, least_per_key, materialise, mix64, salt_of, small_batches, text_slices
from clausewright.llm.words import BASE, BASE_INVERSE, BYTE_VALUES, powers, prefix_hash, text_bytes

LAST = (1 << 63) - 1
#: State of an anchor that its batch has shown to be repeated; others are 1 if a text has them several times, or 0.
SETTLED = 2


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: text number, anchor, first string, last string, anchor's hash.

    Places count from the start of ``data``.
    """
    n, w = len(data), length - lead + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    p = prefix_hash(data)
    h = mix64((p[lead:] - p[:-lead]) * powers(BASE_INVERSE, n + 1)[: n - lead + 1])
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # the least is the leftmost of equals
    size = 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = w - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    start = np.arange(len(low))
    doc = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[doc + 1]
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]
    start, doc = start[inside], doc[inside]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], start[first], start[last], h[at[first]]


def repeated_anchors(texts: DataFrame, *, length: int, lead: int) -> DataFrame:
    """(copy, hashes): of each distinct text (copy, text), the anchors that occur again in it or in another text."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hs, copies, seen = [], [], set()
            for part in text_slices(batch, "text", 1 << 20):
                name = np.asarray(part.column("copy"))
                fresh = np.array([c not in seen and not seen.add(c) for c in name.tolist()], bool)
                data, offsets = text_bytes(part.column("text"))
                doc, _, _, _, h = anchors(data, offsets, length, lead)
                keep = fresh[doc]
                hs.append(h[keep])
                copies.append(name[doc[keep]])
            h, copy = np.concatenate(hs), np.concatenate(copies)
            order = np.lexsort((copy, h))
            h, copy = h[order], copy[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            run = np.flatnonzero(new)
            many = np.diff(np.append(run, len(h))) > 1
            pair = new.copy()
            pair[1:] |= copy[1:] != copy[:-1]
            known = np.flatnonzero(np.repeat(many, np.diff(np.append(run, len(h)))) & pair)
            # one row for each anchor meets those of other batches; those met twice already are settled here and go by their text
            h, copy, many = (np.concatenate([x, y]) for x, y in ((h[run], h[known]), (copy[run], copy[known]), (many, np.ones(len(known), bool))))
            state = np.where(np.arange(len(h)) >= len(run), SETTLED, many).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(copy), pa.array(state)], ["h", "copy", "state"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, False, False)  # hash, a text, settled already, passed on
        for b in batches:
            state = np.asarray(b.column("state"))
            done = state == SETTLED
            if done.any():
                yield b.filter(pa.array(done)).select(["h", "copy"])
            h, copy, many = np.asarray(b.column("h"))[~done], np.asarray(b.column("copy"))[~done], state[~done] > 0
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            run = np.flatnonzero(new)
            size = np.diff(np.append(run, len(h)))
            again = (np.maximum.reduceat(copy, run) != np.minimum.reduceat(copy, run)) | np.logical_or.reduceat(many, run)
            out_h, out_copy = [], []
            if h[0] == last[0]:
                again[0] |= last[2] or copy[0] != last[1] or np.any(copy[: size[0]] != last[1])
                if again[0] and not last[3]:
                    out_h, out_copy = [last[0]], [last[1]]
            rows = np.repeat(again, size)
            # a run that goes on in the next batch may turn out to be repeated: its text is then passed on late
            last = (h[-1], copy[-1], bool(again[-1]), bool(again[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(out_h, np.int64), h[rows]])), pa.array(np.concatenate([np.array(out_copy, np.int64), copy[rows]]))], ["h", "copy"])

    found = texts.mapInArrow(local, "h long, copy long, state byte")
    settled = F.col("state") == SETTLED
    met = found.repartition(F.when(settled, F.col("copy")).otherwise(F.col("h"))).sortWithinPartitions(settled, "h", "copy").mapInArrow(meet, "h long, copy long")
    return met.groupBy("copy").agg(F.collect_set("h").alias("hashes"))


def suffixes(texts: DataFrame, *, length: int, lead: int) -> DataFrame:
    """Suffixes at repeated anchors of (rank, copy, text, hashes).

    Rows with ``suffix`` are (start, strings, anchor: its place in the suffix, leading: bytes from the anchor); those
    without are strings from ``start`` on that the batch itself has shown to be repeats.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[bytes, tuple] = {}
            gone: list[tuple] = []
            for part in text_slices(batch, "text", 1 << 20):
                rank, copy = part.column("rank").to_pylist(), part.column("copy").to_pylist()
                data, offsets = text_bytes(part.column("text"))
                doc, at, first, last, h = anchors(data, offsets, length, lead)
                lists = part.column("hashes")
                wanted = np.asarray(lists.flatten()).view(np.uint64)
                whose = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(lists)))
                both = np.isin(mix64(h) ^ mix64(doc.astype(np.uint64) + np.uint64(1)), mix64(wanted) ^ mix64(whose.astype(np.uint64) + np.uint64(1)))
                raw = data.tobytes()
                for d, x, a, z in zip(doc[both].tolist(), at[both].tolist(), first[both].tolist(), last[both].tolist(), strict=True):
                    suffix, row = raw[a : z + length], (rank[d], copy[d], a - int(offsets[d]), z - a + 1, x - a)
                    other = best.setdefault(suffix, row)
                    if other is not row:
                        if row < other:
                            best[suffix], row = row, other
                        gone.append(row)
            rows = [(*r, s, s[r[4] : r[4] + lead]) for s, r in best.items()] + [(*r, None, None) for r in gone]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["rank", "copy", "start", "strings", "anchor", "suffix", "leading"])

    return texts.mapInArrow(cut, "rank long, copy long, start long, strings int, anchor int, suffix binary, leading binary")


def multikey_classes(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Classes of equal rows within groups: a multikey quicksort over columns of words.

    Each level sorts the rows of every part that still has several by their next word, and splits the parts where
    the word changes; parts of one row are done.  What stays together to the end is equal.
    """
    order = np.argsort(group, kind="stable")
    part = np.empty(len(group), np.int64)
    part[order] = np.cumsum(np.r_[False, group[order][1:] != group[order][:-1]])
    out = part.copy()
    live, count = np.arange(len(group)), int(part.max(initial=-1)) + 1
    for c in range(words.shape[1]):
        sizes = np.bincount(out[live], minlength=count)
        live = live[sizes[out[live]] > 1]
        if not len(live):
            break
        w, p = words[live, c], out[live]
        by = np.lexsort((w, p))
        w, p = w[by], p[by]
        split = np.r_[False, (p[1:] == p[:-1]) & (w[1:] != w[:-1])]
        fresh = np.r_[True, p[1:] != p[:-1]]
        step = np.cumsum(split)
        base = np.maximum.accumulate(np.where(fresh, step, 0))
        moved = step - base > 0
        # the first sub-part keeps its part's number, the others get new ones
        ids = np.where(moved, count + step - 1, p)
        out[live[by]] = ids
        count += int(step[-1])
    return out


def all_but_earliest(cls: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows are not the least, by ``keys`` in order, of their class."""
    order = np.lexsort((*reversed(keys), cls))
    later = np.ones(len(cls), bool)
    later[order] = np.r_[False, cls[order][1:] == cls[order][:-1]] if len(cls) else later
    return later


def _word_view(matrix: np.ndarray) -> np.ndarray:
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    return padded.view(">u8").astype(np.uint64)


def sort_bucket(rows: dict[str, np.ndarray], suffix: list[bytes], group: np.ndarray, length: int, lead: int, most: int = 300_000) -> list[tuple]:
    """Strings to remove in whole groups of suffixes: (rank, copy, first start, last start)."""
    reach = length - lead  # an anchor is at most so far into its string
    n, width = len(suffix), reach + length + 1
    grid = np.zeros((n, width + reach), np.uint8)
    sizes = np.array([len(s) for s in suffix])
    left = reach - rows["anchor"]
    flat = np.frombuffer(b"".join(suffix), np.uint8)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grid[np.repeat(np.arange(n), sizes), np.repeat(left, sizes) + inner] = flat
    ident = np.column_stack([_word_view(grid), rows["anchor"].astype(np.uint64), rows["strings"].astype(np.uint64)])
    later = all_but_earliest(multikey_classes(ident, group), rows["rank"], rows["copy"], rows["start"])
    out = [(rows["rank"][i], rows["copy"][i], rows["start"][i], rows["start"][i] + rows["strings"][i] - 1) for i in np.flatnonzero(later)]
    alone = np.bincount(group[~later], minlength=group.max() + 1)
    kept = np.flatnonzero(~later & (alone[group] > 1))
    if not len(kept):
        return out
    # string j of a suffix is anchor - j before its anchor; only strings at one distance can be equal
    total, pieces = rows["strings"][kept], []
    row = np.repeat(kept, total)
    j = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    far = rows["anchor"][row] - j
    by = np.argsort(far, kind="stable")
    row, j, far = row[by], j[by], far[by]
    cuts, begin = np.flatnonzero(np.r_[True, far[1:] != far[:-1]]), 0
    windows = np.lib.stride_tricks.sliding_window_view(grid, length, axis=1)
    for end in [*cuts[1:], len(row)]:
        if end - begin >= most or end == len(row):
            r, jj = row[begin:end], j[begin:end]
            words = _word_view(windows[r, left[r] + jj])
            cls = multikey_classes(words, group[r] * (reach + 1) + far[begin:end])
            gone = all_but_earliest(cls, rows["rank"][r], rows["copy"][r], rows["start"][r] + jj)
            pieces.append((r[gone], jj[gone]))
            begin = end
    r, jj = (np.concatenate([p[i] for p in pieces]) for i in (0, 1))
    by = np.lexsort((jj, r))
    r, jj = r[by], jj[by]
    if len(r):
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (jj[1:] != jj[:-1] + 1)])
        last = np.r_[first[1:], len(r)] - 1
        out += list(zip(rows["rank"][r[first]], rows["copy"][r[first]], rows["start"][r[first]] + jj[first], rows["start"][r[last]] + jj[last], strict=True))
    return out


STARTS = "rank long, copy long, first long, last long, digest binary"


def start_rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["rank", "copy", "first", "last", "digest"])


def string_digests(part: list[dict], length: int) -> list[tuple]:
    """Each string of some suffixes, as a start with its digest."""
    out = []
    for x in part:
        for k in range(x["strings"]):
            d = hashlib.blake2b(x["suffix"][k : k + length], digest_size=16).digest()
            out.append((x["rank"], x["copy"], x["start"] + k, x["start"] + k, d))
    return out


def hot_leading(rows: DataFrame, *, least: int, sample: int = 100_000, share: float = 0.001) -> DataFrame:
    """(leading): leading bytes that, by a sample, a share of all rows and at least ``least`` rows have; 1 / ``share`` or so at most."""
    n = rows.count()
    step = max(1, n // sample)
    counts = rows.where(F.pmod(F.xxhash64("rank", "copy", "start"), F.lit(step)) == 0).groupBy("leading").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * step >= max(n * share, least)).select("leading")


def sort_suffixes(rows: DataFrame, *, length: int, lead: int, chunk: int = 8192, most: int = 100_000) -> DataFrame:
    """(rank, copy, first, last, digest): starts of strings to remove; rows with a digest are yet to be compared."""

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        held_leading, overflow = None, None

        digests = lambda part: string_digests(part, length)

        def settle(part: list[dict]) -> list[tuple]:
            num = {k: np.array([x[k] for x in part], np.int64) for k in ("rank", "copy", "start", "strings", "anchor")}
            groups: dict[bytes, int] = {}
            group = np.array([groups.setdefault(x["leading"], len(groups)) for x in part])
            return [(*map(int, f), None) for f in sort_bucket(num, [x["suffix"] for x in part], group, length, lead)]

        for b in batches:
            for x in b.to_pylist():
                if x["leading"] != held_leading:
                    if len(held) >= chunk and overflow is None:
                        yield start_rows(settle(held))
                        held = []
                    elif overflow is not None:
                        yield start_rows(digests(held))
                        held, overflow = [], None
                    held_leading, since = x["leading"], len(held)
                held.append(x)
                if overflow is not None and len(held) >= chunk:
                    yield start_rows(digests(held))
                    held = []
                elif overflow is None and len(held) - since >= most:
                    if since:
                        yield start_rows(settle(held[:since]))
                    yield start_rows(digests(held[since:]))
                    held, overflow = [], x["leading"]
        if held:
            yield start_rows(digests(held) if overflow is not None else settle(held))

    buckets = rows.repartitionByRange("leading").sortWithinPartitions("leading")
    return buckets.mapInArrow(bucket, STARTS)


def repeated_strings(rows: DataFrame, *, length: int, lead: int, hot: int = 2048, **bucket) -> DataFrame:
    """(rank, copy, first, last): starts of all strings to remove, from suffixes()."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                yield start_rows(string_digests(b.slice(a, 1024).to_pylist(), length))

    whole = rows.where("suffix is not null")
    often = F.broadcast(hot_leading(whole, least=hot))
    sorted_ = sort_suffixes(whole.join(often, "leading", "left_anti").select(*rows.columns), length=length, lead=lead, **bucket)
    dealt = whole.join(often, "leading", "left_semi").select("rank", "copy", "start", "strings", "suffix").mapInArrow(spread, STARTS)
    found = materialise(sorted_.unionByName(dealt), "repeats")
    across = found.where("digest is not null").select("digest", F.struct("rank", "copy", "first").alias("at")).withColumn("salt", salt_of("at"))
    earliest = least_per_key(across, "digest", "at", "least").drop("copies")
    later = across.join(earliest, ["digest", "salt"]).where("at != least").select("at.rank", "at.copy", "at.first", F.col("at.first").alias("last"))
    local = rows.where("suffix is null").select("rank", "copy", F.col("start").alias("first"), (F.col("start") + F.col("strings") - 1).alias("last"))
    starts = found.where("digest is null").drop("digest").unionByName(later).unionByName(local)
    starts = materialise(starts.groupBy("rank", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("starts")), "starts")
    discard(rows, found)
    return starts


def _left(raw: bytes, starts: list[dict] | None, length: int, whole_chars: bool) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs and what is left of a text, of whose strings those from ``starts`` go."""
    parts, at, n, total, end = [], 0, 0, 0, -1
    for x in starts or ():
        lo, hi = x["first"], x["last"] + length
        if lo > end:
            parts.append(raw[at:lo])
            n += 1
            total += hi - lo
        else:
            total += max(0, hi - end)
        end = at = max(end, hi)
    if not n:
        return 0, 0, raw
    parts.append(raw[at:])
    return total, n, b"".join(p.decode("utf-8", "ignore").encode() for p in parts) if whole_chars else b"".join(parts)


def cut_out(docs: DataFrame, carry: list[str], *, length: int, digest: bool, whole_chars: bool) -> DataFrame:
    """(key, carry.., n_bytes, n_removed, n_spans, kept or kept_sha256) of rows (key, carry.., text, starts, whole).

    ``starts`` are structs (first, last) in order, or null; a row that is ``whole`` goes whole.  With
    ``whole_chars``, a character of which a cut has left a part goes too, so that ``kept`` is text.
    """
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, starts, whole in zip(b.column("text"), b.column("starts"), b.column("whole"), strict=True):
                raw = text.as_py().encode()
                removed, spans, left = (len(raw), 1, b"") if whole.as_py() else _left(raw, starts.as_py(), length, whole_chars)
                out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest() if digest else left))
            form = pa.string() if digest else pa.binary()
            cols = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), form))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", *carry)), *cols], ["key", *carry, *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("key", *carry)) + f", n_bytes long, n_removed long, n_spans long, {names[-1]} {'string' if digest else 'binary'}"
    return docs.select("key", *carry, "text", "starts", "whole").mapInArrow(cut, schema)


def ranked(rows: DataFrame) -> DataFrame:
    """With ``rank``, a whole number in the order of the keys, null last: a whole number itself, or the key's place in a range sort."""
    if isinstance(rows.schema["key"].dataType, T.IntegralType):
        return rows.withColumn("rank", F.coalesce(F.col("key").cast("long"), F.lit(LAST)))
    keys = rows.select("key").where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")
    places = materialise(keys.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return rows.join(places, "key", "left").withColumn("rank", F.coalesce("rank", F.lit(LAST)))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 100, lead: int = 32, carry: tuple[str, ...] = (), digest: bool = False, whole_chars: bool = False, **bucket) -> DataFrame:
    """What is left of each text: key, n_bytes, n_removed, n_spans, then ``kept`` (its bytes) and ``carry`` columns.

    With ``digest``, kept_sha256 takes the place of ``kept``.  Texts move twice: to their anchors that occur again, and to
    the starts of what goes; nothing else that is written holds a whole text.
    """
    small_batches(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    carried = [f"carry_{c}" for c in carry]
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry))
    rows = ranked(rows).withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = rows.withColumns({"copy": F.xxhash64("sha"), "salt": salt_of("rank")})
    long_ = rows.where(F.octet_length("text") >= length)
    firsts = materialise(least_per_key(long_.select("sha", "rank", "salt"), "sha", "rank", "first"), "firsts")
    one = firsts.groupBy("sha").agg(F.first("first").alias("rank")).select("rank", F.xxhash64("sha").alias("copy"))
    again = repeated_anchors(long_.select("copy", "text"), length=length, lead=lead)
    texts = long_.select("rank", "copy", "text").join(one.join(again, "copy"), ["rank", "copy"]).dropDuplicates(["rank", "copy"])
    found = materialise(suffixes(texts, length=length, lead=lead), "suffixes")
    starts = repeated_strings(found, length=length, lead=lead, **bucket)
    copies = long_.select("sha", "salt", "rank", "copy").join(firsts.drop("copies"), ["sha", "salt"]).where("rank != first").select("rank", "copy").distinct()
    cuts = starts.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    asked = rows.select("key", *carried, "text", "rank", "copy").join(cuts, ["rank", "copy"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    out = cut_out(asked, carried, length=length, digest=digest, whole_chars=whole_chars)
    kept = "kept_sha256" if digest else "kept"
    return out.select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", kept, *(F.col(f"carry_{c}").alias(c) for c in carry))
