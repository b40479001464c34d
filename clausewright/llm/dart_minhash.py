"""Near-duplicate classes by DartMinHash signatures and verified links.

A text is the bag of its shingles of five words; a shingle's weight grows with the logarithm of its count (``weights``
names other weights).  Think of darts thrown evenly on the plane of (shingle, weight, rank), the same darts for every
text.  A text owns the darts on the region below its weights; each dart belongs to one of ``k`` coordinates, and a
text's signature holds, for each coordinate, its dart of the least rank.  Two texts agree on a coordinate with the
probability of their weighted Jaccard similarity, the sum of lesser weights over the sum of greater ones.  Only the
lowest k (ln k + 3) darts or so are thrown, so a sparse text costs as much as its shingles and its signature, not their
product; the few texts left without a dart for a coordinate are thrown further.  Ranks, heights, coordinates and
counts of darts come from hashing the cell (shingle, unit of weight, unit of rank).

Bands of coordinates give buckets.  Within a bucket, members are compared with a centre, not with each other: the
exact weighted similarity of their shingles decides, links contract to components, and buckets whose members are in one
component are done.  Buckets that hold several components after ``star_rounds`` centres are cut into blocks of bounded
size, those of a large component apart from the others; pairs of blocks of different components are compared in
memory, one member against a whole block at a time, and only links that connect components leave it.  There whole
signatures rule out members whose best estimate is ``deviations`` standard deviations below the threshold (None: no
member is ruled out), and exact similarities decide the others, so no link is lost to the use of centres, and no list
of pairs is ever made.

With 7 coordinates to a band and 44 bands, a pair at similarity 0.8 shares no bucket with probability 3e-5.

Defined cases: a null text is the empty one; all texts without a word are copies of each other; a text of less than
five words has one shingle; every row is a document, so rows that share a key may be in different classes; a class
is named by its least key, and one whose rows have no key by a hash of its texts, so unlinked texts under one key
are classes of one name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import exp, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.components import components
from clausewright.llm.shared import discard, least_per_key, materialise, mix64, salt_of, small_batches, text_key, text_slices
from clausewright.llm.words import elements, shingles, text_bytes, words

#: A cell of unit area has a Poisson(1) number of darts: bounds of the hash for 0, 1, 2, ... of them.
CELL_BOUNDS = np.array([min(2**64 - 1, int(2**64 * sum(exp(-1) / factorial(i) for i in range(n + 1)))) for n in range(12)], np.uint64)
WEYL_RANK, WEYL_DART, WEYL_UNIT, HEIGHT = (np.uint64(x) for x in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0x5851F42D4C957F2D))
NONE = np.uint64(2**64 - 1)
RANK_BITS, PRINT_BITS = 27, 21
#: The weight of a shingle that a text has n times.
WEIGHTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"damped": lambda n: 1 + np.log(n), "count": lambda n: n.astype(float), "set": lambda n: np.ones(len(n))}


def throw(table: np.ndarray, h: np.ndarray, weight: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
    """Keep in ``table`` (rows x k) the least darts on the elements' regions: heights below ``weight``, ranks low <= r < high."""
    span = high - low
    n = span * np.ceil(weight).astype(np.int64)
    cell = np.repeat(np.arange(len(h)), n)
    unit, rank = np.divmod(np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n), span[cell])
    rank = (rank + low[cell]).astype(np.uint64)
    seed = mix64(h[cell] + (rank + np.uint64(1)) * WEYL_RANK + unit.astype(np.uint64) * WEYL_UNIT)
    darts = np.searchsorted(CELL_BOUNDS, seed, "right")
    at = np.repeat(np.arange(len(cell)), darts)
    nth = (np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts) + 1).astype(np.uint64)
    x = mix64(seed[at] + nth * WEYL_DART)
    room = weight[cell[at]] - unit[at]  # a weight's last unit may be a part of one
    cut = np.flatnonzero(room < 1)
    if len(cut):
        keep = np.ones(len(at), bool)
        keep[cut] = (mix64(x[cut] ^ HEIGHT) >> np.uint64(11)) * 2.0**-53 < room[cut]
        at, x = at[keep], x[keep]
    coordinate = ((x >> np.uint64(48)) * np.uint64(k)) >> np.uint64(16)
    dart = (rank[at] << np.uint64(RANK_BITS + PRINT_BITS)) | (x & np.uint64(2**48 - 1))
    np.minimum.at(table.reshape(-1), row[cell][at] * k + coordinate.astype(np.int64), dart)


def signatures(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Darts of least rank, texts x k, of weighted elements sorted by text; rows of texts without elements stay NONE."""
    table = np.full((n_docs, k), NONE)
    total = np.bincount(doc, weight, n_docs)
    low = np.zeros(n_docs, np.int64)
    high = np.ceil(k * (log(k) + 3) / np.where(total > 0, total, 1)).astype(np.int64)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        for a in range(0, len(mine), 1 << 16):  # bounds the memory of one throw
            part = mine[a : a + (1 << 16)]
            begin = 0
            sizes = (high - low)[doc[part]] * np.ceil(weight[part]).astype(np.int64)
            for end in [*np.flatnonzero(np.diff(np.cumsum(sizes) >> 18)) + 1, len(part)]:
                some = part[begin:end]
                if len(some):
                    throw(table, h[some], weight[some], doc[some], low[doc[some]], high[doc[some]], k)
                begin = end
        todo &= (table == NONE).any(axis=1)
        low, high = np.where(todo, high, low), np.where(todo, 2 * high, high)
    return table


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each signature; it holds the band's number."""
    out = np.empty((len(table), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(table), b + 1, np.uint64)
        for r in range(rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + table[:, b * rows + r])
        out[:, b] = acc
    return out.view(np.int64)


def _text_elements(part: pa.RecordBatch, width: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part.column("text"))
    _, _, h, doc = words(data, offsets)
    h, doc, n = elements(*shingles(h, doc, part.num_rows, width))
    return h, WEIGHTS[weights](n).astype(np.float32).astype(float), doc


def sign(docs: DataFrame, *, width: int, bands: int, rows: int, weights: str) -> DataFrame:
    """(key, copy, salt, bands) of rows (key, copy, text); texts without a word have no bands, and salts go round."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                h, weight, doc = _text_elements(part, width, weights)
                full = np.bincount(doc, minlength=part.num_rows) > 0
                keys = band_keys(signatures(h, weight, doc, part.num_rows, bands * rows), bands, rows)[full]
                offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))
                salts, seen = pa.array(((np.arange(part.num_rows) + seen) % 64).astype(np.int32)), seen + part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copy"), salts, lists], ["key", "copy", "salt", "bands"])

    return docs.select("key", "copy", "text").mapInArrow(run, f"key {kinds['key']}, copy binary, salt int, bands array<long>")


def weighted_sets(docs: DataFrame, *, width: int, weights: str, k: int) -> DataFrame:
    """(node, s, w, marks) of rows (node, text): elements, sorted, their weights, and 16 bits of each coordinate of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 19):
                h, weight, doc = _text_elements(part, width, weights)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32))
                marks = (mix64(signatures(h, weight, doc, part.num_rows, k).reshape(-1)) >> np.uint64(48)).astype("<u2").reshape(-1, k)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.view(np.int64), weight.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array([m.tobytes() for m in marks], pa.binary())], ["node", "s", "w", "marks"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<long>, w array<float>, marks binary")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and the last ends, and all their values."""
    return np.asarray(column.offsets), np.asarray(column.values)


def near(similarity: float, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether weights in common are ``similarity`` of those of both, to the precision of the sums."""
    return common >= similarity * (a + b - common) - 1e-9 * (a + b)


def similar(pairs: DataFrame, sets: DataFrame, *, similarity: float) -> DataFrame:
    """(a, b): those of the distinct pairs whose exact weighted similarity reaches ``similarity``.

    A set that very many pairs name as their ``b`` is dealt over salts and met there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (e, s), (_, v), (f, t), (_, w) = (_lists(batch.column(c)) for c in ("s", "v", "t", "w"))
            common, one, two = np.zeros((3, batch.num_rows))
            for i in range(batch.num_rows):
                x, y = slice(e[i], e[i + 1]), slice(f[i], f[i + 1])
                _, p, q = np.intersect1d(s[x], t[y], assume_unique=True, return_indices=True)
                common[i] = np.minimum(v[x][p], w[y][q]).sum(dtype=float)
                one[i], two[i] = v[x].sum(dtype=float), w[y].sum(dtype=float)
            yield batch.select(["a", "b"]).filter(pa.array(near(similarity, common, one, two)))

    pairs = pairs.withColumn("salt", salt_of("a", salts=32))
    second = pairs.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("s").alias("t"), "w"), "b")
    both = pairs.join(sets.select(F.col("node").alias("a"), "s", F.col("w").alias("v")), "a").join(second, ["b", "salt"])
    return both.select("a", "b", "s", "v", "t", "w").mapInArrow(run, "a long, b long")


def connect(table: pa.Table, *, similarity: float, low: float | None) -> list[tuple[int, int]]:
    """Rows (places in ``table``) that connect what is connected between its components (root), across its blocks if there are two.

    One member at a time is held against all others: its weights are laid out over the codes of the shingles that
    occur here, so the common weights with every other member are one sum over their codes.
    """
    n, root = table.num_rows, np.unique(np.asarray(table.column("root")), return_inverse=True)[1]
    side = np.asarray(table.column("second"))
    across = side.any() and not side.all()
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), "<u2").reshape(n, -1)
    ends, flat = _lists(table.column("s").combine_chunks())
    weight = _lists(table.column("w").combine_chunks())[1]
    code = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    del flat
    total = np.add.reduceat(weight, ends[:-1], dtype=float)
    laid = np.zeros(int(code.max()) + 1, np.float32)
    out = []
    for x in range(n):
        rest = np.flatnonzero((root != root[x]) & ((side & ~side[x]) if across else (np.arange(n) > x)))
        if low is not None and len(rest):
            rest = rest[(marks[rest] == marks[x]).mean(axis=1) >= low]
        if not len(rest):
            continue
        mine = slice(ends[x], ends[x + 1])
        laid[code[mine]] = weight[mine]
        begin, size = ends[rest], ends[rest + 1] - ends[rest]
        starts = np.cumsum(size) - size
        at = np.repeat(begin - starts, size) + np.arange(size.sum())
        common = np.add.reduceat(np.minimum(laid[code[at]], weight[at]), starts, dtype=float)
        laid[code[mine]] = 0
        for y in rest[near(similarity, common, total[x], total[rest])].tolist():
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[y]] = root[x]
    return out


def links_in_blocks(at: DataFrame, sets: DataFrame, *, similarity: float, k: int, deviations: float | None, members: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """(a, b): links between members (bucket, node, root) of different roots, enough to connect what is connected.

    Within a bucket, a root with more than about ``members`` rows or ``block_bytes`` has blocks of its own; the others
    share theirs.  Two blocks of one root are never compared.
    """
    load = F.size("s") * 12 + 2 * k
    rows = at.join(sets.select("node", load.alias("bytes")), "node").withColumn("salt", salt_of("node"))
    part = rows.groupBy("bucket", "root", "salt").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("bytes"))
    blocks = lambda c, n: F.greatest(F.ceil(F.col(c) / members), F.ceil(F.col(n) / block_bytes)).cast("int")
    roots = part.groupBy("bucket", "root").agg(F.sum("c").alias("c"), F.sum("bytes").alias("bytes"), F.collect_list("salt").alias("salts")).withColumn("parts", blocks("c", "bytes"))
    roots = roots.withColumn("own", F.when(F.col("parts") > 1, F.col("root")).otherwise(-1))
    owned = roots.groupBy("bucket", "own").agg(F.sum("c").alias("c"), F.sum("bytes").alias("bytes")).withColumn("parts", blocks("c", "bytes"))
    place = roots.select("bucket", "root", "own", F.explode("salts").alias("salt"))
    block = owned.select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    lists = block.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("own", "part"))).alias("all"))
    first = lists.select("bucket", "all", F.posexplode("all").alias("i", "x"))
    pairs = first.select("bucket", "i", "x", F.posexplode("all").alias("j", "y")).where("j >= i AND (x.own < 0 OR x.own != y.own)")
    sides = pairs.select("bucket", "i", "j", F.explode(F.array(F.struct(F.col("x").alias("block"), F.lit(False).alias("second")), F.struct(F.col("y").alias("block"), F.lit(True).alias("second")))).alias("s"))
    sides = sides.where("i != j OR NOT s.second").select("bucket", "i", "j", "s.block", "s.second")
    dealt = rows.join(place, ["bucket", "root", "salt"]).join(owned.select("bucket", "own", "parts"), ["bucket", "own"])
    dealt = dealt.select("bucket", "node", "root", F.struct("own", F.pmod(F.xxhash64("node", F.lit(99)), "parts").cast("int").alias("part")).alias("block"))
    groups = dealt.join(sides, ["bucket", "block"]).select("bucket", "i", "j", "second", "node", "root").join(sets, "node")
    low = None if deviations is None else similarity - deviations * (similarity * (1 - similarity) / k) ** 0.5

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").combine_chunks()
        found = np.array(connect(table, similarity=similarity, low=low), np.int64).reshape(-1, 2)
        return pa.table({"a": node.take(pa.array(found[:, 0])), "b": node.take(pa.array(found[:, 1]))})

    return groups.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _copy(text: Column) -> Column:
    """Identity of a text; those without a word have the empty one's."""
    return text_key(F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), text))


def _who(key: str, copy: str) -> Column:
    """One value for a key, which may be null, and a text's identity."""
    return F.concat(copy, F.encode(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), "UTF-8"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: one with the class's least key and, of several texts under that, the least copy."""
    kept = near_classes(docs, key=key, text=text, **options).where("kept").select(_who(key, "text_sha256").alias("kept_who")).distinct()
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("key"), _copy(F.col(text)).alias("copy"))
    named = named.select("row", _who("key", "copy").alias("who"))
    return named.join(kept, F.col("who") == F.col("kept_who"), "left_semi").dropDuplicates(["who"]).select("row.*")


def near_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 44, rows: int = 7, weights: str = "damped", star_rounds: int = 1, deviations: float | None = 6.0
) -> DataFrame:
    """(key, class_id, copies, links, kept, text_sha256) for each row of ``docs``.

    class_id: the least key of the texts that links of at least ``similarity`` and exact copies connect; copies:
    rows with this very text; links: verified links by which this text hangs together with its class; kept: whether the
    row stands for its class (so do rows that equal it in key and text).  All texts without a word have the empty one's text_sha256.
    """
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _copy(F.col(text)).alias("copy"))
    signed = materialise(sign(named, width=width, bands=bands, rows=rows, weights=weights), "signatures")
    texts = signed.groupBy("copy").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.collect_set("salt").alias("salts"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "texts")

    open_ = texts.select("node", F.explode("bands").alias("bucket")).withColumn("salt", salt_of("node"))
    sizes = least_per_key(open_, "bucket", "node", "centre").where("copies > 1").drop("copies")
    open_ = materialise(open_.join(sizes, ["bucket", "salt"]).select("bucket", "node", "centre"), "buckets")

    members = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", _who("least", "copy").alias("who"))
    chosen = named.select(_who("key", "copy").alias("who"), "text").join(members, "who").dropDuplicates(["who"]).select("node", "text")
    sets = materialise(weighted_sets(chosen, width=width, weights=weights, k=bands * rows), "sets")

    met, roots, links, spent = open_.where("node != centre"), None, [], [open_]
    for turn in range(star_rounds + 1):
        if turn:
            at = open_.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            several = at.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
            open_ = at = materialise(at.join(several.select("bucket"), "bucket", "left_semi").select("bucket", "node", "root"), "buckets")
            spent.append(open_)
        if 0 < turn < star_rounds:  # another centre for each bucket
            ranked = at.withColumns({"rank": F.struct(F.xxhash64("node", F.lit(turn)), "node", "root"), "salt": salt_of("node")})
            picked = least_per_key(ranked, "bucket", "rank", "centre").select("bucket", "salt", "centre")
            met = ranked.join(picked, ["bucket", "salt"]).where("root != centre.root").select("bucket", "node", F.col("centre.node").alias("centre"))
        if turn < star_rounds:
            pairs = met.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
            fresh = similar(pairs, sets, similarity=similarity)
        else:  # what centres didn't settle
            fresh = links_in_blocks(at, sets, similarity=similarity, k=bands * rows, deviations=deviations)
        fresh = materialise(fresh, "links")
        discard(*spent[:-1])
        spent = spent[-1:]
        links.append(fresh)
        if roots is None or not fresh.isEmpty():
            roots = components(reduce(DataFrame.unionByName, links))
    discard(sets, *spent)

    ends = reduce(DataFrame.unionByName, links).distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    stands = lambda: F.struct(F.col("least").isNull().alias("without"), F.col("least").alias("key"), "copy")
    in_class = roots.join(texts.select("node", stands().alias("stands")), "node").withColumn("salt", salt_of("node"))
    best = least_per_key(in_class, "root", "stands", "best").drop("copies")
    joined = in_class.join(best, ["root", "salt"]).select("node", "best").join(ends, "node", "left")
    labels = texts.join(joined, "node", "left").withColumn("best", F.coalesce("best", stands()))
    labels = materialise(labels.select("copy", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "best", "salts"), "labels")
    discard(texts, roots, *links)
    out = signed.select("key", "copy", "salt").join(labels.withColumn("salt", F.explode("salts")), ["copy", "salt"])
    kind = "bigint" if isinstance(docs.schema[key].dataType, T.IntegralType) else "string"
    name = F.coalesce(F.col("best.key").cast(kind), F.xxhash64("best.copy").cast(kind))
    kept = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("copy") == F.col("best.copy"))
    return out.select(F.col("key").alias(key), name.alias("class_id"), "copies", "links", kept.alias("kept"), F.col("copy").alias("text_sha256"))
