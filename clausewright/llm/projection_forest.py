"""Nearest neighbours by a forest of random-projection trees, searched through one priority queue, and exact reranking.

Each tree halves a bounded sample of the vectors again and again, at the median along the direction between two of them.  Every
vector goes to its leaf in every tree.  A query's search keeps the sides it hasn't gone to in one queue for all
trees, nearest bound first, and takes leaves until they hold a given share of all vectors.  Vectors and queries then meet by
leaf: leaves are dealt into parts of bounded size, a part's vectors are held while its queries stream by, and distances
are made in double precision of the original vectors.

The share is measured, not guessed: :func:`fit` searches its sample for vectors of the sample and takes the least share with
which nearly all true neighbours are found.  In clustered vectors that is little; where all directions are alike (as in
random vectors of 64 dimensions) any tree has to look at about half of them.  A larger table makes neighbours nearer
and so easier to find, so the sample's share holds for the whole.

Copies of one vector are one point, with as many of the least ids as an answer can hold: no leaf fills up with copies, and
nothing is lost, as ties go to smaller ids.

Defined cases: vectors that are null, empty or zero, hold a null or non-finite component, or have another length than most
vectors take no part, nor do rows without an id; of several vectors under one id the least counts, repeated rows once;
equal distances go by id; a table with a single vector has no neighbours, an empty table an empty result; other columns are left behind.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.shared import discard, materialise


@dataclass
class Tree:
    """Inner nodes have a direction, a threshold and two children; a child below 0 is leaf -1 - child."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    root: int
    leaves: int


@dataclass
class Forest:
    trees: list[Tree]
    share: float = 1.0
    sizes: list[np.ndarray] = field(default_factory=list)


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree that halves the sample until at most ``leaf`` vectors are left, or copies of one."""
    directions, thresholds, children, leaves = [], [], [], 0
    root, todo = -1, [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        me = None
        if len(rows) > leaf:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            way = a - b
            length = np.linalg.norm(way)
            if length > 0 and np.isfinite(length):
                along = sample[rows] @ (way / length)
                middle = np.median(along)
                above = along > middle
                if above.any():
                    me = len(directions)
                    directions.append(way / length)
                    thresholds.append(middle)
                    children.append([0, 0])
                    todo += [(rows[~above], me, 0), (rows[above], me, 1)]
        if me is None:
            leaves += 1
            me = -leaves
        if parent < 0:
            root = me
        else:
            children[parent][side] = me
    width = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), root, leaves)


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.full(len(vectors), tree.root, np.int64)
    while len(inner := np.flatnonzero(at >= 0)):
        node = at[inner]
        above = np.einsum("ij,ij->i", vectors[inner], tree.directions[node]) > tree.thresholds[node]
        at[inner] = tree.children[node, above.astype(np.int64)]
    return -1 - at


def search(forest: Forest, query: np.ndarray, enough: float) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in order of their bounds, through one queue, until the leaves hold ``enough`` vectors.

    A vector is in a leaf of every tree, so leaves of several trees may hold it twice; as what matters is how many
    different ones are seen, a leaf counts with the share of its vectors that leaves seen before are likely not to hold.
    """
    margins = [t.directions @ query - t.thresholds for t in forest.trees]
    aside = [np.abs(m) for m in margins]
    queue = [(0.0, i, t.root) for i, t in enumerate(forest.trees)]
    heapq.heapify(queue)
    total = float(forest.sizes[0].sum())
    held, seen = [0.0] * len(forest.trees), 0.0
    while queue and seen < enough:
        bound, i, node = heapq.heappop(queue)
        children, m, a = forest.trees[i].children, margins[i], aside[i]
        while node >= 0:
            side = int(m[node] > 0)
            heapq.heappush(queue, (max(bound, float(a[node])), i, int(children[node, 1 - side])))
            node = int(children[node, side])
        held[i] += float(forest.sizes[i][-1 - node])
        unseen = 1.0
        for h in held:
            unseen *= 1.0 - h / total
        seen = total * (1.0 - unseen)
        yield i, -1 - node


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, places of vectors that may be among its k nearest (all ties), and exact distances: flat rows (query, place), distance."""
    rough = np.einsum("ij,ij->i", vectors, vectors)[None, :] - 2 * (queries @ vectors.T)
    if vectors.shape[0] > k and np.isfinite(rough).all():
        own = np.einsum("ij,ij->i", queries, queries)[:, None]
        top = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
        slack = 1e-9 * (np.abs(rough).max(axis=1, keepdims=True) + own)  # more than the product can be off
        q, v = np.nonzero(rough <= top + slack)
    else:
        q, v = (x.ravel() for x in np.indices(rough.shape))
    gap = vectors[v] - queries[q]
    return np.stack([q, v]), np.sqrt(np.einsum("ij,ij->i", gap, gap))


def fit(sample: np.ndarray, *, trees: int, leaf: int, k: int, recall: float, tested: int, seed: int = 7) -> Forest:
    """A forest of the sample, and the least share of vectors (in steps) that finds ``recall`` of the k nearest in it."""
    rng = np.random.default_rng(seed)
    forest = Forest([grow(sample, leaf, rng) for _ in range(trees)])
    at = [leaves_of(t, sample) for t in forest.trees]
    forest.sizes = [np.bincount(x, minlength=t.leaves) for x, t in zip(at, forest.trees, strict=True)]
    own = rng.permutation(len(sample))[:tested]
    shares = [0.005 * 1.25**i for i in range(24)]
    found, true = np.zeros(len(shares)), 0
    for begin in range(0, len(own), 64):
        some = own[begin : begin + 64]
        gap = np.einsum("ij,ij->i", sample, sample)[None, :] - 2 * (sample[some] @ sample.T)
        gap[np.arange(len(some)), some] = np.inf
        for row, q in zip(gap, some, strict=True):
            near = np.argpartition(row, min(k, len(row) - 1))[:k] if len(row) > k else np.flatnonzero(np.isfinite(row))
            true += len(near)
            step = 0
            hit, weight = np.zeros(len(near), bool), [0.0] * trees
            for i, leaf_ in search(forest, sample[q], len(sample)):
                hit |= at[i][near] == leaf_
                weight[i] += forest.sizes[i][leaf_] / len(sample)
                seen = 1.0 - math.prod(1.0 - w for w in weight)
                while step < len(shares) and seen >= shares[step]:
                    found[step] += hit.sum()
                    step += 1
            found[step:] += len(near)
    good = [s for s, f in zip(shares, found, strict=True) if f >= recall * true]
    forest.share = min(1.0, good[0]) if good else 1.0
    return forest


def usable(vector: Column) -> Column:
    """Whether a vector can take part: components, all finite, and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, width)


def _dealt(forest: Forest, part: int) -> list[np.ndarray]:
    """Into how many parts each leaf is dealt."""
    return [np.maximum(1, -(-s // part)) for s in forest.sizes]


def nearest_neighbours(
    rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", *, k: int = 10, trees: int = 4, leaf: int = 96, most: int = 16384, recall: float = 0.98, tested: int = 192, least: int = 1024, part: int = 4096,
) -> DataFrame:
    """(query, rank, key, score) of the k nearest found of each row for which ``asked`` holds, its own id left out.

    The forest is fitted on ``most`` different vectors at most, those of least hash, and four million
    components (documented bound; they go to the driver); ``recall`` is the share of true neighbours that it must find in them.  Searches go on to ``least`` vectors at
    least, so small tables are searched whole.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(key).alias("id"), F.col(vector).alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    width = given.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kind, form = rows.schema[key].dataType.simpleString(), rows.schema[vector].dataType.simpleString()
    if width is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    width = width.n
    ids = materialise(given.where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec"), F.max("asked").alias("asked")), "vectors")
    held = ids.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    points = materialise(held.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points")
    sample = points.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(min(most, max(256, 4_000_000 // width))).select("vec").toArrow().column("vec")
    forest = fit(_matrix(sample, width), trees=trees, leaf=leaf, k=k, recall=recall, tested=tested)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), width)
            for i, tree in enumerate(forest.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(leaves_of(tree, x).astype(np.int32)), b.column("vec"), b.column("ids")], ["tree", "leaf", "vec", "ids"])

    routed = points.mapInArrow(route, f"tree int, leaf int, vec {form}, ids array<{kind}>")
    forest.sizes = [np.zeros(t.leaves, np.int64) for t in forest.trees]
    for i, at, n in routed.groupBy("tree", "leaf").count().toLocalIterator():  # a row for each leaf of the sample's forest
        forest.sizes[i][at] = n
    total = int(forest.sizes[0].sum())
    enough, dealt = min(total, max(least, forest.share * total)), _dealt(forest, part)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 64):
                some = b.slice(begin, 64)
                at, where, leaf_, piece = [], [], [], []
                for n, q in enumerate(_matrix(some.column("vec"), width)):
                    for i, to in search(forest, q, enough):
                        for p in range(int(dealt[i][to])):
                            at.append(n)
                            where.append(i)
                            leaf_.append(to)
                            piece.append(p)
                took = some.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(leaf_, pa.int32()), pa.array(piece, pa.int32()), took.column("vec"), took.column("name")], ["tree", "leaf", "part", "vec", "name"])

    name = F.unhex(F.sha2(F.to_json(F.struct("vec")), 256))
    queries = ids.where("asked").select("vec", name.alias("name")).distinct()
    visits = queries.mapInArrow(visit, f"tree int, leaf int, part int, vec {form}, name binary")

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, at = (np.asarray(b.column(c)) for c in ("tree", "leaf"))
            parts = np.array([dealt[t][x] for t, x in zip(i, at, strict=True)], np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts.astype(np.int32))], [*b.schema.names, "parts"])

    stored = routed.mapInArrow(parts_of, f"tree int, leaf int, vec {form}, ids array<{kind}>, parts int")
    stored = stored.select("tree", "leaf", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int").alias("part"), "vec", F.lit(None).cast("binary").alias("name"), "ids")
    both = stored.unionByName(visits.withColumn("ids", F.lit(None).cast(f"array<{kind}>")))
    where = ["tree", "leaf", "part"]
    met = both.repartition(*where).sortWithinPartitions(*where, F.col("name").isNotNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids_, flat = None, [], [], None
        for b in batches:
            place = np.stack([np.asarray(b.column(c)) for c in where], axis=1)
            kinds = np.asarray(b.column("name").is_valid())
            change = np.flatnonzero((place[1:] != place[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *change], [*change, b.num_rows], strict=True):
                some = b.slice(a, z - a)
                if not some.num_rows:
                    continue
                if tuple(place[a]) != now:
                    now, vectors, ids_, flat = tuple(place[a]), [], [], None
                if not kinds[a]:
                    vectors.append(_matrix(some.column("vec"), width))
                    ids_.append(some.column("ids"))
                    continue
                if not vectors:
                    continue
                if flat is None:
                    flat, names = np.concatenate(vectors), pa.chunked_array(ids_).combine_chunks()
                asking = _matrix(some.column("vec"), width)
                for begin in range(0, len(asking), 256):
                    (q, v), gap = nearest(asking[begin : begin + 256], flat, k + 1)
                    yield pa.RecordBatch.from_arrays([some.column("name").take(pa.array(q + begin)), names.take(pa.array(v)), pa.array(gap)], ["name", "ids", "score"])

    found = met.mapInArrow(meet, f"name binary, ids array<{kind}>, score double").select("name", F.explode("ids").alias("id"), "score")
    near = Window.partitionBy("name").orderBy("score", "id")
    found = found.withColumn("r", F.dense_rank().over(near)).where(F.col("r") <= k + 1).groupBy("name").agg(F.array_sort(F.collect_set(F.struct("score", "id"))).alias("near"))
    answers = ids.where("asked").select(F.col("id").alias("query_id"), name.alias("name")).join(materialise(found, "found"), "name")
    own = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    out = answers.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "x"))
    discard(points)
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias(key), F.col("x.score").alias("score"))
