"""Operators 11 to 13 against plain versions, on the queries' tables and on awkward rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import projection_forest, queries, turn_repair, word_runs

NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# -- 11


def cheapest(rows, faults):
    """(cost, audit, lines) by a search over prefixes, least cost and then least audit first."""
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        due = {"s": "" == state, "u": state != "u", "a": state == "u"}
        for name in ("user", "assistant"):
            if due[name[0]]:
                heapq.heappush(queue, (cost + 5, audit + "I", i, name[0], (*lines, name + ":")))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 * (faults[i] == "truncated")
        if due.get(role[:1]):
            heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
        for name in ("user", "assistant"):
            if due[name[0]]:
                heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, name[0], (*lines, f"{name}:{text}")))


def repaired(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        which = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(which, text)
        chats[conv] += [(turn is not None, turn or 0, "user" if which == 4 else role, text)] * {0: 0, 3: 2}.get(which, 1)
    out = {}
    for conv, some in chats.items():
        some.sort()
        seen, faults = set(), []
        for *_, role, text in some:
            faults.append("blank" if not NOT_BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if NOT_BLANK.findall(text)[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for known, t, *_ in some if known]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:], strict=False))
        cost, audit, lines = cheapest([x[2:] for x in some], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines
    return out


def test_op11(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_turn_repair(spark, sf).collect()}
    assert got == {c: x for c, (x, _) in repaired(rows).items()}


CHATS = "conv_id long, turn long, role string, text string, block int, place string, copies int, conv long"


def awkward_chats():
    r = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for t in range(r.randrange(1, 25) if conv != 7 else 400):
            strange = r.random() < 0.5
            role = r.choice(["system", "user", "assistant", "tool", "", None]) if strange else ("user", "assistant")[t % 2]
            text = r.choice(["a.", "b", "  ", None, "c!", "d? \t", "x", "e\u0000."]) if r.random() < 0.5 else f"t{r.random()}."
            rows.append((conv, None if r.random() < 0.05 else t + (3 if r.random() < 0.02 else 0), role, text))
    return rows + r.sample(rows, 100) + [rows[-1]] * 40


@pytest.mark.parametrize("per_block", [100_000, 17])
def test_conversations_over_blocks(spark, per_block):
    rows = awkward_chats()
    want = repaired(rows)
    damaged = turn_repair.damaged(spark.createDataFrame([(*x, 1, "p", 9, 3) for x in rows], CHATS))
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(damaged, copies="copies", per_block=per_block, digest=True).collect()}
    assert got == {c: x for c, (x, _) in want.items()}
    lines = defaultdict(list)
    for r in turn_repair.repair(damaged, copies="copies", per_block=per_block).orderBy("place", "step").collect():
        assert (r.turn is None or r.edit != "I") and r.edit in "KRI"
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: tuple(lines[c]) for c in want} == {c: x for c, (_, x) in want.items()}


def test_conversations_without_rows(spark):
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df = spark.createDataFrame([(1, 5, "user", "x.", 0), (2, None, "user", None, 1)], "conv_id long, turn int, role string, text string, n int")
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(df, copies="n", digest=True).collect()}
    assert got == {1: empty, 2: (0, 1, 0, 0, 0, 2, "D", empty[-1])}
    assert turn_repair.repair(df.limit(0), digest=True).count() == turn_repair.repair(df.limit(0)).count() == 0


# -- 12


def true_neighbours(rows, k=10):
    """Of each id divisible by 100: its k nearest (distance, id)."""
    width = max((len(v) for _, v in rows if v), key=[len(v) for _, v in rows if v].count, default=0)
    points = {}
    for i, v in rows:
        if i is not None and v and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v):
            points[i] = min(points.get(i, v), v)
    ids, x = list(points), np.array(list(points.values()), np.float64).reshape(len(points), -1)
    return {q: sorted((float(d), i) for d, i in zip(np.sqrt(((x - np.array(points[q])) ** 2).sum(axis=1)), ids, strict=True) if i != q)[:k] for q in ids if q % 100 == 0}


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def recall_of(got, want):
    return sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))


def test_op12(spark, sf):
    got = answers(queries.op12_projection_forest(spark, sf))
    want = true_neighbours([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])
    assert set(got) == set(want) and recall_of(got, want) >= 0.9


def test_forest_searches_part_of_the_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=24)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(projection_forest.nearest_neighbours(df, F.col("vec_id") % 100 == 0, least=100, part=64)), true_neighbours(rows)
    assert recall_of(got, want) >= 0.9
    assert all(abs(s - dict((i, d) for d, i in want[q]).get(i, s)) < 1e-12 for q in got for s, i in got[q])
    sample = np.array([v for _, v in rows[:3000]])
    forest = projection_forest.fit(sample, trees=4, leaf=64, k=10, recall=0.98, tested=50)
    assert forest.share < 0.4
    # of 24 random directions, more must be searched
    assert projection_forest.fit(rng.normal(size=(3000, 24)), trees=4, leaf=64, k=10, recall=0.98, tested=50).share > forest.share


def test_forest_on_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(700)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1000, 1300)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 4), (2300, [1.0, None, 1.0, 1.0]), (2400, [float("nan")] * 4), (2500, [float("inf"), 0.0, 0.0, 0.0]), (2600, [1.0] * 5), (None, [1.0] * 4)]
    rows += [(100, rows[100][1])] * 30 + [(200, [9.0] * 4), (300, [-0.0, 0.0, 0.0, 1e-300])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<double>, tree int, name string")
    got, want = answers(projection_forest.nearest_neighbours(df, F.col("vec_id") % 100 == 0)), true_neighbours(rows)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    few = answers(projection_forest.nearest_neighbours(df.where("vec_id in (100, 7, 8)"), F.col("vec_id") % 100 == 0))
    assert {q: len(x) for q, x in few.items()} == {100: 2}
    assert projection_forest.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert projection_forest.nearest_neighbours(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


# -- 13


def plain_runs(x, exponent, length):
    """All runs, by walking along each period; a stretch counts with its smallest one."""
    out = {}
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(exponent * p, length):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((a, b, p) for (a, b), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_ones():
    r = random.Random(3)
    for _ in range(1500):
        x = [r.randrange(r.choice([1, 2, 3, 5, 30])) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            a, p = r.randrange(len(x) + 1), r.randrange(1, 8)
            x[a:a] = (x[a : a + p] * 30)[: r.randrange(1, 30)]
        for exponent, length in ((2, 2), (2, 5), (3, 2), (3, 5), (4, 6)):
            want = plain_runs(x, exponent, length)
            assert word_runs.runs(x, exponent, length) == want
            assert word_runs.runs_of_words([str(c) for c in x], exponent, length) == want
    assert word_runs.runs([0] * 5000, 4, 6) == [(0, 5000, 1)]
    assert word_runs.runs([i % 999 for i in range(5000)], 4, 6) == [(0, 5000, 999)]


def test_factors_start_earlier():
    r = random.Random(4)
    for _ in range(300):
        x = [r.randrange(3) for _ in range(r.randrange(40))]
        at = 0
        for s, shift in word_runs.factors(x):
            assert s == at
            longest = max((next((k for k in range(len(x) - s) if x[s + k] != x[j + k]), len(x) - s) for j in range(s)), default=0)
            at += max(longest, 1)
            assert bool(shift) == (longest > 0) and x[s:at] == x[s - shift : at - shift or None][: at - s]
        assert at == len(x)


def of_document(key, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 4, 6)
    dropped = {i for a, b, p in found for i in range(a + p, b)}
    longest = min(((-(b - a), a, p) for a, b, p in found), default=None)
    figures = (longest[1], -longest[0], longest[2], 1000 * -longest[0] // longest[2]) if longest else (None,) * 4
    texts = "".join(f"{a},{b - a},{p}\n" for a, b, p in found), " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(found), *figures, *(hashlib.sha256(t.encode()).hexdigest() for t in texts))


def test_op13(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 20_000]  # the plain version takes a time that grows with the square
    got = {r[0]: tuple(r) for r in queries.op13_word_runs(spark, sf).collect()}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert [got[i] for i, _ in short] == [of_document(i, t) for i, t in short]


def test_runs_of_awkward_texts(spark):
    rows = [(1, "a b " * 9 + "c"), (2, None), (None, "x " * 50), (3, ""), (4, "  z z " * 8), (1, "a b " * 9 + "c"), (5, " ".join(f"w{i % 700}" for i in range(6000))), (6, "don't a\u0000b a\u0000c " * 6), (11, "one")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, runs int, key string")
    got = map(tuple, word_runs.collapse_runs(df, change=queries.recurring, digest=True).drop("n_words").collect())
    assert sorted(got, key=str) == sorted((of_document(*r) for r in rows), key=str)
    whole = {r.doc_id: r for r in word_runs.collapse_runs(df).collect()}
    assert [tuple(x) for x in whole[1].runs] == [(0, 18, 2)] and whole[1].collapsed == "a b c" and whole[None].collapsed == "x" and whole[2].collapsed == ""
    assert word_runs.collapse_runs(df.limit(0)).count() == 0
