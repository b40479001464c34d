"""Windowed classification of tokens against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clausewright.operators import layout as L

COLUMNS = "doc_id string, page_id int, pos int, text string, box array<int>, window int, tag string"


def make_model():
    """Tags that depend on what else is in the window; silent about texts with x."""
    return lambda windows: [[None if "x" in t else f"{i}/{len(w)}:{w[0][0]}" for i, (t, _) in enumerate(w)] for w in windows]


def plain(tokens, size, stride, compat):
    """(doc, page, pos) -> tag."""
    pages = defaultdict(list)
    for t in tokens:
        pages[t[0], t[1]].append(t)
    out = {}
    for page, some in pages.items():
        some.sort(key=lambda t: (t[2], t[3], t[4]))
        starts, at = [], 0
        for t in some:
            starts.append(at)
            at += len(t[3])
        found, begin, number = {}, 0, 0
        while True:
            inside = [i for i, s in enumerate(starts) if begin <= s < begin + size]
            tags = make_model()([[(some[i][3], some[i][4]) for i in inside]])[0]
            for j, (i, tag) in enumerate(zip(inside, tags, strict=True)):
                if tag is None:
                    continue
                if compat:
                    found[tuple(some[i][4])] = tag
                else:
                    room = min(j, len(inside) - 1 - j)
                    if some[i][2] not in found or room > found[some[i][2]][0]:
                        found[some[i][2]] = (room, tag)
            if begin + size >= at:
                break
            begin, number = begin + size - stride, number + 1
        for t in some:
            got = found.get(tuple(t[4]) if compat else t[2])
            if got is not None:
                out[(*page, t[2])] = got if compat else got[1]
    return out


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize(("size", "stride"), [(12, 4), (7, 0), (512, 128)])
def test_windows_equal_a_plain_loop(spark, size, stride, compat):
    rnd = random.Random(size)
    rows = [(d, p, i, "".join(rnd.choices("abx", k=rnd.randrange(1, 5))), [rnd.randrange(9), i // 2, 9, 9], 1, "old") for d, p, n in (("a", 1, 60), ("a", 2, 1), (None, 1, 30), ("b", None, 13), ("long", 1, 900)) for i in range(n)]
    df = spark.createDataFrame(rows, COLUMNS)
    found = L.classify_windows(df, make_model, pieces=F.length("text"), size=size, stride=stride, batch=3, compat=compat)
    assert found.columns == [c for c in df.columns if c != "tag"] + ["tag"]
    got = {(r.doc_id, r.page_id, r.pos): r.tag for r in found.collect()}
    assert got == plain(rows, size, stride, compat) and len(got) < len(rows)


def test_windows_are_dealt_and_models_made_once_a_task(spark):
    rows = [("d", 1, i, "a", [i, 0, i, 0], 1, None) for i in range(4000)]
    df = spark.createDataFrame(rows, COLUMNS)
    windows = L.token_windows(df, F.lit(1), size=100, stride=20)
    sizes = [len(r["items"]) for r in windows.orderBy("window").collect()]
    assert sizes == [100] * 49 + [80] and max(sizes) == 100

    def made():
        import os

        name = f"{os.getpid()}-{random.random()}"
        return lambda ws: [[name] * len(w) for w in ws]

    tags = L.classify_windows(df, made, size=100, stride=20).groupBy("tag").count().collect()
    assert sum(r["count"] for r in tags) == 4000 and 1 < len(tags) <= 8
    assert L.classify_windows(df.limit(0), made).count() == 0
    with pytest.raises(Exception, match="for every token"):
        L.classify_windows(df, lambda: lambda ws: [[] for _ in ws]).count()
