"""The ten operators against brute force, on the queries' tables and on awkward rows."""

import base64
import bisect
import hashlib
import io
import math
import random
import re
import time
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from clausewright.llm import chat_events, chunked_media, credential_links, curve_packing, dart_minhash, line_cleaning, queries, rule_ensemble, suffix_dedup, warc_zip
from clausewright.llm.bpe_monoid import BpeTree, encode_column
from clausewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 97} x{i}" for i in range(9000))
SHARED = "This passage of text is repeated in several documents and is longer than one hundred bytes, so that it must go. "
#: Nulls, empty and very long texts, repeated rows, ties, and columns that clash with the operators' own names.
AWKWARD = [
    (1, "alpha beta gamma delta epsilon. " * 4 + SHARED), (2, None), (2, None), (None, "no key here at all, but words enough to make shingles"), (3, ""), (4, LONG), (5, LONG), (6, SHARED + "é" * 60 + SHARED),
    (7, "x"), (7, "y"), (8, "AKIA" + "B" * 16 + " password = hunter22 " + "deadbeef" * 4), (9, "short\n\nshort\n \t\n"), (10, "　wide 日本語 text 🙂 " * 5), (None, None),
]
COLUMNS = "doc_id long, text string, key string, copy int, node string, salt int, place long, row string, ids int, score string, n_words int"


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame([(*r, *("k", 1, "n", 2, 3, "r", 4, "s", 5)) for r in rows], COLUMNS)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# -- 1


def check_pages(rows, pages):
    first = {}
    for i, h in sorted(((i, h) for i, h in pages if i is not None), key=lambda x: x[0]):
        first.setdefault(h or "", i)
    want = Counter()
    for i, h in pages:
        raw, lead = (h or "").encode(), first.get(h or "")
        again = lead is not None and lead != i
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", lead if again else None)] += 1
    assert Counter(map(tuple, rows)) == want


def test_op1(spark, sf):
    check_pages(queries.op1_warc_zip(spark, sf).collect(), [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()])
    named = spark.createDataFrame([("a\r\nWARC-Type: x %41", "u", "p"), ("é: b", "u", "p"), (" c ", None, None)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc_zip.archive_round_trip(named).collect()} == {(" c ", None), ("a\r\nWARC-Type: x %41", None), ("é: b", "a\r\nWARC-Type: x %41")}
    pages = [(3, "same"), (1, "same"), (1, "same"), (2, None), (4, ""), (None, "same"), (5, "x\r\n\r\ny" * 9000), (6, "é🙂")]
    df = spark.createDataFrame([(i, None if i == 2 else "http://h/\r\nX: y", h, "z") for i, h in pages], "page_id long, url string, html string, digest string")
    back = warc_zip.archive_round_trip(df, payloads=True)
    check_pages(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), pages)
    assert {r.payload for r in back.where("page_id = 6").collect()} == {"é🙂".encode()}
    assert warc_zip.archive_round_trip(df.limit(0)).count() == 0


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open(warc_zip.DATA, "w", force_zip64=True) as f:
            f.write(b"abc")
        z.comment = b"a comment"
    data = raw.getvalue()

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    local, size, method = warc_zip.directory(File(), len(data))[warc_zip.DATA]
    at = warc_zip.data_offset(File(), local)
    assert (data[at : at + size], method) == (b"abc", 0)
    # the same archive with a ZIP64 end record in front of the old one
    end = data.rindex(warc_zip.EOCD)
    n, size_, offset = (int.from_bytes(data[end + a : end + b], "little") for a, b in ((10, 12), (12, 16), (16, 20)))
    wide = warc_zip.EOCD64 + (44).to_bytes(8, "little") + bytes(12) + n.to_bytes(8, "little") * 2 + size_.to_bytes(8, "little") + offset.to_bytes(8, "little")
    locator = warc_zip.EOCD64_LOCATOR + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    data = data[:end] + wide + locator + warc_zip.EOCD + bytes(4) + b"\xff" * 12 + bytes(2)
    assert list(warc_zip.directory(File(), len(data))) == [warc_zip.DATA]
    with pytest.raises(ValueError, match="not a ZIP"):
        data = b"x" * 100
        warc_zip.directory(File(), 100)


# -- 2


def padded(text):
    raw = (text or "").encode()
    return raw, raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def test_op2(spark, sf):
    want = texts(spark, sf)
    for r in queries.op2_chunked_media(spark, sf).collect():
        raw, p = padded(want[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        media = f"P5\n576 {len(p) // 576}\n255\n".encode() + p
        mean = sum(p) / len(p)
        counts = Counter(b >> 4 for b in p)
        feature = [round(mean * 100), round(math.sqrt(sum((b - mean) ** 2 * n for b, n in Counter(p).items()) / len(p)) * 100), *(counts[i] for i in range(16))]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert all(abs(int(x) - y) <= 1 for x, y in zip(r.feature.split(","), feature, strict=True))
    got = chunked_media.media_column(awkward(spark), least=64, average=256, most=1024).collect()
    assert Counter((r.doc_id, r.payload_sha256) for r in got) == Counter((i, hashlib.sha256(padded(t)[1]).hexdigest()) for i, t in AWKWARD)
    assert chunked_media.media_column(awkward(spark, [])).count() == 0


def test_chunks_follow_content():
    data = random.Random(1).randbytes(60_000)

    def cut(d):
        ends = chunked_media.cut_points(d, least=256, average=1024, most=8192)
        return [d[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    assert b"".join(cut(data)) == data
    a, b = set(cut(data)), set(cut(data[:20_000] + b"inserted" + data[20_000:]))
    assert len(a - b) <= 3 and len(a) > 20
    h = chunked_media.gear_hashes(np.frombuffer(data[:500], np.uint8))
    slow = 0
    for i in range(500):
        slow = ((slow << 1) + int(chunked_media.GEAR[data[i]])) & 0xFFFFFFFF
        assert i < 31 or slow == int(h[i])


def test_compaction_keeps_chosen_chunks(spark, tmp_path):
    df = awkward(spark).repartition(4)
    recipes = chunked_media.write_chunks(df, "doc_id", "text", f"file://{tmp_path}/a", least=64, average=256, most=1024).cache()
    places = recipes.selectExpr("explode(chunks) c").select("c.digest").distinct().count()
    assert chunked_media.compact(recipes, f"file://{tmp_path}/a", f"file://{tmp_path}/b").count() == places


# -- 3


def check_pieces(rows, docs, length=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, ids.tobytes())] += 1
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[(r.doc_id, r.doc_tokens)].append((r.start, bytes(r.ids)))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    for (i, n), p in parts.items():
        same = [k for k in want if k[0] == i and len(k[1]) == 4 * n]
        assert sum(len(x) for _, x in p) == 4 * n * sum(want[k] for k in same)
        if sum(want[k] for k in same) == 1:
            assert b"".join(x for _, x in sorted(p)) == same[0][1]


def test_op3(spark, sf):
    path = P.path("word_bpe_49k.json")
    check_pieces(curve_packing.curve_packed(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer=path).collect(), list(texts(spark, sf).items()))
    check_pieces(curve_packing.curve_packed(awkward(spark), tokenizer=path, length=256).collect(), AWKWARD, 256)
    assert curve_packing.curve_packed(awkward(spark, []), tokenizer=path).count() == 0


def test_ranked_tokens_are_the_files_own():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, fast = Tokenizer.from_file(path), curve_packing.RankedTokenizer(path)
    rnd = random.Random(3)
    cases = ["".join(rnd.choice(a) for _ in range(40)) for a in ("abAB é,. \n1'²\x85\xa0\x1c!!?", "".join(map(chr, range(256))), "ΑΣ σ日本 aé'") for _ in range(300)]
    special = ["hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|>", "日本 <|endoftext|> x", "don't<|startoftext|>", "<|ENDOFTEXT|> é", "<|endoftext|", "x <|endoftext|><|endoftext|>\n."]
    assert fast(special[:1], 1)[0].tolist().count(49407) == 1
    for c in [*cases, *special, "", " ", "\x01", "don't \x01 a\x01b"]:
        assert list(fast([c], 1)[0]) == t.encode(c, add_special_tokens=False).ids + [1]


def test_tokens_of_odd_strings():
    """Control characters, NUL, a dotted capital I, combining marks, the file's own tokens: one by one, and many in a call."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t, fast, slow = Tokenizer.from_file(path), curve_packing.RankedTokenizer(path), curve_packing.CachedTokenizer(path)
    rnd = random.Random(9)
    odd = ["\x00", "\x01", "\x1f", "\x7f", "İ", "ı", "İ.", "İ,", "I\u0307", "é", "e\u0301", "\u0301", "\u0307", "a", "B", "'", "don't", "<|endoftext|>", "<|startoftext|>", "<|", " ", " ", "\n", "\t", ",", ".", "1", "ß", "ǅ", "ŉ", "日", "\u200d", "\xa0", "\u2003"]
    cases = ["don't a\x00b a", "é İ. x", "a\x00b a\x00c a a\x00", "İ, İ. İ", *("".join(rnd.choices(odd, k=rnd.randrange(1, 14))) for _ in range(4000))]
    want = [t.encode(c, add_special_tokens=False).ids + [1] for c in cases]
    for one in (fast, slow):
        ids, sizes = one(cases, 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert [fast([c], 1)[0].tolist() for c in cases] == want


def test_hilbert_curve_is_a_walk():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = curve_packing.hilbert_keys(cells, 3)
    path = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# -- 4


def shingle_weights(text):
    w = WORD.findall(text or "")
    n = Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))
    return {s: 1 + math.log(c) for s, c in n.items()}


def weighted_similarity(a, b):
    common = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(docs, similarity=0.8):
    """Least key of the component of each document, by comparing all pairs that share a shingle."""
    names, where = list(docs), defaultdict(list)
    sets = {d: shingle_weights(t) for d, t in docs.items()}
    parent = {d: d for d in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in names:
        for s in sets[d] or [None]:
            where[s].append(d)
    pairs = {(a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        if not sets[a] and not sets[b] or weighted_similarity(sets[a], sets[b]) >= similarity - 1e-7:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: find(d) for d in names}


def near_group(n=60, words=60, seed=5):
    """Copies of a text with some words changed: some are near each other, some aren't."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            w[rnd.randrange(words)] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_op4(spark, sf):
    want = classes(texts(spark, sf))
    assert {r.doc_id: r.class_id for r in queries.op4_dart_minhash(spark, sf).collect()} == want


def test_op4_groups_and_awkward_rows(spark):
    docs = dict(enumerate(near_group(), 100)) | {i: t for i, t in AWKWARD if i is not None and i != 7}
    rows = [*docs.items(), (2, None), (9001, "  \n "), (7, "one text under key seven"), (7, "another text under key seven"), (None, "only one of its kind without key"), (None, docs[100])]
    want = classes(docs | {9001: ""})
    found = [dart_minhash.near_classes(awkward(spark, rows), deviations=d).collect() for d in (6.0, None)]
    for got in found:
        assert {(r.doc_id, r.class_id) for r in got if r.doc_id not in (None, 7)} == set(want.items())
        assert len(got) == len(rows) and sorted(r.class_id == want[100] for r in got if r.doc_id is None) == [False, True]
        assert [(r.class_id, r.copies, r.kept) for r in got if r.doc_id == 7] == [(7, 1, True)] * 2
        assert all((r.links > 0) == (r.copies < sum(x.class_id == r.class_id for x in got)) for r in got if r.doc_id != 7)
    kept = dart_minhash.one_of_each(awkward(spark, rows))
    back = kept.collect()
    assert Counter(r.doc_id for r in back) == Counter([*set(want.values()), 7, 7, None]) and kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert {r.text for r in back if r.doc_id == 7} == {"one text under key seven", "another text under key seven"}
    assert dart_minhash.near_classes(awkward(spark, [])).count() == 0 and dart_minhash.one_of_each(awkward(spark, [])).count() == 0


def test_op4_blocks(spark):
    """With tiny blocks every bucket is compared block by block, whatever its roots."""
    docs = dict(enumerate(near_group(90, 40, seed=8), 1))
    w = {d: shingle_weights(t) for d, t in docs.items()}
    keys = {s: mixed for mixed, s in enumerate(sorted(set().union(*w.values())))}
    rows = [(d, *map(list, zip(*sorted((keys[s], x) for s, x in ws.items()), strict=True)), b"\0\0" * 8) for d, ws in w.items()]
    sets = spark.createDataFrame(rows, "node long, s array<long>, w array<float>, marks binary")
    for roots in (lambda d: d, lambda d: d % 3, lambda d: 0 if d < 60 else d):
        at = spark.createDataFrame([(b, d, roots(d)) for d in docs for b in (5, 6)], "bucket long, node long, root long")
        links = [tuple(r) for r in dart_minhash.links_in_blocks(at, sets, similarity=0.8, k=8, deviations=None, members=7).collect()]
        assert all(weighted_similarity(w[a], w[b]) >= 0.8 - 1e-6 and roots(a) != roots(b) for a, b in links)
        parts = []
        for pairs in (links, [(a, b) for a in docs for b in docs if a < b and roots(a) != roots(b) and weighted_similarity(w[a], w[b]) >= 0.8 - 1e-9]):
            parent = {roots(d): roots(d) for d in docs}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                x, y = sorted((find(roots(a)), find(roots(b))))
                parent[y] = x
            parts.append({d: find(roots(d)) for d in docs})
        assert parts[0] == parts[1]


def test_op4_recall(spark):
    """All pairs of planted texts that reach the threshold, by brute force, end in one class."""
    rnd, docs = random.Random(11), {}
    for g in range(150):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([60, 120, 400]))]
        for _ in range(4):
            w = list(base)
            for _ in range(max(1, int(len(base) * rnd.choice([0.005, 0.01, 0.012])))):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
            docs[len(docs)] = " ".join(w)
    sets = {d: shingle_weights(t) for d, t in docs.items()}
    pairs = [(a, b) for a in docs for b in range(a // 4 * 4, a) if weighted_similarity(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert len(pairs) > 300 and sum(got[a] == got[b] for a, b in pairs) >= 0.999 * len(pairs) and got == classes(docs)


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(0, 2**63, 300).astype(np.uint64)
    h = np.concatenate([np.sort(pool[:200]), np.sort(pool[50:250])])
    doc = np.repeat([0, 1], 200)
    for weight in (np.ones(400), rnd.integers(1, 5, 400).astype(float), rnd.random(400) * 3 + 0.05, 1 + np.log(rnd.integers(1, 9, 400))):
        table = dart_minhash.signatures(h, weight, doc, 2, 4096)
        want = weighted_similarity(*(dict(zip(h[doc == d].tolist(), weight[doc == d].tolist(), strict=True)) for d in (0, 1)))
        assert abs((table[0] == table[1]).mean() - want) < 0.04 and (table != dart_minhash.NONE).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(30, 31), (31, 30), (40, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(21)} | {30: 30, 31: 30}
    for fits in (10**6, 0):  # in one task, and contracted over the cluster
        assert {r.node: r.root for r in components(df, fits=fits).collect()} == want


def test_components_that_go_on_changing_are_an_error(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        components(df, fits=0, rounds=1)


# -- 5


def without_repeats(docs, length=100):
    """docs in order: (text) -> removed, spans, kept digest."""
    seen, out = set(), []
    for text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        new = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        for i, s in enumerate(new):
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_op5(spark, sf):
    docs = texts(spark, sf)
    order = sorted(docs)
    want = dict(zip(order, without_repeats([docs[i] for i in order]), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op5_suffix_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("kind", ["string", "decimal(20,1)"])
def test_op5_keys_of_other_kinds(spark, kind):
    rows = [("10", SHARED + "ten"), ("9", SHARED + "nine"), ("100", "short " + SHARED), (None, SHARED), ("9.5", "y" * 300)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr(f"cast(doc_id as {kind}) AS doc_id", "text")
    order = sorted(rows[:3] + rows[4:], key=lambda r: r[0] if kind == "string" else float(r[0])) + rows[3:4]
    got = {r.doc_id if r.doc_id is None or kind == "string" else float(r.doc_id): tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, digest=True).collect()}
    assert got == {k if k is None or kind == "string" else float(k): x for (k, _), x in zip(order, without_repeats([t for _, t in order]), strict=True)}


@pytest.mark.parametrize("bucket", [{}, {"chunk": 2, "most": 3}, {"hot": 2}])
def test_op5_awkward_rows(spark, bucket):
    """With tiny buckets every run of suffixes overflows, and with a low bound hot ones go the other way: all are compared across buckets.

    A null key comes last, equal rows are one document, and texts under one key go by a hash of theirs.
    """
    rows = [(i, t) for i, t in AWKWARD if i is not None and i not in (2, 7)] + [(11, "tail " * 60), (12, "z" * 99), (13, "z" * 101), (14, LONG[:3000])]
    same_key = [(7, "x"), (7, "under key seven " * 20), (7, SHARED + "seven " * 30)]
    more = [(2, None), (2, None), (None, "no key " * 40 + SHARED), (14, LONG[:3000])]
    got = Counter((r.doc_id, *tuple(r)[1:]) for r in suffix_dedup.remove_repeats(awkward(spark, [*rows, *same_key, *more]), digest=True, **bucket).collect())
    wanted = []
    for sevens in (same_key, [same_key[0], same_key[2], same_key[1]]):
        order = sorted(rows + sevens[:1], key=lambda x: x[0])
        at = next(i for i, x in enumerate(order) if x[0] == 7)
        order = order[:at] + sevens + order[at + 1 :] + [more[2]]
        want = [(i, *x) for (i, _), x in zip(order, without_repeats([t for _, t in order]), strict=True)]
        wanted.append(Counter([*want, *[(2, *without_repeats([None])[0])] * 2, *[x for x in want if x[0] == 14]]))
    assert got in wanted
    assert suffix_dedup.remove_repeats(awkward(spark, []), digest=True).count() == 0


def test_multikey_classes():
    rnd = np.random.default_rng(0)
    for _ in range(30):
        w, g = rnd.integers(0, 3, (200, 4)).astype(np.uint64), rnd.integers(0, 5, 200)
        names = {}
        want = [names.setdefault((int(g[i]), *map(int, w[i])), len(names)) for i in range(200)]
        got = suffix_dedup.multikey_classes(w, g)
        assert len(set(zip(got.tolist(), want, strict=True))) == len(names) == len(set(got.tolist()))


# -- 6

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    out = [(m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, rx, g, least) in enumerate(BASE) for m in rx.finditer(text or "") if len(m[g]) >= least]
    return [x[2] for x in sorted(out)]


SECRETS = [
    "🙂 token=token:abcdef12 token: secret1 API_KEY = 'abc.def-ghi' apikey:short", "AKIA" + "Z" * 15 + " AKIAAKIA" + "A" * 14, "deadbeef" * 3 + "DEADBEEF" + "0" * 23, "password=a password : \"longenough\"", None, "",
    "key " + "aB3/" * 10 + " near AKIA" + "Q" * 16, "key " + "aB3/" * 10, "see https://example.com/path for more", "https://db.example.com/x password=hunter222", "user=bob " + "x " * 300 + "password=hunter222", "user=bob password=hunter222",
]


def test_op6(spark, sf):
    docs = texts(spark, sf)
    for r in queries.op6_credential_links(spark, sf).collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
    rows = list(enumerate(SECRETS)) + [(0, SECRETS[0]), (None, SECRETS[1])]
    found = credential_links.scan(awkward(spark, rows), carry=("text",)).select("doc_id", "text", credential_links.rendered(F.col("strong")).alias("s"), credential_links.rendered(F.col("linked")).alias("w"), credential_links.redacted(F.col("text"), F.concat("strong", "linked")).alias("clean")).collect()
    assert len(found) == len(rows) and all(r.s == ",".join(base_spans(r.text)) for r in found)
    weak = {r.doc_id: {x.split(":")[0] for x in r.w.split(",") if x} for r in found}
    assert weak[6] == {"key40"} and weak[7] == set() and weak[8] == set() and weak[9] == {"endpoint"} and weak[10] == set() and weak[11] == {"name"}
    assert next(r.clean for r in found if r.doc_id == 11) == "[name] [assign]" and next(r.clean for r in found if r.doc_id == 7) == SECRETS[7]
    assert credential_links.scan(awkward(spark, [])).count() == 0


def test_op6_name_value_lines(spark):
    """Parts that stand directly after '=' and names that end a longer one."""
    key = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY"
    rows = [(1, f"AWS_ACCESS_KEY_ID=AKIA{'Q' * 16}\nAWS_SECRET_ACCESS_KEY={key}\n"), (2, "DB_USER=bob\nDB_PASSWORD=hunter222\n"), (3, f"AWS_SECRET_ACCESS_KEY={key}\n"), (4, "DB_USER=bob\n"), (5, "superuser=bob password=hunter222"), (6, f"AKIA{'Q' * 16} {key}=")]
    found = credential_links.scan(awkward(spark, rows), carry=("text",)).select("doc_id", credential_links.redacted(F.col("text"), F.concat("strong", "linked")).alias("clean")).collect()
    clean = {r.doc_id: r.clean for r in found}
    assert len(key) == 40 and clean[1] == "AWS_ACCESS_KEY_ID=[access]\nAWS_SECRET_ACCESS_KEY=[key40]\n"
    assert clean[2] == "DB_[name]\nDB_[assign]\n" and clean[3] == rows[2][1] and clean[4] == rows[3][1]
    assert clean[5] == "superuser=bob [assign]" and clean[6] == f"[access] {key}="


def test_op6_long_weak_spans(spark):
    """Endpoints and names are reported to the end of their run, so nothing of them is left in the text."""
    rows = [(1, f"https://db.example.com/{'p' * 600} password=hunter222"), (2, f"client_id={'w' * 90} password=hunter222")]
    clean = {r.doc_id: r.clean for r in credential_links.scan(awkward(spark, rows), carry=("text",)).select("doc_id", credential_links.redacted(F.col("text"), F.concat("strong", "linked")).alias("clean")).collect()}
    assert clean == {1: "[endpoint] [assign]", 2: "[name] [assign]"}


def test_op6_dense_texts(spark):
    """Many candidates in one text, in hot bins and far apart: counts, links and redaction by a plain version, in bounded time."""
    rnd = random.Random(4)
    key = lambda: "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjk/+") for _ in range(40))
    parts = [rnd.choice([f"password=hunter{i:05d}", f"user=bob{i}", f"see https://h{i}.example.com/x", f"AKIA{'Q' * 16} {key()}", f" {key()} ", "é🙂 plain words between " * rnd.choice([1, 1, 1, 30])]) for i in range(12000)]
    docs = {1: " ".join(parts), 2: "user=bob " * 5000, 3: "user=bob " * 5000 + "password=hunter222"}
    began = time.time()
    found = credential_links.scan(awkward(spark, list(docs.items())), carry=("text",)).select("doc_id", "strong", "linked", credential_links.redacted(F.col("text"), F.concat("strong", "linked")).alias("clean")).collect()
    assert time.time() - began < 60
    weak_rx = [(k, re.compile(rx, re.ASCII)) for k, rx in credential_links.WEAK]
    for r in found:
        text = docs[r.doc_id]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in sorted(r.strong, key=lambda s: (s.start, s.rank))] == base_spans(text)
        strong = [(s.start, s.end, credential_links.ROLES[s.kind]) for s in r.strong]
        weak = [(m.start(), m.end(), k) for k, rx in weak_rx for m in rx.finditer(text)]
        strong.sort()
        begins = [x[0] for x in strong]
        weak = [w for w in weak if not any(w[0] < e and s < w[1] for s, e, _ in strong[max(0, bisect.bisect(begins, w[0]) - 9) : bisect.bisect(begins, w[1])])]
        every = sorted([*strong, *((s, e, credential_links.ROLES[k]) for s, e, k in weak)])
        ends = [x[0] for x in every]
        near = lambda w: any(role == credential_links.NEEDS[w[2]] and w[0] - e <= 200 and s - w[1] <= 200 for s, e, role in every[bisect.bisect(ends, w[0] - 900) : bisect.bisect(ends, w[1] + 201)])
        want = {w for w in weak if near(w)}
        assert {(s.start, s.end, s.kind) for s in r.linked} == want
        out, at = [], 0
        for s in sorted([*r.strong, *r.linked], key=lambda s: (s.start, s.rank)):
            if s.start >= at:
                out.append(text[at : s.start] + f"[{s.kind}]")
            at = max(at, s.end)
        assert r.clean == "".join(out) + text[at:]
    assert {r.doc_id: len(r.linked) > 0 for r in found} == {1: True, 2: False, 3: True}


def test_op6_is_native(spark, sf):
    plan = queries.op6_credential_links(spark, sf)._jdf.queryExecution().executedPlan().toString() + queries.op9_chat_events(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 7


def test_op7(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_rule_ensemble(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    if good and bad:
        assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad) > 0.9


def test_op7_expression_is_its_rules(spark, sf):
    """The compiled expression against a plain evaluation of the model, rule by rule, over the whole table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules, intercept = rule_ensemble.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stats = {r.doc_id: r for r in docs.select("doc_id", *(c.alias(n) for n, c in rule_ensemble.statistics(F.col("text")).items())).collect()}
    want = {}
    for i, x in stats.items():
        z = intercept + sum(rule.weight for rule in rules if all((x[n] <= cut) == upper for n, upper, cut in rule.bounds))
        want[i] = 1 / (1 + math.exp(-z))
    assert rules and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in queries.op7_rule_ensemble(spark, sf).collect())
    kept = rule_ensemble.scored(docs, (rules, intercept), least=0.3).collect()
    assert {r.doc_id for r in kept} == {i for i, p in want.items() if p >= 0.3} and len(kept[0]) == len(docs.columns) + 1


def test_op7_awkward_rows(spark):
    few = spark.createDataFrame([(1, 1), (1, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = rule_ensemble.train(awkward(spark), few)
    out = rule_ensemble.scored(awkward(spark), model, out="probability")
    assert all(min(abs(r.probability - p) for p in (2 / 3, 1 / 2)) < 1e-9 for r in out.collect()) and out.columns == [*(c.split()[0] for c in COLUMNS.split(", ")), "probability"]
    assert rule_ensemble.scored(awkward(spark, []), model).count() == 0
    x = np.random.default_rng(1).random((400, 2))
    rules, intercept = rule_ensemble.fit(x, ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float), ["a", "b"])
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    p = np.array([r.p for r in df.select(rule_ensemble.compiled(rules, intercept).alias("p")).collect()])
    assert (((p > 0.5) == ((x[:, 0] > 0.5) & (x[:, 1] < 0.7))).mean()) > 0.95


# -- 8


def plain_encoder():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("leaf", "window"), [(3, 4), (17, 8), (1000, 64)])
def test_tree_encodes_as_a_whole(leaf, window):
    tree, plain, rnd = BpeTree(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, leaf, window), plain_encoder(), random.Random(leaf)
    alphabets = ["ab  \n'srelmtd", "aé日本1 !", "x", "abcdefghij", "0123456789", " \n\t", "!?-'", "<|endoftext|>"]
    cases = ["".join(rnd.choice(a) for _ in range(rnd.choice([0, 1, 7, 50, 300]))) for a in alphabets for _ in range(12)]
    cases += ["a" * 3000, "abcdefgh" * 500, "don't've 're" * 40, "1" * 2000, " " * 900 + "x", "'" + "s" * 700, " " + "wörd" * 400, "x" * 300 + " " + "y" * 300, "日本語" * 300, "é" + "̂" * 200]
    for c in cases:
        assert tree.encode(c) == plain.encode_ordinary(c), c[:40]
        assert tree.decode(tree.encode(c), 5).decode() == c


def test_op8(spark, sf):
    plain, docs = plain_encoder(), texts(spark, sf)
    tree, joins = BpeTree(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), []
    join, tree.join = tree.join, lambda *x: joins.append(1) or join(*x)
    assert sum(bool(tree.encode(t)) and bool(joins) and not joins.clear() for t in docs.values()) > 0.8 * len(docs)  # the query's leaves: most texts are joined
    for r in queries.op8_bpe_monoid(spark, sf).collect():
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    make = lambda rows: encode_column(awkward(spark, rows), ranks=P.path("byte_bpe_multi_50k.tiktoken"), pattern=P.PATTERN, leaf=500)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in make(AWKWARD).collect()) == Counter((i, (t or "").encode()) for i, t in AWKWARD)
    assert make([]).count() == 0


# -- 9


def test_op9(spark, sf):
    said = "</s>[INST] ok [/INST]"
    chats = defaultdict(list) | {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        chats[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows = queries.op9_chat_events(spark, sf).collect()
    assert len(rows) == len(chats)
    for r in rows:
        turns = sorted(chats[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256("".join(f"{b}\n{t}\n" for _, b, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op9_log_has_every_kind(spark, sf):
    """The query's own log takes back deltas, edits and regenerates: deltas alone would not give its texts."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    events = chat_events.events_of_turns(rows, delta=16)
    kinds = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
    assert kinds["edit"] + kinds["regenerate"] == rows.count() and min(kinds.values()) > 0 and kinds["delta"] > 2 * rows.count()
    told = Counter((r.conversation, r.role, r.text) for r in chat_events.fold_events(events).collect())
    assert told == Counter((r.conv_id, r.role, r.text or "") for r in rows.collect())


def test_op9_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"[{i}] <s> é~{i}" * (1 + i % 3), "k", 1) for i in range(8000)] + [(2, 0, "assistant", "x" * 50_000, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string, sequence int")
    began = time.time()
    got = {r.conversation: r for r in chat_events.chats(chat_events.events_of_turns(df)).select("conversation", chat_events.read_back(F.col("formatted")).alias("turns"), chat_events.under_mask(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert time.time() - began < 60
    for c in (1, 2):
        assert [tuple(t) for t in got[c].turns] == [(x[2], x[3]) for x in rows if x[0] == c]
        assert got[c].loss == "".join(x[3] for x in rows if x[0] == c and x[2] == "assistant")


def test_op9_events(spark):
    log = [("c", 1, 0, "delta", "user", "he"), ("c", 1, 1, "delta", "user", "llo"), ("c", 2, 2, "delta", "assistant", "bad"), ("c", 2, 3, "regenerate", None, None), ("c", 2, 4, "delta", None, "go"), ("c", 2, 5, "delta", None, "od~1<s>"), ("c", 3, 6, "delta", "tool<x>", "[a]"), ("c", 3, 7, "edit", None, "new"), ("c", 3, 8, "delta", None, "!"), ("d", 1, 0, "delta", None, None)]
    events = spark.createDataFrame(log, "conversation string, message int, sequence int, kind string, role string, text string")
    got = {r.conversation: r for r in chat_events.chats(events).select("conversation", "formatted", chat_events.read_back(F.col("formatted")).alias("turns"), chat_events.under_mask(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert [tuple(t) for t in got["c"].turns] == [("user", "hello"), ("assistant", "good~1<s>"), ("tool<x>", "new!")] and got["c"].loss == "good~1<s>"
    assert [tuple(t) for t in got["d"].turns] == [("", "")] and got["c"].formatted.count("<s>") == 1


def test_op9_ties_of_sequence(spark):
    """Deltas go before edits, edits before regenerations of their sequence; what an edit takes back goes, also under its own number."""
    log = [("a", 0, "delta", "ab"), ("a", 1, "delta", "cd"), ("a", 1, "edit", "XX"), ("a", 2, "delta", "ef"), ("b", 1, "edit", "no"), ("b", 1, "regenerate", None), ("b", 1, "delta", "no"), ("b", 2, "delta", "yes"), ("c", 0, "delta", "only"), ("d", 3, "regenerate", None), ("e", 1, "edit", "p"), ("e", 1, "edit", "q")]
    events = spark.createDataFrame([(c, 1, n, k, "user", t) for c, n, k, t in log], "conversation string, message int, sequence int, kind string, role string, text string")
    assert {r.conversation: r.text for r in chat_events.fold_events(events).collect()} == {"a": "XXef", "b": "yes", "c": "only", "d": "", "e": "q"}
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 0, None, "x" * 3000)], "conv_id long, turn long, role string, text string")
    back = {r.conversation: [tuple(t) for t in r.t] for r in chat_events.chats(chat_events.events_of_turns(rows)).select("conversation", chat_events.read_back(F.col("formatted")).alias("t")).collect()}
    assert back == {1: [("user", ""), ("user", "b"), ("user", "b")], None: [("", "x" * 3000)]}
    assert chat_events.chats(chat_events.events_of_turns(rows.limit(0))).count() == 0


# -- 10


def line_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen3 = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen3[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


PHRASES = re.compile(r"(?i)licensed under|all rights reserved|terms of (?:use|service)|privacy policy|accept (?:all )?cookies|copyright \(c\)|lorem ipsum|javascript (?:is|must be) (?:enabled|disabled)", re.ASCII)


def line_verdicts(text):
    """The text without failing lines, and the characters of words that go with them, line by line."""
    seen, kept, lost, total = set(), [], 0, 0
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        w = WORD.findall(line)
        upper, lower = (sum(c in s for c in line) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞ", "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"))
        fails = line in seen or sum(c in "#*$%&|<>!" for c in line) > 0.3 * len(w) or len(w) >= 5 and upper > 0.7 * (upper + lower)
        fails |= len(w) >= 2 and 3 * line.count("|") >= len(w) or len(w) >= 10 and 2 * sum(a == b for a, b in zip(w, w[1:])) > len(w)
        fails |= bool(PHRASES.search(line)) or len(w) >= 8 and not any(x[-1] in line_cleaning.SENTENCE_ENDS for x in w)
        if w:
            seen.add(line)
        size = sum(map(len, w))
        total += size
        if w and fails:
            lost += size
        else:
            kept.append(line + "\n" * (i < len(lines) - 1))
    return "".join(kept), lost, total


def test_op10_lines(spark, sf):
    """Every line rule against a line-by-line version, on whole texts and on lines made to break one rule each."""
    prose = " ".join(f"word{i}" for i in range(79)) + " end."
    odd = ["Home | News | About", "All rights reserved", "THIS IS ALL IN CAPITALS.", "ÉÀÜ ÖÄ ÉÀÜ ÖÄ É.", "a** b## c$$", "so so so so so so so so so so so.", "eight words of a line without any mark", "eight words of a line without any mark.", "it “ends so” as a sentence should end”", "日本語。", "we all accept all cookies.", "wow! wow! wow!", "  ", prose]
    rows = [(i, "\n".join([prose, x, prose + " more.", x])) for i, x in enumerate(odd)] + [(100, prose + "\nand so licensed "), (101, "under this.\n" + prose), (102, prose + "\nprivacy"), (103, " policy\n" + prose), (104, "All rights reserved\n" * 60 + prose)]
    rnd = random.Random(7)
    rows += [(200 + i, "\n".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 9)))) for i in range(40)]
    for docs in (dict(rows), texts(spark, sf)):
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
        for r in line_cleaning.clean_lines(df).collect():
            cleaned, lost, total = line_verdicts(docs[r.doc_id])
            assert (r.cleaned, r.chars_lost) == (cleaned, lost), docs[r.doc_id][:200]
            assert r.kept == (not line_counts(docs[r.doc_id])[5] and lost <= 0.4 * total)


def test_op10(spark, sf):
    docs = texts(spark, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in queries.op10_line_cleaning(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == line_counts(docs[r.doc_id])
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept
    got = line_cleaning.clean_lines(awkward(spark)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_dup_lines) for r in got) == Counter((i, line_counts(t)[0], line_counts(t)[3]) for i, t in AWKWARD)
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    lines = spark.createDataFrame([(1, f"{prose}\nHome | News | About\n{prose}\nAll rights reserved\nTHIS IS ALL IN CAPITALS"), (2, "a** " * 30 + "\n" + prose)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_cleaning.clean_lines(lines).collect()}
    assert out[1].cleaned == prose + "\n" and out[2].cleaned == prose
    assert line_cleaning.clean_lines(awkward(spark, [])).count() == 0


# -- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "suffix_dedup", "secrets", "packing"]
    at, seen = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        assert at.columns == docs.columns
        seen.append(at.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4]
    kept = {r.doc_id: r.text for r in at.collect()}
    assert not any(base_spans(t) for t in kept.values() if "password" in t)
    check_pieces(corpus_pipeline.packing(spark, at, sf).collect(), list(kept.items()))


def stage_rows(spark):
    """Documents with nulls in every column, ties, repeated rows, empty and very long texts, and columns whose names the operators use."""
    import corpus_pipeline

    prose = "The house stood by the river and nobody had lived there since the winter. " * 3
    texts = [*AWKWARD, (20, prose + "It was cold."), (21, prose + "It was cold."), (22, prose + "It was warm."), (23, SHARED + prose), (24, "Write to user=bob password=hunter222 and wait. " + prose), (25, " ".join(f"long{i % 5000} text." for i in range(60_000)))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key string, copy int, node string, salt int, carry_lang string, rank int, row string, fixed int, score int"
    rows = [(i, t, None if i in (1, None) else "en", None if i == 20 else "s", None if t is None else len(t), "k", 1, "n", 2, "c", 3, "r", 4, 5) for i, t in texts]
    return spark.createDataFrame(rows, kinds), corpus_pipeline


@pytest.mark.parametrize("name", ["quality", "near_dedup", "suffix_dedup", "secrets"])
def test_pipeline_stage_on_awkward_rows(spark, sf, name):
    docs, pipeline = stage_rows(spark)
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    assert out.columns == pipeline.COLUMNS and stage(spark, docs.limit(0), sf).count() == 0
    rows, given = out.collect(), docs.collect()
    assert Counter(r.doc_id for r in rows) <= Counter(r.doc_id for r in given)
    by_id = lambda i, found: Counter(r.text for r in found if r.doc_id == i)
    if name == "quality":
        assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in given} and all(by_id(i, rows) in (by_id(i, given), Counter()) for i in range(26))
    elif name == "near_dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id in (2, 3, 20, 21, 22)) == [2, 20] and by_id(7, rows) == Counter("xy")
        assert len(by_id(4, rows)) == 1 and not by_id(5, rows) and sum(r.doc_id is None for r in rows) == 1
    elif name == "suffix_dedup":
        order = sorted((r for r in given if r.doc_id != 7), key=lambda r: (r.doc_id is None, r.doc_id, r.text or ""))
        ascii_ = {r.doc_id for r in order if (r.text or "").isascii()} - {None}
        want = Counter((r.doc_id, x[3]) for r, x in zip(order, without_repeats([r.text for r in order]), strict=True) if r.doc_id in ascii_ and x[0] > x[1] or r.doc_id in (2, 3))
        assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows if r.doc_id in ascii_) == want and not by_id(5, rows)
        assert by_id(7, rows) == Counter("xy") and all(r.n_chars in (None, len(r.text)) for r in rows)
    else:
        assert len(rows) == len(given) and by_id(2, rows) == by_id(2, given) and by_id(25, rows) == by_id(25, given)
        assert next(r.text for r in rows if r.doc_id == 24).startswith("Write to [name] [assign] and wait.") and "AKIA" not in next(r.text for r in rows if r.doc_id == 8)


def test_pipeline_packing_on_awkward_rows(spark, sf):
    docs, pipeline = stage_rows(spark)
    check_pieces(pipeline.packing(spark, docs, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert pipeline.packing(spark, docs.limit(0), sf).count() == 0
