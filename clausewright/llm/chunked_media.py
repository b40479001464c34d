"""Media columns kept as content-defined chunks.

A payload becomes a binary greymap (8-bit samples, ``width`` to a row).  A rolling gear hash cuts the media into
chunks at places that its bytes choose, so an insertion moves the cuts around it and no others.  Each writing task
puts the chunks it has not seen yet, compressed, into pack files in the shared folder.  Spark joins pick one place
for each chunk digest over all packs; each media is then an ordered list of such places, read back by byte ranges,
joined, and verified against its digest.

Payload bytes are never shuffled: only digests and places are.  Chunks that several tasks wrote stay in their
packs, unreferenced after the join, until ``compact`` rewrites the packs with the chosen places alone.

Defined cases: a null text is the empty payload; an empty payload is padded to one row; equal texts give equal
values; rows that repeat are each returned; an empty table gives an empty result; null keys are kept as they are.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import least_per_key, materialise, mix64, open_fs, salt_of, shared_dir, small_batches, text_slices

GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
WINDOW_STEPS = 5  # a 32-bit gear hash forgets a byte after 32 shifts


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear(data[i-k]) << k over the last 32 bytes: what shifting and adding gives, by doubling."""
    h = GEAR[data]
    for s in range(WINDOW_STEPS):
        n = 1 << s
        moved = h[:-n] << np.uint32(n)
        h[n:] += moved
    return h


def cut_points(data: bytes, *, least: int = 2048, average: int = 8192, most: int = 65536) -> list[int]:
    """Ends of chunks: the first place from ``least`` bytes on where the hash's top bits are zero, ``most`` at the latest."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    bits = max(1, average.bit_length() - 1)
    marks = np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - bits) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        k = np.searchsorted(marks, at + least)
        end = min(int(marks[k]) if k < len(marks) else n, at + most, n)
        ends.append(end)
        at = end
    return ends + [n] * (at < n)


def greymap(payload: bytes, width: int) -> bytes:
    """A binary PGM image of the payload, padded with 255 to a positive multiple of ``width``."""
    rows = max(1, -(-len(payload) // width))
    return b"P5\n%d %d\n255\n" % (width, rows) + payload + b"\xff" * (rows * width - len(payload))


def samples(media: bytes) -> bytes:
    """The samples of a greymap that greymap() made."""
    head = 0
    for _ in range(3):
        head = media.index(b"\n", head) + 1
    w, h = map(int, media.split(b"\n", 2)[1].split())
    if media[:2] != b"P5" or len(media) - head != w * h:
        raise ValueError("not a whole greymap")
    return media[head:]


def write_chunks(docs: DataFrame, key: str, text: str, folder: str, *, width: int = 576, least: int = 2048, average: int = 8192, most: int = 65536, pack_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Recipes: key, n_bytes, media_sha256, media_bytes, and ``chunks``: digest and the place its task has it at.

    A place names a pack by its file's name in ``folder``: places are sampled and shuffled, so they stay short.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=level)
        seen: dict[bytes, tuple] = {}
        sink, name, at = None, "", 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for t in part.column("text").to_pylist():
                    payload = (t or "").encode("utf-8", "surrogatepass")
                    media, chunks, start = greymap(payload, width), [], 0
                    for end in cut_points(media, least=least, average=average, most=most):
                        digest = hashlib.sha256(media[start:end]).digest()
                        if digest not in seen:
                            if sink is None:
                                name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}", 0
                                sink = fs.open_output_stream(f"{top}/{name}")
                            packed = squeeze.compress(media[start:end])
                            sink.write(packed)
                            seen[digest] = (name, at, len(packed), end - start)
                            at += len(packed)
                        chunks.append({"digest": digest, **dict(zip(("pack", "offset", "size", "raw"), seen[digest], strict=True))})
                        start = end
                    out.append((len(payload), hashlib.sha256(media).hexdigest(), len(media), chunks))
                    if at >= pack_bytes:
                        sink.close()
                        sink, at, seen = None, 0, {}  # what a task remembers is bounded by a pack
                item = pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("offset", pa.int64()), ("size", pa.int32()), ("raw", pa.int32())])
                cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.list_(item)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["key", "n_bytes", "media_sha256", "media_bytes", "chunks"])
        if sink:
            sink.close()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(write, f"key {kind}, n_bytes long, media_sha256 string, media_bytes long, chunks array<struct<digest:binary,pack:string,offset:long,size:int,raw:int>>")


def ordered_lists(recipes: DataFrame) -> DataFrame:
    """(media_sha256, places) of each distinct media: its chunks in order, each at its digest's chosen place.

    The least place of a digest over all packs is chosen by a join; refs of a digest that very many media share
    are dealt over salts.  A list is as long as its own media, so gathering it is bounded by one payload.
    """
    media = recipes.groupBy("media_sha256").agg(F.first("chunks").alias("chunks"))
    refs = media.select("media_sha256", F.posexplode("chunks").alias("pos", "c")).select("media_sha256", "pos", "c.digest", F.struct("c.pack", "c.offset", "c.size", "c.raw").alias("place"))
    refs = refs.withColumn("salt", salt_of("media_sha256"))
    chosen = least_per_key(refs, "digest", "place", "chosen").select("digest", "salt", "chosen")
    found = refs.select("media_sha256", "pos", "digest", "salt").join(chosen, ["digest", "salt"])
    return found.groupBy("media_sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chosen"))), lambda x: x["chosen"]).alias("places"))


class PackReader:
    """Chunks by place: neighbouring ranges of a pack are read together, files and hot chunks are kept a while."""

    def __init__(self, folder: str, gap: int = 1 << 16, most: int = 4 << 20):
        self.fs, self.top = open_fs(folder)
        self.files: OrderedDict = OrderedDict()
        self.gap, self.most, self.plain = gap, most, zstandard.ZstdDecompressor()

    def file(self, pack: str):
        if pack not in self.files:
            if len(self.files) >= 16:
                self.files.popitem(last=False)[1].close()
            self.files[pack] = self.fs.open_input_file(f"{self.top}/{pack}")
        self.files.move_to_end(pack)
        return self.files[pack]

    def fetch(self, places: set[tuple]) -> dict[tuple, bytes]:
        out, run = {}, []

        def read() -> None:
            start, end = run[0][1], max(x[1] + x[2] for x in run)
            raw = self.file(run[0][0]).read_at(end - start, start)
            for x in run:
                out[x] = self.plain.decompress(raw[x[1] - start : x[1] - start + x[2]], max_output_size=x[3])

        for x in sorted(places):
            if run and (x[0] != run[0][0] or x[1] - (run[-1][1] + run[-1][2]) > self.gap or x[1] + x[2] - run[0][1] > self.most):
                read()
                run = []
            run.append(x)
        if run:
            read()
        return out


def rebuild(lists: DataFrame, feature, folder: str, *, batch_chunks: int = 512) -> DataFrame:
    """Read media back from their lists, verify them, and compute: payload_bytes, payload_sha256, tail_crc32, feature.

    ``feature`` takes the samples as an array of bytes and returns a string.  A media that differs from its digest
    fails the task: nothing damaged is passed on.
    """
    near = lists.withColumn("at", F.col("places")[0]["pack"]).repartitionByRange("at", F.col("places")[0]["offset"]).sortWithinPartitions("at", F.col("places")[0]["offset"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = PackReader(folder)
        for batch in batches:
            keys = batch.column("media_sha256").to_pylist()
            lists_ = [[(p["pack"], p["offset"], p["size"], p["raw"]) for p in x] for x in batch.column("places").to_pylist()]
            at = 0
            while at < len(keys):
                end, n = at + 1, len(lists_[at])
                while end < len(keys) and n + len(lists_[end]) <= batch_chunks:
                    n += len(lists_[end])
                    end += 1
                got = packs.fetch({p for x in lists_[at:end] for p in x})
                out = []
                for k, x in zip(keys[at:end], lists_[at:end], strict=True):
                    media = b"".join(got[p] for p in x)
                    if hashlib.sha256(media).hexdigest() != k:
                        raise ValueError(f"media {k} came back damaged")
                    payload = samples(media)
                    out.append((k, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(np.frombuffer(payload, np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], ["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])
                at = end

    return near.select("media_sha256", "places").mapInArrow(read, "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def histogram_feature(x: np.ndarray, bands: int = 16) -> str:
    """Mean, deviation and a coarse histogram of the samples, in whole numbers."""
    counts = np.bincount(x >> 4, minlength=bands)
    return ",".join(map(str, [round(float(x.mean()) * 100), round(float(x.std()) * 100), *counts.tolist()]))


def media_column(docs: DataFrame, *, key: str = "doc_id", text: str = "text", feature=histogram_feature, **chunking) -> DataFrame:
    """Store each text as chunked media, read every distinct media back, and return a row per input row.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    folder = shared_dir(docs.sparkSession, "packs")
    recipes = materialise(write_chunks(docs, key, text, folder, **chunking), "recipes")
    back = rebuild(ordered_lists(recipes), feature, folder)
    rows = recipes.select("key", "n_bytes", "media_bytes", "media_sha256").withColumn("salt", salt_of("key"))
    back = back.join(rows.select("media_sha256", "salt").distinct(), "media_sha256")
    found = rows.join(back, ["media_sha256", "salt"])
    return found.select(F.col("key").alias(key), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def compact(recipes: DataFrame, packs_folder: str, folder: str) -> DataFrame:
    """Rewrite the packs of ``packs_folder`` into ``folder`` with the chosen places alone: (old place, new place) of every chunk that is still referenced."""
    chosen = ordered_lists(recipes).select(F.explode("places").alias("p")).select("p.*").distinct().repartition("pack").sortWithinPartitions("pack", "offset")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        sinks: dict[str, list] = {}
        packs = PackReader(packs_folder)
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["pack"] not in sinks:
                    for s in sinks.values():
                        s[1].close()
                    name = uuid.uuid4().hex
                    sinks = {x["pack"]: [name, fs.open_output_stream(f"{top}/{name}"), 0]}
                s = sinks[x["pack"]]
                s[1].write(packs.file(x["pack"]).read_at(x["size"], x["offset"]))
                rows.append({**x, "new_pack": s[0], "new_offset": s[2]})
                s[2] += x["size"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pack", pa.string()), ("offset", pa.int64()), ("size", pa.int32()), ("raw", pa.int32()), ("new_pack", pa.string()), ("new_offset", pa.int64())]))
        for s in sinks.values():
            s[1].close()

    return materialise(chosen.mapInArrow(copy, "pack string, offset long, size int, raw int, new_pack string, new_offset long"), "compacted")
