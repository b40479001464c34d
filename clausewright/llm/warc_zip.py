"""WARC records in ZIP packages: a writer, and a reader that never unpacks an archive.

A package is a ZIP file with two *stored* (uncompressed) members: ``archive/data.warc.gz``, a run of WARC
records that are each a gzip member of their own, and ``indexes/index.cdxj``, which gives each record's place
in the first.  Because the members are stored, a record lies at a fixed byte range of the package: the reader
takes the end-of-central-directory record (and the ZIP64 one, where the package has it), the central directory,
the index, and then just the byte ranges of records.

Defined cases: a null payload is an empty one; a null id or URI leaves its header out and reads back as null; a
row without an id is a response unless another row with an id has the same payload; every row that has the
least id of its payload is a response, so repeated rows of that id are all responses.  An empty table gives no
package.  Columns beside the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import least_per_key, materialise, open_fs, salt_of, shared_dir, small_batches

# Fixed values of the ZIP format: signatures, the sizes of fixed parts, and markers of ZIP64.
EOCD, EOCD64_LOCATOR, EOCD64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
EOCD_SIZE, LOCATOR_SIZE, EOCD64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
IN_ZIP64_32, IN_ZIP64_16, ZIP64_EXTRA = 0xFFFFFFFF, 0xFFFF, 0x0001

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "package string, records long, bytes long"
BLOCKS = "package string, block_start long, block_end long, starts array<long>, sizes array<long>"
RECORDS = "id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """(id, uri, payload, refers_to): of equal payloads of ``least_bytes`` or more, all but the least id refer to it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("salt", salt_of("id"))
    first = least_per_key(rows.where(F.octet_length("payload") >= least_bytes).select("digest", "id", "salt"), "digest", "id", "first_id")
    first = first.where("copies > 1").select("digest", "salt", "first_id")
    return rows.join(first, ["digest", "salt"], "left").select("id", "uri", "payload", F.when(F.col("id").isNull() | (F.col("id") != F.col("first_id")), F.col("first_id")).alias("refers_to"))


def warc_record(page: object, uri: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP head of the full payload and none of its body."""
    clean = lambda s: "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in s)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {uri}')}>", f"WARC-Date: {date}"]
    head += [f"WARC-Page-ID: {quote(str(page))}"] * (page is not None) + ([f"WARC-Target-URI: {clean(uri)}"] if uri is not None else [])
    head += [f"WARC-Refers-To-Page: {quote(str(refers_to))}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_packages(rows: DataFrame, folder: str, *, package_bytes: int = 1 << 30, package_records: int = 200_000, level: int = 1, date: str = "2024-01-01T00:00:00Z", zip64: bool = True) -> DataFrame:
    """Write (id, uri, payload, refers_to) as packages below ``folder``; returns the manifest of the finished ones.

    Each task streams its rows into packages of a bounded size.  Names are new for each attempt, and only the
    attempt that commits gets its names into the manifest, so packages of lost or repeated tasks are never read.
    """
    small_batches(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        done: list[tuple[str, int, int]] = []
        out = None

        def begin():
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.wacz"
            sink = fs.open_output_stream(f"{top}/{name}")
            zf = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
            return {"name": name, "sink": sink, "zip": zf, "data": zf.open(DATA, "w", force_zip64=zip64), "index": [], "at": 0}

        def end(o) -> None:
            o["data"].close()
            with o["zip"].open(INDEX, "w", force_zip64=zip64) as f:
                f.write("".join(o["index"]).encode("utf-8", "surrogatepass"))
            o["zip"].close()
            o["sink"].close()
            done.append((f"{folder}/{o['name']}", len(o["index"]), o["at"]))

        for b in batches:
            for page, uri, payload, refers_to in zip(*(b.column(i) for i in range(4)), strict=True):
                out = out or begin()
                packed = gzip.compress(warc_record(page.as_py(), uri.as_py(), payload.as_py(), refers_to.as_py(), date), level, mtime=0)
                out["data"].write(packed)
                out["index"].append(json.dumps({"page": page.as_py(), "offset": out["at"], "length": len(packed)}) + "\n")
                out["at"] += len(packed)
                if out["at"] >= package_bytes or len(out["index"]) >= package_records:
                    end(out)
                    out = None
        if out:
            end(out)
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["package", "records", "bytes"])

    return materialise(rows.select("id", "uri", "payload", "refers_to").mapInArrow(write, MANIFEST), "warc-manifest")


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file, by range reads: name -> (local header's offset, stored size, compression method).

    ``f`` is a random-access file.  Looks for the end record in the last 64 KB, follows the ZIP64 locator where
    there is one, and takes 64-bit sizes and offsets from a member's ZIP64 extra field where the short ones overflow.
    """
    tail_at = max(0, size - (EOCD_SIZE + IN_ZIP64_16 + LOCATOR_SIZE))
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(EOCD)
    if at < 0:
        raise ValueError("not a ZIP file: it has no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= LOCATOR_SIZE and tail[at - LOCATOR_SIZE : at - LOCATOR_SIZE + 4] == EOCD64_LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, at - LOCATOR_SIZE + 8)
        record = f.read_at(EOCD64_SIZE, end64)
        if record[:4] != EOCD64:
            raise ValueError("the ZIP64 locator points at something else")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    raw, found, p = f.read_at(length, offset), {}, 0
    for _ in range(entries):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        (method,) = struct.unpack_from("<H", raw, p + 10)
        packed, plain, n_name, n_extra, n_comment, disk = struct.unpack_from("<IIHHHH", raw, p + 20)
        (local,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + CENTRAL_SIZE : p + CENTRAL_SIZE + n_name].decode()
        q, extra_end = p + CENTRAL_SIZE + n_name, p + CENTRAL_SIZE + n_name + n_extra
        while q + 4 <= extra_end:
            tag, n = struct.unpack_from("<HH", raw, q)
            if tag == ZIP64_EXTRA:
                wide = list(struct.unpack_from(f"<{n // 8}Q", raw, q + 4))
                plain = wide.pop(0) if plain == IN_ZIP64_32 else plain
                packed = wide.pop(0) if packed == IN_ZIP64_32 else packed
                local = wide.pop(0) if local == IN_ZIP64_32 else local
            q += 4 + n
        found[name] = (local, packed, method)
        p = extra_end + n_comment
    return found


def data_offset(f, local: int) -> int:
    """Where a member's bytes begin: after its local header, whose extra field may differ from the directory's."""
    head = f.read_at(LOCAL_SIZE, local)
    if head[:4] != LOCAL:
        raise ValueError("no local header where the directory says")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + LOCAL_SIZE + n_name + n_extra


def locate_records(manifest: DataFrame, *, block_bytes: int = 4 << 20) -> DataFrame:
    """Byte ranges of all records of packages (column ``package``): one row per block of neighbouring records."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package in b.column(0).to_pylist():
                fs, path = open_fs(package)
                with fs.open_input_file(path) as f:
                    members = directory(f, f.size())
                    places = {}
                    for name in (DATA, INDEX):
                        local, packed, method = members[name]
                        if method != zipfile.ZIP_STORED:
                            raise ValueError(f"{name} of {package} isn't stored")
                        places[name] = data_offset(f, local), packed
                    lines = f.read_at(places[INDEX][1], places[INDEX][0]).splitlines()
                rows = [(x["offset"], x["length"]) for x in map(json.loads, lines)]
                base, blocks, run = places[DATA][0], [], []
                for at, n in [*rows, (None, None)]:
                    if run and (at is None or at != run[-1][0] + run[-1][1] or at + n - run[0][0] > block_bytes):
                        first = run[0][0]
                        blocks.append((package, base + first, base + run[-1][0] + run[-1][1], [x - first for x, _ in run], [x for _, x in run]))
                        run = []
                    run.append((at, n))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in blocks], t) for i, t in enumerate(kinds)], ["package", "block_start", "block_end", "starts", "sizes"])

    return manifest.select("package").mapInArrow(locate, BLOCKS)


def parse_record(raw: bytes) -> tuple:
    """(id, uri, type, refers_to, payload bytes, payload digest, payload) of one record; checks a response's digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page, first = (unquote(x) if (x := fields.get(f)) is not None else None for f in ("WARC-Page-ID", "WARC-Refers-To-Page"))
    return page, fields.get("WARC-Target-URI"), kind, first, n, digest, payload if kind == "response" else None


def read_packages(manifest: DataFrame, *, payloads: bool = True, block_bytes: int = 4 << 20) -> DataFrame:
    """Records of packages, by range reads: id, uri, record_type, refers_to, payload_bytes, payload_digest[, payload].

    Blocks of neighbouring records are dealt out evenly, whatever the sizes of the packages they lie in.
    """
    spark = manifest.sparkSession
    blocks = locate_records(manifest, block_bytes=block_bytes)
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "package", "block_start")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                fs, path = open_fs(x["package"])
                with fs.open_input_file(path) as f:
                    raw = f.read_at(x["block_end"] - x["block_start"], x["block_start"])
                for part in np.array_split(np.arange(len(x["starts"])), max(1, len(x["starts"]) // 256)):
                    rows = [parse_record(zlib.decompress(raw[x["starts"][i] : x["starts"][i] + x["sizes"][i]], 31)) for i in part]
                    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(cols[: 6 + payloads], [s.split()[0] for s in RECORDS.split(", ")][: 6 + payloads])

    return blocks.mapInArrow(read, RECORDS if payloads else RECORDS.rpartition(",")[0])


def archive_round_trip(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write a record per row into packages in the shared folder and read the packages back."""
    rows = mark_revisits(pages, id_col, uri_col, payload_col, least_bytes)
    manifest = write_packages(rows, shared_dir(pages.sparkSession, "warc"))
    kind = pages.schema[id_col].dataType
    back = read_packages(manifest, payloads=payloads)
    return back.withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("id", id_col)
