"""Reading contract documents and what earlier steps left of them.

Files come through Spark's own readers (binaryFile, json, csv), so any store that Spark reads will do.  Steps that need
programs or models which may be missing (office conversion, page images, recognition of characters) take a function.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from clausewright.sources.pdf import Pdf, page_size, page_spans

BOX = "struct<page_id:int,bbox:array<int>>"
PARSED = f"""doc_id string, filename string, report_type string, page_num int, pages_size map<int,struct<width:int,height:int>>, file_size string, items_num int,
process_datetime string, content array<struct<id:int,page_id:array<int>,block_bbox:array<{BOX}>,elements:array<struct<key:string,order:int,list_id:string,text:array<string>,is_table:boolean,table_json:string,bbox:array<int>,page_id:array<int>>>>>"""
TOKENS = "doc_id string, page_id int, pos int, text string, box array<int>, rule_tag string, size double, flags int, font string, color int"
TERM_SHEET = r"(?i).*TS.*|.*term sheet"
AGREEMENT = r"(?i).*FA.*|.*facility agreement|.*facilities agreement"


def file_type(name: Column, compat: bool = True) -> Column:
    """TS, FA or other, by a file's name.  With compat ``ts`` anywhere makes a summary; strict asks for it as a word."""
    base = F.element_at(F.split(name, "/"), -1)
    sheet, deal = (TERM_SHEET, AGREEMENT) if compat else (r"(?i)(?:^|[^A-Za-z])TS(?:[^A-Za-z]|$)|term ?sheet", r"(?i)(?:^|[^A-Za-z])FA(?:[^A-Za-z]|$)|facilit(?:y|ies) ?agreement")
    return F.when(base.rlike(sheet), "TS").when(base.rlike(deal), "FA").otherwise("other")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def with_lower_extension(path: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"^(.*?)(?:\.[^./]+)?$", 1), F.when(extension(path) != "", F.concat(F.lit("."), extension(path))).otherwise(F.lit("")))


def files(spark: SparkSession, path: str, *, compat: bool = True, content: bool = False) -> DataFrame:
    """Files below a path with their type; contents are only read if they are asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "modificationTime", file_type(F.col("path"), compat).alias("file_type"), extension(F.col("path")).alias("extension"), *(["content"] if content else []))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON object to a file, in the fixed schema."""
    return spark.read.schema(PARSED).option("multiLine", "true").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page cache: a JSON object to a line."""
    return spark.read.json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows kept as CSV: arrays, which are text there, come back as arrays."""
    wanted = T.StructType.fromDDL(schema)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in wanted])
    rows = spark.read.schema(flat).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    literal = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    opts = {"allowSingleQuotes": "true"}
    return rows.select(*(F.from_json(literal(F.col(f.name)), f.dataType, opts).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in wanted))


def read_bank(spark: SparkSession, path: str, compat: bool = True) -> DataFrame:
    """Known section names, the first column of a CSV file.  With compat a byte-order mark stays on the first name."""
    rows = spark.read.option("quote", '"').option("escape", '"').csv(path).select(F.col("_c0").alias("name")).where("name is not null")
    return rows if compat else rows.withColumn("name", F.regexp_replace("name", "^﻿", ""))


def clean_docx(files_: DataFrame, *, content: str = "content") -> DataFrame:
    """Word files without their three-dimensional scene settings, which break converters; other parts are kept byte for byte."""
    scene = re.compile(rb"<w14:scene3d\b.*?</w14:scene3d>|<w14:scene3d\b[^>]*/>", re.DOTALL)

    def one(raw: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(raw)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
            for item in src.infolist():
                data = src.read(item)
                dst.writestr(item, scene.sub(b"", data) if item.filename.endswith(".xml") else data)
        return out.getvalue()

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: None if raw is None else one(bytes(raw)))

    return files_.withColumn(content, run(F.col(content)))


def convert(files_: DataFrame, converter: Callable[[bytes, str], bytes], *, content: str = "content") -> DataFrame:
    """Files through a converter (bytes, extension) -> bytes; what fails gives an error text instead of a file."""
    kinds = files_.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done, errors = [], []
            for raw, ext in zip(f[content], f["extension"], strict=True):
                try:
                    done.append(converter(raw, ext))
                    errors.append(None)
                except Exception as e:  # one bad file is data, not the end of the job
                    done.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield f.assign(**{content: done, "error": errors})

    return files_.mapInPandas(run, T.StructType([*kinds.fields, T.StructField("error", T.StringType())]))


def recognise(images: DataFrame, reader: Callable[[bytes], str], *, image: str = "image", out: str = "text") -> DataFrame:
    """Text of images by a function that is given their bytes."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: None if raw is None else reader(bytes(raw)))

    return images.withColumn(out, run(F.col(image)))


def carry_headers(tables: DataFrame, *, by: list[str], order: list[str], header: str = "header") -> DataFrame:
    """Tables without a header take that of the one before, as a table that goes on over pages does."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return tables.withColumn(header, F.last(header, ignorenulls=True).over(w))


PDF_TOKENS = "page_id int, pos int, text string, box array<int>, rule_tag string, size double, flags int, font string, color int"


#: Tokens that are sent on together, at least.
TOKENS_SENT = 2_000


def on_grid(box: tuple, width: float, height: float) -> list[int]:
    return [min(1000, max(0, int(v / (height if i % 2 else width) * 1000))) for i, v in enumerate(box)]


def pdf_rows(pdf: Pdf, words: bool, first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """Tokens of some pages of a PDF: (page_id, pos, text, box, rule_tag, size, flags, font, color)."""
    for number, page in pdf.pages(first, last):
        width, height = page_size(pdf, page)
        found = page_spans(pdf, page, words)
        parts = [(w, box, s) for s in found for w, box in s.words] if words else [(s.text, s.box, s) for s in found]
        for pos, (text, box, s) in enumerate(parts):
            yield number, pos, text, on_grid(box, width, height), None, s.size, s.flags, s.font, s.color


def pdf_tokens(files_: DataFrame, key: str = "path", *, content: str = "content", granularity: str = "span") -> DataFrame:
    """Tokens of PDFs that are a column of bytes, as ``page_tokens`` gives them for files, with the error of those that can't be read.

    A null content gives no row.  Where whole files are large, read them by ``page_tokens``, which deals out their pages.
    """
    kind, types = files_.schema[key].dataType.simpleString(), [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.int32()]

    def sent(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, pa.string()], strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], ["key", *(x.split()[0] for x in PDF_TOKENS.split(", ")), "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                if raw is None:
                    continue
                try:
                    found = [(*row, None) for row in pdf_rows(Pdf.of(raw), granularity == "word")]
                except Exception as e:  # one bad file is data, not the end of the job
                    found = [(*(None,) * 9, f"{type(e).__name__}: {e}"[:500])]
                rows += found
                at += [i] * len(found)
                if len(rows) >= TOKENS_SENT:
                    yield sent(batch.column(0), at, rows)
                    at, rows = [], []
            if rows:
                yield sent(batch.column(0), at, rows)

    return files_.selectExpr(f"`{key}` AS key", f"`{content}` AS content").mapInArrow(run, f"key {kind}, {PDF_TOKENS}, error string").withColumnRenamed("key", key)


class TokenSource(DataSource):
    """``spark.read.format("page_tokens").load(path)``: tokens of PDFs and of page files (a JSON object per page, gzip or plain).

    A page in JSON has doc_id, page_id, width, height and spans of text, box, size, flags, font and color; a PDF's doc_id is its
    name.  ``granularity`` is ``span`` or ``word``; boxes come on the grid of 0 to 1000.  Files are dealt out by
    ``partitionBytes`` (32 MB): small ones are read several to a task, the pages of a large PDF by several tasks, each of which
    reads what its pages need.  With ``onError`` ``skip``, files that can't be read are left out; otherwise they end the job.
    """

    @classmethod
    def name(cls) -> str:
        return "page_tokens"

    def schema(self) -> str:
        return TOKENS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TokenReader(self.options)


class PageSource(TokenSource):
    """``spark.read.format("page_sizes").load(path)``: (doc_id, page_id, width, height) of the same files."""

    @classmethod
    def name(cls) -> str:
        return "page_sizes"

    def schema(self) -> str:
        return "doc_id string, page_id int, width double, height double"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SizeReader(self.options)


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.words = options["path"], options.get("granularity", "span") == "word"
        self.bytes, self.skip = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20))), options.get("onerror", options.get("onError", "raise")) == "skip"

    def partitions(self) -> list[InputPartition]:
        """Lists of (path, part, parts): small files together, large PDFs in parts."""
        fs, path = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else sorted((x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and re.search(r"(?i)\.(json(l|\.gz)?|pdf)$", x.path)), key=lambda x: x.path)
        out, some, total = [], [], 0
        for x in found:
            if x.path.lower().endswith(".pdf") and x.size > self.bytes:
                parts = -(-x.size // self.bytes)
                out += [InputPartition([(x.path, i, parts)]) for i in range(parts)]
                continue
            if some and (total + x.size > self.bytes or len(some) >= 64):
                out.append(InputPartition(some))
                some, total = [], 0
            some.append((x.path, 0, 1))
            total += x.size
        return [*out, InputPartition(some)] if some else out

    def read(self, partition: InputPartition):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path, part, parts in partition.value:
            rows = self.pdf(fs, path, part, parts) if path.lower().endswith(".pdf") else self.json(fs, path)
            while True:
                try:
                    row = next(rows)
                except StopIteration:
                    break
                except OSError:  # the store's fault, not the file's: the task tries again
                    raise
                except Exception:
                    if not self.skip:
                        raise
                    break
                yield row

    def pdf(self, fs: pafs.FileSystem, path: str, part: int, parts: int):
        with fs.open_input_file(path) as f:
            pdf = Pdf(in_blocks(f), f.size())
            n = pdf.page_count() if parts > 1 else None
            yield from self.of_pdf(re.sub(r"(?i)\.pdf$", "", path.rsplit("/", 1)[-1]), pdf, *((0, None) if n is None else (n * part // parts, n * (part + 1) // parts if part + 1 < parts else None)))

    def of_pdf(self, name: str, pdf: Pdf, first: int, last: int | None):
        for row in pdf_rows(pdf, self.words, first, last):
            yield name, *row

    def json(self, fs: pafs.FileSystem, path: str):
        import gzip
        import json

        with fs.open_input_stream(path, compression=None) as f:
            raw = f.read()
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        for line in raw.decode().splitlines():
            if line.strip():
                yield from self.of_json(json.loads(line))

    def of_json(self, page: dict):
        pos = 0
        for span in page["spans"]:
            for text, box in self.parts(span):
                yield str(page["doc_id"]), int(page["page_id"]), pos, text, on_grid(box, page["width"], page["height"]), span.get("tag"), float(span.get("size", 0)), int(span.get("flags", 0)), span.get("font"), int(span.get("color", 0))
                pos += 1

    def parts(self, span: dict):
        """The span, or its words with their share of its width."""
        text, (x0, y0, x1, y1) = span["text"], span["box"]
        if not self.words:
            yield text, (x0, y0, x1, y1)
            return
        for m in re.finditer(r"\S+", text):
            step = (x1 - x0) / max(len(text), 1)
            yield m[0], (x0 + step * m.start(), y0, x0 + step * m.end(), y1)


class SizeReader(TokenReader):
    def of_pdf(self, name: str, pdf: Pdf, first: int, last: int | None):
        for number, page in pdf.pages(first, last):
            yield name, number, *map(float, page_size(pdf, page))

    def of_json(self, page: dict):
        yield str(page["doc_id"]), int(page["page_id"]), float(page["width"]), float(page["height"])


def in_blocks(f, size: int = 1 << 18, kept: int = 32) -> Callable[[int, int], bytes]:
    """``read(at, n)`` of an open file, by blocks of which the last ones are kept: many short reads are few requests."""
    held: dict[int, bytes] = {}

    def block(i: int) -> bytes:
        if i not in held:
            if len(held) >= kept:
                del held[next(iter(held))]
            held[i] = f.read_at(size, i * size)
        return held[i]

    def read(at: int, n: int) -> bytes:
        if n > size:
            return f.read_at(n, at)
        out = block(at // size)[at % size : at % size + n]
        return out if len(out) == n or len(held[at // size]) < size else out + block(at // size + 1)[: n - len(out)]

    return read


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenSource)
    spark.dataSource.register(PageSource)
