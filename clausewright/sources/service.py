"""Rows from a paged service, and rows into a database in batches that a failed task neither loses nor repeats.

``paged_records`` reads a service that takes {..., pageSize, pageNum} and gives {success, result: {records, pages}}.  A page is a
partition, asked for by the task that reads it, again if that fails; a stream goes on where it stopped, within a page too.

``staged_rows`` writes through a DB-API connection: tasks insert batches into a staging table under a name of their attempt, and the
commit moves the rows of the attempts that Spark has taken, in one transaction, with a status row for each key.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from itertools import islice
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

BATCH = 1500  # rows of a page and of an insert


class Piece(NamedTuple):
    """Records begin <= i < end of a page; no end means all of them, and ``pages`` is what was planned with."""

    page: int
    begin: int
    end: int | None
    pages: int | None


def _option(options: dict, name: str, default=None):
    return options.get(name.lower(), options.get(name, default))


class PagedRecords(DataSource):
    """Options: ``url``; ``query``, a JSON object that goes into every request; ``pageSize`` (1500); ``attempts`` (5) and
    ``wait``, seconds before the second one, doubled each time (0.5); ``timeout`` in seconds (60).  The schema must be given; a record's
    fields go by name, those that it lacks are null.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        raise ValueError("give the records' schema: spark.read.format('paged_records').schema(...)")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PagedStream(self.options, schema)


class Pages:
    """One page after another, each asked for until it comes."""

    def __init__(self, options: dict, schema: T.StructType):
        self.url, self.query, self.size = _option(options, "url"), json.loads(_option(options, "query", "{}")), int(_option(options, "pageSize", BATCH))
        self.attempts, self.wait, self.timeout = int(_option(options, "attempts", 5)), float(_option(options, "wait", 0.5)), float(_option(options, "timeout", 60))
        self.fields = [(f.name, f.dataType) for f in schema]

    def ask(self, page: int) -> dict:
        body = json.dumps(self.query | {"pageSize": self.size, "pageNum": page}).encode()
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    said = json.load(reply)
                if said.get("success") and isinstance(said.get("result"), dict):
                    return said["result"]
                why = f"the service says {str(said)[:200]}"
            except (OSError, ValueError) as e:  # no connection, an HTTP error, no JSON
                why = f"{type(e).__name__}: {e}"
        raise OSError(f"page {page} of {self.url} didn't come in {self.attempts} attempts: {why}")

    def rows(self, piece: Piece) -> Iterator[tuple]:
        result = self.ask(piece.page)
        records = result.get("records") or []
        if piece.pages is not None and (result.get("pages") != piece.pages or piece.page < piece.pages and len(records) != self.size):
            raise ValueError(f"{self.url} changed while it was read: {piece.pages} pages were planned, page {piece.page} has {len(records)} records of {result.get('pages')} pages")
        if piece.end is not None and len(records) < piece.end:
            raise ValueError(f"page {piece.page} of {self.url} has lost records")
        for record in records[piece.begin : piece.end]:
            yield tuple(_value(record.get(name), kind) for name, kind in self.fields)


def _value(v, kind: T.DataType):
    """A JSON value as a schema's type."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(kind, T.ArrayType):
        return [_value(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {k: _value(x, kind.valueType) for k, x in v.items()}
    if isinstance(kind, T.StructType):
        return tuple(_value(v.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.TimestampType):
        return datetime.fromisoformat(v)
    if isinstance(kind, T.DateType):
        return date.fromisoformat(v[:10])
    return float(v) if isinstance(kind, (T.DoubleType, T.FloatType)) else v


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.pages = Pages(options, schema)

    def partitions(self) -> list[InputPartition]:
        n = self.pages.ask(1).get("pages") or 0
        return [InputPartition(Piece(i, 0, None, n)) for i in range(1, n + 1)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from self.pages.rows(partition.value)


class PagedStream(DataSourceStreamReader):
    """Offsets are (pages, records of the last one), so records added to a page that was short are read once, and alone."""

    def __init__(self, options: dict, schema: T.StructType):
        self.pages = Pages(options, schema)

    def initialOffset(self) -> dict:
        return {"page": 1, "seen": 0}

    def latestOffset(self) -> dict:
        n = self.pages.ask(1).get("pages") or 0
        return {"page": n, "seen": len(self.pages.ask(n).get("records") or [])} if n else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for page in range(start["page"], end["page"] + 1):
            begin = start["seen"] if page == start["page"] else 0
            stop = end["seen"] if page == end["page"] else self.pages.size
            if stop > begin:
                out.append(InputPartition(Piece(page, begin, stop, None)))
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from self.pages.rows(partition.value)


# -- into a database


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class StagedRows(DataSource):
    """Options: ``connect``, "module:function" that gives a DB-API connection, and ``arguments``, a JSON list for it; ``table``; ``batch``
    (1500); ``statusTable`` and ``statusKey``, a column: the commit adds (key, status, rows, message, seconds) there for each key; ``mark``, the
    connection's parameter mark ("?").  The table has the rows' columns; arrays, maps and structs go in as JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "staged_rows"

    def schema(self) -> str:
        raise ValueError("staged_rows is only written to")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options, schema, overwrite)


class StagedWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        module, _, function = _option(options, "connect").partition(":")
        self.source, self.arguments = (module, function), json.loads(_option(options, "arguments", "[]"))
        self.table, self.batch, self.mark, self.overwrite = _option(options, "table"), int(_option(options, "batch", BATCH)), _option(options, "mark", "?"), overwrite
        self.status, self.key = _option(options, "statusTable"), _option(options, "statusKey")
        self.names, self.began = [f.name for f in schema], time.time()
        self.nested = [i for i, f in enumerate(schema) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        for name in (self.table, self.status or "t", *self.names):
            if not name or '"' in name:
                raise ValueError(f"not a name of a table or column: {name}")
        self.stage = f"{self.table}_staged_{uuid.uuid4().hex[:12]}"
        self.columns = ", ".join(f'"{c}"' for c in self.names)
        with self.connection() as db:
            db.execute(f'CREATE TABLE "{self.stage}" AS SELECT {self.columns}, CAST(NULL AS VARCHAR(40)) AS staged_by FROM "{self.table}" WHERE 1 = 0')
            db.execute(f'CREATE TABLE "{self.stage}_taken" (staged_by VARCHAR(40))')

    def connection(self) -> Connection:
        return Connection(getattr(importlib.import_module(self.source[0]), self.source[1])(*self.arguments))

    def write(self, iterator: Iterator) -> Staged:
        attempt, total, marks = uuid.uuid4().hex, 0, ", ".join([self.mark] * (len(self.names) + 1))
        while some := [self.flat(row, attempt) for row in islice(iterator, self.batch)]:
            with self.connection() as db:
                db.executemany(f'INSERT INTO "{self.stage}" ({self.columns}, staged_by) VALUES ({marks})', some)
            total += len(some)
        return Staged(attempt, total)

    def flat(self, row, attempt: str) -> list:
        out = list(row)
        for i in self.nested:
            if out[i] is not None:
                out[i] = json.dumps(_plain(out[i]), ensure_ascii=False, default=str)
        return [*out, attempt]

    def commit(self, messages: list[Staged | None]) -> None:
        taken = [m for m in messages if m is not None]
        with self.connection() as db:
            for a in range(0, len(taken), self.batch):
                db.executemany(f'INSERT INTO "{self.stage}_taken" VALUES ({self.mark})', [[m.attempt] for m in taken[a : a + self.batch]])
            mine = f'FROM "{self.stage}" WHERE staged_by IN (SELECT staged_by FROM "{self.stage}_taken")'
            if self.overwrite:
                db.execute(f'DELETE FROM "{self.table}"')
            db.execute(f'INSERT INTO "{self.table}" ({self.columns}) SELECT {self.columns} {mine}')
            if self.status:
                db.execute(f"INSERT INTO \"{self.status}\" SELECT \"{self.key}\", 'PROCESSED', COUNT(*), NULL, {time.time() - self.began:.3f} {mine} GROUP BY \"{self.key}\"")
        self.drop()

    def abort(self, messages: list[Staged | None]) -> None:
        if self.status:
            with self.connection() as db:
                db.execute(f"INSERT INTO \"{self.status}\" SELECT \"{self.key}\", 'ERROR', 0, 'the write was given up', {time.time() - self.began:.3f} FROM \"{self.stage}\" GROUP BY \"{self.key}\"")
        self.drop()

    def drop(self) -> None:
        with self.connection() as db:
            db.execute(f'DROP TABLE "{self.stage}"')
            db.execute(f'DROP TABLE "{self.stage}_taken"')


class Connection:
    """A transaction: committed if all goes well, rolled back otherwise, and closed."""

    def __init__(self, db):
        self.db = db

    def __enter__(self):
        return self.db.cursor()

    def __exit__(self, kind, *_):
        try:
            self.db.rollback() if kind else self.db.commit()
        finally:
            self.db.close()


def _plain(v):
    """Rows as dictionaries, so that JSON has their names."""
    if isinstance(v, T.Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRecords)
    spark.dataSource.register(StagedRows)
