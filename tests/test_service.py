"""The paged source on a service that fails now and then, and staged writes whose tasks fail."""

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.sources import service

SCHEMA = "id long, text string, box array<int>, score double, more struct<a:int,b:string>"


class Fake(BaseHTTPRequestHandler):
    """Records in pages; every third request fails in one way or another."""

    records, asked, steady = [], [], True

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append(body)
        size, page = body["pageSize"], body["pageNum"]
        way = 9 if self.steady else len(self.asked) % 9
        pages = -(-len(self.records) // size)
        result = {"records": self.records[(page - 1) * size : page * size], "pages": pages}
        said = {0: b"{no json", 3: json.dumps({"success": False, "result": result}).encode(), 6: b""}.get(way, json.dumps({"success": True, "result": result}).encode())
        self.send_response(500 if way == 6 else 200)
        self.end_headers()
        self.wfile.write(said)

    def log_message(self, *_):
        pass


@pytest.fixture
def fake():
    Fake.records = [{"id": i, "text": f"t{i}" if i % 3 else None, "box": [i, 1], "score": i, "more": {"a": i, "b": "é"}, "unknown": 1} for i in range(103)]
    Fake.asked, Fake.steady = [], True
    server = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query"
    server.shutdown()


def load(spark, url, **options):
    service.register(spark)
    reader = spark.read.format("paged_records").schema(SCHEMA).option("url", url).option("query", '{"fileId": 7}').option("wait", "0.01")
    return reader.options(**{"pageSize": 10, **options}).load()


@pytest.mark.parametrize("steady", [True, False])
def test_every_page_once(spark, fake, steady):
    Fake.steady = steady
    df = load(spark, fake, attempts=9)
    rows = sorted(df.collect())
    assert [(r.id, r.text, r.box, r.score, r.more) for r in rows] == [(i, f"t{i}" if i % 3 else None, [i, 1], float(i), Row(a=i, b="é")) for i in range(103)]
    assert df.rdd.getNumPartitions() == 11 and all(a["fileId"] == 7 for a in Fake.asked)
    if steady:
        pages = [a["pageNum"] for a in Fake.asked]
        assert {p: pages.count(p) for p in range(2, 12)} == dict.fromkeys(range(2, 12), 1)


def test_services_without_rows_or_reply(spark, fake):
    Fake.records = []
    assert load(spark, fake).count() == 0
    with pytest.raises(Exception, match="didn't come in 2 attempts"):
        load(spark, "http://127.0.0.1:9/none", attempts=2).collect()


def test_a_service_that_changes_is_an_error(spark, fake):
    pages = service.Pages({"url": fake, "pageSize": 10}, T.StructType.fromDDL(SCHEMA))
    (piece,) = [p.value for p in service.PagedReader({"url": fake, "pageSize": 200}, T.StructType.fromDDL(SCHEMA)).partitions()]
    assert piece == service.Piece(1, 0, None, 1)
    Fake.records = Fake.records[:95]
    with pytest.raises(ValueError, match="changed while"):
        list(pages.rows(service.Piece(4, 0, None, 11)))


def test_stream_reads_what_is_added(spark, fake, tmp_path):
    service.register(spark)
    seen = []

    def run():
        df = spark.readStream.format("paged_records").schema(SCHEMA).option("url", fake).option("pageSize", 10).load()
        q = df.writeStream.foreachBatch(lambda b, _: seen.extend(r.id for r in b.select("id").collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    everything = Fake.records
    Fake.records = everything[:34]
    run()
    assert sorted(seen) == list(range(34))
    Fake.records = everything[:61]
    run()
    run()
    assert sorted(seen) == list(range(61))


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "rows.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE clauses (file_id INTEGER, text TEXT, box TEXT)")
    db.execute("CREATE TABLE status (file_id INTEGER, status TEXT, rows INTEGER, message TEXT, seconds REAL)")
    db.commit()
    db.close()

    def ask(sql):
        db = sqlite3.connect(path)
        try:
            return db.execute(sql).fetchall()
        finally:
            db.close()

    return path, ask


def options(path):
    return {"connect": "sqlite3:connect", "arguments": json.dumps([path]), "table": "clauses", "batch": 7, "statusTable": "status", "statusKey": "file_id"}


def test_staged_write(spark, base):
    service.register(spark)
    path, ask = base
    df = spark.range(100).select((F.col("id") % 3).alias("file_id"), F.concat(F.lit("t"), "id").alias("text"), F.array("id").alias("box")).repartition(4)
    df.write.format("staged_rows").options(**options(path)).mode("append").save()
    assert sorted(ask("SELECT file_id, text, box FROM clauses")) == sorted((i % 3, f"t{i}", f"[{i}]") for i in range(100))
    assert sorted(ask("SELECT file_id, status, rows FROM status")) == [(0, "PROCESSED", 34), (1, "PROCESSED", 33), (2, "PROCESSED", 33)]
    df.limit(5).write.format("staged_rows").options(**options(path)).mode("overwrite").save()
    assert ask("SELECT count(*) FROM clauses") == [(5,)] and len(ask("SELECT name FROM sqlite_master")) == 2


def test_failed_jobs_leave_nothing(spark, base):
    service.register(spark)
    path, ask = base
    bad = F.udf(lambda i: 1 // (i - 90), "long")  # fails after some batches
    df = spark.range(100).select((F.col("id") % 3).alias("file_id"), F.concat(F.lit("t"), bad("id")).alias("text"), F.array("id").alias("box")).coalesce(1)
    with pytest.raises(Exception, match="ZeroDivision|division"):
        df.write.format("staged_rows").options(**options(path)).mode("append").save()
    assert ask("SELECT count(*) FROM clauses") == [(0,)] and len(ask("SELECT name FROM sqlite_master")) == 2


def test_attempts_of_a_task_count_once(base):
    """A task that dies after some batches and runs again, and one that runs twice: only the attempt that Spark takes is moved."""
    path, ask = base
    schema = T.StructType.fromDDL("file_id long, text string, box array<int>")
    writer = service.StagedWriter(options(path), schema, False)
    rows = [(i % 2, f"t{i}", [i]) for i in range(30)]

    def dies():
        yield from rows[:20]
        raise OSError("the executor is lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dies())
    again = writer.write(iter(rows))
    writer.write(iter(rows))  # a speculative copy that isn't taken
    other = writer.write(iter([(5, "u", None)]))
    assert ask("SELECT count(*) FROM clauses") == [(0,)] and (again.rows, other.rows) == (30, 1)
    writer.commit([again, other, None])
    assert sorted(ask("SELECT file_id, text, box FROM clauses")) == sorted([(i % 2, f"t{i}", f"[{i}]") for i in range(30)] + [(5, "u", None)])
    assert sorted(ask("SELECT file_id, status, rows FROM status")) == [(0, "PROCESSED", 15), (1, "PROCESSED", 15), (5, "PROCESSED", 1)]
    late = service.StagedWriter(options(path), schema, False)
    late.write(iter(rows))
    late.abort([None])
    assert ask("SELECT count(*) FROM clauses") == [(31,)] and ask("SELECT count(*) FROM status WHERE status = 'ERROR'") == [(2,)] and len(ask("SELECT name FROM sqlite_master")) == 2
