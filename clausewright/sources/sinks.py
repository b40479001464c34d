"""Writing rows, logs, status and reports."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_rows(rows: DataFrame, path: str, *, kind: str = "file_type") -> None:
    """Append clause rows below a folder per file type and file, so that later reads prune to what they ask for."""
    rows.write.mode("append").partitionBy(kind, "file_id").parquet(path)


def insert_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("append").partitionBy("task_id").parquet(path)


def insert_jdbc(rows: DataFrame, url: str, table: str, *, batch: int = 1500, **options) -> None:
    rows.write.mode("append").format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).save()


def write_parsed(parsed: DataFrame, path: str) -> None:
    parsed.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV in UTF-8 with a header; arrays and structs are written as JSON."""
    flat = rows.select(*(F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in rows.dtypes))
    flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", "true").csv(path)


def update_status(spark, path: str, *, kind: str, key: int, status: str, message: str | None = None, seconds: float | None = None) -> None:
    """A status row of a document or task; readers take the last one of a key."""
    row = spark.createDataFrame([(kind, key, status, message, seconds)], "kind string, key long, status string, message string, seconds double")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_status(df: DataFrame) -> DataFrame:
    return df.groupBy("kind", "key").agg(F.max_by(F.struct("status", "message", "seconds"), "at").alias("s")).select("kind", "key", "s.*")


# -- reports: of one task, so they have a bounded number of rows and are written by the driver


def _cell(ref: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def xlsx(sheets: dict[str, DataFrame], *, most: int = 100_000) -> bytes:
    """A workbook with a filter on each sheet's header.  A sheet of more than ``most`` rows is an error, not a cut."""
    out = io.BytesIO()
    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            df = sheets[name]
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"sheet {name} has more than {most} rows")
            lines = [df.columns, *rows]
            body = "".join(f'<row r="{r}">' + "".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(lines, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData><autoFilter ref="A1:{_column(max(len(df.columns) - 1, 0))}{len(lines)}"/></worksheet>')
    return out.getvalue()


def docx(title: str, tables: dict[str, DataFrame], *, most: int = 20_000) -> bytes:
    """A document with a heading and one table per frame."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, b=False: f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if b else ''}<w:t xml:space=\"preserve\">{escape('' if t is None else str(t))}</w:t></w:r></w:p>"
    body = para(title, True)
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"table {name} has more than {most} rows")
        line = lambda r, b=False: "<w:tr>" + "".join(f"<w:tc>{para(v, b)}</w:tc>" for v in r) + "</w:tr>"
        body += para(name, True) + '<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr>' + line(df.columns, True) + "".join(map(line, rows)) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def bundle(files: dict[str, bytes]) -> bytes:
    """Reports in one ZIP file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in files.items():
            z.writestr(name, raw)
    return out.getvalue()


def health(spark, paths: list[str]) -> DataFrame:
    """(path, reachable) of what a deployment depends on, asked of the file systems themselves."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        rows.append((p, bool(hp.getFileSystem(conf).exists(hp))))
    return spark.createDataFrame(rows, "path string, reachable boolean")
