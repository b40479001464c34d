"""Plain text as PDF files: lines in a fixed pitch, cut to the page's width."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 612, 792, 36, 10, 12
COLUMNS, ROWS = 90, 60


def pages_of_text(text: str) -> list[list[str]]:
    """Lines, each cut into pieces of ``COLUMNS`` characters, ``ROWS`` to a page."""
    pieces = [line[a : a + COLUMNS] for line in text.split("\n") for a in range(0, max(len(line), 1), COLUMNS)]
    return [pieces[a : a + ROWS] for a in range(0, len(pieces), ROWS)]


def pdf_file(objects: list[bytes]) -> bytes:
    """A file of numbered objects, the first of which is the catalog."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def stream(data: bytes, head: bytes = b"") -> bytes:
    packed = zlib.compress(data, 1)
    return b"<< /Filter /FlateDecode /Length %d %s >>\nstream\n%s\nendstream" % (len(packed), head, packed)


def text_pdf(text: str) -> bytes:
    """A PDF of a text.  Its font has a code for each character of the text, with a map back to Unicode."""
    code = {c: i for i, c in enumerate(sorted(set(text)), 1)}
    pages, digits = pages_of_text(text), {c: f"{i:04X}" for c, i in code.items()}
    shown = lambda s: "".join(map(digits.__getitem__, s)).encode()
    bodies = []
    for lines in pages:
        content = b"BT /F1 %d Tf %d TL %d %d Td\n" % (SIZE, LEADING, MARGIN, HEIGHT - MARGIN - SIZE)
        bodies.append(stream(content + b"\n".join(b"<%s> Tj T*" % shown(line) for line in lines) + b"\nET"))
    entries = [f"<{i:04X}> <{c.encode('utf-16-be').hex().upper()}>".encode() for c, i in code.items()]
    blocks = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(some), b"\n".join(some)) for some in (entries[a : a + 100] for a in range(0, len(entries), 100)))
    fixed = 6
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % (fixed + 1 + 2 * i) for i in range(len(pages))), WIDTH, HEIGHT),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Courier /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Courier /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 600 /FontDescriptor 5 0 R >>",
        b"<< /Type /FontDescriptor /FontName /Courier /Flags 33 /Ascent 800 /Descent -200 /ItalicAngle 0 /CapHeight 600 /StemV 80 /FontBBox [0 -200 600 800] >>",
        stream(b"/CIDInit /ProcSet findresource begin 1 begincmap\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + blocks + b"endcmap"),
    ]
    for i, body in enumerate(bodies):
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (fixed + 2 + 2 * i), body]
    return pdf_file(objects)


def text_pdfs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content): each text as a PDF; a null text has an empty page."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([text_pdf(t or "") for t in some.column(1).to_pylist()], pa.binary())], ["key", "content"])

    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, content binary").withColumnRenamed("key", key)
