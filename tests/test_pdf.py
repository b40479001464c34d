"""The PDF reader on files written byte by byte, and the source that reads them."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from clausewright.sources import documents, pdf_write
from clausewright.sources.pdf import FILTERS, Parser, Pdf, Ref, _lzw, _unpredicted, code_map, page_size, page_spans
from clausewright.sources.pdf_write import pdf_file, stream, text_pdf

CATALOG = b"<< /Type /Catalog /Pages 2 0 R >>"
HELV = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def one_page(content: bytes, page: bytes = b"/MediaBox [0 0 600 800]", fonts: bytes = b"/F1 4 0 R", more: tuple[bytes, ...] = (HELV,), resources: bytes = b"") -> bytes:
    return pdf_file([CATALOG, b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Parent 2 0 R %s /Resources << /Font << %s >> %s >> /Contents %d 0 R >>" % (page, fonts, resources, 4 + len(more)), *more, stream(content)])


def spans(data: bytes):
    pdf = Pdf.of(data)
    return [(s.text, tuple(round(v, 2) for v in s.box), s.size, s.flags, s.font, s.color) for _, page in pdf.pages() for s in page_spans(pdf, page)]


def test_objects():
    p = Parser(b"% a comment\n<< /A#20b [1 -2.5 .5 (x(y)\\)\\101\\n\\\nz) <48 6> true null 3 0 R] /C /D >> 4 0 obj")
    got = p.value()
    assert got == {"A b": [1, -2.5, 0.5, b"x(y))A\nz", b"H\x60", True, None, Ref(3, 0)], "C": "D"}
    assert [p.value(), p.value(), p.value(), p.value()] == [4, 0, "obj", None]


def test_filters():
    raw = bytes(random.Random(1).randbytes(300)) + b"abc" * 100
    assert FILTERS["ASCIIHexDecode"](raw.hex().encode() + b">") == raw
    assert FILTERS["RunLengthDecode"](b"\x02abc\xfed\x80zz") == b"abcddd"
    assert FILTERS["ASCII85Decode"](b"87cUR D]j7B~>") == b"Hello wor"[:len(FILTERS["ASCII85Decode"](b"87cUR D]j7B~>"))]
    assert _lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = [bytes([1, 2, 3, 4]), bytes([2, 3, 4, 5]), bytes([9, 9, 9, 9])]
    paeth = bytes([0, 1, 2, 3, 4, 2, 1, 1, 1, 1, 4, 7, 0, 0, 0])
    assert _unpredicted(paeth, {"Predictor": 15, "Columns": 4})[:8] == rows[0] + rows[1]
    with_sub = bytes([1, 5, 1, 1, 1])
    assert _unpredicted(with_sub, {"Predictor": 11, "Columns": 4}) == bytes([5, 6, 7, 8])
    assert _unpredicted(bytes([5, 1, 1, 1]), {"Predictor": 2, "Columns": 4}) == bytes([5, 6, 7, 8])


def test_places_sizes_and_colors():
    content = b"BT /F1 12 Tf 1 0 0 rg 100 700 Td (Hi) Tj 0 -20 TD 0 g (Low) Tj T* [(W) -1000 (ide)] TJ ET q 2 0 0 2 0 0 cm BT /F1 5 Tf 10 10 Td (Big) Tj ET Q"
    got = spans(one_page(content))
    assert got[0] == ("Hi", (100.0, 90.4, 111.33, 102.4), 12.0, 0, "Helvetica", 0xFF0000)
    assert [g[0] for g in got] == ["Hi", "Low", "W", "ide", "Big"] and got[1][1][1] == pytest.approx(110.4)
    assert got[4][2] == 10.0 and got[4][1][0] == 20.0 and got[4][1][3] == 782.0
    # a gap of a fifth of the size is a blank between words, a smaller one is none
    near = spans(one_page(b"BT /F1 10 Tf 50 50 Td [(ab) -50 (cd) -300 (ef)] TJ ET"))
    assert [g[0] for g in near] == ["abcd ef"]
    pdf = Pdf.of(one_page(b"BT /F1 10 Tf 50 50 Td (ab  cd) Tj ET"))
    (span,) = page_spans(pdf, next(pdf.pages())[1])
    assert [(w, round(b[0], 2), round(b[2], 2)) for w, b in span.words] == [("ab", 50.0, 61.12), ("cd", 66.68, 77.24)]


@pytest.mark.parametrize(("turn", "corner"), [(0, (100, 92)), (90, (698, 100)), (180, (494, 698)), (270, (92, 494))])
def test_rotated_pages(turn, corner):
    data = one_page(b"BT /F1 10 Tf 100 700 Td (I) Tj ET", b"/MediaBox [0 0 600 800] /Rotate %d" % turn)
    pdf = Pdf.of(data)
    page = next(pdf.pages())[1]
    assert page_size(pdf, page) == ((800, 600) if turn % 180 else (600, 800))
    (_, box, *_), = spans(data)
    assert abs(box[0] - corner[0]) < 4 and abs(box[1] - corner[1]) < 4
    assert (box[2] - box[0] > box[3] - box[1]) == bool(turn % 180)


def test_crop_box_forms_and_inheritance():
    form = b"<< /Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 50 0] /Length 39 >>\nstream\nBT /F1 10 Tf 10 30 Td (in a form) Tj ET \nendstream"
    data = one_page(b"/X Do BI /W 1 /H 1 ID \x00(Tj ET) EI BT /F1 10 Tf 20 60 Td (after) Tj ET", b"/MediaBox [0 0 600 800] /CropBox [10 20 300 400]", more=(HELV, form), resources=b"/XObject << /X 5 0 R >>")
    got = spans(data)
    assert [(g[0], g[1][0]) for g in got] == [("in a form", 50.0), ("after", 10.0)] and got[0][1][3] == 372.0
    tree = pdf_file([CATALOG, b"<< /Type /Pages /Count 3 /Kids [3 0 R 6 0 R] /MediaBox [0 0 100 200] >>", b"<< /Type /Pages /Parent 2 0 R /Count 2 /Kids [4 0 R 5 0 R] /Rotate 90 >>", b"<< /Type /Page /Parent 3 0 R >>", b"<< /Type /Page /Parent 3 0 R /MediaBox [0 0 50 60] /Rotate 0 >>", b"<< /Type /Page /Parent 2 0 R >>"])
    pdf = Pdf.of(tree)
    assert [(n, page_size(pdf, p)) for n, p in pdf.pages()] == [(1, (200, 100)), (2, (50, 60)), (3, (100, 200))]
    assert [n for n, _ in pdf.pages(2)] == [3] and [n for n, _ in pdf.pages(1, 2)] == [2] and pdf.page_count() == 3


def test_fonts():
    simple = b"<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Arial-BoldItalic /FirstChar 65 /Widths [1000 500] /FontDescriptor 5 0 R /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni20AC 67 /ffi] >> >>"
    about = b"<< /Type /FontDescriptor /Flags 98 /Ascent 900 /Descent 300 /MissingWidth 250 >>"
    wide = b"<< /Type /Font /Subtype /Type0 /BaseFont /Kai /Encoding /Identity-H /DescendantFonts [ << /DW 1000 /W [3 [700 600] 9 11 100] >> ] /ToUnicode 7 0 R >>"
    to = stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <65E5> <0004> <D83DDE42> endbfchar 2 beginbfrange <0009> <000B> <0041> <0010> <0011> [<00660069> <7A>] endbfrange")
    data = one_page(b"BT /F1 10 Tf 10 100 Td (ABC\x80) Tj /F2 10 Tf 0 -50 Td <00030004000A00100099> Tj ET", fonts=b"/F1 4 0 R /F2 6 0 R", more=(simple, about, wide, to))
    a, b = spans(data)
    assert a == ("é€ffi€", (10.0, 691.0, 30.0, 703.0), 10.0, 2 + 4 + 16, "Arial-BoldItalic", 0)
    assert b[0] == "日🙂Bfi�" and b[1][2] == 10 + 7 + 6 + 1 + 10 + 10 and b[4] == "Kai"


def packed_in_streams(predictor: bool) -> bytes:
    """The same page with its objects in an object stream and a cross-reference stream."""
    inner = [(1, CATALOG), (2, b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Resources << /Font << /F1 4 0 R >> >> /Contents 5 0 R >>"), (4, HELV)]
    heads, bodies = [], b""
    for n, body in inner:
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b" "
    first = b" ".join(heads) + b" "
    out = b"%PDF-1.5\n"
    at5 = len(out)
    out += b"5 0 obj\n" + stream(b"BT /F1 10 Tf 10 100 Td (packed) Tj ET") + b"\nendobj\n"
    at6 = len(out)
    out += b"6 0 obj\n" + stream(first + bodies, b"/Type /ObjStm /N 4 /First %d" % len(first)) + b"\nendobj\n"
    at7 = len(out)
    entries = [(0, 0, 0), *((2, 6, i) for i in range(4)), (1, at5, 0), (1, at6, 0), (1, at7, 0)]
    rows = [bytes([a, b >> 8, b & 255, c]) for a, b, c in entries]
    if predictor:  # each row as its difference from the one above
        table = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before, strict=True)) for r, before in zip(rows, [bytes(4), *rows], strict=False))
        parms = b"/DecodeParms << /Predictor 12 /Columns 4 >>"
    else:
        table, parms = b"".join(rows), b""
    out += b"7 0 obj\n" + stream(table, b"/Type /XRef /W [1 2 1] /Size 8 /Root 1 0 R " + parms) + b"\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF" % at7


def test_other_layouts_of_a_file():
    whole = one_page(b"BT /F1 10 Tf 10 100 Td (packed) Tj ET")
    want = spans(whole)
    assert spans(packed_in_streams(False)) == spans(packed_in_streams(True)) == want
    # tables that are gone, or that point anywhere, are made anew
    assert spans(whole.replace(b"startxref", b"startxxxx")) == spans(whole.replace(b"0000000", b"0000001")) == want
    assert spans(packed_in_streams(True).replace(b"startxref", b"startxxxx")) == want
    # an update at the end of the file has the say
    at = len(whole)
    update = b"4 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Courier-Bold >>\nendobj\n"
    old = int(whole.rsplit(b"startxref", 1)[1].split()[0])
    new = whole + update + b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, at + len(update))
    assert [(g[0], g[3], g[4]) for g in spans(new)] == [("packed", 24, "Courier-Bold")]


@pytest.mark.parametrize("bad", [b"", b"not a PDF", b"%PDF-1.4\n1 0 obj << >> endobj", text_pdf("x").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")])
def test_files_that_cannot_be_read(bad):
    with pytest.raises(ValueError, match="PDF"):
        Pdf.of(bad)


def test_damage_ends_in_values_or_errors():
    """Random damage gives spans or an error of the kinds that the source expects, and always ends."""
    rnd, whole = random.Random(2), text_pdf("some text\nover lines " * 30)
    for _ in range(150):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 30)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        try:
            spans(bytes(data[: rnd.randrange(len(data) // 2, len(data) + 1)]))
        except (ValueError, TypeError, KeyError, EOFError, zlib.error):
            pass


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pdfs")
    rnd = random.Random(3)
    texts = {f"doc{i}": "\n".join("".join(rnd.choices("abc é日 ", k=rnd.randrange(0, 200))) for _ in range(rnd.randrange(1, 400))) for i in range(6)}
    for name, text in texts.items():
        (top / f"{name}.pdf").write_bytes(text_pdf(text))
    (top / "pages.json").write_text('{"doc_id": "j", "page_id": 1, "width": 100, "height": 200, "spans": [{"text": "a b", "box": [10, 20, 40, 30]}]}\n')
    return top, texts


def lines_of(text):
    return [(p, line.strip(" ")) for p, lines in enumerate(pdf_write.pages_of_text(text), 1) for line in lines if line.strip(" ")]


@pytest.mark.parametrize("size", [32 << 20, 2000])
def test_source_deals_out_pages(spark, folder, size):
    """With small partitions, several tasks read a file's pages: each page once."""
    documents.register(spark)
    top, texts = folder
    df = spark.read.format("page_tokens").option("partitionBytes", size).load(f"file://{top}")
    assert (df.rdd.getNumPartitions() > 7) == (size == 2000)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.page_id, r.pos)):
        got.setdefault(r.doc_id, []).append((r.page_id, r.text))
    assert got.pop("j") == [(1, "a b")]
    assert got == {name: lines_of(text) for name, text in texts.items() if lines_of(text)}
    sizes = spark.read.format("page_sizes").option("partitionBytes", size).load(f"file://{top}").collect()
    assert {(r.doc_id, r.page_id, r.width, r.height) for r in sizes} == {("j", 1, 100.0, 200.0)} | {(n, p, 612.0, 792.0) for n, t in texts.items() for p in range(1, len(pdf_write.pages_of_text(t)) + 1)}
    words = spark.read.format("page_tokens").option("granularity", "word").load(f"file://{top}/doc0.pdf")
    assert [r.text for r in words.orderBy("page_id", "pos").collect()] == [w for _, line in lines_of(texts["doc0"]) for w in line.split(" ") if w]


def test_errors_are_rows_or_left_out(spark, folder, tmp_path):
    documents.register(spark)
    top, texts = folder
    files = spark.createDataFrame([("a", bytearray(text_pdf("one")), 1), ("b", bytearray(b"junk"), 2), ("c", None, 3), ("d", bytearray(text_pdf("")), 4)], "path string, content binary, pos int")
    rows = {(r.path, r.text, r.error and r.error[:10]) for r in documents.pdf_tokens(files).collect()}
    assert rows == {("a", "one", None), ("b", None, "ValueError")}
    assert documents.pdf_tokens(files.limit(0)).count() == 0
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    (tmp_path / "good.pdf").write_bytes(text_pdf("fine"))
    load = lambda how: spark.read.format("page_tokens").option("onError", how).load(f"file://{tmp_path}").select(F.col("text")).collect()
    assert [r.text for r in load("skip")] == ["fine"]
    with pytest.raises(Exception, match="PDF"):
        load("raise")


def test_words_are_made_only_if_asked_for():
    """A box was worked out for each word, and edges for each letter, though only spans' boxes were wanted."""
    pdf = Pdf.of(text_pdf("  two words\nand a line that is long enough to be cut: " + "abc " * 30 + "\n\nend"))
    (_, page), = pdf.pages()
    whole, plain = page_spans(pdf, page), page_spans(pdf, page, words=False)
    assert [s._replace(words=[]) for s in whole] == plain and [w for w, _ in whole[0].words] == ["two", "words"]
    assert len(pdf.fonts) == 1 and all(s.box[0] == s.words[0][1][0] and s.box[2] == s.words[-1][1][2] for s in whole)


def test_maps_of_pairs_and_of_other_things():
    text, _, _ = code_map(b"2 beginbfchar\n<0001> <0041>\n<0002><D83DDE00>\nendbfchar\n2 beginbfchar <03> % a remark\n<0042> <0004> /x endbfchar 1 beginbfrange <05> <06> <0061> endbfrange")
    assert text == {1: "A", 2: "😀", 3: "B", 4: "", 5: "a", 6: "b"}
