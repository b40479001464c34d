"""Tables from boxes of words, on awkward pages and against a plain version."""

import random

from clausewright.operators import tables as TB

COLUMNS = "doc_id long, page_id int, table_id int, text string, box array<int>, row string, part int"


def words(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)


def plain_cells(found, tolerance=15, space=8):
    """(row, column) -> text of one table's words (text, box)."""
    rows, last = [], None
    for text, (x0, y0, x1, _) in sorted(found, key=lambda w: (w[1][1], w[1][0], w[1][2], w[0])):
        if last is None or y0 - last > tolerance:
            rows.append([])
        rows[-1].append((x0, x1, text))
        last = y0
    parts = []
    for row in rows:
        row.sort(key=lambda w: (w[0], w[1]))
        groups, reach = [], None
        for w in row:
            if reach is None or w[0] - reach > space:
                groups.append([])
            groups[-1].append(w)
            reach = max(w[1], reach if reach is not None else w[1])
        parts.append([(min(w[0] for w in g), max(w[1] for w in g), " ".join(w[2] for w in sorted(g))) for g in groups])

    def sweep(spans):
        out = []
        for a, b in sorted(spans):
            if out and a - out[-1][1] <= space:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    widths = [len(p) for p in parts]
    usual = max(set(widths), key=lambda n: (widths.count(n), n))
    base = sweep([(a, b) for p in parts if len(p) == usual for a, b, _ in p])
    columns = sweep([(a, b) for p in parts for a, b, _ in p if len(p) == usual or not any(a <= d and b >= c for c, d in base)])
    out = {}
    for i, p in enumerate(parts):
        for a, b, text in p:
            at = next(j for j, (c, d) in enumerate(columns) if a <= d and b >= c)
            out[i, at] = f"{out[i, at]} {text}" if (i, at) in out else text
    return out


def test_cells_equal_plain_ones(spark):
    rnd, pages = random.Random(4), {}
    for page in range(120):
        pages[page] = [(rnd.choice("abc") * rnd.randrange(1, 4), (x := rnd.randrange(0, 300), y := rnd.randrange(0, 6) * 20 + rnd.randrange(6), x + rnd.randrange(1, 60), y + 10)) for _ in range(rnd.randrange(1, 25))]
    df = words(spark, [(page % 7, page, 0, t, list(b)) for page, found in pages.items() for t, b in found])
    got = {}
    for r in TB.cells(df).collect():
        got.setdefault(r.page_id, {})[r.row, r.column] = r.text
    assert got == {page: plain_cells(found) for page, found in pages.items()}


def grid(doc, page, lines, table=0):
    return [(doc, page, table, t, [100 * c, 30 * r, 100 * c + 20, 30 * r + 10]) for r, line in enumerate(lines) for c, t in enumerate(line) if t is not None]


def test_headers(spark):
    rows = [
        *grid(1, 1, [["A", None, "C"], ["1", "2", "3"]]),  # no header before it
        *grid(1, 2, [["A", "B", "C"], ["1", "2", "3"], [None, "5", None]]), *grid(1, 3, [["x", None, "y"], ["6", "7", "8"]]), *grid(1, 4, [["D", "D"], ["9", "0"]]), *grid(1, 5, [["z", None], ["1", "2"]]), *grid(1, 6, [["q", None, "r"], ["a", "b", "c"]]),
        *grid(2, 1, [["only"]]), *grid(2, 1, [["P", "Q"], ["1", "2"]], table=1), (3, 1, 0, None, [1, 2, 3, 4]), (3, 1, 0, "no box", None), (None, None, None, "N", [0, 0, 9, 9]),
    ]
    got = {(r.doc_id, r.page_id, r.table_id): (r.header, r.records) for r in TB.tables(TB.cells(words(spark, rows))).collect()}
    assert got[1, 1, 0] == (None, None)
    assert got[1, 2, 0] == (["A", "B", "C"], [{"A": "1", "B": "2", "C": "3"}, {"A": "", "B": "5", "C": ""}])
    assert got[1, 3, 0] == got[1, 2, 0][:1] + ([{"A": "6", "B": "7", "C": "8"}],)
    assert got[1, 4, 0] == (None, None)  # a name twice
    assert got[1, 5, 0] == (None, None)  # the header before has another width
    assert got[1, 6, 0] == (["A", "B", "C"], [{"A": "a", "B": "b", "C": "c"}])
    assert got[2, 1, 0] == (["only"], []) and got[2, 1, 1] == (["P", "Q"], [{"P": "1", "Q": "2"}])
    assert (3, 1, 0) not in got
    strict = {(r.doc_id, r.page_id): r.records for r in TB.tables(TB.cells(words(spark, rows)), compat=False).collect() if r.table_id == 0}
    assert strict[1, 4] == [{"0": "9", "1": "0"}] and strict[1, 1] == [{"0": "1", "1": "2", "2": "3"}]
    assert TB.tables(TB.cells(words(spark, []))).count() == 0


def test_titles_over_columns(spark):
    """A title that reaches over columns belongs to the first; a column that only one row has is one of its own."""
    rows = [(1, 1, 0, "a long title", [0, 0, 130, 10]), *[(1, 1, 0, t, [x, 30 * r, x + 20, 30 * r + 10]) for r, line in enumerate([("A", "B"), ("C", "D")], 1) for x, t in zip((0, 100), line, strict=True)], (1, 1, 0, "aside", [300, 62, 330, 70])]
    got = {(r.row, r.column): r.text for r in TB.cells(words(spark, rows)).collect()}
    assert got == {(0, 0): "a long title", (1, 0): "A", (1, 1): "B", (2, 0): "C", (2, 1): "D", (2, 2): "aside"}


def test_a_box_that_ends_before_it_begins(spark):
    """Its word met no column, so it was lost from the table."""
    rows = [*grid(1, 1, [["A", "B"], ["1", "2"]]), (1, 1, 0, "3", [110, 60, 105, 70])]
    assert {(r.row, r.column): r.text for r in TB.cells(words(spark, rows)).collect()}[2, 1] == "3"


def test_more_pages_than_are_swept_at_once(spark, monkeypatch):
    monkeypatch.setattr(TB, "PAGES", 3)
    rows = [w for page in range(20) for w in grid(page % 3, page, [["A", "B"], [f"v{page}", None], ["w", "x"]])]
    got = {r.page_id: r.lines for r in TB.grids(words(spark, rows)).collect()}
    assert got == {page: [["A", "B"], [f"v{page}", None], ["w", "x"]] for page in range(20)}
