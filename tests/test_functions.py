"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import geometry as G
from clausewright.functions import headings as H
from clausewright.functions import identifiers as I
from clausewright.functions import text as T
from clausewright.operators import tokenise as K


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "compat", "strict"), [
    ("a  b ( c ) , d", "a b (c), d", "a b (c), d"), ("x — y", "x • y", "x — y"), ("ab中文cd", "abcd", "abcd"), ("“q” ’s", "\"q\" 's", "\"q\" 's"), ("■ item § Ø", "• item ▪ •", "• item ▪ •"), ("", "", ""), (None, None, None),
])
def test_clean_text(spark, given, compat, strict):
    assert one(spark, given, T.clean_text) == compat
    assert one(spark, given, lambda c: T.clean_text(c, compat=False)) == strict


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.drop_cjk, "ab中", None), (T.drop_cjk, "ab", "ab"), (T.strip_punctuation, "a-b, (c)!", "a-b c"), (T.strip_punctuation, "", None),
    (T.split_camel_case, "theBorrower", "the Borrower"), (T.split_camel_case, "(Borrower)", "(Borrower)"), (T.light_punctuation, "a,, b;; c..", "a, b c."),
    (T.drop_clause_number, "21.2 Financial Covenants", " Financial Covenants"), (T.trim_heading, "1. Title:", "Title"), (T.ordinals_to_words, "1st Mortgage 22nd day", "First Mortgage Twenty-second day"),
    (T.roman_to_int, "xiv", 14), (T.roman_to_int, "MCMXC", 1990), (T.roman_to_int, "xq", None), (T.join_separated_letters, "F ORM OF I NCREASE C ONFIRMATION", "FORM OF INCREASE CONFIRMATION"),
    (T.is_date, "3 March 2024", True), (T.is_date, "soon", False), (T.is_float, "1.5", True), (T.is_float, "x", False), (T.is_heading_case, "Right of Prepayment", True), (T.is_heading_case, "this is text", False),
    (T.digits_to_words, "pay 21 now", "pay twenty-one now"), (T.clean_heading, 'Quotation Day ["Quotation Day"]', "Quotation Day "), (T.clean_spacing, "a ( b ) “c”", 'a (b) "c"'), (T.unicode_normalise, "ﬁ\t\tx", "fi x"),
])
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_spaced_variants(spark):
    assert one(spark, "ab", T.spaced_variants) == ["ab", "a b"]
    assert one(spark, "", T.spaced_variants) == []


@pytest.mark.parametrize(("text", "nxt", "element", "want"), [
    ("SCHEDULE 3 Fees", None, None, {"schedule_id": "3", "schedule": "Fees"}), ("SCHEDULE II", "The Lenders", None, {"schedule_id": "2", "schedule": "The Lenders"}), ("Schedule 2 to this deed", None, None, {}),
    ("THE SECOND SCHEDULE HEREINBEFORE REFERRED TO Forms", None, None, {"schedule_id": "2", "schedule": "Forms"}), ("PART A lenders", None, None, {"part_id": "A", "part": "lenders"}), ("12.3 Costs: all", None, None, {"section_id": "12", "sub_section_id": "3", "sub_section": "Costs"}),
    ("4 PREPAYMENT", None, None, {"section_id": "4", "section": "PREPAYMENT"}), ("4", "Next", "section", {"section_id": "4", "section": "Next"}), ("5.1", "Terms: x", "sub_section", {"section_id": "5", "sub_section_id": "1", "sub_section": "Terms"}), ("plain text", None, None, {}), (None, None, None, {}),
])
def test_headings(text, nxt, element, want):
    got = {k: v for k, v in H.heading_fields(text, nxt, element).items() if v}
    assert got == want


@pytest.mark.parametrize(("text", "want"), [('"Margin" means two per cent.', ("Margin", '"Margin" means two per cent.')), ('"A" or "B" means x', ("A or B", '"A" or "B" means x')), ("plain words", (None, None)), ("Rate means the rate", ("Rate", "means the rate")), (None, (None, None))])
def test_definitions(spark, text, want):
    assert tuple(one(spark, text, H.read_definition)) == want


@pytest.mark.parametrize(("text", "want"), [('ALPHA LIMITED as borrower (the "Borrower")', "Borrower"), ("BETA as lender of money (x", "lender"), ("GAMMA (agent)", "agent"), ("nobody", None), (None, None)])
def test_parties(spark, text, want):
    assert one(spark, text, H.read_party) == want


IDENTIFIERS = [
    (dict(section_id="0", definition="Borrower"), "Parties-Borrower"), (dict(section_id="0"), "Parties"), (dict(section_id="4.0", sub_section_id="2"), "Cl_4.2"), (dict(section_id="4", sub_section_id="2", list_id="(a)"), "Cl_4.2(a)"),
    (dict(section_id="1", sub_section_id="1", definition="Borrower", section="DEFINITIONS"), "Cl_1.1-Borrower"), (dict(section_id="1", sub_section_id="1", definition="Authorisation", list_id="(a)", section="DEFINITIONS"), "Cl_1.1-Authorisation_(a)"),
    (dict(schedule_id="1", part_id="A"), "Sched_1.A"), (dict(schedule_id="1", section_id="3", list_id="2"), "Sched_1_3_2"), (dict(section_id="4", sub_section_id="None"), "Cl_4"), (dict(), ""), (dict(section_id="0", definition="Agent", list_id="(1)"), "Parties-Agent"),
    (dict(section_id="5", sub_section_id="1", text_element="section"), "Cl_5"), (dict(section_id="4", sub_section_id="2", definition="T", list_id="(b)"), "Cl_4.2(b)-T"),
]


@pytest.mark.parametrize(("fields", "want"), IDENTIFIERS)
def test_identifier(spark, fields, want):
    names = ["section_id", "sub_section_id", "schedule_id", "part_id", "list_id", "definition", "text_element", "section", "sub_section", "text"]
    row = {n: None for n in names} | {"text_element": "paragraph", "text": "t"} | fields
    df = spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} string" for n in names))
    assert df.select(I.clause_identifier(*(F.col(n) for n in names)).alias("i")).first().i == want


def test_identifier_types(spark):
    df = spark.createDataFrame([("Cl_1.1-X",), ("Parties-B",), ("Cl_4.2(a)【X - Y】",), ("Sched_1",), ("zzz",)], "i string")
    assert [r.t for r in df.select(I.identifier_type(F.col("i")).alias("t")).collect()] == ["definitionClause", "partiesClause", "definitionClause", "schedule", None]
    assert [r.t for r in df.select(I.identifier_type(F.col("i"), compat=False).alias("t")).collect()][2] == "clause"


def test_boxes(spark):
    df = spark.createDataFrame([([0, 0, 10, 10], [10, 10, 20, 20], [11, 0, 12, 1])], "a array<int>, b array<int>, c array<int>")
    a, b, c = (F.col(x) for x in "abc")
    r = df.select(G.boxes_overlap(a, b), G.boxes_overlap(a, c), G.boxes_adjacent(a, c, 1, 1), G.outline_of(F.array(a, b)), G.normalise_box(F.array(F.lit(-5.0), F.lit(99.0), F.lit(700.0), F.lit(1.0)), F.lit(600), F.lit(800)), G.font_flags(F.lit("AA+Times-BoldMT"))).first()
    assert tuple(r) == (True, False, True, [0, 0, 20, 20], [0, 123, 1000, 1], 16)


def test_phrases():
    assert K.phrases("First part; second part; and third.") == ["First part;", "second part; and", "third."]
    assert K.phrases("See No. 5 here. Then go.") == ["See No. 5 here.", "Then go."]
    assert K.phrases("the number of days", compat=True) == ["the No. of days"] and K.phrases("the number of days", compat=False) == ["the number of days"]
    assert K.phrases("A:") == ["A:"] and K.phrases("") == [] and K.phrases(None) == []


def test_list_items():
    items, last = K.list_items("(a) first limb; (i) detail; (b) second limb")
    assert [i for i, _ in items] == ["(a)", "(a)(i)", "(b)"] and last == "(b)"
    assert K.list_items("(ii) more", "(a)(i)")[0][0][0] == "(a)(ii)"
    assert K.list_items("as in Clause (a) above")[0] == [(None, "as in Clause (a) above")]
    assert [i for i, _ in K.list_items("1. red 2. blue")[0]] == ["1.", "2."]
    # a number word before a number makes it a reference, as does a word such as Clause, a list of letters or a percentage
    assert K.list_items("1. one 2. two")[0] == [("1.", "one 2. two")]
    for whole in ("as in Clause (a) above", "limbs (a), (b) and (c) of it", "under paragraph (b) to (d)", "within (a) the period", "a rate of 2. 5% a year", "twenty (a) days", "see (a) and (b)"):
        assert [i for i, _ in K.list_items(whole)[0]] == [None], whole
    assert [i for i, _ in K.list_items("(a) fees; (b) costs; and (c) taxes")[0]] == ["(a)", "(b)", "(c)"]
    assert [i for i, _ in K.list_items("a) fees b) costs")[0]] == ["a)", "b)"]
    assert K.list_items("")[0] == [(None, "")]


def test_split_at_separators():
    assert K.split_at_separators("Name: Alpha. Next") == ["Name:", "Alpha.", "Next"]


def test_bullets_and_ngrams(spark):
    assert one(spark, "• charge over shares • account charge", K.split_bullets) == ["• charge over shares", "• account charge"]
    assert one(spark, "a b c", lambda c: K.ngrams(F.split(c, " "), 2)) == ["a b", "b c"]
