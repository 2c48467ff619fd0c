"""Golden rows and quirks of the text rules and validators."""

import pytest
from pyspark.sql import functions as F

from deedlens.fields import FIELDS
from deedlens.functions import text as t
from deedlens.functions import validate as v
from deedlens.functions.jsonparse import parse_json, record
from deedlens.functions.scoring import extraction_confidence
from deedlens.operators import extract, validation
from deedlens.plans.pipeline import process


def column(spark, build, values):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


CLEAN = {
    "Elizabeth   Howerton and Travis Howerton\n$475,950.OO\nNRLS ID: 390l": "Elizabeth Howerton and Travis Howerton $475,950.OO NMLS ID: 390l",
    "$  475 , 950 . 00": "$475 , 950 . 00",
    "RILS ID: l234": "NMLS ID: l234",
    "1 2 3 4": "12 34",
    "Clerk's Office [x] |__| 4 / 1 / 2025 12 34": "Clerk'5 Office x  4 / 1 / 20251234",
    None: "",
    "": "",
    "élan l L": "élan 11",
    "a b": "a b",
}


def test_clean_text(spark):
    assert column(spark, t.clean_text, CLEAN) == list(CLEAN.values())


def test_ocr_and_title(spark):
    names = ["US Mortgage Corporation", "Lende7 Bank", "Borrower5", "RILS"]
    assert column(spark, t.ocr_correct, names) == ["U5 M0rt9a9e C0rp0rati0n", "Lender Bank", "B0rr0wer5", "R1L5"]
    assert column(spark, t.title_case, ["e1izabeth o'brien mary-jane", "w1ll1am", ""]) == ["E1Izabeth O'Brien Mary-Jane", "W1Ll1Am", ""]


def test_parse_scalar(spark):
    got = column(spark, t.parse_scalar, ['"A B"', "null", " NULL ", "", "''", "x", None])
    assert got == ["A B", None, None, None, None, "x", None]


AMOUNTS = {
    "475,950.": (True, "$475,950.00", 90.0), "10000000": (True, "$10,000,000", 90.0), "10000000.01": (False, "10000000.01", 10.0),
    "$9,999.99": (False, "$9,999.99", 10.0), "$475,950.123": (True, "$475,950.12", 90.0), "Smith, $475,950.00": (False, "Smith, $475,950.00", 10.0),
    "12 months $475,950": (False, "12 months $475,950", 10.0), " null ": (False, "null", 10.0), "   ": (False, "", 10.0), None: (False, "", 0.0), "null": (False, "", 0.0),
}
NMLS = {
    "NMLS 12 3456 7890": (True, "3456", 95.0), "123": (False, "123", 20.0), "123456789": (False, "123456789", 20.0), "390l": (False, "390l", 20.0), None: (False, "", 0.0),
}
DATES = {
    "12/31/2024": (True, "12/31/2024", 90.0), "2025-04-01": (True, "2025-04-01", 85.0), "Apr 1, 2025": (True, "Apr 1, 2025", 80.0), "1 April 2025": (True, "1 April 2025", 75.0),
    "2/30/2024 or April 1, 2025": (True, "April 1, 2025", 80.0), "1/1/1980": (False, "1/1/1980", 15.0), "April 1 2025": (False, "April 1 2025", 15.0),
    "Sept 5, 2024": (False, "Sept 5, 2024", 15.0), "1/1/2032": (False, "1/1/2032", 15.0), None: (False, "", 0.0),
}
PERSONS = {"Frank Baker": (True, "Frank Baker", 85.0), "Frank": (True, "Frank", 60.0), "mary-jane d'arcy": (True, "Mary-Jane D'Arcy", 85.0), "Will": (False, "Wi11", 30.0)}
COMPANIES = {"Lende7 Bank": (True, "Lender Bank", 80.0), "A & B; Co": (False, "A & B; C0", 30.0), "none": (False, "", 0.0)}
BORROWERS = {
    "Frank Baker and Mary Baker (husband and wife)": (True, "Frank Baker and Mary Baker (husband and wife)", 95.0),
    "Frank Baker (married)": (True, "Frank Baker (married)", 95.0), "Frank": (True, "Frank", 60.0), "(married)": (False, "(married)", 10.0),
}


@pytest.mark.parametrize(
    "rule, cases",
    [(v.loan_amount, AMOUNTS), (v.nmls_id, NMLS), (lambda x: v.date(x, 2026), DATES), (v.person, PERSONS), (v.company, COMPANIES), (v.borrowers, BORROWERS)],
    ids=["amount", "nmls", "date", "person", "company", "borrowers"],
)
def test_validators(spark, rule, cases):
    assert [tuple(r) for r in column(spark, rule, cases)] == list(cases.values())


A = ("Elizabeth Howerton and Travis Howerton (spouses)", "$475,950.00", "April 1, 2025", "Albany County Clerk's Office", "US Mortgage Corporation", "3901", None, "William John Lane", "65175")
B = A[:5] + ("390l", None, "William John Lane", "65I75")
GOOD = ("Elizabeth Howerton and Travis Howerton (spouses)", "$475,950.00", "April 1, 2025", None, "US Mortgage Corporation", "3901", None, None, None)
EMPTY = (None,) * 9


def records(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, " + ", ".join(f"{f} string" for f in FIELDS))


def test_golden_records(spark):
    a, b, good, empty = process(records(spark, A, B, GOOD, EMPTY), 2026).orderBy("doc_id").collect()
    assert [a["overall"], b["overall"], good["overall"], empty["overall"]] == [74.375, 55.625, 78.0, 0.0]
    assert [r["is_valid"] for r in (a, b, good, empty)] == [True, True, True, False]
    assert [round(r["completeness"], 1) for r in (a, b, good, empty)] == [88.9, 88.9, 55.6, 0.0]
    assert a["issues"] == ["borrowers: Low confidence (45.0%)", "loan_originator_name: Low confidence (30.0%)"]
    assert a["final"]["borrowers"] == "E1izabeth H0wert0n and Travi5 H0wert0n (5p0u5e5)"
    assert a["final"]["loan_amount"] == "475,950.00"
    assert a["corrected"]["lender_name"] == "U5 M0rt9a9e C0rp0rati0n"
    assert a["final"]["loan_originator_name"] == "Wi111am J0Hn Lane"
    assert (b["corrected"]["lender_nmls_id"], b["final"]["lender_nmls_id"], b["final"]["loan_originator_nmls_id"]) == ("390l", "390", "65")
    assert a["field_scores"]["broker_name"] == 100.0 and "broker_name" in a["field_breakdown"]["high_confidence"]
    assert empty["recommendations"][-1] == "Consider manual review due to low overall confidence"


def test_intended_corrections(spark):
    (b,) = process(records(spark, B), 2026, fixups=True).collect()
    assert b["final"]["lender_nmls_id"] == "3901" and b["final"]["loan_originator_nmls_id"] == "65175"
    assert b["final"]["loan_amount"] == "$475,950.00" and b["final"]["lender_name"] == "US Mortgage Corporation"


def test_confidence(spark):
    df = records(spark, A, B, GOOD, EMPTY)
    got = df.select("doc_id", F.round(extraction_confidence({f: F.col(f) for f in FIELDS}), 4).alias("c")).orderBy("doc_id").collect()
    assert [r["c"] for r in got] == [92.2222, 86.2222, 68.8889, 30.0]
    assert df.select(extraction_confidence({f: F.col(f) for f in FIELDS}, F.lit(False)).alias("c")).first()["c"] == 0.0


def test_json(spark):
    got = column(spark, lambda x: record(parse_json(x))["borrowers"], ['x {"borrowers": "A", "n": 1} y', '{"borrowers": 5}', "{broken", None, "{}"])
    assert got == ["A", "5", None, None, None]


def test_sections_and_prompt(spark):
    s = column(spark, lambda x: extract.split_sections(x), ["0123456789", ""])
    assert tuple(s[0]) == ("01", "234567", "89") and tuple(s[1]) == ("", "", "")
    assert column(spark, lambda x: extract.render_prompt("a {document_text} b", x), ["T"]) == ["a T b"]
    with pytest.raises(ValueError):
        extract.field_prompt("nothing", strict=True)


def test_patterns_run_once(spark):
    """Each pattern stands once in the optimised plan for each field that it judges."""
    plan = validation.validate_all(records(spark, A), 2026)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and "Python" not in plan.executedPlan().toString()
    text = plan.optimizedPlan().toString()
    assert text.count(v.AMOUNT) == 1 and text.count(v.RELATION) == 1 and text.count(r"\([^)]+\)") == 1
    assert [text.count(pattern) for pattern, _ in v.DATE_RULES] == [1, 1, 1, 1]
    assert text.count(v.PERSON) == 2 and text.count(v.COMPANY) == 3 and text.count(v.DIGITS) == 2


def test_validators_are_compiled(spark):
    """Lambdas are interpreted row by row: no pattern of a validator runs within one."""
    import re

    text = validation.validate_all(records(spark, A), 2026)._jdf.queryExecution().optimizedPlan().toString()
    lambdas = re.findall(r"lambdafunction\((.*?), lambda ", text)
    assert not [x for x in lambdas if "RLIKE" in x or "regexp" in x or "gettimestamp" in x]


def test_fast_paths_equal_the_patterns(spark):
    """White space of every kind, letters whose case leaves or enters ASCII, several runs of digits."""
    both = lambda quick, plain, values: [r for r in column(spark, lambda x: F.struct(quick(x).alias("a"), plain(x).alias("b")), values) if r["a"] != r["b"]]
    white = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    ends = [f"{c}x Y{c}" for c in map(chr, range(1, 0x3100))]
    assert both(t.strip, white, ends) == both(t.strip_held, white, ends) == []
    assert both(t.squeeze_held, lambda x: white(F.regexp_replace(x, r"(?U)\s+", " ")), ends + [f"a{c}{d}b" for c in "\t \x85\u2003" for d in " \n"]) == []
    spelled = lambda x: "".join(c.upper() if not x[i - 1 : i].isalpha() else c.lower() for i, c in enumerate(x))
    names = [f"{a}{b}x{a}Y" for a in map(chr, range(1, 128)) for b in map(chr, range(1, 128))]
    assert column(spark, t.title_case, names) == [spelled(x) for x in names]
    assert column(spark, t.title_case, ["\u017fmith \u0131an", "9", "\u00c9LAN vital", None]) == ["Smith Ian", "9", "\u00c9lan Vital", None]
    assert [tuple(r) for r in column(spark, v.borrowers, ["\u017fam \u0131an", "\u00e9lan vital", "Fr)nk", "Mark (x) Tanner"])] == [
        (True, "\u017fam \u0131an", 85.0), (False, "\u00e9lan vital", 30.0), (False, "Fr)nk", 30.0), (True, "Mark (x) Tanner", 85.0)]
    assert [r[1] for r in column(spark, v.nmls_id, ["12 3456 7890", "no", "a1234b", "12345"])] == ["3456", "no", "1234", "12345"]
    assert [r[1:] for r in column(spark, lambda x: v.date(x, 2026), ["May 1, 2025", "MayMay 1, 2025", "2/30/2024 1 Dec 2020"])] == [
        ("May 1, 2025", 80.0), ("MayMay 1, 2025", 15.0), ("1 Dec 2020", 75.0)]


def test_settings_reach_the_validators(spark):
    from deedlens.config import ValidationSettings

    own = ValidationSettings(max_loan_amount=1000.0, nmls_max_length=4, required_fields=("recording_date",))
    a, empty = process(records(spark, A, EMPTY), 2026, settings=own).orderBy("doc_id").collect()
    assert (a["v_loan_amount"]["valid"], a["v_lender_nmls_id"]["valid"], a["v_loan_originator_nmls_id"]["valid"]) == (False, True, False)
    assert not empty["is_valid"]
    (b,) = process(records(spark, (None, *A[1:])), 2026, settings=own).collect()
    assert b["is_valid"] == (b["overall"] >= 50)


def test_fractional_confidences(spark):
    from deedlens.operators import pages

    df = spark.createDataFrame([(1, 0.5), (1, 95.7), (1, 80.2), (1, -1.0), (2, -1.0), (3, 0.0)], "doc_id int, conf double")
    by = lambda op: {r["doc_id"]: round(r["confidence"], 4) for r in op(df, ["doc_id"]).collect()}
    assert by(pages.page_confidence) == {1: 87.5, 2: 0.0, 3: 0.0}
    assert by(pages.page_confidence_simple) == {1: 58.8, 2: 0.0, 3: 0.0}
