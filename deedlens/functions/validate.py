"""Field validators: each gives a struct (valid, value, score).

``fixups=False`` is the observable behaviour of the rules as they stand;
``fixups=True`` is the intended one (letters become digits in numeric fields
only, names keep their letters).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ValidationSettings
from .text import OCR_LETTERS, OCR_WORD, Steps, digits_corrected, in_one, is_ascii, ocr_correct, strip, strip_held, title_case, without_parens

DEFAULTS = ValidationSettings()


def outcome(valid: Column, value: Column, score: Column) -> Column:
    """A validator's result."""
    return F.struct(valid.cast("boolean").alias("valid"), value.alias("value"), score.cast("double").alias("score"))


def is_missing(x: Column) -> Column:
    """Null, empty, ``null`` or ``none``; blanks around them count as text."""
    return x.isNull() | ((F.octet_length(x) <= 4) & F.lower(x).isin("null", "none", ""))


def _missing() -> Column:
    return outcome(F.lit(False), F.lit(""), F.lit(0.0))


#: What the first amount in a text looks like, and the runs of digits of an id.
AMOUNT, DIGITS = r"\$?([\d,]+\.?\d{0,2})", r"(\d+)"


def loan_amount_steps(x: Column, settings: ValidationSettings = DEFAULTS, fixups: bool = False) -> Steps:
    """First amount in the text, within bounds, as ``$`` and thousands."""
    found = yield F.regexp_extract(digits_corrected(x) if fixups else x, AMOUNT, 1)
    bare = F.replace(found, F.lit(","), F.lit(""))
    n = yield F.when(F.length(bare) <= 300, bare).try_cast("double")
    shown = F.concat(F.lit("$"), F.when(found.contains("."), F.format_number(n, 2)).otherwise(F.format_number(n, 0)))
    good = (n >= settings.min_loan_amount) & (n <= settings.max_loan_amount)
    return F.when(is_missing(x), _missing()).when(good, outcome(F.lit(True), shown, F.lit(90.0))).otherwise(outcome(F.lit(False), strip_held(x), F.lit(10.0)))


def digit_runs(x: Column) -> Column:
    """All runs of digits; a text of nothing else is one."""
    return F.when(~x.rlike(r"\D"), F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(DIGITS), F.lit(1)))


def longest(runs: Column) -> Column:
    """The longest of some runs, the first of equals; empty if there is none."""
    of_many = F.aggregate(runs, F.lit(""), lambda best, v: F.when(F.length(v) > F.length(best), v).otherwise(best))
    return F.when(runs.isNotNull(), F.when(F.size(runs) <= 1, F.coalesce(F.get(runs, F.lit(0)), F.lit(""))).otherwise(of_many))


def digits_kept_steps(x: Column) -> Steps:
    """The longest run of digits, or the text as it is where there is none."""
    runs = yield digit_runs(x)
    return F.coalesce(F.nullif(longest(runs), F.lit("")), x)


def nmls_id_steps(x: Column, settings: ValidationSettings = DEFAULTS, fixups: bool = False) -> Steps:
    """Longest digit run of an allowed length."""
    runs = yield digit_runs(digits_corrected(x) if fixups else x)
    run = yield longest(runs)
    good = (F.length(run) >= settings.nmls_min_length) & (F.length(run) <= settings.nmls_max_length)
    return F.when(is_missing(x), _missing()).when(good, outcome(F.lit(True), run, F.lit(95.0))).otherwise(outcome(F.lit(False), strip_held(x), F.lit(20.0)))


#: A date's pattern and the formats that parse it, in order of preference.
DATE_RULES = (
    (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", ("M/d/yyyy",)),
    (r"\b(\d{4}-\d{1,2}-\d{1,2})\b", ("yyyy-M-d",)),
    (r"\b([A-Za-z]+ \d{1,2}, \d{4})\b", ("MMMM d, yyyy", "MMM d, yyyy")),
    (r"\b(\d{1,2} [A-Za-z]+ \d{4})\b", ("d MMMM yyyy", "d MMM yyyy")),
)
FIRST_YEAR, YEARS_AHEAD = 1990, 5


def date_steps(x: Column, as_of_year: int) -> Steps:
    """The first date that parses and lies in range, as written.

    A rule's pattern runs once, and its text is parsed only where no rule before it has found a date.
    """
    first, last = FIRST_YEAR, as_of_year + YEARS_AHEAD
    texts = yield F.array(*[F.regexp_extract(x, pattern, 1) for pattern, _ in DATE_RULES])

    def by_rule(i: int, formats: tuple[str, ...]) -> Column:
        text = F.get(texts, F.lit(i))
        # each format is an optional section of one formatter: a text that fits only the second costs no exception
        year = F.year(F.when(text != "", F.try_to_timestamp(text, F.lit(formats[0] if len(formats) == 1 else "".join(f"[{f}]" for f in formats)))))
        in_range = F.abs(year * 2 - (first + last)) <= last - first  # with the year, which is parsed for it, named once
        return F.when(in_range, F.struct(text.alias("value"), F.lit(90.0 - 5 * i).alias("score")))

    found = yield F.coalesce(*[by_rule(i, formats) for i, (_, formats) in enumerate(DATE_RULES)])
    return F.when(is_missing(x), _missing()).when(found.isNotNull(), outcome(F.lit(True), found["value"], found["score"])).otherwise(
        outcome(F.lit(False), strip_held(x), F.lit(15.0)))


#: The characters of a person's and of a company's name.
PERSON, COMPANY = r"^[A-Za-z\s.\-']+$", r"^[A-Za-z0-9\s.\-&,'\"]+$"


def _corrected(x: Column, fixups: bool) -> Column:
    return strip_held(x) if fixups else ocr_correct(strip_held(x))


def _two_words(name: Column) -> Column:
    return name.rlike(r"\S\s+\S")


def person_steps(x: Column, fixups: bool = False) -> Steps:
    """A person's name in title case."""
    corrected = yield _corrected(x, fixups)
    name = yield title_case(corrected)
    return F.when(is_missing(x), _missing()).when(
        name.rlike(PERSON), outcome(F.lit(True), name, F.when(_two_words(name), 85.0).otherwise(60.0))
    ).otherwise(outcome(F.lit(False), name, F.lit(30.0)))


def company_steps(x: Column, fixups: bool = False) -> Steps:
    """A company's name."""
    name = yield _corrected(x, fixups)
    good = yield name.rlike(COMPANY)
    return F.when(is_missing(x), _missing()).otherwise(outcome(good, name, F.when(good, 80.0).otherwise(30.0)))


def broker_steps(x: Column, fixups: bool = False) -> Steps:
    """A broker's name: a company's, or none."""
    judged = yield from company_steps(x, fixups)
    none = F.coalesce(x, F.lit("")).isin("") | ((F.octet_length(x) == 4) & (F.lower(x) == "null"))
    return F.when(none, outcome(F.lit(True), F.lit(""), F.lit(100.0))).otherwise(judged)


#: The relations that borrowers' names are followed by.
RELATION = r"(?i)\((husband and wife|spouses|married)\)"


def borrowers_steps(x: Column, fixups: bool = False) -> Steps:
    """Borrowers: scored without their parenthesised relation, returned as given."""
    bare = yield F.when(x.contains("("), without_parens(x)).otherwise(x)
    names = yield strip_held(bare)
    # a letter that is corrected becomes a digit, which no name has, whatever else is corrected
    corrected = names if fixups else F.when(names.rlike(f"[{OCR_LETTERS}]"), F.lit("0")).otherwise(F.replace(names, *map(F.lit, OCR_WORD)))
    # case matters to no pattern, but where it turns other letters into ASCII ones
    name = yield F.when(is_ascii(names), corrected).otherwise(title_case(corrected))
    base = F.when(is_missing(names), 0.0).when(~name.rlike(PERSON), 30.0).when(_two_words(name), 85.0).otherwise(60.0)
    n = yield base
    related = F.when(x.contains("(") & x.rlike(RELATION), 10.0).otherwise(0.0)
    joined = F.when(F.lower(names).contains(" and "), 5.0).otherwise(0.0)
    value = title_case(strip(x)) if fixups else strip_held(x)
    return F.when(is_missing(x), _missing()).otherwise(outcome(n > 30, value, F.least(n + related + joined, F.lit(95.0))))


def _rule(steps: Callable[..., Steps]) -> Callable[..., Column]:
    @functools.wraps(steps)
    def rule(*args, **how) -> Column:
        return in_one(steps(*args, **how))

    return rule


loan_amount, nmls_id, date, person, company, borrowers, digits_kept = map(
    _rule, (loan_amount_steps, nmls_id_steps, date_steps, person_steps, company_steps, borrowers_steps, digits_kept_steps))
