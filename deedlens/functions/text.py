"""Text rules as columns: cleaning, OCR corrections, title case, answers."""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"

# Letters that OCR confuses with digits, and the one word rule
# that can still match after the letter rules.
OCR_LETTERS, OCR_DIGITS = "lIOoSsGg", "11005569"
OCR_WORD = ("Lende7", "Lender")

#: Cleaning rules in order.  All ignore case; later rules see earlier results.
CLEAN_RULES = (
    (r"(?U)\s+", " "),
    (r"(?U)\bO\b", "0"),
    (r"(?U)\bl\b", "1"),
    (r"(?U)\bS\b", "5"),
    (r"(?U)\bRILS\b", "NMLS"),
    (r"(?U)\bNRLS\b", "NMLS"),
    (r"(?U)\bARLS\b", "NMLS"),
    (r"\$\s+", r"\$"),
    (r"(\d)\s+(\d)", "$1$2"),
    (r"\b(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})\b", "$1/$2/$3"),
    (r"[|_]{2,}", ""),
    (r"[\[\]{}]", ""),
)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: A rule in steps: it yields each value that later steps use, gets a column that holds it, and returns its result.
Steps = Generator[Column, Column, Column]


def in_one(steps: Steps, value: Column | None = None) -> Column:
    """A rule's steps as one column, by lambdas; ``staged`` runs many rules over whole projections."""
    try:
        step = steps.send(value)
    except StopIteration as end:
        return end.value
    return bound(step, lambda v: in_one(steps, v))


def apart(value: Column, beside: Column) -> Column:
    """``value``, in a projection that is compiled apart from its neighbours, in small methods.

    A generated stage is one method, and the JVM leaves those over 8,000 bytes uncompiled, which is many
    times slower.  A projection with a lambda stands outside of stages; this one is of a null test of ``beside``.
    """
    return F.when(bound(beside.isNull(), lambda null: null).isNotNull(), value)


def with_apart(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds the columns in one projection that is compiled apart."""
    first = next(iter(columns))
    return df.withColumns(columns | {first: apart(columns[first], F.col(df.columns[0]))})


def staged(df: DataFrame, rules: dict[str, Steps]) -> DataFrame:
    """Adds a column for each rule, the rules' steps side by side in one projection a step.

    Lambdas are interpreted row by row, projections are compiled: this is for rules that run on every record.
    """
    running, results, held, sent = dict(rules), {}, [], {}
    for level in range(1_000):
        ready = {}
        for name, steps in list(running.items()):
            try:
                ready[f"_{name}_{level}"] = (name, steps.send(sent.get(name)))
            except StopIteration as end:
                results[name] = end.value
                del running[name]
        if not running:
            break
        df = with_apart(df, {held_as: step for held_as, (_, step) in ready.items()})
        held += ready
        sent = {name: F.col(held_as) for held_as, (name, _) in ready.items()}
    return with_apart(df, results).drop(*held)


#: What ``(?U)\s`` matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Python's strip: white space of any kind on both ends."""
    return F.btrim(x, F.lit(WHITE))


def strip_held(x: Column) -> Column:
    """``strip`` of a column that holds its value: texts between two visible ASCII characters are taken as they are."""
    first, last = F.ascii(x), F.ascii(F.substring(x, -1, 1))
    return F.when((first > 32) & (first < 127) & (last > 32) & (last < 127), x).otherwise(strip(x))


def is_ascii(x: Column) -> Column:
    """Whether every character is one byte."""
    return F.octet_length(x) == F.char_length(x)


def clean_text(x: Column) -> Column:
    """OCR text cleaned by the ordered rules; null and empty give empty."""
    x = F.coalesce(x, F.lit(""))
    for pattern, new in CLEAN_RULES:
        x = F.regexp_replace(x, "(?i)" + pattern, new)
    return strip(x)


def ocr_correct(x: Column) -> Column:
    """Letters to digits everywhere, then the surviving word rule."""
    return F.replace(F.translate(x, OCR_LETTERS, OCR_DIGITS), F.lit(OCR_WORD[0]), F.lit(OCR_WORD[1]))


def digits_corrected(x: Column) -> Column:
    """Intended variant for numeric fields: misread letters to digits."""
    return F.translate(x, OCR_LETTERS, OCR_DIGITS)


#: A control character; texts that hold it take the longer way.
MARK = "\x01"


def title_case(x: Column) -> Column:
    """A letter after any non-letter is upper case, all others lower case."""
    words = F.regexp_extract_all(x, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))
    # of ASCII texts ``initcap`` makes it, which takes words at blanks: a marked blank stands before words elsewhere
    marked = F.initcap(F.regexp_replace(F.lower(x), "(?<=[^a-z ])(?=[a-z])", MARK + " "))
    return F.when(is_ascii(x) & ~x.contains(MARK), F.replace(marked, F.lit(MARK + " "), F.lit(""))).otherwise(F.array_join(cased, ""))


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; both ends are cut."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def squeeze_held(x: Column) -> Column:
    """``squeeze`` of a column that holds its value: only texts with other white space than single blanks are rewritten."""
    tidy = is_ascii(x) & ~x.contains("  ") & ~x.rlike(r"[\t-\r]")
    return F.when(tidy, strip_held(x)).otherwise(squeeze(x))


def without_parens(x: Column) -> Column:
    """Without parenthesised parts."""
    return F.regexp_replace(x, r"\([^)]+\)", "")


def parse_scalar(x: Column) -> Column:
    """A model's one-value answer: unquoted; ``null`` and empty give null."""
    y = F.regexp_replace(strip(x), "^[\"']+|[\"']+\\z", "")
    return F.when((y != "") & (F.lower(y) != "null"), y)
