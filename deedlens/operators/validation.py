"""Whole-record validation, corrections and the quality report.

All are projections: no shuffle, no Python.  Each validator's struct is built
once as a column and only its fields are used afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ValidationSettings
from ..fields import FIELDS, OPTIONAL
from ..functions import validate as v
from ..functions.text import apart, ocr_correct, squeeze_held, staged, with_apart


#: The fields that are licence numbers.
IDS = ("lender_nmls_id", "loan_originator_nmls_id")


def validators(as_of_year: int, settings: ValidationSettings = v.DEFAULTS, fixups: bool = False) -> dict:
    """The validator of every field, in steps."""
    company = lambda x: v.company_steps(x, fixups)
    nmls = lambda x: v.nmls_id_steps(x, settings, fixups)
    return {
        "borrowers": lambda x: v.borrowers_steps(x, fixups),
        "loan_amount": lambda x: v.loan_amount_steps(x, settings, fixups),
        "recording_date": lambda x: v.date_steps(x, as_of_year),
        "recording_location": company,
        "lender_name": company,
        "lender_nmls_id": nmls,
        "broker_name": lambda x: v.broker_steps(x, fixups),
        "loan_originator_name": lambda x: v.person_steps(x, fixups),
        "loan_originator_nmls_id": nmls,
    }


def listed(*items: tuple[Column, Column]) -> Column:
    """The texts whose conditions hold, in order."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(holds, F.array(text)).otherwise(none) for holds, text in items])


def _checked() -> Column:
    """The nine outcomes as one array, in field order."""
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.col(f"v_{f}.valid").alias("valid"), F.col(f"v_{f}.value").alias("value"), F.col(f"v_{f}.score").alias("score")
            )
            for f in FIELDS
        ]
    )


def validate_all(df: DataFrame, as_of_year: int, settings: ValidationSettings = v.DEFAULTS, fixups: bool = False) -> DataFrame:
    """Adds ``v_<field>``, ``corrected``, ``field_scores``, ``issues``, ``overall``, ``is_valid``."""
    rules = validators(as_of_year, settings, fixups)
    df = staged(df, {f"v_{f}": rules[f](F.col(f).cast("string")) for f in FIELDS})
    df = df.withColumn("checked", _checked())
    df = df.withColumn(
        "corrected", F.struct(*[F.nullif(F.col(f"v_{f}.value"), F.lit("")).alias(f) for f in FIELDS])
    ).withColumn("field_scores", F.struct(*[F.col(f"v_{f}.score").alias(f) for f in FIELDS]))
    valid, value, score = (lambda f, part=part: F.col(f"v_{f}.{part}") for part in ("valid", "value", "score"))

    def issue(f: str) -> tuple[Column, Column]:
        low, none = ~valid(f) & (value(f) != ""), F.lit(False) if f == OPTIONAL else value(f) == ""
        text = F.concat(F.lit(f"{f}: Low confidence ("), score(f).cast("string"), F.lit("%)"))  # scores have one decimal
        return low | none, F.when(low, text).otherwise(f"{f}: Missing or invalid data")

    counted = [f for f in FIELDS if f != OPTIONAL]
    df = with_apart(df, {"issues": listed(*map(issue, FIELDS))})
    df = df.withColumns({
        "_n": sum((F.when(value(f) != "", 1).otherwise(0) for f in counted), F.lit(0)),
        "_total": sum((F.when(value(f) != "", score(f)).otherwise(0.0) for f in counted), F.lit(0.0)),
    })
    df = df.withColumn("overall", F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")).otherwise(0.0)).drop("_n", "_total")
    present = F.lit(True)
    for f in settings.required_fields:
        present = present & (F.col(f"v_{f}.value") != "")
    return df.withColumn("is_valid", present & (F.col("overall") >= 50))


def regex_corrections(values: dict[str, Column], fixups: bool = False, done: tuple[str, ...] = ()) -> dict[str, Column]:
    """The second correction pass over corrected values; null and empty stay.

    The names in ``done`` have their letters corrected, which a second time changes nothing.
    """
    out = dict(values)
    amount = values["loan_amount"]
    if not fixups:  # the intended variant keeps the amount and the names as validated
        bare = F.regexp_replace(F.regexp_replace(amount, r"[$]\s*", ""), r"(\d)\s+(\d)", "$1$2")
        out["loan_amount"] = F.when(amount != "", F.regexp_replace(bare, "[Oo]", "0")).otherwise(amount)
        for f in ("borrowers", "lender_name", "broker_name", "loan_originator_name"):
            x = values[f]
            out[f] = F.when((x != "") & (x != "null"), squeeze_held(x) if f in done else ocr_correct(squeeze_held(x))).otherwise(x)
    for f in IDS:
        out[f] = v.digits_kept(values[f])
    return out


def with_corrections(df: DataFrame, fixups: bool = False) -> DataFrame:
    """Adds ``final``: the corrected values after the second pass."""
    df = staged(df, {f"_final_{f}": v.digits_kept_steps(F.col(f"corrected.{f}")) for f in IDS})
    final = regex_corrections({f: F.col(f"corrected.{f}") for f in FIELDS}, fixups, ("lender_name", "broker_name")) | {f: F.col(f"_final_{f}") for f in IDS}
    first = FIELDS[0]
    final[first] = apart(final[first], F.col(df.columns[0]))
    return df.withColumn("final", F.struct(*[final[f].alias(f) for f in FIELDS])).drop(*[f"_final_{f}" for f in IDS])


def quality_report(df: DataFrame) -> DataFrame:
    """Adds ``completeness``, ``field_breakdown`` and ``recommendations`` to validated rows."""
    names = lambda keep: listed(*[(keep(F.col(f"v_{f}.score")), F.lit(f)) for f in FIELDS])
    df = df.withColumn(
        "field_breakdown",
        F.struct(
            names(lambda score: score >= 80).alias("high_confidence"),
            names(lambda score: (score >= 50) & (score < 80)).alias("medium_confidence"),
            names(lambda score: score < 50).alias("low_confidence"),
        ),
    )
    known = lambda x: (x != "") & ~((F.octet_length(x) == 4) & (F.lower(x) == "null"))
    complete = sum((F.when(known(F.col(f"v_{f}.value")), 1).otherwise(0) for f in FIELDS), F.lit(0))
    low = F.col("field_breakdown.low_confidence")
    missing = lambda f, text: (F.col(f"v_{f}.value") == "", F.lit(text))
    # the texts below are fixed values
    return df.withColumn("completeness", complete / len(FIELDS) * 100).withColumn(
        "recommendations",
        listed(
            (F.size(low) > 0, F.concat(F.lit("Review low confidence fields: "), F.array_join(low, ", "))),
            missing("borrowers", "Borrower information is missing - critical field"),
            missing("loan_amount", "Loan amount is missing - critical field"),
            missing("lender_name", "Lender name is missing - critical field"),
            (F.col("overall") < 70, F.lit("Consider manual review due to low overall confidence")),
        ),
    )
