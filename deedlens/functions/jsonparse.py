"""A model's JSON answer as a map of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fields import FIELDS

MAP = "map<string,string>"


def parse_json(x: Column) -> Column:
    """From the first ``{`` to the last ``}``, else the whole; malformed gives an empty map.

    Numbers become strings and nested values stay JSON text.
    """
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(inner != "", inner).otherwise(x), MAP)
    return F.coalesce(parsed, F.from_json(F.lit("{}"), MAP))


def record(parsed: Column) -> Column:
    """The nine fields of a parsed answer, others dropped."""
    return F.struct(*[F.try_element_at(parsed, F.lit(f)).alias(f) for f in FIELDS])


def merge_answers(answers: Column) -> Column:
    """An array of maps folded in its order: later keys win, also with a null; a null map changes nothing."""
    def over(merged: Column, more: Column) -> Column:
        return F.when(more.isNull(), merged).otherwise(F.map_concat(F.map_filter(merged, lambda k, _: ~F.map_contains_key(more, k)), more))

    return F.aggregate(answers, F.from_json(F.lit("{}"), MAP), over)
