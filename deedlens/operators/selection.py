"""Best candidate and field-wise merge.

The first of equals wins everywhere, so candidates carry an explicit ``rank``
and argmax is ``max(struct(score, -rank, ...))``: one partial-aggregated shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import FIELDS
from ..functions.scoring import extraction_confidence, is_filled
from ..functions.text import bound

MIN_CONFIDENCE = 30.0


def argmax(score: Column, rank: Column, value: Column) -> Column:
    """Aggregate: the value of the largest score, the smallest rank of equals."""
    return F.max(F.struct(score.alias("score"), (-rank).alias("order"), value.alias("value")))["value"]


def best_ocr(df: DataFrame, keys: list[str], preferred: str | None = None) -> DataFrame:
    """The best engine's result per key: columns engine, text, confidence, rank.

    A preferred engine wins if its text is not blank; else the largest confidence.
    """
    wanted = F.lit(0)
    if preferred:
        wanted = F.when((F.col("engine") == preferred) & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), 1).otherwise(0)
    chosen = F.max(
        F.struct(wanted.alias("wanted"), F.col("confidence").alias("score"), (-F.col("rank")).alias("order"), F.struct("engine", "text", "confidence").alias("value"))
    )["value"]
    return df.groupBy(*keys).agg(chosen.alias("best")).select(*keys, "best.*")


def strategies(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """All strategies' results, ranked in the order given."""
    ranked = [df.withColumns({"strategy": F.lit(name), "rank": F.lit(i)}) for i, (name, df) in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def merge_aggregates() -> list[Column]:
    """Per field the value of the largest length x confidence, first of equals."""
    out = []
    for f in FIELDS:
        x = F.col(f)
        score = F.when(is_filled(x), F.length(x) * F.col("confidence") / 100)
        out.append(F.max(F.when(is_filled(x), F.struct(score.alias("score"), (-F.col("rank")).alias("order"), x.alias("value"))))["value"].alias(f))
    return out


def merge_extractions(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One merged record per key: nine fields, confidence, attempts, processing_time, errors."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "errors")))  # one row a strategy
    merged = df.groupBy(key).agg(
        *merge_aggregates(),
        F.sum("attempts").alias("attempts"),
        F.sum("processing_time").alias("processing_time"),
        F.flatten(F.transform(ordered, lambda r: r["errors"])).alias("errors"),
    )
    any_field = reduce(lambda a, b: a | b, [is_filled(F.col(f)) for f in FIELDS])
    return merged.withColumn("confidence", extraction_confidence({f: F.col(f) for f in FIELDS}, any_field)).withColumn(
        "strategy_used", F.lit("merged")
    )


def best_extraction(df: DataFrame, key: str = "doc_id", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The best strategy's record, or the merged one where it is strictly better
    and the best is below ``min_confidence``.  One shuffle for both."""
    best = argmax(F.col("confidence"), F.col("rank"), F.struct(*FIELDS, F.col("confidence"), F.col("strategy"), F.col("attempts"), F.col("processing_time")))
    both = df.groupBy(key).agg(
        best.alias("best"),
        F.struct(*merge_aggregates()).alias("merged"),
        F.sum("attempts").alias("all_attempts"),
        F.sum("processing_time").alias("all_time"),
    )
    merged = {f: F.col(f"merged.{f}") for f in FIELDS}
    any_field = reduce(lambda a, b: a | b, [is_filled(x) for x in merged.values()])
    both = both.withColumn("merged_confidence", extraction_confidence(merged, any_field))
    use = (F.col("best.confidence") < min_confidence) & (F.col("merged_confidence") > F.col("best.confidence"))
    pick = lambda a, b: F.when(use, a).otherwise(b)
    return both.select(
        key,
        *[pick(merged[f], F.col(f"best.{f}")).alias(f) for f in FIELDS],
        pick(F.col("merged_confidence"), F.col("best.confidence")).alias("confidence"),
        pick(F.lit("merged"), F.col("best.strategy")).alias("strategy_used"),
        pick(F.col("all_attempts"), F.col("best.attempts").cast("long")).alias("attempts"),
        pick(F.col("all_time"), F.col("best.processing_time")).alias("processing_time"),
    )


def best_in(candidates: Column, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """The same choice within a row: of an array of structs to one struct, without a shuffle.

    A candidate has strategy, rank, nine fields, confidence, attempts and processing_time.
    """
    def largest(rows: Column, score: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        return F.array_max(F.transform(rows, lambda c: F.struct(score(c).alias("score"), (-c["rank"]).alias("order"), value(c).alias("value"))))["value"]

    def merged_field(f: str) -> Column:
        return largest(F.filter(candidates, lambda c: is_filled(c[f])), lambda c: F.length(c[f]) * c["confidence"] / 100, lambda c: c[f])

    total = lambda name, zero: F.aggregate(candidates, zero, lambda s, c: s + c[name])
    both = F.struct(
        largest(candidates, lambda c: c["confidence"], lambda c: c).alias("best"), F.struct(*[merged_field(f).alias(f) for f in FIELDS]).alias("merged"),
        total("attempts", F.lit(0).cast("long")).alias("attempts"), total("processing_time", F.lit(0.0)).alias("time"),
    )

    def chosen(b: Column) -> Column:
        merged = {f: b["merged"][f] for f in FIELDS}
        score = extraction_confidence(merged, reduce(lambda x, y: x | y, [is_filled(x) for x in merged.values()]))
        return bound(F.struct(b.alias("b"), score.alias("score")), pick)

    def pick(x: Column) -> Column:
        b, score = x["b"], x["score"]
        use = (b["best"]["confidence"] < min_confidence) & (score > b["best"]["confidence"])
        one = lambda merged, best: F.when(use, merged).otherwise(best)
        return F.struct(
            *[one(b["merged"][f], b["best"][f]).alias(f) for f in FIELDS], one(score, b["best"]["confidence"]).alias("confidence"),
            one(F.lit("merged"), b["best"]["strategy"]).alias("strategy_used"), one(b["attempts"], b["best"]["attempts"].cast("long")).alias("attempts"),
            one(b["time"], b["best"]["processing_time"]).alias("processing_time"),
        )

    return bound(both, chosen)
