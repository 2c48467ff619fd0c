"""Mortgage-like rows derived from the order tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import apart

TABLES = ("orders", "customer", "nation", "lineitem", "supplier", "part", "documents", "conversations", "events")
AS_OF_YEAR = 2026


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the input tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def pick(key: str, values: list[str]) -> str:
    """A CASE that spreads the values over ``key``."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


_DEC = "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)"
_INT = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_YEAR, _MONTH, _DAY = (f"CAST({f}(o_orderdate) AS STRING)" for f in ("year", "month", "day"))

VALUES = {
    "borrowers": pick("o_orderkey", [
        "'Frank Baker and Mary Baker (husband and wife)'", "'Elizabeth Howerton and Travis Howerton (spouses)'", "c_name",
        "'Mary Bryan (married)'", "NULL", "'null'", "'  Frank '", "concat('Mark Tanner and ', n_name)", "'mary-jane d''arcy'",
        "'(married)'", "'Frank Baker and Mary Baker'",
    ]),
    "loan_amount": pick("(o_orderkey + 1)", [
        f"concat('$', {_DEC})", _DEC, f"concat('$', {_INT})", f"concat('Smith, $', {_DEC})", "'12 months $475,950'", "NULL", "' null '",
        "'$475,950.00'", f"concat('amount: ', {_DEC}, ' USD')", "'n0t a currency amOunt'", "'475,950.'", "'$10000000'", "'10000000.01'", "'$ 9,999.99'",
    ]),
    "recording_date": pick("(o_orderkey + 2)", [
        f"concat({_MONTH}, '/', {_DAY}, '/', {_YEAR})", f"concat({_YEAR}, '-', {_MONTH}, '-', {_DAY})", "'April 1, 2025'", "'1 apr 2025'",
        "'2/30/2024 or April 1, 2025'", "'1/1/1980'", "NULL", "'Sept 5, 2024'", f"concat('on ', {_MONTH}, '/', {_DAY}, '/', {_YEAR}, ' and 4/1/2025')",
        "'1/1/2032'", "'  none'", "'Dec 12, 2031'",
    ]),
    "recording_location": pick("o_orderkey", ["'Albany County Clerk''s Office'", "n_name", "NULL", "''", "'Book #12'"]),
    "lender_name": pick("(o_orderkey + 3)", ["s_name", "'US Mortgage Corporation'", "'Lende7 Bank'", "'A & B; Co'", "NULL", "concat(n_name, ' Bank')", "'Borrower5  Bank'"]),
    "lender_nmls_id": pick("o_orderkey", ["CAST(o_orderkey AS STRING)", "'NMLS 12 3456 7890'", "'390l'", "'65I75'", "'123456789'", "NULL", "'none'", "'NMLS ID 3901'"]),
    "broker_name": pick("o_orderkey", ["NULL", "'none'", "'US Mortgage Corporation'", "'A & B; Co'", "p_name", "'NULL'"]),
    "loan_originator_name": pick("(o_orderkey + 1)", ["'William John Lane'", "'mary-jane d''arcy'", "'Frank'", "c_name", "NULL", "'  mark  tanner '", "'B. Ryan'"]),
    "loan_originator_nmls_id": pick("(o_orderkey + 4)", ["'65175'", "CAST(o_custkey * 1000 AS STRING)", "''", "'id 12 and 34'", "'1234 5678'"]),
}

FROM_SQL = """
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
LEFT JOIN supplier ON s_suppkey = sk LEFT JOIN part ON p_partkey = pk
"""
SOURCE_SQL = f"""
SELECT o_orderkey AS doc_id, {', '.join(f'{sql} AS {name}' for name, sql in VALUES.items())}{FROM_SQL}"""
#: The columns that the nine fields are made of.
GIVEN = "o_orderkey, o_custkey, o_totalprice, o_orderdate, c_name, n_name, s_name, p_name"


def mortgages(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """doc_id and the nine raw fields, and ``more`` columns of the order, over as many tasks as the session shuffles to.

    The joins leave few rows' bytes for many rows' work: the validators cost more than
    the shuffle that spreads them, and the given columns are narrower than the fields.
    """
    views(spark, sf_dir, "orders", "customer", "nation", "lineitem", "supplier", "part")
    given = spark.sql(f"SELECT {GIVEN} {FROM_SQL}").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    fields = {name: F.expr(sql) for name, sql in VALUES.items()}
    first = next(iter(fields))
    fields[first] = apart(fields[first], F.col("o_orderkey"))
    return given.select(F.col("o_orderkey").alias("doc_id"), *[x.alias(name) for name, x in fields.items()], *more)
