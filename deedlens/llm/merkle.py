"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

DataFrame functions only.  A text is cut into sections (after blank lines),
those into paragraphs (after line ends) and those into leaves (sentences, at
most ``LEAF_CHARS`` characters each).  All separators stay in the leaves, so the
leaves joined are the text.  A node is the SHA-256 of its children's digests.
Equal roots mean equal texts; where roots differ, only differing branches need
to be entered to find the edits.

The fingerprint is one string: the root, then ``|`` and each section's digest,
``:`` and its paragraphs' digests with ``;`` between, each followed by ``=`` and
its leaves with ``,`` between.  Nodes are digests of whole digests; only the string
shortens those below the root.

Likeness descends two trees.  Equal sections count with all their leaves and are
not entered; of the others, equal paragraphs count likewise; of the rest, leaves.
It is the share of the leaves of both trees that is common.

Edge cases: a null text is the empty text, whose tree is one empty leaf;
very long lines are cut into leaves; equal texts have equal fingerprints and
likeness 1; extra columns are ignored; an empty table gives no rows.  Rows of
one doc_id, and those without, are ordered by a hash of their text; a null doc_id
comes last in descending order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import full_text, table

LEAF_CHARS = 200
LEAF_HEX, NODE_HEX = 12, 16
#: Ranges of ids for every shuffle partition.
RANGES_PER_PARTITION = 4

SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)(?!\n)"
LEAF = rf"(?s).{{1,{LEAF_CHARS}}}?(?:[.!?][ \t\n]+|\z)|.{{1,{LEAF_CHARS}}}"


def _leaves(paragraph: Column) -> Column:
    # an empty paragraph has no match: its one leaf is the empty string
    found = F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0))
    found = F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)
    return F.transform(found, lambda x: F.sha2(x, 256))


def leaf_tree(text: Column) -> Column:
    """Sections of paragraphs of leaf digests."""
    return F.transform(
        F.split(text, SECTION_END),
        lambda s: F.transform(F.split(s, PARAGRAPH_END), _leaves),
    )


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ","), 256)


def fingerprint(tree: Column) -> Column:
    """The tree as a string that begins with its root."""
    short = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, LEAF_HEX)), ",")
    sections = F.transform(tree, lambda s: F.transform(s, lambda p: F.struct(_node(p).alias("h"), short(p).alias("leaves"))))
    described = F.transform(
        sections,
        lambda s: F.struct(
            _node(F.transform(s, lambda p: p["h"])).alias("h"),
            F.array_join(F.transform(s, lambda p: F.concat(F.substring(p["h"], 1, NODE_HEX), F.lit("="), p["leaves"])), ";").alias("body"),
        ),
    )
    return F.concat(
        _node(F.transform(described, lambda s: s["h"])),
        F.lit("|"),
        F.array_join(F.transform(described, lambda s: F.concat(F.substring(s["h"], 1, NODE_HEX), F.lit(":"), s["body"])), "|"),
    )


def root(fp: Column) -> Column:
    """The root digest of a fingerprint."""
    return F.substring(fp, 1, 64)


def _sections(fp: Column) -> Column:
    """The distinct sections of a fingerprint, each with its branch."""
    return F.array_distinct(F.split(F.substring(fp, F.lit(66), F.length(fp)), r"\|"))


def _children(branches: Column, sign: str, between: str) -> Column:
    """The distinct children of some branches, each with its own branch."""
    return F.array_distinct(F.flatten(F.transform(branches, lambda x: F.split(F.substring_index(x, sign, -1), between))))


def _n_leaves(branches: Column) -> Column:
    """Leaves below some sections or paragraphs: each paragraph's first follows ``=``, others ``,``."""
    return F.aggregate(branches, F.lit(0).cast("long"), lambda n, x: n + F.length(x) - F.length(F.translate(x, "=,", "")))


def likeness(a: Column, b: Column) -> Column:
    """Share of the leaves of two fingerprints that is common to both, 0 to 1, by descent."""
    def described(two: Column) -> Column:
        # each level holds what differs on the one before; ``both`` counts the leaves of what does not
        level = lambda x, y: F.struct(F.array_except(x, y).alias("x"), F.array_except(y, x).alias("y"), F.array_intersect(x, y).alias("both"))
        once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  bound, so evaluated once
        down = lambda v, sign, between: level(_children(v["x"], sign, between), _children(v["y"], sign, between))
        return once(
            level(_sections(two["a"]), _sections(two["b"])),
            lambda s: once(
                down(s, ":", ";"),
                lambda p: once(
                    F.struct(_children(p["x"], "=", ",").alias("x"), _children(p["y"], "=", ",").alias("y")),
                    lambda l: F.struct(  # noqa: E741
                        (_n_leaves(s["both"]) + _n_leaves(p["both"]) + F.size(F.array_intersect(l["x"], l["y"]))).cast("double").alias("common"),
                        (2 * (_n_leaves(s["both"]) + _n_leaves(p["both"])) + F.size(l["x"]) + F.size(l["y"])).cast("double").alias("all"),
                    ),
                ),
            ),
        )

    share = F.transform(F.array(described(F.struct(a.alias("a"), b.alias("b")))), lambda d: d["common"] * 2 / d["all"])[0]
    return F.when(root(a) == root(b), 1.0).otherwise(share)


_POSITIONS = "array<struct<section:int,paragraph:int,leaf:int>>"


def _unlike(one: Column, other: Column) -> Column:
    """Positions (section, paragraph, leaf; from 1) of ``one`` that no equal branch of ``other`` has."""
    none = F.array().cast(_POSITIONS)
    differing = F.array_except(other, one)  # sections whose equal is not in both
    paragraphs = F.array_distinct(F.flatten(differing))
    own = F.array_distinct(F.flatten(F.array_except(one, other)))
    leaves = F.array_distinct(F.flatten(F.array_except(paragraphs, own)))

    def leaf(x, i, j, k):
        return F.when(~F.array_contains(leaves, x), F.struct((i + 1).cast("int").alias("section"), (j + 1).cast("int").alias("paragraph"), (k + 1).cast("int").alias("leaf")))

    return F.flatten(F.transform(one, lambda s, i: F.when(F.array_contains(other, s), none).otherwise(
        F.flatten(F.transform(s, lambda p, j: F.when(F.array_contains(paragraphs, p), none).otherwise(
            F.array_compact(F.transform(p, lambda x, k: leaf(x, i, j, k)))))))))


def differing_leaves(old: Column, new: Column) -> Column:
    """(added, removed): positions (section, paragraph, leaf; from 1) in ``new`` and in ``old`` that differ.

    Branches that the other tree holds too, wherever they stand, are not entered: an
    inserted section is the only one that differs.
    """
    return F.struct(_unlike(new, old).alias("added"), _unlike(old, new).alias("removed"))


def _bounds(keys: DataFrame, n: int) -> list[int]:
    """Upper bounds of about ``n`` ranges of about equal row counts of the column ``key``; each is a value of it.

    Quantiles are approximate, and of doubles; the largest key below each is exact.
    """
    got = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n + 1)], max(10_000, 4 * n)).alias("q"), F.max("key").alias("top")).first()
    if got["top"] is None:
        return []
    about = sorted({*got["q"], got["top"]})
    return sorted(r["top"] for r in keys.groupBy(_place(F.col("key"), about)[0].alias("at")).agg(F.max("key").alias("top")).collect())


def _place(key: Column, bounds: list[int]) -> tuple[Column, Column]:
    """The number of the range that holds ``key``, and whether ``key`` is its bound.

    Bounds are one folded literal, searched in two steps of about the root of their number.
    """
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[0]]
    constant = lambda value, kind: F.from_json(F.lit(str(value)), kind)
    smaller = lambda values: F.size(F.filter(values, lambda b: b < key))
    # a key beyond the bounds, which only an unstable input can have, goes to the last range
    coarse = F.least(smaller(constant([p[-1] for p in parts], "array<bigint>")), F.lit(len(parts) - 1))
    of = F.element_at(constant(parts, "array<array<bigint>>"), coarse + 1)
    fine = F.least(smaller(of), F.size(of) - 1)
    return coarse * step + fine, F.element_at(of, fine + 1) == key


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the text of the next document in descending id order.

    Ids are cut into ranges of about equal counts, and so are the text hashes of rows
    without an id.  The largest row of every range is also dealt to the next range
    (that of the whole table to the first), so each range finds its predecessors by
    itself in one shuffle.
    """
    rows = df.select(df[id_col].cast("long").alias("doc_id"), full_text(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION)
    there = _bounds(rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key")), n)
    missing = _bounds(rows.where(F.col("doc_id").isNull()).select(F.col("hash").alias("key")), n)
    rows = rows.withColumn("key", F.coalesce("doc_id", "hash"))
    at_missing, edge_missing = _place(F.col("key"), missing)
    at_there, edge_there = _place(F.col("key"), there)
    last = len(missing) + len(there) - 1
    at = F.when(F.col("doc_id").isNull(), at_missing).otherwise(at_there + len(missing))
    edge = F.when(F.col("doc_id").isNull(), edge_missing).otherwise(edge_there)
    rows = rows.withColumn("at", at).withColumn("edge", edge)
    own = F.struct(F.col("at").alias("at"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.when(F.col("at") == last, 0).otherwise(F.col("at") + 1).alias("at"), F.lit(True).alias("ghost"))
    rows = rows.select("doc_id", "text", "hash", F.explode(F.when(F.col("edge"), F.array(own, ghost)).otherwise(F.array(own))).alias("deal"))
    rows = rows.select("doc_id", "text", "hash", "deal.at", "deal.ghost")
    return rows.withColumn("next_text", F.lag("text").over(by_range()))


def by_range() -> Window:
    """Rows of a range, ghosts of the range before first."""
    return Window.partitionBy("at").orderBy(F.desc("ghost"), F.asc_nulls_first("doc_id"), "hash", "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses."""
    rows = with_next(df, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "text", "hash", "at", "ghost", n.cast("long").alias("n_chars"), F.coalesce(edited, "text").alias("edited"))
    rows = rows.select(
        "doc_id", "text", "hash", "at", "ghost", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(leaf_tree(F.col("text"))).alias("fingerprint"), fingerprint(leaf_tree(F.col("edited"))).alias("edited_fingerprint"),
    )
    rows = rows.withColumn("following", F.coalesce(F.lag("fingerprint").over(by_range()), "fingerprint"))
    return rows.where(~F.col("ghost")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )


def op6_document_fingerprints(spark, sf_dir):
    """Query op6: fingerprints of every text of ``documents``."""
    return fingerprints(table(spark, sf_dir, "documents"))


def _sql_tree(text: str) -> str:
    cut = lambda x, end: f"string_split(regexp_replace({x}, '{end}', '\\0' || chr(1), 'g'), chr(1))"
    return (
        f"list_transform({cut(text, chr(92) + 'n' + chr(92) + 'n+')}, lambda s: "
        f"list_transform({cut('s', chr(92) + 'n+')}, lambda p: "
        "list_transform(CASE WHEN p = '' THEN [''] ELSE "
        rf"regexp_extract_all(p, '(?s).{{1,{LEAF_CHARS}}}?(?:[.!?][ \t\n]+|\z)|.{{1,{LEAF_CHARS}}}') END, lambda x: sha256(x))))"
    )


def _sql_fingerprint(tree: str) -> str:
    joined = lambda x, sep: f"array_to_string({x}, '{sep}')"
    paragraph = f"sha256({joined('p', ',')})"
    section = f"sha256({joined(f'list_transform(s, lambda p: {paragraph})', ',')})"
    top = f"sha256({joined(f'list_transform({tree}, lambda s: {section})', ',')})"
    short = joined(f"list_transform(p, lambda x: x[1:{LEAF_HEX}])", ",")
    body = joined(f"list_transform(s, lambda p: {paragraph}[1:{NODE_HEX}] || '=' || {short})", ";")
    return f"{top} || '|' || {joined(f'list_transform({tree}, lambda s: {section}[1:{NODE_HEX}] || chr(58) || {body})', '|')}"


def _sql_near(a: str, b: str, out: str) -> str:
    """Common table expressions that end in ``out`` (doc_id, near) of two fingerprint columns of ``fp``."""
    children = lambda x, sign, between: f"list_distinct(flatten(list_transform({x}, lambda v: string_split(string_split(v, '{sign}')[-1], '{between}'))))"
    sections = lambda x: f"list_distinct(string_split({x}[66:], '|'))"
    without = lambda x, y: f"list_filter({x}, lambda v: NOT list_contains({y}, v))"
    leaves = lambda x, y: f"coalesce(list_sum(list_transform(list_intersect({x}, {y}), lambda v: length(v) - length(translate(v, '=,', '')))), 0)"
    return f"""
{out}_s AS (SELECT doc_id, {a} = {b} AS same, {sections(a)} AS x, {sections(b)} AS y FROM fp),
{out}_p AS (SELECT doc_id, same, {leaves('x', 'y')} AS n, {children(without('x', 'y'), ':', ';')} AS x, {children(without('y', 'x'), ':', ';')} AS y FROM {out}_s),
{out}_l AS (SELECT doc_id, same, n + {leaves('x', 'y')} AS n, {children(without('x', 'y'), '=', ',')} AS x, {children(without('y', 'x'), '=', ',')} AS y FROM {out}_p),
{out} AS (SELECT doc_id, CASE WHEN same THEN 1.0 ELSE 2.0 * (n + len(list_intersect(x, y))) / (2 * n + len(x) + len(y)) END::DOUBLE AS near FROM {out}_l)"""


OP6_SQL = f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS following,
         first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS top
  FROM documents),
edits AS (
  SELECT doc_id, text, n, coalesce(following, top) AS next_text,
         substr(text, 1, n - n // 2) || substr(coalesce(following, top), 1, n // 2) AS edited
  FROM ordered),
trees AS (
  SELECT doc_id, n, edited, {_sql_tree('text')} AS t, {_sql_tree('edited')} AS e, {_sql_tree('next_text')} AS x FROM edits),
fp AS (
  SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_sql_fingerprint('t')} AS fingerprint,
         {_sql_fingerprint('e')} AS edited_fingerprint, {_sql_fingerprint('x')} AS next_fingerprint
  FROM trees),{_sql_near('fingerprint', 'edited_fingerprint', 'e')},{_sql_near('fingerprint', 'next_fingerprint', 'x')}
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, e.near AS near_edited, x.near AS near_next
FROM fp JOIN e USING (doc_id) JOIN x USING (doc_id)
"""
