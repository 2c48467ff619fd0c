"""URL filter: pattern rules indexed by their rarest literal token.

A rule set is compiled once on the driver.  Every rule names the literal tokens
that any URL it matches must contain; the index files the rule under the token
which the whole url table holds least often (counts of rule tokens only, so the
table is as small as the rule set).  A URL is cut into tokens, the tokens fetch
candidate rules, and only the candidates' regular expressions run.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
matches no host rule; pattern rules see the empty string and match nothing, so
its verdict is ``allow``.  Rules without a usable token are kept under the
empty token and always run.  Of pattern rules that fit, an exception goes before a block,
and host rules go before both.  An empty table gives no rows.  Repeated rows give repeated results.  Equal-length
rules that both fit: the smaller rule string wins.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9]+")

#: Host rules of the contract: (host, path prefix, verdict).
HOST_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Patterns, found anywhere in the url: ``*`` any run, ``^`` a separator or the end.
PATTERNS = (
    "-pills.",
    "^ads-track.",
    "^casino-",
    "^free-bets.",
    "^adult-",
    "^spam-farm.",
    "^doubleclick^",
    "/banner^",
    "/popunder^",
    "^viagra^",
    "^porn^",
    "^xxx^",
    "^torrent^",
    "^warez^",
)


#: What ``^`` is in public lists, where host names go on after a dot.
LIST_SEPARATOR = "[^a-z0-9_.%-]"


@dataclass(frozen=True)
class Rule:
    """One rule: what it is called, says and matches, and its literal tokens."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    host_rule: bool


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule on a host with all its subdomains, and on a prefix of the path."""
    regex = rf"(?s)(?:[^/?#]*\.)?{re.escape(host)}\n{re.escape(path)}"
    inner = TOKEN.findall(host)
    # a path token counts only where the rule itself ends it
    inner += [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(host + path, verdict, regex, tuple(inner), True)


def pattern_rule(pattern: str, verdict: str = "block", separator: str = "[^a-z0-9]") -> Rule:
    """A pattern over the lower-cased URL, without query-order tricks; no letter or digit may be a ``separator``."""
    out, tokens, inner, end = [], [], pattern, ""
    if inner.startswith("||"):  # a host or one of its subdomains
        out, inner = [r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"], inner[2:]
    elif inner.startswith("|"):
        out, inner = ["^"], inner[1:]
    if inner.endswith("|"):
        inner, end = inner[:-1], r"\Z"
    for part in re.split(r"([*^])", inner):
        out.append({"*": ".*", "^": rf"(?:{separator}|\Z)"}.get(part, re.escape(part)))
    out.append(end)
    for m in TOKEN.finditer(pattern):
        left = pattern[m.start() - 1] if m.start() else "*"
        right = pattern[m.end()] if m.end() < len(pattern) else "*"
        if left != "*" and right != "*":  # a wildcard could lengthen the token
            tokens.append(m[0].lower())
    return Rule(pattern, verdict, "(?s)" + "".join(out), tuple(tokens), False)


def listed_rules(lines: Iterable[str]) -> tuple[list[Rule], list[str]]:
    """Rules of a filter list in the common public format, and the lines that a url alone cannot decide.

    ``||host^`` anchors a host, ``|`` an end of the url, ``*`` is any run, ``^`` a separator
    or the end, ``@@`` an exception, ``!`` a comment.  Lines with options after ``$`` (they ask
    for the page or the kind of request), rules for elements of pages and whole regular
    expressions are given back, not applied.  Letters match in either case.
    """
    rules, left = {}, []
    for line in lines:
        line = (line or "").strip()
        if not line or line.startswith(("!", "[")):
            continue
        pattern = line.removeprefix("@@").lower()
        if "$" in pattern or re.search(r"#[@?$]*#", pattern) or (len(pattern) > 1 and pattern[0] == pattern[-1] == "/") or not pattern.strip("*|^"):
            left.append(line)
            continue
        verdict = "allow" if line.startswith("@@") else "block"
        rules[pattern, verdict] = pattern_rule(pattern, verdict, LIST_SEPARATOR)
    return list(rules.values()), left


def load_rules(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[list[Rule], list[str]]:
    """``listed_rules`` of the text files at ``path``; a list of over ``most`` lines is an error.

    The rule set is held by the driver and sent to every executor, hence the bound.
    """
    lines = [r["value"] for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"the rule list has more than {most} lines")
    return listed_rules(sorted(lines))


def default_rules() -> list[Rule]:
    """The contract's host rules and the built-in pattern list."""
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(p) for p in PATTERNS]


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int] | None = None):
        counts = counts or {}
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules:
            key = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
            self.by_token.setdefault(key, []).append((rule, re.compile(rule.regex)))

    def match(self, url: str, host: str, path: str) -> tuple[str | None, str | None, int]:
        """(host rule's name, verdict, regular expressions run); verdict None: no rule."""
        lower = url.lower()
        tokens = set(TOKEN.findall(lower)) | set(TOKEN.findall(path)) | {""}
        best: tuple[int, str, str] | None = None
        blocked, excepted, ran = False, False, 0
        for token in tokens:
            for rule, regex in self.by_token.get(token, ()):
                ran += 1
                if rule.host_rule:
                    if regex.match(f"{host}\n{path}"):
                        found = (-len(rule.name), rule.name, rule.verdict)
                        best = min(best, found) if best else found
                elif url and regex.search(lower):
                    blocked, excepted = blocked or rule.verdict == "block", excepted or rule.verdict == "allow"
        if best:
            return best[1], best[2], ran
        return None, "allow" if excepted else "block" if blocked else None, ran


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(df: DataFrame, url_col: str, rules: list[Rule]) -> dict[str, int]:
    """How many urls of the whole table hold each rule token: at most one row a token.

    The urls' tokens meet the rules' in one join with the rule tokens, which are as
    many as the rule set has, and are counted before the shuffle.
    """
    wanted = sorted({t.lower() for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = df.sparkSession
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), "[^a-z0-9]+"))
    rule_tokens = spark.createDataFrame(pa.table({"token": pa.array(wanted, pa.string())}))
    counted = df.select(F.explode(tokens).alias("token")).join(F.broadcast(rule_tokens), "token").groupBy("token").agg(F.count("*").alias("n"))
    found = {r["token"]: int(r["n"]) for r in counted.collect()}
    return {t: found.get(t.lower(), 0) for r in rules for t in r.tokens}


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """Judges every url: id, host, path, rule, verdict, n_regex (expressions run)."""
    rules = default_rules() if rules is None else rules
    index = RuleIndex(rules, token_counts(df, url_col, rules))
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    # Spark has the host and path; one Arrow pass judges them
    rows = df.select(F.col(id_col).alias("page_id"), u.alias("url"), url_host(u).alias("host"), url_path(u).alias("path"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string, n_regex int"

    def judge(batches):
        for b in batches:
            urls, hosts, paths = (b.column(c).to_pylist() for c in ("url", "host", "path"))
            found = [index.match(*x) for x in zip(urls, hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"), b.column("host"), b.column("path"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] or "allow" for x in found], pa.string()),
                    pa.array([x[2] for x in found], pa.int32()),
                ],
                ["page_id", "host", "path", "rule", "verdict", "n_regex"],
            )

    return rows.mapInArrow(judge, schema)


def op4_url_filter(spark, sf_dir):
    """Query op4: every url of ``pages`` judged."""
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT *, ('.' || host) LIKE '%.net' AND path LIKE '/%' AS r1,
         ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' AS r2,
         ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' AS r3,
         ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' AS r4
  FROM parts),
ruled AS (
  SELECT *, CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/'
                 WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule
  FROM fits)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(lower(url), '-pills\.|[^a-z0-9](ads-track\.|casino-|free-bets\.|adult-|spam-farm\.)|([^a-z0-9](doubleclick|viagra|porn|xxx|torrent|warez)|/(banner|popunder))([^a-z0-9]|$)')
            THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
