"""DuckDB SQL for the library's queries, written apart from the Spark expressions."""

from __future__ import annotations

from ..fields import FIELDS, OPTIONAL, REQUIRED
from . import queries as q
from .fixtures import AS_OF_YEAR, SOURCE_SQL

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
SRC = f"WITH mortgages AS ({SOURCE_SQL})"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def missing(x):
    return f"(lower(coalesce({x}, 'None')) IN ('null', 'none', ''))"


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def ocr(x):
    return f"replace(translate({x}, 'lIOoSsGg', '11005569'), 'Lende7', 'Lender')"


def title(x):
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), '')"


def digits(x):
    return rf"list_reduce(regexp_extract_all({x}, '\d+'), lambda m, y: CASE WHEN length(y) > length(m) THEN y ELSE m END, '')"


def result(valid, value, score):
    return f"{{'valid': {valid}, 'value': {value}, 'score': {score}::DOUBLE}}"


def amount(x):
    found = rf"regexp_extract({x}, '\$?([\d,]+\.?\d{{0,2}})', 1)"
    bare = f"replace({found}, ',', '')"
    value = f"try_cast({bare} AS DOUBLE)"
    text = f"'$' || CASE WHEN contains({bare}, '.') THEN format('{{:,.2f}}', {value}) ELSE format('{{:,.0f}}', {value}) END"
    return f"CASE WHEN {missing(x)} THEN {result('false', _lit(''), 0)} WHEN coalesce({value} BETWEEN 10000 AND 10000000, false) THEN {result('true', text, 90)} ELSE {result('false', strip(x), 10)} END"


def nmls(x):
    return f"CASE WHEN {missing(x)} THEN {result('false', _lit(''), 0)} WHEN length({digits(x)}) BETWEEN 4 AND 8 THEN {result('true', digits(x), 95)} ELSE {result('false', strip(x), 20)} END"


def date(x):
    rules = [
        (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", ["%m/%d/%Y"]),
        (r"\b(\d{4}-\d{1,2}-\d{1,2})\b", ["%Y-%m-%d"]),
        (r"\b([A-Za-z]+ \d{1,2}, \d{4})\b", ["%B %d, %Y", "%b %d, %Y"]),
        (r"\b(\d{1,2} [A-Za-z]+ \d{4})\b", ["%d %B %Y", "%d %b %Y"]),
    ]
    out = f"CASE WHEN {missing(x)} THEN {result('false', _lit(''), 0)}"
    for i, (pattern, formats) in enumerate(rules):
        text = f"regexp_extract({x}, '{pattern}', 1)"
        day = "coalesce(" + ", ".join(f"try_strptime({text}, '{f}')" for f in formats) + ")"
        out += f" WHEN coalesce(year({day}) BETWEEN 1990 AND {AS_OF_YEAR + 5}, false) THEN {result('true', text, 90 - 5 * i)}"
    return out + f" ELSE {result('false', strip(x), 15)} END"


def _good_person(y):
    return rf"regexp_matches({y}, '^[A-Za-z\s.\-'']+$')"


def person(x):
    y = title(ocr(strip(x)))
    two = rf"regexp_matches({y}, '\S\s+\S')"
    return (
        f"CASE WHEN {missing(x)} THEN {result('false', _lit(''), 0)} "
        f"WHEN {_good_person(y)} THEN {result('true', y, f'(CASE WHEN {two} THEN 85 ELSE 60 END)')} ELSE {result('false', y, 30)} END"
    )


def company(x):
    y = ocr(strip(x))
    return (
        f"CASE WHEN {missing(x)} THEN {result('false', _lit(''), 0)} "
        rf"WHEN regexp_matches({y}, '^[A-Za-z0-9\s.\-&,''" + f"\"]+$') THEN {result('true', y, 80)} ELSE {result('false', y, 30)} END"
    )


def borrowers(x):
    names = strip(rf"regexp_replace({x}, '\([^)]+\)', '', 'g')")
    inner = person(names)
    bonus = rf"(CASE WHEN regexp_matches({x}, '\((husband and wife|spouses|married)\)', 'i') THEN 10 ELSE 0 END + CASE WHEN contains(lower({names}), ' and ') THEN 5 ELSE 0 END)"
    return f"CASE WHEN {missing(x)} THEN {result('false', _lit(''), 0)} ELSE {result(f'({inner}).valid', strip(x), f'least(({inner}).score + {bonus}, 95)')} END"


def broker(x):
    return f"CASE WHEN coalesce({x}, '') = '' OR lower({x}) = 'null' THEN {result('true', _lit(''), 100)} ELSE {company(x)} END"


RULES = dict(zip(FIELDS, (borrowers, amount, date, company, company, nmls, broker, person, nmls)))


def one(field, rule):
    return f"{SRC}, r AS (SELECT doc_id, {rule(field)} AS r FROM mortgages) SELECT doc_id, r.valid AS valid, r.value AS value, r.score AS score FROM r"


def corrected(f, x):
    if f == "loan_amount":
        return rf"CASE WHEN {x} <> '' THEN regexp_replace(regexp_replace(regexp_replace({x}, '[$]\s*', '', 'g'), '(\d)\s+(\d)', '\1\2', 'g'), '[Oo]', '0', 'g') ELSE {x} END"
    if f.endswith("nmls_id"):
        return f"CASE WHEN {digits(x)} <> '' THEN {digits(x)} ELSE {x} END"
    if f in ("borrowers", "lender_name", "broker_name", "loan_originator_name"):
        squeezed = strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")
        return f"CASE WHEN {x} <> '' AND {x} <> 'null' THEN {ocr(squeezed)} ELSE {x} END"
    return x


_COUNTED = [f for f in FIELDS if f != OPTIONAL]
CHECKED = f"{SRC}, checked AS (SELECT doc_id, {', '.join(f'{rule(f)} AS {f}' for f, rule in RULES.items())} FROM mortgages)"
_SUM = " + ".join(f"CASE WHEN {f}.value <> '' THEN {f}.score ELSE 0 END" for f in _COUNTED)
_N = " + ".join(f"CASE WHEN {f}.value <> '' THEN 1 ELSE 0 END" for f in _COUNTED)
SCORED = f"{CHECKED}, scored AS (SELECT *, CASE WHEN {_N} = 0 THEN 0.0::DOUBLE ELSE ({_SUM})::DOUBLE / ({_N}) END AS overall FROM checked)"
_VALID = " AND ".join(f"{f}.value <> ''" for f in REQUIRED) + " AND overall >= 50"
_FINAL = {f: corrected(f, f"nullif({f}.value, '')") for f in FIELDS}


def _issue(f):
    low = f"WHEN NOT {f}.valid AND {f}.value <> '' THEN '{f}: Low confidence (' || format('{{:.1f}}', {f}.score) || '%)'"
    return f"CASE {low}" + ("" if f == OPTIONAL else f" WHEN {f}.value = '' THEN '{f}: Missing or invalid data'") + " END"


def _list(items, sep):
    return f"array_to_string(list_filter([{', '.join(items)}], lambda s: s IS NOT NULL), '{sep}')"


def _names(condition):
    return _list([f"CASE WHEN {condition.format(f=f)} THEN '{f}' END" for f in FIELDS], ", ")


def filled(x):
    return f"coalesce({x} <> '' AND {x} <> 'null', false)"


def confidence(get):
    n = " + ".join(f"{filled(get(f))}::INT" for f in FIELDS)
    quality = f"100 - CASE WHEN coalesce({get('loan_amount')}, '') <> '' AND NOT ({get('loan_amount')} LIKE '$%' AND regexp_matches({get('loan_amount')}, '\\d')) THEN 15 ELSE 0 END"
    for f in ("lender_nmls_id", "loan_originator_nmls_id"):
        quality += f" - CASE WHEN {filled(get(f))} AND NOT regexp_matches({strip(get(f))}, '^\\d+$') THEN 10 ELSE 0 END"
    quality += f" - CASE WHEN {filled(get('borrowers'))} AND NOT regexp_matches({get('borrowers')}, '\\pL') THEN 20 ELSE 0 END"
    return f"greatest(0.0, least(100.0, (({n})::DOUBLE / 9 * 100) * 0.7::DOUBLE + ({quality})::DOUBLE * 0.3::DOUBLE))"


_BOTH = (
    f"{SRC}, c AS (SELECT doc_id, 'full_document' AS strategy, 0 AS rank, {', '.join(FIELDS)}, (doc_id % 50)::DOUBLE AS confidence FROM mortgages UNION ALL "
    f"SELECT doc_id, 'field_by_field', 1, {', '.join(q.SECOND[f] for f in FIELDS)}, (doc_id % 37)::DOUBLE FROM mortgages)"
)
_MERGED = (
    f"{_BOTH}, m0 AS (SELECT doc_id, "
    + ", ".join(f"first({f} ORDER BY length({f}) * confidence / 100 DESC, rank) FILTER ({filled(f)}) AS {f}" for f in FIELDS)
    + f" FROM c GROUP BY doc_id), m AS (SELECT *, CASE WHEN coalesce({', '.join(FIELDS)}) IS NULL THEN 0 ELSE {confidence(str)} END AS conf FROM m0)"
)
_BATCH = (
    f"{SCORED}, b AS (SELECT 'doc' || doc_id AS document, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status, "
    "CASE WHEN doc_id % 11 <> 0 THEN overall END AS overall, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 7 + 0.5)::DOUBLE END AS t, "
    + ", ".join(f"{x} AS {f}" for f, x in _FINAL.items())
    + " FROM scored)"
)
_WORDS = "WITH w AS (" + q.WORDS_SQL + ")"
_PAGES = "WITH p AS (" + q.PAGES_SQL + ")"
_JOINED = "coalesce(string_agg(text, '{}' ORDER BY page_no) FILTER (text <> ''), '')"
_ENGINES = "WITH e AS (" + q.ENGINES_SQL + ")"


def _has(i, key):
    return f"coalesce(list_contains(json_keys(j{i}), '{key}'), false)"


def _stated(i, key):
    return f"WHEN {_has(i, key)} THEN j{i}->>'$.{key}'"


def clean_sql(x):
    steps = [
        (r"\s+", " "), (r"\bO\b", "0"), (r"\bl\b", "1"), (r"\bS\b", "5"), (r"\b(RILS|NRLS|ARLS)\b", "NMLS"), (r"\$\s+", "$"),
        (r"(\d)\s+(\d)", r"\1\2"), (r"\b(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{4})\b", r"\1/\2/\3"), (r"[|_]{2,}", ""), (r"[\[\]{}]", ""),
    ]
    x = f"coalesce({x}, '')"
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'gi')"
    return strip(x)


def _after(label, value=r"([^\n]+)"):
    return rf"nullif(trim(regexp_extract(text, '(?im)^{label}[ \t]*{value}', 1)), '')"


_PROMPT = (
    "Find loan amount in this mortgage document: the principal or loan amount, a large sum in dollars.\n\n",
    "\n\nAnswer with the value alone, or null.",
)
_LOW = " + ".join(f"({f}.score < 50)::INT" for f in FIELDS)

SQL = {
    "clean_text": f"WITH n AS ({q.NOISY_SQL}) SELECT doc_id, {clean_sql('text')} AS cleaned FROM n",
    "ocr_correct": f"{SRC} SELECT doc_id, {ocr('lender_name')} AS lender, {ocr('borrowers')} AS borrowers FROM mortgages",
    "title_case": f"{SRC} SELECT doc_id, {title('loan_originator_name')} AS name, {title(ocr('borrowers'))} AS borrowers FROM mortgages",
    "parse_scalar": f"""WITH a AS ({q.ANSWERS_SQL}), b AS (SELECT doc_id, regexp_replace({strip('answer')}, '^["'']+|["'']+$', '', 'g') AS v FROM a)
        SELECT doc_id, CASE WHEN lower(v) NOT IN ('', 'null') THEN v END AS value FROM b""",
    "parse_json": f"""WITH r AS ({q.REPLIES_SQL}), i AS (SELECT doc_id, coalesce(nullif(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1), ''), reply) AS j FROM r),
        g AS (SELECT doc_id, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM i)
        SELECT doc_id, j->>'k' AS k, j->>'borrowers' AS borrowers, j->>'loan_amount' AS loan_amount, len(json_keys(coalesce(j, '{{}}')))::BIGINT AS n_keys FROM g""",
    "json_merge": f"""WITH p AS ({q.PARTS_SQL}),
j AS (SELECT doc_id, {', '.join(f"try_cast(nullif(regexp_extract(p{i}, '(?s)({chr(92)}{{.*{chr(92)}}})', 1), '') AS JSON) AS j{i}" for i in (1, 2, 3))} FROM p)
SELECT doc_id, {', '.join(f"CASE {' '.join(_stated(i, k) for i in (3, 2, 1))} END AS {k}" for k in ('borrowers', 'loan_amount', 'lender_name', 'lender_nmls_id'))},
  CAST({' + '.join(f"({' OR '.join(_has(i, k) for i in (1, 2, 3))})::INT" for k in ('borrowers', 'loan_amount', 'lender_name', 'lender_nmls_id', 'x'))} AS BIGINT) AS n_keys FROM j""",
    "render_prompt": f"WITH n AS ({q.NOISY_SQL}) SELECT doc_id, {_lit(_PROMPT[0])} || coalesce(text, '') || {_lit(_PROMPT[1])} AS prompt FROM n",
    "split_sections": """WITH d AS (SELECT doc_id, text, length(text) AS n, floor(length(text) * 0.2)::BIGINT AS e FROM documents)
        SELECT doc_id, left(text, e) AS header, substr(text, e + 1, n - 2 * e) AS body, substr(text, n - e + 1, e) AS signature FROM d""",
    "doc_info": "SELECT doc_id, round(strlen(text) * 1000 / (1024 * 1024)::DOUBLE, 2) AS file_size_mb FROM documents",
    "validate_loan_amount": one("loan_amount", amount),
    "validate_nmls_id": one("lender_nmls_id", nmls),
    "validate_date": one("recording_date", date),
    "validate_person": one("loan_originator_name", person),
    "validate_company": one("lender_name", company),
    "validate_borrowers": one("borrowers", borrowers),
    "regex_corrections": f"{SRC} SELECT doc_id, {', '.join(f'{corrected(f, f)} AS {f}' for f in FIELDS)} FROM mortgages",
    "validate_all": f"{SCORED} SELECT doc_id, round(overall, 6) AS overall, ({_VALID}) AS is_valid, {_list([_issue(f) for f in FIELDS], '; ')} AS issues, "
    + ", ".join(f"{f}.score AS score_{f}" for f in FIELDS) + ", " + ", ".join(f"{x} AS {f}" for f, x in _FINAL.items()) + " FROM scored",
    "quality_report": f"{SCORED} SELECT doc_id, round(("
    + " + ".join(f"(lower({f}.value) NOT IN ('', 'null'))::INT" for f in FIELDS)
    + f")::DOUBLE / 9 * 100, 6) AS completeness, {_names('{f}.score >= 80')} AS high, {_names('{f}.score >= 50 AND {f}.score < 80')} AS medium, {_names('{f}.score < 50')} AS low, "
    + _list([
        f"CASE WHEN {_LOW} > 0 THEN 'Review low confidence fields: ' || {_names('{f}.score < 50')} END",
        "CASE WHEN borrowers.value = '' THEN 'Borrower information is missing - critical field' END",
        "CASE WHEN loan_amount.value = '' THEN 'Loan amount is missing - critical field' END",
        "CASE WHEN lender_name.value = '' THEN 'Lender name is missing - critical field' END",
        "CASE WHEN overall < 70 THEN 'Consider manual review due to low overall confidence' END",
    ], " | ") + " AS recommendations FROM scored",
    "extraction_confidence": f"{SRC} SELECT doc_id, round({confidence(str)}, 6) AS confidence FROM mortgages",
    "multi_strategy": f"{_BOTH} SELECT doc_id, strategy, rank, borrowers, loan_amount, confidence FROM c",
    "merge_extractions": f"{_MERGED} SELECT doc_id, {', '.join(FIELDS)}, round(conf, 6) AS confidence, 3::BIGINT AS attempts, 0.75::DOUBLE AS processing_time, 'e1;e2;e3' AS errors, 'merged' AS strategy_used FROM m",
    "best_extraction": f"{_MERGED}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, rank) = 1), "
    "j AS (SELECT b.doc_id, b.confidence < 30 AND m.conf > b.confidence AS use, b, m FROM b JOIN m ON b.doc_id = m.doc_id) SELECT doc_id, "
    + ", ".join(f"CASE WHEN use THEN m.{f} ELSE b.{f} END AS {f}" for f in FIELDS)
    + ", round(CASE WHEN use THEN m.conf ELSE b.confidence END, 6) AS confidence, CASE WHEN use THEN 'merged' ELSE b.strategy END AS strategy_used, "
    "CASE WHEN use THEN 3 ELSE b.rank + 1 END::BIGINT AS attempts, CASE WHEN use THEN 0.75 WHEN b.rank = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS processing_time FROM j",
    "best_ocr": f"{_ENGINES} SELECT doc_id, page_no, engine, text, confidence FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY confidence DESC, rank, engine DESC, text DESC) = 1",
    "best_ocr_preferred": f"{_ENGINES} SELECT doc_id, page_no, engine, text, confidence FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, page_no "
    "ORDER BY (engine = 'easyocr' AND trim(text) <> '') DESC, confidence DESC, rank, engine DESC, text DESC) = 1",
    "extract_rules": f"{SRC}, d AS ({q.DOCUMENT_SQL}) SELECT doc_id, {_after('Borrower.s.:')} AS borrowers, "
    + _after("Loan Amount:", r"(\$?[\d,]+(?:\.\d{1,2})?)") + f" AS loan_amount, {_after('Recorded on')} AS recording_date, {_after('Recorded at:')} AS recording_location, "
    rf"{_after('Lender:')} AS lender_name, nullif(regexp_extract(replace(text, 'LO NMLS', 'LO#'), '(?is)Lender:.*?NMLS ID:[ \t]*(\w+)', 1), '') AS lender_nmls_id, "
    rf"{_after('Broker:')} AS broker_name, {_after('Loan Originator:')} AS loan_originator_name, nullif(regexp_extract(text, 'LO NMLS ID:[ \t]*(\w+)', 1), '') AS loan_originator_nmls_id FROM d",
    "combine_pages": f"{_PAGES} SELECT doc_id, {_JOINED.format(PAGE_BREAK)} AS text FROM p GROUP BY doc_id",
    "combine_pages_simple": f"{_PAGES} SELECT doc_id, {_JOINED.format(chr(10) * 2)} AS text FROM p GROUP BY doc_id",
    "doc_ocr": f"{_PAGES} SELECT doc_id, {_JOINED.format(PAGE_BREAK)} AS text, round(avg(coalesce(confidence, 0)), 6) AS confidence, sum(processing_time) AS processing_time, count(*) AS pages FROM p GROUP BY doc_id",
    "page_confidence": f"{_WORDS} SELECT doc_id, page_no, round(coalesce(avg(trunc(conf)) FILTER (trunc(conf) > 0), 0), 6)::DOUBLE AS confidence FROM w GROUP BY ALL",
    "page_confidence_simple": f"{_WORDS} SELECT doc_id, page_no, round(coalesce(avg(conf) FILTER (conf <> -1), 0), 6)::DOUBLE AS confidence FROM w GROUP BY ALL",
    "page_confidence_easyocr": f"{_WORDS} SELECT doc_id, page_no, round(avg(fraction) * 100, 6)::DOUBLE AS confidence FROM w GROUP BY ALL",
    "batch_summary": f"{_BATCH} SELECT count(*) AS total_documents, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed, "
    "round(coalesce(count(*) FILTER (status = 'success') / nullif(count(*), 0)::DOUBLE * 100, 0), 6) AS success_rate, round(coalesce(avg(t), 0), 6) AS average_processing_time, round(coalesce(avg(overall), 0), 6) AS average_confidence FROM b",
    "field_rates": f"{_BATCH} " + " UNION ALL ".join(
        f"SELECT '{f}' AS field, round(coalesce(avg(coalesce(lower({f}) NOT IN ('', 'null'), false)::INT) * 100, 0), 6) AS rate FROM b WHERE status = 'success'" for f in FIELDS),
    "individual_results": f"{_BATCH} SELECT document, status, round(coalesce(overall, 0), 6) AS confidence, coalesce(t, 0) AS processing_time, CASE WHEN status = 'failed' THEN 'not readable' END AS error FROM b",
    "full_pipeline": f"{SCORED} SELECT ({_VALID}) AS is_valid, ({_LOW})::BIGINT AS low_fields, count(*) AS documents, round(avg(overall), 6) AS mean_overall, count(nullif(loan_amount.value, '')) AS with_amount FROM scored GROUP BY 1, 2",
}
