"""The jobs: against SQL, by reruns, over growing input, from the command line."""

import dataclasses
import json
import logging
import os

import pytest
from pyspark.sql import functions as F

from deedlens.plans.fixtures import AS_OF_YEAR
from jobs import page_intake, record_review
from jobs.common import read_config
from jobs.queries import QUERIES, SQL

from .conftest import SF, rows_of

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PAGE = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, duck, name):
    before = dict(spark.conf.getAll)
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
    after = dict(spark.conf.getAll)
    assert {k: v for k, v in after.items() if before.get(k) != v and k != page_intake.STATE_STORE} == {}


def test_config_files_state_the_defaults(spark, tmp_path):
    for job in (record_review, page_intake):
        name = f"{HERE}/jobs/{job.__name__.split('.')[-1]}.json"
        assert read_config(spark, f"file://{name}", job.Config) == job.Config()
        assert set(json.load(open(name))) == {f.name for f in dataclasses.fields(job.Config)}
    assert record_review.Config().as_of_year == AS_OF_YEAR
    for wrong in ({"unknown": 1}, {"max_files": "7"}, {"noisy_below": True}):
        (tmp_path / "c.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            read_config(spark, str(tmp_path / "c.json"), page_intake.Config)


# -- record review -------------------------------------------------------------------------


def files_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_review_reruns_and_redoes_years(spark, tmp_path, caplog):
    out = str(tmp_path / "o")
    with caplog.at_level(logging.INFO):
        first = rows_of(record_review.run(spark, SF, out).toPandas())
    assert f"reading {SF}" in caplog.text and "accepted records" in caplog.text
    summary = rows_of(spark.read.parquet(f"{out}/summary").toPandas())
    years = {p.split("/")[0] for p in files_of(f"{out}/records")}
    assert len(years) > 2 and all(y.startswith("year=") for y in years)
    assert rows_of(record_review.run(spark, SF, out).toPandas()) == first
    before = files_of(f"{out}/records")
    redone = record_review.run(spark, SF, out, record_review.Config(years=(1995,)))
    after = files_of(f"{out}/records")
    assert rows_of(redone.toPandas()) == first and rows_of(spark.read.parquet(f"{out}/summary").toPandas()) == summary
    same = lambda files: {k: v for k, v in files.items() if not k.startswith("year=1995")}
    assert same(before) == same(after) and before != after  # only that year's files are new
    stricter = record_review.run(spark, SF, out, record_review.Config(years=(1995,), accept_at=101.0))
    assert stricter.where("year = 1995 and outcome = 'accepted'").count() == 0 < stricter.where("outcome = 'accepted'").count()


def test_review_reads_orders_once(spark):
    for config in (record_review.Config(), record_review.Config(years=(1995,))):
        plan = record_review.records_of(spark, SF, config)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("o_orderdate") > 0 and plan.count("ReadSchema: struct<o_orderkey") == 1


def test_review_outcomes(spark):
    fields = {f: None for f in record_review.FIELDS}
    good = fields | {"borrowers": "Frank Baker (married)", "loan_amount": "$475,950.00", "lender_name": "US Mortgage Corporation"}
    rows = [(1, 1999, *good.values()), (2, None, *fields.values()), (3, 1999, *(good | {"lender_name": None}).values())]
    df = spark.createDataFrame(rows, "doc_id long, year int, " + ", ".join(f"{f} string" for f in record_review.FIELDS))
    got = {r["doc_id"]: r for r in record_review.reviewed(df, record_review.Config()).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {1: "accepted", 2: "rejected", 3: "review"}
    assert got[2]["year"] is None and "critical" in got[2]["recommendations"]
    assert record_review.reviewed(df.limit(0), record_review.Config()).count() == 0


# -- page intake ---------------------------------------------------------------------------


def deliver(spark, rows, folder, schema=PAGE):
    """One more file of pages in a folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_intake_takes_only_what_is_new(spark, tmp_path, caplog):
    into, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    first = [(1, 0, "user", "Loan  Amount"), (1, 1, "user", "Lender: A Bank"), (2, 0, None, None), (1, 0, "user", "Loan  Amount")]
    deliver(spark, first, into)
    take = lambda: page_intake.run(spark, into, out, cp)
    with caplog.at_level(logging.INFO):
        assert take().count() == 3
        assert "took 4 new rows" in caplog.text
        before = files_of(f"{out}/pages")
        caplog.clear()
        assert take().count() == 3 and files_of(f"{out}/pages") == before  # nothing is new
        assert "took 0 new rows" in caplog.text
        deliver(spark, [(2, 1, "user", "[é] || {é}"), (1, 1, "user", "Lender: A Bank"), (1, 2, "user", "")], into)  # one page comes again
        caplog.clear()
        pages = {(r["doc_id"], r["page_no"]): r for r in take().collect()}
        assert "took 3 new rows" in caplog.text
    assert before.items() <= files_of(f"{out}/pages").items()  # what stands there stays
    assert {k: r["quality"] for k, r in pages.items()} == {(1, 0): "clean", (1, 1): "clean", (1, 2): "blank", (2, 0): "blank", (2, 1): "noisy"}
    assert pages[1, 0]["text"] == "Loan Amount" and pages[1, 0]["n_words"] == 2
    got = {r["doc_id"]: r for r in page_intake.documents(page_intake.stored_pages(spark, out)).collect()}
    assert "Loan Amount" in got[1]["text"] and got[1]["text"].index("Loan") < got[1]["text"].index("Lender")
    assert (got[1]["pages"], got[1]["blank"], got[2]["noisy"]) == (3, 1, 1)


def test_intake_of_growing_copies_equals_one_run(spark, tmp_path):
    """A copy of the table that grows file by file gives what the whole gives at once."""
    whole = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    into, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in range(3):
        whole.where(F.pmod("conv_id", F.lit(3)) == part).write.mode("append").parquet(into)
        got = page_intake.run(spark, into, out, cp, page_intake.Config(max_files=1))
    want = page_intake.run(spark, f"{SF}/conversations.parque[t]", str(tmp_path / "o2"), str(tmp_path / "cp2"))
    assert rows_of(got.toPandas()) == rows_of(want.toPandas())


def test_intake_survives_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    into, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    deliver(spark, [(1, 0, "user", "one"), (1, 1, "user", "two")], into)
    fails = F.udf(lambda t: 1 / 0, "string")
    monkeypatch.setattr(page_intake, "clean_text", fails)
    with pytest.raises(Exception):
        page_intake.run(spark, into, out, cp)
    monkeypatch.undo()
    deliver(spark, [(1, 2, "user", "three")], into)
    assert sorted(r["text"] for r in page_intake.run(spark, into, out, cp).collect()) == ["one", "three", "two"]


def test_intake_of_odd_pages(spark, tmp_path):
    into, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    odd = [(None, None, None, None, "x"), (1, None, "", "", "x"), (1, 0, "user", "word " * 200_000, "x"), (1, 0, "user", "  \n\t ", "x")]
    deliver(spark, odd, into, PAGE + ", quality string")
    got = page_intake.run(spark, into, out, cp).collect()
    assert sorted(r["quality"] for r in got) == ["blank", "blank", "blank", "clean"] and max(r["n_words"] for r in got) == 200_000
    empty = str(tmp_path / "empty")
    deliver(spark, [], empty)
    assert page_intake.run(spark, empty, str(tmp_path / "o3"), str(tmp_path / "cp3")).count() == 0


def test_command_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the session of the tests goes on
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"noisy_below": 50}))
    assert page_intake.main(["--input", f"{SF}/conversations.parque[t]", "--output", str(tmp_path / "p"), "--checkpoint", str(tmp_path / "cp"), "--config", str(config)]) == 0
    assert page_intake.stored_pages(spark, str(tmp_path / "p")).count() > 0
    assert page_intake.main(["--input", str(tmp_path / "none"), "--output", str(tmp_path / "p"), "--checkpoint", str(tmp_path / "cp")]) == 1
    assert record_review.main(["--input", SF, "--output", str(tmp_path / "r"), "--years", "1995"]) == 0
    assert {r["year"] for r in spark.read.parquet(str(tmp_path / "r/summary")).collect()} == {1995}
    config.write_text(json.dumps({"unknown": 1}))
    assert record_review.main(["--input", SF, "--output", str(tmp_path / "r"), "--config", str(config)]) == 1
