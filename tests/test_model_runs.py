"""Kept answers, bounded calls, second questions, page ranges, settings that reach plug-ins, saved intermediates."""

import json
import os
import sys
import time
import types
import uuid

import pytest
from pyspark.sql import functions as F

from deedlens import cli, config
from deedlens.fields import FIELDS
from deedlens.plans import pipeline
from deedlens.plans.pipeline import process_documents
from deedlens.sources import answers, files, plugins

FULL = '{"borrowers": "Frank Baker (married)", "loan_amount": "$475,950.00", "lender_name": "A Bank", "recording_date": "4/1/2025", "recording_location": "Albany Office", ' \
    '"lender_nmls_id": "%s", "broker_name": null, "loan_originator_name": "Mary Bryan", "loan_originator_nmls_id": "65175"}'


class Fatal(BaseException):
    """Ends the task, as a lost executor would."""


class Counting:
    """Notes every call in a folder, with the number of calls that run at the same time."""

    def __init__(self, folder, fatal_after=None, seconds=0.0):
        self.folder, self.fatal_after, self.seconds = str(folder), fatal_after, seconds

    def complete(self, prompt):
        if self.fatal_after is not None and len(os.listdir(self.folder)) >= self.fatal_after:
            raise Fatal("the machine is gone")
        mine = f"{self.folder}/{uuid.uuid4().hex}"
        open(mine + ".running", "w").close()
        at_once = sum(n.endswith(".running") for n in os.listdir(self.folder))
        time.sleep(self.seconds)
        with open(mine + ".running", "w") as f:
            json.dump({"prompt": prompt, "at_once": at_once, "at": time.time()}, f)
        os.rename(mine + ".running", mine)
        return self.answer(prompt)

    def answer(self, prompt):
        if "fails" in prompt:
            raise TimeoutError("slow")
        return "answer to " + prompt

    def calls(self):
        return [json.load(open(f"{self.folder}/{n}")) for n in os.listdir(self.folder)]


def client_in(tmp_path, name, kind=Counting, **how):
    (tmp_path / name).mkdir()
    return kind(tmp_path / name, **how)


def test_a_run_that_broke_off_asks_only_what_is_open(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    asked = plugins.questions(docs, {"a": "A {document_text}", "b": "B {document_text}"})
    store = answers.Store(str(tmp_path / "store"), "model 1", answers.Pace(concurrency=2, batch=2))
    first = client_in(tmp_path, "first", fatal_after=10)
    with pytest.raises(Exception):
        store.ask(asked, first, delay=0.0).collect()
    done = store.answers(spark).count()
    assert 0 < done <= 10 and len(first.calls()) <= 10
    second = client_in(tmp_path, "second")
    rows = {(r["doc_id"], r["prompt"]): r["answer"] for r in store.ask(asked, second, delay=0.0).collect()}
    assert rows == {(i, p): f"answer to {p.upper()} text {i}" for i in range(12) for p in "ab"}
    assert len(second.calls()) == 24 - done  # what was answered is not asked again
    third = client_in(tmp_path, "third")
    assert store.ask(asked, third, delay=0.0).count() == 24 and third.calls() == []
    other = answers.Store(store.path, "model 2", store.pace)  # other settings are other questions
    assert other.ask(asked.limit(3), third, delay=0.0).count() == 3 and len(third.calls()) == 3
    assert not [n for n in os.listdir(store.path) if n.startswith("open-")]


def test_failed_questions_stay_open(spark, tmp_path):
    docs = spark.createDataFrame([(1, "fine"), (2, "fails"), (2, "fails"), (None, None)], "doc_id long, text string")
    store = answers.Store(str(tmp_path / "store"))
    client = client_in(tmp_path, "calls")
    how = dict(tries=2, retries=1, delay=0.0)
    got = sorted(store.ask(plugins.questions(docs, {"a": "{document_text}"}), client, **how).collect(), key=str)
    assert [(r["doc_id"], r["answer"], r["attempts"], len(r["errors"])) for r in got if r["doc_id"] == 2] == [(2, None, 2, 2)] * 2
    assert len(got) == 4 and len(client.calls()) == 4  # the repeated question is asked once, in two tries
    again = client_in(tmp_path, "again")
    store.ask(plugins.questions(docs, {"a": "{document_text}"}), again, **how).collect()
    assert {c["prompt"] for c in again.calls()} == {"fails", ""} - ({""} if any(r["answer"] for r in got if r["doc_id"] is None) else set())
    assert store.ask(plugins.questions(docs.limit(0), {"a": "x"}), again, **how).count() == 0


def test_calls_at_once_are_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(24)], "doc_id long, text string").repartition(8)
    client = client_in(tmp_path, "calls", seconds=0.05)
    store = answers.Store(str(tmp_path / "store"), pace=answers.Pace(concurrency=2, batch=12, seconds=0.1))
    assert store.ask(plugins.questions(docs, {"a": "{document_text}"}), client).count() == 24
    calls = client.calls()
    assert len(calls) == 24 and max(c["at_once"] for c in calls) <= 2
    assert max(c["at"] for c in calls) - min(c["at"] for c in calls) >= 0.1 * (24 / 2 - 2)  # the pace holds in every task


class Twice(Counting):
    """The first answers hold one misread and one wrong number; second questions get better and worse ones."""

    def answer(self, prompt):
        if prompt.startswith("An earlier search"):
            return "unreadable" if "lender name" in prompt else ' "3901" '
        return FULL % ("39l" if "doc one" in prompt else "3901")


def test_second_questions_in_the_chain(spark, tmp_path):
    docs = spark.createDataFrame([("in/1", "doc one"), ("in/2", "doc two"), ("in/3", None)], "doc_id string, text string")
    client = client_in(tmp_path, "calls", Twice)
    run = lambda second, c: {r["doc_id"]: r for r in process_documents(docs, 2026, client=c, names=("full_document",), work=str(tmp_path / uuid.uuid4().hex), second=second).collect()}
    plain = run(None, client_in(tmp_path, "plain", Twice))
    assert plain["in/1"]["field_scores"]["lender_nmls_id"] == 20.0
    got = run(50.0, client)
    seconds = [c["prompt"] for c in client.calls() if c["prompt"].startswith("An earlier search")]
    assert len(seconds) == 1 and "lender nmls id gave: 39l" in seconds[0]  # good fields are not asked for
    assert got["in/1"]["lender_nmls_id"] == "3901" and got["in/1"]["overall"] > plain["in/1"]["overall"]
    assert {f: got["in/2"][f] for f in (*FIELDS, "overall")} == {f: plain["in/2"][f] for f in (*FIELDS, "overall")} and got["in/3"]["status"] == "failed"
    strict = client_in(tmp_path, "strict", Twice)
    again = run(86.0, strict)  # company names score 85: they are asked for, and worse answers are not taken
    assert any("lender name" in c["prompt"] for c in strict.calls() if c["prompt"].startswith("An earlier")) and again["in/2"]["lender_name"] == plain["in/2"]["lender_name"]


class Long:
    """A hundred pages; notes which range was rendered."""

    def __init__(self, folder):
        self.folder = str(folder)

    def count(self, content):
        if content == b"bad":
            raise OSError("not a document")
        return int(content)

    def pages(self, content, first, last):
        open(f"{self.folder}/{first}-{last}-{uuid.uuid4().hex}", "w").close()
        return (b"page %d" % n for n in range(first, last + 1))


def test_page_ranges_spread_and_repeat_alone(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    docs = spark.createDataFrame([("long", bytearray(b"100")), ("short", bytearray(b"2")), ("none", bytearray(b"0")), ("bad", bytearray(b"bad"))], "doc_id string, content binary").coalesce(1)
    pages = plugins.rasterize(docs, Long(tmp_path / "seen"), pages_per_task=10)
    rows = pages.withColumn("task", F.spark_partition_id()).collect()
    of = lambda d: sorted((r["page_no"], None if r["image"] is None else bytes(r["image"])) for r in rows if r["doc_id"] == d)
    assert of("long") == [(n, b"page %d" % n) for n in range(1, 101)] and of("short") == [(1, b"page 1"), (2, b"page 2")] and of("none") == []
    assert [(r["page_no"], r["error"]) for r in rows if r["doc_id"] == "bad"] == [(0, "not a document")]
    assert len({r["task"] for r in rows if r["doc_id"] == "long"}) > 1
    ranges = sorted(tuple(map(int, n.split("-")[:2])) for n in os.listdir(tmp_path / "seen"))
    assert ranges == sorted([*((n, n + 9) for n in range(1, 101, 10)), (1, 2)])  # each range is rendered by itself
    some = plugins.rasterize(docs, Long(tmp_path / "seen"), page_range=(5, 27), pages_per_task=10).where("doc_id = 'long'")
    assert sorted(r["page_no"] for r in some.collect()) == list(range(5, 28))
    read = pipeline.read_documents(docs, Long(tmp_path / "seen"), [Reader({})], str(tmp_path / "w"), pages_per_task=40)
    assert {r["doc_id"]: (r["pages"], r["error"]) for r in read.collect()} == {"long": (100, None), "short": (2, None), "none": (0, "no pages"), "bad": (0, "not a document")}


class Reader:
    def __init__(self, settings):
        self.settings, self.name = settings, "reader"

    def read(self, image):
        return f"{image.decode()} read with mode {self.settings.get('page_seg_mode')}", [80.0]


class Renderer:
    def __init__(self, settings):
        self.dpi = settings["dpi"]

    def pages(self, content):
        yield b"%s at %d" % (content, self.dpi)
        yield b"end"


def make_rasterizer(settings):
    return Renderer(settings)


def make_engines(settings):
    return [Reader(settings)]


@pytest.fixture
def plug(monkeypatch):
    """A module of plug-in factories."""
    module = types.ModuleType("made_plugins")
    module.make_rasterizer, module.make_engines = make_rasterizer, make_engines
    monkeypatch.setitem(sys.modules, "made_plugins", module)
    return "made_plugins"


def test_settings_reach_plugins_and_intermediates_are_kept(spark, tmp_path, plug):
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "scan.pdf").write_text(folder)
    (tmp_path / "in" / "other.pdf").write_text("o")
    (tmp_path / "c.json").write_text(json.dumps({"ocr": {"dpi": 222, "page_seg_mode": 4}, "processing": {"output_format": "csv"}}))
    out = tmp_path / "o"
    assert cli.main(["-i", str(tmp_path / "in"), "-o", str(out), "--rules", "--batch", "--plugins", plug, "--save-intermediates", "-c", str(tmp_path / "c.json")]) == 0
    assert (out / "other_ocr_text.txt").read_text() == "o at 222 read with mode 4\n\nend read with mode 4"
    assert (out / "other_images/other_page_001.png").read_bytes() == b"o at 222" and (out / "other_images/other_page_002.png").read_bytes() == b"end"
    assert json.loads((out / "other_result.json").read_text())["status"] == "success"
    assert spark.read.csv(f"{out}/results_csv", header=True).count() == 1


def test_equal_stems_give_results_of_their_own(spark, tmp_path):
    rows = [("x/a/scan.pdf",), ("x/b/scan.txt",), ("x/other.pdf",), ("y/none",)]
    df = spark.createDataFrame(rows, "doc_id string")
    names = {r["doc_id"]: r["name"] for r in files.with_names(df).collect()}
    assert names["x/other.pdf"] == "other" and names["y/none"] == "none"
    assert len(set(names.values())) == 4 and all(names[k].startswith("scan-") for k in ("x/a/scan.pdf", "x/b/scan.txt"))
    done = process_documents(df.withColumn("text", F.lit("Lender: A Bank\nmore\n")), 2026)
    files.write_each(files.result_document(done), str(tmp_path / "each"), "json")
    found = {n.split("=")[1]: [f for f in os.listdir(tmp_path / "each" / n) if f.startswith("part-")] for n in os.listdir(tmp_path / "each") if n.startswith("name=")}
    assert set(found) == set(names.values()) and all(len(f) == 1 for f in found.values())
    whole = (tmp_path / "each" / "name=other" / found["other"][0]).read_text()
    assert json.loads(whole)["final_data"]["lender_name"] == "A Bank"


def test_a_failed_task_leaves_no_results(spark, tmp_path):
    bad = spark.range(4, numPartitions=2).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("x").alias("v"))
    with pytest.raises(Exception):
        files.write_each(bad, str(tmp_path / "each"), "v")
    assert not (tmp_path / "each").exists() or not [n for n in os.listdir(tmp_path / "each") if n.startswith("name=")]


def test_bad_settings_stop_before_anything_is_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    for wrong in ({"ocr": {"dpi": 20}}, {"ai": {"max_concurrent": 0}}, {"processing": {"output_format": "xml"}}):
        (tmp_path / "c.json").write_text(json.dumps(wrong))
        assert cli.main(["-i", str(tmp_path / "a.txt"), "-o", str(tmp_path / "o"), "--rules", "-c", str(tmp_path / "c.json")]) == 1
    assert not (tmp_path / "o/a_result.json").exists()
    assert "output format must be json or csv" in (tmp_path / "o/processing.log").read_text()
    assert config.validate(config.load(env={"GOOGLE_API_KEY": "k"}))["is_valid"]
