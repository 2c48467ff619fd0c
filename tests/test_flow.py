"""Selection, pages, summaries, plug-ins, settings, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from deedlens import cli, config, doctor
from deedlens.fields import FIELDS
from deedlens.operators import model, pages, selection, summary, verify
from deedlens.plans import pipeline
from deedlens.plans.pipeline import process_documents
from deedlens.sources import files, plugins
from deedlens.streaming import ingest

TEXT = """MORTGAGE
Borrower(s): Frank Baker and Mary Baker (husband and wife)
Principal Amount: $475,950.00
Recorded on 04/01/2025
Lender: A and B Bank
NMLS ID: 3901
Loan Originator: Mary Bryan
LO NMLS ID: 65175
"""


def test_best_ocr_first_wins_ties(spark):
    df = spark.createDataFrame([(1, "t", 0, "a", 50.0), (1, "e", 1, "b", 50.0), (2, "t", 0, "a", 50.0), (2, "e", 1, " ", 90.0)], "page int, engine string, rank int, text string, confidence double")
    best = lambda **k: {r["page"]: r["engine"] for r in selection.best_ocr(df, ["page"], **k).collect()}
    assert best() == {1: "t", 2: "e"}
    assert best(preferred="e") == {1: "e", 2: "e"}


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, "b", 50.0), (1, 1, "a", None), (1, 3, "", 70.0)], "doc_id int, page_no int, text string, confidence double").withColumn("processing_time", F.lit(0.5))
    r = pages.doc_ocr(df, "doc_id", simple=True).first()
    assert (r["text"], r["confidence"], r["processing_time"], r["pages"]) == ("a\n\nb", 40.0, 1.5, 3)


def test_empty_summary(spark):
    df = spark.createDataFrame([], "document string, status string, overall double, processing_time double, error string, " + ", ".join(f"{f} string" for f in FIELDS))
    assert tuple(summary.batch_summary(df).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    assert [r["rate"] for r in summary.field_rates(df).collect()] == [0.0] * 9


def test_process_documents(spark):
    rows = {r["doc_id"]: r for r in process_documents(spark.createDataFrame([(1, TEXT), (2, None), (3, "nothing")], "doc_id long, text string"), 2026).collect()}
    assert rows[1]["loan_amount"] == "475,950.00" and rows[1]["lender_nmls_id"] == "3901" and rows[1]["is_valid"]
    assert rows[2]["status"] == "failed" and rows[3]["status"] == "success" and rows[3]["overall"] == 0.0


class Pages:
    def pages(self, content):
        if content == b"bad":
            raise OSError("not a document")
        yield from (content + bytes([48 + i]) for i in range(1, 4))


class Engine:
    name = "fake"

    def read(self, image):
        if image.endswith(b"2"):
            raise RuntimeError("unreadable")
        return image.decode(), [90.0, -1.0, 70.0]


class Client:
    def complete(self, prompt):
        if "boom" in prompt:
            raise TimeoutError("slow")
        return 'Sure: {"borrowers": "A"} ok'


def test_plugins(spark):
    docs = spark.createDataFrame([(1, bytearray(b"p")), (2, bytearray(b"bad"))], "doc_id long, content binary")
    images = plugins.rasterize(docs, Pages(), page_range=(2, 3))
    assert sorted((r["doc_id"], r["page_no"], r["error"]) for r in images.collect()) == [(1, 2, None), (1, 3, None), (2, 0, "not a document")]
    read = plugins.recognise(images.where("image is not null"), [Engine()]).orderBy("page_no").collect()
    assert [(r["text"], r["confidence"], r["error"]) for r in read] == [("", 0.0, "unreadable"), ("p3", 80.0, None)]
    texts = spark.createDataFrame([(1, "x"), (2, "boom")], "doc_id long, text string")
    got = plugins.ask(texts, Client(), {"full": "Q {document_text}"}, retries=2, delay=0.0).orderBy("doc_id").collect()
    assert [(r["attempts"], r["answer"] is None, len(r["errors"])) for r in got] == [(1, False, 0), (2, True, 2)]


class Answers:
    """Answers JSON to prompts that ask for it, a quoted value otherwise, garbage at first."""

    def __init__(self):
        self.calls = 0

    def complete(self, prompt):
        self.calls += 1
        if "one JSON object" not in prompt:
            return ' "Frank Baker" ' if "borrowers" in prompt else "null"
        if "whose keys are" in prompt and self.calls % 2:
            return "sorry"
        return '{"borrowers": "A B", "loan_amount": 20000, "lender_name": "Bank", "lender_nmls_id": null}'


def test_model_strategies(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    frames = model.run_strategies(docs, Answers(), ("full_document", "field_by_field", "unknown"), delay=0.0)
    assert [name for name, _ in frames] == ["full_document", "field_by_field"]
    full, each = (df.first() for _, df in frames)
    assert (full["borrowers"], full["loan_amount"], full["lender_nmls_id"], full["attempts"]) == ("A B", "20000", None, 2)
    # the groups' objects come after the single answers and state these fields, too: later answers win
    assert (each["borrowers"], each["loan_amount"], each["lender_name"], each["recording_date"]) == ("A B", "20000", "Bank", None)
    best = selection.best_extraction(selection.strategies(frames)).first()
    assert best["strategy_used"] == "full_document"


def test_page_sink_info_and_doctor(spark, tmp_path):
    folder = str(tmp_path)
    images = spark.createDataFrame([("a/x.pdf", 1, bytearray(b"i"), None), ("a/x.pdf", 2, bytearray(b"j"), None), ("b", 0, None, "bad")], "doc_id string, page_no int, image binary, error string")
    plugins.save_pages(images, lambda name, data: open(f"{folder}/{name}", "wb").write(data))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.pdf_page_001.png", "x.pdf_page_002.png"]
    sizes = spark.createDataFrame([("a/x.pdf", 5 * 1024 * 1024), ("b", 1)], "doc_id string, length long")
    got = {r["doc_id"]: (r["file_size_mb"], r["page_count"], r["error"]) for r in files.doc_info(sizes, images).collect()}
    assert got == {"a/x.pdf": (5.0, 2, None), "b": (0.0, 0, "bad")}
    assert doctor.checks({})["package pyspark"] and doctor.verdict({"a": True, "b": False})[1] == "fail"


def test_retry():
    waits, left = [], [ValueError("a"), ValueError("b")]

    def call():
        if left:
            raise left.pop()
        return "ok"

    assert plugins.with_retry(call, 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        plugins.with_retry(lambda: (_ for _ in ()).throw(ValueError("x")), 2, 0.0, waits.append)


def test_settings(tmp_path):
    s = config.load(profile="production", env={"OCR_DPI": "200", "GOOGLE_API_KEY": "k"})
    assert (s.ocr.dpi, s.ai.min_confidence) == (300, 50.0) and config.validate(s)["is_valid"]
    assert config.load(profile="unknown", env={"OCR_DPI": "200"}).ocr.dpi == 200
    assert "API key is not set" in config.validate(config.load(env={}))["issues"]
    nested = tmp_path / "c.json"
    nested.write_text(json.dumps({"ai": {"temperature": 3, "unknown": 1}}))
    assert config.validate(config.load(str(nested), env={"GOOGLE_API_KEY": "k"}))["issues"] == ["temperature must be between 0 and 2"]
    with pytest.raises(ValueError):
        config.load(env={}).api_config()


def test_files_cli_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text(TEXT)
    (source / "b.pdf").write_text("x")
    docs = files.documents(spark, str(source), "*.txt", text=True)
    assert [r["document"] for r in docs.collect()] == ["a.txt"]
    assert files.documents(spark, str(source), "*.none").count() == 0
    out = str(tmp_path / "o")
    assert cli.main(["-i", str(tmp_path / "no"), "-o", out, "--rules"]) == 1
    assert cli.main(["-i", str(source), "-o", out, "--rules"]) == 1  # a folder without --batch
    assert cli.main(["-i", str(source / "a.txt"), "-o", out, "--rules", "--batch"]) == 1
    assert cli.main(["-i", str(source), "-o", out, "--rules", "--batch", "--save-intermediates"]) == 0
    assert spark.read.json(f"{out}/processing_summary").first()["successful"] == 1
    result = json.loads((tmp_path / "o/a_result.json").read_text())
    assert result["document_name"] == "a" and result["final_data"]["broker_name"] is None  # nulls are kept
    assert "no such folder" in (tmp_path / "o/processing.log").read_text() and not (tmp_path / "o/_work").exists()
    q = ingest.run(ingest.text_stream(spark, str(source)), str(tmp_path / "s"), str(tmp_path / "cp"), 2026)
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_cli_settings_and_exit_codes(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "own.json").write_text(json.dumps({"validation": {"max_loan_amount": 1000.0}}))
    run = lambda *more: cli.main(["-i", str(tmp_path / "a.txt"), "-o", str(tmp_path / "o"), *more])
    monkeypatch.delenv("GOOGLE_API_KEY", raising=False)
    assert run() == 1 and "GOOGLE_API_KEY is not set" in (tmp_path / "o/processing.log").read_text()
    assert run("--rules") == 0
    shown = capsys.readouterr().out
    assert "  broker_name: [Not Found]" in shown and "  loan_amount: 475,950.00" in shown and "Status: success" in shown
    assert run("--rules", "-c", str(tmp_path / "own.json")) == 0
    assert json.loads((tmp_path / "o/a_result.json").read_text())["validation_details"]["field_scores"]["loan_amount"] == 10.0
    monkeypatch.setenv("GOOGLE_API_KEY", "k")
    assert run() == 1  # a key, but no client


class Enhancer:
    def enhance(self, image):
        return image.upper()


class TextEngine:
    def __init__(self, name, text, confidences):
        self.name, self.text, self.confidences = name, text, confidences

    def read(self, image):
        if image.endswith(b"3"):
            raise RuntimeError("unreadable")
        return self.text if image.endswith(b"1") else "page " + image.decode(), self.confidences


def test_files_to_records(spark, tmp_path):
    """Render, enhance, read, join, ask, choose, validate and report, all by fakes."""
    docs = spark.createDataFrame([("in/a.pdf", bytearray(b"p")), ("in/b.pdf", bytearray(b"bad"))], "doc_id string, content binary")
    engines = [TextEngine("one", "blurred", [20.0]), TextEngine("two", TEXT, [90.0, 70.0])]
    read = {r["doc_id"]: r for r in pipeline.read_documents(docs, Pages(), engines, str(tmp_path / "w"), Enhancer()).collect()}
    a, b = read["in/a.pdf"], read["in/b.pdf"]
    assert a["text"] == TEXT + "\n\npage P2" and a["pages"] == 3 and abs(a["ocr_confidence"] - 160 / 3) < 1e-9 and a["error"] is None
    assert b["text"] is None and b["error"] == "not a document"
    for client in (None, Answers()):
        got = pipeline.process_files(docs, Pages(), engines, str(tmp_path / "w"), 2026, client=client, enhancer=Enhancer())
        a, b = got.orderBy("doc_id").collect()
        assert (a["status"], b["status"], b["error"]) == ("success", "failed", "not a document")
        assert a["stages"]["conversion"]["pages"] == 3 and a["stages"]["ocr"]["text_length"] == len(TEXT) + 9
        assert a["stages"]["extraction"]["strategy_used"] == a["strategy_used"] and a["stages"]["validation"]["confidence"] == a["overall"]
        assert a["borrowers"] is not None and a["is_valid"]
    saved = {r["name"]: json.loads(r["json"]) for r in files.result_document(got.withColumn("document", F.element_at(F.split("doc_id", "/"), -1))).collect()}
    assert set(saved) == {"a", "b"} and saved["b"]["error"] == "not a document" and saved["a"]["stages"]["ocr"]["confidence"] > 50


class Sections:
    """Each section states the fields that stand there; all name a lender."""

    def complete(self, prompt):
        found = {"lender_name": "First" if "beginning" in prompt else "Later"}
        if "middle" in prompt:
            found |= {"borrowers": "A B", "loan_amount": 20000}
        if "its end" in prompt:
            return 'Here: {"lender_name": "Later", "loan_originator_name": "C D", "borrowers": null}'
        return json.dumps(found)


def test_sections(spark):
    docs = spark.createDataFrame([(1, "header " * 30 + "body " * 60 + "signature " * 30)], "doc_id long, text string")
    ((name, df),) = model.run_strategies(docs, Sections(), ("section_based",), delay=0.0)
    r = df.first()
    assert name == "section_based" and r["attempts"] == 3
    assert (r["lender_name"], r["borrowers"], r["loan_amount"], r["loan_originator_name"], r["broker_name"]) == ("First", "A B", "20000", "C D", None)
    late = spark.createDataFrame([(1, "x" * 300 + "\nLender: Last Bank\n")], "doc_id long, text string")
    assert pipeline.extract_documents(late).first()["lender_name"] == "Last Bank"


class Checker:
    def complete(self, prompt):
        if prompt.startswith("Is "):
            return 'So: {"is_valid": false, "confidence_score": 40, "issues_found": ["letter"], "suggested_correction": "3901"}' if "= 390l" in prompt else "no idea"
        if "Rate each" in prompt:
            assert '"broker_name":null' in prompt
            return '{"lender_nmls_id": {"value": "390l", "confidence": 55, "reasoning": "one letter"}}'
        assert "gave: 390l" in prompt and "lender nmls id" in prompt
        return '"3901"'


def test_second_questions(spark):
    rows = [(1, "NMLS 3901", "390l", *[None] * 8), (2, "x", "5", *[None] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lender_nmls_id string, " + ", ".join(f"{f} string" for f in FIELDS if f != "lender_nmls_id"))
    a, b = verify.check_value(df, "lender_nmls_id", Checker(), delay=0.0).orderBy("doc_id").collect()
    assert (a["is_valid"], a["confidence_score"], a["issues_found"], a["suggested_correction"]) == (False, 40.0, ["letter"], "3901") and b["is_valid"] is None
    assert verify.assess(df, Checker(), delay=0.0).first()["confidences"]["lender_nmls_id"]["confidence"] == 55.0
    assert verify.clarify(df.where("doc_id = 1"), "lender_nmls_id", Checker(), delay=0.0).first()["value"] == "3901"


def test_first_page_size(spark):
    png = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"rest"
    pages = spark.createDataFrame([("a", 1, bytearray(png), None), ("a", 2, bytearray(b"x"), None), ("b", 1, bytearray(b"x"), None)], "doc_id string, page_no int, image binary, error string")
    info = {r["doc_id"]: r["first_page_size"] for r in files.doc_info(spark.createDataFrame([("a", 9), ("b", 9)], "doc_id string, length long"), pages).collect()}
    assert tuple(info["a"]) == (640, 480) and info["b"] is None


def test_enhance(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "n int, image binary")
    assert [None if r["image"] is None else bytes(r["image"]) for r in plugins.enhance(df, Enhancer()).orderBy("n").collect()] == [b"AB", None]


def test_choice_within_the_row(spark):
    """Equal to the choice by groups, in one scan without an exchange."""
    from deedlens.operators import extract
    from deedlens.plans.fixtures import mortgages
    from deedlens.plans.queries import DOCUMENT_SQL

    from .conftest import SF

    mortgages(spark, SF).createOrReplaceTempView("mortgages")
    docs = spark.sql(DOCUMENT_SQL).unionByName(spark.createDataFrame([(-1, "x" * 300 + "\nLender: Last Bank\n"), (-2, "")], "doc_id long, text string"))
    docs.write.mode("overwrite").saveAsTable("rule_documents")
    docs = spark.table("rule_documents")
    frames = [("full_document", extract.rule_strategy(docs)), *extract.rule_sections(docs)]
    order = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for least in (30.0, 100.0):
        want = selection.best_extraction(selection.strategies(frames), "doc_id", least)
        got = pipeline.extract_documents(docs, "text", least)
        assert order(got) == order(want.select(got.columns)), least
    plan = process_documents(docs, 2026)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_documents_fail_alone(spark, tmp_path):
    """One broken file and one broken image give a failed row each, in the batch and in the stream."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text(TEXT)
    (source / "b.txt").write_bytes(b"\xff\xfe broken")
    (source / "c.txt").write_text("é")
    (source / "d.txt").write_text(" ")
    docs = files.documents(spark, str(source), "*.txt", text=True)
    of = lambda df: {r["doc_id"].rsplit("/", 1)[-1]: (r["status"], r["error"]) for r in df.collect()}
    want = {"a.txt": ("success", None), "b.txt": ("failed", "not valid UTF-8"), "c.txt": ("success", None), "d.txt": ("success", None)}
    assert of(process_documents(docs, 2026)) == want
    assert of(process_documents(docs, 2026, client=Answers(), work=str(tmp_path / "w"))) == want
    ingest.run(ingest.text_stream(spark, str(source)), str(tmp_path / "s"), str(tmp_path / "cp"), 2026).awaitTermination(120)
    assert of(spark.read.json(str(tmp_path / "s"))) == want
    assert cli.main(["-i", str(source), "-o", str(tmp_path / "o"), "--rules", "--batch"]) == 0
    assert json.loads((tmp_path / "o/b_result.json").read_text())["error"] == "not valid UTF-8"

    class Picky:
        def enhance(self, image):
            if image == b"q2":
                raise ValueError("no image data")
            return image

    scans = spark.createDataFrame([("p", bytearray(b"p")), ("q", bytearray(b"q")), ("r", bytearray(b"bad"))], "doc_id string, content binary")
    got = {r["doc_id"]: (r["text"] is None, r["error"]) for r in pipeline.read_documents(scans, Pages(), [Engine()], str(tmp_path / "w"), Picky()).collect()}
    assert got == {"p": (False, None), "q": (True, "enhancement failed: no image data"), "r": (True, "not a document")}
    done = pipeline.process_files(scans, Pages(), [Engine()], str(tmp_path / "w"), 2026, enhancer=Picky())
    assert of(done) == {"p": ("success", None), "q": ("failed", "enhancement failed: no image data"), "r": ("failed", "not a document")}


def test_merged_answers(spark):
    """Later answers win, also with nulls; keys beyond a prompt's own count, too."""
    class Overlapping:
        def complete(self, prompt):
            if "one JSON object" not in prompt:
                return "null" if "loan amount" in prompt else "A B"
            if "recording_date" in prompt:
                return '{"recording_date": "1/1/2020", "lender_name": "Early", "borrowers": "C D"}'
            return '{"lender_name": null}' if "lender_nmls_id" in prompt else "no json"

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    ((_, df),) = model.run_strategies(docs, Overlapping(), ("field_by_field",), delay=0.0)
    r = df.first()
    assert (r["borrowers"], r["recording_date"], r["lender_name"], r["loan_amount"], r["attempts"]) == ("C D", "1/1/2020", None, None, 5)
