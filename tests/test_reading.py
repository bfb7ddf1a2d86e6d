"""Readers, steps, PDF text layers, uploads and sinks."""

import json
import sys
import zipfile
import zlib
from datetime import date
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.operators import parse, readers
from ledgerloom.plans import grouped, manual
from ledgerloom.plans.steps import StepFailed, Steps
from ledgerloom.sources import files
from ledgerloom.sources.pdf import pdf_pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def row(**over):
    return {"date": "2026-01-02", "description": "x", "amount": 1, "direction": "CR"} | over


def test_reading_tries_and_checks():
    answers = [None, ValueError("down"), [row()]]

    def flaky(task, text):
        out = answers.pop(0)
        if isinstance(out, Exception):
            raise out
        return out

    assert len(readers.read(flaky, "rows", "", readers._rows)) == 1
    with pytest.raises(readers.ReadingFailed):
        readers.read(lambda *_: None, "rows", "")
    with pytest.raises(readers.ReadingFailed):
        readers.read(lambda *_: [{"description": "no amount"}], "rows", "", readers._rows)


def test_ranges_that_fail_are_halved():
    lines, asked = [f"line {i}" for i in range(40)], []

    def short_sighted(task, text):
        asked.append(text.count("\n") + 1)
        if text.count("\n") > 21:
            return None
        return [row(source_line=int(x.split(":")[0][1:]), description=x) for x in text.split("\n")]

    found = readers.read_range(short_sighted, lines, 0, 40)
    assert [r["source_line"] for r in found] == list(range(40)) and max(asked) == 40
    with pytest.raises(readers.ReadingFailed):
        readers.read_range(lambda *_: None, lines, 0, 40)


class Failing(readers.LineReader):
    """Fails on long texts, and on any text with a bad line."""

    def __init__(self, longest):
        self.longest = longest

    def __call__(self, task, text):
        return None if len(text) > self.longest or "bad" in text else super().__call__(task, text)


@pytest.fixture(scope="module")
def texts(spark):
    lines = lambda n, extra="": "head\n" + "\n".join(f"2026-01-{i % 28 + 1:02d} paid to {i} {i}.50 {'Cr' if i % 3 else 'Withdrawal'}" for i in range(n)) + extra
    return spark.createDataFrame([(1, lines(200)), (2, lines(3)), (3, lines(3, "\nbad")), (4, "nothing here"), (5, None)], "statement_id long, text string")


def test_chunks_of_failed_statements_are_read_again(spark, texts):
    rows, states = readers.read_chunks(texts, Failing(2500), chunk_chars=4000)
    state = {r["statement_id"]: r for r in states.collect()}
    assert state[1]["status"] == state[2]["status"] == "OK" and state[1]["read_rows"] == 200 and state[1]["parts"] > 2
    assert state[3]["status"] == "ERROR: chunks [0] of 1 failed." and state[4]["status"].startswith("ERROR: no transactions")
    got = rows.filter("statement_id = 1").orderBy("seq").collect()
    assert [r["transaction_id"] for r in got[:2]] == ["tx_000001", "tx_000002"] and got[5]["amount"] == Decimal("5.50")
    assert got[0]["direction"] == "DEBIT" and got[1]["direction"] == "CREDIT" and got[0]["extraction_confidence"] == 0.8
    assert rows.filter("statement_id = 3").count() == 0


def test_ranges_leave_out_what_fails(spark, texts):
    rows, states = readers.read_ranges(texts, Failing(1500), chunk_chars=2000)
    state = {r["statement_id"]: r for r in states.collect()}
    assert state[1]["status"] == "OK" and state[1]["read_rows"] == 200 and state[1]["warnings"] == []
    assert state[3]["status"].startswith("ERROR") and state[3]["warnings"][0].startswith("Lines 0-5 failed extraction")
    got = rows.filter("statement_id = 1").orderBy("seq").collect()
    assert got[0]["transaction_id"] == "TXN_00001" and [r["source_line"] for r in got] == list(range(1, 201)) and got[0]["direction"] == "DEBIT" and got[0]["date"] == "2026-01-01"


def test_boundaries_layout_and_records(spark):
    text = "Bank\nDate Narration Withdrawal Deposit Balance\n01-02-2026 a 1.00 5.00\n02-02-2026 b 2.00 3.00"
    frame = spark.createDataFrame([(1, text), (2, text), (3, "no table")], "statement_id long, text string")
    guesses = spark.createDataFrame([(1, 3), (2, 40)], "statement_id long, first_transaction_line int")
    got = {r["statement_id"]: (r["first_line"], r["method"]) for r in readers.boundaries(frame, guesses).collect()}
    assert got == {1: (3, "llm"), 2: (2, "heuristic"), 3: (None, None)}
    found = readers.boundaries(frame)
    parts = {r["statement_id"]: r for r in readers.split_at(frame, found).collect()}
    assert set(parts) == {1, 2} and parts[1]["header_text"].endswith("Balance") and parts[1]["txn_text"].startswith("01-02")
    layout = {r["statement_id"]: r for r in readers.sniff_layout(frame, found).collect()}
    assert layout[1]["column_names"] == ["date", "narration", "debit", "credit", "balance"] and layout[1]["direction_style"] == "TWO_COLUMNS" and layout[3]["column_names"] is None or layout[3]["column_names"] == []
    record = readers.read_records(frame, lambda task, shown: {"bank_name": shown[:4], "extra": 1} if "Bank" in shown else None, "account", readers.header_window(F.col("text")), ["bank_name", "holder"])
    assert {r["statement_id"]: (r["bank_name"], r["holder"], r["error"] is None) for r in record.collect()} == {1: ("Bank", None, True), 2: ("Bank", None, True), 3: (None, None, False)}


def test_document_scan(spark):
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("b", 1, " "), ("c", 1, "bad")], "statement_id string, page_no int, text string")

    def page(task, text):
        return None if text == "bad" else {"account": {"bank": text, "holder": None if text == "one" else "H"}, "summary": {"closing": text}, "transactions": [row(description=text)]}

    documents, transactions = readers.scan_documents(pages, page, ["bank", "holder"], ["closing"], pages_read=2)
    got = {r["statement_id"]: r for r in documents.collect()}
    assert got["a"]["account"].asDict() == {"bank": "one", "holder": "H"} and got["a"]["summary"]["closing"] == "two" and got["a"]["errors"] == []
    assert got["b"]["account"] is None and got["c"]["errors"][0]["page_no"] == 1
    assert [(r["source_page"], r["description"]) for r in transactions.orderBy("source_page").collect()] == [(1, "one"), (2, "two")]
    assert readers.scan_documents(pages, page, ["bank"], ["closing"])[1].count() == 1


def test_steps(spark):
    tried = []

    def fails():
        tried.append(1)
        raise ValueError("no")

    steps = Steps(frozenset({"soft"}))
    assert steps.run("soft", fails, lambda: "default") == "default" and steps.warnings[0].startswith("Stage 'soft'")
    assert steps.run("hard", fails, again=lambda: 7) == 7 and steps.run("hard", fails) == 7 and len(tried) == 2
    with pytest.raises(StepFailed):
        steps.run("other", fails)
    steps.reopen("hard")
    assert steps.run("hard", lambda: 8) == 8
    assert [(r["step"], r["status"]) for r in steps.statuses(spark).orderBy("step_no").collect()] == [("soft", "ERROR"), ("hard", "ERROR"), ("hard", "OK"), ("other", "ERROR"), ("hard", "OK")]


def pdf(*pages, packed=False):
    """A PDF of pages of operators."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)}
    objects[3] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
    cmap = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0010> <0012> <0061> endbfrange"
    objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    for i, page in enumerate(pages):
        data = zlib.compress(page)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F2 3 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
    out = b"%PDF-1.5\n"
    if packed:
        loose = [n for n in objects if b"stream" not in objects[n]]
        body, places = b"", []
        for n in loose:
            places.append(b"%d %d" % (n, len(body)))
            body += objects.pop(n) + b" "
        head = b" ".join(places) + b" "
        data = zlib.compress(head + body)
        objects[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(loose), len(head), len(data), data)
    return out + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_text_layers(spark, tmp_path, packed):
    one = b"BT /F1 10 Tf 1 0 0 1 200 700 Tm (1,200.50) Tj ET BT 1 0 0 1 20 700 Tm (Paid \\(UPI\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET BT 1 0 0 1 20 720 Tm (First) ' ET"
    two = b"BT /F2 9 Tf 50 500 Td <00010010 0011> Tj ET"
    assert pdf_pages(pdf(one, two, packed=packed)) == ["First\nPaid (UPI) 1,200.50\nsecond line", "Aab"]
    with pytest.raises(ValueError):
        pdf_pages(b"plain")
    (tmp_path / "s.pdf").write_bytes(pdf(one, two, packed=packed))
    (tmp_path / "broken.pdf").write_bytes(b"not one")
    got = {(r["statement_id"].rsplit("/", 1)[1], r["page_no"]): (r["text"], r["error"]) for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert got[("s.pdf", 2)] == ("Aab", None) and got[("broken.pdf", None)][1] == "not a PDF file"


def test_uploads_are_accepted_or_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "big.csv").write_text("x" * 100)
    got = {r["name"]: (r["length"], r["status"]) for r in files.upload_statuses(spark, str(tmp_path), ["a.csv", "gone.csv"], max_bytes=50).collect()}
    assert got == {"a.csv": (1, "ACCEPTED"), "big.csv": (100, "REJECTED: larger than 50 bytes"), "gone.csv": (None, "REJECTED: no such file")}


def test_the_active_sheet_is_read(tmp_path):
    main, links = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda x: f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>{x}</t></is></c></row></sheetData></worksheet>'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", sheet("first"))
        book.writestr("xl/worksheets/sheet2.xml", sheet("second"))
    assert files.sheet_rows(path.read_bytes()) == [["second"]]


def test_results_are_typed_and_json_is_exact(spark, tmp_path):
    made = spark.createDataFrame([(1, "2026-01-02T10:00", 12.3, "x")], "statement_id long, day string, total double, note string")
    files.append_result(made, str(tmp_path / "r"), dates=["day"], money=["total"])
    files.append_result(made, str(tmp_path / "r"), dates=["day"], money=["total"])
    got = spark.read.parquet(str(tmp_path / "r")).collect()
    assert len(got) == 2 and got[0]["day"] == date(2026, 1, 2) and got[0]["total"] == Decimal("12.30")
    nested = spark.sql("select named_struct('a', cast(1.10 as decimal(5,2)), 'b', array(cast(2.5 as decimal(5,2)))) as s, map('k', cast(3 as decimal(5,2))) as m, 1 as n")
    assert json.loads(files.json_ready(nested).toJSON().first()) == {"s": {"a": "1.10", "b": ["2.50"]}, "m": {"k": "3.00"}, "n": 1}


def test_pages_without_rows_count(spark):
    rows = spark.createDataFrame([(1, 1, "a", "CREDIT")], "statement_id long, page_no int, narration string, transaction_type string")
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "statement_id long, page_no int")
    got = {r["statement_id"]: (r["page_count"], r["transaction_count"], r["cluster_count"]) for r in manual.summary(rows, rows, pages).collect()}
    assert got == {1: (2, 1, 1), 2: (1, 0, 0)}


def test_periods_are_filled_in(spark):
    frame = spark.createDataFrame([("", None, None, "2026-01-01", "2026-02-01"), ("Jan", "2026-01-05", None, "2026-01-01", "2026-02-01"), (None, None, None, None, None)], "statement_period string, statement_period_start string, statement_period_end string, first_day string, last_day string")
    got = [tuple(r)[:3] for r in grouped.with_period(frame).collect()]
    assert got == [("2026-01-01 to 2026-02-01", "2026-01-01", "2026-02-01"), ("Jan", "2026-01-05", "2026-02-01"), (None, None, None)]


def test_cells_amounts_and_ids(spark):
    frame = spark.sql("select date'2026-01-02' as d, ' x ' as s, cast(null as int) as n, '1,200.50' as a, '-7' as b, 'z' as c")
    got = frame.select(t.cell_to_text(F.col("d"), "date"), t.cell_to_text(F.col("s"), "string"), t.cell_to_text(F.col("n"), "int"), t.parse_amount(F.col("a")), t.parse_amount(F.col("b")), t.parse_amount(F.col("c"))).first()
    assert tuple(got) == ("02-01-2026", "x", "", Decimal("1200.50"), Decimal("7.00"), None)
    assert parse.owned_rows(spark.sql("select * from values (1, 0, 2), (3, 0, 2), (null, 0, 2) as t(source_line, start, stop)")).count() == 2
