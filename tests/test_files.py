"""File sources and sinks, whole pipelines, and streams."""

import io
import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import parse
from ledgerloom.plans import evidence, grouped, manual
from ledgerloom.sources import files
from ledgerloom.streaming.ledger_stream import first_of_reference, windowed_totals

HEADER = [*parse.ACCOUNT_HEADERS, *parse.TRANSACTION_HEADERS]
CSV = "Business Name,Date,Narration,Withdrawal (Dr),Deposit (Cr)\nACME,01-01-2026,UPI/a-b,\"1,000.00\",\n,02-01-2026,UPI a b,5,\n,total,,,\n,03-01-2026,Salary,,9.50\n"


def workbook(rows):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f"<row>{''.join(cells)}</row>" for cells in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Date</t></si><si><t> Narration </t></si><si><r><t>Deposit</t></r><r><t> (Cr)</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd\\-mm\\-yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    return out.getvalue()


def test_csv_through_the_manual_pipeline(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿".encode() + CSV.encode())
    account, transactions = parse.tabular_statement(files.reader_for("s.csv")(spark, str(tmp_path / "s.csv"), HEADER))
    got = manual.run(account, transactions)
    assert got["account"].first()["business_name"] == "ACME"
    clusters = got["clusters"].orderBy("cluster_id").collect()
    assert [(c["normalized_narration"], c["transaction_type"], c["total_amount"], c["cluster_id"]) for c in clusters] == [("UPI A B", "DEBIT", Decimal("1005.00"), 1), ("SALARY", "CREDIT", Decimal("9.50"), 2)]
    assert got["summary"].first()["transaction_count"] == 3


def test_xlsx_cells(spark, tmp_path):
    rows = [
        ['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="D1" t="s"><v>2</v></c>'],
        ['<c r="A2" s="1"><v>46023</v></c>', '<c r="B2" t="inlineStr"><is><t>hi</t></is></c>', '<c r="D2"><v>12.5</v></c>'],
        ['<c r="B3"/>'],
    ]
    (tmp_path / "s.xlsx").write_bytes(workbook(rows))
    got = files.read_xlsx(spark, str(tmp_path / "s.xlsx"), ["Date", "Narration", "Deposit (Cr)", "Missing"]).orderBy("row_no").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "01-01-2026", "hi", "12.5", ""), (1, "", "", "", "")]


def test_pages_meta_and_limits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_text("x" * 100)
    pages = files.read_pages(spark, str(tmp_path))
    assert pages.count() == 3
    assert {r["text"] for r in files.statement_text(pages).collect()} == {"one\ntwo", "x" * 100}
    assert files.uploads(spark, str(tmp_path), max_bytes=50).count() == 1
    assert {(r["name"], r["mime"]) for r in files.file_meta(files.uploads(spark, str(tmp_path))).collect()} == {("a.txt", "text/plain"), ("b.txt", "text/plain")}
    with pytest.raises(ValueError):
        files.reader_for("x.doc")
    out = str(tmp_path / "out")
    result = spark.createDataFrame([(1, Decimal("1.50"))], "id int, amount decimal(15,2)")
    files.append_result(result, out)
    files.append_result(result, out)
    assert spark.read.parquet(out).count() == 2 and files.json_ready(result).first()["amount"] == "1.50"


LEDGER = "statement_id long, seq int, transaction_id string, txn_date date, amount decimal(15,2), direction string, narration string, reference_number string, balance decimal(18,2), opening_balance decimal(15,2), extraction_confidence double"


def rows(spark):
    data = [
        (1, 1, "TXN_00001", date(2026, 1, 1), Decimal(100), "DEBIT", "UPI/john@ybl/JOHN DOE", "123456789", Decimal(900), Decimal(1000), 0.9),
        (1, 2, "TXN_00002", date(2026, 2, 1), Decimal(50), "CREDIT", "REFUND john@ybl", None, Decimal(950), Decimal(1000), 0.5),
        (1, 3, "TXN_00003", date(2026, 3, 1), Decimal(50), "UNKNOWN", "CASH", None, Decimal(1000), Decimal(1000), None),
        (2, 1, "TXN_00001", date(2026, 1, 5), Decimal(5), "DEBIT", "NEFT-HDFC0123456-ACME TRADERS", None, None, None, 0.9),
    ]
    return spark.createDataFrame(data, LEDGER)


def test_evidence_pipeline(spark):
    made = spark.createDataFrame([(1, "TXN_00001", "rent", 0.9, ["lease"], False)], "statement_id long, transaction_id string, category string, confidence double, evidence array<string>, requires_review boolean")
    got = evidence.run(rows(spark), made)
    paid = got["money_paid"].orderBy("statement_id", "rank").collect()
    assert [(r["statement_id"], r["transaction_count"], float(r["total"])) for r in paid] == [(1, 1, 100.0), (2, 1, 5.0)]
    assert got["validation"].filter("statement_id = 1").first()["directions_corrected"] == 1
    exact = [r for r in got["transactions"].collect() if r["counterparty"]["match_type"] == "EXACT"]
    assert [r["transaction_id"] for r in exact] == ["TXN_00002"]
    assert {r["unknown_transaction_ids"][0] for r in got["unknown"].collect()} == {"TXN_00002", "TXN_00001"}
    whole = {r["statement_id"]: r for r in evidence.result_rows(got).collect()}
    assert len(whole) == 2 and len(whole[1]["clusters"]) == 1 and whole[1]["review_queue"][0]["severity"] in ("HIGH", "MEDIUM")


def test_grouped_pipeline(spark):
    none = spark.createDataFrame([], "statement_id long, transaction_id string, category string, counterparty string, payment_mode string, relationship string, confidence double")
    got = grouped.run(rows(spark), none, group_by="counterparty")
    trees = {(r["statement_id"], r["transaction_id"]): r for r in got["transactions"].collect()}
    assert trees[1, "TXN_00001"]["party"]["counterparty"] == "JOHN@YBL" and trees[1, "TXN_00002"]["classification"]["relationship"] == "REFUND"
    assert trees[2, "TXN_00001"]["party"]["counterparty"] == "ACME TRADERS" and trees[2, "TXN_00001"]["cluster_id"] == "CL0001"
    text = got["summary"].filter("statement_id = 1").first()["summary"].split("\n")
    assert text[0] == "Processed 3 transactions for the account." and len(text) == 5


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    data = rows(spark).withColumn("ts", F.col("txn_date").cast("timestamp"))
    data.write.parquet(source)
    stream = spark.readStream.schema(data.schema).parquet(source)
    for name, df, mode in (("totals", windowed_totals(stream), "append"), ("first", first_of_reference(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.table("first").count() == 4
    assert {r["transaction_count"] for r in spark.table("totals").collect()} <= {1}
