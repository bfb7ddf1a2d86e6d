"""Entry points for whole statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import iso_date
from ledgerloom.operators import readers
from ledgerloom.operators.parse import account_window
from ledgerloom.plans import evidence, grouped
from ledgerloom.plans.results import Results
from ledgerloom.plans.steps import Steps

NO_CLASSIFICATIONS = "statement_id long, transaction_id string, category string, counterparty string, payment_mode string, relationship string, confidence double"
NO_JUDGEMENTS = "statement_id long, transaction_id string, category string, confidence double, evidence array<string>, requires_review boolean"


def process(ledger: DataFrame, classifications: DataFrame | None = None, merges: DataFrame | None = None, group_by: str | Sequence[str] | None = None, include_transactions: bool = True) -> Results:
    """The grouped pipeline. Without ``classifications`` the rules alone decide."""
    made = classifications if classifications is not None else ledger.sparkSession.createDataFrame([], NO_CLASSIFICATIONS)
    out = grouped.run(ledger, made, merges, group_by)
    return out if include_transactions else out.without("transactions")


def intelligence(ledger: DataFrame, classifications: DataFrame | None = None, readings: DataFrame | None = None, account: DataFrame | None = None, include_transactions: bool = True) -> Results:
    """The evidence-based pipeline. Its groupings are fixed."""
    made = classifications if classifications is not None else ledger.sparkSession.createDataFrame([], NO_JUDGEMENTS)
    out = evidence.run(ledger, made, readings, account)
    return out if include_transactions else out.without("transactions")


ACCOUNT_FIELDS = ["account_number", "account_holder_name", "bank_name", "statement_period", "statement_period_start", "statement_period_end"]


def _ledger(rows: DataFrame) -> DataFrame:
    """Rows that a reader gave as a ledger."""
    return rows.select(
        "statement_id", "seq", "transaction_id", iso_date(F.col("date")).alias("txn_date"), "amount", "direction", F.col("description").alias("narration"), "reference_number",
        F.col("balance").cast("decimal(18,2)").alias("balance"), F.lit(None).cast("decimal(15,2)").alias("opening_balance"), "extraction_confidence",
    )


def _no_account(texts: DataFrame) -> DataFrame:
    return texts.select("statement_id", *[F.lit(None).cast("string").alias(f) for f in ACCOUNT_FIELDS], F.lit("account not read").alias("error"))


def process_texts(texts: DataFrame, reader: readers.Reader, classifications: DataFrame | None = None, merges: DataFrame | None = None, group_by: str | Sequence[str] | None = None, chunk_chars: int = 3500) -> tuple[Results, DataFrame, Steps]:
    """Statement texts (statement_id, text) through a reader and the grouped pipeline: results, a status for each statement
    (status, first_line, method, parts, read_rows), and the steps. A statement without a status of OK has no rows; one whose
    account can't be read has an empty account."""
    steps = Steps(frozenset({"account", "layout"}))
    found = steps.run("boundaries", lambda: readers.boundaries(texts))
    parts = steps.run("split", lambda: readers.split_at(texts, found))
    account = steps.run("account", lambda: readers.read_records(parts, reader, "account", readers.header_window(F.col("header_text")), ACCOUNT_FIELDS), lambda: _no_account(parts))
    layout = steps.run("layout", lambda: readers.sniff_layout(texts, found))
    rows, read = steps.run("transactions", lambda: readers.read_chunks(parts, reader, text="txn_text", chunk_chars=chunk_chars))
    missing = F.when(F.col("first_line").isNull(), "ERROR: could not find where the transactions start.")
    statuses = found.join(read.drop("failed"), "statement_id", "left").withColumn("status", F.coalesce(missing, "status"))
    results = steps.run("pipeline", lambda: process(_ledger(rows), classifications, merges, group_by))
    more = {"account": lambda _: account, "layout": lambda _: layout, "statement": lambda _: grouped.result_rows(results, account.drop("error"), statuses)}
    return Results({k: (lambda _, k=k: results[k]) for k in results} | more), statuses, steps


def intelligence_texts(texts: DataFrame, reader: readers.Reader, classifications: DataFrame | None = None, readings: DataFrame | None = None, chunk_chars: int = 3500) -> tuple[Results, DataFrame, Steps]:
    """Statement texts through a reader and the evidence-based pipeline. Only statements of which nothing can be read have an
    error; what else fails is a warning in their status, and an account that can't be read is empty."""
    steps = Steps(frozenset({"account"}))
    account = steps.run("account", lambda: readers.read_records(texts, reader, "account", account_window(F.col("text")), ACCOUNT_FIELDS), lambda: _no_account(texts))
    rows, statuses = steps.run("transactions", lambda: readers.read_ranges(texts, reader, chunk_chars=chunk_chars))
    results = steps.run("pipeline", lambda: intelligence(_ledger(rows), classifications, readings, account))
    return results, statuses, steps
