"""From statement text to lines, account fields, records and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import AMOUNT, DATE_LINE, MANUAL_DATE, clean_amount

# Labels of the account block in text, headers of the tabular form.
ACCOUNT_LABELS = {
    "business_name": "Business Name", "account_reference": "Account Reference", "business_type": "Business Type",
    "statement_period": "Statement Period", "opening_balance": "Opening Balance", "closing_balance": "Closing Balance",
}
ACCOUNT_HEADERS = {
    "Business Name": "business_name", "Account Reference": "account_reference", "Business Type": "business_type",
    "Statement Period": "statement_period", "Opening Balance": "opening_balance", "Statement Closing Balance": "closing_balance",
}
TRANSACTION_HEADERS = {
    "Date": "date", "Narration": "narration", "Chq./Ref. No.": "reference", "Value Date": "value_date",
    "Withdrawal (Dr)": "withdrawal", "Deposit (Cr)": "deposit", "Closing Balance": "closing_balance",
}
RECORD_LINES = ("date", "narration", "reference", "value_date", "withdrawal", "deposit", "closing_balance")


def text_lines(texts: DataFrame, key: str = "statement_id", text: str = "text") -> DataFrame:
    """One row a line: key, line_no (from 0), line."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def inspect(texts: DataFrame, key: str = "statement_id", text: str = "text") -> DataFrame:
    lines = F.split(text, "\n")
    preview = F.array_join(F.transform(F.slice(lines, 1, 8), lambda x: F.substring(x, 1, 150)), "\n")
    return texts.select(key, F.length(text).alias("n_chars"), F.size(lines).alias("n_lines"), preview.alias("preview"))


def first_transaction_line(lines: DataFrame, key: str = "statement_id") -> DataFrame:
    """The first line that begins with a date and, with the next eleven, has two lines with an amount."""
    ahead = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, 11)
    dense = F.sum(F.col("line").rlike(AMOUNT).cast("int")).over(ahead) >= 2
    return lines.withColumn("starts", F.col("line").rlike(DATE_LINE) & dense).filter("starts").groupBy(key).agg(F.min("line_no").alias("first_line"))


def context_lines(lines: DataFrame, key: str = "statement_id", before: int = 3, after: int = 8) -> DataFrame:
    """Each line with its neighbours, joined."""
    frame = Window.partitionBy(key).orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(frame), "\n"))


def chunks_of_lines(lines: list[str], max_chars: int, date_line: re.Pattern) -> list[str]:
    """Close a chunk before a line that would overfill it, if the line has a date or the chunk is half as long again."""
    chunks, held, size = [], [], 0
    for line in lines:
        full = held and size + len(line) > max_chars
        if full and (size > 1.5 * max_chars or date_line.match(line)):
            chunks.append("\n".join(held))
            held, size = [], 0
        held.append(line)
        size += len(line) + 1
    return chunks + (["\n".join(held)] if held else [])


def line_chunks(texts: DataFrame, key: str = "statement_id", text: str = "text", max_chars: int = 3500) -> DataFrame:
    """key, chunk_no, chunk. A row is one statement, so no chunk crosses statements."""
    pattern = re.compile(DATE_LINE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, c) for k, t in zip(frame["k"], frame["t"]) for i, c in enumerate(chunks_of_lines((t or "").splitlines(), max_chars, pattern))]
            yield pd.DataFrame(rows, columns=["k", "chunk_no", "chunk"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk_no int, chunk string").withColumnRenamed("k", key)


def line_ranges(texts: DataFrame, key: str = "statement_id", text: str = "text", chunk_chars: int = 3500) -> DataFrame:
    """key, start, stop: ranges of stripped, non-blank lines that close once their characters, eight more a line, fill up.

    A fold over the statement's array of lines inside the JVM.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sizes = F.transform(lines, lambda x: F.length(x) + 8)
    empty = F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("done"), F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).alias("size"))

    def step(s: Column, n: Column) -> Column:
        at, size = s["at"] + 1, s["size"] + n
        closed = F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), at.alias("stop"))))
        full = size >= chunk_chars
        return F.struct(F.when(full, closed).otherwise(s["done"]).alias("done"), F.when(full, at).otherwise(s["start"]).alias("start"), at.alias("at"), F.when(full, 0).otherwise(size).alias("size"))

    rest = lambda s: F.when(s["start"] < s["at"], F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["at"].alias("stop"))))).otherwise(s["done"])
    return texts.select(key, F.explode(F.aggregate(sizes, empty, step, rest)).alias("r")).select(key, "r.start", "r.stop")


def account_from_text(texts: DataFrame, key: str = "statement_id", text: str = "text") -> DataFrame:
    """The value on the line after each label; null where the label is missing."""
    fields = [F.nullif(F.trim(F.regexp_extract(text, rf"(?i){label}\s*\n\s*(.+)", 1)), F.lit("")).alias(name) for name, label in ACCOUNT_LABELS.items()]
    return texts.select(key, *fields)


def records_of_lines(lines: list[str]) -> list[list[str]]:
    """Records of seven lines that begin with a date and have one on the fourth; lines of a record begin no other."""
    date, out, at = re.compile(MANUAL_DATE), [], 0
    while at + len(RECORD_LINES) <= len(lines):
        record = lines[at : at + len(RECORD_LINES)]
        if date.match(record[0]) and date.match(record[3]):
            out.append(record)
            at += len(RECORD_LINES)
        else:
            at += 1
    return out


def transactions_from_pages(pages: DataFrame, key: str = "statement_id") -> DataFrame:
    """Pages (key, page_no, text) to transactions; no record crosses pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, page, text in zip(frame["k"], frame["page_no"], frame["t"]):
                lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
                rows += [(k, page, i, *r) for i, r in enumerate(records_of_lines(lines))]
            yield pd.DataFrame(rows, columns=["k", "page_no", "row_no", *RECORD_LINES])

    kind = pages.schema[key].dataType.simpleString()
    schema = f"k {kind}, page_no int, row_no int, " + ", ".join(f"{c} string" for c in RECORD_LINES)
    raw = pages.select(F.col(key).alias("k"), F.col("page_no").cast("int").alias("page_no"), F.col("text").alias("t")).mapInPandas(run, schema)
    return _with_money(raw.withColumnRenamed("k", key).withColumn("page", F.format_string("page_%d", "page_no")))


def _with_money(rows: DataFrame) -> DataFrame:
    """Amounts from text; ``parse_error`` names the first one that is malformed (its value is null)."""
    names = ("withdrawal", "deposit", "closing_balance")
    parsed = rows.withColumns({f"{c}_": clean_amount(F.col(c)) for c in names})
    error = F.coalesce(*[F.when(F.col(f"{c}_").isNull(), F.lit(c)) for c in names])
    return parsed.withColumn("parse_error", error).drop(*names).withColumnsRenamed({f"{c}_": c for c in names})


def tabular_statement(rows: DataFrame, key: str = "statement_id", order: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """Text rows with printed headers to (account, transactions).

    Blank rows go; the account is in the first row left; a transaction has a dd-mm-yyyy date or value date. Missing
    columns are empty, unknown ones ignored.
    """
    known = [c for c in rows.columns if c not in (key, order)]
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) if c in known else F.lit("")
    filled = rows.filter(F.concat(F.lit(""), *[text(c) for c in known]) != "")
    fields = F.struct(*[text(h).alias(n) for h, n in ACCOUNT_HEADERS.items()])
    account = filled.groupBy(key).agg(F.min_by(fields, order).alias("a")).select(key, "a.*")
    shaped = filled.select(key, order, *[text(h).alias(n) for h, n in TRANSACTION_HEADERS.items()], F.lit("page_1").alias("page"))
    dated = shaped.filter(F.col("date").rlike(MANUAL_DATE) | F.col("value_date").rlike(MANUAL_DATE))
    return account, _with_money(dated)


def sequenced(rows: DataFrame, prefix: str, width: int, order: list[str], key: str = "statement_id") -> DataFrame:
    """seq and transaction_id in the order of chunks and rows."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("seq", place).withColumn("transaction_id", F.format_string(f"{prefix}%0{width}d", F.col("seq")))


def batch_number(size: int) -> Column:
    """Number, from 0, of a row's batch of ``size``."""
    return F.floor((F.col("seq") - 1) / size)


def owned_rows(rows: DataFrame) -> DataFrame:
    """Rows without a source line, or whose line is within their chunk's own range."""
    return rows.filter("source_line is null or (source_line >= start and source_line < stop)")


def account_window(text: Column, head: int = 6000, tail: int = 1500) -> Column:
    """What a reader of account details sees: the beginning and the end of the text."""
    return F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))
