"""Statement files: CSV, XLSX, page text and PDF text layers; and where results go."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import MAX_UPLOAD_BYTES
from ledgerloom.sources.pdf import pdf_pages

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_MIME = {"pdf": "application/pdf", "csv": "text/csv", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "txt": "text/plain"}


def uploads(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES, glob: str | None = None) -> DataFrame:
    """path, length and content of files that are not too large. ``upload_statuses`` names the others."""
    return _files(spark, path, glob).filter(F.col("length") <= max_bytes)


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def upload_statuses(spark: SparkSession, path: str, expected: list[str] | None = None, max_bytes: int = MAX_UPLOAD_BYTES, glob: str | None = None) -> DataFrame:
    """name, length and status of each file, and of the expected names that are missing: accepted, or why not. Contents are
    not read."""
    files = _files(spark, path, glob).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")
    if expected is not None:
        files = spark.createDataFrame([(n,) for n in expected], "name string").join(files, "name", "full")
    large = F.format_string("REJECTED: larger than %d bytes", F.lit(max_bytes))
    return files.withColumn("status", F.when(F.col("length").isNull(), "REJECTED: no such file").when(F.col("length") > max_bytes, large).otherwise("ACCEPTED"))


def file_meta(files: DataFrame) -> DataFrame:
    """Name, size, extension and media type. Contents are not read."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _MIME.items() for x in kv]), extension), F.lit("application/octet-stream"))
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), extension.alias("extension"), mime.alias("mime"))


def read_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Text cells of CSV files with a header row (UTF-8, byte order mark or not), with statement_id (the file) and row_no.

    ``header`` names the columns that are wanted; nothing is inferred. Order within a file is kept by splitting none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = csv.DictReader(content.decode("utf-8-sig").splitlines())
                yield pd.DataFrame([(path, i, *[(r.get(h) or "") for h in header]) for i, r in enumerate(rows)], columns=["statement_id", "row_no", *header])

    return uploads(spark, path).select("path", "content").mapInPandas(run, _text_schema(header))


def read_xlsx(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Like ``read_csv`` for the first sheet of XLSX files; dates become dd-mm-yyyy."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = sheet_rows(content)
                names = [c.strip() for c in rows[0]] if rows else []
                cells = [dict(zip(names, r)) for r in rows[1:]]
                yield pd.DataFrame([(path, i, *[r.get(h, "") for h in header]) for i, r in enumerate(cells)], columns=["statement_id", "row_no", *header])

    return uploads(spark, path).select("path", "content").mapInPandas(run, _text_schema(header))


def _text_schema(header: list[str]) -> T.StructType:
    fields = [T.StructField("statement_id", T.StringType()), T.StructField("row_no", T.IntegerType())]
    return T.StructType(fields + [T.StructField(h, T.StringType()) for h in header])


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet as text, from its XML parts alone."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates = _date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        sheet = _active_sheet(book, names)
        out = []
        for row in ElementTree.fromstring(book.read(sheet)).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else i
                cells[at] = _cell_text(cell, shared, dates)
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def _active_sheet(book: zipfile.ZipFile, names: set[str]) -> str:
    """The part of the sheet that was open when the workbook was saved; the lowest-numbered one where that isn't told."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        view, sheets = next(root.iter(f"{_MAIN}workbookView"), None), list(root.iter(f"{_MAIN}sheet"))
        at = int(view.get("activeTab", 0)) if view is not None else 0
        wanted = sheets[at].get(f"{_LINKS}id") if at < len(sheets) else None
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = link.get("Target", "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if link.get("Id") == wanted and target in names:
                return target
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))


def _date_styles(styles: bytes) -> set[int]:
    root = ElementTree.fromstring(styles)
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    formats = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(ids) if 14 <= n <= 22 or re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(n, "")), re.I)}


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")).strip()
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)].strip()
    if kind in (None, "n") and int(cell.get("s") or 0) in dates:
        return (datetime(1899, 12, 30) + timedelta(days=float(value.text))).strftime("%d-%m-%Y")
    return value.text.strip()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """statement_id, page_no, text, error of files: text layers of PDF files, else text files whose pages form feeds part.

    A file that can't be read is one row without a page, with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = [(path, i, t, None) for i, t in enumerate(page_texts(path, content), 1)]
                except (ValueError, zlib.error) as error:
                    rows = [(path, None, None, str(error))]
                yield pd.DataFrame(rows, columns=["statement_id", "page_no", "text", "error"]).astype({"page_no": "Int32"})

    return uploads(spark, path).select("path", "content").mapInPandas(run, "statement_id string, page_no int, text string, error string")


def page_texts(path: str, content: bytes) -> list[str]:
    return pdf_pages(content) if path.lower().endswith(".pdf") else content.decode("utf-8-sig").split("\f")


def statement_text(pages: DataFrame) -> DataFrame:
    """Pages joined in order; statements without any text are left out."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.trim(x["text"])), "\n")
    return pages.groupBy("statement_id").agg(joined.alias("text")).filter(F.trim("text") != "")


#: Readers of tabular files by extension.
TABULAR: dict[str, Callable[[SparkSession, str, list[str]], DataFrame]] = {"csv": read_csv, "xlsx": read_xlsx}


def reader_for(path: str) -> Callable:
    extension = path.rsplit(".", 1)[-1].lower()
    if extension in TABULAR:
        return TABULAR[extension]
    if extension in ("pdf", "txt"):
        return read_pages
    raise ValueError(f"no reader for .{extension} files")


def append_result(result: DataFrame, path: str, partition_by: str | None = None, dates: Sequence[str] = (), money: Sequence[str] = ()) -> None:
    """Append one row a run; earlier runs stay. ISO text in ``dates`` becomes dates, numbers in ``money`` decimals by way of
    their shortest text. The commit protocol makes the write all or nothing."""
    typed = {c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd") for c in dates} | {c: F.col(c).cast("string").try_cast("decimal(15,2)") for c in money}
    writer = (result.withColumns(typed) if typed else result).write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def json_ready(result: DataFrame) -> DataFrame:
    """Decimals as text, at any depth, so that JSON keeps them exact."""
    return result.select(*[_without_decimals(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in result.schema])


def _without_decimals(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _without_decimals(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _without_decimals(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_without_decimals(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return c
