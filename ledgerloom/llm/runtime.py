"""Shared storage for intermediate tables, and small helpers for Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.storage import Stored, shared_dir  # noqa: F401

#: The white space of the contracts: space and \t \n \v \f \r, in Java and Python regex syntax.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``docs`` as the struct ``row`` beside the keys, so that no name clashes; ``unpacked`` undoes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[k.alias(name) for name, k in keys.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select("row.*").select(*[f"`{c}`" for c in docs.columns])


def document_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string with null read as empty, and nothing else (clashing names can't matter)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def int64_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A long column as numpy; nulls become the smallest long."""
    column = batch.column(name)
    if column.null_count:
        column = column.fill_null(np.iinfo(np.int64).min)
    return column.to_numpy(zero_copy_only=False)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of ``size`` rows at most."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
