"""Lookups, lists and soft deletion over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import ISO_DATE

PAGE_SIZE, MAX_PAGE_SIZE = 24, 100


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value).limit(1)


def latest_per_key(table: DataFrame, key: str, created: str, tie: str) -> DataFrame:
    """The newest row of each key; among equals the largest ``tie``."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(created, tie)).alias("r")).select(key, "r.*")


def page(table: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of an ordered list; pages have MAX_PAGE_SIZE rows at most. The list itself is never gathered."""
    size = max(1, min(size, MAX_PAGE_SIZE))
    return table.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def ordered(table: DataFrame, fields: list[str]) -> DataFrame:
    """Order by any columns, a leading minus for descending; unknown names are ignored."""
    known = [f for f in fields if f.lstrip("-") in table.columns]
    return table.orderBy(*[F.desc(f[1:]) if f.startswith("-") else F.asc(f) for f in known]) if known else table


def alive(table: DataFrame) -> DataFrame:
    return table.filter(~F.col("is_deleted"))


def dead(table: DataFrame) -> DataFrame:
    return table.filter(F.col("is_deleted"))


def active(table: DataFrame) -> DataFrame:
    return table.filter(F.col("is_active") & ~F.col("is_deleted"))


def inactive(table: DataFrame) -> DataFrame:
    return table.filter(~F.col("is_active") & ~F.col("is_deleted"))


def soft_deleted(table: DataFrame, where: Column, at: Column | None = None) -> DataFrame:
    """Mark rows as deleted and inactive instead of removing them."""
    hit = F.coalesce(where, F.lit(False))
    changed = {"is_deleted": F.col("is_deleted") | hit, "is_active": F.col("is_active") & ~hit}
    if at is not None:
        changed["deleted"] = F.when(hit, at).otherwise(F.col("deleted")) if "deleted" in table.columns else F.when(hit, at)
    return table.withColumns(changed)


def hard_deleted(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def only_row_per_key(table: DataFrame, key: str) -> DataFrame:
    """Keys with exactly one row; none and several are both no answer."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.count("*").alias("n"), F.any_value(F.struct(*rest)).alias("r")).filter("n = 1").select(key, "r.*")


def projected(table: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Dotted paths under new names; whatever is no number becomes text."""
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    out = table.select(*[F.col(path).alias(name) for name, path in fields.items()])
    return out.select(*[F.col(c) if kind in numeric or kind.startswith("decimal") else F.col(c).cast("string").alias(c) for c, kind in out.dtypes])


def dated(table: DataFrame, column: str = "date") -> DataFrame:
    """Rows whose date text is a full ISO date."""
    return table.filter(F.coalesce(F.col(column).rlike(ISO_DATE), F.lit(False)))


def blanks_as_null(table: DataFrame) -> DataFrame:
    """Empty text becomes null; false, zero and empty lists stay."""
    return table.select(*[F.nullif(c, F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in table.dtypes])


def with_window_number(table: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """Number, from 0, of each row's batch of ``size`` within its key."""
    return table.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))
