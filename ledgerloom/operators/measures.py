"""Aggregate expressions and first-seen order, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def money(direction: str) -> Column:
    """Sum of one direction's amounts; 0 where there are none."""
    return F.coalesce(F.sum(F.when(F.col("direction") == direction, F.col("amount"))), F.lit(0).cast("decimal(25,2)"))


def totals() -> list[Column]:
    """Count, credits, debits, net. A row of unknown direction counts but adds to neither sum."""
    return [F.count("*").alias("transaction_count"), money("CREDIT").alias("total_credit"), money("DEBIT").alias("total_debit"), (money("CREDIT") - money("DEBIT")).alias("net_amount")]


def date_range() -> list[Column]:
    return [F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date")]


def mean_confidence() -> Column:
    """Mean to two decimals, halves up, in whole hundredths so that no sum of floats decides."""
    hundredths = F.sum(F.round(F.coalesce(F.col("confidence"), F.lit(0)) * 100).cast("bigint"))
    return F.call_function("div", 2 * hundredths + F.count("*"), 2 * F.count("*")).cast("double") / 100.0


def in_order(value: str, by: str = "seq") -> Column:
    """All values of a group as an array in the order of ``by``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def sorted_distinct(value: str) -> Column:
    return F.array_sort(F.collect_set(value))


def numbered(groups: DataFrame, prefix: str, width: int, partition: list[str], order: list[Column], name: str) -> DataFrame:
    """Sequence ids within each statement."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return groups.withColumn(name, F.format_string(f"{prefix}%0{width}d", place))


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Exact decimals as doubles, for output."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
