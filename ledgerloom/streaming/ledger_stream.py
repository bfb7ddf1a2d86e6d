"""Streams of transactions: daily totals and repeated references, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(stream: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Totals by statement and window; rows later than the watermark are left out and state is dropped behind it."""
    amount = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0).cast("decimal(25,2)"))
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "statement_id")
    totals = grouped.agg(F.count("*").alias("transaction_count"), amount("CREDIT").alias("total_credit"), amount("DEBIT").alias("total_debit"))
    return totals.select("statement_id", F.col("w.start").alias("window_start"), "transaction_count", "total_credit", "total_debit")


def first_of_reference(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each reference, amount and direction within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["statement_id", "reference_number", "amount", "direction"])
