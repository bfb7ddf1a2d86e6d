"""Monthly repetition of a group's dates, by either of two rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _gaps(ledger: DataFrame, keys: list[str]) -> DataFrame:
    before = F.lag("txn_date").over(Window.partitionBy(*keys).orderBy("txn_date"))
    return ledger.withColumn("gap", F.datediff("txn_date", before))


def recurring_by_bands(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """At least three dated rows, and of the gaps (zeros included) half, two at least, of 20 to 40 days."""
    monthly, dated = F.count_if(F.col("gap").between(20, 40)), F.count("txn_date")
    enough = monthly >= F.greatest(F.lit(2), F.floor((dated - 1) / 2))
    return _gaps(ledger, keys).groupBy(*keys).agg(((dated >= 3) & enough).alias("recurring"))


def recurring_by_median(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """At least three distinct months, and a median positive gap of 24 to 36 days."""
    median = F.median(F.when(F.col("gap") > 0, F.col("gap")))
    months = F.count_distinct(F.date_format("txn_date", "yyyy-MM"))
    return _gaps(ledger, keys).groupBy(*keys).agg(((months >= 3) & F.coalesce(median.between(24, 36), F.lit(False))).alias("recurring"))
