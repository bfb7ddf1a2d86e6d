"""Summaries of ledgers by counterparty, category, payment mode and month, per statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import month
from ledgerloom.operators.measures import date_range, in_order, mean_confidence, money, sorted_distinct, totals


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("UNKNOWN"))


def statement_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("statement_id").agg(*totals(), *date_range())


def side_summary(ledger: DataFrame, direction: str) -> DataFrame:
    """Who paid (CREDIT) or was paid (DEBIT). Rows without a counterparty share one row named UNRESOLVED.

    Ranked by total within the statement, first seen first among equals.
    """
    groups = ledger.filter(F.col("direction") == direction).groupBy("statement_id", "counterparty").agg(
        F.count("*").alias("transaction_count"), F.sum("amount").alias("total"), *date_range(), sorted_distinct("payment_mode").alias("payment_modes"),
        in_order("transaction_id").alias("transaction_ids"), mean_confidence().alias("confidence"), F.min("seq").alias("first_seq"),
    )
    rank = F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc("total"), "first_seq"))
    return groups.withColumn("rank", rank).withColumn("counterparty_name", F.coalesce("counterparty", F.lit("UNRESOLVED")))


def counterparty_summary(ledger: DataFrame) -> DataFrame:
    """Received, paid and net of each counterparty, UNKNOWN among them; is_payer and is_payee may both hold."""
    groups = ledger.groupBy("statement_id", or_unknown(F.col("counterparty")).alias("counterparty")).agg(
        F.count("*").alias("transaction_count"), money("CREDIT").alias("total_received"), money("DEBIT").alias("total_paid"), (money("CREDIT") - money("DEBIT")).alias("net_amount"),
        *date_range(), sorted_distinct("payment_mode").alias("payment_modes"), mean_confidence().alias("confidence"), F.min("seq").alias("first_seq"),
    )
    rank = F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc(F.col("total_received") + F.col("total_paid")), "first_seq"))
    return groups.withColumn("rank", rank).withColumn("is_payer", F.col("total_received") > 0).withColumn("is_payee", F.col("total_paid") > 0)


def keyed_summary(ledger: DataFrame, key: Column) -> DataFrame:
    """Count, credits, debits of each key. Whatever is no credit is a debit here."""
    other = F.coalesce(F.sum(F.when(F.col("direction") != "CREDIT", F.col("amount"))), F.lit(0).cast("decimal(25,2)"))
    return ledger.groupBy("statement_id", key.alias("key")).agg(F.count("*").alias("transaction_count"), money("CREDIT").alias("credits"), other.alias("debits"), (money("CREDIT") - other).alias("net"))


def category_summary(ledger: DataFrame) -> DataFrame:
    return keyed_summary(ledger, or_unknown(F.col("category")))


def payment_mode_summary(ledger: DataFrame) -> DataFrame:
    return keyed_summary(ledger, or_unknown(F.col("payment_mode")))


def month_summary(ledger: DataFrame) -> DataFrame:
    return keyed_summary(ledger, month(F.col("txn_date")))


def group_totals(ledger: DataFrame) -> DataFrame:
    """Totals by category, payment mode and month in one pass: (statement_id, dimension, key, ...)."""
    keyed = ledger.withColumns({"category_key": or_unknown(F.col("category")), "mode_key": or_unknown(F.col("payment_mode")), "month_key": month(F.col("txn_date"))})
    sets = [[F.col("statement_id"), F.col(k)] for k in ("category_key", "mode_key", "month_key")]
    grouped = keyed.groupingSets(sets, "statement_id", "category_key", "mode_key", "month_key").agg(*totals(), F.grouping_id("statement_id", "category_key", "mode_key", "month_key").alias("gid"))
    dimension = F.when(F.col("gid") == 3, "category").when(F.col("gid") == 5, "payment_mode").otherwise("month")
    return grouped.select("statement_id", dimension.alias("dimension"), F.coalesce("category_key", "mode_key", "month_key").alias("key"), "transaction_count", "total_credit", "total_debit", "net_amount")


def category_breakdown(ledger: DataFrame) -> DataFrame:
    """Received and paid by category, side by side; null where a side has none."""
    pivoted = ledger.groupBy("statement_id", or_unknown(F.col("category")).alias("category")).pivot("direction", ["CREDIT", "DEBIT"]).agg(F.sum("amount"))
    return pivoted.withColumnsRenamed({"CREDIT": "received", "DEBIT": "paid"})


def relationship_histogram(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("statement_id", "relationship").agg(F.count("*").alias("n"))


def frequent_names(ledger: DataFrame) -> DataFrame:
    """Distinct counterparties, most frequent first, then first seen."""
    counts = ledger.filter("counterparty is not null").groupBy("statement_id", "counterparty").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc("n"), "first_seq")))


def top_counterparties(ledger: DataFrame, k: int = 40) -> DataFrame:
    """The ``k`` most frequent counterparties of each statement, ties by name."""
    counts = ledger.filter("counterparty is not null").groupBy("statement_id", "counterparty").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc("n"), "counterparty"))).filter(F.col("rank") <= k)


def frequent_categories(ledger: DataFrame, least: int = 3, k: int = 100) -> DataFrame:
    """Categories but UNKNOWN by frequency, ``k`` at most, of statements that have ``least`` of them."""
    counts = ledger.filter(or_unknown(F.col("category")) != "UNKNOWN").groupBy("statement_id", "category").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    statement = Window.partitionBy("statement_id")
    ranked = counts.withColumns({"labels": F.count("*").over(statement), "rank": F.row_number().over(statement.orderBy(F.desc("n"), "first_seq"))})
    return ranked.filter((F.col("labels") >= least) & (F.col("rank") <= k)).drop("labels", "first_seq")


def upper_median(ledger: DataFrame) -> DataFrame:
    """The element at floor(n / 2), from 0, of each statement's sorted amounts."""
    sizes = F.count("amount").over(Window.partitionBy("statement_id"))
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("amount"))
    known = ledger.filter("amount is not null").select("statement_id", "amount").withColumns({"n": sizes, "place": place})
    return known.filter(F.col("place") == F.floor(F.col("n") / 2) + 1).select("statement_id", F.col("amount").alias("median_amount"))


def top_relationship(ledger: DataFrame, by: str = "counterparty") -> DataFrame:
    """The most frequent relationship of each counterparty, first seen among equals."""
    counts = ledger.groupBy("statement_id", by, "relationship").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return counts.groupBy("statement_id", by).agg(F.max_by("relationship", F.struct("n", -F.col("first_seq"))).alias("top_relationship"))


def extraction_quality(ledger: DataFrame) -> DataFrame:
    """Mean confidence and counts of what is weak, per statement."""
    return ledger.groupBy("statement_id").agg(
        mean_confidence().alias("mean_confidence"), F.count_if(F.coalesce(F.col("confidence"), F.lit(0)) < 0.60).alias("low_confidence"),
        F.count_if(F.col("counterparty").isNull()).alias("unknown_counterparties"), F.count_if(or_unknown(F.col("category")) == "UNKNOWN").alias("unknown_categories"),
    )


def first_and_last_known(pages: DataFrame, key: str, order: str, first: list[str], last: list[str]) -> DataFrame:
    """Merge pages: of some columns the first value that is not null, of others the last."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"last_{c}" if c in first else c) for c in last]
    return pages.groupBy(key).agg(*firsts, *lasts)
