"""The manual pipeline: tabular statements or page text, normalized and grouped by narration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_narration
from ledgerloom.operators.measures import in_order, numbered


def normalized(transactions: DataFrame, direction: str | None = None) -> DataFrame:
    """Type and amount from deposit or withdrawal, and the normalized narration.

    Where the column ``direction`` says CREDIT or DEBIT it decides, since an amount of 0 or none doesn't tell.
    """
    credit = F.col("deposit") > 0
    if direction is not None:
        credit = F.when(F.col(direction).isin("CREDIT", "DEBIT"), F.col(direction) == "CREDIT").otherwise(credit)
    return transactions.withColumns({
        "normalized_narration": normalize_narration(F.col("narration")), "transaction_type": F.when(credit, "CREDIT").otherwise("DEBIT"),
        "amount": F.when(credit, F.col("deposit")).otherwise(F.col("withdrawal")),
    })


def clusters(transactions: DataFrame, order: str = "seq", member: str = "narration") -> DataFrame:
    """Groups of equal narration and type, numbered as first seen, with their members in order."""
    groups = transactions.groupBy("statement_id", "normalized_narration", "transaction_type").agg(
        F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"), in_order(member, order).alias("members"), F.min(order).alias("first_seq")
    )
    return numbered(groups, "", 1, ["statement_id"], [F.col("first_seq")], "cluster_no").withColumn("cluster_id", F.col("cluster_no").cast("int")).drop("cluster_no")


def summary(transactions: DataFrame, clustered: DataFrame, pages: DataFrame, page: str = "page_no") -> DataFrame:
    """Pages of each statement's file, with rows or not, its transactions and its clusters."""
    counted = pages.groupBy("statement_id").agg(F.count_distinct(page).alias("page_count"))
    for part, name in ((transactions, "transaction_count"), (clustered, "cluster_count")):
        counted = counted.join(part.groupBy("statement_id").agg(F.count("*").alias(name)), "statement_id", "left")
    return counted.fillna(0, ["transaction_count", "cluster_count"])


def run(account: DataFrame, transactions: DataFrame, order: str = "row_no", pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """Parsed rows to account, transactions, clusters and summary. Without ``pages`` (statement_id, page_no) a file has the
    one page that a table has."""
    rows = normalized(transactions)
    grouped = clusters(rows, order)
    return {"account": account, "transactions": rows, "clusters": grouped, "summary": summary(rows, grouped, account.select("statement_id", F.lit(1).alias("page_no")) if pages is None else pages)}
