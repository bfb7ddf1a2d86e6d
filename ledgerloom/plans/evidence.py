"""The evidence-based pipeline: validate, normalize, resolve, find duplicates, cluster, classify, review, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import aggregate, classify, cluster, duplicates, resolve, review, validate
from ledgerloom.operators.measures import totals
from ledgerloom.plans.results import Results
from ledgerloom.storage import Stored


def run(ledger: DataFrame, classifications: DataFrame, readings: DataFrame | None = None, account: DataFrame | None = None) -> Results:
    """All results of the pipeline by name.

    ``ledger``: statement_id, seq, transaction_id, txn_date, amount, direction, narration, reference_number, balance,
    opening_balance, extraction_confidence. Without ``readings`` the rules read the narrations.
    """
    checked = validate.checked_rows(ledger)
    breaks = (F.col("checked") & ~F.col("reconciled")).alias("balance_break")
    rows = checked.select(*[c for c in ledger.columns if c != "direction"], F.col("corrected_direction").alias("direction"), breaks)
    rows = classify.normalize(rows, readings if readings is not None else classify.rule_readings(rows), account)
    found = resolve.resolve_counterparties(rows)
    rows = rows.drop("counterparty", "counterparty_type", "confidence", "evidence").join(found, ["statement_id", "seq", "transaction_id"]).withColumn("counterparty", F.col("counterparty_id"))
    rows = Stored(rows.sparkSession).write(rows, "resolved")  # every result reads these rows; resolving is the costly step
    pairs = duplicates.duplicate_groups(rows.withColumn("reference_number", F.col("reference"))).withColumnRenamed("confidence", "duplicate_confidence")
    rows = rows.join(pairs, ["statement_id", "seq"], "left")
    rows = classify.classify(rows, classifications)
    flagged = lambda done: review.with_flags(rows.withColumnRenamed("requires_review", "match_review"), done["review_queue"])
    return Results({
        "validation": lambda _: validate.validate(ledger), "money_received": lambda _: aggregate.side_summary(rows, "CREDIT"), "money_paid": lambda _: aggregate.side_summary(rows, "DEBIT"),
        "clusters": lambda _: cluster.related_clusters(cluster.counterparty_clusters(rows)), "counterparties": lambda done: resolve.party_registry(rows, done["clusters"]), "group_totals": lambda _: aggregate.group_totals(rows),
        "category_breakdown": lambda _: aggregate.category_breakdown(rows), "review_queue": lambda _: review.queue(rows), "totals": lambda _: rows.groupBy("statement_id").agg(*totals()),
        "transactions": lambda done: transaction_tree(cluster.cluster_of_transaction(flagged(done), done["clusters"])), "unknown": lambda _: unknown_transactions(rows),
    })


def unknown_transactions(rows: DataFrame) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "transaction_id"))), lambda x: x["transaction_id"])
    return rows.filter(F.col("category") == "UNKNOWN").groupBy("statement_id").agg(ids.alias("unknown_transaction_ids"))


def transaction_tree(rows: DataFrame) -> DataFrame:
    """One nested row a transaction, from what was printed to its flags."""
    return rows.select(
        "statement_id", "transaction_id", F.struct("txn_date", "amount", "direction", "narration", "reference_number", "balance").alias("raw"),
        F.struct("payment_mode", "name", "alias", "upi_id", "bank_ifsc", "reference", "identifiers", "own_account").alias("normalized"),
        F.struct("counterparty_id", "counterparty_name", "counterparty_type", "match_type", "confidence", "evidence", "possible_match_of").alias("counterparty"), "cluster_id",
        F.struct("category", "category_confidence", "category_review").alias("classification"), F.struct("duplicate_group_id", "duplicate_confidence").alias("duplicate"), "review_flags",
    )


def result_rows(results: Results) -> DataFrame:
    """One nested row a statement, ready to append."""
    gather = lambda name, order, *columns: results[name].groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    out = results["validation"].join(results["totals"].select("statement_id", "total_credit", "total_debit", "net_amount"), "statement_id")
    for part in (
        gather("money_received", "rank", "counterparty_name", "total", "transaction_count"), gather("money_paid", "rank", "counterparty_name", "total", "transaction_count"),
        gather("clusters", "cluster_id", "counterparty", "cluster_type", "transaction_count"), gather("review_queue", "position", "transaction_id", "issue_type", "severity"), results["unknown"],
    ):
        out = out.join(part, "statement_id", "left")
    return out
