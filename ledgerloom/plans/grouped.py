"""The grouped pipeline: classify by side table and rules, cluster by chosen fields, summarise, review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import income_or_expense
from ledgerloom.operators import aggregate, classify, cluster, duplicates, resolve, review, validate
from ledgerloom.operators.measures import money
from ledgerloom.plans.results import Results
from ledgerloom.storage import Stored


def run(ledger: DataFrame, classifications: DataFrame, merges: DataFrame | None = None, group_by: str | Sequence[str] | None = None) -> Results:
    """All results of the pipeline by name.

    ``ledger``: statement_id, seq, transaction_id, txn_date, amount, direction, narration, reference_number, balance.
    Sums in ``validation`` are as printed; those in ``totals`` follow the corrected directions.
    """
    checked = validate.adjacent_checks(ledger)
    rows = checked.withColumn("direction", F.col("corrected_direction")).select(*ledger.columns)
    rows = classify.classify_grouped(rows, classifications)
    if merges is not None:
        rows = classify.merge_categories(rows, merges)
    rows = classify.repair_relationships(resolve.with_canonical_names(rows))
    rows = Stored(rows.sparkSession).write(rows, "classified")  # every result reads these rows
    net = [money("CREDIT").alias("credit_total"), money("DEBIT").alias("debit_total"), (money("CREDIT") - money("DEBIT")).alias("net")]
    return Results({
        "rows": lambda _: rows, "validation": lambda _: validate.validate_adjacent(ledger), "clusters": lambda _: cluster.cluster_by_fields(rows, group_by), "counterparties": lambda _: aggregate.counterparty_summary(rows),
        "categories": lambda _: aggregate.category_summary(rows), "payment_modes": lambda _: aggregate.payment_mode_summary(rows), "months": lambda _: aggregate.month_summary(rows),
        "totals": lambda _: rows.groupBy("statement_id").agg(*net), "quality": lambda _: aggregate.extraction_quality(rows),
        "review_queue": lambda done: review.queue_grouped(rows, done["validation"], duplicates.exact_duplicate_rows(rows)),
        "transactions": lambda done: transaction_tree(review.with_flags(rows, done["review_queue"]), done["clusters"]),
        "summary": lambda done: text_summary(rows, done["validation"], done["review_queue"]),
    })


# Fixed value: the warning of a failed validation.
MATERIAL_FAILURE = "Transaction extraction validation failed materially. Review extraction before relying on accounting conclusions."


def result_rows(results: Results, account: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """One nested row a statement: account with its period filled in, totals, groups, queue, quality and warnings.

    ``account``: statement_id, account_number, statement_period, statement_period_start and statement_period_end, and more;
    ``statuses``: statement_id, status of the extraction. The period is that of the dated rows where none is printed.
    """
    rows = results["rows"]
    dated = rows.filter("txn_date is not null").groupBy("statement_id").agg(F.min("txn_date").cast("string").alias("first_day"), F.max("txn_date").cast("string").alias("last_day"))
    out = results["validation"].select("statement_id", F.struct("validation_status", "pairs", "fitting", "duplicate_rows", "missing_data", "directions_corrected").alias("validation"), "validation_status")
    out = out.join(results["totals"], "statement_id").join(dated, "statement_id", "left").join(results["quality"].select("statement_id", F.struct("*").alias("data_quality")), "statement_id", "left")
    if account is None:
        account = rows.select("statement_id", *[F.lit(None).cast("string").alias(c) for c in ("statement_period", "statement_period_start", "statement_period_end")]).distinct()
    out = with_period(out.join(account, "statement_id", "left"))
    gather = lambda name, *columns: results[name].groupBy("statement_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    for part in (
        gather("clusters", "rank", "cluster_id", "transaction_count", "total_amount"), gather("counterparties", "rank", "counterparty", "total_received", "total_paid"),
        gather("review_queue", "transaction_id", "issue_type", "severity"), results["summary"],
    ):
        out = out.join(part, "statement_id", "left")
    notes = [F.when(F.col("validation_status") == "FAIL", MATERIAL_FAILURE)]
    if statuses is not None:
        out = out.join(statuses.select("statement_id", F.col("status").alias("extraction_status")), "statement_id", "left")
        notes.append(F.when(F.col("extraction_status") != "OK", F.col("extraction_status")))
    return out.withColumn("warnings", F.filter(F.array(*notes), lambda x: x.isNotNull())).drop("validation_status", "first_day", "last_day", "extraction_status")


def with_period(rows: DataFrame) -> DataFrame:
    """The printed period, else the first and last day."""
    both = F.when(F.col("first_day").isNotNull(), F.concat_ws(" to ", "first_day", "last_day"))
    return rows.withColumns({
        "statement_period": F.coalesce(F.nullif("statement_period", F.lit("")), both),
        "statement_period_start": F.coalesce("statement_period_start", "first_day"), "statement_period_end": F.coalesce("statement_period_end", "last_day"),
    })


def transaction_tree(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """One nested row a transaction: as printed, party, cluster, classification and flags."""
    linked = cluster.cluster_of_transaction(rows, clusters)
    return linked.select(
        "statement_id", "transaction_id", F.struct("txn_date", "amount", "direction", "narration", "reference_number").alias("raw"), F.struct("counterparty", "payment_mode").alias("party"), "cluster_id",
        F.struct("category", "relationship", "confidence", income_or_expense(F.col("category"), F.col("direction")).alias("interpretation")).alias("classification"),
        F.struct("requires_review", "possible_duplicate", "review_flags").alias("flags"),
    )


# The wording of the five lines.
def text_summary(rows: DataFrame, validation: DataFrame, queue: DataFrame) -> DataFrame:
    """Five lines on each statement. Sums are those before correction."""
    groups = aggregate.counterparty_summary(rows).groupBy("statement_id").agg(F.count_if("is_payer").alias("payers"), F.count_if("is_payee").alias("payees"))
    unknown = rows.groupBy("statement_id").agg(F.count_if(F.coalesce("counterparty", F.lit("")) == "").alias("no_party"), F.count_if(F.col("category") == "UNKNOWN").alias("no_category"))
    items = queue.groupBy("statement_id").agg(F.count("*").alias("items"))
    all_ = validation.join(groups, "statement_id").join(unknown, "statement_id").join(items, "statement_id", "left")
    amount = lambda c: F.format_number(c, 2)
    return all_.select("statement_id", F.concat_ws(
        "\n", F.format_string("Processed %d transactions for the account.", "transaction_count"),
        F.concat(F.lit("Credits="), amount("credit_total"), F.lit("; Debits="), amount("debit_total"), F.lit("; Net movement="), amount(F.col("credit_total") - F.col("debit_total")), F.lit(".")),
        F.format_string("Identified %d incoming counterparty groups and %d outgoing counterparty groups.", "payers", "payees"),
        F.format_string("%d transactions have no reliable counterparty and %d remain unclassified.", "no_party", "no_category"),
        F.format_string("CA review queue contains %d items; validation status=%s.", F.coalesce("items", F.lit(0)), F.col("validation_status")),
    ).alias("summary"))
