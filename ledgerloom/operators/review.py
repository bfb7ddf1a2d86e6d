"""Review queues: rules over rows as arrays of items, ordered, without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import possible_internal_transfer, reference_v1
from ledgerloom.operators.aggregate import upper_median
from ledgerloom.schema import PERSONAL_MIN_CONFIDENCE, REVIEW_LOW_CONFIDENCE, UNUSUAL_FACTOR

ITEM = ["statement_id", "transaction_id", "seq", "rule_no", "issue_type", "reason", "severity"]


def _item(holds: Column, issue: str | Column, reason: str | Column, severity: str | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(holds, F.struct(as_column(issue).alias("issue_type"), as_column(reason).alias("reason"), as_column(severity).alias("severity")))


def _exploded(rows: DataFrame, rules: list[Column], first_rule: int = 0) -> DataFrame:
    items = F.filter(F.array(*[F.struct(F.lit(first_rule + i).alias("rule_no"), r.alias("item")) for i, r in enumerate(rules)]), lambda x: x["item"].isNotNull())
    return rows.select("statement_id", "transaction_id", "seq", F.explode(items).alias("i")).select("statement_id", "transaction_id", "seq", "i.rule_no", "i.item.*")


# Issue types, severities and the wording of reasons in all rules below.
def anomalies(ledger: DataFrame) -> DataFrame:
    """Six rules on classified rows: low confidence, unknown party or purpose, unusual amount, own transfer, personal."""
    rows = ledger.join(upper_median(ledger), "statement_id", "left")
    amount, median = F.col("amount"), F.col("median_amount")
    narration = F.col("narration") if "narration" in ledger.columns else F.lit(None).cast("string")
    unusual = F.concat(F.lit("Transaction amount "), F.format_number("amount", 2), F.lit(f" is at least {UNUSUAL_FACTOR}x the statement transaction median "), F.format_number("median_amount", 2), F.lit("."))
    return _exploded(rows, [
        _item(F.coalesce(F.col("confidence"), F.lit(0)) < REVIEW_LOW_CONFIDENCE, "low_confidence", F.concat(F.lit("Classification confidence is "), F.format_number("confidence", 2), F.lit(".")), "MEDIUM"),
        _item(F.coalesce("counterparty", F.lit("")) == "", "counterparty_unknown", "No reliable payer/payee was identified.", "MEDIUM"),
        _item(F.col("category") == "UNKNOWN", "classification_unknown", "Accounting purpose could not be determined reliably.", "MEDIUM"),
        _item((median > 0) & (amount >= median * UNUSUAL_FACTOR), "unusual_amount", unusual, "MEDIUM"),
        _item(possible_internal_transfer(narration, F.col("category")), "possible_internal_transfer", "Narration/category suggests a transfer between own accounts.", "LOW"),
        _item((F.col("category") == "PERSONAL_EXPENSE") & (F.col("direction") == "DEBIT"), "possible_personal_expense", "The transaction was classified as a possible personal expense.", "MEDIUM"),
    ])


def duplicate_items(duplicates: DataFrame) -> DataFrame:
    reason = "Another transaction has the same date, amount, direction, counterparty/narration and reference."
    return duplicates.select("statement_id", "transaction_id", "seq", F.lit(-1).alias("rule_no"), F.lit("possible_duplicate").alias("issue_type"), F.lit(reason).alias("reason"), F.lit("MEDIUM").alias("severity"))


def queue_grouped(ledger: DataFrame, validation: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The grouped pipeline's queue: duplicates, anomalies, the statement's balance, references, refunds; each item once."""
    share = F.col("balance_consistency")
    balance = validation.filter(share < 90).select(
        "statement_id", F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("int").alias("seq"), F.lit(50).alias("rule_no"), F.lit("balance_mismatch").alias("issue_type"),
        F.concat(F.lit("Running balance consistency is "), F.format_number(share, 1), F.lit("%.")).alias("reason"), F.when(share < 70, "HIGH").otherwise("MEDIUM").alias("severity"),
    )
    no_reference = (F.coalesce("reference_number", F.lit("")) == "") & reference_v1(F.col("narration")).isNull()
    kind = F.col("relationship")
    late = _exploded(ledger, [
        _item(no_reference, "missing_reference", "No transaction reference/UTR was extracted.", "LOW"),
        _item(kind.isin("REFUND", "REVERSAL"), F.when(kind == "REFUND", "possible_refund").otherwise("possible_reversal"), F.concat(F.lit("Transaction relationship is "), kind, F.lit(".")), "MEDIUM"),
    ], 60)
    return without_repeats(duplicate_items(duplicates).unionByName(anomalies(ledger)).unionByName(balance).unionByName(late))


def without_repeats(items: DataFrame) -> DataFrame:
    """The first of items alike in statement, transaction, type and reason."""
    same = Window.partitionBy("statement_id", "transaction_id", "issue_type", "reason").orderBy("rule_no", "seq")
    return items.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").drop("_nth")


def queue(ledger: DataFrame) -> DataFrame:
    """The evidence-based pipeline's queue with ``position`` in its statement: by severity, then as raised.

    Columns used: balance_break, extraction_confidence, counterparty, match_type, possible_match_of, category,
    category_review, category_confidence, own_account, evidence, duplicate_group_id, duplicate_confidence.
    """
    unknown = F.col("counterparty").isNull()
    unsure = F.col("category_review") | (F.col("category") == "UNKNOWN")
    noted = F.nullif(F.array_join(F.slice("evidence", 1, 2), "; "), F.lit(""))
    level = F.col("duplicate_confidence")
    items = _exploded(ledger, [
        _item(F.col("balance_break"), "BALANCE_MISMATCH", "Running balance does not reconcile with this row", "HIGH"),
        _item(F.col("extraction_confidence") < REVIEW_LOW_CONFIDENCE, "POOR_EXTRACTION", "Low extraction confidence", "MEDIUM"),
        _item(unknown, "UNKNOWN_COUNTERPARTY", "Counterparty could not be established from the narration", "MEDIUM"),
        _item(~unknown & (F.col("match_type") == "POSSIBLE"), "POSSIBLE_ENTITY_MATCH", F.concat(F.lit("Possibly the same party as "), "possible_match_of", F.lit("; not merged")), "MEDIUM"),
        _item(unsure, "UNCERTAIN_CLASSIFICATION", F.concat(F.lit("Purpose not established ("), "category", F.lit(")")), "MEDIUM"),
        _item(~unsure & (F.col("category") == "PERSONAL_EXPENSE") & (F.col("category_confidence") < PERSONAL_MIN_CONFIDENCE), "PERSONAL_OR_BUSINESS_UNCLEAR", "Looks personal but the evidence is weak", "MEDIUM"),
        _item(F.col("own_account"), "INTERNAL_TRANSFER_SUSPECTED", F.coalesce(noted, F.lit("Own-account evidence in narration")), "HIGH"),
        _item(level.isNotNull(), "DUPLICATE_SUSPECTED", F.concat(level, F.lit(" confidence ("), "duplicate_group_id", F.lit("); kept, not deleted")), F.when(level == "HIGH", "HIGH").otherwise("MEDIUM")),
    ])
    severity = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    late = F.when(F.col("issue_type") == "BALANCE_MISMATCH", 0).otherwise(1)
    return items.withColumn("position", F.row_number().over(Window.partitionBy("statement_id").orderBy(severity, late, "seq", "rule_no")))


def flags(items: DataFrame) -> DataFrame:
    """Sorted distinct issue types of each transaction."""
    return items.filter("transaction_id is not null").groupBy("statement_id", "transaction_id").agg(F.array_sort(F.collect_set("issue_type")).alias("review_flags"))


def with_flags(ledger: DataFrame, items: DataFrame) -> DataFrame:
    """requires_review, possible_duplicate and review_flags of every transaction."""
    rows = ledger.join(flags(items), ["statement_id", "transaction_id"], "left").withColumn("review_flags", F.coalesce("review_flags", F.array().cast("array<string>")))
    return rows.withColumns({"requires_review": F.size("review_flags") > 0, "possible_duplicate": F.arrays_overlap("review_flags", F.array(F.lit("possible_duplicate"), F.lit("DUPLICATE_SUSPECTED")))})
