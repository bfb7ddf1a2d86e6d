"""Readings and classifications of transactions: side tables joined with defaults, and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as t
from ledgerloom.schema import CATEGORIES, CATEGORIES_V1, CLASSIFY_MIN_CONFIDENCE, COUNTERPARTY_TYPES, RELATIONSHIPS, RELATIONSHIPS_V1, REVIEW_LOW_CONFIDENCE

KEYS = ["statement_id", "transaction_id"]
READING = {
    "payment_mode": "string", "counterparty_name_raw": "string", "counterparty_alias": "string", "counterparty_account": "string", "merchant_id": "string", "counterparty_type": "string",
    "relationship": "string", "own_account_transfer_suspected": "boolean", "possible_existing_id": "string", "confidence": "double", "evidence": "array<string>",
}


def last_by_key(side: DataFrame, keys: list[str], columns: list[str], order: str = "row_no") -> DataFrame:
    """The last row of each key in a side table, by the column ``order`` if there is one; rows that it doesn't part, by their
    values."""
    rank = [F.col(c) for c in (order,) if c in side.columns]
    return side.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*rank, *columns)).alias("r")).select(*keys, "r.*")


def rule_readings(ledger: DataFrame) -> DataFrame:
    """Readings without a model: the party in the narration, and the relationship by rule."""
    narration = F.col("narration")
    party = t.counterparty_from_narration(narration)
    return ledger.select(
        *KEYS, t.payment_mode(narration).alias("payment_mode"), party.alias("counterparty_name_raw"), F.lit(None).cast("string").alias("counterparty_alias"),
        F.lit(None).cast("string").alias("counterparty_account"), F.lit(None).cast("string").alias("merchant_id"), F.lit("UNKNOWN").alias("counterparty_type"),
        t.infer_relationship(narration, F.lit("UNKNOWN"), F.col("direction")).alias("relationship"), F.upper(narration).rlike("|".join(t.OWN_ACCOUNT_TERMS)).alias("own_account_transfer_suspected"),
        F.lit(None).cast("string").alias("possible_existing_id"), F.when(party.isNotNull(), 0.55).otherwise(0.0).alias("confidence"), F.array().cast("array<string>").alias("evidence"),
    )


def normalize(ledger: DataFrame, readings: DataFrame, account: DataFrame | None = None) -> DataFrame:
    """The ledger with its structured fields: mode, identifiers, grounded names, own-account evidence.

    Of several readings of a transaction the last counts (``last_by_key``), readings of unknown transactions don't, and rows
    without one get an empty reading. ``account``
    (statement_id, account_number, account_holder_name) names the holder.
    """
    own = [c for c in ledger.columns if c in READING]
    rows = ledger.drop(*own).join(last_by_key(readings, KEYS, list(READING)).withColumnsRenamed({c: f"r_{c}" for c in READING}), KEYS, "left")
    if account is not None:
        rows = rows.join(account.select("statement_id", "account_number", "account_holder_name"), "statement_id", "left")
    else:
        rows = rows.withColumns({"account_number": F.lit(None).cast("string"), "account_holder_name": F.lit(None).cast("string")})
    narration = F.col("narration")
    printed = F.col("reference_number") if "reference_number" in ledger.columns else None
    name = F.when(t.grounded(F.col("r_counterparty_name_raw"), narration), F.col("r_counterparty_name_raw"))
    alias = F.when(t.grounded(F.col("r_counterparty_alias"), narration), F.col("r_counterparty_alias"))
    rows = rows.withColumns({
        "payment_mode": t.payment_mode(narration, F.col("r_payment_mode")), "name": name, "alias": alias, "bank_ifsc": t.ifsc(narration), "upi_id": t.upi(narration),
        "reference": t.reference(narration, printed), "counterparty_type": t.in_vocabulary(F.col("r_counterparty_type"), COUNTERPARTY_TYPES),
        "relationship": t.in_vocabulary(F.col("r_relationship"), RELATIONSHIPS), "merchant_id": F.col("r_merchant_id"), "possible_existing_id": F.col("r_possible_existing_id"),
        "reading_confidence": F.coalesce("r_confidence", F.lit(0.0)), "pattern": t.narration_pattern(narration),
    })
    same_account = (t.digits(F.col("account_number")) != "") & (t.digits(F.col("account_number")) == t.digits(F.col("r_counterparty_account")))
    rows = rows.withColumns({"name_key": t.name_key(F.col("name")), "alias_key": t.name_key(F.col("alias"))})
    same_name = (F.col("name_key") != "") & (F.col("name_key") == t.name_key(F.col("account_holder_name")))
    notes = F.array(F.when(same_account, "counterparty account equals the holder's own account"), F.when(same_name, "counterparty name equals the account holder's name"))
    display = F.coalesce(F.nullif("name", F.lit("")), F.upper(F.col("merchant_id")))
    return rows.withColumns({
        "own_account": F.coalesce("r_own_account_transfer_suspected", F.lit(False)) | same_account | same_name,
        "evidence": F.concat(F.slice(F.coalesce("r_evidence", F.array().cast("array<string>")), 1, 4), F.filter(notes, lambda x: x.isNotNull())),
        "identifiers": t.identifiers(F.col("r_counterparty_account"), F.col("upi_id"), F.col("merchant_id"), F.col("bank_ifsc"), F.col("reference")),
        "display_key": t.name_key(display),
    }).drop(*[f"r_{c}" for c in READING])


def classify(ledger: DataFrame, classifications: DataFrame) -> DataFrame:
    """Categories with their guards. Weak or unproved ones, and wallet top-ups, become UNKNOWN; doubtful ones are reviewed.

    ``classifications``: KEYS, category, confidence, evidence, requires_review; of several for a transaction the last counts
    (``last_by_key``).
    """
    c = last_by_key(classifications, KEYS, ["category", "confidence", "evidence", "requires_review"]).select(*KEYS, F.col("category").alias("c_category"), F.col("confidence").alias("c_confidence"), F.col("evidence").alias("c_evidence"), F.col("requires_review").alias("c_review"))
    rows = ledger.join(c, KEYS, "left")
    confidence = F.coalesce("c_confidence", F.lit(0.0))
    weak = (confidence < CLASSIFY_MIN_CONFIDENCE) | (F.coalesce(F.size("c_evidence"), F.lit(0)) <= 0)
    wallet = F.coalesce(F.col("relationship") == "WALLET_TOP_UP", F.lit(False))
    category = F.when(weak | wallet, "UNKNOWN").otherwise(t.in_vocabulary(F.col("c_category"), CATEGORIES))
    rows = rows.withColumns({"category": category, "category_confidence": confidence})
    review = F.coalesce("c_review", F.lit(False)) | (F.col("category") == "UNKNOWN") | (F.col("category_confidence") < REVIEW_LOW_CONFIDENCE)
    return rows.withColumn("category_review", review).drop("c_category", "c_confidence", "c_evidence", "c_review")


def classify_grouped(ledger: DataFrame, classifications: DataFrame) -> DataFrame:
    """The grouped pipeline's classification: defaults for rows without one, then mode, party and relationship by rule.

    ``classifications``: KEYS, category, counterparty, payment_mode, relationship, confidence; the last of a transaction
    counts, and one that isn't in the ledger doesn't.
    """
    named = ["category", "counterparty", "payment_mode", "relationship", "confidence"]
    c = last_by_key(classifications, KEYS, named).withColumnsRenamed({x: f"c_{x}" for x in named})
    rows = ledger.drop("category", "counterparty", "payment_mode", "relationship", "confidence").join(c, KEYS, "left")
    narration = F.col("narration")
    label, mode = t.normalize_label(F.col("c_category")), F.coalesce(F.nullif("c_payment_mode", F.lit("UNKNOWN")), t.payment_mode_v1(narration))
    by_upi = t.normalize_name(t.upi_v1(narration))
    fallback = F.col("c_counterparty").isNull() & by_upi.isNotNull()
    rows = rows.withColumns({
        "category": F.when(label.isin(*CATEGORIES_V1), label).otherwise("UNKNOWN"), "payment_mode": mode, "counterparty": F.coalesce("c_counterparty", by_upi),
        "confidence": F.when(fallback, F.least(F.greatest(F.coalesce("c_confidence", F.lit(0.0)), F.lit(0.7)), F.lit(1.0))).otherwise(F.coalesce("c_confidence", F.lit(0.0))),
    })
    ruled = t.infer_relationship(narration, F.col("category"), F.col("direction"))
    known = F.when(F.col("c_relationship").isin(*RELATIONSHIPS_V1) & (F.col("c_relationship") != "UNKNOWN"), F.col("c_relationship"))
    rows = rows.withColumn("relationship", F.coalesce(known, ruled))
    party = t.counterparty_from_narration(narration)
    guessed = F.col("counterparty").isNull() & party.isNotNull()
    confidence = F.when(guessed, F.greatest("confidence", F.lit(0.55))).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", confidence).withColumn("counterparty", F.coalesce("counterparty", party)).drop("c_category", "c_counterparty", "c_payment_mode", "c_relationship", "c_confidence")


def merge_categories(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """Replace categories by their canonical ones (label, canonical); labels outside the vocabulary change nothing.

    The map has a row a label, the last one given (by ``row_no``), and labels that the vocabulary knows only, so it is small
    by construction.
    """
    order = [F.col("row_no")] if "row_no" in merges.columns else []
    m = merges.select(t.normalize_label(F.col("label")).alias("category"), t.normalize_label(F.col("canonical")).alias("canonical"), *order)
    m = last_by_key(m.filter(F.col("category").isin(*CATEGORIES_V1) & F.col("canonical").isin(*CATEGORIES_V1)), ["category"], ["canonical"])
    return ledger.join(F.broadcast(m), "category", "left").withColumn("category", F.coalesce("canonical", "category")).drop("canonical")


def unclassified(ledger: DataFrame, classifications: DataFrame) -> DataFrame:
    return ledger.join(classifications.select(*KEYS), KEYS, "left_anti")


def repair_relationships(ledger: DataFrame) -> DataFrame:
    ruled = t.infer_relationship(F.col("narration"), F.col("category"), F.col("direction"))
    return ledger.withColumn("relationship", F.when(F.col("relationship").isin(*RELATIONSHIPS_V1), F.col("relationship")).otherwise(ruled))
