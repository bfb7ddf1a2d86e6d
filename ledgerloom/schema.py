"""Vocabularies, thresholds and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
STATEMENT = "statement_id"

# Vocabularies of the grouped pipeline.
PAYMENT_MODES_V1 = ("UPI", "NEFT", "RTGS", "IMPS", "BANK_TRANSFER", "CHEQUE", "CASH", "ATM", "DEBIT_CARD", "CREDIT_CARD", "POS", "NACH", "ECS", "INTEREST", "BANK_CHARGE", "REVERSAL", "REFUND", "UNKNOWN")
RELATIONSHIPS_V1 = ("PAYMENT", "RECEIPT", "REFUND", "REVERSAL", "TRANSFER", "REIMBURSEMENT", "LOAN_DISBURSEMENT", "LOAN_REPAYMENT", "INTEREST", "CHARGE", "TAX_PAYMENT", "SALARY", "PURCHASE", "SALE_RECEIPT", "UNKNOWN")
CATEGORIES_V1 = (
    "SALES_RECEIPT", "PURCHASE", "RAW_MATERIAL", "INVENTORY", "SALARY", "RENT", "PROFESSIONAL_FEES", "TRAVEL", "TELECOMMUNICATION", "UTILITIES", "SOFTWARE_SUBSCRIPTION", "ADVERTISING",
    "BANK_CHARGES", "INTEREST", "LOAN_REPAYMENT", "LOAN_RECEIPT", "TAX_PAYMENT", "GST_PAYMENT", "TDS_PAYMENT", "GOVERNMENT_PAYMENT", "INSURANCE", "REFUND", "REIMBURSEMENT", "INTERNAL_TRANSFER",
    "PERSONAL_EXPENSE", "CAPITAL_EXPENDITURE", "INVESTMENT", "DIVIDEND", "INTEREST_INCOME", "CASH_DEPOSIT", "CASH_WITHDRAWAL", "UNKNOWN",
)
GROUP_FIELDS = ("direction", "category", "counterparty", "month", "payment_mode", "relationship")

# Vocabularies of the evidence-based pipeline.
PAYMENT_MODES = ("UPI", "NEFT", "RTGS", "IMPS", "CHEQUE", "CASH", "ATM", "POS", "CARD", "NACH", "ECS", "INTEREST", "BANK_CHARGE", "UNKNOWN")
RELATIONSHIPS = ("PAYMENT", "RECEIPT", "REFUND", "REVERSAL", "TRANSFER", "LOAN_DISBURSEMENT", "LOAN_REPAYMENT", "INTEREST", "CHARGE", "TAX_PAYMENT", "SALARY", "WALLET_TOP_UP", "CASH", "UNKNOWN")
COUNTERPARTY_TYPES = ("PERSON", "BUSINESS", "BANK", "GOVERNMENT", "PLATFORM", "UNKNOWN")
CATEGORIES = (
    "SALES_RECEIPT", "PURCHASE", "RAW_MATERIAL", "INVENTORY", "SALARY", "RENT", "PROFESSIONAL_FEES", "TRAVEL", "UTILITIES", "SOFTWARE_SUBSCRIPTION", "ADVERTISING", "BANK_CHARGES", "INTEREST",
    "LOAN_REPAYMENT", "LOAN_RECEIPT", "TAX_PAYMENT", "GST_PAYMENT", "TDS_PAYMENT", "INSURANCE", "REFUND", "REIMBURSEMENT", "INTERNAL_TRANSFER", "PERSONAL_EXPENSE", "CAPITAL_EXPENDITURE",
    "INVESTMENT", "INTEREST_INCOME", "CASH_DEPOSIT", "CASH_WITHDRAWAL", "UNKNOWN",
)

# Thresholds.
EVIDENCE_WEIGHTS = {"account": 0.50, "upi": 0.30, "merchant": 0.25, "strong_id": 0.25, "name": 0.15, "narration": 0.10, "history": 0.10}
EXACT_KINDS = {"acct:": "account", "upi:": "upi", "mid:": "merchant"}
STRONG_KINDS = ("ifsc:", "ref:")
NAME_SIMILARITY = 0.85
CANONICAL_NAME_SIMILARITY = 0.92
DUPLICATE_NARRATION_SIMILARITY = 0.90
BALANCE_TOLERANCE = "0.02"
CLOSING_TOLERANCE = "0.50"
CLASSIFY_MIN_CONFIDENCE = 0.40
REVIEW_LOW_CONFIDENCE = 0.60
PERSONAL_MIN_CONFIDENCE = 0.80
UNUSUAL_FACTOR = 10
MAX_UPLOAD_BYTES = 5 * 1024 * 1024

RESOLUTION = T.StructType([
    T.StructField("statement_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("transaction_id", T.StringType()),
    T.StructField("counterparty_id", T.StringType()), T.StructField("counterparty_name", T.StringType()), T.StructField("counterparty_type", T.StringType()),
    T.StructField("match_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("possible_match_of", T.StringType()), T.StructField("requires_review", T.BooleanType()),
])
