"""Text rules as columns. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns. Alternation order is part of the result (REFERENCE 12 gives ERENCE).
DATE_LINE = r"^\s*(\d{1,2}[-/. ]([A-Za-z]{3,9}|\d{1,2})[-/. ,]+\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})"
AMOUNT = r"\d[\d,]*\.?\d{0,2}"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
MANUAL_DATE = r"^\d{2}-\d{2}-\d{4}$"
UPI_V1 = r"(?i)(?:upi[/:\-])?([A-Za-z0-9._-]+@[A-Za-z0-9._-]+)"
REFERENCE_V1 = r"(?i)\b(?:UTR|RRN|REF|REFERENCE)[\s:/-]*([A-Za-z0-9]+)"
CHEQUE_V1 = r"(?i)\b(?:CHEQUE|CHQ|CHK)[\s:/#-]*(\d+)"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
UPI = r"\b[\w.\-]{2,}@[A-Za-z]{2,}\b"
REFERENCE = r"\b\d{9,22}\b"
MODES_V1 = (
    ("UPI", r"\bUPI\b|@\w+"), ("NEFT", r"\bNEFT\b"), ("RTGS", r"\bRTGS\b"), ("IMPS", r"\bIMPS\b"), ("NACH", r"\bNACH\b"), ("ECS", r"\bECS\b"), ("ATM", r"\bATM\b"), ("POS", r"\bPOS\b"),
    ("DEBIT_CARD", r"\bDEBIT\s*CARD\b"), ("CREDIT_CARD", r"\bCREDIT\s*CARD\b"), ("CHEQUE", r"\bCHEQUE\b|\bCHQ\b|\bCHK\b"), ("CASH", r"\bCASH\b"),
    ("BANK_CHARGE", "CHARGE|FEE"), ("INTEREST", "INTEREST"), ("REVERSAL", "REVERS"), ("REFUND", "REFUND"),
)
MODES = (
    ("UPI", r"\bUPI\b"), ("IMPS", r"\bIMPS\b"), ("NEFT", r"\bNEFT\b"), ("RTGS", r"\bRTGS\b"), ("NACH", r"\bNACH\b"), ("ECS", r"\bECS\b"), ("CHEQUE", r"\b(CHQ|CHEQUE|CLG|CLEARING)\b"),
    ("ATM", r"\bATM\b"), ("POS", r"\bPOS\b"), ("CARD", r"\b(DEBIT|CREDIT) CARD\b"), ("CASH", r"\bCASH\b"), ("INTEREST", r"\bINT(EREST)?\b"), ("BANK_CHARGE", r"\b(CHARGES?|CHGS?|FEE)\b"),
)
NARRATION_STOP_WORDS = ("UPI", "NEFT", "RTGS", "IMPS", "TRANSFER", "PAYMENT", "BANK", "CASH", "ATM", "POS", "REF", "REFERENCE", "CHARGE")
BANK_WORDS = ("BANK", "HDFC", "ICICI", "AXIS", "SBI", "KOTAK", "IDFC", "YES BANK", "INDUSIND", "PNB", "BOB", "CANARA", "UNION BANK")
OWN_ACCOUNT_TERMS = ("OWN ACCOUNT", "SELF TRANSFER", "SELF TRF", "TRANSFER TO SELF", "TRANSFER FROM SELF", "OWN A/C", "SELF A/C")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extracted(c: Column, pattern: str, group: int) -> Column:
    """A regex group, null where nothing matches."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The label of the first pattern found in ``text``."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(otherwise)


def normalize_label(c: Column) -> Column:
    return blank_to_null(F.upper(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_"))))


def normalize_name(c: Column) -> Column:
    kept = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9&.\-@ ]+", " "))
    return blank_to_null(F.trim(F.regexp_replace(kept, " +", " ")))


def parse_amount(c: Column) -> Column:
    return F.abs(F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("decimal(15,2)"))


def payment_mode_v1(narration: Column) -> Column:
    return first_rule(F.upper(narration), MODES_V1, F.lit("UNKNOWN"))


def payment_mode(narration: Column, reading: Column | None = None) -> Column:
    """By pattern, else what a reader said, folded into the vocabulary."""
    from ledgerloom.schema import PAYMENT_MODES

    return first_rule(F.upper(narration), MODES, in_vocabulary(reading, PAYMENT_MODES) if reading is not None else F.lit("UNKNOWN"))


def reference_v1(narration: Column) -> Column:
    return extracted(narration, REFERENCE_V1, 1)


def upi_v1(narration: Column) -> Column:
    return extracted(narration, UPI_V1, 1)


def cheque_number(narration: Column) -> Column:
    return extracted(narration, CHEQUE_V1, 1)


def iso_date_text(c: Column) -> Column:
    return F.when(c.rlike(ISO_DATE), c)


def month_of_text(c: Column) -> Column:
    return F.when(c.rlike(ISO_DATE), F.substring(c, 1, 7))


def near_amount(a: Column, b: Column, tolerance: str = "0.01") -> Column:
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(15,2)")


def iso_date(c: Column) -> Column:
    """A date from the first ten characters (YYYY-MM-DD), else null."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def month(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit("UNKNOWN"))


def name_key(c: Column, classes: str = r"\p{L}\p{N}") -> Column:
    """Lower-case letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{classes}]+", " "))


def grounded(name: Column, narration: Column) -> Column:
    """Whether a word of three characters or more of the name stands in the narration."""
    words = F.filter(F.split(name_key(name), " "), lambda t: F.length(t) >= 3)
    return F.coalesce(F.exists(words, lambda t: F.contains(F.lower(narration), t)), F.lit(False))


def narration_pattern(narration: Column, classes: str = r"\p{L}\p{N}") -> Column:
    return name_key(F.regexp_replace(narration, r"\d+", " "), classes)


def in_vocabulary(c: Column, allowed: Sequence[str]) -> Column:
    folded = F.translate(F.upper(F.trim(c)), " -", "__")
    return F.when(folded.isin(*allowed), folded).otherwise("UNKNOWN")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def direction_v1(printed: Column) -> Column:
    """Whatever doesn't begin with C is a debit, Deposit included."""
    return F.when(F.startswith(F.upper(F.trim(printed)), F.lit("C")), "CREDIT").otherwise("DEBIT")


def direction_of(printed: Column) -> Column:
    first = F.substring(F.upper(F.trim(printed)), 1, 1)
    return F.when(first.isin("D", "W"), "DEBIT").when(first.isin("C", "R"), "CREDIT").otherwise("UNKNOWN")


def clean_amount(c: Column) -> Column:
    """Money from printed text: digits, points and minus signs; nothing left is 0, a malformed rest is null."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9.\-]", "")
    return F.when(kept == "", F.lit(0).cast("decimal(15,2)")).otherwise(kept.try_cast("decimal(15,2)"))


def clean_amount_legacy(c: Column) -> Column:
    """The older rule: a dash is 0; the letter I, commas and the rupee sign are dropped."""
    kept = F.trim(F.translate(F.coalesce(c, F.lit("")), "I,₹", ""))
    return F.when(kept.isin("", "—", "-"), F.lit(0).cast("decimal(15,2)")).otherwise(kept.try_cast("decimal(15,2)"))


def normalize_narration(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")), F.lit(""))


# The words, categories and their order in the two ladders below decide results.
def infer_relationship(narration: Column, category: Column, direction: Column) -> Column:
    text = F.upper(narration)
    return (
        F.when(F.contains(text, F.lit("REFUND")), "REFUND")
        .when(F.contains(text, F.lit("REVERS")), "REVERSAL")
        .when(F.contains(text, F.lit("INTEREST")), "INTEREST")
        .when(F.contains(text, F.lit("CHARGE")) | F.contains(text, F.lit("FEE")), "CHARGE")
        .when(category == "SALARY", "SALARY")
        .when(category.isin("GST_PAYMENT", "TDS_PAYMENT", "TAX_PAYMENT"), "TAX_PAYMENT")
        .when(category == "LOAN_RECEIPT", "LOAN_DISBURSEMENT")
        .when(category == "LOAN_REPAYMENT", "LOAN_REPAYMENT")
        .when(category == "INTERNAL_TRANSFER", "TRANSFER")
        .when(direction == "CREDIT", "RECEIPT")
        .when(direction == "DEBIT", "PAYMENT")
        .otherwise("UNKNOWN")
    )


def possible_internal_transfer(narration: Column, category: Column) -> Column:
    return F.coalesce(F.upper(narration).rlike("|".join(OWN_ACCOUNT_TERMS)), F.lit(False)) | F.coalesce(category == "INTERNAL_TRANSFER", F.lit(False))


def income_or_expense(category: Column, direction: Column) -> Column:
    return (
        F.when(category == "INTERNAL_TRANSFER", "internal_transfer")
        .when(category.isin("LOAN_RECEIPT", "LOAN_REPAYMENT"), "loan")
        .when(category.isin("INVESTMENT", "DIVIDEND", "INTEREST_INCOME"), "investment")
        .when(category.isin("GST_PAYMENT", "TDS_PAYMENT", "TAX_PAYMENT", "GOVERNMENT_PAYMENT"), "tax")
        .when(category == "REFUND", "refund")
        .when(category == "PERSONAL_EXPENSE", "personal")
        .when((direction == "CREDIT") & (category == "SALES_RECEIPT"), "business_income")
        .when((direction == "DEBIT") & (category != "UNKNOWN"), "business_expense")
        .otherwise("unknown")
    )


def counterparty_from_narration(narration: Column) -> Column:
    """The first part that looks like a party: an address with @, or two words and more."""
    parts = F.transform(F.split(narration, r"[/|:\-]+"), normalize_name)

    def looks_like_party(p: Column) -> Column:
        plain = p.isNotNull() & ~p.isin(*NARRATION_STOP_WORDS, *BANK_WORDS) & ~p.rlike(r"^\d+$")
        return plain & (F.contains(p, F.lit("@")) | F.contains(p, F.lit(" ")))

    return F.get(F.filter(parts, looks_like_party), F.lit(0))


def ifsc(narration: Column) -> Column:
    return extracted(F.upper(narration), IFSC, 0)


def upi(narration: Column) -> Column:
    return F.lower(extracted(narration, UPI, 0))


def reference(narration: Column, printed: Column | None = None) -> Column:
    found = extracted(narration, REFERENCE, 0)
    return found if printed is None else F.coalesce(blank_to_null(printed), found)


def identifiers(account: Column, upi_id: Column, merchant: Column, ifsc_code: Column, ref: Column) -> Column:
    """Identity signals with their kind, in the order of their strength."""
    signals = [("acct:", F.trim(account)), ("upi:", upi_id), ("mid:", name_key(merchant)), ("ifsc:", ifsc_code), ("ref:", ref)]
    sources = [account, upi_id, merchant, ifsc_code, ref]
    return F.filter(F.array(*[F.when(blank_to_null(s).isNotNull(), F.concat(F.lit(k), v)) for (k, v), s in zip(signals, sources)]), lambda x: x.isNotNull())


def conflicting(mine: Column, theirs: Column) -> Column:
    """Two different accounts, or UPI ids, are two parties."""

    def of_kind(ids: Column, kind: str) -> Column:
        return F.filter(ids, lambda x: F.startswith(x, F.lit(kind)))

    out = F.lit(False)
    for kind in ("acct:", "upi:"):
        a, b = of_kind(mine, kind), of_kind(theirs, kind)
        out = out | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))
    return out


def evidence_score(exact: dict[str, Column], strong: Column, name: Column, narration: Column, history: Column) -> Column:
    """Sum of the weights of what holds, 1 at most."""
    from ledgerloom.schema import EVIDENCE_WEIGHTS as W

    terms = [(exact[k], W[k]) for k in ("account", "upi", "merchant")] + [(strong, W["strong_id"]), (name, W["name"]), (narration, W["narration"]), (history, W["history"])]
    total = F.lit(0.0)
    for holds, weight in terms:
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 2)


def display_choice(c: Column) -> Column:
    """A slug for reading: underscores as spaces, words capitalised."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def cell_to_text(c: Column, kind: str) -> Column:
    """A spreadsheet cell as text: dates as dd-mm-yyyy, null as empty."""
    text = F.date_format(c, "dd-MM-yyyy") if kind in ("date", "timestamp", "timestamp_ntz") else F.trim(c.cast("string"))
    return F.coalesce(text, F.lit(""))


def stable_counterparty_id(name: Column) -> Column:
    """A display id that is the same in every process."""
    return F.when(name != "UNKNOWN", F.format_string("CP_%05d", F.pmod(F.xxhash64(name), F.lit(100_000))))
