"""Running-balance checks. The printed balance never changes, so both checks are windows over the statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import normalize_name
from ledgerloom.operators.measures import money
from ledgerloom.schema import BALANCE_TOLERANCE, CLOSING_TOLERANCE


def _by_seq():
    return Window.partitionBy("statement_id").orderBy("seq")


def _signed():
    return F.when(F.col("direction") == "CREDIT", F.col("amount")).otherwise(-F.col("amount"))


def carried_balance(ledger: DataFrame) -> DataFrame:
    """``previous_balance``: the last balance printed before the row, or the opening balance; ``delta`` to this row's."""
    before = F.last("balance", ignorenulls=True).over(_by_seq().rowsBetween(Window.unboundedPreceding, -1))
    rows = ledger.withColumn("previous_balance", F.coalesce(before, F.col("opening_balance")))
    return rows.withColumn("delta", F.col("balance") - F.col("previous_balance"))


def checked_rows(ledger: DataFrame) -> DataFrame:
    """Each row with ``checked``, ``reconciled`` and ``corrected_direction``.

    An unknown direction is read off the balance change, credit first; one that reconciles only the other way is flipped.
    """
    close = lambda a, b: F.abs(a - b) <= F.lit(BALANCE_TOLERANCE).cast("decimal(18,2)")
    rows = carried_balance(ledger)
    delta, amount, checked = F.col("delta"), F.col("amount"), F.col("delta").isNotNull()
    read = F.when(F.col("direction") != "UNKNOWN", F.col("direction")).when(checked & close(delta, amount), "CREDIT").when(checked & close(delta, -amount), "DEBIT").otherwise("UNKNOWN")
    rows = rows.withColumn("read_direction", read)
    signed = F.when(F.col("read_direction") == "CREDIT", amount).otherwise(-amount)
    fits, flips = close(delta, signed), close(delta, -signed) & (F.col("read_direction") != "UNKNOWN")
    other = F.when(F.col("read_direction") == "CREDIT", "DEBIT").otherwise("CREDIT")
    flip = checked & ~fits & flips
    return rows.withColumns({
        "checked": checked, "reconciled": F.coalesce(checked & (fits | flips), F.lit(False)),
        "corrected_direction": F.when(F.coalesce(flip, F.lit(False)), other).otherwise(F.col("read_direction")),
        "corrections": F.when(F.col("direction") != F.col("read_direction"), 1).otherwise(0) + F.when(F.coalesce(flip, F.lit(False)), 1).otherwise(0),
    })


def balance_breaks(ledger: DataFrame) -> DataFrame:
    return checked_rows(ledger).filter("checked and not reconciled")


def validate(ledger: DataFrame) -> DataFrame:
    """Per statement: share of rows that reconcile (100 where none was checked), totals after correction, status."""
    rows = checked_rows(ledger).withColumn("direction", F.col("corrected_direction"))
    has_closing = "closing_balance" in ledger.columns
    closing = F.max("closing_balance") if has_closing else F.lit(None).cast("decimal(15,2)")
    agg = rows.groupBy("statement_id").agg(
        F.count("*").alias("transaction_count"), F.count_if("checked").alias("checked"), F.count_if("reconciled").alias("reconciled"), F.sum("corrections").alias("directions_corrected"),
        money("CREDIT").alias("credit_total"), money("DEBIT").alias("debit_total"), F.count_if(F.col("checked") & ~F.col("reconciled")).alias("balance_breaks"),
        F.bool_or((F.col("direction") == "UNKNOWN") | F.col("txn_date").isNull()).alias("incomplete_rows"), F.max_by("balance", "seq").alias("last_balance"), closing.alias("closing_balance"),
    )
    share = F.when(F.col("checked") == 0, F.lit(100.0)).otherwise(F.round(F.col("reconciled") * F.lit(100).cast("decimal(5,0)") / F.col("checked"), 2).cast("double"))
    differs = F.coalesce(F.abs(F.col("closing_balance") - F.col("last_balance")) > F.lit(CLOSING_TOLERANCE).cast("decimal(15,2)"), F.lit(False))
    issues = F.filter(
        F.array(
            F.when(F.col("balance_breaks") > 0, F.format_string("%d running-balance breaks (rows may be missing or misread)", "balance_breaks")),
            F.when(F.col("incomplete_rows"), F.lit("Some rows have unknown direction or date")),
            F.when(differs, F.lit("Last balance differs from closing balance (rows may be missing)")),
        ),
        lambda x: x.isNotNull(),
    )
    status = F.when(F.col("balance_consistency") < 70, "FAIL").when(F.size("issues") == 0, "PASS").otherwise("WARNING")
    return agg.withColumn("balance_consistency", share).withColumn("issues", issues).withColumn("validation_status", status)


def adjacent_checks(ledger: DataFrame) -> DataFrame:
    """Neighbouring printed balances checked in both reading orders; the one that fits more rows corrects directions.

    Descending wins only if it fits strictly more. ``corrected_direction`` is by the winner's neighbour alone.
    """
    rows = ledger.withColumns({"before": F.lag("balance").over(_by_seq()), "after": F.lead("balance").over(_by_seq())})
    up, down = F.col("balance") - F.col("before"), F.col("balance") - F.col("after")
    rows = rows.withColumns({"delta_up": up, "delta_down": down, "fit_up": F.coalesce((up == _signed()).cast("int"), F.lit(0)), "fit_down": F.coalesce((down == _signed()).cast("int"), F.lit(0))})
    whole = Window.partitionBy("statement_id")
    rows = rows.withColumn("descending", F.sum("fit_down").over(whole) > F.sum("fit_up").over(whole))
    delta = F.when(F.col("descending"), F.col("delta_down")).otherwise(F.col("delta_up"))
    truth = F.when(delta > 0, "CREDIT").otherwise("DEBIT")
    corrected = F.when(F.abs(delta) == F.col("amount"), truth).otherwise(F.col("direction"))
    return rows.withColumns({"paired": delta.isNotNull(), "fits": F.when(F.col("descending"), F.col("fit_down")).otherwise(F.col("fit_up")), "corrected_direction": corrected})


def validate_adjacent(ledger: DataFrame) -> DataFrame:
    """Per statement: sums before correction, shares of fitting balances (0 without pairs) and dated rows, duplicates, status."""
    rows = adjacent_checks(ledger)
    has = set(ledger.columns)
    narration = F.col("narration") if "narration" in has else F.lit(None).cast("string")
    reference = F.col("reference_number") if "reference_number" in has else F.lit(None).cast("string")
    row = F.struct("txn_date", "amount", "direction", normalize_name(narration).alias("n"), reference.alias("r"))
    no_text = narration.isNull() | (narration == "") if "narration" in has else F.lit(False)
    agg = rows.groupBy("statement_id").agg(
        F.count("*").alias("transaction_count"), money("CREDIT").alias("credit_total"), money("DEBIT").alias("debit_total"), F.count_if("paired").alias("pairs"),
        F.sum(F.when(F.col("paired"), F.col("fits")).otherwise(0)).alias("fitting"), F.count("txn_date").alias("dated"), (F.count("*") - F.count_distinct(row)).alias("duplicate_rows"),
        F.count_if(F.col("amount").isNull() | ~F.col("direction").isin("CREDIT", "DEBIT") | no_text).alias("missing_data"),
        F.count_if(F.col("direction") != F.col("corrected_direction")).alias("directions_corrected"), F.bool_or("descending").alias("descending"),
    )
    hundred = F.lit(100).cast("decimal(5,0)")
    balance = F.when(F.col("pairs") == 0, F.lit(0.0)).otherwise(F.round(F.col("fitting") * hundred / F.col("pairs"), 2).cast("double"))
    dates = F.round(F.col("dated") * hundred / F.col("transaction_count"), 2).cast("double")
    agg = agg.withColumns({"balance_consistency": balance, "date_consistency": dates})
    enough_balance, enough_dates = 100 * F.col("fitting") >= 90 * F.col("pairs"), 100 * F.col("dated") >= 95 * F.col("transaction_count")
    some = F.col("pairs") > 0
    status = F.when(some & enough_balance & enough_dates, "PASS").when(some & (100 * F.col("fitting") >= 70 * F.col("pairs")), "WARNING").otherwise("FAIL")
    issues = F.filter(
        F.array(
            F.when(some & ~enough_balance, F.concat(F.lit("Running balance consistency is only "), F.format_number("balance_consistency", 1), F.lit("%."))),
            F.when(~enough_dates, F.format_string("%d transactions have missing/invalid dates.", F.col("transaction_count") - F.col("dated"))),
            F.when(F.col("duplicate_rows") > 0, F.format_string("%d exact duplicate transaction rows detected.", "duplicate_rows")),
            F.when(F.col("missing_data") > 0, F.format_string("%d transactions have missing required data.", "missing_data")),
        ),
        lambda x: x.isNotNull(),
    )
    return agg.withColumns({"issues": issues, "validation_status": status})
