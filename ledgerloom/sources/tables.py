"""Ledger views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions: one statement a customer, suppliers as counterparties (null for some)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(part, line.l_partkey == part.p_partkey)
    )
    order = Window.partitionBy("o_custkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    priority = F.col("o_orderpriority")
    mode = F.when(priority == "1-URGENT", "RTGS").when(priority == "2-HIGH", "NEFT").when(priority == "3-MEDIUM", "UPI").when(priority == "4-NOT SPECIFIED", "IMPS").otherwise("CASH")
    direction = F.when(F.col("l_returnflag") == "R", "CREDIT").otherwise("DEBIT")
    rows = joined.withColumn("seq", F.row_number().over(order))
    return rows.select(
        F.col("o_custkey").alias("statement_id"), "seq", F.format_string("tx_%06d", "seq").alias("transaction_id"), "l_orderkey", "l_partkey",
        F.col("l_shipdate").cast("date").alias("txn_date"), F.col("l_extendedprice").cast("decimal(15,2)").alias("amount"), direction.alias("direction"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("s_name")).alias("counterparty"), F.col("p_type").alias("category"), mode.alias("payment_mode"),
        F.when(direction == "CREDIT", "RECEIPT").otherwise("PAYMENT").alias("relationship"), (1 - 5 * F.col("l_discount")).cast("decimal(3,2)").alias("confidence"),
    )


def damaged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with printed balances (gaps, errors of 1.00) and directions that are missing or flipped in places."""
    rows = ledger(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(15,2)").alias("opening_balance"))
    signed = F.when(F.col("direction") == "CREDIT", F.col("amount")).otherwise(-F.col("amount"))
    running = F.sum(signed).over(Window.partitionBy("statement_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    part = F.col("l_partkey")
    wrong = F.when(part % 37 == 0, F.lit(1)).otherwise(F.lit(0))
    balance = F.when(part % 5 != 0, (F.col("opening_balance") + running + wrong).cast("decimal(18,2)"))
    flipped = F.when(F.col("direction") == "CREDIT", "DEBIT").otherwise("CREDIT")
    printed = F.when(part % 11 == 0, "UNKNOWN").when(part % 13 == 0, flipped).otherwise(F.col("direction"))
    return rows.join(customer, rows.statement_id == customer.c_custkey).drop("c_custkey").withColumn("balance", balance).withColumn("direction", printed)


def narrated_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions with narrations: one statement a user."""
    events = table(spark, sf_dir, "events")
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    number = (F.col("event_id") + 100_000_000).cast("string")
    narration = (
        F.when(kind == "purchase", F.concat(F.lit("UPI/shop"), k, F.lit("@okbank/REF "), number))
        .when(kind == "click", F.concat(F.lit("POS CARD FEE "), k))
        .when(kind == "error", F.concat(F.lit("REFUND REVERSAL "), k))
        .when(kind == "signup", F.concat(F.lit("NEFT-HDFC0123456-ACME TRADERS "), k))
        .otherwise(F.concat(F.lit("CASH DEPOSIT SELF TRF "), k))
    )
    return events.select(
        F.col("user_id").alias("statement_id"), "event_id", F.col("event_id").alias("row_id"), F.col("ts").cast("date").alias("txn_date"), F.col("value").cast("decimal(15,2)").alias("amount"),
        F.when(kind.isin("purchase", "click"), "DEBIT").otherwise("CREDIT").alias("direction"), narration.alias("narration"), kind.alias("counterparty"),
        F.when(F.col("event_id") % 40 != 0, number).alias("reference_number"),
    )


def doubled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrated ledger with every twentieth row twice."""
    rows = narrated_ledger(spark, sf_dir)
    again = rows.filter(F.col("event_id") % 20 == 0).withColumn("row_id", F.col("event_id") + 10_000_000)
    return rows.unionByName(again)


def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrated ledger as printed text: two head lines, then a line for each transaction."""
    rows = narrated_ledger(spark, sf_dir)
    word = F.when(F.col("direction") == "CREDIT", "Cr").otherwise("Withdrawal")
    line = F.concat_ws(" ", F.date_format("txn_date", "yyyy-MM-dd"), "narration", F.col("amount").cast("string"), word)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    heads = F.when(F.col("statement_id") % 2 == 0, "Date Narration Debit Credit Balance").otherwise("Date Particulars Amount Dr or Cr")
    text = F.concat_ws("\n", F.concat(F.lit("Statement of "), F.col("statement_id").cast("string")), heads, F.array_join("lines", "\n"))
    return rows.groupBy("statement_id").agg(lines.alias("lines")).select("statement_id", text.alias("text"))


def balanced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrated ledger with ids, printed balances (every fifth missing) and, in places, the wrong direction."""
    order = Window.partitionBy("statement_id").orderBy("event_id")
    rows = narrated_ledger(spark, sf_dir).withColumn("seq", F.row_number().over(order)).withColumnRenamed("counterparty", "event_type")
    signed = F.when(F.col("direction") == "CREDIT", F.col("amount")).otherwise(-F.col("amount"))
    running = F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1000
    flipped = F.when(F.col("direction") == "CREDIT", "DEBIT").otherwise("CREDIT")
    return rows.withColumns({
        "transaction_id": F.format_string("tx_%06d", "seq"), "balance": F.when(F.col("event_id") % 5 != 0, running.cast("decimal(18,2)")),
        "opening_balance": F.lit(1000).cast("decimal(15,2)"), "extraction_confidence": F.lit(0.9), "direction": F.when(F.col("event_id") % 13 == 0, flipped).otherwise(F.col("direction")),
    })
