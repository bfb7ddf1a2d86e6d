"""Clusters: groups of transactions that stay linked to their rows and are never merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import month
from ledgerloom.operators.aggregate import or_unknown, top_relationship
from ledgerloom.operators.measures import date_range, in_order, mean_confidence, money, numbered, totals
from ledgerloom.operators.recurring import recurring_by_bands, recurring_by_median
from ledgerloom.schema import GROUP_FIELDS


def group_fields(wanted: str | Sequence[str] | None) -> list[str]:
    """Known fields in the order asked for, each once, behind the direction; category where none is left."""
    names = [w.strip() for w in wanted.split(",")] if isinstance(wanted, str) else list(wanted or ())
    kept = [f for f in dict.fromkeys(names) if f in GROUP_FIELDS and f != "direction"]
    return ["direction", *(kept or ["category"])]


def _value(field: str) -> Column:
    if field == "direction":
        return F.col("direction")
    return month(F.col("txn_date")) if field == "month" else or_unknown(F.col(field))


def cluster_by_fields(ledger: DataFrame, group_by: str | Sequence[str] | None = None) -> DataFrame:
    """One cluster for each combination of the chosen fields, numbered as first seen, ranked by direction and total."""
    fields = group_fields(group_by)
    keyed = ledger.withColumns({f"g_{f}": _value(f) for f in fields})
    keys = ["statement_id", *(f"g_{f}" for f in fields)]
    groups = keyed.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"), money("CREDIT").alias("credit_total"), money("DEBIT").alias("debit_total"), (money("CREDIT") + money("DEBIT")).alias("total_amount"),
        *date_range(), mean_confidence().alias("confidence"), in_order("transaction_id").alias("transaction_ids"), F.min("seq").alias("first_seq"),
    )
    groups = groups.join(recurring_by_bands(keyed, keys), keys)
    groups = numbered(groups, "CL", 4, ["statement_id"], [F.col("first_seq")], "cluster_id")
    rank = F.row_number().over(Window.partitionBy("statement_id").orderBy("g_direction", F.desc("total_amount"), "first_seq"))
    named = [F.col(f"g_{f}") for f in ("counterparty", "category", "relationship", "month") if f in fields]
    name = F.coalesce(*named) if named else F.lit(None).cast("string")
    kind = F.lit("COUNTERPARTY" if "counterparty" in fields else "ACCOUNTING")
    out = groups.withColumns({"rank": rank, "cluster_name": name, "cluster_type": kind})
    return out.withColumnsRenamed({f"g_{f}": f for f in fields})


def cluster_type(counterparty_type: Column, relationship: Column, recurring: Column) -> Column:
    return (
        F.when(relationship == "WALLET_TOP_UP", "WALLET").when(relationship == "TAX_PAYMENT", "TAX").when(counterparty_type == "PLATFORM", "MERCHANT")
        .when(recurring, "RECURRING_PAYMENT").otherwise("COUNTERPARTY")
    )


def counterparty_clusters(ledger: DataFrame, counterparty: str = "counterparty") -> DataFrame:
    """One cluster a resolved counterparty, numbered by its id: totals, dates, recurrence, top relationship, review.

    Optional columns ``counterparty_type``, ``match_type``, ``possible_match_of`` and ``requires_review`` are used if there.
    """
    has = set(ledger.columns)
    rows = ledger.filter(F.col(counterparty).isNotNull())
    rows = rows.withColumns({c: F.lit(v) for c, v in (("counterparty_type", "UNKNOWN"), ("match_type", "NEW"), ("requires_review", False)) if c not in has})
    if "possible_match_of" not in has:
        rows = rows.withColumn("possible_match_of", F.lit(None).cast("string"))
    keys = ["statement_id", counterparty]
    groups = rows.groupBy(*keys).agg(
        *totals(), *date_range(), mean_confidence().alias("cluster_confidence"), F.bool_or("requires_review").alias("requires_review"), in_order("transaction_id").alias("transaction_ids"),
        F.max_by("counterparty_type", "seq").alias("counterparty_type"), F.array_sort(F.collect_set("possible_match_of")).alias("related"),
    )
    matches = rows.groupBy(*keys, "match_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "n", "match_type"))), lambda x: F.format_string("%d transaction(s) matched as %s", x["n"], x["match_type"]))
    groups = groups.join(matches.groupBy(*keys).agg(lines.alias("evidence")), keys)
    groups = groups.join(top_relationship(rows, counterparty), keys).join(recurring_by_median(rows, keys), keys)
    groups = numbered(groups, "CL_", 4, ["statement_id"], [F.col(counterparty)], "cluster_id")
    return groups.withColumn("cluster_type", cluster_type(F.col("counterparty_type"), F.col("top_relationship"), F.col("recurring")))


def related_clusters(clusters: DataFrame, counterparty: str = "counterparty") -> DataFrame:
    """Related counterparties as cluster ids; those without a cluster are left out."""
    ids = clusters.select("statement_id", F.col(counterparty).alias("other"), F.col("cluster_id").alias("other_cluster"))
    pairs = clusters.select("statement_id", "cluster_id", F.posexplode("related").alias("pos", "other")).join(ids, ["statement_id", "other"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "other_cluster"))), lambda x: x["other_cluster"])
    return clusters.join(pairs.groupBy("statement_id", "cluster_id").agg(listed.alias("related_cluster_ids")), ["statement_id", "cluster_id"], "left")


def first_cluster_of_counterparty(ledger: DataFrame, group_by: Sequence[str] = ("counterparty",)) -> DataFrame:
    """Counterparty summaries with the best ranked cluster of their name."""
    clusters = cluster_by_fields(ledger, group_by)
    return clusters.groupBy("statement_id", "counterparty").agg(F.min_by("cluster_id", "rank").alias("cluster_id"))


def cluster_of_transaction(ledger: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each transaction with its cluster, through the clusters' lists of ids."""
    members = clusters.select("statement_id", "cluster_id", F.explode("transaction_ids").alias("transaction_id"))
    return ledger.join(members, ["statement_id", "transaction_id"], "left")
