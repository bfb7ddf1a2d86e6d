"""Duplicate suspicion: rows are flagged and linked, never removed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ledgerloom.functions.similarity import Ratio
from ledgerloom.functions.text import normalize_name
from ledgerloom.operators.grouping import per_group
from ledgerloom.schema import DUPLICATE_NARRATION_SIMILARITY


def exact_duplicate_rows(ledger: DataFrame) -> DataFrame:
    """Rows that share date, amount, direction, counterparty, narration and reference (nulls alike) with another row."""
    keyed = ledger.withColumn("normalized", normalize_name(F.col("narration")))
    same = Window.partitionBy("statement_id", "txn_date", "amount", "direction", "counterparty", "normalized", "reference_number")
    return keyed.withColumn("group_rows", F.count("*").over(same)).filter("group_rows > 1")


def _block(usable: Column, keys: list[str]) -> WindowSpec:
    """Rows of a statement that share the keys; unusable rows are blocks of their own."""
    return Window.partitionBy("statement_id", *keys, F.when(~usable, F.col("seq")))


def _present(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return out


def duplicate_tiers(ledger: DataFrame) -> DataFrame:
    """``high`` and ``medium``: seq of the group's first row, by reference and then, among rows not high, by counterparty;
    ``medium_block``: seq of the first row, high or not, that shares the medium keys.

    Groups of one tier are disjoint, so each tier is one window; rows of a medium group that are high already are left out
    of its count.
    """
    referred, known = _present("reference_number"), _present("txn_date", "counterparty")
    same = _block(referred, ["reference_number", "amount", "direction"])
    rows = ledger.withColumn("high", F.when(referred & (F.count("*").over(same) > 1), F.min("seq").over(same)))
    free, keys = known & F.col("high").isNull(), ["txn_date", "amount", "direction", "counterparty"]
    left, whole = _block(free, keys), _block(known, keys)
    rows = rows.withColumn("medium_block", F.when(known, F.min("seq").over(whole)))
    return rows.withColumn("medium", F.when(free & (F.count("*").over(left) > 1), F.min("seq").over(left)))


def _similar_rows(threshold: float):
    """Each row that is still free leads the free rows whose narrations are like its own. Equal narrations go together, so a
    narration leads once and each is compared as one."""

    def solve(rows: Iterator[dict]) -> Iterator[tuple]:
        free: dict[str, list[int]] = {}
        for row in rows:
            statement, block = row["statement_id"], row["block"]
            free.setdefault((row["narration"] or "").upper(), []).append(row["seq"])
        others = {text: Ratio(text, threshold) for text in free}
        for leader in list(free):
            if leader not in free:
                continue
            near = [text for text in free if text == leader or others[text].of(leader) is not None]
            found = sorted(seq for text in near for seq in free[text])
            for text in near if len(found) > 1 else [leader]:
                del free[text]
            if len(found) > 1:
                yield from ((statement, seq, found[0], block) for seq in found)

    return solve


def possible_duplicates(tiers: DataFrame, threshold: float = DUPLICATE_NARRATION_SIMILARITY) -> DataFrame:
    """Rows of neither tier that share date, amount and direction, with narrations alike: (statement_id, seq, possible, block).

    ``possible`` is the seq of the row that leads the group, ``block`` that of the first row, free or not, that shares the
    keys. Blocks with one free row never reach Python.
    """
    keys = ["txn_date", "amount", "direction"]
    dated = tiers.filter("txn_date is not null").withColumn("block", F.min("seq").over(Window.partitionBy("statement_id", *keys)))
    free = dated.filter("high is null and medium is null").withColumn("n", F.count("*").over(Window.partitionBy("statement_id", *keys))).filter("n > 1")
    shared = free.select("statement_id", "seq", *keys, "narration", "block")
    return per_group(shared, ["statement_id", *keys], ["seq"], _similar_rows(threshold), "statement_id long, seq long, possible long, block long")


def duplicate_groups(ledger: DataFrame) -> DataFrame:
    """statement_id, seq, duplicate_group_id, confidence: tiers in order, then groups by their block's first row, flagged by
    an earlier tier or not, and then by their own."""
    tiers = duplicate_tiers(ledger)
    possible = possible_duplicates(tiers).select("statement_id", "seq", F.lit(3).alias("tier"), "block", F.col("possible").alias("first"))
    high = F.col("high").isNotNull()
    known = tiers.filter("high is not null or medium is not null").select(
        "statement_id", F.col("seq").cast("long").alias("seq"), F.when(high, 1).otherwise(2).alias("tier"),
        F.when(high, F.col("high")).otherwise(F.col("medium_block")).cast("long").alias("block"), F.coalesce("high", "medium").cast("long").alias("first"),
    )
    number = F.dense_rank().over(Window.partitionBy("statement_id").orderBy("tier", "block", "first"))
    level = F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("POSSIBLE")), F.col("tier"))
    return known.unionByName(possible).select("statement_id", "seq", F.format_string("DUP_%04d", number).alias("duplicate_group_id"), level.alias("confidence"))
