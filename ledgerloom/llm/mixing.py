"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the same expected number of copies within its source. The fractional parts are paired; each
step moves word mass between two documents, at random but fair to both, until one of them has a whole number of copies,
and keeps the pair's expected words. Leaves of a bounded number of documents run this locally; what stays fractional, one
document a leaf, is combined up a tree of groupings until one document a source remains, which is rounded at random.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.runtime import NOT_SPACE, Stored, packed, unpacked

LEAF_DOCUMENTS = 2048
TREE_FANOUT = 16
_WHOLE = 1e-9
_ITEMS = "src long, bucket long, doc_id long, no_id boolean, h long, alike long, size long, source_size long, target double, base long, p double, pick double, open boolean"


def word_count(text):
    """Number of maximal runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_SPACE}+")), F.lit(0)).cast("long")


def _pivot(items: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Round all but one of the items; the last level rounds that one as well. Order and draws come from the rows alone.

    Large documents come first: the small ones after them take up their residue, so what is left at the end is small.
    """
    items = items.sort_values(["size", "pick", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    p, size, pick = items["p"].to_numpy(copy=True), items["size"].to_numpy().astype(float), items["pick"].to_numpy()
    held = -1
    for j in range(len(p)):
        if not _WHOLE < p[j] < 1 - _WHOLE:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        moved = up if pick[j] * (up + down) < down else -down
        p[i] += moved / size[i]
        p[j] -= moved / size[j]
        for k in (i, j):
            if p[k] <= _WHOLE or p[k] >= 1 - _WHOLE:
                p[k] = round(p[k])
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    if held >= 0 and last:
        p[held] = 1.0 if pick[held] < p[held] else 0.0
    items["p"] = p
    items["open"] = (p > 0) & (p < 1)
    items["bucket"] //= TREE_FANOUT
    # a fresh draw for the next level, from the last one
    items["pick"] = (pick * 7919.0 + 0.618033988749895) % 1.0
    return items


def _level(last: bool):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        return _pivot(items, last)

    return run


def _row_hash(seed: int):
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed), "source", "text")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, stored: Stored) -> DataFrame:
    """source, src (rank by code point, null last), source_size, target, n. All steps are aggregates over the source table."""
    grouped = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n"))
    ranged = stored.write(grouped.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    # Ranks: position within a range partition plus the rows of the partitions before it.
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    offsets, before = {}, 0
    for part, count in counts:
        offsets[part], before = before, before + count
    if not offsets:
        return ranged.select("source", F.lit(0).cast("long").alias("src"), "source_size", F.lit(0.0).alias("target"), "n")
    offset = sized.sparkSession.createDataFrame(list(offsets.items()), "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = ranged.join(F.broadcast(offset), "part").withColumn("src", F.col("before") + place - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = stored.write(ranked.select("source", "src", "source_size", "n", weight.alias("weight")), "mix-ranked")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    limit = cap * F.col("source_size")
    rate, full = None, -1
    while True:  # each round shares what capped sources leave; at most one round a source, a few in practice
        capped = F.lit(False) if rate is None else F.col("weight") * rate >= limit
        row = ranked.agg(F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(F.when(capped, 1).otherwise(0))).first()
        if row[2] == full or not row[1]:
            break
        full, rate = row[2], (total - row[0]) / row[1]
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(rate or 0.0)))
    return ranked.select("source", "src", "source_size", "n", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, and h, the row's hash.

    Whole documents are taken, so ``taken`` is ``copies * size``; it differs from the source's target by less than one
    document. Null text has size 0, and documents of size 0 are never taken; null source is a source of its own, ranked
    last; rows alike in id, source and text are rounded as one and share its copies as evenly as whole ones allow; an empty
    table gives an empty result. ``share`` must not exceed ``cap``,
    or the mix cannot be met. The same input gives the same output, however it is partitioned.
    """
    drawn = _drawn(docs, weights, share, cap, seed)
    row = F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1))
    each = drawn.select("*", row.alias("row")).withColumn("copies", _share_of(F.col("row")))
    return each.select("doc_id", "h", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _share_of(row):
    """Copies of one of the rows that are alike, numbered from 0."""
    return F.floor(F.col("copies") / F.col("alike")) + F.when(row < F.col("copies") % F.col("alike"), 1).otherwise(0)


def _drawn(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int) -> DataFrame:
    """A row for each doc_id and h, with alike, the number of its rows, and copies, the number of copies they share."""
    stored = Stored(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _row_hash(seed).alias("h"))
    sized = stored.write(sized.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    sources = source_targets(sized, weights, share, cap, stored)
    sources = stored.write(sources, "mix-targets")
    leaves = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / LEAF_DOCUMENTS)))).cast("long")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = expected * F.col("d.alike")
    base = F.floor(expected + _WHOLE)
    d = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    items = d.select(
        F.col("s.src").alias("src"), F.pmod(F.shiftright(F.col("d.h"), 11), leaves).alias("bucket"), F.coalesce("d.doc_id", F.lit(0)).alias("doc_id"),
        F.col("d.doc_id").isNull().alias("no_id"), "d.h", "d.alike", "d.size", "s.source_size", "s.target",
        base.alias("base"), F.greatest(F.lit(0.0), expected - base).alias("p"), (F.pmod(F.xxhash64("d.h", F.lit(seed + 1)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("pick"),
        (F.col("d.size") > 0).alias("open"),
    )
    most = sources.agg(F.max("n")).first()[0] or 0
    level_leaves = 1
    while level_leaves * LEAF_DOCUMENTS < most:
        level_leaves *= 2
    idle = items.filter("not open")
    done, current = [idle], items.filter("open")
    while True:
        last = level_leaves == 1
        rounded = stored.write(current.groupBy("src", "bucket").applyInPandas(_level(last), _ITEMS), "mix-level")
        done.append(rounded.filter("not open"))
        if last:
            break
        current = rounded.filter("open")
        level_leaves = -(-level_leaves // TREE_FANOUT)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("base") + F.round("p").cast("long")).otherwise(F.lit(0).cast("long"))
    doc_id = F.when(~F.col("no_id"), F.col("doc_id"))
    return out.select(doc_id.alias("doc_id"), "h", "alike", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, as often as ``mix_sources`` takes it."""
    drawn = _drawn(docs, weights, share, cap, seed).filter("copies > 0").select(F.col("doc_id").alias("drawn_id"), F.col("h").alias("drawn_h"), "alike", "copies")
    drawn = Stored(docs.sparkSession).write(drawn, "mix-drawn")
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), h=_row_hash(seed))
    joined = rows.join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn_id")) & (F.col("h") == F.col("drawn_h")))
    own = F.col("copies")
    if not drawn.filter("alike > 1").isEmpty():
        own = _share_of(F.row_number().over(Window.partitionBy("drawn_id", "drawn_h").orderBy("drawn_h")) - 1)
    taken = joined.withColumn("own", own).filter("own > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own"))))
    return unpacked(taken, docs)
