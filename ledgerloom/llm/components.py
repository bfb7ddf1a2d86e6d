"""Connected components by alternating large-star and small-star contraction, on written tables.

Links are range-partitioned by both ends and sorted, so the first row of a node holds its smallest neighbour and a pass
over the rows contracts them. A hub's rows lie in as many partitions as they need; the smallest neighbour of the nodes at
partitions' edges, two a partition at most, is what partitions tell each other. A graph of a counted, bounded number of
links is joined by one task at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import Stored

#: Links that one pass of union-find holds at most.
FOREST_LINKS = 100_000
_LINK, _EDGE_ROW, _EDGE_LEAST, _UNSETTLED = range(4)
_PASS = "kind int, a long, b long"


def connected_components(edges: DataFrame, stored: Stored, at_once: int = FOREST_LINKS) -> DataFrame:
    """``edges`` (a, b) of long nodes, any order and repeats, to (node, root): the smallest node that can be reached.

    Nodes without an edge to another node are left out. No key is gathered in one task, except that one task joins what is
    left if that is no more than ``at_once`` links.
    """
    current = stored.write(edges.filter("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    if current.count() <= at_once:
        joined = stored.write(current.coalesce(1).mapInArrow(_forest, "a long, b long"), "edges")
        return joined.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _contracted(both, True, stored)
        if large is None:
            return current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        small = _contracted(large, False, stored)
        stored.drop(current)
        stored.drop(large)
        current = small


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to stars of what they connect, ``FOREST_LINKS`` links at a time."""
    parent: dict[int, int] = {}
    held = 0

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root) for x in list(parent) if (root := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            if (a := find(a)) != (b := find(b)):
                parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held > FOREST_LINKS:
            yield stars()
            parent.clear()
            held = 0
    yield stars()


def _contracted(edges: DataFrame, large: bool, stored: Stored) -> DataFrame | None:
    """One star pass. Large: larger neighbours move to the smallest of a node and its neighbours; None if ``edges``, given in
    both directions, are stars already. Small: a node and its smaller neighbours move to the smallest of them."""
    ordered = edges.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    passed = stored.write(ordered.mapInArrow(_star_pass(large), _PASS), "star")
    least = passed.filter(F.col("kind") == _EDGE_LEAST).groupBy("a").agg(F.min("b").alias("m"))
    waiting = passed.filter(F.col("kind") == _EDGE_ROW).select("a", "b").join(F.broadcast(least), "a")
    if large:
        unsettled = waiting.filter("m < a and b > m").limit(1).select("a").unionByName(passed.filter(F.col("kind") == _UNSETTLED).limit(1).select("a"))
        if unsettled.isEmpty():
            stored.drop(passed)
            return None
        moved = waiting.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        moved = waiting.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    out = passed.filter(F.col("kind") == _LINK).select("a", "b").unionByName(moved)
    out.stored_path = passed.stored_path
    return out


def _star_pass(large: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = least = last_b = None
        settled = True
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            begins = np.empty(len(a), dtype=bool)
            begins[0] = a[0] != last if last is not None else True
            begins[1:] = a[1:] != a[:-1]
            fresh = begins.copy()
            fresh[0] |= b[0] != last_b
            fresh[1:] |= b[1:] != b[:-1]
            starts = np.flatnonzero(begins)
            m = np.concatenate([[least or 0], b[starts]])[np.cumsum(begins)]
            if first is None:
                first = a[0]
                yield _rows(_EDGE_LEAST, a[:1], b[:1])
            last, last_b, least = a[-1], b[-1], m[-1]
            edge, inner = fresh & (a == first), fresh & (a != first)
            yield _rows(_EDGE_ROW, a[edge], b[edge])
            a, b, m = a[inner], b[inner], m[inner]
            if large:
                settled &= not ((m < a) & (b > m)).any()
                up = b > a
                yield _rows(_LINK, b[up], np.minimum(a, m)[up])
            else:
                yield _rows(_LINK, np.where(b == m, a, b), m)
        if first is not None and last != first:
            yield _rows(_EDGE_LEAST, np.array([last]), np.array([least]))
        if not settled:
            yield _rows(_UNSETTLED, np.zeros(1, np.int64), np.zeros(1, np.int64))

    return run


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])
