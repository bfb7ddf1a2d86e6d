"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes (routed by a short prefix, a hash and the document id, so that a
hot group of copies spreads over many tasks); an external sort places equal texts side by side; neighbours are compared
in full; runs that touch a partition's edge are joined up by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import SPACE, Stored, document_columns, int64_column

ROUTING_CHARS = 48

_RUN_FIELDS = [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("run_size", pa.int64()), ("first", pa.bool_()), ("edge", pa.bool_())]
_RUN_SCHEMA = "doc_id long, text_sha256 string, keep_id long, run_size long, first boolean, edge boolean"


def normalised(text):
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by content and id to rows with their run's smallest id and size. Keeps ids, not texts, of the open run."""
    ids: list[pa.Array] = []
    sha, last, first_run = None, None, True

    def closed(edge: bool) -> pa.RecordBatch:
        doc_ids = pa.concat_arrays(ids)
        n = len(doc_ids)
        head = np.zeros(n, dtype=bool)
        head[0] = True
        columns = [doc_ids, pa.array([sha]).take(pa.array(np.zeros(n, dtype=np.int64))), pa.array([doc_ids[0].as_py()] * n, pa.int64()), pa.array(np.full(n, n)), pa.array(head), pa.array(np.full(n, edge))]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_RUN_FIELDS))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm, doc_ids, shas = batch.column("norm"), batch.column("doc_id"), batch.column("text_sha256")
        same = np.empty(n, dtype=bool)
        same[0] = last is not None and norm[0].as_py() == last
        if n > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        done: list[pa.RecordBatch] = []
        if not len(starts):
            ids.append(doc_ids)
        else:
            if starts[0] > 0:
                ids.append(doc_ids.slice(0, starts[0]))
            if ids:
                done.append(closed(first_run))
                first_run = False
            if len(starts) > 1:
                done.append(_inner(doc_ids, shas, starts, first_run))
                first_run = False
            ids, sha = [doc_ids.slice(starts[-1])], shas[int(starts[-1])].as_py()
        last = norm[n - 1].as_py()
        yield from done
    if ids:
        yield closed(True)


def _inner(doc_ids: pa.Array, shas: pa.Array, starts: np.ndarray, first_run: bool) -> pa.RecordBatch:
    """The runs that begin and end within a batch, all at once."""
    lo, hi = int(starts[0]), int(starts[-1])
    sizes = np.diff(starts)
    run = np.repeat(np.arange(len(sizes)), sizes)
    head = np.zeros(hi - lo, dtype=bool)
    head[starts[:-1] - lo] = True
    edge = np.zeros(hi - lo, dtype=bool)
    if first_run:
        edge[: sizes[0]] = True
    columns = [doc_ids.slice(lo, hi - lo), shas.slice(lo, hi - lo), doc_ids.take(pa.array(starts[:-1][run])), pa.array(sizes[run]), pa.array(head), pa.array(edge)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_RUN_FIELDS))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty text are equal texts. Of equal rows (same id and text) one is kept. Null ids sort last, so they keep
    a text only where every id is null; then keep_id is null. An empty table gives an empty result; extra columns are
    ignored. Texts of any length are compared whole.
    """
    stored = Stored(docs.sparkSession)
    norm = document_columns(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = norm.select("doc_id", F.substring("norm", 1, ROUTING_CHARS).alias("route"), F.xxhash64("norm").alias("h"), "norm")
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = keyed.repartitionByRange("route", "h", by_id).sortWithinPartitions("route", "h", "norm", by_id)
    runs = stored.write(ordered.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256")).mapInArrow(_runs, _RUN_SCHEMA), "content-runs")
    edges = (
        runs.filter("edge and first").groupBy("text_sha256")
        .agg(F.min("keep_id").alias("edge_keep"), F.sum("run_size").alias("edge_size"))
    )
    # Two runs a partition at most are edges, so this side is bounded by the number of partitions.
    joined = runs.join(F.broadcast(edges), (runs.text_sha256 == edges.text_sha256) & runs.edge, "left").select(runs["*"], "edge_keep", "edge_size")
    keep = F.when(F.col("edge"), F.col("edge_keep")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("edge_size", "run_size").alias("group_size"),
        (F.col("first") & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256",
    )
