"""Line deduplication: hashed lines in range partitions, drops as compressed bitmaps.

Lines travel as 128-bit hashes with their document and position, range-partitioned by hash and document and sorted by
position. A streaming pass counts the documents of each hash; a hash that crosses a partition's edge is counted across
partitions. What comes back to a document is a compressed bitmap of the lines it keeps, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import Stored, packed

_STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_DROPS = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("edge", pa.bool_()), ("part", pa.int32())])


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    line = line.strip(_STRIP)
    return line.lower() if line.isascii() else line.translate(_LOWER)


def _hashed_lines(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            raw, rows, positions = [], [], []
            for r, text in enumerate(batch.column("text")):
                for i, line in enumerate(text.as_py().split("\n")):
                    key = line_key(line)
                    if len(key) >= least_chars:
                        raw.append(digest(key.encode()))
                        rows.append(r)
                        positions.append(i)
            h = np.frombuffer(b"".join(raw), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), *(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc", "th")), pa.array(positions, pa.int32())], names=["h1", "h2", "doc", "th", "pos"])

    return run


def _frequent(least_docs: int):
    """Sorted (h1, h2, doc, th, pos) to the rows of hashes in ``least_docs`` documents, and to all rows of hashes at an edge.

    Rows of an open hash wait only until its ``least_docs``-th document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        key, last_doc, n_docs, first = None, None, 0, True

        def flush(edge: bool) -> list[pa.RecordBatch]:
            nonlocal waiting
            if edge and not waiting and key is not None:  # all its rows are out, but other partitions need its count
                waiting = [tuple(np.array([x]) for x in (*last_doc, -1))]
            out = []
            if waiting and (edge or n_docs >= least_docs):
                docs, ths, pos = (np.concatenate(c) for c in zip(*waiting))
                n = len(docs)
                out.append(_drops(docs, ths, pos, np.full(n, key[0]), np.full(n, key[1]), np.full(n, n_docs), np.full(n, edge)))
            waiting = []
            return out

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc, th, pos = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc", "th", "pos"))
            new_key = np.empty(n, dtype=bool)
            new_key[0] = key is None or (h1[0], h2[0]) != key
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_key.copy()
            new_doc[0] |= (doc[0], th[0]) != last_doc
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
            starts = np.flatnonzero(new_key)
            lead = int(starts[0]) if len(starts) else n
            if lead:  # the rest, so far, of the open hash
                n_docs += int(new_doc[:lead].sum())
                waiting.append((doc[:lead], th[:lead], pos[:lead]))
            if len(starts):
                if key is not None:
                    yield from flush(first)
                    first = False
                if len(starts) > 1:
                    lo, hi = int(starts[0]), int(starts[-1])
                    run_of = np.cumsum(new_key[lo:hi]) - 1
                    counts = np.bincount(run_of, weights=new_doc[lo:hi]).astype(np.int64)
                    edge = (run_of == 0) & first
                    take = lo + np.flatnonzero((counts[run_of] >= least_docs) | edge)
                    yield _drops(doc[take], th[take], pos[take], h1[take], h2[take], counts[run_of[take - lo]], edge[take - lo])
                    first = False
                at = int(starts[-1])
                key, n_docs = (h1[at], h2[at]), int(new_doc[at:].sum())
                waiting = [(doc[at:], th[at:], pos[at:])]
            last_doc = (doc[-1], th[-1])
            if n_docs >= least_docs and not first:  # an inner hash, frequent already: its rows need not wait
                yield from flush(False)
        if key is not None:
            yield from flush(True)

    return run


def _drops(doc, th, pos, h1, h2, docs, edge) -> pa.RecordBatch:
    context = TaskContext.get()
    part = np.full(len(doc), context.partitionId() if context else 0)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, th, pos, h1, h2, docs, edge, part), _DROPS.types)], schema=_DROPS)


def doc_key() -> dict[str, Column]:
    """A document is a doc_id with a text (by its hash); rows alike in both are one document."""
    doc = F.col("doc_id").cast("long")
    return {"doc": F.coalesce(doc, F.lit(-(2**63))), "th": F.xxhash64(F.coalesce("text", F.lit("")), doc.isNull())}


def pack(positions: np.ndarray) -> bytes:
    """Positions of dropped lines as a compressed bitmap of whole bytes in which kept lines are ones; it ends with the last dropped one."""
    bits = np.ones((int(positions.max()) // 8 + 1) * 8, dtype=np.uint8)
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def kept_lines(text: str, bitmap: bytes | None) -> list[str]:
    lines = text.split("\n")
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document to one bitmap a document."""
    doc, held = None, []

    def emit(docs: list, maps: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in docs], pa.int64()) for i in (0, 1)), pa.array(maps, pa.binary())], names=["_doc", "_th", "bitmap"])

    for batch in batches:
        if not batch.num_rows:
            continue
        docs, maps = [], []
        ids, ths, pos = (batch.column(c).to_numpy() for c in ("doc", "th", "pos"))
        starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])) + 1).tolist()]
        for lo, hi in zip(starts, [*starts[1:], len(ids)]):
            if (int(ids[lo]), int(ths[lo])) != doc:
                if held:
                    docs.append(doc)
                    maps.append(pack(np.concatenate(held)))
                doc, held = (int(ids[lo]), int(ths[lo])), []
            held.append(pos[lo:hi])
        yield emit(docs, maps)
    if held:
        yield emit([doc], [pack(np.concatenate(held))])


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """_doc and _th (``doc_key``) and bitmap for every document that loses a line; other documents keep all lines."""
    stored = Stored(docs.sparkSession)
    keyed = docs.select(*[key.alias(name) for name, key in doc_key().items()], F.coalesce("text", F.lit("")).alias("text"))
    lines = stored.write(keyed.mapInArrow(_hashed_lines(least_chars), "h1 long, h2 long, doc long, th long, pos int"), "lines")
    ordered = lines.repartitionByRange("h1", "h2", "doc", "th").sortWithinPartitions("h1", "h2", "doc", "th", "pos")
    found = stored.write(ordered.mapInArrow(_frequent(least_docs), "doc long, th long, pos int, h1 long, h2 long, docs long, edge boolean, part int"), "line-drops")
    # A document's lines of one hash are in one partition, so the partitions' counts add up.
    parts = found.filter("edge").groupBy("h1", "h2", "part").agg(F.max("docs").alias("docs")).groupBy("h1", "h2").agg(F.sum("docs").alias("total"))
    # Two hashes a partition at most are at an edge, so this side is bounded by the number of partitions.
    over = parts.filter(F.col("total") >= least_docs).select(F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    across = found.filter("edge").join(F.broadcast(over), (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), "left_semi")
    drops = found.filter("not edge").select("doc", "th", "pos").unionByName(across.filter("pos >= 0").select("doc", "th", "pos"))
    return drops.repartition("doc", "th").sortWithinPartitions("doc", "th", "pos").mapInArrow(_bitmaps, "_doc long, _th long, bitmap binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        lines, dropped, digests = [], [], []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("bitmap").to_pylist()):
            kept, n = kept_lines(text, bitmap), text.count("\n") + 1
            lines.append(n)
            dropped.append(n - len(kept))
            digests.append(sha256("\n".join(kept).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _with_bitmaps(docs: DataFrame, least_docs: int, least_chars: int) -> DataFrame:
    bitmaps = keep_bitmaps(docs, least_docs, least_chars)
    return packed(docs, **{f"_{name}": key for name, key in doc_key().items()}).join(bitmaps, ["_doc", "_th"], "left")


def line_digests(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line. Lines whose key has ``least_chars`` code points and stands in ``least_docs``
    documents are dropped everywhere. Rows alike in doc_id and text count as one document and get the same result; an
    empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = _with_bitmaps(slim, least_docs, least_chars)
    return joined.select("row.doc_id", "row.text", "bitmap").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines and ``n_chars``, if there, counted anew; null texts stay null."""
    joined, names = _with_bitmaps(docs, least_docs, least_chars), docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = [t if t is None or b is None else "\n".join(kept_lines(t, b)) for t, b in zip(rows.field(at).to_pylist(), batch.column("bitmap").to_pylist())]
            columns = [pa.array(texts, pa.string()) if i == at else rows.field(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.select("row", "bitmap").mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
