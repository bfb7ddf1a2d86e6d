"""Near-duplicates at a similarity of word shingles: SimHash BK-trees link most, an exact completion finds the rest.

Shards are keyed by minima of hashed shingles: with ``BANDS`` keys of ``ROWS`` minima each, a pair at 0.8 shares none with
probability (1 - 0.8**ROWS)**BANDS < 1e-6, which is the whole chance to miss it. Within a shard each fingerprint looks up
its nearest one in a BK-tree, and these links are checked against the shingles. At a similarity of 0.8 fingerprints differ
in about 10 of 64 bits and, for small sets of shingles, in any number of them, so no radius bounds true pairs: texts that
the checked links leave apart, though chains of shared shards join them, are then compared exactly, whatever their
fingerprints, in blocks of bounded size against those that may be near enough in size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.runtime import Stored, packed, unpacked
from ledgerloom.llm.simhash import BKTree, fingerprint, words_of

BANDS, ROWS = 20, 3
#: How far a BK-tree looks for the nearest fingerprint, and how many fingerprints it holds before another is begun. Neither
#: affects results: what the trees don't link, the completion compares.
NEAREST, TREE = 24, 1024
#: What a task of the completion holds at once on either side: hashes, each text counting for ``TEXT_HASHES`` more.
BLOCK_HASHES, TEXT_HASHES = 32_768, 128
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUES = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64)
#: A multiplier that is 3 modulo 8, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)
_SAME_SHARD, _TREE_LINK, _SHARD_EDGE = range(3)


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys that similar sets of shingles share."""
    if not len(hashes):
        return []
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 8192):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * hashes[None, lo : lo + 8192]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[i].tobytes(), i) - 2**63 for i in range(BANDS)]


@lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count - 1, base, np.uint64)]), dtype=np.uint64)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles. Fewer words: one of the whole sequence; none: an empty array.

    A shingle's hash is that of its bytes, taken as the difference of two prefix sums over the whole text, and mixed.
    """
    if not words:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    room = 1 << max(16, len(raw).bit_length())
    up, down = _powers(_BASE, room), _powers(_INVERSE, room)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up[: len(raw)], out=prefix[1:])
    spaces = np.flatnonzero(raw == 32)
    width = min(k, len(words))
    starts = np.concatenate([[0], spaces + 1])[: len(words) - width + 1]
    ends = np.concatenate([spaces, [len(raw)]])[width - 1 :]
    out = (prefix[ends] - prefix[starts]) * down[starts]
    for shift in (32, 29):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(_BASE)
    return np.unique(out ^ (out >> np.uint64(32)))


def _words_key(words: list[bytes]) -> tuple[int, int]:
    """128 bits that stand for a text's words, in order."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype=np.int64).tolist())


def _marked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ns, fps, bands = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hashes = shingle_set(words, k)
                keys.append(_words_key(words))
                ns.append(len(hashes))
                fps.append(fingerprint(hashes))
                bands.append(band_keys(hashes))
            columns = [batch.column("id"), batch.column("h"), *(pa.array([key[i] for key in keys], pa.int64()) for i in (0, 1))]
            columns += [pa.array(ns, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).astype(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "w1", "w2", "n", "fp", "bands"])

    return run


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and fingerprint to neighbours of a shard, links to nearest fingerprints, and the first and the
    last row, whose shards other partitions may share."""
    shard, previous, tree, held, out = None, 0, BKTree(), {}, []
    for batch in batches:
        for value, fp, node in zip(*(batch.column(c).to_pylist() for c in ("value", "fp", "node"))):
            fp &= 2**64 - 1
            if value != shard:
                if shard is None:
                    out.append((_SHARD_EDGE, value, node))
                shard, tree, held = value, BKTree(), {fp: node}
                tree.add(fp)
            else:
                out.append((_SAME_SHARD, previous, node))
                if fp in held:
                    out.append((_TREE_LINK, held[fp], node))
                else:
                    near = tree.nearest(fp, NEAREST)
                    if near is not None:
                        out.append((_TREE_LINK, held[near], node))
                    if len(held) >= TREE:
                        tree, held = BKTree(), {}
                    tree.add(fp)
                    held[fp] = node
            previous = node
        if len(out) > 10_000:
            yield _links(out)
            out = []
    if shard is not None:
        out.append((_SHARD_EDGE, shard, previous))
    yield _links(out)


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _hash_sets(k: int):
    """Shingle sets of texts, once for adjacent rows of a text; a row whose words are not the expected ones is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep, sets = [], []
            for i, (text, node, w1, w2) in enumerate(zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("node", "w1", "w2")))):
                words = words_of(text.as_py()) if node != last else []
                if node != last and _words_key(words) == (w1, w2):
                    last = node
                    keep.append(i)
                    sets.append(np.sort(shingle_set(words, k).astype(np.int64)))
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in ("node", "cluster", "n")), pa.array(sets, pa.list_(pa.int64()))], names=["node", "cluster", "n", "hashes"])

    return run


def _set_views(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[lo:hi] for lo, hi in zip(offsets, offsets[1:])]


def _similar(shared, n, m, similarity: float):
    return (shared > 0) & (shared >= similarity * (n + m - shared) - 1e-9)


def _alike(similarity: float):
    """Links whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [_similar(np.intersect1d(x, y).size, len(x), len(y), similarity) for x, y in zip(_set_views(batch, "left_set"), _set_views(batch, "right_set"))]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    return run


class _Block:
    """An inverted index from shingles to the texts of a block."""

    def __init__(self, members: dict[int, tuple[int, np.ndarray]]):
        self.nodes, self.roots = np.array(list(members)), np.array([root for root, _ in members.values()])
        sets = [np.unique(h) for _, h in members.values()]
        self.sizes = np.array([len(h) for h in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def similar(self, hashes: np.ndarray, similarity: float) -> np.ndarray:
        """Places of the block's texts that have the similarity."""
        lo, hi = np.searchsorted(self.values, hashes, "left"), np.searchsorted(self.values, hashes, "right")
        lengths = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(_similar(shared, len(hashes), self.sizes, similarity))


_BLOCK_KEY = ("cluster", "size_class", "block", "chunk")


def _completed(similarity: float):
    """Blocks, each followed by the texts to compare with it, to spanning links among the groups that are left apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block, parent, out = None, {}, None, {}, []

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            sets = _set_views(batch, "hashes")
            for r, (*at, node, root, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*_BLOCK_KEY, "node", "root", "asks")))):
                if at != key:
                    key, members, block, parent = at, {}, None, {}
                if not asks:
                    members[node] = (root, sets[r].copy())
                    continue
                if block is None and members:
                    block = _Block(members)
                    members = {}
                for i in block.similar(sets[r], similarity) if block else ():
                    a, b = find(root), find(int(block.roots[i]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((node, int(block.nodes[i])))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _size_class(n: Column, similarity: float) -> Column:
    """Sizes that may have the similarity are in one class or in adjacent ones."""
    return F.floor(F.log(n) / F.lit(math.log(1 / similarity))).cast("int") if similarity < 1 else n.cast("int")


def _left_apart(sets: DataFrame, roots: DataFrame, similarity: float, stored: Stored) -> DataFrame:
    """Sets dealt to tasks so that in each cluster every text outside its largest group meets all texts of the cluster that
    are near enough in size: blocks of the cluster's texts against chunks of those that ask."""
    placed = sets.select("node", "cluster", "n").distinct().join(roots, "node", "left")
    placed = stored.write(placed.select("node", "cluster", "n", F.coalesce("root", "node").alias("root"), _size_class(F.col("n"), similarity).alias("size_class")), "near-placed")
    groups = placed.groupBy("cluster", "root").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.count("*").alias("groups"), F.max(F.struct("c", "root")).alias("most"))
    open_clusters = stored.write(groups.filter("groups > 1").select("cluster", F.col("most.root").alias("largest")), "near-open")
    texts = stored.write(placed.join(open_clusters, "cluster").withColumn("asks", F.col("root") != F.col("largest")).drop("largest"), "near-texts-apart")
    near = F.explode(F.array(*[F.col("size_class") + d for d in (-1, 0, 1)])).alias("other")
    held = texts.groupBy("cluster", "size_class").agg(F.ceil(F.sum(F.col("n") + TEXT_HASHES) / BLOCK_HASHES).cast("int").alias("blocks"))
    asked = texts.filter("asks").select("cluster", "n", near).groupBy("cluster", F.col("other").alias("size_class")).agg(F.ceil(F.sum(F.col("n") + TEXT_HASHES) / BLOCK_HASHES).cast("int").alias("chunks"))
    grid = stored.write(held.join(asked, ["cluster", "size_class"]), "near-grid")

    def part(seed: int, parts: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    columns = ("node", "root", "asks", *_BLOCK_KEY)
    members = texts.drop("asks").join(grid, ["cluster", "size_class"]).withColumn("asks", F.lit(False)).withColumn("block", part(1, "blocks")).withColumn("chunk", each("chunks")).select(*columns)
    asking = texts.filter("asks").select("cluster", "node", "root", "asks", near).withColumnRenamed("other", "size_class")
    asking = asking.join(grid, ["cluster", "size_class"]).withColumn("chunk", part(2, "chunks")).withColumn("block", each("blocks")).select(*columns)
    dealt = stored.write(members.unionByName(asking), "near-dealt")
    return dealt.join(sets.select("node", "hashes"), "node").repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY, "asks", "node")


def _identified(docs: DataFrame) -> DataFrame:
    """id, text and h: a row is known by its id and the hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _grouped(docs: DataFrame, shingle_words: int, similarity: float, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """A row per document with its words' key, and a row per text with its group and its least row."""
    rows = _identified(docs)
    marked = stored.write(rows.mapInArrow(_marked(shingle_words), "id long, h long, w1 long, w2 long, n int, fp long, bands array<long>"), "near-marked")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least")
    texts = marked.groupBy("w1", "w2").agg(least, *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    texts = stored.write(texts.withColumn("node", F.monotonically_increasing_id()), "near-texts")
    dealt = texts.select("node", "fp", F.explode("bands").alias("value"))
    found = stored.write(dealt.repartitionByRange("value", "fp", "node").sortWithinPartitions("value", "fp", "node").mapInArrow(_sharded, "kind int, a long, b long"), "near-shards")
    edges = found.filter(F.col("kind") == _SHARD_EDGE).select(F.col("a").alias("value"), F.col("b").alias("node"))
    across = edges.join(edges.groupBy("value").agg(F.min("node").alias("a")), "value").select("a", F.col("node").alias("b"))
    clusters = connected_components(found.filter(F.col("kind") == _SAME_SHARD).select("a", "b").unionByName(across), stored)
    clusters = stored.write(clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct()), "near-clusters")
    wanted = texts.join(clusters, "node").select("node", F.col("root").alias("cluster"), "n", "w1", "w2", F.col("least.id").alias("own_id"), F.col("least.h").alias("own_h"))
    full = rows.join(wanted, rows.id.eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))).select("text", "node", "cluster", "n", "w1", "w2")
    sets = stored.write(full.mapInArrow(_hash_sets(shingle_words), "node long, cluster long, n int, hashes array<long>"), "near-sets")
    links = found.filter(F.col("kind") == _TREE_LINK).select("a", "b").distinct()
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{side}_set")) for c, side in (("a", "left"), ("b", "right")))
    linked = stored.write(links.join(left, "a").join(right, "b").select("a", "b", "left_set", "right_set").mapInArrow(_alike(similarity), "a long, b long"), "near-linked")
    apart = _left_apart(sets, connected_components(linked, stored), similarity, stored)
    completed = stored.write(apart.mapInArrow(_completed(similarity), "a long, b long"), "near-completed")
    roots = connected_components(linked.unionByName(completed), stored)
    grouped = texts.select("node", "w1", "w2", "least").join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    return marked, stored.write(grouped, "near-groups")


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, group, and keep_id, the doc_id of the row that stays.

    Two texts link if the Jaccard similarity of their sets of ``shingle_words``-word shingles is ``similarity`` or more
    (a text with fewer words is one shingle); groups are what links connect. Texts with the same words, null and empty
    ones among them, are one text. The row that stays has the group's smallest doc_id, null ids last, then the smallest
    hash of its text. An empty table gives an empty result.
    """
    marked, grouped = _grouped(docs, shingle_words, similarity, Stored(docs.sparkSession))
    keep = grouped.groupBy("group").agg(F.min("least").alias("keep"))
    by_text = grouped.join(keep, "group").select("w1", "w2", "group", F.col("keep.id").alias("keep_id"))
    return marked.select("id", "w1", "w2").join(by_text, ["w1", "w2"]).select(F.col("id").alias("doc_id"), "group", "keep_id")


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of ``near_duplicate_groups``.

    Of rows alike in doc_id and text one stays.
    """
    stored = Stored(docs.sparkSession)
    marked, grouped = _grouped(docs, shingle_words, similarity, stored)
    keep = grouped.groupBy("group").agg(F.min("least").alias("keep")).select(F.col("keep.id").alias("keep_id"), F.col("keep.h").alias("keep_h"))
    repeated = marked.groupBy("id", "h").agg(F.count("*").alias("alike")).filter("alike > 1")
    keep = keep.join(repeated, F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("keep_h") == F.col("h")), "left")
    keep = stored.write(keep.select("keep_id", "keep_h", F.col("alike").isNotNull().alias("repeated")), "near-keep")
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _h=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = rows.join(keep, F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_h") == F.col("keep_h"))).drop("keep_id", "keep_h")
    if not keep.filter("repeated").isEmpty():
        kept = kept.filter("not repeated").unionByName(kept.filter("repeated").dropDuplicates(["_id", "_h"]))
    return unpacked(kept, docs)
