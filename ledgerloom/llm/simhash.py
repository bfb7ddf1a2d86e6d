"""SimHash near-duplicates with BK-trees.

Documents become 64-bit fingerprints. Distinct fingerprints are dealt to shards so that two of them within the radius
share at least one shard (equal blocks of bits; a crowded shard is split again by blocks of its other bits). A task holds
one shard's BK-tree at a time and follows only edges within the radius. Links join the shard's fingerprints to spanning
trees, never to all pairs, and components are contracted on written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.runtime import Stored, document_columns

SEED = 42
CROWDED = 512


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; fewer words: of the whole sequence; none: an empty array."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, ends, starts, at = b" ".join(words), [], [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
        ends.append(at - 1)
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts, ends[k - 1 :] or ends[-1:])], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        part = hashes[lo : lo + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


class BKTree:
    """Fingerprints under edges labelled with the Hamming distance to their parent."""

    __slots__ = ("root", "children")

    def __init__(self):
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, fp: int) -> None:
        """``fp`` must be new to the tree."""
        self.children[fp] = {}
        if self.root is None:
            self.root = fp
            return
        node = self.root
        while True:
            distance = (node ^ fp).bit_count()
            nxt = self.children[node].get(distance)
            if nxt is None:
                self.children[node][distance] = fp
                return
            node = nxt

    def nearest(self, fp: int, radius: int) -> int | None:
        """A fingerprint of the tree with the least distance, if that is within the radius."""
        best, stack = None, [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            distance = (node ^ fp).bit_count()
            if distance <= radius:
                best, radius = node, distance - 1
            stack.extend(child for label, child in self.children[node].items() if distance - radius <= label <= distance + radius)
        return best

    def within(self, fp: int, radius: int) -> Iterator[int]:
        """All fingerprints of the tree within the radius."""
        stack = [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            distance = (node ^ fp).bit_count()
            if distance <= radius:
                yield node
            edges = self.children[node]
            if len(edges) <= 2 * radius + 1:
                stack.extend(child for label, child in edges.items() if distance - radius <= label <= distance + radius)
            else:
                stack.extend(edges[label] for label in range(max(1, distance - radius), distance + radius + 1) if label in edges)


def shard_links(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is connected within the shard: one a fingerprint at most."""
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for fp in fps:
        parent[fp] = fp
        for other in tree.within(fp, radius):
            a, b = find(fp), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield other, fp
        tree.add(fp)


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    return [bits[i * len(bits) // count : (i + 1) * len(bits) // count] for i in range(count)]


def _block_value(fp, bits: list[int]):
    """The value of a run of adjacent bits as a column."""
    return F.shiftrightunsigned(fp, bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def shards(fps: DataFrame, radius: int, crowded: int = CROWDED) -> DataFrame:
    """fp and shard of every fingerprint: one row for each of radius + 1 blocks, or, in shards of over ``crowded``
    fingerprints, one for each of radius + 1 blocks of the remaining bits."""
    blocks = _blocks(list(range(64)), radius + 1)
    dealt = fps.select("fp", F.posexplode(F.array(*[_block_value(F.col("fp"), b) for b in blocks])).alias("block", "value"))
    sizes = dealt.groupBy("block", "value").agg(F.count("*").alias("n"))
    shared = dealt.join(sizes.filter("n > 1"), ["block", "value"])
    whole = shared.filter(F.col("n") <= crowded).select("fp", F.concat_ws("/", "block", "value").alias("shard"))
    inner = F.lit(None)
    for i, block in enumerate(blocks):
        rest = [b for j, other in enumerate(blocks) if j != i for b in other]
        keys = []
        for part in _blocks(rest, radius + 1):
            runs: list[list[int]] = []
            for b in part:  # bits of a part need not be adjacent
                if runs and runs[-1][-1] == b - 1:
                    runs[-1].append(b)
                else:
                    runs.append([b])
            keys.append(F.concat_ws(".", *[_block_value(F.col("fp"), run) for run in runs]))
        inner = F.when(F.col("block") == i, F.array(*keys)).otherwise(inner)
    split = shared.filter(F.col("n") > crowded).select("fp", "block", "value", F.posexplode(inner).alias("part", "key"))
    return whole.unionByName(split.select("fp", F.concat_ws("/", "block", "value", "part", "key").alias("shard")))


def _linked(links: Callable[[list[int]], Iterator[tuple[int, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        shard, out = None, []
        for batch in batches:
            names, fps = batch.column("shard").to_pylist(), (batch.column("fp").to_numpy().astype(np.uint64)).tolist()
            for name, fp in zip(names, fps):
                if name != shard:
                    if len(held) > 1:
                        out.extend(links(held))
                    shard, held = name, []
                held.append(fp)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if len(held) > 1:
            out.extend(links(held))
        yield _pairs(out)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(words_of(t), k)) for t in batch.column("text").to_pylist()], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return run


def fingerprint_components(fps: DataFrame, radius: int, stored: Stored, crowded: int = CROWDED) -> DataFrame:
    """Distinct fingerprints (fp) to (node, root) for those that have a link."""
    dealt = shards(fps, radius, crowded).repartition("shard").sortWithinPartitions("shard", "fp")
    links = stored.write(dealt.mapInArrow(_linked(lambda held: shard_links(held, radius)), "a long, b long"), "simhash-links")
    return connected_components(links, stored)


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` differing bits or fewer; component_id is the smallest doc_id that links reach. Null
    and empty texts, and texts of white space, have fingerprint zero and link like any other. Null ids never become a
    component's id unless all ids in it are null (then it is null). Repeated rows give repeated results; an empty table
    gives an empty one. The search is exact: no shard is capped.
    """
    stored = Stored(docs.sparkSession)
    marked = stored.write(document_columns(docs).mapInArrow(_fingerprints(shingle_words), "doc_id long, fp long"), "simhash")
    classes = stored.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = fingerprint_components(classes.select("fp"), radius, stored, crowded)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stored.write(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
