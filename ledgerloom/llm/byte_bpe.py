"""Byte-level BPE by corpus-level merge replay, and decoding.

Texts are cut into pre-tokens; the distinct ones not seen before form a block. Over the block an inverted index from the
rank that a neighbouring pair merges to, to the positions of such pairs, applies merges in rank order and touches only the
neighbours of each merge. Texts are then looked up pre-token by pre-token.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerloom.llm.runtime import document_columns

CACHED_WORDS = 60_000
BLOCK_CHARS = 3_000_000
#: So few new pre-tokens, as after an edit, are encoded one by one; an index over them costs more than it saves.
FEW_WORDS = 64
_NO_MERGE = 1 << 30


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PreTokenizer:
    """Splits by the pattern; texts of Latin letters only take a form of it with spelled-out classes, which is faster."""

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern)
        self.beyond = re.compile("[^\x00-ɏ]")
        self.fast = None
        if pattern == default_pattern():
            latin = [chr(c) for c in range(0x250)]
            letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
            numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
            space = r"\t\n\x0b\x0c\r \x85\xa0"
            self.fast = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{letters}]++|[{numbers}]++|[^{space}{letters}{numbers}]++)|[{space}]+(?![^{space}])|[{space}]+")

    def split(self, text: str) -> list[str]:
        if self.fast is None or self.beyond.search(text):
            return self.full.findall(text)
        return self.fast.findall(text)


class ByteBPE:
    """Ranks, the table of pairs that merge, and the encodings of pre-tokens met lately."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pre = PreTokenizer(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self._keys = np.array(sorted(found), dtype=np.int64)
        self._ranks = np.array([found[k] for k in self._keys.tolist()], dtype=np.int64)
        self._young: dict[str, tuple[int, str, bytes]] = {}
        self._old: dict[str, tuple[int, str, bytes]] = {}

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the joint bytes of neighbours; _NO_MERGE where they are no token or a side is no symbol (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0), self._ranks[at], _NO_MERGE)

    def replay(self, words: list[str]) -> list[tuple[int, ...]]:
        """Encodings of distinct words: every merge of the block, in rank order, through an index from rank to positions."""
        raws = [w.encode() for w in words]
        out: list[tuple[int, ...] | None] = [(r,) if (r := self.ranks.get(raw)) is not None else None for raw in raws]
        todo = [i for i, ids in enumerate(out) if ids is None]
        lengths = np.array([len(raws[i]) for i in todo], dtype=np.int64)
        if not len(todo):
            return out
        # A -1 before, between and after words keeps them apart.
        starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])[:-1]
        size = int(lengths.sum()) + len(todo) + 1
        ids = np.full(size, -1, dtype=np.int64)
        inside = np.ones(size, dtype=bool)
        inside[0] = False
        inside[starts + lengths] = False
        ids[inside] = self.byte_ids[np.frombuffer(b"".join([raws[i] for i in todo]), dtype=np.uint8)]
        nxt, prv = np.arange(1, size + 1), np.arange(-1, size - 1)
        pair = np.full(size, _NO_MERGE, dtype=np.int64)
        pair[:-1] = self._merged(ids[:-1], ids[1:])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            can = ranks != _NO_MERGE
            places, ranks = places[can], ranks[can]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                if hi > lo:
                    rank = int(ranks[lo])
                    held = index.get(rank)
                    if held is None:
                        index[rank] = [places[lo:hi]]
                        heapq.heappush(queue, rank)
                    else:
                        held.append(places[lo:hi])

        add(np.arange(size), pair)
        odd: list[np.ndarray] = []
        while queue:
            rank = heapq.heappop(queue)
            held = index.pop(rank)
            places = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            places = places[pair[places] == rank]
            if not len(places):
                continue
            if (pair[nxt[places]] == rank).any():  # overlapping pairs (aaa): the leftmost of a chain first, then every other
                places = _leftmost(np.unique(places), nxt)
            second = nxt[places]
            after = nxt[second]
            between = self._merged(np.full(len(places), rank), ids[after])
            ids[places], nxt[places], prv[after], pair[second] = rank, after, places, _NO_MERGE
            before = prv[places]
            right, left = self._merged(ids[places], ids[after]), self._merged(ids[before], ids[places])
            pair[places], pair[before] = right, left
            early = (between < rank) | (left < rank)
            if early.any():  # a merge that undercuts the order within its word
                odd.append(places[early])
            add(np.concatenate([places, before]), np.concatenate([right, left]))
        live = ids >= 0
        live[inside] &= _reached(nxt, starts, starts + lengths, size)[inside]
        flat, counts = ids[live].tolist(), np.add.reduceat(live, starts).tolist()
        at = 0
        for i, n in zip(todo, counts):
            out[i] = tuple(flat[at : at + n])
            at += n
        for w in set(np.searchsorted(starts, np.concatenate(odd), "right").tolist()) if odd else ():
            out[todo[w - 1]] = self._alone(raws[todo[w - 1]])
        return out

    def _one(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        rank = self.ranks.get(raw)
        return self._alone(raw) if rank is None else (rank,)

    def _alone(self, raw: bytes) -> tuple[int, ...]:
        """One word by the definition: merge the leftmost pair of least rank until none is left."""
        parts = [int(self.byte_ids[b]) for b in raw]
        while len(parts) > 1:
            ranks = [self.ranks.get(self.tokens[a] + self.tokens[b], _NO_MERGE) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == _NO_MERGE:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [least]
        return tuple(parts)

    def learn(self, pre_tokens: list[list[str]]) -> dict[str, tuple[int, str, bytes]]:
        """Encodings of all pre-tokens given: count, decimal ids joined by commas, decoded bytes. Replays what is new."""
        if len(self._young) > CACHED_WORDS:
            self._old, self._young = self._young, {}
        young, old, new = self._young, self._old, set()
        for pre in pre_tokens:
            for w in set(pre).difference(young):
                if w in old:
                    young[w] = old[w]
                else:
                    new.add(w)
        words = sorted(new)
        tokens = self.tokens
        for w, ids in zip(words, self.replay(words) if len(words) > FEW_WORDS else map(self._one, words)):
            young[w] = (len(ids), ",".join(map(str, ids)), b"".join([tokens[i] for i in ids]))
        return young

    def forget(self) -> None:
        """Drop the encodings met lately, so that an idle worker holds the ranks alone."""
        self._young, self._old = {}, {}

    def encode(self, text: str) -> list[int]:
        pre = self.pre.split(text)
        words = self.learn([pre])
        return [int(i) for w in pre for i in words[w][1].split(",")]

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _leftmost(places: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of chains of overlapping pairs, in order of position: the first, third, ... pair of each chain."""
    taken, last = [], -1
    for i, j in zip(places.tolist(), nxt[places].tolist()):
        if i != last:
            taken.append(i)
            last = j
    return np.array(taken)


def _reached(nxt: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which positions still hold a symbol: those that following ``nxt`` from the starts of words meets."""
    reached = np.zeros(size, dtype=bool)
    at, end = starts, ends
    while len(at):
        reached[at] = True
        at = nxt[at]
        going = at < end
        at, end = at[going], end[going]
    return reached


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(ranks_path, pattern)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of bounded size, so that pre-tokens of one group are in memory at once."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _digests(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for batch in batches:
            counts, ids_digests, decoded_digests = [], [], []
            for texts in _groups(batch.column("text").to_pylist()):
                split = [bpe.pre.split(t) for t in texts]
                words = bpe.learn(split)
                for pre in split:
                    rows = [words[w] for w in pre]
                    ids = ",".join([r[1] for r in rows])
                    counts.append(ids.count(",") + 1 if rows else 0)
                    ids_digests.append(sha256(ids.encode()).hexdigest())
                    decoded_digests.append(sha256(b"".join([r[2] for r in rows])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return run


def token_digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (of the bytes).

    Null and empty texts have no tokens. Special tokens are ordinary text. Repeated rows give repeated results; an empty
    table gives an empty one. ``ranks_path`` must be readable on every executor.
    """
    run = _digests(ranks_path or default_ranks(), pattern or default_pattern())
    return document_columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    path, pat = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pat)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return document_columns(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and bytes of every row of ``encode_documents``; null ids give no bytes."""
    path, pat = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pat)
        for batch in batches:
            raw = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
