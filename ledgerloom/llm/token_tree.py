"""Edit-aware token counts: a segment tree over a document's pre-tokens, kept beside the document.

Leaves hold a few dozen pre-tokens; inner nodes hold sums of characters and of tokens. What is kept of a tree is the text,
the lengths and token counts of its pre-tokens, and how they fall into leaves, in a table (``token_trees``) that edits read
and write anew (``edited_trees``) without encoding the text again. An edit re-splits from a leaf boundary that the edit
cannot move until old and new boundaries meet again, encodes only what is new in that region, and updates the sums on the
way to the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.byte_bpe import ByteBPE, _groups, default_pattern, default_ranks, tokenizer
from ledgerloom.llm.runtime import Stored, document_columns

LEAF = 48
#: Characters after a boundary that the pattern may look at before it sets it: a contraction is up to three long.
LOOKAHEAD = 3
Edit = tuple[int, int, str]


class TokenTree:
    """Token count of a text under edits. ``reencoded`` counts the pre-tokens that edits have encoded anew."""

    def __init__(self, bpe: ByteBPE, pieces: list[str]):
        self.bpe = bpe
        self.reencoded = 0
        self._build(pieces)

    @classmethod
    def of_kept(cls, bpe: ByteBPE, text: str, lengths: np.ndarray, tokens: np.ndarray, leaf_pieces: np.ndarray) -> "TokenTree":
        """The tree of what ``kept`` gave; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.bpe, tree.reencoded = bpe, 0
        ends, cuts = np.cumsum(lengths).tolist(), np.cumsum(leaf_pieces).tolist()
        pieces, tokens = [text[lo:hi] for lo, hi in zip([0, *ends], ends)], tokens.tolist()
        spans = list(zip([0, *cuts], cuts)) or [(0, 0)]
        tree._sums([pieces[lo:hi] for lo, hi in spans], [tokens[lo:hi] for lo, hi in spans])
        return tree

    def kept(self) -> tuple[str, list[int], list[int], list[int]]:
        """Text, lengths and token counts of pre-tokens, and the number of them in each leaf."""
        pieces = [p for leaf in self.leaves for p in leaf]
        return "".join(pieces), [len(p) for p in pieces], [n for counts in self.counts for n in counts], [len(leaf) for leaf in self.leaves]

    def _build(self, pieces: list[str], counts: list[int] | None = None) -> None:
        if counts is None:
            words = self.bpe.learn([pieces])
            counts = [words[w][0] for w in pieces]
        places = range(0, len(pieces), LEAF) or [0]
        self._sums([pieces[i : i + LEAF] for i in places], [counts[i : i + LEAF] for i in places])

    def _sums(self, leaves: list[list[str]], counts: list[list[int]]) -> None:
        self.leaves, self.counts = leaves, counts
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, leaf))
            self.tokens[self.width + i] = sum(counts[i])
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (or the last with characters), and where it begins."""
        node, begin = 1, 0
        position = min(position, self.length - 1)
        while node < self.width:
            node *= 2
            if position >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return max(0, node - self.width), begin

    def _set_leaf(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[i], self.counts[i] = pieces, counts
        node = self.width + i
        chars, tokens = sum(map(len, pieces)) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to ``end``."""
        if not 0 <= start <= end <= self.length:
            raise ValueError(f"edit {start}:{end} is outside a text of {self.length} characters")
        if not self.length:
            pieces = self.bpe.pre.split(replacement)
            self._build(pieces)
            self.reencoded += len(pieces)
            return
        first, begin = self._leaf_at(start)
        # Back to a boundary that stays: far enough before the edit, and not within white space that reaches it.
        while first > 0:
            before = "".join("".join(leaf) for leaf in self.leaves[first : self._leaf_at(start)[0] + 1])[: start - begin]
            if len(before) >= LOOKAHEAD and not before.isspace() and self.chars[self.width + first]:
                break
            first -= 1
            begin -= self.chars[self.width + first]
        last, stop = self._leaf_at(max(start, end - 1))
        stop += self.chars[self.width + last]
        delta = len(replacement) - (end - start)
        while True:
            old = [p for leaf in self.leaves[first : last + 1] for p in leaf]
            whole = "".join(old)
            new = whole[: start - begin] + replacement + whole[end - begin :]
            at_end = last == len(self.leaves) - 1
            kept = self._meets(old, new, start - begin, end - begin, delta, at_end)
            if kept is not None:
                break
            last += 1
            stop += self.chars[self.width + last]
        known = dict(zip(old, [n for counts in self.counts[first : last + 1] for n in counts]))
        new = [p for p in kept if p not in known]
        self.reencoded += len(new)
        if new:
            words = self.bpe.learn([new])
            known |= {p: words[p][0] for p in new}
        counts = [known[p] for p in kept]
        if len(kept) > 4 * LEAF * (last - first + 1):
            around = lambda parts, own: [x for part in parts[:first] for x in part] + own + [x for part in parts[last + 1 :] for x in part]
            self._build(around(self.leaves, kept), around(self.counts, counts))
            return
        share = -(-len(kept) // (last - first + 1)) or 1
        for n, i in enumerate(range(first, last + 1)):
            self._set_leaf(i, kept[n * share : (n + 1) * share], counts[n * share : (n + 1) * share])

    def _meets(self, old: list[str], new: str, start: int, end: int, delta: int, at_end: bool):
        """The region's pieces after the edit, or None if its boundaries don't meet the old ones within it."""
        old_ends, at = set(), 0
        for p in old:
            at += len(p)
            old_ends.add(at)
        old_length, at, fresh = at, 0, self.bpe.pre.split(new)
        for i, piece in enumerate(fresh):
            at += len(piece)
            if at - delta >= end and at >= start and at - delta in old_ends and (at_end or self._settled(new, at)):
                rest, seen = [], 0
                for p in old:
                    if seen >= at - delta:
                        rest.append(p)
                    seen += len(p)
                return fresh[: i + 1] + rest
        if at_end:
            return fresh
        return None if old_length else []

    @staticmethod
    def _settled(new: str, at: int) -> bool:
        """Whether the boundary would be the same whatever follows ``new``."""
        rest = new[at:]
        return len(rest) >= LOOKAHEAD and not rest.isspace()


_KEPT = "text string, lengths array<int>, tokens array<int>, leaf_pieces array<int>"
_COUNTS = "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_reencoded long"


def _kept_columns(trees: list[tuple]) -> list[pa.Array]:
    return [pa.array([t[0] for t in trees], pa.string())] + [pa.array([t[i] for t in trees], pa.list_(pa.int32())) for i in (1, 2, 3)]


def _even_leaves(pieces: int) -> list[int]:
    return [min(LEAF, pieces - i) for i in range(0, pieces, LEAF)] or [0]


def _grown(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text").to_pylist()):
                split = [bpe.pre.split(t) for t in texts]
                words = bpe.learn(split)
                trees = [(t, [len(p) for p in pieces], [words[p][0] for p in pieces], _even_leaves(len(pieces))) for t, pieces in zip(texts, split)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *_kept_columns(trees)], names=["doc_id", "text", "lengths", "tokens", "leaf_pieces"])
                at += len(texts)
        bpe.forget()

    return run


def token_trees(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """What is kept of each document's tree: doc_id, text, lengths, tokens, leaf_pieces. To be written as a table.

    Null text is empty and has an empty tree; repeated rows have a tree each; an empty table gives an empty one.
    """
    return document_columns(docs).mapInArrow(_grown(ranks_path or default_ranks(), pattern or default_pattern()), f"doc_id long, {_KEPT}")


def _edited(edits_of: Callable[[str], list[Edit]], ranks_path: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks_path, pattern)
        for batch in batches:
            counts, trees = [], []
            for text, *arrays in zip(batch.column("text"), *(batch.column(c) for c in ("lengths", "tokens", "leaf_pieces"))):
                text, (lengths, tokens, pieces) = text.as_py(), (a.values.to_numpy() for a in arrays)
                edits = sorted(edits_of(text), reverse=True)  # from the end, so that earlier offsets stay
                before = after = int(tokens.sum())
                again = 0
                if edits or keep:
                    tree = TokenTree.of_kept(bpe, text, lengths, tokens, pieces)
                    for edit in edits:
                        tree.edit(*edit)
                    after, again = tree.count, tree.reencoded
                    trees += [tree.kept()] if keep else []
                counts.append((before, after, len(edits), again))
            columns = [batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), *(_kept_columns(trees) if keep else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_reencoded", *(["text", "lengths", "tokens", "leaf_pieces"] if keep else [])])
        bpe.forget()

    return run


def edited_trees(trees: DataFrame, edits_of: Callable[[str], list[Edit]], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Kept trees after edits: doc_id, n_tokens, n_tokens_edited, n_edits, n_reencoded, and the tree to keep from now on.

    ``edits_of`` gives disjoint (start, end, replacement) in offsets of the text. Only regions that edits touch are encoded;
    counts equal those of encoding the edited text afresh.
    """
    return trees.mapInArrow(_edited(edits_of, ranks_path or default_ranks(), pattern or default_pattern(), True), f"{_COUNTS}, {_KEPT}")


def edited_token_counts(docs: DataFrame, edits_of: Callable[[str], list[Edit]], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_tokens_edited (after the edits), n_edits, n_reencoded.

    The documents' trees are written once, and the edits read them. Null text is empty and has no tokens; repeated rows give
    repeated results; an empty table gives an empty one.
    """
    kept = Stored(docs.sparkSession).write(token_trees(docs, ranks_path, pattern), "token-trees")
    return kept.mapInArrow(_edited(edits_of, ranks_path or default_ranks(), pattern or default_pattern(), False), _COUNTS)
