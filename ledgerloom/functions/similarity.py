"""Text similarity by longest matching blocks. Not symmetric; the standard library's rule decides."""

from __future__ import annotations

from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=1 << 16)
def _classes(text: str) -> int:
    """A bit for each of 64 classes of characters that occur."""
    out = 0
    for c in set(text):
        out |= 1 << (ord(c) & 63)
    return out


class Ratio:
    """Ratios of many texts to one, as far as they can reach a threshold: upper bounds by lengths, by classes of characters
    that the other text lacks, and by characters go before the search for blocks."""

    def __init__(self, second: str, threshold: float):
        self.second, self.threshold, self.matcher = second, threshold, None

    def of(self, first: str) -> float | None:
        """The ratio if it is at the threshold or above."""
        a, b, least = len(first), len(self.second), self.threshold * (len(first) + len(self.second))
        if 2 * min(a, b) < least:
            return None
        mine, theirs = _classes(first), _classes(self.second)
        if 2 * min(a - (mine & ~theirs).bit_count(), b - (theirs & ~mine).bit_count()) < least:
            return None
        if self.matcher is None:
            self.matcher = SequenceMatcher(None, "", self.second)
        self.matcher.set_seq1(first)
        if self.matcher.quick_ratio() < self.threshold:
            return None
        ratio = self.matcher.ratio()
        return ratio if ratio >= self.threshold else None


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of each pair; null where a side is. Each pair of texts of a batch is compared once."""

    def ratios(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = list(zip(x.to_pylist(), y.to_pylist()))
        known = {pair: None if None in pair else text_ratio(*pair) for pair in set(pairs)}
        return pa.array([known[pair] for pair in pairs], pa.float64())

    return F.arrow_udf(ratios, "double")(a, b)


@lru_cache(maxsize=4096)
def _long_words(key: str) -> frozenset[str]:
    return frozenset(w for w in key.split() if len(w) >= 3)


@lru_cache(maxsize=1 << 17)
def _alike(key: str, other: str, threshold: float) -> bool:
    """The same names stand in many statements, so a worker keeps what it has compared lately."""
    words, theirs = _long_words(key), _long_words(other)
    return key == other or bool(words and theirs and (words <= theirs or theirs <= words)) or Ratio(other, threshold).of(key) is not None


def similar_to(key: str, known: Iterable[str], threshold: float) -> Iterable[str]:
    """Those of ``known`` that are equal, whose words of three characters and more hold or are within the key's, or whose
    ratio from the key reaches the threshold."""
    return (other for other in known if key and other and _alike(key, other, threshold))


def names_similar(key: str, known: Iterable[str], threshold: float) -> bool:
    return any(True for _ in similar_to(key, known, threshold))
