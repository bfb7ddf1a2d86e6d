"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model over words and beginnings of words scores each sentence; a leaky noisy-or combines the
sentences' probabilities, and the document labels train it. The leak takes up labels that no word explains. Scoring names
the sentences that make a document toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import crc32_mod

#: Labelled toxic and clean documents that train the model, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Lengths of the beginnings of words that count as features beside the words.
PREFIXES = (4, 5, 6, 7)
#: Log odds that the weights of a sentence's telling words add to; a sentence without any counts for nothing.
REST = -10.0
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences: up to a stop before white space, or a line's end."""
    at = 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def features(word: str) -> list[int]:
    """Ids of the word and of its beginnings."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(b"^" + word[:n].encode()) for n in PREFIXES if len(word) > n]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of each sentence's distinct words, one sentence after another, and where each begins."""
    ids, starts = [], []
    for lo, hi in sentences(text):
        own = [i for w in set(_WORD.findall(text[lo:hi].lower())) for i in features(w)]
        if own:
            starts.append(len(ids))
            ids += sorted(own)
    return np.array(ids, dtype=np.uint32), np.array(starts, dtype=np.int32)


@dataclass
class NoisyOr:
    weights: dict[int, float] = field(default_factory=dict)
    leak: float = 0.0
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def telling(self, word: str) -> tuple[int, ...]:
        """The word's features that have a weight."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 250_000:
                self.cache.clear()
            found = self.cache[word] = tuple(i for i in features(word) if i in self.weights)
        return found

    def sentence_score(self, sentence: str) -> float:
        told = [self.weights[i] for w in set(_WORD.findall(sentence.lower())) for i in self.telling(w)]
        return 1 / (1 + float(np.exp(-np.clip(REST + sum(told), -30, 30)))) if told else 0.0

    def document_score(self, text: str) -> float:
        """Noisy-or over the sentences with a telling word and the leak, whatever the length. The sentences are looked at one by
        one only if a word of the text tells."""
        none = np.log1p(-min(self.leak, 1 - 1e-9))
        if any(map(self.telling, set(_WORD.findall(text.lower())))):
            none += sum(np.log1p(-min(self.sentence_score(text[lo:hi]), 1 - 1e-12)) for lo, hi in sentences(text))
        return float(-np.expm1(none))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, least_texts: int = 5, screen: float = 4.0, rounds: int = 400, rate: float = 0.4, l1: float = 0.002) -> NoisyOr:
    """Gradient steps on the log loss of the noisy-or, all bags at once.

    Only features whose share of toxic documents lies ``screen`` standard deviations above that of all documents take part,
    with weights that are never negative: a feature speaks for toxicity or not at all. A feature must also be in
    ``least_texts`` distinct texts (in as many as are toxic, if those are fewer), or copies of one document would make its
    rare words tell. The count is the same for samples of any size, so more labels let rarer words tell.
    """
    if not len(bags) or not labels.any():
        return NoisyOr()
    rate_all = labels.mean()
    per_doc = [np.unique(ids) for ids, _ in bags]
    words, place = np.unique(np.concatenate(per_doc), return_inverse=True)
    df = np.bincount(place, minlength=len(words))
    toxic = np.bincount(place, weights=np.repeat(labels, [len(x) for x in per_doc]), minlength=len(words))
    excess = (toxic - rate_all * df) / np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-9) * df)
    texts = {(ids.tobytes(), starts.tobytes()): d for d, (ids, starts) in enumerate(bags)}
    in_texts = np.bincount(place[np.isin(np.repeat(np.arange(len(bags)), [len(x) for x in per_doc]), list(texts.values()))], minlength=len(words))
    toxic_texts = len({(bags[d][0].tobytes(), bags[d][1].tobytes()) for d in np.flatnonzero(labels)})
    telling = words[(in_texts >= min(least_texts, toxic_texts)) & (excess >= screen)]
    if not len(telling):
        return NoisyOr({}, float(rate_all) if rate_all < 0.5 else 0.0)
    # Occurrences of telling words: which sentence, which document.
    word, sentence, doc = [], [], []
    offset = 0
    for d, (ids, starts) in enumerate(bags):
        at = np.searchsorted(telling, ids)
        hit = np.flatnonzero((at < len(telling)) & (telling[np.minimum(at, len(telling) - 1)] == ids))
        word.append(at[hit])
        sentence.append(offset + np.searchsorted(starts, hit, "right") - 1)
        doc.append(np.full(len(hit), d))
        offset += len(starts)
    word, sentence, doc = map(np.concatenate, (word, sentence, doc))
    sentences_hit, sentence = np.unique(sentence, return_inverse=True)
    doc_of = np.zeros(len(sentences_hit), dtype=int)
    doc_of[sentence] = doc
    w, leak, squares = np.full(len(telling), -REST), rate_all / 2, np.full(len(telling), 1e-2)
    y = labels.astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(REST + np.bincount(sentence, weights=w[word], minlength=len(sentences_hit)), -30, 30)))
        quiet = np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags))
        none = (1 - leak) * np.exp(quiet)
        slope = np.where(y[doc_of] > 0, -p * (none / np.maximum(1 - none, 1e-9))[doc_of], p)
        g = np.bincount(word, weights=slope[sentence], minlength=len(telling)) + l1
        squares += g * g
        w = np.maximum(0.0, w - rate * g / np.sqrt(squares))
        # the leak by expectation: how far it explains the toxic documents
        explained = y * leak / np.maximum(1 - none, 1e-9)
        leak = float(np.clip(explained.sum() / len(y), 1e-4, 0.4))
    return NoisyOr({int(i): float(x) for i, x in zip(telling, w) if x > 0.1}, leak)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [bag(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([i.view(np.int32) for i, _ in pairs], pa.list_(pa.int32())), pa.array([s for _, s in pairs], pa.list_(pa.int32()))], names=["toxic", "ids", "starts"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> NoisyOr:
    """Train on a bounded sample of labelled documents outside the held-out fold (crc32 of the id modulo ``folds``).

    Null labels and ids don't train; a document with several labels is toxic if one says so. The sample takes each class's
    ids with the smallest hash. Inputs are words of the texts alone.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.filter(crc32_mod(F.col("doc_id"), folds) != held_out)
    picked = []
    for label, sample in ((0, sample_clean), (1, sample_toxic)):
        ids = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked += [(r["doc_id"], label) for r in ids.collect()]
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(_bags, "toxic int, ids array<int>, starts array<int>").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: zlib.crc32(rows["ids"][i].values.to_numpy().tobytes()))  # partitions may come in any order
    bags = [(rows["ids"][i].values.to_numpy().view(np.uint32), rows["starts"][i].values.to_numpy()) for i in order]
    return train(bags, rows["toxic"].to_numpy()[order] if len(order) else np.empty(0))


def _scored(model: NoisyOr):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.document_score(t) for t in batch.column("text").to_pylist()], dtype=np.float64)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: NoisyOr, folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Whole texts are scored; null, empty and wordless texts score the leak, which is below 0.5. A null id is in the fold of an empty text. Repeated
    rows give repeated results; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def offending_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (code points) and score of each sentence whose own probability reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for lo, hi in sentences(text):
                    score = model.sentence_score(text[lo:hi])
                    if score >= threshold:
                        out.append((doc_id, lo, hi, score))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "start", "end", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, score double")


def without_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.document_score(t or "") < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
