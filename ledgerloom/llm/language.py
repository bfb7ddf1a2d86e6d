"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A word's subwords are its character n-grams with its ends marked. A text's vector is the mean of the embeddings of all
its subwords. Embeddings and softmax are trained together by stochastic gradient descent; a temperature and a rejection
threshold are then set on documents that training did not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import crc32_mod

BUCKETS = 4096
WIDTH = 24
#: n-grams have 1 to so many characters.
LONGEST = 4
#: Documents that train and calibrate the model, at most.
SAMPLE = 3000
#: What \w has beside letters, digits of \d and the underscore: numbers such as halves, superscripts and circled digits.
_NUMBERS, _HIGH_NUMBERS = (
    re.compile("[" + "".join(c for c in map(chr, planes) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]") for planes in (range(0x80, 0x10000), range(0x10000, 0x110000))
)
_HIGH = re.compile("[\U00010000-\U0010ffff]")
_WORD = re.compile(r"[^\W\d_]+")
#: Odd multipliers for the places of an n-gram's characters, and a last one that mixes.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_MIX = np.uint32(0x2C1B3C6D)
_CHUNK = 1 << 18


def marked_words(text: str) -> str:
    """The text's words in lower case, each with its ends marked; none: an empty string."""
    low = text.lower()
    if not low.isascii():
        low = _NUMBERS.sub(" ", low)
        low = _HIGH_NUMBERS.sub(" ", low) if _HIGH.search(low) else low
    words = _WORD.findall(low)
    return "<" + "><".join(words) + ">" if words else ""


def text_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the n-grams of the text's marked words."""
    counts, marked = np.zeros(BUCKETS), marked_words(text)
    for at in range(0, len(marked), _CHUNK):
        codes = np.frombuffer(marked[at : at + _CHUNK + LONGEST - 1].encode("utf-32-le"), dtype=np.uint32)
        inner = codes != ord(">")
        h, whole = np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
        for n in range(1, LONGEST + 1):
            size = max(0, min(_CHUNK, len(codes) - n + 1))
            h = h[:size] + codes[n - 1 : n - 1 + size] * _PLACES[n - 1]
            whole = whole[:size]
            if n > 1:  # an n-gram ends with its word
                whole = whole & inner[n - 2 : n - 2 + size]
            mixed = h[whole] + np.uint32(n)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * _MIX
            counts += np.bincount((mixed >> np.uint32(12)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    langs: list[str]
    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def table(self) -> np.ndarray:
        """What one occurrence of a bucket adds to the scores of the languages."""
        return self.embedding @ self.softmax

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From summed bucket scores and numbers of subwords."""
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, langs: list[str], labels: np.ndarray, epochs: int = 40, rate: float = 4.0, batch: int = 32, seed: int = 9) -> LanguageModel:
    """``counts``: a row of bucket counts for each document. A fifth of the rows is kept for calibration."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(langs, rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs)))
    totals = counts.sum(axis=1, keepdims=True)
    x = (counts / np.maximum(totals, 1)).astype(np.float64)
    order = rng.permutation(len(x))
    aside, fit = order[: len(x) // 5], order[len(x) // 5 :]
    y = np.eye(len(langs))[labels]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(fit), batch):
            rows = np.sort(rng.choice(fit, batch)) if len(fit) > batch else fit
            h = x[rows] @ model.embedding
            z = h @ model.softmax + model.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = (z / z.sum(axis=1, keepdims=True) - y[rows]) / len(rows)
            used = np.flatnonzero(x[rows].any(axis=0))
            back = slope @ model.softmax.T
            model.softmax -= step * (h.T @ slope)
            model.bias -= step * slope.sum(axis=0)
            model.embedding[used] -= step * 10 * (x[rows][:, used].T @ back)
    if len(aside):
        sums, n = counts[aside] @ model.table(), totals[aside][:, 0]
        fits = []
        for t in np.geomspace(0.05, 5, 40):
            model.temperature = t
            p = model.probabilities(sums, n)
            fits.append((-np.log(np.maximum(p[np.arange(len(aside)), labels[aside]], 1e-12)).mean(), t))
        model.temperature = min(fits)[1]
        p = model.probabilities(sums, n)
        best, right = p.max(axis=1), p.argmax(axis=1) == labels[aside]
        # the lowest threshold at which what is accepted is right in 99 of 100 cases
        by_score = np.argsort(-best)
        good = np.flatnonzero(np.cumsum(right[by_score]) >= 0.99 * np.arange(1, len(best) + 1))
        model.reject_below = float(best[by_score][good[-1]]) if len(good) else 1.0
    return model


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, counts = [], []
        for t in batch.column("text").to_pylist():
            c = text_counts(t)
            at = np.flatnonzero(c)
            buckets.append(at.astype(np.int32))
            counts.append(c[at])
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float64()))], names=["h", "lang", "buckets", "counts"])


def fit_language(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE) -> LanguageModel:
    """Learn from text and non-null lang of a bounded sample of documents outside the held-out fold.

    The sample takes the ids with the smallest hash; documents without a letter don't train.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), folds) != held_out))
    h = F.xxhash64(F.col("doc_id").cast("long"))
    picked = usable.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h")).orderBy("h").limit(sample).select("doc_id").distinct()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in picked.collect()], "picked long")
    texts = usable.join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("picked")).select(h.alias("h"), "lang", "text")
    rows = texts.mapInArrow(_sampled, "h long, lang string, buckets array<int>, counts array<double>").toArrow()
    rows = sorted((r for r in rows.to_pylist() if r["buckets"]), key=lambda r: (r["h"], r["lang"], r["buckets"]))
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        counts[i, r["buckets"]] = r["counts"]
    return train(counts, langs, np.array([langs.index(r["lang"]) for r in rows], dtype=int)) if rows else LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros((1, 0)), np.zeros(0))


class Scorer:
    """Language scores of texts."""

    def __init__(self, model: LanguageModel):
        self.model, self.table = model, model.table()

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        model = self.model
        if not model.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        sums, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            counts = text_counts(text)
            sums[i], n[i] = counts @ self.table, counts.sum()
        p = model.probabilities(sums, n)
        best, score = p.argmax(axis=1), p.max(axis=1)
        none = n == 0
        return (
            ["und" if x else model.langs[b] for b, x in zip(best, none)],
            np.where(none, 0.0, score).tolist(),
            (none | (score < model.reject_below)).tolist(),
        )


def predict_language(docs: DataFrame, model: LanguageModel, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt. ``rejected`` is true where
    the calibrated score is below the model's threshold. A null id is in the fold of an empty text. Whole texts count.
    Repeated rows give repeated results; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs, scores, rejected = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
