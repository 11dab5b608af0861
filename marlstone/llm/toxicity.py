"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label. Each sentence gets a logistic score from the words
that it has, each counted once;
the document's score is their noisy-or with a leak: 1 - exp(-leak - sum softplus(z)). Fitting the documents' likelihood
teaches the sentence scores, which then point at the offending sentences.

Words and word stems (the first 4 to 7 letters) that are more frequent in toxic documents of the sample than chance
explains are the features. The leak takes up
labels that no word explains, so that a long document isn't toxic for its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import crc_mod, packed, persisted
from marlstone.llm.quality import labelled_sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
LEXICON = 4000
LEAST_DOCS = 3
LEAST_Z = 3.0
STEMS = (4, 5, 6, 7)
#: Documents whose words a task counts before it hands them on.
COUNT_ROWS = 1000
#: Words whose weight a task remembers.
CACHE_WORDS = 200_000
STEPS = 300
_SENTENCE_ENDS = b".!?\n\r"
_TABLE = bytes(10 if c in _SENTENCE_ENDS else c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?\n\r]+")


def sentences(text: str | None) -> list[list[bytes]]:
    """Words (runs of ASCII letters, lower-cased, and non-ASCII characters) of each sentence that has any."""
    return [w for s in (text or "").encode().translate(_TABLE).split(b"\n") if (w := s.split())]


def parts_of(word: bytes) -> list[bytes]:
    """The word and its stems; a stem ends in ``-``."""
    text = word.decode("utf-8", "replace")
    return [word, *((text[:n] + "-").encode() for n in STEMS if n < len(text))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class BagModel:
    """Word weights, the sentences' bias and the leak."""

    def __init__(self, weights: dict[bytes, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def weight(self, word: bytes) -> float:
        """Sum of the weights of a word and its stems."""
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(p, 0.0) for p in parts_of(word))
        return w

    def scores(self, text: str | None) -> tuple[float, list[float]]:
        """The document's score and those of its sentences."""
        z = self.bias + np.array([sum(map(self.weight, words)) for words in map(set, sentences(text))])
        return float(-np.expm1(-self.leak - _softplus(z).sum())), _sigmoid(z).tolist()

    def located(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Start, end (code points, exclusive) and score of each sentence that scores ``least`` or more."""
        out = []
        for m in _SENTENCE.finditer(text or ""):
            words = {w for s in sentences(m[0]) for w in s}
            if words:
                p = _sigmoid(self.bias + sum(map(self.weight, words)))
                if p >= least:
                    out.append((m.start(), m.end(), float(p)))
        return out


def count_parts(rows: Iterable[tuple[int, str | None]]) -> dict[bytes, list[int]]:
    """For each word and stem: documents that have it, and toxic ones among them."""
    seen: dict[bytes, list[int]] = {}
    for label, text in rows:
        for part in {p for w in {w for s in sentences(text) for w in s} for p in parts_of(w)}:
            c = seen.setdefault(part, [0, 0])
            c[0] += 1
            c[1] += label
    return seen


def numbered(text: str | None, number: dict[bytes, int]) -> tuple[int, list[list[int]]]:
    """Sentences without any of the words, which all score alike, as a count; the words' numbers in the others."""
    plain, bag = 0, []
    for words in sentences(text):
        own = [number[p] for w in sorted(set(words)) for p in parts_of(w) if p in number]
        if own:
            bag.append(own)
        else:
            plain += 1
    return plain, bag


def fit(words: list[bytes], bags: list[tuple[int, int, list[list[int]]]], *, steps: int = STEPS, ridge: float = 0.05) -> BagModel:
    """Full-batch likelihood ascent (Adam) on (label, plain sentences, word numbers of the others).

    Without labels of both kinds there are no words and the leak is the share.
    """
    y = np.array([b[0] for b in bags], dtype=float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return BagModel({}, -20.0, float(-np.log1p(-share)))
    plain = np.array([b[1] for b in bags], dtype=float)
    owner = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    flat = [s for b in bags for s in b[2]]
    n = len(flat)
    sentence = np.repeat(np.arange(n), [len(s) for s in flat])
    word = np.array([i for s in flat for i in s], dtype=np.int64)
    theta = np.concatenate([np.zeros(len(words)), [-8.0, np.log(np.expm1(0.02))]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        z = bias + np.bincount(sentence, w[word], n)
        total = _softplus(leak) + np.bincount(owner, _softplus(z), len(bags)) + plain * _softplus(bias)
        slope = np.where(y > 0, 1 / np.expm1(np.clip(total, 1e-9, 50)), -1.0)
        by_z = slope[owner] * _sigmoid(z)
        gradient = np.concatenate([np.bincount(word, by_z[sentence], len(words)) - ridge * w, [by_z.sum() + (slope * plain).sum() * _sigmoid(bias) - 40 * (bias + 8), slope.sum() * _sigmoid(leak)]])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return BagModel({w: float(v) for w, v in zip(words, theta[:-2]) if abs(v) > 1e-3}, float(theta[-2]), float(_softplus(theta[-1])))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> BagModel:
    """Fit on the rows of ``labels``; ``sample_rows`` bounds the documents that are used.

    Words are counted and numbered on the executors; the driver holds at most LEXICON words and their numbers in the
    sample's sentences.
    """
    rows = labelled_sample(docs, labels, label, sample_rows, text_col, id_col)
    sample = persisted(rows.select(F.col("__id").cast("string").alias("id"), F.col("__label").alias("label"), F.col("__text").alias("text")))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    words: list[bytes] = []
    if 0 < toxic < n:
        share = toxic / n

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in range(0, batch.num_rows, COUNT_ROWS):
                    own = batch.slice(part, COUNT_ROWS)
                    seen = count_parts(zip(own.column(1).to_pylist(), own.column(2).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], ["word", "m", "k"])

        counts = sample.mapInArrow(count, "word binary, m long, k long").groupBy("word").agg(F.sum("m").alias("m"), F.sum("k").alias("k")).where(F.col("m") >= LEAST_DOCS)
        z = (F.col("k") - share * F.col("m")) / F.sqrt(F.col("m") * (share * (1 - share)))
        words = [bytes(r["word"]) for r in counts.withColumn("z", z).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "word").limit(LEXICON).collect()]
    number = {w: i for i, w in enumerate(words)}

    def to_numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbered(t, number) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.list_(pa.int32())))], ["id", "label", "plain", "bag"])

    found = sample.mapInArrow(to_numbers, "id string, label int, plain long, bag array<array<int>>").collect()
    return fit(words, sorted((r["label"], r["plain"], r["bag"]) for r in sorted(found, key=lambda r: r["id"])))


def score(docs: DataFrame, model: BagModel, *, text_col: str = "text", least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``score`` and ``offending``: start, end and score of the sentences that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, ddl = packed(docs.drop("score", "offending"), text_col, carry)
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                whole, parts = own.scores(text)
                scores.append(whole)
                spans.append([dict(zip(("start", "end", "score"), x)) for x in own.located(text, least)] if max(parts, default=0) >= least else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(struct))], ["row", "score", "offending"])

    return rows.mapInArrow(run, ddl + ", score double, offending array<struct<start: int, end: int, score: double>>").select("row.*", "score", "offending")


def train_and_score(docs: DataFrame, labels: DataFrame, *, fold: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for each row of ``docs`` (doc_id, text).

    Fitted on labelled rows whose crc32(doc_id as text) mod ``fold`` is not ``held``; ``held_out`` marks the others. A null
    label, a label that is not 0 or 1, or one without a document is not used. Null and empty texts have no sentences and
    score the leak alone. A null doc_id is never held out. Repeated rows are scored alike; an empty table gives an empty
    result.
    """
    own = docs.select("doc_id", "text")
    model = train(own, labels.where(crc_mod("doc_id", fold) != held), sample_rows=sample_rows)
    scored = score(own, model, carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
