"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few dozen shape features. Each feature is cut into quantile bins. Boosting goes round the features in
turn; a step fits a shallow tree to one feature's gradient histogram and adds its leaves to that feature's lookup table.
Pairs that explain most of what is left are then boosted the same way into two-way tables. A score is a sum of table
entries through a logistic function, looked up for a whole batch at once.

The model is fitted on the driver from a bounded sample of labelled rows; only their features are gathered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import crc_mod, packed, whole_text

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS = 48
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 250
RATE = 0.08
LEAVES = 4
_SYMBOLS = b"#$%&*@^~_+=\\"
_CODE = b"{}<>[]();"
FEATURES = (
    "chars", "words", "lines", "word_length", "lower", "upper", "digit", "space", "symbol", "code", "pipe", "exclaim", "stop", "comma", "beyond_ascii",
    "caps_words", "symbol_words", "distinct_words", "top_word", "top_pair", "distinct_pairs", "repeated_lines", "line_length", "short_lines", "ended_lines", "long_words", "entropy",
)


def features(text: str | None) -> list[float]:
    """Shape of one text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n_words = max(1, len(words))
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    n_lines = max(1, len(lines))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lower, upper, digit = n[97:123].sum(), n[65:91].sum(), n[48:58].sum()
    share = n[n > 0] / size
    of = lambda chars: n[np.frombuffer(chars, dtype=np.uint8)].sum() / size
    caps = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    odd = sum(c for w, c in counts.items() if not w.isalnum() and w.rstrip(".,;:!?\"')").lstrip("\"'(").isalnum() is False)
    return [
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), min(50.0, len(text) / n_words), lower / size, upper / size, digit / size, (n[32] + n[9] + n[10]) / size,
        of(_SYMBOLS), of(_CODE), n[124] / size, n[33] / size, (n[46] + n[63]) / size, n[44] / size, n[128:].sum() / size,
        caps / n_words, odd / n_words, len(counts) / n_words ** 0.8, max(counts.values(), default=0) / n_words, max(pairs.values(), default=0) / n_words, len(pairs) / n_words,
        1 - len(set(lines)) / n_lines, np.log1p(len(text) / n_lines), sum(len(x) < 30 for x in lines) / n_lines, sum(x[-1] in ".!?\"'" for x in lines) / n_lines,
        sum(c for w, c in counts.items() if len(w) > 15) / n_words, float(-(share * np.log2(share)).sum()),
    ]


def _leaves(gradient: np.ndarray, hessian: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree of few leaves over ordered bins, grown best split first; the step for each bin."""
    cuts = [(0, len(gradient))]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) < leaves:
        best = (1e-9, None, 0)
        for a, b in cuts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = (g[at] - g[a]) ** 2 / (h[at] - h[a] + ridge) + (g[b] - g[at]) ** 2 / (h[b] - h[at] + ridge) - gain(a, b)
                if won.max() > best[0]:
                    best = (won.max(), (a, b), int(at[won.argmax()]))
        if best[1] is None:
            break
        cuts.remove(best[1])
        cuts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in cuts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _two_way(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A cut of each of two features: four leaves; the step for each cell and the gain."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    total, best = g[-1, -1] ** 2 / (h[-1, -1] + ridge), (-1.0, 0, 0)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(g[i, j], h[i, j]), (g[i, -1] - g[i, j], h[i, -1] - h[i, j]), (g[-1, j] - g[i, j], h[-1, j] - h[i, j]), (g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j])]
            won = sum(a * a / (b + ridge) for a, b in parts) - total
            if won > best[0]:
                best, steps = (won, i, j), [a / (b + ridge) for a, b in parts]
    out = np.zeros(gradient.shape)
    if best[0] > 0:
        _, i, j = best
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, best[0]


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, bias: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]):
        self.bias, self.cuts, self.tables, self.pairs = bias, cuts, tables, pairs

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, (cut, table_) in enumerate(zip(self.cuts, self.tables)):
            out += table_[np.searchsorted(cut, x[:, f], side="right")]
        for a, b, cut_a, cut_b, table_ in self.pairs:
            out += table_[np.searchsorted(cut_a, x[:, a], side="right"), np.searchsorted(cut_b, x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, rate: float = RATE, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs with the largest gain. Without rows the score is 0.5."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if not 0 < y.sum() < len(y):
        return AdditiveModel(bias, cuts, tables, [])
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    z = np.full(len(y), bias)
    for _ in range(rounds):
        for f, own in enumerate(bins):
            p = _sigmoid(z)
            step = rate * _leaves(np.bincount(own, y - p, len(tables[f])), np.bincount(own, p * (1 - p), len(tables[f])), LEAVES, ridge)
            tables[f] += step
            z += step[own]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def histogram(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell, p = cells[a] * shape[1] + cells[b], _sigmoid(z)
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), cell

    gains = sorted(((-_two_way(*histogram(a, b)[:2], ridge)[1], a, b) for a in range(len(cuts)) for b in range(a)), key=lambda g: g)
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains[:PAIRS]]
    for _ in range(rounds // 10):
        for a, b, table_ in chosen:
            gradient, hessian, cell = histogram(a, b)
            step = rate * _two_way(gradient, hessian, ridge)[0]
            table_ += step
            z += step.ravel()[cell]
    return AdditiveModel(bias, cuts, tables, [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, text_col: str, id_col: str = "doc_id") -> DataFrame:
    """``__id``, ``__label`` and ``__text`` of labelled documents, at most ``sample_rows``: those whose ids have the smallest hashes.

    Only ids under a hash that lets through about ``sample_rows`` are sorted. Rows that repeat a labelled id count as one,
    with the smallest text, so that the bound holds for documents too.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label")).distinct()
    space, h = 1 << 40, F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    n = usable.count()
    near = usable.where(h < int(space * min(1.0, (sample_rows + 5 * sample_rows**0.5 + 5) / max(n, 1))))
    chosen = near.orderBy(h, "__id", "__label").limit(sample_rows)
    met = docs.select(F.col(id_col).alias("__key"), whole_text(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col("__id"))
    return met.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on the rows of ``labels``. ``sample_rows`` bounds what is fitted on and what the driver holds."""
    rows = labelled_sample(docs, labels, label, sample_rows, text_col, id_col)

    def shape(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "label", "x"])

    found = sorted((r["id"], r["label"], tuple(r["x"])) for r in rows.mapInArrow(shape, "id string, label int, x array<double>").collect())
    return fit(np.array([r[2] for r in found], dtype=float).reshape(-1, len(FEATURES)), np.array([r[1] for r in found], dtype=float))


def score(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", out_col: str = "score", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``out_col``, the probability of label 1, last, in place of one of that name.

    Null texts are scored as empty ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, ddl = packed(docs.drop(out_col), text_col, carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["row", "score"])

    return rows.mapInArrow(run, ddl + ", score double").select("row.*", F.col("score").alias(out_col))


def train_and_score(docs: DataFrame, labels: DataFrame, *, fold: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Fitted on labelled rows whose crc32(doc_id as text) mod ``fold`` is not ``held``; ``held_out`` marks the others. A null
    label, a label that is not 0 or 1, or one without a document is not used; a document labelled both ways counts twice, and one that
    repeats with other texts counts with the smallest.
    Without usable labels of both kinds the score is their smoothed share (0.5 without any). A null doc_id is never held
    out. Repeated rows are scored alike; an empty table gives an empty result.
    """
    own = docs.select("doc_id", "text")
    model = train(own, labels.where(crc_mod("doc_id", fold) != held), sample_rows=sample_rows)
    scored = score(own, model, carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
