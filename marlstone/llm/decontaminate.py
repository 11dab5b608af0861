"""Benchmark decontamination by winnowing.

The benchmark is read in blocks of a bounded number of words. A block's words get numbers, its windows of ten words and
its k-gram fingerprints (the minimum hash of every six consecutive 5-grams) go into sorted arrays, and one job over the
documents scans against them; no more than one block is broadcast at a time. Every span of ten shared words contains six consecutive 5-grams, so both sides keep the
same minimum and the span can't be missed. A shared fingerprint is extended to all windows around it, each confirmed
word by word. Items of fewer than ten words are one window of their own length and are looked up directly.

Words that no item of the block has can't be in a window, so a document is only ever a sequence of word numbers and zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import packed, persisted, whole_text

WINDOW = 10
GRAM = 5
#: A block of the benchmark that one pass looks for.
BLOCK_WORDS = 2_000_000
#: Text that is worked on at once in a task.
CHUNK_BYTES = 4_000_000
_TO_WORDS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.encode().translate(_TO_WORDS).split() if text else []


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, n]).integers(1 << 32, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hash(mixed: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    for j, f in enumerate(_factors(n, seed)):
        out += mixed[starts + j] * f
    return out ^ (out >> np.uint64(31))


def _full_starts(ids: np.ndarray, n: int) -> np.ndarray:
    """Starts of n consecutive words that the block has."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.int64)
    count = np.concatenate([[0], np.cumsum(ids > 0)])
    return np.flatnonzero(count[n:] - count[:-n] == n)


def winnow(mixed: np.ndarray, windows: np.ndarray, gram: int = GRAM, window: int = WINDOW, seed: int = 0) -> np.ndarray:
    """Positions of the k-grams that are the minimum (the last of equal ones) of a window that starts in ``windows``."""
    if not len(windows):
        return windows
    span = window - gram + 1
    best, at = None, None
    for j in range(span):
        h = _gram_hash(mixed, windows + j, gram, seed)
        if best is None:
            best, at = h, np.zeros(len(windows), dtype=np.int64)
        else:
            low = h <= best
            best, at = np.where(low, h, best), np.where(low, j, at)
    return np.unique(windows + at)


class BenchmarkBlock:
    """Sorted arrays of one block's windows and fingerprints."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(self.names)}
        self.number: dict[bytes, int] = {}
        rows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, words in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], dtype=np.int32)
            n = min(len(ids), WINDOW)
            if n:
                rows.setdefault(n, []).append((rank[name], np.lib.stride_tricks.sliding_window_view(ids, n)))
        self.tables = {n: self._table(n, [g for _, g in found], [np.full(len(g), r) for r, g in found]) for n, found in sorted(rows.items())}
        self.prints = np.zeros(0, dtype=np.uint64)
        if WINDOW in self.tables:
            grams = self.tables[WINDOW]["words"]
            flat = np.concatenate([grams, np.zeros((len(grams), 1), dtype=grams.dtype)], axis=1).ravel()
            mixed = _mixed(flat)
            self.prints = np.unique(_gram_hash(mixed, winnow(mixed, np.arange(len(grams)) * (WINDOW + 1)), GRAM, 0))

    @staticmethod
    def _table(n: int, grams: list[np.ndarray], owners: list[np.ndarray]) -> dict:
        words, window = np.unique(np.concatenate(grams), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([window.ravel(), np.concatenate(owners)], axis=1), axis=0)
        starts, seed = np.arange(len(words)) * n, 1
        while len(np.unique(hashes := _gram_hash(_mixed(words.ravel()), starts, n, seed))) < len(words):
            seed += 1
        order = np.argsort(hashes)
        return {"seed": seed, "hashes": hashes[order], "order": order, "words": words, "first": np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), "owners": pairs[:, 1]}

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[np.ndarray]]:
        """For each text: number of words, hit word ranges [start, end), ranks of the items with windows in it."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        at = 0
        for words in split:
            ids[at : at + len(words)] = np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.int64, count=len(words))
            at += len(words) + 1
        mixed, cover, found = _mixed(ids), np.zeros(len(ids) + 1, dtype=np.int64), []
        for n, table in self.tables.items():
            starts = _full_starts(ids, n)
            if n == WINDOW:
                seeds = winnow(mixed, starts)
                seeds = seeds[np.isin(_gram_hash(mixed, seeds, GRAM, 0), self.prints)]
                around = np.unique((seeds[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
                starts = np.intersect1d(around, starts, assume_unique=True)
            if not len(starts):
                continue
            hashes = _gram_hash(mixed, starts, n, table["seed"])
            place = np.minimum(np.searchsorted(table["hashes"], hashes), len(table["hashes"]) - 1)
            same = table["hashes"][place] == hashes
            starts, window = starts[same], table["order"][place[same]]
            same = (ids[starts[:, None] + np.arange(n)] == table["words"][window]).all(axis=1)
            starts, window = starts[same], window[same]
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + n, -1)
            seen = np.unique(np.stack([np.searchsorted(ends, starts, side="right"), window], axis=1), axis=0)
            first, many = table["first"][seen[:, 1]], table["first"][seen[:, 1] + 1] - table["first"][seen[:, 1]]
            flat = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(seen) else np.zeros(0, dtype=np.int64)
            found.append(np.stack([np.repeat(seen[:, 0], many), table["owners"][flat]], axis=1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])))
        for text, a, b in zip(np.searchsorted(ends, edges[::2], side="right").tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            first = int(ends[text] - 1 - sizes[text])
            spans[text].append((a - first, b - first))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        cut = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        return sizes, spans, [pairs[a:b, 1] for a, b in zip(cut, cut[1:])]


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[BenchmarkBlock]:
    """Indexes of at most ``block_words`` words each, unless one item has more."""
    held, n = [], 0
    for name, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        words = words_of(text)
        if held and n + len(words) > block_words:
            yield BenchmarkBlock(held)
            held, n = [], 0
        if words:
            held.append((name, words))
            n += len(words)
    yield BenchmarkBlock(held)


def _chunks(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text or "")
        if n >= limit:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _digest(names: Iterable[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of each document that lie in a benchmark window: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A window is ten consecutive words of an item; an item of one to nine words is one window. ``items`` lists the ids of
    items with a window in the document, sorted as strings; ``items_sha256`` is the SHA-256 of them joined by commas.
    Columns of ``docs`` that ``carry`` names come along as the struct ``row``.

    Null and empty texts have no words and no hits; an item without words has no window; a null item id counts as an empty
    string. Rows are judged one by one, so repeated rows come out as often. An empty benchmark leaves every row clean.
    If the benchmark takes more than one block, documents are scanned once for each block, in one job after the other; the
    hit ranges of each text are written and united. Items of several blocks and equal texts are told apart by digests of the texts.
    """
    every = blocks(benchmark, block_words=block_words)
    first, second = next(every), next(every, None)
    rows, ddl = packed(docs, text_col, [id_col] if carry is None else carry)
    if second is None:
        found = _scanned(rows, ddl, first, whole=True)
    else:
        # hits of one block after the other, by text; then all texts meet the hits of all blocks
        digest = F.md5(whole_text("text"))
        texts = rows.select(digest.alias("row"), "text")
        hits = [persisted(_scanned(texts, "row string", block, whole=False).dropDuplicates(["row"])) for block in chain([first, second], every)]
        united = reduce(DataFrame.unionByName, hits).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        met = rows.withColumn("__digest", digest).join(persisted(united.withColumnRenamed("row", "__of")), F.col("__digest") == F.col("__of"), "left")
        found = met.select("row", _n_words(F.col("text")).alias("n_words"), _covered(F.col("spans")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.select(F.col("row")[id_col].alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "row")


def _scanned(rows: DataFrame, ddl: str, block: BenchmarkBlock, *, whole: bool) -> DataFrame:
    """``row`` of each text with n_words, n_hit and items, if ``whole``; else ``row``, spans and items of the texts that are hit."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                n_words, spans, ranks = own.scan(texts[a:b])
                items = pa.array([[own.names[r] for r in x.tolist()] for x in ranks], pa.list_(pa.string()))
                part = batch.column(0).slice(a, b - a)
                if whole:
                    yield pa.RecordBatch.from_arrays([part, pa.array(n_words, pa.int64()), pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()), items], ["row", "n_words", "n_hit", "items"])
                else:
                    cut = pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], pa.list_(span))
                    yield pa.RecordBatch.from_arrays([part, cut, items], ["row", "spans", "items"]).filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return rows.select("row", "text").mapInArrow(scan, ddl + (", n_words long, n_hit long, items array<string>" if whole else ", spans array<struct<start:int,stop:int>>, items array<string>"))


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")


def _covered(spans: Column) -> Column:
    """Positions that lie in any of the ranges; 0 for null."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["stop"]).alias("end"), (acc["n"] + F.greatest(s["stop"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))
    return F.coalesce(F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"]), F.lit(0).cast("long"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (
  SELECT item, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 8, 2))) AS i, w FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT size FROM bg),
dw AS (SELECT n, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
hits AS (
  SELECT n, i, bg.size, item FROM (SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM dw) x JOIN bg USING (size, g)),
words AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT n, i, size FROM hits)) GROUP BY n),
items AS (SELECT n, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT n, item FROM hits) GROUP BY n)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""
