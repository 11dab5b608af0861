"""Near-duplicate groups by SetSketch registers.

A text's set of word shingles is reduced to registers: each is the minimum of exponential variables over the set, kept as
the exponent of a base close to one and cut off at 16 bits. Registers of a union are the larger ones of the parts, and two
sets share a register with about the probability of their Jaccard similarity. Runs of registers are bands; texts that
share a band are candidates. Candidates' similarity is estimated by maximum likelihood from how often one register is
larger, smaller or equal, given both set sizes; what may reach the threshold is then confirmed on the full sets.

Texts with equal sets are one class, and only one text of a class goes on. In each bucket of a band all texts are first
held against one leader, which connects most of a large group by as many pairs as it has texts. What is left are buckets
whose texts (but the leader) lie in more than one component. There, the sketches outside the largest component are held
against all others, in cells of bounded size, and components with a likely link between them form a cluster. In each
cluster the texts outside its largest component meet all others once, again in cells of bounded size, which skip what has
become connected and give links only. So no link between different texts is lost but those whose texts share no band
(chance ``MISS``), while a group of copies never turns into all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import persisted
from marlstone.operators.graph import components

BASE = 1.001
RATE = 20.0
TOP = 65534
BAND_ROWS = 5
#: Chance that two texts at the threshold share no band.
MISS = 1e-7
#: Estimates further below the threshold than this many standard deviations are not confirmed.
SIGMAS = 5.5
CHUNK_SHINGLES = 60_000
#: Texts of one side of a cell.
CELL = 256
#: Class representatives whose ids are broadcast to fetch their texts; beyond, texts are joined by shuffling.
BROADCAST_IDS = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _WordHashes(dict):
    """64-bit hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int, hashes: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of fewer words, of all of them together."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return np.unique(out)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Register values, a row for each non-empty set."""
    if not sets:
        return np.zeros((0, m), dtype=np.uint16)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(20240229)
    salts, factors = rng.integers(0, 1 << 63, m, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64) | np.uint64(1)
    least = np.empty((m, len(sets)), dtype=np.uint64)
    for i in range(m):
        x = (flat ^ salts[i]) * factors[i]
        x ^= x >> np.uint64(31)
        least[i] = np.minimum.reduceat(x * np.uint64(0x9E3779B97F4A7C15), starts)
    u = (least.T.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(larger: np.ndarray, smaller: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity where ``larger`` of m registers of a exceed those of b and ``smaller`` fall short."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * (np.arange(1, 129) / 128)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * ((BASE - 1) / BASE)) / math.log(BASE)
    more, less = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
    value = larger[:, None] * np.log(more) + smaller[:, None] * np.log(less) + (m - larger - smaller)[:, None] * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), value.argmax(1)]


def reaches(more: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> np.ndarray:
    """Whether the estimate reaches ``floor``; pairs far below it by their equal registers alone are not estimated."""
    out = np.zeros(len(more), dtype=bool)
    near = np.flatnonzero((m - more - less) / m >= floor - 0.08)
    for part in np.array_split(near, max(1, -(-len(near) // 4096))):
        if len(part):
            out[part] = estimate(more[part], less[part], m, n_a[part], n_b[part]) >= floor
    return out


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def _floor(percent: int, m: int) -> float:
    s = percent / 100
    return s - SIGMAS * math.sqrt(s * (1 - s) / m)


def _sketches(docs: DataFrame, size: int, m: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1)
            start = 0
            while start < len(texts):
                sets, held, end = [], 0, start
                while end < len(texts) and held < CHUNK_SHINGLES:
                    sets.append(shingles(texts[end].as_py(), size, hashes))
                    held += len(sets[-1])
                    end += 1
                found = iter(registers([s for s in sets if len(s)], m))
                node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows = [next(found).astype("<u2").tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "n", "node", "registers"])
                start = end

    return docs.mapInArrow(run, f"doc_id {kind}, n long, node binary, registers binary")


def _bands(classes: DataFrame, bands: int) -> DataFrame:
    """bucket, node: a row for each band of each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            if nodes:
                r = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(len(nodes), bands, BAND_ROWS).astype(np.uint64)
                h = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(nodes), 1), dtype=np.uint64)
                for j in range(BAND_ROWS):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j] + np.uint64(1))
                for j in range(bands):
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, j].view(np.int64)), batch.column(0)], ["bucket", "node"])

    return classes.select("node", "registers").mapInArrow(run, "bucket long, node binary")


def _likely(pairs: DataFrame, m: int, floor: float) -> DataFrame:
    """Those of ``pairs`` (a, b, and n and registers of both) whose estimate reaches ``floor``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (np.array(batch.column(i).to_pylist()) for i in (0, 1, 2, 3))
            if not len(n_a):
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(len(n_a), m) for i in (4, 5))
            keep = reaches((ra > rb).sum(1), (ra < rb).sum(1), m, n_a.astype(float), n_b.astype(float), floor)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a binary, b binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked; neighbours in a task share the leader b."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, leader, own = _WordHashes(), None, None
        for batch in batches:
            keep = []
            b, text_a, text_b = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for i, node in enumerate(b):
                if node != leader:
                    leader, own = node, shingles(text_b[i].as_py(), size, hashes)
                keep.append(linked(shingles(text_a[i].as_py(), size, hashes), own, percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _celled(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """``rows`` (group, label, node, ...) dealt to cells (group, i, j): those outside the group's largest label to every
    cell of their block i as strays, all to every cell of their block j.

    A group of n rows with s strays takes about s * n / CELL**2 cells, so a bucket that many unlike texts share costs the
    product of both; five equal registers of 48 bands keep such buckets small.
    """
    parts = rows.groupBy(group, "label").agg(F.count("*").alias("k"))
    sizes = parts.groupBy(group).agg(F.count("*").alias("parts"), F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("largest")).where("parts > 1")
    sizes = persisted(sizes.select(group, F.col("largest.label").alias("largest"), (F.floor((F.col("size") - F.col("largest.k")) / CELL) + 1).alias("rows_"), (F.floor(F.col("size") / CELL) + 1).alias("columns_")))
    met = persisted(rows.join(sizes.hint("merge"), group).withColumn("h", F.xxhash64("node")))
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    others = met.select(group, "label", "node", F.lit(False).alias("stray"), F.pmod("h", "columns_").alias("j"), count("rows_").alias("i"), *columns)
    strays = met.where("label <> largest").select(group, "label", "node", F.lit(True).alias("stray"), F.pmod("h", "rows_").alias("i"), count("columns_").alias("j"), *columns)
    return others.unionByName(strays)


def _pairs_of(cell: pa.Table, percent: int, m: int, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each stray's row number with those of the others whose label differs and whose estimate reaches ``floor``."""
    stray, n = np.array(cell.column("stray").to_pylist(), dtype=bool), np.array(cell.column("n").to_pylist(), dtype=float)
    r = np.frombuffer(b"".join(cell.column("registers").to_pylist()), dtype="<u2").reshape(len(n), m)
    _, label = np.unique(np.array([x.hex() for x in cell.column("label").to_pylist()]), return_inverse=True)
    others = np.flatnonzero(~stray)
    for i in np.flatnonzero(stray).tolist():
        j = others[(label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        if len(j):
            j = j[reaches((r[i] > r[j]).sum(1), (r[i] < r[j]).sum(1), m, np.full(len(j), n[i]), n[j], floor)]
            if len(j):
                yield i, j


def _root(above: dict[bytes, bytes], x: bytes) -> bytes:
    """The label that stands for ``x``; labels on the way are pointed nearer to it."""
    while (y := above.get(x, x)) != x:
        above[x] = above.get(y, y)
        x = above[x]
    return x


def _likely_labels(cells: DataFrame, group: str, percent: int, m: int) -> DataFrame:
    """a, b: pairs of labels with a likely link between them, as many as connect what is so connected in each cell."""
    floor = _floor(percent, m)

    def run(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(groups))
        label, above = cell.column("label").to_pylist(), {}
        found = []
        for i, j in _pairs_of(cell, percent, m, floor):
            for k in j.tolist():
                a, b = _root(above, label[i]), _root(above, label[k])
                if a != b:
                    above[max(a, b)] = min(a, b)
                    found.append((label[i], label[k]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return cells.groupBy(group, "i", "j").applyInArrow(run, "a binary, b binary")


def _links(cells: DataFrame, group: str, size: int, percent: int, m: int) -> DataFrame:
    """a, b: pairs of labels with a link between them, as many as connect what is connected in each cell."""
    floor = _floor(percent, m)

    def run(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(groups))
        found = _cell_links(cell, list(_pairs_of(cell, percent, m, floor)), size, percent)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    return cells.groupBy(group, "i", "j").applyInArrow(run, "a binary, b binary")


def _cell_links(cell: pa.Table, pairs: list[tuple[int, np.ndarray]], size: int, percent: int) -> list[tuple[bytes, bytes]]:
    label, texts = cell.column("label").to_pylist(), cell.column("text")
    above: dict[bytes, bytes] = {}
    sets: dict[int, np.ndarray] = {}
    hashes, links = _WordHashes(), []

    def own(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i].as_py(), size, hashes)
        return sets[i]

    for i, others in pairs:
        for k in others.tolist():
            a, b = _root(above, label[i]), _root(above, label[k])
            if a != b and linked(own(i), own(k), percent):
                above[max(a, b)] = min(a, b)
                links.append((label[i], label[k]))
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate texts: doc_id, n_shingles, component_id, kept, and class_id (hex; texts with equal sets).

    A text's set is that of its runs of ``shingle_words`` words, A-Z lower-cased; with fewer words the whole sequence is
    one. Texts are linked when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id that links
    reach; ``kept`` marks its row.

    A text without words (null, empty, white space) has n_shingles 0, a null class and no links. A null doc_id is never
    the component's id unless all of it is null. Rows that repeat a doc_id and its text count as one text; each has its
    row in the result. An empty table gives an empty result. Other columns are not read.
    """
    bands = band_count(percent)
    m = bands * BAND_ROWS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = persisted(_sketches(rows, shingle_words, m))
    some = sketched.where("node is not null")
    classes = persisted(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers")))

    every = _bands(classes, bands)
    leaders = persisted(every.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node")).alias("first")).where("size > 1").select("bucket", F.col("first.node").alias("leader")))
    members = persisted(every.join(leaders.hint("merge"), "bucket").where("node <> leader"))
    stars = members.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    likely = persisted(_likely(stars.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").where(fits), m, _floor(percent, m)))

    def texts_of(nodes: DataFrame) -> DataFrame:
        """node, text of the classes in ``nodes``; a doc_id may be repeated with other texts, so the set decides."""
        wanted = persisted(classes.join(nodes.distinct(), "node").select("node", "rep"))
        few = wanted.count() <= BROADCAST_IDS
        found = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(wanted["rep"])).select("node", "text")
        return persisted(_same_set(found, shingle_words).groupBy("node").agg(F.min("text").alias("text")))

    in_pairs = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node")))
    edges = persisted(_confirmed(likely, texts_of(in_pairs), shingle_words, percent))
    labels = components(edges)

    content = classes.select("node", "n", "registers")
    labelled = members.select("bucket", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    likely_labels = persisted(_likely_labels(_celled(labelled, "bucket").join(content.hint("merge"), "node"), "bucket", percent, m).distinct())
    if not likely_labels.isEmpty():
        clusters = components(likely_labels).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
        named = persisted(classes.select("node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
        clustered = persisted(named.join(clusters.hint("merge"), "label"))
        full = content.join(texts_of(clustered.select("node")), "node")
        more = persisted(_links(_celled(clustered, "cluster").join(full, "node"), "cluster", shingle_words, percent, m))
        if not more.isEmpty():
            joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("joined"))
            labels = persisted(named.join(joined.hint("merge"), "label", "left").select("node", F.coalesce("joined", "label").alias("label")))

    grouped = classes.select("node", "rep").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = persisted(grouped.groupBy("label").agg(F.min("rep").alias("component_id")))
    of_class = grouped.join(ids.hint("merge"), "label").select("node", "component_id")
    out = sketched.select("doc_id", "n", "node").join(of_class, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.lower(F.hex("node")).alias("class_id"))


def _same_set(found: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            keep = [hashlib.blake2b(shingles(t.as_py(), size, hashes).tobytes(), digest_size=16).digest() == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(run, "node binary, text string")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g), len(g)),
x AS (SELECT rep, n, unnest(g) AS g FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS node, rep AS low FROM c UNION SELECT e2.b, r.low FROM r JOIN e2 ON r.node = e2.a WHERE r.low < e2.b),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
o AS (SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
      FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON c.rep = m.node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""
