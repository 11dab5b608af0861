"""Phrase collocation mining by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. One scan counts phrases of every length at the same time: words
from the first scan on, a longer phrase from the scan on at which both phrases that it consists of (all words but the last,
all but the first) have reached the threshold in the shards counted so far. A phrase is complete after one full cycle from
where it began, and the scans end when nothing new has become active for a cycle. So most phrases of all lengths are
counted within little more than one pass, and a shard is never counted twice for a phrase.

Which phrases are active is told to the scans by one filter a length: a bit for the hash of each active phrase, in a bit map
of a fixed size that is built on the executors. It has no misses; a false hit makes a scan count a phrase too early, which is
another phrase counted in full: a scan counts what passes the present filters and did not pass those of the shard's
scan before, and bits are only ever added. Counts are summed in Arrow batches, in each task, and by a shuffle; nothing else
of the corpus leaves the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import whole_text
from marlstone.storage import shared_dir

#: Words of the longest phrases, least occurrences of a phrase, shards, phrases of a language that are returned.
LONGEST, LEAST, SHARDS, TOP = 3, 10, 2, 2000
#: Bits of a filter: 4 MB. More active phrases than bits make the scans count more, not wrongly.
FILTER_BITS = 1 << 25
#: A longer candidate with this share (percent) of a candidate's occurrences takes its place.
COVERED_PERCENT = 50
SCALE = 1_000_000
#: Bytes of text that a task counts at once.
FLUSH_BYTES = 5 << 20
_SEGMENT = 1 << 15
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands between pieces. No word holds a capital letter after lower-casing.
_END = b"A"

Filters = dict[int, bytes]


def tokens(text: bytes) -> list[bytes]:
    """Words of a text from ``_chunks``, ``_END`` between pieces."""
    return text.replace(b"\n", b" A ").split()


def _chunks(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of at most ``most`` bytes and up to the end of a piece."""
    text, begin = text.translate(_TABLE), 0
    while begin < len(text):
        end = text.find(b"\n", begin + most)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end


def _passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(hashes), bool)
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (np.frombuffer(bits, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def word_hashes(prefix: bytes, words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(prefix + w) for w in words), np.uint64, len(words))


def longer_hashes(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last and of the last."""
    x = shorter * np.uint64(0x9E3779B97F4A7C15) + last
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def count_phrases(lang: str, words: list[bytes], longest: int, with_words: bool, now: Filters, before: Filters) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """size, phrases, counts: words if wanted, and the longer phrases that pass ``now`` and did not pass ``before``. ``words`` is emptied."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    words.clear()
    key, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    del coded
    key[key == next((i for i, w in enumerate(vocabulary) if w == _END), -1)] = -1
    if with_words:
        n = np.bincount(key[key >= 0], minlength=len(vocabulary))
        at = np.flatnonzero(n)
        yield 1, [vocabulary[i] for i in at], n[at]
    if not now.get(1):
        return
    own = word_hashes(lang.encode() + b"\t", vocabulary)
    # of the phrase that begins at each place: its hash, whether it is active now, and whether it was before
    h, real = own[key], key >= 0
    active, old = real & _passes(now[1], own)[key], real & _passes(before.get(1, b""), own)[key]
    for size in range(2, longest + 1):
        both, done = active[:-1] & active[1:], old[:-1] & old[1:]
        at = np.flatnonzero(both & ~done)
        if len(at):
            yield size, *_distinct(key, vocabulary, at, size)
        if size == longest or not now.get(size):
            return
        h = longer_hashes(h[:-1], own[key[size - 1 :]])
        active, old = both & _passes(now[size], h), done & _passes(before.get(size, b""), h)


def _distinct(key: np.ndarray, vocabulary: list[bytes], at: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray]:
    """The different phrases of ``size`` words that begin at the places ``at``, and how often each does."""
    code = key[at]
    for j in range(1, size):
        _, first, code, n = np.unique(code * len(vocabulary) + key[at + j], return_index=True, return_inverse=True, return_counts=True)
    begin = at[first]
    return [b" ".join(words) for words in zip(*([vocabulary[i] for i in key[begin + j].tolist()] for j in range(size)))], n


def _scan(shared, longest: int, with_words: bool, flush: int):
    """Texts of one shard to size, key (language, tab, phrase), n."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = shared.value
        held: dict[str, list[bytes]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                for k, phrases, n in count_phrases(lang, words, longest, with_words, now, before):
                    prefix = lang.encode() + b"\t"
                    columns = [pa.array(np.full(len(phrases), k, np.int8)), pa.array([prefix + p for p in phrases], pa.binary()).view(pa.string()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["size", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in _chunks(text.as_py(), flush):
                    held.setdefault(lang, []).extend((*tokens(part), _END))
                    size += len(part)
                    if size >= flush:
                        yield from out()
                        size = 0
        yield from out()

    return scan


class _Folder:
    """Tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/collocations-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        conf, writers = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        held = conf.get(writers)
        conf.set(writers, "16")  # the few folders of a table are written side by side, not after a sort
        try:
            df.write.partitionBy(*by).parquet(f"{self.path}/{name}")
        finally:
            conf.set(writers, held)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _places(bits: int):
    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """segment, at: the bits of phrases, given as keys."""
        for batch in batches:
            at = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(batch.column("key").to_pylist()):
                head, _, phrase = key.rpartition(b"\t")
                each = word_hashes(head + b"\t", phrase.split(b" "))
                h = each[:1]
                for k in range(1, len(each)):
                    h = longer_hashes(h, each[k : k + 1])
                at[i] = int(h[0]) & (bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at // _SEGMENT).astype(np.int32)), pa.array(at % _SEGMENT)], ["segment", "at"])

    return places


def _filter(totals: DataFrame, least: int, bits: int) -> bytes:
    """The bits of all phrases with ``least`` occurrences: at most ``bits / 8`` bytes come to the driver."""
    told = totals.where(F.col("n") >= least).select(F.col("key").cast("binary").alias("key")).mapInArrow(_places(bits), "segment int, at long")
    found = told.repartition("segment").groupBy("segment").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = bytearray(bits // 8)
    for r in found:
        out[r["segment"] * (_SEGMENT // 8) : (r["segment"] + 1) * (_SEGMENT // 8)] = r["bits"]
    return bytes(out) if found else b""


def counted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS, filter_bits: int = FILTER_BITS, flush: int = FLUSH_BYTES) -> dict[int, DataFrame]:
    """By number of words: key (language, tab, phrase), n. All words are counted, and every longer phrase with ``least`` occurrences (and some others)."""
    spark = docs.sparkSession
    if filter_bits < _SEGMENT or filter_bits & (filter_bits - 1):
        raise ValueError(f"filter_bits must be a power of two, {_SEGMENT} at least")
    folder = _Folder(spark)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), whole_text(F.col(f"`{text_col}`")).cast("binary").alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    corpus = folder.write(rows, "shards", "shard")
    totals: dict[int, tuple[int, DataFrame]] = {}  # by length: the step that summed it up last, and its counts
    last: list[DataFrame] = []
    history: list[Filters] = []
    now: Filters = {}
    step = 0
    while True:
        before = history[step - shards] if step >= shards else {}
        sizes = [k for k in range(1, longest + 1) if (step < shards if k == 1 else now.get(k - 1, b"") != before.get(k - 1, b""))]
        if not sizes:
            break
        shared = spark.sparkContext.broadcast((now, before))
        found = corpus.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(_scan(shared, max(sizes), 1 in sizes, flush), "size byte, key string, n long")
        for k in sizes:  # counts so far are summed with the new ones, in the same shuffle
            if k in totals:
                found = found.unionByName(totals[k][1].select(F.lit(k).cast("byte").alias("size"), "key", "n"))
        summed = folder.write(found.groupBy("size", "key").agg(F.sum("n").alias("n")), f"step-{step}", "size")
        shared.unpersist()
        history.append(now)
        now = dict(now)
        for k in sizes:
            own = summed.where(F.col("size") == k).select("key", "n")
            if k == longest:
                last.append(own)
                continue
            if k in totals:
                folder.drop(f"step-{totals[k][0]}/size={k}")
            totals[k] = (step, own)
            now[k] = _filter(own, least, filter_bits)
        step += 1
    none = spark.createDataFrame([], "key string, n long")
    out = {k: totals[k][1] if k in totals else none for k in range(1, longest)}
    out[longest] = none
    for own in last:
        out[longest] = out[longest].unionByName(own)
    out[longest] = out[longest].groupBy("key").agg(F.sum("n").alias("n"))
    return out


def _told(counts: DataFrame) -> DataFrame:
    """lang, phrase, n. A phrase has no tab, a language may."""
    phrase = F.substring_index("key", "\t", -1)
    return counts.select(F.left("key", F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "n")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two to ``longest`` words.

    Pieces end at ``[.,;:!?]`` and line ends, words at spaces and tabs; A-Z count as a-z. a, l and r are the occurrences of the
    phrase, and of the two parts of the cut at which floor(1000000 a a / (l r)) is lowest (the earliest of equal ones), which
    is the score; n is the number of the language's words. Phrases have ``least`` occurrences or more; one goes if a longer one
    that contains it has half of its occurrences or more. Ranks go by score, then a, descending, then by the phrase's UTF-8 bytes.

    A null text is empty, a null language is ``und``. Repeated rows count again. Texts of any length are read whole, in
    parts that end with a piece. An empty table gives an empty result. Other columns of ``docs`` may have any names.
    """
    counts = counted(docs, text_col=text_col, lang_col=lang_col, longest=longest, least=least, shards=shards, filter_bits=filter_bits)
    folder = _Folder(docs.sparkSession)
    enough = [_told(counts[k].where(F.col("n") >= least)).withColumn("size", F.lit(k)) for k in counts]
    frequent = enough[0]
    for x in enough[1:]:
        frequent = frequent.unionByName(x)
    frequent = folder.write(frequent, "frequent")
    words = folder.write(_told(counts[1]).groupBy("lang").agg(F.sum("n").alias("n")), "words")
    candidates = frequent.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("w"))
    text = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(F.struct((2 * k).alias("k"), text(F.lit(1), k).alias("part")), F.struct((2 * k + 1).alias("k"), text(k + 1, F.col("size") - k).alias("part")))))
    asked = candidates.select("lang", "phrase", "a", "size", F.explode(parts).alias("x")).select("lang", "phrase", "a", "size", "x.k", F.col("x.part").alias("part"))
    met = asked.join(frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    whole = met.groupBy("lang", "phrase", "a", "size").agg(F.map_from_entries(F.collect_list(F.struct("k", "f"))).alias("f"))
    scored = lambda k: F.expr(f"cast({SCALE} * cast(a as decimal(19,0)) * cast(a as decimal(19,0)) as decimal(38,0)) div (cast(f[{2 * k}] as decimal(19,0)) * cast(f[{2 * k + 1}] as decimal(19,0)))")
    cuts = F.array(*[F.when(F.col("size") > k, F.struct(scored(k).alias("score"), F.lit(k).alias("k"), F.element_at("f", 2 * k).alias("l"), F.element_at("f", 2 * k + 1).alias("r"))) for k in range(1, longest)])
    least_cut = whole.select("lang", "phrase", "a", F.array_min(F.array_compact(cuts)).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: text(i, k))))
    covers = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = least_cut.join(covers, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < COVERED_PERCENT * F.col("a"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    first = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT id, lang, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM (SELECT id, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS l FROM t)),
pw AS (SELECT id, lang, pos, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS l FROM p),
w AS (SELECT id, lang, pos, unnest(l) AS word, unnest(range(len(l))) AS i FROM pw),
g AS (SELECT lang, word AS w1, lead(word, 1) OVER q AS w2, lead(word, 2) OVER q AS w3 FROM w WINDOW q AS (PARTITION BY id, pos ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cut AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 z WHERE z.lang = c.lang AND 100 * z.f >= 50 * c.f AND (z.w1 = c.w1 AND z.w2 = c.w2 OR z.w2 = c.w1 AND z.w3 = c.w2))
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 1
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, x.f, y.f, 2
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o
                 FROM (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut)) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000
"""
