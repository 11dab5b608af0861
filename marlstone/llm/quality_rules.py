"""Quality rules by distribution divergence.

Each language has two references, summed over all its documents that pass the base rules and are long enough: a histogram
of character classes, and one of its common words (every word with at least ``1 / SHARE`` of the language's words, so at
most ``SHARE`` of them) with one bin for all other words. A document fails if the Jensen-Shannon distance (base 2, 0 to 1)
of its own histogram to the reference is over ``base + slack / sqrt(size)``: the second term is what chance alone does to a
histogram of that size. Minimum lengths guard both tests, and a language whose reference is small has none.

References are counted on the executors and summed before the shuffle. They meet the documents in a join by language,
where Spark checks the size of the side before it broadcasts it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import whole_text
from marlstone.storage import written_table

#: Words of a document, at least, before it counts for its language's reference.
REFERENCE_WORDS = 50
#: A word is common if it is one of ``SHARE`` words of the language or more.
SHARE = 200
#: Words in a language's reference, at least; below, its documents are judged by the base rules alone.
LEAST_REFERENCE = 2000
#: Code points and words of a document, at least, for the tests of classes and of words.
LEAST_CHARS, LEAST_WORDS = 200, 50
CLASS_LIMIT, WORD_LIMIT = (0.15, 3.0), (0.1, 2.2)
#: Rows of counts that a task holds before it hands them on.
HELD_COUNTS = 200_000
CLASSES = 7
_PROSE = b".,;:!?'\"()-"
#: lower, upper, digit, white space, prose punctuation, other ASCII, not ASCII; 7 for the bytes that continue a code point.
_CLASS = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c == 32 or 9 <= c <= 13 else 4 if c in _PROSE else 5 if c < 128 else 7 if c < 192 else 6 for c in range(256)])
_SYMBOL = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, width = ids, 1
    while width < size:  # numbers of windows of doubling width, the last step overlapping
        step = min(width, size - width)
        pairs = key[: len(words) - width - step + 1] * len(words) + key[step : len(words) - width + 1]
        _, key = np.unique(pairs, return_inverse=True)
        width += step
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[size : size + n] -= again
    return int((np.cumsum(edge) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histogram of character classes."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=seen, minlength=CLASSES + 1)[:CLASSES].astype(np.int64)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), int(classes.sum() - classes[3]), int(seen[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words), classes


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def letters(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of bytes beyond ASCII."""
    return text.translate(_LETTERS).split()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    terms = (p[p > 0] * np.log2(p[p > 0] / m[p > 0])).sum() + (q[q > 0] * np.log2(q[q > 0] / m[q > 0])).sum()
    return math.sqrt(max(0.0, terms / 2))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, n: words by key, classes by their number in key ``\\x00k``."""
    words: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            n, _, _, _, repeats, classes = measures(text)
            if n >= REFERENCE_WORDS and not base_fails(n, repeats):
                own = words[lang]
                own.update(letters(text))
                own.update({b"\x00%d" % k: int(c) for k, c in enumerate(classes) if c})
                if sum(map(len, words.values())) >= HELD_COUNTS:
                    yield out()
    if words:
        yield out()


def references(rows: DataFrame) -> DataFrame:
    """lang, classes, words (array of word and n), total of each language with a reference; ``rows`` has lang and text (binary)."""
    counts = written_table(rows.select("lang", "text").mapInArrow(_counted, "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    is_class = F.substring("key", 1, 1) == F.lit(b"\x00")
    totals = written_table(counts.groupBy("lang").agg(F.sum(F.when(~is_class, F.col("n"))).alias("total")).where(F.col("total") >= LEAST_REFERENCE))
    common = counts.join(totals, "lang").where(is_class | (F.col("n") * SHARE >= F.col("total")))
    return common.groupBy("lang").agg(F.sort_array(F.collect_list(F.when(is_class, F.struct("key", "n")))).alias("classes"), F.sort_array(F.collect_list(F.when(~is_class, F.struct("key", "n")))).alias("words"), F.first("total").alias("total"))


class Reference:
    def __init__(self, ref: dict):
        self.classes = np.zeros(CLASSES)
        for x in ref["classes"]:
            self.classes[int(x["key"][1:])] = x["n"]
        self.number = {x["key"]: i for i, x in enumerate(ref["words"])}
        self.words = np.array([*(x["n"] for x in ref["words"]), ref["total"] - sum(x["n"] for x in ref["words"])], float)

    def distances(self, text: bytes, classes: np.ndarray) -> tuple[float | None, int, float | None, int]:
        """Distance and size of classes and of words; a distance is null for a text below its least length."""
        chars = int(classes.sum())
        own = letters(text)
        of_words = None
        if len(own) >= LEAST_WORDS:
            seen, last = Counter(own), len(self.number)
            counts = np.zeros(last + 1)
            for w, i in self.number.items():
                counts[i] = seen.get(w, 0)
            counts[last] = len(own) - counts.sum()
            of_words = distance(counts, self.words)
        return distance(classes, self.classes) if chars >= LEAST_CHARS else None, chars, of_words, len(own)


def _over(x: float | None, size: int, limit: tuple[float, float]) -> bool:
    return x is not None and x > limit[0] + limit[1] / math.sqrt(size)


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Reference | None] = {}
    for batch in batches:
        found = []
        for lang, text, ref in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("ref")):
            text = text.as_py()
            *base, classes = measures(text)
            if lang not in known:
                if len(known) >= 1000:
                    known.clear()
                known[lang] = Reference(ref.as_py()) if ref.is_valid else None
            a, chars, b, n = known[lang].distances(text, classes) if known[lang] else (None, 0, None, 0)
            failed = base_fails(base[0], base[4])
            found.append((*base, failed, a, b, not (failed or _over(a, chars, CLASS_LIMIT) or _over(b, n, WORD_LIMIT))))
        columns = list(zip(*found)) if found else [()] * 9
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["row", *OUT])


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def quality_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``, null: all of them, as a struct) with the document's measures and verdict.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``), n_dup_lines (lines with a word, equal to an earlier
    one), n_repeat_words (words in five-word windows that the text has twice or more): long. base_failed: under ten words, or
    over a fifth of them repeated. class_distance and word_distance are null below the least lengths and without a reference.
    kept: not base_failed and neither distance over its limit.

    A null text is empty: no words, base_failed. A null language is ``und``. Repeated rows each get a result and each count
    for the reference. Texts of any length are read whole; a task holds one at a time. An empty table gives an empty result.
    Columns of ``docs`` may have any names, they stay within ``row``.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), lang.alias("lang"), whole_text(F.col(f"`{text_col}`")).cast("binary").alias("text"))
    ddl = f"row {rows.schema['row'].dataType.simpleString()}"
    refs = written_table(references(rows)).select("lang", F.struct("classes", "words", "total").alias("ref"))
    kinds = ", ".join(f"{c} {t}" for c, t in zip(OUT, ["long"] * 5 + ["boolean", "double", "double", "boolean"]))
    return rows.join(refs, "lang", "left").select("row", "lang", "text", "ref").mapInArrow(_judged, f"{ddl}, {kinds}")


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, word, pos FROM (
    SELECT id, unnest(l) AS word, unnest(range(len(l))) AS pos
    FROM (SELECT id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM t))),
gram AS (SELECT id, pos, concat_ws(chr(0), word, lead(word, 1) OVER q, lead(word, 2) OVER q, lead(word, 3) OVER q, lead(word, 4) OVER q) AS g, lead(word, 4) OVER q AS last FROM w WINDOW q AS (PARTITION BY id ORDER BY pos)),
twice AS (SELECT id, pos FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS n FROM gram WHERE last IS NOT NULL) WHERE n >= 2),
rep AS (SELECT id, count(DISTINCT pos + d) AS n_repeat_words FROM twice, range(5) r(d) GROUP BY id),
wn AS (SELECT id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY id),
ln AS (
  SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
m AS (
  SELECT id, doc_id, lang, text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN wn USING (id) LEFT JOIN ln USING (id) LEFT JOIN rep USING (id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
cls AS (
  SELECT id, lang, n_words >= 50 AND NOT base_failed AS refers, unnest(range(7)) AS k, unnest([
    length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
    length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[^.,;:!?''"()\-]', '', 'g')),
    length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F#$%&*+/<=>@\[\\\]\^_`{|}~\x7F]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))]) AS n FROM b),
lw AS (
  SELECT id, lang, n_words >= 50 AND NOT base_failed AS refers, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM b),
lwn AS (SELECT lang, word, count(*) AS n FROM lw WHERE refers GROUP BY lang, word),
total AS (SELECT lang, sum(n) AS total FROM lwn GROUP BY lang HAVING sum(n) >= 2000),
common AS (SELECT lang, word, n::DOUBLE / total AS q FROM lwn JOIN total USING (lang) WHERE n * 200 >= total),
refs AS (
  SELECT lang, word, q FROM common
  UNION ALL SELECT lang, '', 1 - coalesce(sum(q), 0) FROM total LEFT JOIN common USING (lang) GROUP BY lang),
size AS (SELECT id, lang, count(*) AS size FROM lw GROUP BY id, lang),
known AS (SELECT id, lang, CASE WHEN word IN (SELECT word FROM common c WHERE c.lang = lw.lang) THEN word ELSE '' END AS word, count(*) AS n FROM lw GROUP BY ALL),
dw AS (
  SELECT s.id, max(s.size) AS size, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
  FROM (SELECT s.id, s.size, r.q, coalesce(k.n, 0)::DOUBLE / s.size AS p FROM size s JOIN refs r USING (lang) LEFT JOIN known k ON k.id = s.id AND k.word = r.word WHERE s.size >= 50) s GROUP BY s.id),
cref AS (SELECT lang, k, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls JOIN total USING (lang) WHERE refers GROUP BY lang, k),
dc AS (
  SELECT id, max(size) AS size, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d
  FROM (SELECT c.id, q, n::DOUBLE / sum(n) OVER (PARTITION BY c.id) AS p, sum(n) OVER (PARTITION BY c.id) AS size FROM cls c JOIN cref USING (lang, k)) WHERE size >= 200 GROUP BY id)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR coalesce(sqrt(greatest(dc.d, 0)) > 0.15 + 3 / sqrt(dc.size), false) OR coalesce(sqrt(greatest(dw.d, 0)) > 0.1 + 2.2 / sqrt(dw.size), false)) AS kept
FROM b LEFT JOIN dc USING (id) LEFT JOIN dw USING (id)
"""
