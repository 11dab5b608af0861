"""Exact dedup with a cuckoo-filter index that keeps the live digests in buckets.

Each document is reduced to the SHA-256 of its normalised text inside the JVM. An index task takes the digests of one
hash shard. For each digest it asks the filter first: absent means new, so the digest goes in. A hit may be false, so it
is verified against the full digests kept for the slots of the two candidate buckets. The filter keeps 16 bits of
fingerprint a slot; when an insertion finds no place, the filter doubles and is refilled from the stored keys. Withdrawn
digests are deleted from it.

Only (digest, length, id, count) rows move. Every input task combines its own digests with the same index before the
shuffle, so a digest that a third of the corpus shares reaches its shard as one row for each input task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import persisted, whole_text

SLOTS = 4
MAX_KICKS = 200
#: Keys after which an input task hands its digests on; bounds its memory.
FLUSH_KEYS = 400_000
WHITE = " \t\n\x0b\x0c\r"
_SCHEMA = "digest binary, best_len int, best_id {kind}, n long"


class CuckooIndex:
    """Cuckoo filter (16-bit fingerprints, four slots a bucket) whose slots point at stored keys.

    ``add`` returns the entry number of the key, new or found; ``discard`` deletes a live key; ``find`` looks it up.
    Keys are byte strings of at least 16 evenly distributed bytes (digests).
    """

    def __init__(self, buckets: int = 256):
        self.keys: list[bytes | None] = []
        self.live = 0
        self.resizes = 0
        self.false_hits = 0
        self._build(buckets)

    def _build(self, buckets: int) -> None:
        self.buckets = buckets
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.entries = [-1] * (buckets * SLOTS)
        self.turn = 0

    def _place_of(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (((mark * 0x5BD1E995) >> 3) & self.mask)

    def _slot_of(self, key: bytes, mark: int, first: int, second: int) -> int:
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark:
                    if self.keys[self.entries[slot]] == key:
                        return slot
                    self.false_hits += 1
        return -1

    def find(self, key: bytes) -> int:
        """Entry number of a live key, else -1."""
        slot = self._slot_of(key, *self._place_of(key))
        return -1 if slot < 0 else self.entries[slot]

    def add(self, key: bytes) -> int:
        mark, first, second = self._place_of(key)
        slot = self._slot_of(key, mark, first, second)
        if slot >= 0:
            return self.entries[slot]
        entry = len(self.keys)
        self.keys.append(key)
        self.live += 1
        if not self._put(entry, mark, first, second):
            self._grow()
        return entry

    def discard(self, key: bytes) -> bool:
        """Delete a live key; whether it was there."""
        slot = self._slot_of(key, *self._place_of(key))
        if slot < 0:
            return False
        self.keys[self.entries[slot]] = None
        self.prints[slot], self.entries[slot] = 0, -1
        self.live -= 1
        return True

    def _put(self, entry: int, mark: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        bucket = first
        for _ in range(MAX_KICKS):
            self.turn = (self.turn + 1) % SLOTS
            slot = bucket * SLOTS + self.turn
            self.prints[slot], mark = mark, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        return False

    def _grow(self) -> None:
        """Double until every live stored key has a slot; fingerprints alone could not be dealt anew."""
        size = self.buckets
        while True:
            size *= 2
            self.resizes += 1
            self._build(size)
            if all(self._put(e, *self._place_of(k)) for e, k in enumerate(self.keys) if k is not None):
                return


def _better(len_a: int, id_a, len_b: int, id_b) -> bool:
    """Whether a stays before b: longer first, then smaller id, null ids last."""
    if len_a != len_b:
        return len_a > len_b
    return id_b is None or (id_a is not None and id_a < id_b)


def _index(batches: Iterable[pa.RecordBatch], flush: int | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Group rows by digest. A row with n = 0 withdraws its digest."""

    def groups() -> Iterator[pa.RecordBatch]:
        gone = [k for k in withdrawn if index.discard(k)] if flush is None else []
        alive = [e for e, k in enumerate(index.keys) if k is not None]
        digests, counts = [index.keys[e] for e in alive], [count[e] for e in alive]
        rows = [digests + gone, [length[e] for e in alive] + [0] * len(gone), [best[e] for e in alive] + [None] * len(gone), counts + [0] * len(gone)]
        if flush is not None and withdrawn:
            for values, more in zip(rows, ([*withdrawn], [0] * len(withdrawn), [None] * len(withdrawn), [0] * len(withdrawn))):
                values += more
        whole = pa.table([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)
        yield from whole.to_batches(max_chunksize=16384)

    index, length, best, count, withdrawn = CuckooIndex(), [], [], [], set()
    for batch in batches:
        for digest, n_chars, id_, n in zip(*(c.to_pylist() for c in batch.columns)):
            if n == 0:
                withdrawn.add(digest)
                continue
            entry = index.add(digest)
            if entry == len(count):
                length.append(n_chars)
                best.append(id_)
                count.append(n)
            else:
                count[entry] += n
                if _better(n_chars, id_, length[entry], best[entry]):
                    length[entry], best[entry] = n_chars, id_
        if flush is not None and len(count) >= flush:
            yield from groups()
            index, length, best, count, withdrawn = CuckooIndex(), [], [], [], set()
    yield from groups()


def normalised_digest(text: str = "text"):
    """SHA-256, as bytes, of the text without ASCII white space."""
    return F.unhex(F.sha2(F.encode(F.translate(whole_text(text), WHITE, ""), "UTF-8"), 256))


def digest_groups(keys: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """One row for each digest of ``keys`` (digest, n_chars, doc_id): digest, best_len, best_id, n (0: withdrawn)."""
    kind = keys.schema["doc_id"].dataType.simpleString()
    rows = keys.select("digest", "n_chars", "doc_id", F.lit(1).cast("long").alias("n"))
    if withdrawn is not None:
        rows = rows.unionByName(withdrawn.where("digest is not null").select("digest", F.lit(0).alias("n_chars"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("n")))
    ddl = _SCHEMA.format(kind=kind)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    local = rows.mapInArrow(lambda batches: _index(batches, FLUSH_KEYS, schema), ddl)
    return local.repartition("digest").mapInArrow(lambda batches: _index(batches, None, schema), ddl)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", withdrawn: DataFrame | None = None) -> DataFrame:
    """Exact groups of ``docs`` by text without ASCII white space (``[\\x20\\x09-\\x0D]``).

    Returns one row for each input row: doc_id, keep_id, group_size (long), kept, text_sha256 (lowercase hex). The row
    with the most code points in its original text stays, then the one with the smallest id. ``withdrawn`` may hold
    ``digest`` (binary) of texts that are deleted from the index; their rows have group_size 0, no keep_id and are not kept.

    Null text is an empty text; all empty texts are one group. Rows with a null id come after all others of equal length;
    a group of null ids only has a null keep_id. Rows that repeat both id and text of the row that stays are kept
    with it. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    keys = persisted(docs.select(F.col(id_col).alias("doc_id"), normalised_digest(text_col).alias("digest"), F.length(whole_text(text_col)).alias("n_chars")))
    groups = digest_groups(keys, withdrawn).where("n <> 1").select("digest", "best_len", "best_id", "n")
    joined = keys.join(groups, "digest", "left")
    own = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (own | (F.col("n") > 0) & F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_len"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
