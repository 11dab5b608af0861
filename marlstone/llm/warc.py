"""WARC archives with a two-level capture index.

Archives: gzip members, one record each, written by every task to files of its own in a folder that driver and executors
share. A file's name holds the task attempt, so an attempt that was lost leaves only a file that no index entry names.

Index: one line a record, keyed by the URL with its host reversed (``com,example,www)/path``) and the record's id, range-sorted
and written as compressed blocks. Each index file ends in its sparse block directory, the first and last key of every block;
over the files stands one row for each. A lookup searches the files' first keys by bisection, reads that file's directory,
searches it by bisection, reads one range of the file for each block that may hold the key, and one range of an archive for
each capture. Many lookups are sorted and dealt by range, so that a task reads a directory and a block once.

Which records are revisits is found on ids and digests. Up to ``BROADCAST_REVISITS`` of them payloads go from the table into the
archives and no other way; beyond, pages meet the revisits' ids in a shuffle join, payloads with them.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import persisted, shared_dir, whole_text
from marlstone.llm.url_filter import url_host

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads under this size are always stored.
LEAST_REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30
BLOCK_LINES = 3000
READ_BYTES = 8 << 20
#: Revisits whose ids are broadcast to the writers; beyond, they meet the pages by shuffling.
BROADCAST_REVISITS = 100_000
#: Tasks that share the pages of one digest.
SALTS = 16
_ENTRY = "key string, ref string, file string, offset long, length long"
_PART = "first_key string, first_ref string, last_key string, last_ref string, file string, offset long, length long, n long"
_RECORD = "ref string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def ref_of(page_id: Column) -> Column:
    """Name of a record in archives and index: ``null``, or ``id:`` and the id as text, percent-encoded."""
    return F.coalesce(F.concat(F.lit("id:"), F.url_encode(page_id.cast("string"))), F.lit("null"))


def id_of(ref: Column) -> Column:
    """The id as text that a name stands for; null for ``null``."""
    return F.when(F.startswith(ref, F.lit("id:")), F.url_decode(F.substring(ref, 4, 1 << 30)))


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then what follows the host; the whole text where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.regexp_extract(url, r"^.*?://[^/?#]*([\s\S]*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(url_host(url), r"\.")), ","), F.lit(")"), after)
    return F.regexp_replace(F.when(F.instr(url, "://") > 0, key).otherwise(url), r"[\x00-\x20]", "%20")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_bytes(ref: str, url: str, payload: bytes, refers_to: str | None, size: int, digest: str) -> bytes:
    """One WARC 1.1 record, not compressed. A revisit has the HTTP header only. ``digest`` is the payload's SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{ref}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields; raises ValueError where its length or the payload's digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if tail != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    own = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    refers = fields.get("WARC-Refers-To")
    return {"ref": own(fields["WARC-Record-ID"]), "uri": fields.get("WARC-Target-URI", ""), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers and own(refers), "payload": payload}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, size, refers_to. Of equal payloads of at least 1000 bytes the largest page_id is stored.

    Revisits carry no html. Pages of one digest are dealt to several tasks, without their payloads; the stored pages are
    those that aren't revisits.
    """
    html = whole_text(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    large = rows.where(F.col("size") >= LEAST_REVISIT_BYTES).select("page_id", "url", "digest", "size")
    groups = persisted(large.groupBy("digest", "size").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1").drop("n"))
    salt = lambda c: F.pmod(F.xxhash64(c, "url"), F.lit(SALTS)).cast("int")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = large.withColumn("salt", salt("page_id")).join(salted, ["digest", "size", "salt"])
    revisits = persisted(met.where(~F.col("stored").eqNullSafe(F.col("page_id"))).select("page_id", "url", F.lit("").alias("html"), "digest", "size", F.col("stored").alias("refers_to")))
    gone = revisits.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    few = revisits.count() <= BROADCAST_REVISITS
    stored = rows.join(F.broadcast(gone) if few else gone, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_anti")
    return stored.withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType)).unionByName(revisits)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``with_revisits`` into ``folder``; the index entries, cut off from the writing by a checkpoint."""
    texts = rows.select(surt(F.col("url")).alias("key"), ref_of(F.col("page_id")), "url", "html", "digest", "size", F.when(F.col("refers_to").isNotNull(), ref_of(F.col("refers_to"))))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        context = TaskContext.get()
        out, name, at, n = None, "", 0, 0
        for batch in batches:
            entries = []
            for key, ref, url, html, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{n}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, at, n = files.open_output_stream(f"{path}/{name}", compression=None), 0, n + 1
                member = gzip.compress(record_bytes(ref, url, html.encode(), refers, size, digest), 6, mtime=0)
                out.write(member)
                entries.append((key, ref, name, at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if entries:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*entries)], ["key", "ref", "file", "offset", "length"])
        if out is not None:
            out.close()

    return persisted(texts.mapInArrow(write, _ENTRY))


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort entries into compressed blocks, a file for each range, its directory last: a row for each file."""
    names = [x.split()[0] for x in _PART.split(", ")]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        context = TaskContext.get()
        name = f"index-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.cdx"
        out, at, n, held, blocks = None, 0, 0, [], []

        def close_block() -> None:
            nonlocal at, held
            data = _packed_lines(held)
            out.write(data)
            blocks.append((*held[0][:2], *held[-1][:2], at, len(data)))
            at, held = at + len(data), []

        for batch in batches:
            out = out or files.open_output_stream(f"{path}/{name}", compression=None)
            n += batch.num_rows
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(entry)
                if len(held) == block_lines:
                    close_block()
        if held:
            close_block()
        if out is not None:
            directory = _packed_lines(blocks)
            out.write(directory)
            out.close()
        if blocks:
            row = (*blocks[0][:2], *blocks[-1][2:4], name, at, len(directory), n)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    order = ["key", "ref", "file", "offset"]
    return persisted(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, _PART))


def _packed_lines(rows: list[tuple]) -> bytes:
    """Rows of keys, names and numbers, none of which has a tab or a line break."""
    return zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode())


def _block_lines(data: bytes) -> list[tuple[str, str, str, int, int]]:
    return [(k, r, f, int(o), int(n)) for k, r, f, o, n in (x.split("\t") for x in zlib.decompress(data).decode().split("\n"))]


class _Bisection:
    """Entries of an index by key, or by key and record. The last directory and block that were read are kept."""

    def __init__(self, parts: list[tuple], folder: str):
        self.parts, self.firsts = parts, [p[:2] for p in parts]
        self.files, self.path = _filesystem(folder)
        self.read: dict[str, tuple] = {}

    def _kept(self, level: str, file: str, offset: int, length: int, parse) -> list[tuple]:
        if self.read.get(level, (None,))[0] != (file, offset):
            with self.files.open_input_file(f"{self.path}/{file}") as f:
                f.seek(offset)
                self.read[level] = ((file, offset), parse(f.read(length)))
        return self.read[level][1]

    @staticmethod
    def _directory(data: bytes) -> list[tuple]:
        return [(*x[:4], int(x[4]), int(x[5])) for x in (line.split("\t") for line in zlib.decompress(data).decode().split("\n"))]

    @staticmethod
    def _spanning(rows: list[tuple], low: tuple, high: tuple) -> Iterator[tuple]:
        """Rows (first key and ref, last key and ref, ...) in order that may hold something between low and high."""
        at = max(0, bisect.bisect_left(rows, low) - 1)
        while at < len(rows) and rows[at][:2] <= high:
            if rows[at][2:4] >= low:
                yield rows[at]
            at += 1

    def entries(self, key: str, ref: str | None = None) -> Iterator[tuple[str, str, str, int, int]]:
        low, high = (key, ref or ""), (key, "\U0010ffff" if ref is None else ref)
        for part in self._spanning(self.parts, low, high):
            file = part[4]
            for block in self._spanning(self._kept("directory", file, part[5], part[6], self._directory), low, high):
                lines = self._kept("block", file, block[4], block[5], _block_lines)
                at = bisect.bisect_left(lines, low)
                while at < len(lines) and lines[at][:2] <= high:
                    yield lines[at]
                    at += 1


def _ranges(files: pafs.FileSystem, path: str, wanted: Iterable[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes of each (file, offset, length); neighbours are read together, up to READ_BYTES."""
    handle, opened, held, start = None, None, b"", 0
    wanted = list(wanted)
    for i, (file, offset, length) in enumerate(wanted):
        if file != opened:
            handle, opened, held, start = files.open_input_file(f"{path}/{file}"), file, b"", 0
        if not start <= offset <= offset + length <= start + len(held):
            end, j = offset + length, i + 1
            while j < len(wanted) and wanted[j][0] == file and wanted[j][1] == end and end + wanted[j][2] - offset <= READ_BYTES:
                end, j = end + wanted[j][2], j + 1
            handle.seek(offset)
            held, start = handle.read(end - offset), offset
        yield held[offset - start : offset - start + length]


def lookup(requests: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """Index entries of the requested (key, ref) pairs. The files' first keys, a row a file, are what every task gets.

    Requests are made distinct, sorted and dealt by range; each is found by bisection of the files, of one file's directory and
    of one block.
    """
    top = requests.sparkSession.sparkContext.broadcast(sorted(map(tuple, parts.collect())))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Bisection(top.value, folder)
        for batch in batches:
            found = [e for key, ref in zip(*(c.to_pylist() for c in batch.columns)) for e in index.entries(key, ref)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)], ["key", "ref", "file", "offset", "length"])

    order = ["key", "ref"]
    return requests.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(find, _ENTRY)


def read_archives(entries: DataFrame, folder: str) -> DataFrame:
    """The records that ``entries`` name, by range reads in the order of the archives; every digest is checked."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        names = [x.split()[0] for x in _RECORD.split(", ")]
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            found = [parse_record(gzip.decompress(data)) for data in _ranges(files, path, zip(*rows))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64() if c == "payload_bytes" else pa.string()) for c in names], names)

    order = ["file", "offset"]
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(read, _RECORD)


class CaptureIndex:
    """Lookups of single URL keys in a written archive. It holds a row for each index file."""

    def __init__(self, parts: DataFrame, folder: str):
        self.folder, self.index = folder, _Bisection(sorted(map(tuple, parts.collect())), folder)

    def captures(self, key: str) -> list[dict]:
        files, path = _filesystem(self.folder)
        found = sorted(e[2:] for e in self.index.entries(key))
        return [parse_record(gzip.decompress(data)) for data in _ranges(files, path, found)]


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive ``pages`` into ``folder`` (a URI that driver and executors share); a row for each index file."""
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    return write_index(write_archives(with_revisits(pages, id_col, url_col, html_col), folder), folder)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC, index them, look every page up in the index and read its record: page_id, payload_bytes,
    payload_digest, record_type, refers_to, uri.

    Of records with equal payloads of at least 1000 bytes the one with the largest page_id is a response and the others
    are revisits of it; rows that repeat that page_id and payload are responses too. Null html is an empty payload, a
    null url has no target URI, a null page_id stays null and comes before all others; ids may be any text. An empty table
    gives an empty result. Other columns are not read. The archives lie in the shared folder and go once the result is there.
    """
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType
    parts = write_warc(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    requests = pages.select(surt(F.coalesce(F.col(url_col), F.lit(""))).alias("key"), ref_of(F.col(id_col)).alias("ref"))
    records = read_archives(lookup(requests, parts, folder), folder)
    back = lambda c: id_of(F.col(c)).cast(kind)
    out = persisted(records.select(back("ref").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"), "uri"))
    files, path = _filesystem(folder)
    files.delete_dir(path)
    return out


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS stored FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND stored <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND stored <> page_id THEN stored END AS refers_to
FROM g
"""
