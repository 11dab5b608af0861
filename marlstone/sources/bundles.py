"""Archives as a data source, and bundles of many small records that are published atomically.

``archive`` reads zip and tar files: a partition for each archive, its members streamed one at a time. A member whose path
would leave the root (``..``, an absolute path, a drive, a link) is refused before any of the archive's rows is given.

A bundle is a folder with versions. A version's parts are archives that tasks write, then its index (member, part, size,
digest), then a mark that it is complete; last the name of the current version is put in place by one rename. So readers
see the old version until that rename, whatever is interrupted before. A lost index is rebuilt from the parts, a lost name
of the current version from the marks.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import tarfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, size long, content binary"
INDEX = "member string, part string, size long, sha256 string"
#: Records and bytes of a part, about at most.
PART_RECORDS, PART_BYTES = 10_000, 64 << 20
_CURRENT, _COMPLETE = "CURRENT", "COMPLETE"


class UnsafeMember(ValueError):
    """A member's path would leave the root."""


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def checked(member: str) -> str:
    """The member's path, which stays below the root."""
    parts = member.replace("\\", "/").split("/")
    if not member or "\x00" in member or member[0] in "/\\" or ".." in parts or (len(parts[0]) == 2 and parts[0][1] == ":"):
        raise UnsafeMember(f"{member!r} would leave the root")
    return posixpath.normpath(member.replace("\\", "/"))


class ArchivePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the archive source needs a path")
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        files, path = filesystem(self.root)
        info = files.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz")))
        return [ArchivePartition(n) for n in names]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        files, _ = filesystem(self.root)
        name = posixpath.basename(partition.path)
        with files.open_input_file(partition.path) as f:
            if partition.path.lower().endswith(".zip"):
                with zipfile.ZipFile(f) as bundle:
                    members = [(checked(m.filename), m) for m in bundle.infolist()]
                    for path, m in members:
                        if not m.is_dir():
                            yield name, path, m.file_size, bundle.read(m)
            else:
                with tarfile.open(fileobj=f) as bundle:
                    members = bundle.getmembers()
                    for m in members:
                        checked(m.name)
                        if m.issym() or m.islnk() or m.isdev():
                            raise UnsafeMember(f"{m.name!r} is a link or a device")
                    for m in members:
                        if m.isfile():
                            yield name, checked(m.name), m.size, bundle.extractfile(m).read()


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: archive, member, size, content."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, size, content of all archives below ``path``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").load(path)


def _parts(folder: str, records: int, size: int):
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a task's records as archives and gives their index."""
        files, path = filesystem(folder)
        held: list[tuple[str, bytes]] = []
        n, total = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal n, total
            context = TaskContext.get()
            part = f"part-{context.partitionId():05d}-{n:05d}-{context.taskAttemptId()}.zip"
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as bundle:
                for member, content in held:
                    bundle.writestr(zipfile.ZipInfo(member), content)
            with files.open_output_stream(f"{path}/{part}") as out:
                out.write(data.getbuffer())
            rows = [(m, part, len(c), hashlib.sha256(c).hexdigest()) for m, c in held]
            held.clear()
            n, total = n + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["member", "part", "size", "sha256"])

        for batch in batches:
            for member, content in zip(batch.column("member").to_pylist(), batch.column("content")):
                held.append((checked(member), content.as_py()))
                total += len(held[-1][1])
                if len(held) >= records or total >= size:
                    yield flush()
        if held:
            yield flush()

    return parts


def _write_text(root: str, name: str, text: str) -> None:
    files, path = filesystem(root)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(text.encode())


def _read_text(root: str, name: str) -> str | None:
    files, path = filesystem(root)
    if files.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
        return None
    with files.open_input_stream(f"{path}/{name}") as f:
        return f.read().decode()


def _digest(index: DataFrame) -> tuple[int, str]:
    """Number of records, and a digest of the index that is independent of order: the sum of its rows' hashes."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "member", "size", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = index.agg(F.count("*"), F.sum(row)).first()
    return n, str(total or 0)


def written_version(records: DataFrame, root: str, *, part_records: int = PART_RECORDS, part_bytes: int = PART_BYTES) -> str:
    """Writes ``records`` (member, content) aside as a complete version and gives its name; readers don't see it yet.

    Members must be different, not null and below the root; contents are read back and must have the digests that went in.
    """
    version = f"v-{uuid.uuid4().hex}"
    folder = f"{root}/{version}"
    files, path = filesystem(folder)
    files.create_dir(f"{path}/parts", recursive=True)
    rows = records.select(F.col("member").cast("string").alias("member"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    rows.mapInArrow(_parts(f"{folder}/parts", part_records, part_bytes), INDEX).write.parquet(f"{folder}/index")
    spark = records.sparkSession
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    if twice := index.groupBy("member").count().where("count > 1").take(1):
        raise ValueError(f"member {twice[0][0]!r} comes twice")
    back = rebuilt_index(spark, folder)
    if index.join(back, ["member", "part", "size", "sha256"], "left_anti").take(1):
        raise ValueError("a part doesn't give back what was written")
    n, digest = _digest(index)
    _write_text(folder, _COMPLETE, json.dumps({"version": version, "records": n, "digest": digest, "after": current_version(root)}))
    return version


def make_current(root: str, version: str) -> None:
    """Puts a complete version in place by one rename."""
    if _read_text(f"{root}/{version}", _COMPLETE) is None:
        raise ValueError(f"version {version} isn't complete")
    aside = f"{_CURRENT}-{uuid.uuid4().hex}"
    _write_text(root, aside, version)
    files, path = filesystem(root)
    files.move(f"{path}/{aside}", f"{path}/{_CURRENT}")


def publish(records: DataFrame, root: str, **sizes: int) -> str:
    version = written_version(records, root, **sizes)
    make_current(root, version)
    return version


def current_version(root: str) -> str | None:
    return _read_text(root, _CURRENT)


def recovered_version(root: str) -> str | None:
    """The complete version that no other complete one came after, when the name of the current one is lost."""
    files, path = filesystem(root)
    marks = [json.loads(m) for f in files.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory and (m := _read_text(f"{root}/{f.base_name}", _COMPLETE))]
    before = {m["after"] for m in marks}
    last = sorted(m["version"] for m in marks if m["version"] not in before)
    if len(last) > 1:
        raise ValueError(f"versions {last} were written side by side; make one current")
    return last[0] if last else None


def rebuilt_index(spark: SparkSession, folder: str) -> DataFrame:
    """member, part, size, sha256 from a version's parts alone. Parts of attempts that failed aren't told apart from others."""
    rows = read_archives(spark, f"{folder}/parts")
    return rows.select("member", F.col("archive").alias("part"), F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def published(spark: SparkSession, root: str, *, with_content: bool = True) -> DataFrame:
    """member, size, sha256 and content of the current version."""
    version = current_version(root)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    index = spark.read.schema(INDEX).parquet(f"{root}/{version}/index")
    if not with_content:
        return index.select("member", "size", "sha256")
    rows = read_archives(spark, f"{root}/{version}/parts").select("member", F.col("archive").alias("part"), "content")
    return index.join(rows, ["member", "part"]).select("member", "size", "sha256", "content")


def bundle_problems(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """member, problem: 'no_provenance', 'no_record', 'repeated_record', 'repeated_provenance' or 'other_digest'.

    ``records`` has member and sha256, ``provenance`` member, sha256 and origin.
    """
    a = records.groupBy("member").agg(F.count("*").alias("n"), F.min("sha256").alias("own"))
    b = provenance.groupBy("member").agg(F.count("*").alias("m"), F.min("sha256").alias("told"))
    tests = {"no_provenance": F.col("m").isNull(), "no_record": F.col("n").isNull(), "repeated_record": F.col("n") > 1, "repeated_provenance": F.col("m") > 1, "other_digest": F.col("own") != F.col("told")}
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return a.join(b, "member", "full").select("member", F.explode(found).alias("problem"))
