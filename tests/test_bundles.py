"""Archives with safe and hostile members; bundles that are interrupted, lost and rebuilt."""

import hashlib
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.sources import bundles


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)


def test_archives_are_read_member_by_member(spark, tmp_path):
    zipped(tmp_path / "a.zip", [("x/1.json", b"{}"), ("y.txt", b""), ("d/", b"")])
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("./z/2.bin")
        info.size = 3
        t.addfile(info, io.BytesIO(b"\x00\x01\x02"))
    (tmp_path / "note.txt").write_text("no archive")
    df = bundles.read_archives(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.archive, r.member, r.size, bytes(r.content)) for r in df.collect()) == [("a.zip", "x/1.json", 2, b"{}"), ("a.zip", "y.txt", 0, b""), ("b.tar.gz", "z/2.bin", 3, b"\x00\x01\x02")]
    with pytest.raises(Exception, match="FileNotFoundError"):
        bundles.read_archives(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("name", ["../evil.txt", "a/../../evil", "/etc/passwd", "C:\\evil", "\\evil", "a/..\\..\\evil"])
def test_hostile_members_are_refused(spark, tmp_path, name):
    zipped(tmp_path / "bad.zip", [("good.txt", b"1"), (name, b"2")])
    with pytest.raises(Exception, match="would leave the root"):
        bundles.read_archives(spark, str(tmp_path)).collect()


def test_links_in_archives_are_refused(spark, tmp_path):
    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        link = tarfile.TarInfo("inner")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc"
        t.addfile(link)
    with pytest.raises(Exception, match="is a link"):
        bundles.read_archives(spark, str(tmp_path)).collect()


@pytest.fixture
def records(spark):
    return spark.range(500).select(F.concat(F.lit("r/"), F.col("id").cast("string"), F.lit(".json")).alias("member"), F.concat(F.lit("v1:"), F.col("id").cast("string")).cast("binary").alias("content"))


def test_publish_and_read_back(spark, tmp_path, records):
    root = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        bundles.published(spark, root)
    version = bundles.publish(records.repartition(3), root, part_records=40)
    got = {r.member: r for r in bundles.published(spark, root).collect()}
    assert len(got) == 500 and all(bytes(got[f"r/{i}.json"].content) == f"v1:{i}".encode() and got[f"r/{i}.json"].sha256 == hashlib.sha256(f"v1:{i}".encode()).hexdigest() for i in range(500))
    index = spark.read.parquet(f"{root}/{version}/index")
    assert index.select("part").distinct().count() >= 13 and index.exceptAll(bundles.rebuilt_index(spark, f"{root}/{version}")).count() == 0


def test_interrupted_writes_leave_the_old_version(spark, tmp_path, records, monkeypatch):
    root = str(tmp_path / "bundle")
    old = bundles.publish(records, root)
    newer = records.withColumn("content", F.lit(b"v2"))
    bad = newer.withColumn("member", F.when(F.col("member") == "r/77.json", F.lit("../evil")).otherwise(F.col("member")))
    with pytest.raises(Exception, match="would leave the root"):
        bundles.publish(bad, root)
    with pytest.raises(ValueError, match="comes twice"):
        bundles.publish(newer.union(newer.limit(1)), root)
    monkeypatch.setattr(bundles, "make_current", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        bundles.publish(newer, root)
    monkeypatch.undo()
    assert bundles.current_version(root) == old and {bytes(r.content)[:2] for r in bundles.published(spark, root).collect()} == {b"v1"}
    new = bundles.recovered_version(root)  # the last complete one
    assert new != old
    bundles.make_current(root, new)
    assert {bytes(r.content) for r in bundles.published(spark, root).collect()} == {b"v2"}
    with pytest.raises(ValueError, match="isn't complete"):
        bundles.make_current(root, "v-none")


def test_bundle_problems(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3"), ("e", "5")], "member string, sha256 string")
    b = spark.createDataFrame([("a", "1", "real"), ("b", "9", "real"), ("c", "3", "made"), ("d", "4", "made"), ("e", "5", "real"), ("e", "5", "made")], "member string, sha256 string, origin string")
    got = sorted((r.member, r.problem) for r in bundles.bundle_problems(a, b).collect())
    assert got == [("b", "other_digest"), ("c", "repeated_record"), ("d", "no_record"), ("e", "repeated_provenance")]
    assert [r.problem for r in bundles.bundle_problems(a.where("member = 'a'"), b.limit(0)).collect()] == ["no_provenance"]
