"""The data source of folders: partitions, tags that are asked for, short files, and the stream's log."""

import os

import pytest
from pyspark.sql import functions as F

from metaudit.sources import folder, scan
from tests import study
from tests.dicom import element, part10


@pytest.fixture
def files(tmp_path):
    root = tmp_path / "in"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "_hidden").mkdir()
    (root / "_hidden" / "x").write_bytes(b"x")
    (root / "a").write_bytes(study.file_bytes("P", 1, b"\1\2" * 2_000_000))
    (root / "deep" / "b").write_bytes(part10(element("00100010", "PN", "A^B") + element("00420011", "OB", b"x" * 3_000_000) + element("00420012", "UT", "y" * 500_000) + element("00420013", "LO", "last")))
    (root / "deep" / "er" / "c").write_bytes(b"no")
    (root / "cut").write_bytes(part10(element("00100010", "PN", "A^B") + element("00420011", "UT", b"x" * 3000))[:-2000])
    (root / "DICOMDIR").write_bytes(part10(b"", sop_class=scan.DIRECTORY_CLASS))
    return root


def test_rows_and_partitions(spark, files):
    rows = folder.read_folder(spark, str(files), files_per_partition="2")
    assert rows.rdd.getNumPartitions() == 3
    got = {r["relative_path"]: r for r in rows.collect()}
    assert {k: (r["outcome"], r["reason"]) for k, r in got.items()} == {"in/a": ("read", None), "in/deep/b": ("read", None), "in/deep/er/c": ("skipped", "not-dicom"), "in/cut": ("failed", None), "in/DICOMDIR": ("skipped", "dicomdir")}
    assert "(00420011)" in got["in/cut"]["message"] and got["in/a"]["bytes_read"] <= scan.FIRST_BYTES < got["in/a"]["size"]
    assert got["in/deep/b"]["attributes"][-1]["value"] == "last" and 500_000 < got["in/deep/b"]["bytes_read"] < 1_500_000
    # Listing and reading by Spark gives the same rows.
    listed = scan.scan_files(spark, str(files))
    key = lambda r: (os.path.basename(r["file"]), r["outcome"], str(r["attributes"]))
    assert sorted(map(key, scan.scan(listed).collect())) == sorted(map(key, rows.collect()))
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(files)).select(F.col("path").alias("file"), "content")
    assert sorted(map(key, scan.scan(contents).collect())) == sorted(map(key, rows.collect()))


def test_values_that_nobody_asks_for_are_not_read(spark, files):
    got = {r["relative_path"]: r for r in folder.read_folder(spark, str(files), tags=["00420013", "00100010"]).collect()}
    assert [(a["tag"], a["value"]) for a in got["in/deep/b"]["attributes"]] == [("00100010", "A^B"), ("00420013", "last")]
    assert got["in/deep/b"]["bytes_read"] < 300_000


def test_conditions_on_tags_are_pushed(spark, files, capfd):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = folder.read_attributes(spark, str(files)).filter(F.col("tag").isin("00100010", "00080060"))
        assert {(r["tag"], r["value"]) for r in rows.collect()} == {("00100010", "A^B"), ("00100010", "Sample^One"), ("00080060", "CT")}
        reader = folder.PushingReader({"path": str(files), "rows": "attributes"})
        assert len(list(reader.pushFilters([folder.In(("tag",), ("00100010",)), folder.EqualTo(("file",), "x")]))) == 2
        assert reader.folder.wanted == {"00100010"}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert folder.read_attributes(spark, str(files)).count() == scan.attributes(folder.read_folder(spark, str(files))).count()


def test_a_file_that_gives_fewer_bytes_than_it_states():
    """A file that shrinks while it is read, or whose store breaks off, is a failed row."""
    whole = study.file_bytes("P", 1, b"\1\2" * 200)
    for held in (100, 140, 400):
        read = lambda at, n, held=held: whole[at : min(at + n, held)]
        outcome, _, message, count, _ = scan.read_outcome(lambda read=read: (read, len(whole), lambda: None), None)
        assert outcome == "failed" and "fewer bytes" in message and count <= held

    def gone():
        raise FileNotFoundError("no such file")

    assert scan.read_outcome(gone, None)[:3] == ("failed", None, "no such file")


def test_windows_move_along(monkeypatch):
    body = b"".join(element(f"0042{k:04x}", "LO", f"v{k}" * 20) for k in range(0x1000, 0x3000))
    whole = part10(body)
    reads = []
    read = lambda at, n: reads.append((at, n)) or whole[at : at + n]
    outcome, _, _, count, rows = scan.read_outcome(lambda: (read, len(whole), lambda: None), None)
    assert outcome == "read" and len(rows) == 0x2000 + 3 and count == len(whole)
    assert len(reads) < 6 and [a for a, _ in reads] == sorted(a for a, _ in reads)


def test_partitions_are_planned_by_bytes():
    plan = folder.planned([("a", 10), ("b", 10**9), ("c", 10**9), ("d", 5)], 100, 2 * scan.FIRST_BYTES)
    assert [[f for f, _ in p.files] for p in plan] == [["a", "b"], ["c", "d"]] and folder.planned([], 1, 1) == []


def test_stream_offsets_come_from_the_log(files, tmp_path):
    options = {"path": str(files), "log": str(tmp_path / "log")}
    stream = folder.FolderStream(options)
    first = stream.latestOffset()
    assert stream.latestOffset() == first == {"number": 1}
    (files / "new").write_bytes(b"no")
    again = folder.FolderStream(options)  # another run lists what is new, after what was seen
    assert again.latestOffset() == {"number": 2} and len(again.partitions({"number": 1}, {"number": 2})[0].files) == 1
    (files / "a").unlink()
    assert sum(len(p.files) for p in again.partitions({"number": 0}, {"number": 1})) == 5


def test_access_of_stores(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.access.key", "k")
    conf.set("fs.s3a.endpoint.region", "r")
    try:
        assert folder.hadoop_options(spark) == {"fs.access_key": "k", "fs.region": "r"}
    finally:
        conf.unset("fs.s3a.access.key")
        conf.unset("fs.s3a.endpoint.region")
    where, path = folder.file_system("s3a://bucket/a/b", {"fs.region": "eu-west-1", "fs.access_key": "k", "fs.secret_key": "s"})
    assert where.type_name == "s3" and path == "bucket/a/b"
    assert folder.file_system("file:/a/b", {})[1] == "/a/b" == folder.file_system("file:///a/b", {})[1]
