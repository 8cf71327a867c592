"""The planted studies from files to report."""

import json

import pytest
from pyspark.sql import functions as F

from metaudit.operators import checks, classify, pixels, summary
from metaudit.plans import audit as audits
from metaudit.plans import report
from metaudit.sources import scan
from tests import study
from tests.dicom import element, part10


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(study.PROFILE, "tag string, action string"),
        spark.createDataFrame([(0, "60xx3000", "X")], "ordinal int, mask string, action string"),
        spark.createDataFrame(study.NAMES, "tag string, name string, vr string"),
        spark.createDataFrame([(0, "60xx3000", "Overlay Data", "OW")], "ordinal int, mask string, name string, vr string"),
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("files") / "series"
    return made, study.write_study(made)


@pytest.fixture(scope="module")
def audited(spark, tables, folder):
    return audits.audit_folder(spark, str(folder[0]), *tables)


def test_outcomes(audited):
    assert summary.outcome_totals(audited.outcomes).first().asDict() == {"selected": 22, "read": 18, "not_dicom": 2, "dicomdir": 1, "failed": 1}
    assert summary.folder_name(audited.outcomes).first()[0] == "series"
    assert "(00100010)" in audited.outcomes.filter("outcome = 'failed'").first()["message"]


def test_nested_attributes(audited):
    paths = {r["path"] for r in audited.attributes.select("path").distinct().collect()}
    assert "04000561/0/04000550/0/00080090" in paths and "7fe00010" not in paths


def test_files_are_read_up_to_the_pixels(spark, tmp_path):
    (tmp_path / "large").write_bytes(study.file_bytes("P", 1, b"\1\2" * 2_000_000))
    (tmp_path / "gone").write_bytes(study.file_bytes("P", 2))
    (tmp_path / "long").write_bytes(part10(element("00100010", "PN", "A^B") + element("00420011", "OB", b"x" * 300_000) + element("00420012", "LO", "last")))
    files = scan.scan_files(spark, str(tmp_path)).cache()
    assert files.count() == 3
    (tmp_path / "gone").unlink()
    got = {r["file"].rpartition("/")[2]: r for r in scan.scan(files).collect()}
    assert got["large"]["outcome"] == "read" and got["large"]["bytes_read"] <= scan.FIRST_BYTES
    assert got["gone"]["outcome"] == "failed" and got["gone"]["message"]
    assert got["long"]["attributes"][-1]["value"] == "last" and got["long"]["bytes_read"] < 150_000  # past the binary value
    files.unpersist()


def test_eleven_findings(audited, folder):
    names = folder[1]
    label = lambda file: "".join(map(str, names[file.rpartition("/")[2]]))
    every = ("P1", "P2", "P3", "P4", "P6", "P7", "P8")
    got = {}
    for r in checks.collapse(audited.finding_files).collect():
        key = (r["kind"], r["scope"], r["series"], r["path"], tuple(map(label, r["files"])) if r["scope"] == "series" else len(r["files"]))
        got[key] = (r["expected"], r["actual"], r["expected_value"])
    close = pytest.approx
    p, q, r = "2.1.7", "2.1.9", "2.2.3"
    assert got == {
        ("position-gap", "series", p, None, ("P4", "P6")): (2.5, 5.0, None),
        ("position-gap", "series", p, None, ("P7", "P8")): (2.5, close(0.004), None),
        ("duplicate-position", "series", p, None, ("P7", "P8")): (None, None, None),
        ("inconsistent-pixel-spacing", "series", p, None, ("P2",)): (None, None, "0.8\\0.8"),
        ("extra-field", "series", p, "00290010", ("P3",)): (None, None, None),
        ("extra-field", "series", q, "04000561/0/04000550/0/00080090", ("Q2",)): (None, None, None),
        ("varying-value", "series", q, "00100010", ("Q4",)): (None, None, "Sample^One"),
        ("mixed-modality", "series", q, None, ("Q1", "Q2", "Q3", "Q4", "Q5", "Q6")): (None, None, None),
        ("inconsistent-orientation", "series", r, None, ("R1", "R2", "R3")): (None, None, None),
        ("inconsistent-identifier", "series", r, None, ("R1", "R4", "R2", "R3")): (None, None, None),
        ("mixed-modality", "folder", None, None, 18): (None, None, None),
    }
    assert summary.finding_counts(audited.finding_files).first().asDict() == {"not_consistent": 3, "structural": 8}
    placed = {label(r["file"]): r["ordered_by"] for r in audited.ordered.collect()}
    assert {placed[f] for f in every} == {"position"} and placed["R1"] == "instance-number"


def test_report_hides_values(audited, tmp_path):
    report.write_markdown(audited, str(tmp_path / "md"), "2026-01-15 14:30:00")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    for said in ("Checked 2026-01-15 at 14:30", "- Folder: series", "- 22 files selected", "- 18 DICOM files read", "- 3 identifying fields are not the same on every file", "- 8 structural inconsistencies between files", "Burned-in annotation: 7 files declare YES, 6 declare NO; 5 do not carry the field", "### Patient ID", "- Distinct values: 2", "- Present: in 1 of 18 files", "### Series 4 · CT · 7 slices", "Ordered by position", "A slice may be missing — 5 mm between two slices where 2.5 mm is expected", "### Whole folder", "## Ungrouped files (1)", "no series identifier"):
        assert said in text, said
    for secret in ("PID-9", "Sample^Two", "2.1.7", "CHEST", "Referrer"):
        assert secret not in text, secret
    places = [text.index(f"\n## {s}") for s in report.SECTIONS]  # "### Series" is no section
    assert places == sorted(places)
    report.write_markdown(audited, str(tmp_path / "open"), "2026-01-15 14:30:00", include_values=True)
    shown = "\n".join(p.read_text() for p in sorted((tmp_path / "open").glob("part-*")))
    assert "Sample^One (in 16 files)" in shown and report.VALUES_WARNING in shown


def test_json(audited, tmp_path, spark):
    report.write_json(audited, str(tmp_path / "json"), "2026-01-15T14:30:00Z")
    raw = "".join(p.read_text() for p in (tmp_path / "json").rglob("part-*"))
    assert "PID-9" not in raw and "2.1.7" not in raw
    head = spark.read.json(str(tmp_path / "json/head")).first()
    assert head["headline"]["filesRead"] == 18 and head["headline"]["structuralCount"] == 8
    gaps = spark.read.json(str(tmp_path / "json/structural")).filter("kind = 'position-gap'").collect()
    assert [r["series"] for r in gaps] == ["4", "4"]
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json/report").glob("part-*"))))
    assert list(whole) == ["provenance", "whatWasChecked", "headline", "burnedIn", "includesValues", "caveats", "identifyingFields", "notConsistent", "structural", "series", "ungrouped", "failed"]
    assert len(whole["structural"]) == 8 and len(whole["notConsistent"]) == 3 and len(whole["failed"]) == 1 and whole["series"][0]["seriesInstanceUid"] is None
    assert [f["path"] for f in whole["identifyingFields"]] == sorted(f["path"] for f in whole["identifyingFields"])


def test_a_long_report_is_many_rows(spark, audited, tmp_path, monkeypatch):
    """Twenty thousand failed files: the document is written by several tasks, a line an entry, and reads as JSON."""
    n = 20_000
    failed = spark.range(n).select(F.format_string("f%05d", n - 1 - F.col("id")).alias("name"), F.lit('cut "short"').alias("message"))
    sections = report.json_sections(audited, "2026-01-15T14:30:00Z")
    monkeypatch.setattr(report, "json_sections", lambda *a: sections | {"failed": failed, "ungrouped": sections["ungrouped"].limit(0)})
    lines = report.json_lines(audited, "2026-01-15T14:30:00Z")
    assert lines.filter("section = 6").count() == n + 2 and lines.agg(F.max(F.length("text"))).first()[0] < 5000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small parts become one
    try:
        report.write_json(audited, str(tmp_path / "json"), "2026-01-15T14:30:00Z")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "json/report").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in files))
    assert len(files) > 1 and [f["name"] for f in whole["failed"]] == [f"f{k:05d}" for k in range(n)] and whole["ungrouped"] == []


def test_burned_in_sentence_is_bounded(spark):
    counts = spark.range(50_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("value"), F.when(F.col("id") == 7, 9).otherwise(1).cast("bigint").alias("n"))
    text = summary.burned_in_text(counts, 3).first()[0]
    assert text == "Burned-in annotation: 9 files declare v00007, 1 declares v00000, 1 declares v00001, 49997 declare one of 49997 other values"
    assert summary.burned_in_text(counts.limit(0)).first()[0] == "No file declares burned-in annotation."


def frames_file(offsets, fragments, cut=0):
    """A file with encapsulated pixel data."""
    item = lambda b: b"\xfe\xff\x00\xe0" + len(b).to_bytes(4, "little") + b
    data = item(b"".join(o.to_bytes(4, "little") for o in offsets)) + b"".join(map(item, fragments)) + b"\xfe\xff\xdd\xe0\0\0\0\0"
    whole = part10(element("00280008", "IS", str(len(fragments))) + b"\xe0\x7f\x10\x00OB\0\0\xff\xff\xff\xff" + data, "1.2.840.10008.1.2.5")
    return whole[: len(whole) - cut]


def test_offset_tables_of_files(spark, tmp_path):
    """Facts of pixel data from files up to the triage: a table that does not fit, data that are too short."""
    fragments = [b"a" * 200_000, b"b" * 10, b"c" * 6]
    right = [0, 200_008, 200_026]
    for name, whole in {"right": frames_file(right, fragments), "wrong": frames_file([0, 200_000, 200_026], fragments), "back": frames_file([200_008, 0, 200_026], fragments), "none": frames_file([], fragments), "cut": frames_file(right, fragments, 20)}.items():
        (tmp_path / name).write_bytes(whole)
    (tmp_path / "native").write_bytes(study.file_bytes("P", 1, b"\1\2" * 50))
    (tmp_path / "bare").write_bytes(part10(element("00100010", "PN", "A^B")))
    got = scan.scan_pixels(scan.scan_files(spark, str(tmp_path))).withColumn("name", F.substring_index("file", "/", -1)).cache()
    rows = {r["name"]: r for r in got.collect()}
    assert [f["offset"] for f in rows["right"]["fragments"]] == right and rows["right"]["offset_table"] == right
    assert rows["native"]["pixel_bytes"] == 100 and not rows["native"]["encapsulated"] and not rows["bare"]["has_pixels"]
    assert "fragment" in rows["cut"]["message"]
    pieces = got.select("file", F.posexplode("fragments").alias("idx", "f")).select("file", "idx", "f.offset")
    facts = lambda frame: {r["file"].rpartition("/")[2]: r["offsets_match"] for r in pixels.boundary_facts(pieces, got.filter("encapsulated"), frame).collect()}
    assert facts(0) == {"right": True, "wrong": False, "back": False, "none": None} and facts(1) == {"right": True, "wrong": False, "back": True, "none": None} and facts(2) == {"right": True, "wrong": True, "back": True, "none": None}
    images = pixels.boundary_facts(pieces, got.filter("encapsulated")).join(got.select("file", "name", "has_pixels", "encapsulated", "pixel_bytes"), "file").withColumns(
        {"syntax": F.lit("1.2.840.10008.1.2.5"), "frames": F.lit(3), "samples": F.lit(1), "photometric": F.lit("MONOCHROME2"), "planar": F.lit(0), "rows": F.lit(2), "columns": F.lit(2), "bits_allocated": F.lit(8), "bits_stored": F.lit(8), "high_bit": F.lit(7)}
    )
    registry = spark.createDataFrame([("1.2.840.10008.1.2.5", "RLE Lossless")], "uid string, name string")
    assert {r["name"]: r["decodability"] for r in pixels.decodability(images, registry).collect()} == {"right": "ok", "wrong": "unsupported-format", "back": "unsupported-format", "none": "ok"}


def test_implicit_gives_the_same(spark):
    from tests.dicom import sequence

    vrs = {"00100010": "PN", "00280010": "US", "00081140": "SQ", "00100020": "LO"}
    body = lambda implicit: sequence("00081140", [element("00100020", "LO", "ID", implicit)], implicit=implicit) + element("00100010", "PN", "A^B", implicit) + element("00280010", "US", (513).to_bytes(2, "little"), implicit)
    one, two = scan.read_metadata(part10(body(False))), scan.read_metadata(part10(body(True), "1.2.840.10008.1.2"), vrs)
    same = lambda rows: [(r["path"], r["vr"], r["value"]) for r in rows if r["tag"] != "00020010"]
    assert same(one) == same(two) and ("00280010", "US", "513") in same(one)


def test_numeric_texts():
    import struct

    assert scan.numbers_text(struct.pack("<f", 0.1), "FL") == "0.1"
    assert scan.numbers_text(struct.pack("<2f", 1.0, 2.5), "FL") == "1\\2.5"
    assert scan.numbers_text(struct.pack("<d", 3.0), "FD") == "3"
    assert scan.numbers_text(b"\x10\x00\x20\x00", "AT") == "(0010,0020)"
    assert scan.numbers_text(b"\1\0\0", "US") is None and scan.numbers_text(b"", "US") == ""
    assert scan.numbers_text(struct.pack("<20H", *range(20)), "US").endswith("\\15 … (20 values in all)")


def test_refused_files():
    for syntax in scan.REFUSED:
        with pytest.raises(ValueError, match="not read"):
            scan.read_metadata(part10(b"", syntax))


def test_precedence(spark, tables):
    profile = spark.createDataFrame([("60003000", None)], "tag string, action string")
    rows = spark.createDataFrame([("f", t) for t in ("60003000", "601e3000", "60013000", "00280301", "00080060")], "file string, tag string").withColumns({"path": F.col("tag"), "value": F.lit("v")})
    got = {r["tag"]: (r["kind"], r["action"]) for r in classify.classify(rows, profile, tables[1]).collect()}
    assert got == {"60003000": ("annex-e", None), "601e3000": ("annex-e", "X"), "60013000": ("private", None), "00280301": ("burned-in", None)}
