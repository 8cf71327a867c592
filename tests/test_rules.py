import random
import time

import pytest
from pyspark.sql import functions as F

from metaudit.operators import checks, pixels, series
from metaudit.sources import tables

ORDERED = "study string, series string, file string, distance double, ordered_by string, instance_number double"


def ordered(spark, distances, names=None):
    rows = [("s", "1", (names or [f"f{k}" for k in range(len(distances))])[k], float(d), "position", None) for k, d in enumerate(distances)]
    return series.with_ordinal(spark.createDataFrame(rows, ORDERED))


@pytest.mark.parametrize(
    ("distances", "gaps"),
    [([0, 3, 6, 9], 0), ([0, 100], 0), ([1e-6, 3, 6 - 1e-6, 9, 12 + 1e-6], 0), ([0, 3, 6, 12, 15], 1), ([0, 3, 6.02, 9.02], 1), ([0, 3, 6, 12, 18], 2)],
)
def test_gaps(spark, distances, gaps):
    found = checks.position_gaps(ordered(spark, distances)).collect()
    assert len(found) == 2 * gaps
    if gaps == 2:
        assert {r["expected"] for r in found} == {3.0}


def test_duplicates(spark):
    found = checks.duplicate_positions(ordered(spark, [0, 3, 3.005, 6])).collect()
    assert sorted(r["file"] for r in found) == ["f1", "f2"]
    assert checks.duplicate_positions(ordered(spark, [0, 3, 6])).count() == 0


def test_majority_tie(spark):
    files = series.with_ordinal(spark.createDataFrame([("s", "1", f, 0.0, "filename", None) for f in "abc"], ORDERED))
    findings = spark.createDataFrame([("a", "ZEBRA"), ("b", "APPLE"), ("c", "MANGO")], "file string, value string").withColumns({"path": F.lit("00100020"), "tag": F.lit("00100020"), "kind": F.lit("annex-e")})
    found = checks.varying_values(files, findings).collect()
    assert {r["expected_value"] for r in found} == {"APPLE"} and sorted(r["file"] for r in found) == ["a", "c"]
    exempt = findings.withColumns({"path": F.lit("00080018"), "tag": F.lit("00080018")})
    assert checks.varying_values(files, exempt).count() == 0


def test_spacing(spark):
    rows = [("s", "1", f"f{k}", float(k), "position", None, v) for k, v in enumerate(["0.5\\0.5", "0.50005\\0.5", "0.6\\0.6", "0.5", None])]
    files = series.with_ordinal(spark.createDataFrame(rows, ORDERED + ", spacing string"))
    found = {r["file"]: r["expected_value"] for r in checks.spacing_outliers(files).collect()}
    assert found == {"f2": "0.5\\0.5", "f3": "0.5\\0.5"}


def leads_of(spacings, tolerance=1e-4):
    """The lead of each spacing, by comparing it with all leads before."""
    leads, out = [], {}
    for s in spacings:
        if s not in out:
            near = [g for g in leads if abs(g[0] - s[0]) <= tolerance and abs(g[1] - s[1]) <= tolerance]
            if not near:
                leads.append(s)
            out[s] = near[0] if near else s
    return out


@pytest.mark.parametrize("few", [64, 0])
def test_spacing_groups_match_brute_force(spark, few):
    rng = random.Random(8)
    rows, want = [], {}
    for n in range(12):
        step = rng.choice([0.00003, 0.00006, 0.0002, 0.5])
        own = [(1 + rng.randrange(4) * step, 1 + rng.randrange(6) * step) for _ in range(40)]
        rows += [("s", str(n), f"f{n}-{k:02}", float(k), "position", None, f"{a!r}\\{b!r}") for k, (a, b) in enumerate(own)]
        lead = leads_of(own)
        sizes = {}
        for s in own:
            sizes[lead[s]] = sizes.get(lead[s], 0) + 1
        first = {g: own.index(g) for g in sizes}
        most = min(sizes, key=lambda g: (-sizes[g], *g, first[g]))
        want |= {f"f{n}-{k:02}": (first[lead[s]], "{!r}\\{!r}".format(*most)) for k, s in enumerate(own) if lead[s] != most}
    files = series.with_ordinal(spark.createDataFrame(rows, ORDERED + ", spacing string"))
    got = {r["file"]: (int(r["item"]), r["expected_value"]) for r in checks.spacing_outliers(files, few=few).collect()}
    assert got == want


def test_very_many_spacings(spark):
    """A hundred thousand distinct spacings of one series, each near others."""
    c = F.col
    files = spark.range(100_000).select(F.lit("s").alias("study"), F.lit("1").alias("series"), F.concat(F.lit("f"), "id").alias("file"), c("id").alias("ordinal"), F.concat_ws("\\", 1 + c("id") % 317 * 0.00007, 1 + F.floor(c("id") / 317) * 0.00007).alias("spacing"))
    began = time.time()
    assert checks.spacing_outliers(files).count() > 90_000 and time.time() - began < 60


@pytest.fixture(scope="module")
def large(spark):
    """Series of some hundred files each, with steps, repeats, odd orientations and absent numbers."""
    rng, rows = random.Random(9), []
    flat, tilt = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    for n in range(6):
        z = 0.0
        for k in range(300):
            z += rng.choice([2.5, 2.5, 2.5, 5.0, 0.0, 0.004])
            orientation = tilt if n == 1 and k == 200 else None if n == 2 and k == 3 else flat
            number = None if n in (3,) and k % 7 == 0 else float(k % 250)
            position = None if n in (3, 4) and k == 50 else [0.0, 0.0, z]
            rows.append((f"t{n % 2}", f"s{n}", f"f{n}-{rng.randrange(10**9)}-{k}", orientation, position, number, "MR" if n == 5 and k == 7 else "CT" if n % 2 else None))
    rows += [(None, "s1", "loose", flat, [0.0, 0.0, 0.0], 1.0, "CT"), ("t0", "small", "one", flat, [0.0, 0.0, 0.0], 1.0, "CT")]
    return spark.createDataFrame(rows, "study string, series string, file string, orientation array<double>, position array<double>, instance_number double, modality string").repartition(5)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_large_series_are_sorted_in_parts(spark, large):
    """The same rows where series are too large for a window, of places and of all checks."""
    by_windows, by_parts = series.order_series(large).cache(), series.order_series(large, hot_files=100).cache()
    assert by_windows.columns == by_parts.columns and rows_of(by_windows) == rows_of(by_parts)
    assert {r["ordered_by"] for r in by_parts.collect()} == {"position", "instance-number", "filename"}
    marks = [checks._gap_marks(0.01), checks._duplicate_marks(0.01), checks._orientation_marks(), checks._modality_marks()]
    plain = checks._marked(by_windows, marks, None)
    for block in (17, 1 << 17):
        hot = checks._marked(by_windows, marks, checks._placed_columns(0.01, block), hot_files=100)
        assert rows_of(plain) == rows_of(hot)
    assert {r["check_no"] for r in plain.select("check_no").distinct().collect()} == {1, 2, 4, 5}


def test_fields_of_large_series(spark, large):
    ordered = series.order_series(large)
    k = F.xxhash64("file")
    fields = F.array(F.struct(F.lit("00100010").alias("tag"), F.when(k % 5 > 0, F.lit("A")).otherwise(F.lit("B")).alias("v")), F.struct(F.when(k % 9 > 0, F.lit("00290010")).alias("tag"), F.lit("x").alias("v")), F.struct(F.lit("00100020").alias("tag"), F.when(k % 11 == 0, F.lit("")).alias("v")))
    found = large.select("study", "series", "file", F.explode(fields).alias("f")).filter("f.tag IS NOT NULL").select("study", "series", "file", F.col("f.tag").alias("path"), "f.tag", F.when(F.col("f.tag") == "00290010", "private").otherwise("annex-e").alias("kind"), F.col("f.v").alias("value"))
    marks = [checks._varying_marks(()), checks._extra_marks()]
    joined = found.join(ordered.select("study", "series", "file", "ordinal", "n_files"), ["study", "series", "file"])
    plain = checks._marked(joined, marks, None)
    assert rows_of(plain) == rows_of(checks._marked(joined, marks, checks._field_columns(()), hot_files=100))
    # With and without the series beside each finding.
    for run in (checks.varying_values, checks.extra_fields):
        assert rows_of(run(ordered, found)) == rows_of(run(ordered, found.drop("study", "series")))


def test_ladder(spark):
    flat, tilt = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    schema = "study string, series string, file string, orientation array<double>, position array<double>, instance_number double"
    rows = [("s", "p", "a", flat, [0.0, 0.0, 9.0], None), ("s", "p", "b", flat, [0.0, 0.0, 1.0], None)]
    rows += [("s", "n", "c", flat, [0.0, 0.0, 1.0], 2.0), ("s", "n", "d", tilt, [0.0, 0.0, 2.0], 1.0)]
    rows += [("s", "f", "y", None, None, 1.0), ("s", "f", "x", None, None, None), (None, "z", "u", None, None, None), ("s", None, "v", None, None, None), (None, None, "w", None, None, None)]
    files = spark.createDataFrame(rows, schema)
    got = {r["file"]: (r["ordered_by"], r["ordinal"], r["orientation_consistent"]) for r in series.order_series(files).collect()}
    assert got == {"b": ("position", 0, True), "a": ("position", 1, True), "d": ("instance-number", 0, False), "c": ("instance-number", 1, False), "x": ("filename", 0, True), "y": ("filename", 1, True)}
    assert {r["file"]: r["reason"] for r in series.ungrouped(files).collect()} == {"u": "missing-study", "v": "missing-series", "w": "missing-both"}


def test_shared_series_and_modes(spark):
    rows = [("s1", "x", "a", 0.0, "filename", None), ("s2", "x", "b", 0.0, "filename", None), ("s1", "y", "c", 0.0, "filename", None)]
    assert sorted(r["file"] for r in checks.shared_series(series.with_ordinal(spark.createDataFrame(rows, ORDERED))).collect()) == ["a", "b"]
    values = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    assert {r["k"]: r["v"] for r in series.most_common(values, ["k"], "v").collect()} == {1: "a", 2: None}


def test_frames(spark):
    pieces = spark.createDataFrame([(f, i, i * 10) for f in "abcd" for i in range(4)], "file string, idx int, offset bigint")
    images = spark.createDataFrame([("a", 1, None), ("b", 4, []), ("c", 2, [0, 20]), ("d", 3, [])], "file string, frames int, offset_table array<bigint>")
    got = {}
    for r in pixels.fragments_to_frames(pieces, images).collect():
        got.setdefault(r["file"], []).append((r["idx"], r["frame"]))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(i, 0) for i in range(4)], "b": [(i, i) for i in range(4)], "c": [(0, 0), (1, 0), (2, 1), (3, 1)]}


def test_run_lengths(spark):
    assert pixels.unpack_segment(bytes([2, 1, 2, 3, 254, 9, 128]), 6) == bytes([1, 2, 3, 9, 9, 9])
    with pytest.raises(ValueError):
        pixels.unpack_segment(bytes([5, 1]), 6)
    header = (2).to_bytes(4, "little") + (64).to_bytes(4, "little") + (67).to_bytes(4, "little")
    frame = header.ljust(64, b"\0") + bytes([1, 0x0A, 0x0B]) + bytes([1, 0x01, 0x02])
    rows = spark.createDataFrame([("f", 0, bytearray(frame), 2, 1, 2, True), ("g", 0, bytearray(b"\1\0"), 2, 1, 2, False)], "file string, frame int, data binary, pixels int, samples int, width int, packed boolean")
    got = {r["file"]: (r["words"], r["error"]) for r in pixels.frame_samples(rows).collect()}
    assert got["f"] == ([0x0A01, 0x0B02], None) and got["g"][0] is None and got["g"][1]


def test_tables(spark, tmp_path):
    actions = {f"c{k}": "X" for k in range(11)}
    import json

    good = {"tag": "00100010", "name": "N", "retired": False, "inStandardCompositeIod": True, "actions": actions}
    patterns = [{"tagPattern": m, "match": "nibbleMask", "mask": m, "name": "n", "retired": False, "actions": actions} for m in tables.PROFILE_MASKS] + [{"tagPattern": "odd", "match": "oddGroup", "name": "n", "retired": False, "actions": actions}]
    (tmp_path / "p.json").write_text(json.dumps({"source": {"edition": "2026a"}, "attributes": [good], "patterns": patterns}))
    profile, masks = tables.load_profile(spark, str(tmp_path / "p.json"), "c3")
    assert profile.first()["action"] == "X" and tables.validate_profile(profile, masks).count() == 0
    bad = [good, good, good | {"tag": "(0010)", "actions": {"c0": "Q"}}]
    (tmp_path / "b.json").write_text(json.dumps({"source": {"edition": "2026b"}, "attributes": bad, "patterns": patterns[:3]}))
    found = {(r["subject"], r["violation"]) for r in tables.validate_profile(*tables.load_profile(spark, str(tmp_path / "b.json"))).collect()}
    assert {("00100010", "occurs more than once"), ("(0010)", "tag is not normalised"), ("(0010)", "has an unknown action"), ("oddGroup", "pattern row is missing")} <= found
    (tmp_path / "d.json").write_text(json.dumps({"source": {"edition": "2026b"}, "attributes": {"00100010": {"name": "N", "vr": "PN"}}, "patterns": [{"tagPattern": "x", "mask": "50xx00g0", "name": "n", "vr": "US"}]}))
    words = {r["violation"] for r in tables.validate_dictionary(*tables.load_dictionary(spark, str(tmp_path / "d.json")), profile).collect()}
    assert words == {"invalid mask", "edition differs from the profile's"}
    (tmp_path / "t.json").write_text(json.dumps({"1.2": "Implicit"}))
    assert tables.load_transfer_syntaxes(spark, str(tmp_path / "t.json")).collect() == [("1.2", "Implicit")]


def test_diff(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, checks.diff_findings(a, b).collect())) == [(1, "missing"), (2, "missing"), (3, "extra")]
