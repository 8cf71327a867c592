import pytest
from pyspark.sql import functions as F

from metaudit.functions import display, geometry, tags, voi


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize_tag(spark):
    good = ["(0010,0010)", "0010,0010", "00100010", "0x00100010", "X00100010", "  (0010,0010) "]
    bad = ["", "   ", "0010", "001000100", "(0010,001)", "(00100010)", "( 0010 , 0010 )", "0x0010,0010", "(0010,0010", "zzzzzzzz", "0xx0100010", None]
    assert {r[0] for r in values(spark, [(x,) for x in good], "s string", tags.normalize_tag(F.col("s")))} == {"00100010"}
    assert {r[0] for r in values(spark, [(x,) for x in bad], "s string", tags.normalize_tag(F.col("s")))} == {None}
    with pytest.raises(Exception, match="zzzzzzzz"):
        values(spark, [("zzzzzzzz",)], "s string", tags.normalize_tag(F.col("s"), strict=True))


def test_tag_parts(spark):
    t = F.col("t")
    assert values(spark, [("00291010",), ("002900ff",), ("7fe00010",)], "t string", tags.format_tag(t), tags.tag_group(t), tags.tag_element(t), tags.is_private(t), tags.is_private_creator(t)) == [
        ("(0029,1010)", 0x29, 0x1010, True, False),
        ("(0029,00FF)", 0x29, 0xFF, True, True),
        ("(7FE0,0010)", 0x7FE0, 0x10, False, False),
    ]
    assert values(spark, [("US or SS", "04000561/0/04000550/0/00080090")], "v string, p string", tags.first_vr(F.col("v")), tags.tag_of_path(F.col("p")), tags.path_depth(F.col("p"))) == [("US", "00080090", 2.0)]


def test_numbers(spark):
    rows = [("1.5",), ("",), ("abc",), ("1d",), ("NaN",), (" -2e3 ",), (None,)]
    assert [r[0] for r in values(spark, rows, "s string", geometry.number(F.col("s")))] == [1.5, None, None, None, None, -2000.0, None]
    assert [r[0] for r in values(spark, [("1\\2\\3",), ("1\\2",), ("1\\x\\3",)], "s string", geometry.numbers(F.col("s"), 3))] == [[1.0, 2.0, 3.0], None, None]


def test_geometry(spark):
    tilted = [1.0, 0.0, 0.0, 0.0, 0.8, -0.6]
    rows = [(tilted, [0.0, 10.0, 0.0]), (tilted, [0.0, 0.0, 5.0]), (tilted, [0.0, 0.0, 10.0]), ([0.0] * 6, [1.0, 1.0, 1.0])]
    got = values(spark, rows, "o array<double>, p array<double>", geometry.project(F.col("p"), geometry.slice_normal(F.col("o"))))
    assert [None if r[0] is None else round(r[0], 9) for r in got] == [6.0, 4.0, 8.0, None]
    flat = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    near = [(flat, [1.0, 0.0, d, 0.0, 1.0, 0.0]) for d in (5e-5, 1e-4, 5e-3)]
    assert [r[0] for r in values(spark, near, "a array<double>, b array<double>", geometry.orientations_agree(F.col("a"), F.col("b")))] == [True, True, False]


def test_display(spark):
    rows = [("A^B", "PN", None), ("", "PN", None), (None, "SQ", None), (None, "LO", None), ("x", "OB", 1234), ("x", "OB", 1), (None, "UN", None)]
    args = [F.col("v"), F.col("r"), F.col("n")]
    assert values(spark, rows, "v string, r string, n bigint", display.plain_text(*args), display.masked(*args)) == [
        ("A^B", "●●●●●●●●"), ("(empty)", "(empty)"), ("(sequence)", "(sequence)"), ("(not shown)", "(not shown)"),
        ("<binary, 1,234 bytes>", "<binary, 1,234 bytes>"), ("<binary, 1 byte>", "<binary, 1 byte>"), ("<binary, length not stated>", "<binary, length not stated>"),
    ]
    assert [r[0] for r in values(spark, [(3.0199999999999996,), (6.0,), (-2.5,), (0.0005,), (12.34,)], "d double", display.format_mm(F.col("d")))] == ["3.02", "6", "-2.5", "0.001", "12.34"]
    names = [(list("abcde"),), (list("abcdefg"),)]
    assert [r[0] for r in values(spark, names, "f array<string>", display.file_list(F.col("f")))] == ["a, b, c, d, e", "a, b, c, d, e, and 2 more"]
    assert [r[0] for r in values(spark, [("My Folder (2)",), ("---",), (None,)], "s string", display.slug(F.col("s")))] == ["my-folder-2", "files", "files"]
    assert values(spark, [("2026-01-15 14:30:00",)], "s string", display.report_filename(F.lit("A b"), "md", F.col("s").cast("timestamp"))) == [("metaudit-a-b-2026-01-15.md",)]
    assert [r[0] for r in values(spark, [("X",), ("Q",), (None,)], "a string", display.action_gloss(F.col("a")))] == ["remove", "Q", None]


def test_voi(spark):
    rows = [(0, 0), (4095, 255), (448, 46)]
    x = voi.rescale(F.col("s"), F.lit(2.0), F.lit(-1024.0))
    got = values(spark, [(s,) for s, _ in rows], "s bigint", voi.grey_level(x, F.lit(0.0), F.lit(400.0), F.lit(False)), voi.grey_level(x, F.lit(0.0), F.lit(400.0), F.lit(True)))
    assert got == [(g, 255 - g) for _, g in rows]
    stored = voi.stored_value(F.col("w"), F.lit(12), F.lit(15), F.col("g"))
    assert values(spark, [(0xFFF0, True), (0xFFF0, False), (0x7FF0, True)], "w bigint, g boolean", stored) == [(-1,), (4095,), (2047,)]
